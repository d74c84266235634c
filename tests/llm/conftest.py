import pytest
from llm_samples import ODD

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a table of documents from (doc_id, text) pairs."""
    def build(pairs):
        rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None if k % 5 == 0 else len(t or "")) for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, COLUMNS).repartition(3)
    return build


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)
