"""Fill-in-middle outputs against a plain cut of every text, and back."""

import hashlib
import re

import pyarrow as pa
from llm_samples import ODD
from pyspark.sql import functions as F

from tracewell.llm import fill_middle
from tracewell.llm.fill_middle import fill_in_middle, restored


def plainly(doc_id, text, seed="1"):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ROWS = [*ODD, *[(100 + i, f"Word{i},  ÿ<{'PSM'[i % 3]}{'>' * (i % 7 == 0)}<\n" * (i % 5)) for i in range(200)]]


def check(frame):
    got = frame.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted([(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=repr) == \
        sorted([(i, t, *plainly(i, t)) for i, t in ROWS], key=repr)
    assert all(r.back == (r.text or "") for r in got)
    return got


def test_outputs_and_restoring(documents):
    got = check(fill_in_middle(documents(ROWS)))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_small_slices(documents, monkeypatch):
    monkeypatch.setattr(fill_middle, "SLICE_BYTES", 64)
    texts = pa.array([t or "" for _, t in ROWS])
    parts = [texts[s] for s in fill_middle._slices(texts)]
    assert len(parts) > 10 and pa.concat_arrays(parts).equals(texts)
    check(fill_in_middle(documents(ROWS)))


def test_clashing_columns_and_empty_table(documents):
    frame = documents(ROWS).withColumn("n", F.lit("x")).withColumn("output", F.lit(1)).withColumn("form", F.lit(2))
    out = fill_in_middle(frame)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n", "form", "prefix_chars", "middle_chars", "output"]
    check(out)
    assert fill_in_middle(frame.limit(0)).collect() == []


def test_separator_is_absent():
    assert fill_middle._separator(pa.array(["a", "\ue000\ue001"])) == "\ue002"
