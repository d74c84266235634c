"""Embedding of text columns through a pluggable backend."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from tracewell.sources.versions import VersionedTable, rows_of

CALL_SIZE = 256
STORED = StructType([StructField("digest", StringType()), StructField("vector", ArrayType(FloatType()))])
Backend = Callable[[Sequence[str]], "np.ndarray | Sequence[Sequence[float]]"]


def embed(df: DataFrame, text_col: str, load: Callable[[], Backend], dims: int, out: str = "embedding",
          call_size: int = CALL_SIZE) -> DataFrame:
    """Add a vector per row. ``load`` runs once per task and returns the batch function, called with ``call_size`` texts at most.

    Only the text column goes through Python; a NULL text gives a NULL vector.
    A reply of the wrong shape fails the task, so no vector has another length.
    """
    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        backend = load()
        for texts in batches:
            given = np.flatnonzero(texts.notna())
            result: list = [None] * len(texts)
            for start in range(0, len(given), call_size):
                asked = given[start:start + call_size]
                matrix = np.asarray(backend(texts.iloc[asked].tolist()), dtype="float32")
                if matrix.shape != (len(asked), dims):
                    raise ValueError(f"backend returned shape {matrix.shape}, expected {(len(asked), dims)}")
                for at, vector in zip(asked, matrix):
                    result[at] = vector
            yield pd.Series(result, dtype=object)

    return df.withColumn(out, vectors(F.col(text_col)))


def embed_once(df: DataFrame, text_col: str, store: VersionedTable, load: Callable[[], Backend], dims: int, out: str = "embedding",
               call_size: int = CALL_SIZE) -> DataFrame:
    """As ``embed``, but a text goes to the backend once, however often it is repeated here and in later calls.

    ``store`` holds vectors by the SHA-256 of their text, for one backend; a
    further backend takes a store of its own. Texts that it lacks are combined
    before the shuffle, embedded and committed, then rows look up their vector.
    A task that is run again asks again for the texts it had not yet written.
    """
    before = store.manifest()
    known = rows_of(store, STORED, before)
    digest = F.sha2(F.col(text_col).cast("binary"), 256)
    texts = df.select(F.col(text_col).alias("text"), digest.alias("digest")).where("text IS NOT NULL") \
        .join(known.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
    made = store.write(embed(texts, "text", load, dims, "vector", call_size).select("digest", "vector"))
    if before.schema is None or not store.read(before, made).isEmpty():
        store.commit(before, before.folders + made, STORED, before.info)
    vectors = store.read().select(F.col("digest").alias("_digest"), F.col("vector").alias("_vector"))
    kept = [c for c in df.columns if c != out]
    return df.select(*kept, digest.alias("_digest")).join(vectors, "_digest", "left").select(*kept, F.col("_vector").alias(out))


def check_dims(df: DataFrame, col: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has the agreed length, and the others."""
    ok = F.coalesce(F.size(col) == dims, F.lit(False))
    return df.where(ok), df.where(~ok)
