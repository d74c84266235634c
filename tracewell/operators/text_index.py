"""Word search over messages, by scan or through a stored inverted index."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.postings import packed_rows

BUCKETS = 256
#: Parts a shuffle partition that texts are dealt to.
PARTS = 4


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _wanted(query: str | Sequence[str]) -> list[str]:
    """The words of a query, cut as texts are; none for a query without letters and digits."""
    terms = [query] if isinstance(query, str) else query
    return sorted({word for t in terms for word in re.findall(r"[^\W_]+", t.lower())})


def text_search(docs: DataFrame, id_col: str, text_col: str, query: str | Sequence[str]) -> DataFrame:
    """Ids of the texts that hold every word of the query, with the number of hits.

    A query without a word finds nothing, here as in the index.
    """
    wanted = F.array(*[F.lit(w) for w in _wanted(query)]).cast("array<string>")
    scanned = docs.select(id_col, F.filter(words(F.col(text_col)), lambda w: F.array_contains(wanted, w)).alias("_hits"))
    return scanned.where(
        (F.size("_hits") > 0) & (F.size(F.array_distinct("_hits")) == F.size(wanted))).select(id_col, F.size("_hits").cast("bigint").alias("hits"))


def build_text_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Inverted index as rows ``bucket, word, id, hits``.

    One row per word and text rather than one list per word: a word found
    everywhere has no list that must fit in memory.
    """
    # texts are smaller than their words: they are dealt by id, in parts small enough for the words of one to be counted in memory
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = docs.select(id_col, text_col).repartition(parts, id_col).select(id_col, F.explode(words(F.col(text_col))).alias("word"))
    return pairs.groupBy("word", id_col).agg(F.count(F.lit(1)).alias("hits")) \
        .select(bucket_of(F.col("word")).alias("bucket"), "word", id_col, "hits")


def bucket_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def write_text_index(index: DataFrame, path: str) -> None:
    """Store by bucket, sorted by word, so that a lookup reads one small part of few files; rows ``bucket, word, ids,
    hits`` hold a word's texts of one batch."""
    id_col = next(c for c in index.columns if c not in ("bucket", "word", "hits"))
    blocks = packed_rows(index, id_col).hint("rebalance", "bucket").sortWithinPartitions("bucket", "word")
    blocks.write.partitionBy("bucket").mode("append").option("compression", "zstd").parquet(path)


def search_text_index(index: DataFrame, id_col: str, query: str | Sequence[str]) -> DataFrame:
    """As ``text_search``, from an index as it was built or stored. Rows stored more than once, by a repeated or resumed write, count once."""
    wanted = _wanted(query)
    # The buckets are constant expressions, so that the scan prunes partitions.
    in_bucket = F.lit(False)
    for w in wanted:
        in_bucket = in_bucket | (F.col("bucket") == bucket_of(F.lit(w)))
    found = index.where(in_bucket & F.col("word").isin(wanted))
    if "ids" in index.columns:
        found = found.select("word", F.inline(F.arrays_zip("ids", "hits")).alias(id_col, "hits"))
    found = found.groupBy(id_col, "word").agg(F.max("hits").alias("hits"))
    return found.groupBy(id_col).agg(F.count(F.lit(1)).alias("_words"), F.sum("hits").alias("hits")) \
        .where(F.col("_words") == len(wanted)).select(id_col, "hits")
