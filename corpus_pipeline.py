"""The corpus pipeline: documents that are good, distinct and without long repeats, packed into training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.column_suffixes import suffix_dedup
from tracewell.llm.extendible_dedup import exact_dedup
from tracewell.llm.factorisation import score, train
from tracewell.llm.gray_simhash import fingerprints, simhash_dedup
from tracewell.llm.order_packing import pack
from tracewell.llm.tables import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, fitted on a bounded sample of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels)).where("predicted = 1").select(*COLUMNS)


def one_each(docs: DataFrame, *key: str) -> DataFrame:
    """One row of all that share a key: the longest text, then the first by its columns; copies meet in map-side steps."""
    first = F.min(F.struct((-F.char_length(F.coalesce("text", F.lit("")))).alias("less"), *COLUMNS))
    return docs.groupBy(*key).agg(first.alias("first")).select(*[F.col(f"first.{c}").alias(c) for c in COLUMNS])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space, rows that repeat an id included."""
    kept = exact_dedup(docs.select(*COLUMNS)).where("kept")
    return one_each(kept, "doc_id", "text_sha256")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints at 3 or fewer bits, of shingles of 3 words."""
    grouped = simhash_dedup(fingerprints(docs.select(*COLUMNS), width=3), most=3)
    return one_each(grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id"))), "group_id")


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 400-byte strings that start anywhere else too; a document may end up empty, but stays."""
    cut = suffix_dedup(docs.select(*COLUMNS), length=400, decoded=True)
    return cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


#: Every stage takes (spark, docs, sf_dir); it works on the table that the stage before it wrote.
STAGES = [("quality", good_quality), ("exact_dedup", exact), ("simhash_dedup", near), ("suffix_dedup", long_repeats), ("packing", packing)]
#: SQL can express neither the classifier nor the tokenizer; tests/llm/test_pipeline.py compares the stages with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
