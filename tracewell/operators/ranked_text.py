"""Ranked and phrase search through a stored index of word positions."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tracewell.operators.postings import packed_postings
from tracewell.operators.text_index import bucket_of, words
from tracewell.sources.versions import Manifest, VersionedTable, partition_value

#: The usual parameters of BM25: how soon repeated words stop to count, and how much long texts are held back.
SATURATION, LENGTH_WEIGHT = 1.2, 0.75
#: The folder of the rows that hold one text each; words have buckets from 0.
TEXTS = -1
DIGITS = 9


def query_words(query: str) -> list[str]:
    """The words of a query in order, cut as texts are."""
    return re.findall(r"[^\W_]+", query.lower())


class RankedIndex:
    """Postings of texts by word bucket: immutable segments under one manifest, which ``merge`` turns into one.

    A row holds the texts of a batch that have a word, with its positions in
    them and their lengths, so that neither ranking nor phrases need a join. The
    number of texts and words of the whole index stand in the manifest.
    """

    def __init__(self, spark: SparkSession, root: str, id_type=None):
        self.spark, self.table = spark, VersionedTable(spark, root)
        numbers = ArrayType(IntegerType())
        self.schema = StructType([
            StructField("word", StringType()), StructField("ids", ArrayType(id_type or LongType())), StructField("lengths", numbers),
            StructField("counts", numbers), StructField("positions", numbers), StructField("bucket", IntegerType())])

    def _read(self, manifest: Manifest, buckets: set[int] | None = None) -> DataFrame:
        """Postings of some buckets; folders of others are not even listed to Spark."""
        folders = [f for f in manifest.folders if buckets is None or int(partition_value(f)) in buckets]
        if manifest.schema is None or not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.table.read(manifest, folders)

    def _write(self, postings: DataFrame) -> list[str]:
        return self.table.write(postings.sortWithinPartitions("bucket", "word"), "bucket", compression="zstd")

    def add(self, texts: DataFrame, id_col: str, text_col: str) -> Manifest:
        """Index texts as a new segment. A text whose id the index has already is left as it is, so a batch that
        is delivered again changes nothing; of several texts of one id in a batch the smallest counts. Rows
        without id or text are not indexed; a text without words counts as a text of length 0.
        """
        before = self.table.manifest()
        given = texts.select(F.col(id_col).cast(self.schema["ids"].dataType.elementType).alias("id"), F.col(text_col).alias("text")).dropna()
        known = self._read(before, {TEXTS}).select(F.explode("ids").alias("id"))
        new = given.groupBy("id").agg(F.min("text").alias("text")).join(known, "id", "left_anti") \
            .select("id", words(F.col("text")).alias("words"))
        rows = packed_postings(new).select("word", "ids", "lengths", "counts", "positions",
                                           F.when(F.col("word").isNull(), TEXTS).otherwise(bucket_of(F.col("word"))).alias("bucket"))
        # a segment is written where its texts are; ``merge`` gathers the parts of a bucket
        folders = self._write(rows)
        of_texts = [f for f in folders if int(partition_value(f)) == TEXTS]
        made = Manifest(schema=self.schema.jsonValue(), folders=of_texts)
        count = self._read(made).agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("texts"), F.coalesce(
            F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda total, n: total + n)), F.lit(0)).alias("words")).first()
        info = {key: before.info.get(key, 0) + count[key] for key in ("texts", "words")}
        return self.table.commit(before, before.folders + folders, self.schema, info)

    def merge(self) -> Manifest:
        """Rewrite all segments as one; readers see the segments or the merged one."""
        before = self.table.manifest()
        if before.schema is None:
            return before
        return self.table.commit(before, self._write(self._read(before).hint("rebalance", "bucket")), self.schema, before.info)

    def _postings(self, manifest: Manifest, wanted: list[str]) -> DataFrame:
        if not wanted:
            return self._read(manifest, set())
        buckets = self.spark.range(1).select(F.array(*[bucket_of(F.lit(w)) for w in wanted])).first()[0]
        return self._read(manifest, set(buckets)).where(F.col("word").isin(wanted))

    def search(self, query: str, k: int | None = None) -> DataFrame:
        """``id, score`` of the texts with any word of the query, by BM25; the best ``k`` in order, ties by id, or all.

        Words that are repeated in the query count once. Scores are rounded to 9 digits.
        """
        manifest, wanted = self.table.manifest(), sorted(set(query_words(query)))
        postings = self._postings(manifest, wanted).select("word", F.inline(F.arrays_zip("ids", "lengths", "counts")).alias("id", "length", "times"))
        total = manifest.info.get("texts", 0)
        mean = max(manifest.info.get("words", 0), 1) / max(total, 1)
        holding = {r.word: r["count"] for r in postings.groupBy("word").count().collect()}  # as many as the query has words
        weight = F.lit(0.0)
        for word, n in holding.items():
            weight = F.when(F.col("word") == word, math.log(1 + (total - n + 0.5) / (n + 0.5))).otherwise(weight)
        times = F.col("times")
        held_back = SATURATION * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * F.col("length") / mean)
        scored = postings.groupBy("id").agg(F.round(F.sum(weight * times * (SATURATION + 1) / (times + held_back)), DIGITS).alias("score"))
        return scored if k is None else scored.orderBy(F.col("score").desc(), "id").limit(k)

    def phrase(self, query: str) -> DataFrame:
        """``id, hits`` of the texts that hold the words of the query one after another, and how often.

        Every position of the phrase's ``i``-th word stands for a start ``i`` words before; a start that all words
        agree on is a hit. Texts are split over tasks by start, not gathered.
        """
        manifest, wanted = self.table.manifest(), query_words(query)
        places: dict[str, list[int]] = {}
        for i, word in enumerate(wanted):
            places.setdefault(word, []).append(i)
        postings = self._postings(manifest, sorted(places))
        offsets = F.lit(None).cast("array<int>")
        for word, at in places.items():
            offsets = F.when(F.col("word") == word, F.array(*[F.lit(i) for i in at])).otherwise(offsets)
        owners = F.flatten(F.transform("counts", lambda n, i: F.array_repeat(F.get(F.col("ids"), i), n)))
        spots = postings.select("word", F.inline(F.arrays_zip(owners.alias("id"), F.col("positions"))).alias("id", "position"))
        starts = spots.withColumn("offset", F.explode(offsets)) \
            .groupBy("id", (F.col("position") - F.col("offset")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
        return starts.where(F.col("n") == len(wanted)).groupBy("id").agg(F.count(F.lit(1)).alias("hits"))
