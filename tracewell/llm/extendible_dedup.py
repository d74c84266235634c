"""Exact deduplication through an extendible-hash index on shared files."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.tables import bucketed, discard, stored, whole_number, whole_text

WHITE_SPACE = r"[\x20\x09-\x0D]+"
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")
#: Entries that the copies of one text may leave in the files of their slot.
SPREAD = 8
_SIGN = 2**63


def directory(hashes: DataFrame, capacity: int) -> DataFrame:
    """The directory over ``h``: one row per slot with the bucket it points to.

    A directory of depth g has 2**g slots, named by the first g bits of the
    hash. Doubling it splits every bucket with more than ``capacity`` keys;
    the doublings of all depths are counted in one aggregation, and a slot
    points to the shallowest bucket that fits. Several slots share a bucket
    that needed no split. Keys that agree in all bits of the deepest directory
    overflow their bucket and are chained there.
    """
    depth = max(1, math.ceil(math.log2(max(1, hashes.count()) / capacity)) + 2)
    slots = hashes.groupBy(F.shiftrightunsigned("h", 64 - depth).alias("slot")).agg(F.count(F.lit(1)).alias("keys"))
    halves = slots.select("slot", "keys", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    halves = halves.withColumn("bucket", F.expr(f"shiftright(slot, {depth} - depth)"))
    buckets = halves.groupBy("depth", "bucket").agg(F.sum("keys").alias("bucket_keys"))
    fits = (F.col("bucket_keys") <= capacity) | (F.col("depth") == depth)
    return (halves.join(buckets.where(fits), ["depth", "bucket"]).groupBy("slot").agg(F.min("depth").alias("depth"))
            .select("slot", "depth", F.expr(f"shiftright(slot, {depth} - depth)").alias("bucket"), F.lit(depth).alias("global_depth")))


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = 4096) -> DataFrame:
    """The stored index: one row per distinct normalised text.

    Columns: bucket, depth, h, chain (place among different texts of one
    hash), text_sha256, keep_id, group_size.

    The directory comes first, from the distinct hashes alone; its depth says
    how many slots the files have. Texts are then written once more as entries
    of their slot's files. Copies are combined before they are written, apart by
    ``SPREAD`` parts of the ids, so a text held by a third of all rows
    reaches the files as at most that many entries, and never meets in one
    task before. An owner task reads the files of its slots and settles there,
    without another shuffle, what equals what: entries of one hash are
    compared by their bytes, different ones are chained.
    """
    norm = F.regexp_replace(whole_text(text), WHITE_SPACE, "")
    # longest original first, then smallest id: one fixed-width number, so that the aggregation hashes and never sorts
    rank = (F.char_length(whole_text(text)).cast("decimal(38,0)") * whole_number(2**64)
            + (whole_number(_SIGN - 1) - F.col(doc_id))).cast("decimal(38,0)")
    slots = stored(directory(stored(docs.select(F.xxhash64(norm).alias("h")).distinct()), capacity))
    depth = slots.agg(F.max("global_depth")).first()[0] or 1
    rows = docs.select(norm.alias("norm"), rank.alias("rank"), F.pmod(F.xxhash64(doc_id), F.lit(SPREAD)).alias("part"))
    rows = rows.withColumn("h", F.xxhash64("norm")).withColumn("slot", F.shiftrightunsigned("h", 64 - depth))
    entries = bucketed(rows.groupBy("slot", "h", "norm", "part").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n")).drop("part"), "slot")
    owned = entries.groupBy("slot", "h", "norm").agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"))
    keep = (whole_number(_SIGN - 1) - F.col("rank") % whole_number(2**64)).cast("bigint")
    texts = owned.select("slot", "h", F.sha2("norm", 256).alias("text_sha256"), keep.alias("keep_id"), "group_size")
    chain = F.row_number().over(Window.partitionBy("slot", "h").orderBy("text_sha256"))
    index = texts.withColumn("chain", chain).join(slots.drop("global_depth"), "slot")
    index = stored(index.select("bucket", "depth", "h", "chain", "text_sha256", "keep_id", "group_size"))
    discard(entries, slots)
    return index


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = 4096) -> DataFrame:
    """Add keep_id, group_size, kept and text_sha256 to every row.

    Texts are equal when identical without the characters of ``WHITE_SPACE``;
    NULL is an empty text. Of equal texts the row with the most code points
    stays, then the smallest id. Rows that repeat the id that stays are all
    kept; rows without an id stay only where no row of the group has one
    (keep_id is then NULL). An empty table gives an empty result.
    """
    index = build_index(docs, text, doc_id, capacity).where("group_size > 1")
    index = index.select(F.col("h").alias("_t_h"), F.col("text_sha256").alias("_t_sha"), F.col("keep_id").alias("_t_keep"),
                         F.col("group_size").alias("_t_size"))
    norm = F.regexp_replace(whole_text(text), WHITE_SPACE, "")
    rows = docs.drop(*RESULTS).withColumns({"_t_h": F.xxhash64(norm), "_t_sha": F.sha2(norm, 256)})
    found = rows.join(index, ["_t_h", "_t_sha"], "left")
    return found.withColumns({
        "keep_id": F.when(F.col("_t_size").isNull(), F.col(doc_id)).otherwise(F.col("_t_keep")),
        "group_size": F.coalesce("_t_size", F.lit(1).cast("bigint")),
        "text_sha256": F.col("_t_sha"),
    }).withColumn("kept", F.col(doc_id).eqNullSafe(F.col("keep_id"))).drop("_t_h", "_t_sha", "_t_keep", "_t_size")
