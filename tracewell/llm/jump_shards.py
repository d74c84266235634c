"""Sharding by jump consistent hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.tables import stored, whole_number, whole_text

#: Fixed values of the method's generator: multiplier, modulus, divisor that drops the low bits.
MULTIPLIER, MODULUS, DROPPED = 2862933555777941757, 2**64, 2**33
SLICE_ROWS = 8192
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
_USUAL_STEPS = 48


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a 64-bit key.

    A key jumps forward through the shard numbers; the last jump that stays
    below ``shards`` is its shard. With one more shard a key keeps its place
    or jumps into the new one. The generator's state is a decimal, as 64-bit
    products must wrap and SQL integers refuse to. About ln(shards) jumps are
    usual; the rare key that needs more than 48 is run again with as many as
    any key can need.
    """
    wide = key.cast("decimal(20,0)")
    start = F.struct(F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"),
                     F.when(key < 0, wide + whole_number(MODULUS)).otherwise(wide).cast("decimal(20,0)").alias("s"))

    def jump(at: Column) -> Column:
        state = ((at["s"] * whole_number(MULTIPLIER) + F.lit(1)) % whole_number(MODULUS)).cast("decimal(20,0)")

        def onward(s: Column) -> Column:
            high = F.call_function("div", s, whole_number(DROPPED)).cast("double") + 1
            return F.struct(at["j"].alias("b"), F.floor((at["j"] + 1) * (F.lit(2.0**31) / high)).cast("bigint").alias("j"), s.alias("s"))

        return F.transform(F.array(state), onward)[0]

    def walk(steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda at, _: F.when(at["j"] >= shards, at).otherwise(jump(at)))

    if shards <= _USUAL_STEPS:
        return walk(shards)["b"].cast("int")
    done = F.transform(F.array(walk(_USUAL_STEPS)), lambda at: F.when(at["j"] >= shards, at["b"]))[0]
    return F.coalesce(done, walk(shards)["b"]).cast("int")


def shard(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Add size, text_crc32, law, shard, slot and grown_shard to every row.

    The id alone decides the shard (by the hash of its value, so ids of any
    type will do; NULL is a key like another). Slots number the rows of a
    shard from 0 without gaps, rows of one id included: rows are counted in
    runs of ``SLICE_ROWS`` of the stored input, numbered inside a run, and
    moved by the counts of the runs before, so that no task ever sorts a
    shard. A NULL text has size 1 and the checksum of no bytes. An empty table
    gives an empty result.
    """
    content, key = whole_text(text), F.xxhash64(doc_id)
    placed = stored(docs.drop(*RESULTS).withColumns({
        "size": (F.octet_length(content) + 1).cast("bigint"),
        "text_crc32": F.crc32(content.cast("binary")),
        "law": F.lit("key"),
        "shard": jump_hash(key, shards),
        "grown_shard": jump_hash(key, shards + 1),
        "_t_at": F.monotonically_increasing_id(),
    })).withColumn("_t_run", F.expr(f"_t_at div {SLICE_ROWS}"))
    before = Window.partitionBy("shard").orderBy("_t_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("shard", "_t_run").agg(F.count(F.lit(1)).alias("_t_rows"))
    starts = runs.select("shard", "_t_run", F.coalesce(F.sum("_t_rows").over(before), F.lit(0)).alias("_t_start"))
    inside = F.row_number().over(Window.partitionBy("shard", "_t_run").orderBy("_t_at")) - 1
    return (placed.withColumn("_t_inside", inside).join(starts, ["shard", "_t_run"])
            .withColumn("slot", F.col("_t_start") + F.col("_t_inside")).drop("_t_at", "_t_run", "_t_start", "_t_inside"))
