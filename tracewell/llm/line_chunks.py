"""Removal of repeated runs of lines, cut at content-defined boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.expr import let
from tracewell.llm.tables import stored, whole_text

WINDOW, DIVISOR, LEAST_LINES = 3, 4, 2
BASE, PRIME = 16807, 2**31 - 1
RESULTS = ("n_lines", "n_chunks", "removed_chunks", "removed_lines", "kept_text")


def chunks(text: Column) -> Column:
    """The chunks of a text: array of (no, n_lines, body).

    Every line has a 32-bit hash; a polynomial rolls over the hashes of three
    lines, and a chunk ends after a line where it is divisible by ``DIVISOR``
    (or at the end). An inserted or deleted line moves only the boundaries
    whose three lines it touches.
    """
    def line_hash(line: Column) -> Column:
        return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint") % PRIME

    def rolling(hashes: Column, at: Column) -> Column:
        value = F.coalesce(F.get(hashes, at - (WINDOW - 1)), F.lit(0))
        for back in range(WINDOW - 2, -1, -1):
            value = (value * BASE + F.coalesce(F.get(hashes, at - back), F.lit(0))) % PRIME
        return value

    def ends(lines: Column, hashes: Column) -> Column:
        last = F.size(lines) - 1
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (rolling(hashes, i) % DIVISOR == 0))

    def cut(lines: Column, stops: Column) -> Column:
        def chunk(end: Column, no: Column) -> Column:
            start = F.when(no == 0, 0).otherwise(F.get(stops, no - 1) + 1)
            return let(start, lambda s: F.struct(no.alias("no"), (end - s + 1).alias("n_lines"),
                                                 F.array_join(F.slice(lines, s + 1, end - s + 1), "\n").alias("body")))
        return F.transform(stops, chunk)

    return let(F.split(text, "\n", -1), lambda lines: let(F.transform(lines, line_hash), lambda hashes: let(
        ends(lines, hashes), lambda stops: cut(lines, stops))))


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Drop every chunk of two or more lines whose bytes occurred before; add the counts and kept_text.

    The first occurrence, by id and place, stays; chunks of one line always
    stay. Hashes only find the boundaries: chunks are grouped by their whole
    text, copies first inside each task, so a very common passage is one row
    per task. NULL counts as an empty text of one line. Rows that repeat an id
    and a text count as one document; rows without an id never own the first
    occurrence while another row has one. An empty table gives an empty result.
    """
    docs = docs.drop(*RESULTS)
    parts = docs.select(F.col(doc_id).alias("id"), F.explode(chunks(whole_text(text))).alias("c")).where(F.col("c.n_lines") >= LEAST_LINES)
    # id and place in one fixed-width number, so that the aggregation hashes and never sorts
    place = (F.col("id").cast("decimal(38,0)") * F.lit(2**31) + F.col("c.no")).cast("decimal(38,0)")
    groups = parts.select(F.col("c.body").alias("body"), place.alias("place")).groupBy("body").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = stored(groups.where("n > 1").select(F.md5("body").alias("sum"), F.octet_length("body").alias("bytes"), "first"))
    places = parts.select("id", F.col("c.no").alias("no"), F.md5("c.body").alias("sum"), F.octet_length("c.body").alias("bytes"), place.alias("place"))
    later = places.join(repeated, ["sum", "bytes"]).where(~F.col("place").eqNullSafe(F.col("first")))
    key = F.xxhash64("no", "sum", "bytes")
    drops = stored(later.groupBy(F.col("id").alias("_t_id")).agg(F.collect_set(key).alias("_t_drop")))
    # what is dropped grows with the input: never broadcast, the same plan at every size
    found = docs.join(drops.hint("merge"), F.col(doc_id).eqNullSafe(F.col("_t_id")), "left")

    def result(all_chunks: Column) -> Column:
        def stays(c: Column) -> Column:
            gone = F.array_contains("_t_drop", F.xxhash64(c["no"], F.md5(c["body"]), F.octet_length(c["body"])))
            return (c["n_lines"] < LEAST_LINES) | ~F.coalesce(gone, F.lit(False))

        def count(some: Column) -> Column:
            return F.aggregate(some, F.lit(0).cast("bigint"), lambda n, c: n + c["n_lines"])

        return let(F.filter(all_chunks, stays), lambda kept: F.struct(
            count(all_chunks).alias("n_lines"), F.size(all_chunks).cast("bigint").alias("n_chunks"),
            (F.size(all_chunks) - F.size(kept)).cast("bigint").alias("removed_chunks"),
            (count(all_chunks) - count(kept)).alias("removed_lines"),
            F.array_join(F.transform(kept, lambda c: c["body"]), "\n").alias("kept_text")))

    columns = [F.col(c) for c in docs.columns]
    once = F.array(let(chunks(whole_text(text)), result))  # exploded, so that no column is computed twice
    return found.select(*columns, F.explode(once).alias("_t")).select(*columns, "_t.*")
