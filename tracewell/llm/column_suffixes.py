"""Removal of repeated byte strings by column-wise suffix sorting of many strings at once.

A string of ``length`` bytes that starts in two places is found in three steps.

1. Anchors. Of the grams inside each such string the one with the least hash
   is its anchor; equal strings have equal anchors at equal distance. A
   table of (gram, place) therefore brings all candidates together. Places
   of a text that agree in their whole context and lie close, as in a line
   that a text repeats, are one row with the first, the last and their number.
2. Contexts. All strings with one anchor lie in a bounded context around it.
   Equal contexts settle each other by hash. Contexts that differ are aligned
   at the anchor and form a collection.
3. Columns. A collection is sorted as in multi-document suffix-array
   construction: from the right, one symbol of every context is inserted per
   round. The round's column is the collection's transform; the order of the
   suffixes and the common prefixes of neighbours follow from those of the
   round before by one stable sort and range minima, so a task holds two
   columns of state and reads its collections one after the other from the
   sorted shuffle files. A common prefix of ``length`` or more marks a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import bucketed, discard, stored, whole_text

RESULTS = ("n_bytes", "n_removed", "n_spans", "kept")
#: Bytes hashed at once; contexts sorted at once; contexts of one anchor sorted in one task.
SEGMENT, COLLECTION, LARGEST_GROUP = 1 << 20, 6000, 256
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_OUTSIDE = 256  # the symbol of places before or after a document; equal to nothing, not even itself


def _places(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The place of the anchor of every string of ``length`` bytes."""
    n, width = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, "i8")
    powers = np.cumprod(np.full(n, _BASE, "u8"))
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(data * powers)])
    value = (sums[gram:] - sums[:-gram]) * np.cumprod(np.full(n - gram + 1, _BASE_INVERSE, "u8"))
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(29)
    least, place, span = value, np.arange(len(value), dtype="i4"), 1

    def wider(by: int) -> None:
        nonlocal least, place
        left, right = least[:-by], least[by:]
        first = left <= right  # the leftmost of equals
        least, place = np.where(first, left, right), np.where(first, place[:-by], place[by:])

    while 2 * span <= width:
        wider(span)
        span *= 2
    if span < width:
        wider(width - span)
    return place


def _anchors_of(data: np.ndarray, stops: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Places of the anchors of all strings that lie inside one of the documents ending at ``stops``."""
    place = _places(data, length, gram)
    starts = np.arange(len(place))
    inside = stops[np.searchsorted(stops, starts, "right")] >= starts + length
    return np.unique(place[inside])



def anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (row, at, last, n, gram, context): the anchors of each text's strings, with hashes of gram and context.

    A row stands for the n places from ``at`` to ``last`` of one text that
    agree in gram and context and whose contexts touch or overlap.
    """
    before = length - gram

    def folded(row: np.ndarray, at: np.ndarray, grams: np.ndarray, contexts: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((at, contexts, grams, row))
        row, at, grams, contexts = row[order], at[order], grams[order], contexts[order]
        same = (row[1:] == row[:-1]) & (grams[1:] == grams[:-1]) & (contexts[1:] == contexts[:-1])
        near = same & (at[1:] - at[:-1] <= before + length)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), ~near]))
        stop = np.append(first[1:], len(at))
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (row[first], at[first], at[stop - 1], (stop - first).astype("i8"), grams[first], contexts[first])],
            ["row", "at", "last", "n", "gram", "context"])

    def flush(rows: list[int], parts: list[bytes], froms: list[int], whole: list[bytes], done: tuple[int, int]) -> tuple[pa.RecordBatch, tuple[int, int]]:
        data = np.frombuffer(b"".join(parts), "u1")
        stops = np.cumsum([len(p) for p in parts])
        at = _anchors_of(data, stops, length, gram)
        part = np.searchsorted(stops, at, "right")
        local = at - np.concatenate([[0], stops[:-1]])[part] + np.array(froms, "i8")[part]
        # anchors move with their strings, so what the segment before had too is not behind the place it ended at
        text_of = np.array(rows, "i8")[part]
        new = (text_of != np.append(done[0], text_of[:-1])) | (local > np.append(done[1], local[:-1]))
        part, local, text_of = part[new], local[new], text_of[new]
        if len(local):
            done = int(text_of[-1]), int(local[-1])
        digest = xxhash.xxh3_64_digest
        contexts, grams = [], []
        for p, a in zip(part.tolist(), local.tolist()):
            text, left = whole[p], min(a, before)
            contexts.append(digest(text[a - left:a + length], left))
            grams.append(digest(text[a:a + gram]))
        hashes = [np.frombuffer(b"".join(some), ">i8").astype("i8") for some in (grams, contexts)]
        return folded(text_of, local, *hashes), done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, parts, froms, whole, held, done = [], [], [], [], 0, (-1, -1)
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = data.as_py()
                # a long text goes through in segments that overlap by all but one byte of a string
                for start in range(0, max(0, len(text) - length) + 1, SEGMENT):
                    part = text[start:start + SEGMENT + length - 1]
                    if len(part) >= length:
                        rows.append(row)
                        parts.append(part)
                        froms.append(start)
                        whole.append(text)
                        held += len(part)
                    if held >= SEGMENT:
                        found, done = flush(rows, parts, froms, whole, done)
                        yield found
                        rows, parts, froms, whole, held = [], [], [], [], 0
        if parts:
            yield flush(rows, parts, froms, whole, done)[0]

    return texts.select("_t_row", F.col("_t_text").cast("binary")).mapInArrow(run, "row long, at long, last long, n long, gram long, context long")


def shared_starts(symbols: np.ndarray, group: np.ndarray, length: int, wanted: int) -> np.ndarray:
    """For contexts (rows of ``symbols``, sorted by ``group``): which of the first ``wanted`` columns start a shared string.

    Columns are inserted from the right. ``order`` lists the contexts by group
    and suffix, ``common`` is the common prefix of each with the one before.
    """
    n, width = symbols.shape
    order, common = np.arange(n), np.zeros(n + 1, "i4")
    found = np.zeros((n, wanted), bool)
    for column in range(width - 1, -1, -1):
        inserted = symbols[order, column]
        key = group[order] * (_OUTSIDE + 1) + inserted
        if np.all(key[1:] >= key[:-1]):
            place = np.arange(n)
        else:
            place = np.argsort(key, kind="stable")
            order, inserted, key = order[place], inserted[place], key[place]
        equal = np.flatnonzero((key[1:] == key[:-1]) & (inserted[1:] != _OUTSIDE)) + 1
        new = np.zeros(n + 1, "i4")
        if len(equal):
            bounds = np.empty(2 * len(equal), "i8")
            bounds[0::2], bounds[1::2] = place[equal - 1] + 1, place[equal] + 1
            new[equal] = np.minimum.reduceat(common, bounds)[0::2] + 1
        common = new
        if column < wanted:
            found[order, column] = np.maximum(common[:-1], common[1:]) >= length
    return found


def _sorted_collections(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """Covered byte ranges (row, start, stop) of contexts that meet under one key; small groups only."""
    before = length - gram
    width = before + length

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        data = rows["data"].tolist()
        left, size = rows["left"].to_numpy(), np.array([len(d) for d in data])
        symbols = np.full((len(rows), width), _OUTSIDE, "i2")
        flat = np.frombuffer(b"".join(data), "u1")
        line = np.repeat(np.arange(len(rows)), size)
        symbols[line, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(before - left, size)] = flat
        group = np.unique(rows["key"].to_numpy(), return_inverse=True)[1]
        found = shared_starts(symbols, group, length, before + 1)
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype("i1"), axis=1)
        line, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1]
        base = rows["at"].to_numpy()[line] - before
        return pd.DataFrame({"row": rows["row"].to_numpy()[line], "start": base + first, "stop": base + last - 1 + length})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            while len(batch):
                some, batch = batch.iloc[:COLLECTION], batch.iloc[COLLECTION:]
                held.append(some)
                size += len(some)
                if size >= COLLECTION:
                    rows = pd.concat(held, ignore_index=True)
                    cut = int(np.searchsorted(rows["key"].to_numpy(), rows["key"].iloc[-1]))  # the last group may go on
                    if cut:
                        yield solve(rows.iloc[:cut])
                    held, size = [rows.iloc[cut:]], len(rows) - cut
        if size:
            yield solve(pd.concat(held, ignore_index=True))

    return keyed.repartition("key").sortWithinPartitions("key").select("key", "row", "at", "left", "data").mapInPandas(
        run, "row long, start long, stop long")


def _cut(places: DataFrame, texts: DataFrame, length: int, before: int, owned: bool = False) -> DataFrame:
    """The contexts (key, row, at, left, data) of places (gram, row, at); texts are divided by row and stay where they are.

    With ``owned`` also low and high, the first and last start, from the place,
    of the strings that have their anchor there.
    """
    columns = ["key", "row", "at", "left", "data", *(("low", "high") if owned else ())]

    def context(gram: int, row: int, at: int, text: bytes) -> tuple:
        left = min(at, before)
        data = text[at - left:at + length]
        if not owned:
            return gram, row, at, left, data
        own = np.flatnonzero(_places(np.frombuffer(data, "u1"), length, length - before) == left)
        return gram, row, at, left, data, int(own[0]) - left, int(own[-1]) - left

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, text, some in zip(batch["_t_row"], batch["_t_text"], batch["places"]):
                out += [context(place["gram"], row, place["at"], text) for place in some]
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    of_row = stored(places.groupBy(F.col("row").alias("_t_row")).agg(F.collect_list(F.struct("gram", "at")).alias("places")))
    return texts.join(of_row.hint("merge"), "_t_row").select("_t_row", F.col("_t_text").cast("binary").alias("_t_text"), "places").mapInPandas(
        run, "key long, row long, at long, left long, data binary" + (", low long, high long" if owned else ""))


def _split_hot(contexts: DataFrame, length: int, before: int, largest: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts of groups that are too large, in groups of at most ``largest``; and the ranges settled on the way.

    A group is split by the starts of its strings: half of the starts go to
    one part, half to the other, and a context only to parts with starts whose
    anchor it was cut around. All strings of a part share a core of bytes,
    so contexts with different cores part company; contexts that agree in all
    bytes of the part settle each other, and one of them goes on. With one
    start left, core and string are the same. Every step is a grouping by hash
    with map-side sums, so no group ever meets in a task.
    """
    columns = ("key", "row", "at", "left", "data", "begin", "end")
    large = stored(contexts.select("key", "row", "at", "left", "data", F.col("low").alias("begin"), F.col("high").alias("end"),
                                   F.lit(-before).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("high")))
    small, settled = [], []
    while not large.isEmpty():
        middle = F.expr("low + (high - low) div 2")
        both = F.array(F.struct(F.col("low").alias("l"), middle.alias("h")), F.struct((middle + 1).alias("l"), F.col("high").alias("h")))
        within = F.filter(both, lambda p: F.greatest(p["l"], F.col("begin")) <= F.least(p["h"], F.col("end")))
        halves = large.select("*", F.explode(within).alias("part"))
        first, last = F.greatest(F.col("part.l"), F.col("begin")), F.least(F.col("part.h"), F.col("end"))
        core = F.expr(f"substring(data, cast(left + part.h + 1 as int), cast({length} - (part.h - part.l) as int))")
        hull = F.substring("data", (F.col("left") + first + 1).cast("int"), (last - first + length).cast("int"))
        parts = stored(halves.select(
            F.xxhash64("key", "part.l", core).alias("key"), *columns[1:], F.col("part.l").alias("low"), F.col("part.h").alias("high"),
            F.xxhash64(first, hull).alias("hull"), first.alias("first"), last.alias("last")))
        # any of the contexts that agree can go on: they agree in all bytes that are looked at from here
        hulls = stored(parts.groupBy("key", "hull").agg(
            F.count(F.lit(1)).alias("n"), F.first(F.struct(*columns[1:], "low", "high")).alias("one")))
        kinds = stored(hulls.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
        settled.append(stored(parts.drop("data").join(hulls.where("n > 1").select("key", "hull").hint("merge"), ["key", "hull"]).select(
            "row", (F.col("at") + F.col("first")).alias("start"), (F.col("at") + F.col("last") + length).alias("stop"))))
        one = hulls.select("key", "one.*").join(kinds.hint("merge"), "key")
        small.append(stored(one.where(f"kinds <= {largest}").select(*columns[:5])))
        rest = stored(one.where(f"kinds > {largest}").select(*columns, "low", "high"))
        discard(large, parts, hulls, kinds)
        large = rest
    return small, settled


def repeated_ranges(texts: DataFrame, length: int = 400, largest: int = LARGEST_GROUP) -> DataFrame:
    """Ranges (row, start, stop) covered by a string of ``length`` bytes that starts anywhere else too.

    ``texts`` (_t_row, _t_text) is divided by row. Only hashes and places are
    shuffled until contexts that differ are cut out of the texts.
    """
    gram = max(1, length // 4)
    before = length - gram
    found = stored(anchors(texts, length, gram))
    grams = stored(found.groupBy("gram").agg(F.sum("n").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1")
                   .select("gram", (F.col("low") != F.col("high")).alias("mixed")))
    repeated = stored(found.join(grams.hint("merge"), "gram"))
    discard(found, grams)
    kinds = stored(repeated.where("mixed").groupBy("gram", "context").agg(
        F.sum("n").alias("n"), F.first("row").alias("row"), F.first("at").alias("at")))
    alike = repeated.where("mixed").join(kinds.where("n > 1").select("gram", "context").hint("merge"), ["gram", "context"])
    settled = repeated.where("NOT mixed").select("row", "at", "last").unionAll(alike.select("row", "at", "last"))
    # the whole contexts of settled anchors are covered, as far as their document goes: cut to it when they are removed
    ranges = stored(settled.select("row", F.greatest(F.col("at") - before, F.lit(0)).alias("start"), (F.col("last") + length).alias("stop")))
    discard(repeated)
    hot = stored(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where(f"kinds > {largest}"))
    contexts, more = [_cut(kinds.join(hot, "gram", "left_anti"), texts, length, before)], []
    if not hot.isEmpty():
        small, more = _split_hot(_cut(kinds.join(hot, "gram", "left_semi"), texts, length, before, owned=True), length, before, largest)
        contexts += small
    sorted_ranges = _sorted_collections(reduce(DataFrame.unionAll, contexts), length, gram)
    return reduce(DataFrame.unionAll, [ranges, *more, sorted_ranges])


def suffix_dedup(docs: DataFrame, length: int = 400, text: str = "text", largest: int = LARGEST_GROUP, decoded: bool = False) -> DataFrame:
    """Add n_bytes, n_removed, n_spans and kept (the bytes left) to every row.

    With ``decoded``, kept is text, without the parts of characters that a cut
    went through.

    Every byte of the text's UTF-8 that a string of ``length`` bytes covers
    which also starts anywhere else, in the same row or another, is removed;
    strings may overlap and are judged on the input. Rows with equal texts
    repeat each other. NULL is an empty text; texts shorter than ``length``
    stay whole. An empty table gives an empty result.
    """
    docs = docs.drop(*RESULTS)
    plain = [c for c in docs.columns if c.lower() != text.lower()]  # the text itself is stored once
    rows = bucketed(docs.select(*plain, F.col(text).isNull().alias("_t_null"), whole_text(text).alias("_t_text"),
                                F.monotonically_increasing_id().alias("_t_row")), "_t_row")
    ranges = repeated_ranges(rows.select("_t_row", "_t_text"), length, largest)
    spans = stored(ranges.groupBy(F.col("row").alias("_t_at")).agg(F.collect_set(F.struct("start", "stop")).alias("_t_spans")))

    @F.pandas_udf(f"n_bytes long, n_removed long, n_spans long, kept {'string' if decoded else 'binary'}")
    def removed(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for data, some in zip(texts, spans):
            n, kept, at, gone, runs, reach = len(data), [], 0, 0, 0, -1
            for start, stop in sorted((s["start"], min(s["stop"], n)) for s in some) if some is not None else ():
                if start > reach:  # a new run
                    kept.append(data[at:start])
                    runs += 1
                    gone += stop - start
                elif stop > reach:
                    gone += stop - reach
                reach = max(reach, stop)
                at = reach
            kept.append(data[at:])
            left = b"".join(kept)
            out.append((n, gone, runs, left.decode("utf-8", "ignore") if decoded else left))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(spans.hint("merge"), rows["_t_row"] == spans["_t_at"], "left")
    return (joined.withColumn("_t", removed(F.col("_t_text").cast("binary"), "_t_spans"))
            .withColumn(text, F.when(~F.col("_t_null"), F.col("_t_text"))).select(*docs.columns, "_t.*"))
