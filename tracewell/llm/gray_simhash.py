"""SimHash near-duplicates through a hierarchical index in Gray order."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.components import components, forest
from tracewell.llm.tables import stored, whole_text

SEED = 42
BLOCK, FANOUT, CHUNK = 2048, 8, 400_000
RESULTS = ("fingerprint", "component_id", "group_id")


def fingerprint(text: str, width: int) -> int:
    """SimHash over the XXH64 of all ``width``-word shingles, repeats included, as a signed 64-bit number.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A
    text of fewer words is one shingle, one without words has fingerprint 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, count = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:count].tolist()
    stops = ends[min(width, len(words)) - 1:].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, "int64")
    for at in range(0, count, 1 << 16):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + (1 << 16)], stops[at:at + (1 << 16)])])
        ones += np.unpackbits(np.frombuffer(hashes, "u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="int64")
    value = int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, out: str = "_t_fp") -> DataFrame:
    """Add the fingerprint of every whole text as a 64-bit column; NULL is an empty text."""
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.withColumn(out, prints(whole_text(text)))


def gray_rank(value: Column) -> Column:
    """Place of a bit pattern in Gray order, where neighbours differ in one bit: the exclusive-or of all its prefixes."""
    for shift in (1, 2, 4, 8, 16, 32):
        value = value.bitwiseXOR(F.shiftrightunsigned(value, shift))
    return value


def _levels(leaves: np.ndarray, height: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes of each level, leaves first: bits shared by all below (mask) and their values."""
    low, high, levels = leaves, leaves, []
    for _ in range(height + 1):
        levels.append((~(low ^ high), low))
        at = np.arange(0, len(low), FANOUT)
        low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
    return levels


def close_pairs(left: np.ndarray, right: np.ndarray, most: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs that differ in at most ``most`` bits; both sides in Gray order.

    Goes down both trees at once. A pair of nodes carries the differences
    that its ancestors have counted and adds those in bits that only now are
    shared on both sides; beyond ``most`` both groups are left out whole.
    """
    height = max(1, math.ceil(math.log(max(len(left), len(right), 2), FANOUT)))
    a, b = _levels(left, height), _levels(right, height)
    root = np.zeros(1, "i8")
    found = [(root[:0], root[:0])]
    todo = [(height, root, root, root, np.zeros(1, "u8"))]
    while todo:
        level, i, j, differ, counted = todo.pop()
        (mask_a, value_a), (mask_b, value_b) = a[level], b[level]
        shared = mask_a[i] & mask_b[j]
        differ = differ + np.bitwise_count((value_a[i] ^ value_b[j]) & shared & ~counted)
        keep = differ <= most
        if same:
            keep &= i < j if level == 0 else i <= j
        i, j, differ, shared = i[keep], j[keep], differ[keep], shared[keep]
        if level == 0:
            found.append((i, j))
            continue
        n, m = len(a[level - 1][0]), len(b[level - 1][0])
        for at in range(0, len(i), CHUNK // FANOUT**2):
            part = slice(at, at + CHUNK // FANOUT**2)
            x = (i[part, None, None] * FANOUT + np.arange(FANOUT)[None, :, None]) + np.zeros((1, 1, FANOUT), "i8")
            y = (j[part, None, None] * FANOUT + np.arange(FANOUT)[None, None, :]) + np.zeros((1, FANOUT, 1), "i8")
            real = (x < n) & (y < m)
            each = np.broadcast_to(np.arange(len(i[part]))[:, None, None], x.shape)[real]
            todo.append((level - 1, x[real], y[real], differ[part][each], shared[part][each]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def links(prints: DataFrame, most: int) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints ``fp`` at ``most`` or fewer differing bits.

    The prints are sorted by Gray rank, range-partitioned, and cut into blocks
    of at most ``BLOCK`` that share their first bits (8, more as the input
    grows), the upper nodes of the index. A block meets the blocks whose first
    bits differ in at most ``most`` places, once per pair, by an equi-join on
    those bits; the shared patterns of the whole blocks prune again, and the
    trees inside do the rest. Each pair of blocks gives a spanning forest of
    its links, so a dense group costs no more edges than it has members.
    """
    prefix_bits = max(8, math.ceil(math.log2(max(2, prints.count()))) - 16)
    ranked = prints.select("fp", gray_rank(F.col("fp")).alias("rank")).select(
        "fp", "rank", F.shiftrightunsigned("fp", 64 - prefix_bits).alias("prefix"))
    # flipping the sign bit makes Spark's signed order that of unsigned ranks
    order = F.col("rank").bitwiseXOR(F.lit(-(2**63)))
    sorted_prints = ranked.repartitionByRange(order).sortWithinPartitions(order).select("fp", "prefix")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(0, "i8")
        held_prefix = None

        def block(values: np.ndarray, prefix: int) -> tuple:
            leaves = values.view("u8")
            shared = ~(np.bitwise_and.reduce(leaves) ^ np.bitwise_or.reduce(leaves))
            return int(values[0]), prefix, int(shared.view("i8")), leaves.tobytes()

        for batch in batches:
            values, prefixes = batch["fp"].to_numpy(), batch["prefix"].to_numpy()
            out = []
            for at in np.split(np.arange(len(values)), np.flatnonzero(np.diff(prefixes)) + 1):
                if not len(at):
                    continue
                if held_prefix is not None and prefixes[at[0]] != held_prefix:
                    out.append(block(held, held_prefix))
                    held = np.zeros(0, "i8")
                held_prefix, held = int(prefixes[at[0]]), np.concatenate([held, values[at]])
                while len(held) > BLOCK:
                    out.append(block(held[:BLOCK], held_prefix))
                    held = held[BLOCK:]
            if out:
                yield pd.DataFrame(out, columns=["block", "prefix", "shared", "leaves"])
        if len(held):
            yield pd.DataFrame([block(held, held_prefix)], columns=["block", "prefix", "shared", "leaves"])

    blocks = stored(sorted_prints.mapInPandas(cut, "block long, prefix long, shared long, leaves binary"))
    flips = [sum(1 << bit for bit in bits) for k in range(most + 1) for bits in combinations(range(prefix_bits), k)]
    near = F.filter(F.transform(F.array(*[F.lit(f).cast("bigint") for f in flips]), lambda f: F.col("prefix").bitwiseXOR(f)),
                    lambda p: p >= F.col("prefix"))
    left = blocks.select(F.explode(near).alias("prefix"), *[F.col(c).alias(f"{c}_a") for c in ("block", "shared", "leaves")])
    differ = F.bit_count(F.col("block_a").bitwiseXOR(F.col("block")).bitwiseAND(F.col("shared_a")).bitwiseAND(F.col("shared")))
    own = F.shiftrightunsigned("block_a", 64 - prefix_bits) == F.col("prefix")
    pairs = left.join(blocks.hint("merge"), "prefix").where((differ <= most) & (~own | (F.col("block_a") <= F.col("block"))))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block_a, block_b, leaves_a, leaves_b in zip(batch["block_a"], batch["block"], batch["leaves_a"], batch["leaves"]):
                left, right, same = np.frombuffer(leaves_a, "u8"), np.frombuffer(leaves_b, "u8"), block_a == block_b
                i, j = close_pairs(left, right, most, same)
                if len(i):
                    nodes = left if same else np.concatenate([left, right])
                    root = forest(len(nodes), i, j if same else j + len(left))
                    moved = np.flatnonzero(root != np.arange(len(nodes)))
                    yield pd.DataFrame({"a": nodes[moved].view("i8"), "b": nodes[root[moved]].view("i8")})

    return pairs.select("block_a", "block", "leaves_a", "leaves").mapInPandas(meet, "a long, b long")


def simhash_dedup(printed: DataFrame, most: int = 3, doc_id: str = "doc_id", fp: str = "_t_fp") -> DataFrame:
    """Add fingerprint (hex), component_id and group_id to rows that carry ``fp`` (see ``fingerprints``).

    component_id is the smallest id reachable over links of ``most`` or fewer
    bits; the row whose id it is stays. Rows of equal fingerprint are one node
    of the graph. A group without any id has a NULL component; group_id, the
    group's least fingerprint as a number, tells all groups apart, also where
    rows of one id are in several. An empty table gives an empty result.
    """
    rows = stored(printed.drop(*RESULTS))
    prints = stored(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("first")))
    found = stored(components(stored(links(prints.select("fp"), most))))
    lowest = found.join(prints, found.node == prints.fp).groupBy("component").agg(
        F.min("first").alias("lowest"), F.min("node").alias("group"))
    joined = found.join(lowest, "component").select(F.col("node").alias("fp"), "lowest", "group")
    nodes = stored(prints.join(joined, "fp", "left").select(
        F.col("fp").alias("_t_node"), F.when(F.col("group").isNotNull(), F.col("lowest")).otherwise(F.col("first")).alias("component_id"),
        F.coalesce("group", "fp").alias("group_id")))
    return rows.join(nodes, F.col(fp) == F.col("_t_node")).withColumn(
        "fingerprint", F.lower(F.lpad(F.hex(fp), 16, "0"))).drop(fp, "_t_node")
