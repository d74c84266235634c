"""Nearest vectors by cosine similarity: semantic search and recall.

A task holds one bounded block of queries, and the candidates stream past it
in tiles that are scored by matrix product; it keeps the best ``k`` per query.
Similarities are rounded to 9 digits, so that ties do not depend on the order
of summation; ties go to the smaller id.
Zero vectors and vectors of another length than the query's have no similarity
and are never found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.memory import visible

#: Queries and candidates of a tile, which is scored at once.
QUERY_BLOCK, CANDIDATE_CHUNK = 512, 8192
#: Numbers in the vectors, or in the hits, of the queries that one task holds. Candidates are copied once a block.
BLOCK_VALUES = 1 << 21
DIGITS = 9
#: More than rounding can change; what comes this close to a threshold is rounded before it is judged.
_NEAR = 2e-9
_SCANNED = ("block", "dims", "side", "cell", "_query", "name", "least", "vector")
_RESULT = "_query long, query_id string, id string, similarity double, rank int"


def _unit_rows(vectors: Iterable) -> np.ndarray:
    matrix = np.asarray([np.asarray(v, dtype="float64") for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms > 0, matrix / norms, np.nan)


class _Block:
    """The queries of one block and their best ``k`` among the candidates seen so far."""

    def __init__(self, queries: pd.DataFrame, k: int, skip_self: bool):
        unit = _unit_rows(queries["vector"])
        good = np.isfinite(unit).all(axis=1)
        self.unit, self.k = unit[good], k
        self.names, self.queries = queries["name"].to_numpy(dtype=object)[good], queries["_query"].to_numpy()[good]
        #: A hit is worth keeping from here on: ``k`` others are known that are as good.
        self.least = queries["least"].to_numpy(dtype="float64")[good]
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.most = 0, max(2 * k * len(self.names), 1 << 18)
        self.own: dict[str, list[int]] = {}
        for at, name in enumerate(self.names if skip_self else ()):
            self.own.setdefault(name, []).append(at)

    def meet(self, ids: np.ndarray, rows: np.ndarray, among: np.ndarray) -> None:
        """Score candidates against the queries at the positions ``among``, in tiles."""
        for first in range(0, len(ids), CANDIDATE_CHUNK):
            names, part = ids[first:first + CANDIDATE_CHUNK], rows[first:first + CANDIDATE_CHUNK]
            same = [(at, c) for c, name in enumerate(names) for at in self.own.get(name, ())] if self.own else []
            own, met = np.array(same, dtype="int64").reshape(-1, 2).T
            width = max(QUERY_BLOCK, QUERY_BLOCK * CANDIDATE_CHUNK // len(names))
            for start in range(0, len(among), width):
                self._tile(names, part, among[start:start + width], own, met)
            if self.waiting > self.most:
                self.settle()

    def _tile(self, names: np.ndarray, rows: np.ndarray, at: np.ndarray, own: np.ndarray, met: np.ndarray) -> None:
        scores = self.unit[at] @ rows.T
        if len(own):
            place = np.minimum(np.searchsorted(at, own), len(at) - 1)
            here = at[place] == own
            scores[place[here], met[here]] = -np.inf
        worth = (scores >= self.least[at][:, None] - _NEAR) & (scores > -np.inf)
        if len(names) > self.k and np.count_nonzero(worth) > 2 * self.k * len(at):
            kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
            worth &= scores >= kth[:, None] - _NEAR
            self.least[at] = np.maximum(self.least[at], np.round(kth, DIGITS))
        q, c = np.nonzero(worth)
        similar = np.round(scores[q, c], DIGITS)
        kept = similar >= self.least[at][q]
        self.found.append((at[q[kept]], similar[kept], names[c[kept]]))
        self.waiting += int(kept.sum())

    def settle(self) -> None:
        """Leave the best ``k`` of each query, ties by id."""
        if not self.found:
            return
        q, similar, ids = (np.concatenate(part) for part in zip(*self.found))
        by_id = pd.factorize(ids, sort=True)[0]
        order = np.lexsort((by_id, -similar, q))
        q = q[order]
        self.rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = self.rank < self.k
        q, similar, ids, self.rank = q[best], similar[order][best], ids[order][best], self.rank[best]
        full = self.rank == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], similar[full])
        self.found = [(q, similar, ids)]
        self.waiting, self.most = 0, max(2 * self.k * len(self.names), 1 << 18)

    def hits(self) -> Iterator[pd.DataFrame]:
        self.settle()
        for q, similar, ids in self.found:
            yield pd.DataFrame({"_query": self.queries[q], "query_id": pd.Series(self.names[q], dtype=object),
                                "id": pd.Series(ids, dtype=object), "similarity": similar, "rank": (self.rank + 1).astype("int32")})


def block_count(queries: DataFrame, k: int) -> int:
    """Blocks that queries (``vector``) are dealt to: as many as there are tasks at once, more where a block would be too large."""
    n, dims = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    few = min(queries.sparkSession.sparkContext.defaultParallelism, math.ceil(n / QUERY_BLOCK))
    return max(2, few, math.ceil(n * max(dims or 1, k) / BLOCK_VALUES))


def best_of_blocks(queries: DataFrame, candidates: DataFrame, k: int, skip_self: bool, blocks: int | None = None,
                   near: Callable[[int, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The ``k`` best candidates of each block's queries (``_RESULT``).

    ``queries`` has ``block, _query, query_id, vector`` and may have ``least``, a
    similarity that ``k`` candidates are known to reach; ``candidates`` has ``block, id,
    vector`` and may have ``cell``, of which ``near`` (cell, unit rows, ``least``)
    says which queries meet it. With ``blocks`` each block is a partition, else blocks are dealt by hash.
    """
    asked = queries.select("block", F.size("vector").alias("dims"), F.lit(0).alias("side"), F.lit(0).alias("cell"), "_query", F.col("query_id").alias("name"),
                           (F.col("least") if "least" in queries.columns else F.lit(float("-inf"))).alias("least"), "vector")
    given = candidates.select("block", F.size("vector").alias("dims"), F.lit(1).alias("side"), (F.col("cell") if near else F.lit(0)).alias("cell"),
                              F.lit(0).cast("long").alias("_query"), F.col("id").alias("name"), F.lit(0.0).alias("least"), "vector")
    rows = asked.unionByName(given).select(*_SCANNED)
    dealt = rows.repartitionById(blocks, "block") if blocks else rows.repartition("block")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, waiting, block = None, [], None
        for batch in batches:
            for (number, dims, side), part in batch.groupby(["block", "dims", "side"]):
                if (number, dims) != key:
                    if block is not None:
                        yield from block.hits()
                    key, waiting, block = (number, dims), [], None
                if side == 0:
                    waiting.append(part)
                elif waiting or block is not None:
                    if block is None:
                        block, waiting = _Block(pd.concat(waiting), k, skip_self), []
                    unit = _unit_rows(part["vector"])
                    good = np.isfinite(unit).all(axis=1)
                    ids, cells, unit = part["name"].to_numpy(dtype=object)[good], part["cell"].to_numpy()[good], unit[good]
                    for cell in np.unique(cells):
                        of_cell = cells == cell
                        among = np.arange(len(block.names)) if near is None else np.flatnonzero(near(cell, block.unit, block.least))
                        block.meet(ids[of_cell], unit[of_cell], among)
        if block is not None:
            yield from block.hits()

    return dealt.sortWithinPartitions("block", "dims", "side", "cell").mapInPandas(scan, _RESULT)


def nearest(queries: DataFrame, candidates: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """``query_id, id, similarity, rank`` of the ``k`` best candidates per query.

    ``queries`` has ``query_id, vector``, ``candidates`` has ``id, vector``.
    Blocks of queries meet all candidates of the same length, which stream past;
    a block is of bounded size, whatever the tables are, and there are few of them,
    so that a candidate is copied once a block. A NULL or empty vector finds nothing and is
    found by nothing. Queries that share an id but not the vector are ranked apart;
    repeated ones count once. Candidates that tie with the ``k``-th come by id.
    """
    queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector").where("size(vector) > 0") \
        .withColumn("_query", F.xxhash64("query_id", "vector")).dropDuplicates(["_query"])
    candidates = candidates.select(F.col("id").cast("string").alias("id"), "vector").where("size(vector) > 0")
    blocks = block_count(queries, k)
    asked = queries.withColumn("block", F.pmod("_query", F.lit(blocks)).cast("int"))
    given = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return best_of_blocks(asked, given, k, skip_self, blocks).select("query_id", "id", "similarity", "rank")


def memory_id() -> Column:
    """One text per memory entry; agent ids never contain the separator."""
    return F.concat_ws("|", "agent_id", "key")


def memory_search(memory: DataFrame, queries: DataFrame, k: int, agent: str | None = None) -> DataFrame:
    """The ``k`` entries most similar to each query, among those the agent may see."""
    seen = memory if agent is None else visible(memory, agent)
    seen = seen.withColumn("id", memory_id())
    hits = nearest(queries, seen.select("id", F.col("embedding").alias("vector")), k)
    return hits.join(seen.drop("embedding"), "id").select("query_id", "rank", "similarity", "agent_id", "key", "value")


def recall(contexts: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` past situations most similar to each context, itself excluded."""
    return nearest(contexts, candidates, k, skip_self=True)
