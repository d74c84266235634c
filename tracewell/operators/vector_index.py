"""Nearest vectors through a stored partition of the candidates: exact, and most pairs are never scored.

The candidates are stored by cell, the pivot they are closest to, with the
radius of each cell. By the triangle inequality no vector of a cell is more
similar to a query than the distance to the pivot less the radius allows. A
query first meets the cells whose pivots are closest; its ``k``-th hit there
tells which cells can hold one as good, and only those are met. Then the cells
stream past blocks of queries; vectors are not copied for every query and cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators.checkpoints import work_dir
from tracewell.operators.similarity import BLOCK_VALUES, QUERY_BLOCK, _unit_rows, best_of_blocks, block_count

#: Pivots are held by the driver and every task, so their number is bounded; by default it grows with the root of the rows.
MOST_CELLS = 4096
SEED_CELLS = 2
#: Added to radii and taken from thresholds: more than rounding can change, so that a bound never excludes a hit.
SLACK = 1e-7
_VECTORS = "id string, vector array<double>, slot long, distance double, cell int"
_CELLS = "cell int, n long, radius double"
_ROUTES = "_query long, query_id string, vector array<double>, cell int"
_PROBES = "query_id string, cell int"


def _stored(df: DataFrame) -> DataFrame:
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _by_dims(vectors: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, positions and unit rows of the vectors of each length that have a direction."""
    lengths = vectors.map(len).to_numpy()
    for dims in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == dims)
        rows = _unit_rows(vectors.iloc[at])
        good = np.isfinite(rows).all(axis=1)
        yield int(dims), at[good], rows[good]


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (rows @ pivots.T), 0))


def _may_hold(apart: np.ndarray, radii: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether a cell at this distance may hold a vector as similar as ``least``."""
    gap = np.maximum(apart - radii - SLACK, 0)
    return 1 - gap * gap / 2 >= least - SLACK


class VectorIndex:
    """Candidates stored below ``path`` by cell, with the pivots and radii of the cells."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, candidates: DataFrame, cells: int | None = None) -> VectorIndex:
        """Store ``id, vector`` of every candidate; the folder must be new.

        A bounded sample by hashed id gives the pivots, distinct ones, so copies
        that make up much of the table do not use them up. A length that the
        sample lacks has one cell that bounds exclude from nothing. Vectors that
        are NULL, empty, zero or not finite are found by nothing and not stored.
        """
        rows = candidates.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector")) \
            .where("vector IS NOT NULL")
        wanted = min(MOST_CELLS, cells or math.ceil(math.sqrt(rows.count())) or 1)
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(2 * wanted).select("vector").toPandas()["vector"]
        pivots: dict[int, np.ndarray] = {}
        for dims, _, unit in _by_dims(sample):
            _, first = np.unique(np.round(unit, 9), axis=0, return_index=True)
            pivots[dims] = unit[np.sort(first)[:max(1, wanted * len(unit) // max(len(sample), 1))]]
        start, numbered = 0, {}
        for dims, unit in pivots.items():
            numbered[dims] = (start, unit)
            start += len(unit)
        shared = self.spark.sparkContext.broadcast(numbered)

        @F.pandas_udf("struct<cell int, distance double>")
        def placed(vectors: pd.Series) -> pd.DataFrame:
            cell = pd.array([None] * len(vectors), dtype="Int32")
            distance = np.full(len(vectors), 2.0)
            for dims, at, unit in _by_dims(vectors):
                if dims not in shared.value:
                    cell[at] = -dims
                    continue
                first, own = shared.value[dims]
                apart = _distances(unit, own)
                nearest = apart.argmin(axis=1)
                cell[at] = (first + nearest).astype("int32")
                distance[at] = apart[np.arange(len(at)), nearest]
            return pd.DataFrame({"cell": cell, "distance": distance})

        # slots divide a large cell evenly, also among rows of one id; they are fixed once they are stored
        assigned = rows.withColumn("at", placed("vector")).where("at.cell IS NOT NULL").select(
            "id", "vector", F.monotonically_increasing_id().alias("slot"), "at.distance", "at.cell")
        assigned.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{self.path}/vectors")
        self._vectors().groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).write.parquet(f"{self.path}/cells")
        at = [(first + i, dims, row.tolist()) for dims, (first, unit) in numbered.items() for i, row in enumerate(unit)]
        self.spark.createDataFrame(at, "cell int, dims int, pivot array<double>").write.parquet(f"{self.path}/pivots")
        return self

    def _vectors(self) -> DataFrame:
        return self.spark.read.schema(_VECTORS).parquet(f"{self.path}/vectors")

    def _cells(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Cells, pivots, radii and sizes by vector length; as many as there are cells."""
        cells = self.spark.read.schema(_CELLS).parquet(f"{self.path}/cells")
        pivots = self.spark.read.schema("cell int, dims int, pivot array<double>").parquet(f"{self.path}/pivots")
        found: dict[int, list] = {}
        for r in cells.join(pivots, "cell", "left").orderBy("cell").collect():
            dims = -r.cell if r.cell < 0 else r.dims
            found.setdefault(dims, []).append((r.cell, r.pivot or [0.0] * dims, r.radius if r.pivot else 4.0, r.n))
        return {d: tuple(np.asarray(part) for part in zip(*rows)) for d, rows in found.items()}

    @staticmethod
    def _reach(batches: Iterator[pd.DataFrame], cells, k: int, seeds: bool) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
        """Rows of queries, by length, with the cells of that length and which of them each query must meet: the
        first ones, or those that may hold a hit as good as ``least``, the first ones aside."""
        for batch in batches:
            for start in range(0, len(batch), QUERY_BLOCK):
                part = batch.iloc[start:start + QUERY_BLOCK]
                for dims, at, unit in _by_dims(part["vector"]):
                    if dims not in cells or not len(at):
                        continue
                    names, pivots, radii, sizes = cells[dims]
                    apart = _distances(unit, pivots)
                    order = np.argsort(apart, axis=1, kind="stable")
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    first = (before < k) | (np.arange(len(names)) < SEED_CELLS)
                    meets = np.zeros(apart.shape, dtype=bool)
                    np.put_along_axis(meets, order, first, axis=1)
                    if not seeds:
                        meets = ~meets & _may_hold(apart, radii, part["least"].to_numpy()[at][:, None])
                    yield part.iloc[at], names, meets

    def _seeds(self, queries: DataFrame, cells, need: int) -> DataFrame:
        """Queries with their first cells, a row for each."""
        shared = self.spark.sparkContext.broadcast(cells)

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, names, meets in VectorIndex._reach(batches, shared.value, need, True):
                q, c = np.nonzero(meets)
                yield part.iloc[q][["_query", "query_id", "vector"]].assign(cell=names[c].astype("int32"))

        return _stored(queries.mapInPandas(route, _ROUTES))

    def _meet(self, routes: DataFrame, k: int, skip_self: bool) -> DataFrame:
        """The ``k`` best of a cell's queries among its candidates, in blocks of queries."""
        sizes = routes.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims")).collect()
        load, at = [], 0
        for r in sizes:
            parts = math.ceil(r.n * max(r.dims, k) / BLOCK_VALUES)
            load.append((r.cell, at, parts))
            at += parts
        known = F.broadcast(self.spark.createDataFrame(load, "cell int, at int, parts int"))  # one row a cell
        # a list of constants, so that the scan reads the folders of these cells only
        given = self._vectors().where(F.col("cell").isin([r.cell for r in sizes])).join(known, "cell") \
            .select("id", "vector", F.explode(F.sequence("at", F.col("at") + F.col("parts") - 1)).alias("block"))
        asked = routes.join(known, "cell").select(
            "_query", "query_id", "vector", (F.col("at") + F.pmod(F.xxhash64("_query"), F.col("parts")).cast("int")).alias("block"))
        return best_of_blocks(asked, given, k, skip_self)

    def _scan(self, judged: DataFrame, blocks: int, cells, k: int, skip_self: bool) -> DataFrame:
        """The ``k`` best of all cells that may hold a hit as good as ``least``; a block gets those that one of its queries needs."""
        shared = self.spark.sparkContext.broadcast(cells)
        placed = {int(cell): (pivots[i], radii[i]) for names, pivots, radii, _ in cells.values() for i, cell in enumerate(names)}
        bounds = self.spark.sparkContext.broadcast(placed)

        def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dims, at, unit in _by_dims(batch["vector"]):
                    if dims not in shared.value or not len(at):
                        continue
                    names, pivots, radii, _ = shared.value[dims]
                    of, least = batch["block"].to_numpy()[at], batch["least"].to_numpy()[at]
                    for start in range(0, len(at), QUERY_BLOCK):
                        part = slice(start, start + QUERY_BLOCK)
                        q, c = np.nonzero(_may_hold(_distances(unit[part], pivots), radii, least[part][:, None]))
                        yield pd.DataFrame({"block": of[part][q], "cell": names[c]}).drop_duplicates().astype("int32")

        def near(cell: int, unit: np.ndarray, least: np.ndarray) -> np.ndarray:
            pivot, radius = bounds.value[int(cell)]
            return _may_hold(_distances(unit, pivot[None, :])[:, 0], radius, least)

        wanted = _stored(judged.mapInPandas(needed, "block int, cell int").distinct())
        met = [r.cell for r in wanted.select("cell").distinct().collect()]  # as many as there are cells
        given = self._vectors().where(F.col("cell").isin(met)).join(F.broadcast(wanted), "cell").select("id", "vector", "block", "cell")
        return best_of_blocks(judged, given, k, skip_self, blocks, near)

    def search_with_probes(self, queries: DataFrame, k: int, skip_self: bool = False) -> tuple[DataFrame, DataFrame]:
        """The hits, and the cells that each query met (``query_id, cell``), which are found anew when they are read."""
        queries = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")) \
            .where("vector IS NOT NULL").withColumn("_query", F.xxhash64("query_id", "vector")).dropDuplicates(["_query"])
        queries = _stored(queries)
        cells = self._cells()
        # a query that is a candidate itself must still meet k others
        need = k + 1 if skip_self else k
        seeds = self._seeds(queries, cells, need)
        order = Window.partitionBy("_query").orderBy(F.col("similarity").desc())
        least = self._meet(seeds, k, skip_self).select("_query", "similarity").withColumn("n", F.row_number().over(order)) \
            .where(F.col("n") == k).select("_query", F.col("similarity").alias("least"))
        blocks = block_count(queries, k)
        judged = _stored(queries.join(least, "_query", "left").select(
            "_query", "query_id", "vector", F.coalesce("least", F.lit(-2.0)).alias("least"), F.pmod("_query", F.lit(blocks)).cast("int").alias("block")))
        hits = self._scan(judged, blocks, cells, k, skip_self).select("query_id", "id", "similarity", "rank")
        shared = self.spark.sparkContext.broadcast(cells)

        def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, names, meets in VectorIndex._reach(batches, shared.value, need, False):
                q, c = np.nonzero(meets)
                yield part.iloc[q][["query_id"]].assign(cell=names[c].astype("int32"))

        return hits, seeds.select("query_id", "cell").unionByName(judged.mapInPandas(others, _PROBES))

    def search(self, queries: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
        """As ``nearest``: ``query_id, id, similarity, rank`` of the ``k`` best candidates per query, ties by id."""
        return self.search_with_probes(queries, k, skip_self)[0]
