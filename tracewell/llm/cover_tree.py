"""Exact near-duplicate pairs of vectors by dual traversal of cover trees.

Upper levels: pivots, chosen far from each other from a bounded sample, divide
the vectors of a label; every pivot knows the radius that covers its vectors.
Lower levels: each division is one or more blocks with a cover tree of their
own, of nested levels whose radii halve. Pairs of pivots, then of nodes, are
dropped when their centres are farther apart than threshold and radii
allow, or linked whole when they are so near that no pair can miss it.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.components import components, forest
from tracewell.llm.tables import stored

#: Vectors in a block; sampled vectors that pivots are chosen from (fixes the size of what the driver and all tasks hold).
BLOCK, SAMPLE = 512, 2048
#: Radii of the nested levels inside a block, on the unit sphere.
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
_SLACK = 1e-7  # far above rounding errors: bounds decide only what is clear, the exact cosine the rest
_CHUNK = 100_000
RESULTS = ("n_links", "component_id", "kept")


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can link: a label, finite components, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(v, "f8") for v in vectors])
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class Tree:
    """A cover tree over the rows of ``points``: per level the centres, covering radii and ranges of ``order``.

    A node's centre is also a centre of the level below; siblings' centres
    are farther apart than the level's radius. The last level has the points.
    """

    def __init__(self, points: np.ndarray):
        apart = _distance(points, points)
        groups, self.levels = [np.arange(len(points))], []
        for radius in RADII:
            below = []
            for members in groups:
                while len(members):
                    near = apart[members[0], members] <= radius
                    near[0] = True
                    below.append(members[near])
                    members = members[~near]
            groups = below
            self._add(groups, apart)
        self.order = np.concatenate(groups)
        self._add([np.array([p]) for p in self.order], apart)

    def _add(self, groups: list[np.ndarray], apart: np.ndarray) -> None:
        stops = np.cumsum([len(g) for g in groups])
        self.levels.append((np.array([g[0] for g in groups]), np.array([apart[g[0], g].max() for g in groups]),
                            np.concatenate([[0], stops[:-1]]), stops))


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, ``counts[i]`` times (i, 0), (i, 1), ..."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def dual_links(a: Tree, points_a: np.ndarray, b: Tree, points_b: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Ranges (start, stop in ``a.order``, start, stop in ``b.order``) whose pairs all have cosine ``least`` or more.

    Every linked pair is in exactly one range, in one direction only where
    both trees are the same; a point is never paired with itself.
    """
    most = math.sqrt(2.0 - 2.0 * least)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[0][0])), np.arange(len(b.levels[0][0])), indexing="ij"))
    last = len(a.levels) - 1
    for level in range(last + 1):
        (centre_a, radius_a, start_a, stop_a), (centre_b, radius_b, start_b, stop_b) = a.levels[level], b.levels[level]
        if same:
            i, j = i[(keep := i <= j)], j[keep]
        cosine = points_a[centre_a] @ points_b[centre_b].T
        if level == last:
            keep = cosine[i, j] >= least
            if same:
                keep &= i < j
            yield start_a[i[keep]], stop_a[i[keep]], start_b[j[keep]], stop_b[j[keep]]
            return
        apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))[i, j]
        reach = radius_a[i] + radius_b[j]
        keep = apart <= most + reach + _SLACK
        whole = (apart + reach < most - _SLACK) & ((i != j) if same else True)
        yield start_a[i[whole]], stop_a[i[whole]], start_b[j[whole]], stop_b[j[whole]]
        i, j = i[keep & ~whole], j[keep & ~whole]
        below_a, below_b = a.levels[level + 1][2], b.levels[level + 1][2]
        first_a, first_b = np.searchsorted(below_a, start_a[i]), np.searchsorted(below_b, start_b[j])
        count_a, count_b = np.searchsorted(below_a, stop_a[i]) - first_a, np.searchsorted(below_b, stop_b[j]) - first_b
        pair, at = _spread(count_a * count_b)
        i, j = first_a[pair] + at // count_b[pair], first_b[pair] + at % count_b[pair]


def meet_blocks(a: dict, b: dict, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, root) of all vectors that link between two blocks: links count copies, roots span the links."""
    n_a, n_b = len(a["nodes"]), len(b["nodes"])
    order_a, order_b = a["tree"].order, b["tree"].order
    copies_a, copies_b = (np.concatenate([[0], np.cumsum(x["copies"][x["tree"].order])]) for x in (a, b))
    # a range of one side linked with a range of the other: sums by differences at the ranges' ends
    gain_a, gain_b = np.zeros(n_a + 1, "i8"), np.zeros(n_b + 1, "i8")
    left, right = [], []
    for start_a, stop_a, start_b, stop_b in dual_links(a["tree"], a["points"], b["tree"], b["points"], least, same):
        more_a, more_b = copies_b[stop_b] - copies_b[start_b], copies_a[stop_a] - copies_a[start_a]
        for gain, at, by in ((gain_a, start_a, more_a), (gain_a, stop_a, -more_a), (gain_b, start_b, more_b), (gain_b, stop_b, -more_b)):
            np.add.at(gain, at, by)
        # each range as a chain to its first point, and the two first points together
        shift = 0 if same else n_a
        for start, stop, base in ((start_a, stop_a, 0), (start_b, stop_b, shift)):
            which, at = _spread(stop - start)
            left.append(base + start[which])
            right.append(base + start[which] + at)
        left.append(start_a)
        right.append(shift + start_b)
    links_a, links_b = np.cumsum(gain_a)[:-1], np.cumsum(gain_b)[:-1]
    nodes = a["nodes"][order_a] if same else np.concatenate([a["nodes"][order_a], b["nodes"][order_b]])
    links = links_a + links_b if same else np.concatenate([links_a, links_b])
    root = forest(len(nodes), np.concatenate(left), np.concatenate(right))
    linked = np.flatnonzero(links)
    return nodes[linked], links[linked], nodes[root[linked]]


def choose_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows, each the farthest from those before it: nested nets of falling radius."""
    chosen, apart = [0], _distance(points, points[:1])[:, 0]
    while len(chosen) < count and apart.max() > 0.05:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, _distance(points, points[chosen[-1:]])[:, 0])
    return np.array(chosen)


def _pivots(groups: DataFrame) -> dict[tuple, np.ndarray]:
    """Pivots of each (label, dims) from at most ``SAMPLE`` vectors, drawn over all by a hash."""
    sample = groups.orderBy(F.xxhash64("node", F.lit(1))).select("label", "dims", "vector").limit(SAMPLE).toPandas()
    known = groups.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"))
    wanted = sample[["label", "dims"]].drop_duplicates()
    sizes: dict[tuple, int] = {}
    if len(wanted):
        few = groups.sparkSession.createDataFrame(wanted, groups.select("label", "dims").schema)  # at most SAMPLE rows
        sizes = {(r["label"], r["dims"]): r["n"] for r in known.join(F.broadcast(few), ["label", "dims"]).collect()}
    out = {}
    for key, rows in sample.groupby(["label", "dims"]):
        points = _unit(rows["vector"])
        out[key] = points[choose_pivots(points, -(-sizes[key] // BLOCK))]
    return out


def near_vectors(vectors: DataFrame, least: float = 0.98, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id") -> DataFrame:
    """Add n_links, component_id and kept to every row.

    Two rows link when their labels are equal and the cosine of their vectors,
    in double precision, is at least ``least``. Rows without a label, and
    vectors that are NULL, empty, zero, or hold a NULL or a number that is not
    finite link with nothing; neither do vectors of different lengths.
    component_id is the smallest id reachable (NULL if no row of the component
    has an id); kept says whether that is the row's own. Equal vectors are one
    point with a number of copies, so a vector held by a third of all rows is
    one row after the map-side step. An empty table gives an empty result.
    """
    docs = vectors.drop(*RESULTS)
    as_double = F.transform(F.col(vector), lambda x: x.cast("double"))
    node = F.when(usable(as_double, F.col(label)), F.xxhash64(F.col(label), as_double))
    rows = stored(docs.withColumn("_t_node", node))
    points = rows.where("_t_node IS NOT NULL").select(
        F.col("_t_node").alias("node"), F.col(label).alias("label"), as_double.alias("vector"), F.col(vec_id).alias("id"))
    groups = stored(points.groupBy("node", "label", "vector").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("lowest"))
                    .withColumn("dims", F.size("vector")))
    pivots = _pivots(groups)

    @F.pandas_udf("pivot long, apart double")
    def nearest(labels: pd.Series, sizes: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"pivot": np.zeros(len(labels), "i8"), "apart": np.full(len(labels), 9.0)})
        for key, at in pd.DataFrame({"l": labels.to_numpy(), "d": sizes.to_numpy()}).groupby(["l", "d"]).indices.items():
            centres = pivots.get(key)
            if centres is not None:
                apart = _distance(_unit(found.iloc[at]), centres)
                out.iloc[at, 0], out.iloc[at, 1] = apart.argmin(axis=1), apart.min(axis=1)
        return out

    placed = stored(groups.withColumn("_p", nearest("label", "dims", "vector")).select("node", "label", "dims", "vector", "copies", "_p.*"))
    sizes = stored(placed.groupBy("label", "dims", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius")))
    few = sizes.where("radius < 9.0").collect()  # as many rows as there are pivots: at most SAMPLE
    near: dict[tuple, list[int]] = {}
    by_label: dict[tuple, list] = {}
    for r in few:
        by_label.setdefault((r["label"], r["dims"]), []).append(r)
    for key, some in by_label.items():
        at, radius = np.array([r["pivot"] for r in some]), np.array([r["radius"] for r in some])
        close = _distance(pivots[key][at], pivots[key][at]) <= math.sqrt(2 - 2 * least) + radius[:, None] + radius[None, :] + _SLACK
        for x, p in enumerate(at.tolist()):
            near[(*key, p)] = [q for y, q in enumerate(at.tolist()) if close[x, y] and q >= p]

    parts = placed.join(sizes.withColumn("parts", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")).select("label", "dims", "pivot", "parts"),
                        ["label", "dims", "pivot"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")))

    def build(block: pd.DataFrame) -> pd.DataFrame:
        first = block.iloc[0]
        unit = _unit(block["vector"])
        data = {"nodes": block["node"].to_numpy(), "copies": block["copies"].to_numpy(), "points": unit, "tree": Tree(unit)}
        data = {**data, "tree": (data["tree"].levels, data["tree"].order)}
        key = (first["label"], int(first["dims"]), int(first["pivot"]))
        return pd.DataFrame({"label": [first["label"]], "dims": [first["dims"]], "pivot": [first["pivot"]], "part": [first["part"]],
                             "near": [near.get(key, [key[2]])], "data": [pickle.dumps(data)]})

    kind = dict(groups.dtypes)["label"]
    blocks = stored(parts.groupBy("label", "dims", "pivot", "part").applyInPandas(
        build, f"label {kind}, dims int, pivot long, part long, near array<long>, data binary"))
    left = blocks.select("label", "dims", F.col("pivot").alias("own"), F.col("part").alias("own_part"), F.col("data").alias("own_data"),
                         F.explode("near").alias("pivot"))
    pairs = left.join(blocks.drop("near").hint("merge"), ["label", "dims", "pivot"]).where("own < pivot OR own_part <= part")

    def load(data: bytes) -> dict:
        block = pickle.loads(data)
        tree = Tree.__new__(Tree)
        tree.levels, tree.order = block["tree"]
        return {**block, "tree": tree}

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for same, own, other in zip(batch["same"], batch["own_data"], batch["data"]):
                nodes, links, roots = meet_blocks(load(own), load(other), least, same)
                if len(nodes):
                    yield pd.DataFrame({"node": nodes, "links": links, "root": roots})

    same = ((F.col("own") == F.col("pivot")) & (F.col("own_part") == F.col("part"))).alias("same")
    found = stored(pairs.select(same, "own_data", "data").mapInPandas(meet, "node long, links long, root long"))
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = stored(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    lowest = stored(whole.join(groups.select("node", "lowest"), "node").groupBy("component").agg(F.min("lowest").alias("lowest")))
    linked = whole.join(lowest, "component").select("node", F.col("lowest").alias("reached"), F.lit(True).alias("linked"))
    nodes = stored(groups.select("node", "copies", "lowest").join(total, "node", "left").join(linked, "node", "left").select(
        F.col("node").alias("_t_point"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.when(F.col("linked"), F.col("reached")).otherwise(F.col("lowest")).alias("component_id"), F.lit(True).alias("_t_known")))
    out = rows.join(nodes, F.col("_t_node") == F.col("_t_point"), "left")
    return out.withColumns({
        "n_links": F.coalesce("n_links", F.lit(0).cast("bigint")),
        "component_id": F.when(F.col("_t_known"), F.col("component_id")).otherwise(F.col(vec_id)),
    }).withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id"))).drop("_t_node", "_t_point", "_t_known")
