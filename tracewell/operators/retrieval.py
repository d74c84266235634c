"""Retrieval that joins three views of stored events: a filter, their relations and their vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.vectors import cosine
from tracewell.operators.checkpoints import written
from tracewell.operators.similarity import nearest

#: Ranks count from here when they are fused: the larger, the less a first place in one list outweighs two middling ones.
RANK_OFFSET = 60


def both_ways(edges: DataFrame, start: str, end: str) -> DataFrame:
    """Edges as ``from_id, to_id`` in both directions, each once; loops and missing ends lead nowhere."""
    one = edges.select(F.col(start).cast("string").alias("from_id"), F.col(end).cast("string").alias("to_id"))
    back = one.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    return one.unionByName(back).where("from_id <> to_id").distinct()


def expand(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Nodes within ``hops`` edges of each query's seeds: ``query_id, id, hops``, the fewest edges to each.

    ``edges`` has ``from_id, to_id``, ``seeds`` has ``query_id, id``; seeds
    are at 0 hops. A round follows only the nodes that the round before reached
    first, so an edge is walked once a query. What a round reaches is written
    before the next one: a lost executor repeats a round, not the walk.
    """
    reached = written(seeds.select(F.col("query_id").cast("string").alias("query_id"), F.col("id").cast("string").alias("id"))
                      .where("id IS NOT NULL AND query_id IS NOT NULL").distinct().withColumn("hops", F.lit(0)))
    frontier = reached
    for hop in range(1, hops + 1):
        ends = frontier.join(edges, F.col("id") == F.col("from_id")).select("query_id", F.col("to_id").alias("id")).distinct()
        frontier = written(ends.join(reached, ["query_id", "id"], "left_anti").withColumn("hops", F.lit(hop)))
        reached = reached.unionByName(frontier)
    return reached


def _ranked(df: DataFrame, name: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col(name) <= k)


def hybrid_search(queries: DataFrame, seeds: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int, k: int, pool: int = 50) -> DataFrame:
    """The ``k`` best nodes a query: ``query_id, rank, id, hops, similarity, score``.

    ``queries`` has ``query_id, vector`` with unique ids, ``nodes`` has ``id,
    vector`` and holds only what the caller's filter lets through; the walk from
    the seeds passes through other nodes too. Two lists of ``pool`` nodes are made for
    a query: the nearest by vector, and those reached by fewest hops, nearer ones
    first. A node scores 1 / (RANK_OFFSET + rank) in each list that holds it;
    equal scores come by id. Seeds and the node that bears the query's id are
    no results. A query without a vector has the second list only, where
    its nodes come by id; ``hops`` is NULL for what no walk reached.
    """
    nodes = nodes.select(F.col("id").cast("string").alias("id"), "vector")
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").alias("_asked"))
    walk = expand(edges, seeds, hops)
    own = walk.where("hops = 0").select("query_id", "id")
    scored = walk.where("hops > 0 AND id <> query_id").join(nodes, "id").join(asked, "query_id") \
        .select("query_id", "id", "hops", F.round(cosine(F.col("vector"), F.col("_asked")), 9).alias("similarity"))
    linked = _ranked(scored, "_near", pool, F.col("hops"), F.col("similarity").desc_nulls_last(), F.col("id"))
    # seeds are not known to the vector search: it looks further by as many as the query with most seeds has
    most = own.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    alike = nearest(asked.withColumnRenamed("_asked", "vector"), nodes, pool + most, skip_self=True)
    alike = alike.select("query_id", "id", "similarity").join(own, ["query_id", "id"], "left_anti")
    alike = _ranked(alike, "_alike", pool, F.col("similarity").desc(), F.col("id"))
    both = linked.join(alike.withColumnRenamed("similarity", "_similarity"), ["query_id", "id"], "full")

    def share(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.lit(RANK_OFFSET) + F.col(rank)), F.lit(0.0))

    fused = both.withColumn("score", F.round(share("_near") + share("_alike"), 12))
    best = _ranked(fused, "rank", k, F.col("score").desc(), F.col("id"))
    return best.select("query_id", "rank", "id", "hops", F.coalesce("similarity", "_similarity").alias("similarity"), "score")
