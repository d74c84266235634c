"""Walks over relations and fused retrieval against plain code."""

import random
from collections import defaultdict

import numpy as np

from tracewell.operators.retrieval import RANK_OFFSET, both_ways, expand, hybrid_search


def around(links, seeds, hops):
    found = {s: 0 for s in seeds}
    edge = set(seeds)
    for hop in range(1, hops + 1):
        edge = {b for a in edge for b in links[a]} - set(found)
        found |= dict.fromkeys(edge, hop)
    return found


def graph(rng, nodes, edges):
    pairs = [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(edges)]
    pairs += [("n0", f"n{i}") for i in range(0, nodes, 2)]  # a hub
    links = defaultdict(set)
    for a, b in pairs:
        if a != b:
            links[a].add(b)
            links[b].add(a)
    return pairs, links


def test_expand(spark):
    pairs, links = graph(random.Random(3), 60, 40)
    edges = both_ways(spark.createDataFrame(pairs + pairs[:5] + [(None, "n1"), ("n1", None)], "a string, b string"), "a", "b")
    seeds = [("q1", "n1"), ("q1", "n1"), ("q1", "n2"), ("q2", "n0"), ("q3", "absent"), ("q4", None), (None, "n3")]
    got = {(r.query_id, r.id): r.hops for r in expand(edges, spark.createDataFrame(seeds, "query_id string, id string"), 3).collect()}
    expected = {(q, n): h for q, s in (("q1", ["n1", "n2"]), ("q2", ["n0"]), ("q3", ["absent"])) for n, h in around(links, s, 3).items()}
    assert got == expected
    assert expand(edges, spark.createDataFrame([], "query_id string, id string"), 2).count() == 0


def test_hybrid_search(spark):
    rng, draws = random.Random(4), np.random.default_rng(4)
    pairs, links = graph(rng, 40, 30)
    vectors = {f"n{i}": [float(x) for x in draws.normal(size=6)] for i in range(40)}
    vectors["n7"], vectors["n9"] = None, vectors["n10"]
    passed = {n: v for n, v in vectors.items() if n not in ("n4", "n0")}  # the walk passes the hub, which is no result
    queries = {"q1": vectors["n1"], "q2": vectors["n5"], "q3": None, "n6": vectors["n6"]}
    seeds = [("q1", "n1"), ("q1", "n3"), ("q2", "n5"), ("q3", "n2"), ("n6", "n6")]
    got = hybrid_search(
        spark.createDataFrame(list(queries.items()), "query_id string, vector array<double>"),
        spark.createDataFrame(seeds, "query_id string, id string"), both_ways(spark.createDataFrame(pairs, "a string, b string"), "a", "b"),
        spark.createDataFrame(list(passed.items()), "id string, vector array<double>"), hops=2, k=8, pool=10).collect()
    expected = []
    for q, v in queries.items():
        own = [n for s, n in seeds if s == q]

        def similar(n):
            a, b = v, passed[n]
            return None if a is None or b is None else round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 9)
        sims = {n: similar(n) for n in passed if n not in own and n != q}
        walk = {n: h for n, h in around(links, own, 2).items() if h and n in sims}
        by_hops = sorted(walk, key=lambda n: (walk[n], sims[n] is None, -(sims[n] or 0), n))[:10]
        by_vector = sorted((n for n in sims if sims[n] is not None), key=lambda n: (-sims[n], n))[:10]
        score = {n: round(sum(1 / (RANK_OFFSET + 1 + part.index(n)) for part in (by_hops, by_vector) if n in part), 12) for n in {*by_hops, *by_vector}}
        for rank, n in enumerate(sorted(score, key=lambda n: (-score[n], n))[:8], 1):
            expected.append((q, rank, n, walk[n] if n in by_hops else None, sims[n], score[n]))
    assert sorted(map(tuple, got)) == sorted(expected)
