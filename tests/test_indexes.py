"""Stored indexes: pruned nearest vectors, ranked and phrase search, vectors by text; range joins through nested cells."""

import math
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from tracewell.operators import vector_index
from tracewell.operators.embedding import embed, embed_once
from tracewell.operators.ranked_text import RankedIndex
from tracewell.operators.sessions import attach_sessions
from tracewell.operators.similarity import nearest
from tracewell.operators.text_index import build_text_index, search_text_index, write_text_index
from tracewell.operators.vector_index import VectorIndex
from tracewell.sources.versions import VersionedTable

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def hits(df):
    return sorted((r.query_id, r["rank"], r.id, r.similarity) for r in df.collect())


def clustered(rng, groups, each, dims=16):
    centres = rng.normal(size=(groups, dims))
    return [(f"v{g}-{i}", (centres[g] + 0.05 * rng.normal(size=dims)).tolist()) for g in range(groups) for i in range(each)]


@pytest.mark.parametrize("skip_self", [False, True])
def test_vector_index_is_exact(spark, tmp_path, skip_self):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 20, 20)
    rows += [(f"copy{i}", rows[0][1]) for i in range(150)]  # a third are copies of one vector
    rows += [("none", None), ("empty", []), ("zero", [0.0] * 16), ("nan", [math.nan] * 16), ("inf", [math.inf] * 16), ("hole", [None] * 16)]
    rows += [("short1", [1.0, 2.0]), ("short2", [2.0, 1.0]), ("v0-0", rows[0][1])]
    candidates = spark.createDataFrame(rows, "id string, vector array<double>")
    asked = rows[::7] + rows[-9:] + [("far", (-np.asarray(rows[0][1])).tolist()), ("other length", [1.0, 2.0, 3.0])]
    queries = spark.createDataFrame(asked, "query_id string, vector array<double>")
    index = VectorIndex(spark, str(tmp_path / "index")).build(candidates)
    assert hits(index.search(queries, 4, skip_self)) == hits(nearest(queries, candidates, 4, skip_self))


def test_vector_index_skips_cells(spark, tmp_path):
    rows = clustered(np.random.default_rng(4), 30, 30)
    candidates = spark.createDataFrame(rows, "id string, vector array<double>")
    queries = candidates.selectExpr("id AS query_id", "vector")
    index = VectorIndex(spark, str(tmp_path / "index")).build(candidates, cells=100)
    found, probes = index.search_with_probes(queries, 3, True)
    assert hits(found) == hits(nearest(queries, candidates, 3, True))
    sizes = {r.cell: r["count"] for r in index._vectors().groupBy("cell").count().collect()}
    scored = sum(sizes[r.cell] for r in probes.collect())
    assert probes.count() == probes.distinct().count()
    assert scored < 0.25 * len(rows) ** 2


def test_vector_index_copies_no_vector_a_cell(spark, tmp_path, monkeypatch):
    """Random vectors meet nearly every cell; what is written stays in proportion to the queries."""
    rows = [(f"v{i}", row.tolist()) for i, row in enumerate(np.random.default_rng(8).normal(size=(600, 32)))]
    candidates = spark.createDataFrame(rows, "id string, vector array<double>")
    queries = candidates.selectExpr("id AS query_id", "vector")
    index = VectorIndex(spark, str(tmp_path / "index")).build(candidates, cells=40)
    written = []

    def counted(df, stored=vector_index._stored):
        out = stored(df)
        written.append(out.count() if "vector" in out.columns else 0)
        return out

    monkeypatch.setattr(vector_index, "_stored", counted)
    found, probes = index.search_with_probes(queries, 3, True)
    assert hits(found) == hits(nearest(queries, candidates, 3, True))
    assert probes.count() > 20 * len(rows) and sum(written) <= 5 * len(rows)


def test_vector_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id string, vector array<double>")
    some = spark.createDataFrame([("a", [1.0, 0.0])], "query_id string, vector array<double>")
    assert VectorIndex(spark, str(tmp_path / "a")).build(none).search(some, 3).count() == 0
    index = VectorIndex(spark, str(tmp_path / "b")).build(some.withColumnRenamed("query_id", "id"))
    assert index.search(none.withColumnRenamed("id", "query_id"), 3).count() == 0
    assert hits(index.search(some, 3)) == [("a", 1, "a", 1.0)]


def cut(text):
    return re.findall(r"[^\W_]+", text.lower())


def bm25(texts, query):
    cuts = {i: cut(t) for i, t in texts.items()}
    mean = sum(map(len, cuts.values())) / len(cuts)
    scores = defaultdict(float)
    for word in set(cut(query)):
        n = sum(word in c for c in cuts.values())
        for i, c in cuts.items():
            if word in c:
                tf = Counter(c)[word]
                scores[i] += math.log(1 + (len(cuts) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(c) / mean))
    return scores


def test_ranked_and_phrase_search(spark, tmp_path):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(["red", "blue", "Red", "sky", "sea", "the"]) for _ in range(rng.randrange(1, 60))) for i in range(120)}
    texts |= {200: "", 201: "...", 202: "the the the", 203: "red-sky red SKY", 204: "rare " * 5000}
    rows = list(texts.items())
    index = RankedIndex(spark, str(tmp_path / "index"))
    schema = "doc_id long, text string"
    assert index.search("red").count() == index.phrase("red sky").count() == 0
    index.add(spark.createDataFrame([], schema), "doc_id", "text")
    assert index.search("red").count() == 0
    for part in (rows[:60], rows[:60], rows[40:], [(None, "red"), (300, None)], [(7, "another text")]):
        index.add(spark.createDataFrame(part, schema), "doc_id", "text")

    def check():
        for query in ("red sky", "the THE", "rare", "absent", "!?", "red absent"):
            expected = bm25(texts, query)
            got = {r.id: r.score for r in index.search(query).collect()}
            assert got == pytest.approx(expected, abs=1e-8) and got.keys() == expected.keys()
        best = [(r.id, r.score) for r in index.search("red sky", 10).collect()]
        assert best == sorted(((r.id, r.score) for r in index.search("red sky").collect()), key=lambda r: (-r[1], r[0]))[:10]
        for query in ("red sky", "the the", "sea", "sky red sky", "red absent", ""):
            words = cut(query)
            counted = {i: sum(c[at:at + len(words)] == words for at in range(len(c))) for i, c in ((i, cut(t)) for i, t in texts.items())}
            assert {r.id: r.hits for r in index.phrase(query).collect()} == {i: n for i, n in counted.items() if n and words}

    check()
    folders = len(index.table.manifest().folders)
    index.merge()
    assert len(index.table.manifest().folders) < folders
    assert index.table.vacuum(keep=1) > 0
    check()


def test_segments_are_not_shuffled_by_word(spark, tmp_path):
    """A word is one row per batch of texts, and adding a segment moves texts only."""
    rows = [(i, "the sea the sky " + f"own{i}") for i in range(400)]
    index = RankedIndex(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    stored = index.table.read()
    assert stored.where("word = 'sea'").count() <= 4 and stored.where("word = 'sea'").selectExpr("sum(size(ids))").first()[0] == 400
    assert {r.id: r.hits for r in index.phrase("the sea the").collect()} == {i: 1 for i in range(400)}


def test_stored_words_are_blocks(spark, tmp_path):
    rows = [(i % 300, "The sea, the sky") for i in range(400)] + [(None, "the sea"), (None, "sea"), (900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    built = build_text_index(docs, "doc_id", "text")
    path = str(tmp_path / "words")
    for _ in range(2):
        write_text_index(built, path)
    stored = spark.read.parquet(path)
    assert stored.count() < built.count()
    expected = {i: 6 if i < 100 else 3 for i in range(300)} | {None: 3}
    for index in (built, stored):
        assert {r.doc_id: r.hits for r in search_text_index(index, "doc_id", "sea the").collect()} == expected


def test_texts_are_embedded_once(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "vectors"))

    def load():
        def backend(texts):
            assert len(texts) <= 3
            return np.random.default_rng().random((len(texts), 2))  # no two answers are equal
        return backend

    first = spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)] + [(40, None), (41, ""), (42, "x" * 100_000)], "id long, text string")
    again = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "id long, text string")
    one = {r.id: r.embedding for r in embed_once(first, "text", store, load, 2, call_size=3).collect()}
    assert one[40] is None and len(one) == 43
    by_text = {i % 5: one[i] for i in range(5)}
    assert all(one[i] == by_text[i % 5] for i in range(40)) and len({tuple(v) for v in by_text.values()}) == 5
    two = {r.id: r.embedding for r in embed_once(again, "text", store, load, 2, call_size=3).collect()}
    assert all(two[i] == by_text[i % 7] for i in range(40) if i % 7 < 5)
    assert store.read().count() == 9  # texts 0 to 6, the empty and the long one
    version = store.manifest().version
    embed_once(again, "text", store, load, 2, call_size=3)
    assert store.manifest().version == version  # nothing new, nothing written
    embed(first, "text", load, 2, call_size=3).collect()


def test_sessions_of_any_length_span_events(spark):
    rng = random.Random(6)
    sessions, events = [], []
    for owner in ("hot", "a", "b"):
        at = 0.0
        for n in range(60):
            begin, length = at + rng.choice([0, 1, 4000, 90_000]), rng.choice([0, 0.000001, 30, 5000, 4294.967296, 70_000, 40_000_000])
            sessions.append((owner, "t", f"{owner}{n}", START + timedelta(seconds=begin), START + timedelta(seconds=begin + length)))
            at = begin + length / 2  # neighbours overlap
    sessions += [("a", "t", "ages", datetime(1, 1, 2, tzinfo=timezone.utc), datetime(9999, 12, 30, tzinfo=timezone.utc)),
                 ("a", "t", "backwards", START + timedelta(days=2), START), ("a", "t", "open", START, None), (None, "t", "nobody", START, START)]
    edges = [t for s in sessions for t in s[3:] if t is not None]
    for n in range(600):
        owner = "hot" if n % 2 else rng.choice(["a", "b", "c", None])
        ts = rng.choice(edges) if rng.random() < 0.5 else START + timedelta(seconds=rng.uniform(-1e6, 6e8))
        events.append((n, owner, "t", ts if n % 50 else None, "old"))
    sf = spark.createDataFrame(sessions, "agent_id string, session_token string, session_id string, started_at timestamp, last_event_at timestamp")
    ef = spark.createDataFrame(events, "event_id long, agent_id string, session_token string, ts timestamp, session_id string")
    expected = []
    for n, owner, _, ts, _ in events:
        spans = [s[2] for s in sessions if None not in (owner, ts, s[0], s[4]) and s[0] == owner and s[3] <= ts <= s[4]]
        expected += [(n, s) for s in spans] or [(n, "")]
    got = [(r.event_id, r.session_id or "") for r in attach_sessions(ef, sf).select("event_id", "session_id").collect()]
    assert sorted(got) == sorted(expected)
