"""The pipeline's stages, one after the other, against plain code on what each of them was given."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from llm_samples import ODD
from tokenizers import Tokenizer

import corpus_pipeline
from corpus_pipeline import COLUMNS, exact, long_repeats, near, packing
from tracewell.llm.factorisation import score, train
from tracewell.llm.gray_simhash import fingerprint
from tracewell.llm.tables import stored

LENGTH = 400


def sample():
    """Documents with near copies, repeated rows, one id for several texts, rows without id, and passages of many documents."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(600)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, rows = prose(90), [*ODD]
    rows += [(20 + i, prose(60 + i) + " é " + passage + " ü " + prose(30)) for i in range(6)]
    long = prose(400)
    rows += [(40 + i, long + (" end" if i % 2 else "")) for i in range(5)]                # near copies
    rows += [(50, prose(200)), (51, prose(200))]
    rows += [rows[-1], (50, rows[-2][1].replace(" ", "  ")), (50, long), (None, prose(120))]  # repeated rows, other texts of an id
    rows += [rows[-1], (60, passage * 2), (61, prose(20000))]
    return rows


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def by_repr(rows):
    return sorted(rows, key=repr)


def test_exact_leaves_one_row(spark, documents):
    rows = sample()
    got = pairs(exact(spark, documents(rows), ""))
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, t or ""))
    assert len(got) == len(groups)
    for i, t in got:
        least = min((g for g in groups[norm(t)] if not g[1]), default=min(groups[norm(t)]))
        assert (len(t or ""), i) == (-least[0], None if least[1] else least[2])


def test_two_equal_rows_keep_one_full_text(spark, documents):
    text = " ".join(f"word{i * i}" for i in range(200))
    docs = documents([(1, text), (1, text)])
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stored(stage(spark, docs, ""))
    assert pairs(docs) == [(1, text)]


def test_near_leaves_one_row_of_a_group(spark, documents):
    rows = sample()
    prints = {t: fingerprint(t or "", 3) % 2**64 for _, t in rows}
    up = {p: p for p in prints.values()}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p
    for p in up:
        for q in up:
            if p < q and (p ^ q).bit_count() <= 3:
                up[root(p)] = root(q)
    groups = defaultdict(list)
    for i, t in rows:
        groups[root(prints[t])].append((i, t))
    expected = []
    for members in groups.values():
        lowest = min((i for i, _ in members if i is not None), default=None)
        some = [t for i, t in members if i == lowest]
        expected.append((lowest, min(some, key=lambda t: (-len(t or ""), t is not None, t))))
    assert by_repr(pairs(near(spark, documents(rows), ""))) == by_repr(expected)


def test_long_repeats_go(spark, documents):
    rows = [(k, t) for k, (_, t) in enumerate(sample())]
    data = [(t or "").encode() for _, t in rows]
    starts = Counter(d[i:i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    expected = []
    for (k, t), d in zip(rows, data):
        covered = np.zeros(len(d) + 1, int)
        for i in range(len(d) - LENGTH + 1):
            if starts[d[i:i + LENGTH]] > 1:
                covered[i] += 1
                covered[min(i + LENGTH, len(d))] -= 1
        kept = bytes(x for x, c in zip(d, np.cumsum(covered)) if c == 0)
        expected.append((k, kept.decode("utf-8", "ignore")))
    got = long_repeats(spark, documents(rows), "")
    assert [c for c, _ in got.dtypes] == list(COLUMNS)
    assert sorted(pairs(got)) == expected
    assert any(len(k) < len(t or "") for (_, k), (_, t) in zip(expected, rows)) and all(r.n_chars == len(r.text) for r in got.collect())


def test_packing_keeps_every_id(spark, documents):
    rows = sample()
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter((i, tuple(words.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing(spark, documents(rows), "").collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        pieces[r.doc_id, r.doc_tokens].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for (i, n), found in pieces.items():
        same = sum(c for (j, ids), c in expected.items() if j == i and len(ids) == n)
        assert sum(len(ids) for _, ids in found) == n * same
    one = {k: sorted(v) for k, v in pieces.items() if sum(len(x) for _, x in v) == k[1]}
    for (i, n), found in one.items():
        assert expected[i, tuple(x for _, ids in found for x in ids)] == 1
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("empty", [False, True])
def test_whole_pipeline(spark, sf_dir, empty):
    """Every stage works on what the one before has kept; clean documents reach the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.limit(0) if empty else docs
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality":
            expected = {r.doc_id for r in score(docs, model).where("score >= 0.3").collect()}
        docs = stored(score(docs, model).where("predicted = 1").select(*COLUMNS) if name == "quality" and empty else stage(spark, docs, sf_dir))
        assert docs.columns == list(COLUMNS)
        counts.append(docs.count())
        if name == "quality":
            assert {r.doc_id for r in docs.collect()} == expected
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4]
    pieces = packing(spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
