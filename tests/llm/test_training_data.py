"""Each operator against a plain computation, on odd rows and on small tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from llm_samples import LINE, ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import prefix_bpe
from tracewell.llm.column_suffixes import SEGMENT, anchors, suffix_dedup
from tracewell.llm.components import components
from tracewell.llm.cover_tree import near_vectors
from tracewell.llm.extendible_dedup import build_index, directory, exact_dedup
from tracewell.llm.factorisation import fit, is_held_out, score, train
from tracewell.llm.gray_simhash import close_pairs, fingerprints, gray_rank, simhash_dedup
from tracewell.llm.jump_shards import jump_hash, shard
from tracewell.llm.line_chunks import line_dedup
from tracewell.llm.order_packing import best_cuts, pack
from tracewell.llm.zip_warc import members, read_archives, write_archives

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def roots(n, edges):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def lowest(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


def pairs(rows):
    return sorted(rows, key=repr)


# sharding

def canonical_jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 8, 9, 1000])
def test_jump_hash(spark, shards):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 10863919174838991, 123456789]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_hash(F.col("k"), shards).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: canonical_jump(k, shards) for k in keys}


def test_shards(odd, spark):
    got = shard(odd.withColumn("slot", F.lit("clash")), 4).collect()
    assert len(got) == len(ODD)
    by_shard = defaultdict(list)
    for r in got:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 4)
        by_shard[r.shard].append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({i for i, _ in ODD})
    many = shard(spark.range(30000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), 8).groupBy("shard").agg(
        F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    assert len(many) == 8 and all(r.n == r.m + 1 == r.d and abs(r.n - 3750) < 300 for r in many)


# exact deduplication

def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def test_exact_dedup(odd):
    groups = defaultdict(list)
    for i, t in ODD:
        groups[norm(t)].append((-len(t or ""), i))
    expected = []
    for i, t in ODD:
        known = [g for g in groups[norm(t)] if g[1] is not None]
        keep = min(known)[1] if known else None
        if len(groups[norm(t)]) == 1:
            keep = i
        expected.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = exact_dedup(odd.withColumn("kept", F.lit(7)).withColumn("norm", F.lit(1)))
    assert pairs(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == pairs(expected)
    assert set(got.columns) == {*odd.columns, "norm", "keep_id", "group_size", "kept", "text_sha256"}


def test_directory_splits_only_full_buckets(spark, documents):
    hashes = spark.range(4000).select(F.xxhash64("id").alias("h"))
    crowded = hashes.unionAll(spark.range(3000).select(F.shiftrightunsigned(F.xxhash64("id"), 8).alias("h")))
    rows = directory(crowded.distinct(), 500).collect()
    depth = rows[0].global_depth
    held = Counter((h % 2**64) >> (64 - depth) for (h,) in crowded.distinct().collect())
    buckets = defaultdict(int)
    for r in rows:
        buckets[r.depth, r.bucket] += held[r.slot]
        assert r.bucket == r.slot >> (depth - r.depth)
    assert all(n <= 500 for (d, _), n in buckets.items() if d < depth) and len({d for d, _ in buckets}) > 1
    index = build_index(documents([(k, f"t{k % 50}") for k in range(200)]), capacity=10)
    assert index.count() == 50 and index.where("group_size = 4 AND chain = 1").count() == 50


def test_index_of_hot_copies_leaves_no_names(spark, documents):
    before = {t.name for t in spark.catalog.listTables()}
    hot = documents([(k, "same " * (1 + (k == 77)) if k % 3 else f"t{k}") for k in range(900)])
    sizes = sorted(r.group_size for r in build_index(hot, capacity=4).collect())
    assert sizes == [1] * 301 + [599]  # the text of 77 is longer
    kept = {r.doc_id for r in exact_dedup(hot, capacity=4).where("kept").collect()}
    assert kept == {k for k in range(900) if k % 3 == 0} | {1, 77}
    assert {t.name for t in spark.catalog.listTables()} == before


# line chunks

def chunked(text):
    lines = (text or "").split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % (2**31 - 1) for x in lines]
    out, now = [], []
    for k, line in enumerate(lines):
        now.append(line)
        roll = 0
        for j in (k - 2, k - 1, k):
            roll = (roll * 16807 + (hashes[j] if j >= 0 else 0)) % (2**31 - 1)
        if roll % 4 == 0 or k == len(lines) - 1:
            out.append(now)
            now = []
    return out


def test_line_dedup(documents):
    random.seed(5)
    vocabulary = [f"line {k}" for k in range(12)]
    shared = [f"shared {k}" for k in range(30)]
    texts = [(k, "\n".join(random.choices(vocabulary, k=random.randrange(1, 9)) + (shared if k % 3 else []) + [f"own {k}"])) for k in range(60)]
    texts += [(100, None), (101, ""), (102, "\n\n\n"), (103, "\n\n\n")]
    seen, expected = set(), {}
    for i, t in sorted(texts):
        kept = []
        for c in chunked(t):
            body = "\n".join(c)
            if len(c) < 2 or body not in seen:
                kept.append(body)
            if len(c) >= 2:
                seen.add(body)
        expected[i] = "\n".join(kept)
    got = line_dedup(documents(texts).withColumn("n_lines", F.lit("x"))).collect()
    assert {r.doc_id: r.kept_text for r in got} == expected
    assert all(r.n_lines == len((t or "").split("\n")) for r in got for i, t in texts if i == r.doc_id)
    assert sum(r.removed_chunks for r in got) > 50


def test_line_dedup_odd_rows(odd):
    got = line_dedup(odd).collect()
    assert len(got) == len(ODD) and all(r.kept_text is not None for r in got)


# byte pair encoding

def test_bpe_equals_tiktoken(odd):
    ranks = prefix_bpe.Vocabulary.load(RANKS).ranks
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = prefix_bpe.decode(prefix_bpe.encode(odd.withColumn("ids", F.lit(1)), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.ids == real.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_prefix_tables_append_and_edit():
    vocabulary = prefix_bpe.Vocabulary.load(RANKS)
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    random.seed(3)
    for alphabet in ("ab", "aeith '", " \n", "é中\U0001f600 ", "=-*"):
        for _ in range(30):
            text = "".join(random.choice(alphabet) for _ in range(random.randrange(1, 40)))
            table = prefix_bpe.TextTable(vocabulary, public_tokenizers.PATTERN)
            for c in text:
                table.append(c)
            assert table.ids() == real.encode_ordinary(text)
            data = text.encode()
            piece = prefix_bpe.PrefixTable(vocabulary, data)
            a = random.randrange(len(data) + 1)
            piece.replace(a, min(len(data), a + 2), b"xa")
            assert piece.last == prefix_bpe.PrefixTable(vocabulary, piece.data).last
    long = prefix_bpe.PrefixTable(vocabulary, b"the cat sat " * 300)
    assert long.replace(100, 101, b"xyz") < 500
    assert long.last == prefix_bpe.PrefixTable(vocabulary, long.data).last


# packing

def test_pack(odd):
    tokenizer = Tokenizer.from_file(WORDS)
    got = pack(odd, WORDS, window=64).collect()
    ids_of = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in ODD)
    windows, documents = defaultdict(list), defaultdict(list)
    for r in got:
        assert 0 < r.length <= 64 and len(r.ids) == 4 * r.length
        windows[r.sequence_id].append((r.offset, r.length))
    for some in windows.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 64
    # the pieces of a document follow each other; documents of one id are told apart by where they start
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        documents[r.doc_id, r.doc_tokens].append(r)
    found = Counter()
    for (i, n), some in documents.items():
        open_ids = []
        for r in some:
            assert r.start == len(open_ids) % n
            open_ids += np.frombuffer(bytes(r.ids), "<u4").tolist()
        for at in range(0, len(open_ids), n):
            found[i, tuple(open_ids[at:at + n])] += 1
    assert found == ids_of


def test_cuts_are_the_cheapest():
    random.seed(9)
    for _ in range(60):
        points = np.cumsum([random.randrange(1, 9) for _ in range(random.randrange(1, 12))])
        costs = np.array([random.choice([0.0, 2.0, 5.0]) for _ in points])
        costs[-1] = 0.0
        best = {0: 0.0}
        place = [0, *points.tolist()]
        for j in range(1, len(place)):
            best[j] = min(best[i] + 16 - (place[j] - place[i]) + costs[j - 1] for i in range(j) if place[j] - place[i] <= 16)
        tails = [best[j] + 48.0 * ((place[-1] - place[j]).bit_count() - 1) for j in range(len(place) - 1) if place[-1] - place[j] <= 16]
        cuts = best_cuts(points, costs, 16)
        lengths = np.diff([0, *cuts])
        assert cuts[-1] == points[-1] and lengths.max() <= 16
        costs_of_splits = []
        for m in range(len(cuts) + 1):  # m padded windows, then a tail of powers of two
            padded, at = 0.0, 0
            if not set(cuts[:m]) <= set(points.tolist()):
                continue
            for c in cuts[:m]:
                padded += 16 - (c - at) + costs[points.tolist().index(c)]
                at = c
            rest = place[-1] - at
            if m == len(cuts):
                costs_of_splits.append(padded)
            elif rest <= 16 and np.diff([at, *cuts[m:]]).tolist() == [1 << k for k in range(5, -1, -1) if rest >> k & 1]:
                costs_of_splits.append(padded + 48.0 * (rest.bit_count() - 1))
        assert min(costs_of_splits) == pytest.approx(min([best[len(place) - 1], *tails]))


# quality

def test_quality_learns_without_held_out_rows(spark, documents, sf_dir):
    good = [(k, " ".join(random.Random(k).choices(["alpha", "beta", "gamma", "delta", "of", "the"], k=60)) + ".") for k in range(400)]
    bad = [(k, "BUY!! " * random.Random(k).randrange(5, 90)) for k in range(400, 520)]
    docs = documents(good + bad + [(9000, None), (9001, ""), (None, "alpha beta")])
    labels = spark.createDataFrame([(k, int(k < 400)) for k in range(520)] + [(None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(is_held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    model = train(docs, flipped)
    rows = score(docs.withColumn("score", F.lit("x")), model).withColumn("out", is_held_out("doc_id")).collect()
    assert len(rows) == 523 and all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.out and r.doc_id is not None and r.doc_id < 520]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held) and len(held) > 60
    assert sum((r.score >= 0.3) == (r.doc_id < 400) for r in held) >= 0.97 * len(held)


def test_quality_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score(odd, train(odd, none)).collect()} == {0.5}
    assert fit([], np.zeros(0)).bias == 0.0


# SimHash

def plain_fingerprint(text):
    data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    grams = [b" ".join(words[k:k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if grams and 2 * sum(h >> k & 1 for h in hashes) > len(grams))


def test_simhash(documents):
    random.seed(8)
    words = [f"w{k}" for k in range(300)]
    texts = [(k, " ".join(random.choices(words, k=random.choice([3, 40, 150])))) for k in range(120)]
    for k in range(120, 220):
        near = texts[random.randrange(120)][1].split(" ")
        near[random.randrange(len(near))] = "new"
        texts.append((k, " ".join(near)))
    texts += ODD
    prints = [plain_fingerprint(t) for _, t in texts]
    n = len(texts)
    root = roots(n, [(a, b) for a in range(n) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    low = {r: lowest([texts[k][0] for k in range(n) if root[k] == r]) for r in set(root)}
    got = simhash_dedup(fingerprints(documents(texts).withColumn("component_id", F.lit("x")))).collect()
    expected = [(texts[k][0], f"{prints[k]:016x}", low[root[k]]) for k in range(n)]
    assert pairs((r.doc_id, r.fingerprint, r.component_id) for r in got) == pairs(expected)
    assert 20 < len(set(root)) < n - 20


def test_close_pairs_of_dense_groups():
    draw = np.random.default_rng(4)
    base = draw.integers(0, 2**63, 40, dtype="u8")
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << draw.integers(0, 64, 40, dtype="u8")) for _ in range(20)]))
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    values = values[np.argsort(rank)]
    i, j = close_pairs(values, values, 3, True)
    expected = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if int(values[a] ^ values[b]).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist())) == expected and len(i) == len(expected)


def test_gray_neighbours_differ_in_one_bit(spark):
    rows = spark.range(64).select(F.col("id"), gray_rank(F.col("id")).alias("r")).orderBy("r").collect()
    assert [r.r for r in rows] == list(range(64))
    assert all((a.id ^ b.id).bit_count() == 1 for a, b in zip(rows, rows[1:]))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000), (7, 3), (2**62, -(2**62))]
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r.component].add(r.node)
    assert sorted(map(len, groups.values())) == [1, 2, 200, 301] and len(found) == 504
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# vectors

def test_near_vectors(spark):
    draw = np.random.default_rng(1)
    base = draw.normal(size=(25, 16))
    rows = []
    for k in range(900):
        v = base[k % 25] + draw.normal(size=16) * (0.06 if k % 2 else 0.25)
        rows.append((k, v.astype("f4").tolist(), k % 3))
    rows += [(k, rows[0][1], 0) for k in range(2000, 2100)]
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] + [1.0] * 15, 0), (3003, rows[0][1], None), (3004, rows[0][1][:8], 0),
             (3005, [None] + [1.0] * 15, 0), (3006, [float("inf")] + [1.0] * 15, 0), (3007, [], 0), (3008, [1e-30] * 16, 1), (3009, [1e30] * 16, 1)]
    good = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    edges, links = [], Counter()
    for a in range(len(good)):
        for b in range(a):
            if good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]):
                x, y = np.array(good[a][1], "f8"), np.array(good[b][1], "f8")
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    edges.append((a, b))
                    links[good[a][0]] += 1
                    links[good[b][0]] += 1
    root = roots(len(good), edges)
    low = {good[k][0]: good[root[k]][0] for k in range(len(good))}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("clash"))
    got = near_vectors(df.repartition(3)).collect()
    assert pairs((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == pairs(
        (r[0], links[r[0]], low.get(r[0], r[0]), low.get(r[0], r[0]) == r[0]) for r in rows)
    assert sum(links.values()) > 5000
    assert near_vectors(df.limit(0)).count() == 0


# repeated strings

def plain_repeats(texts, length):
    count = Counter()
    for _, t in texts:
        data = (t or "").encode()
        count.update(data[p:p + length] for p in range(len(data) - length + 1))
    out = []
    for i, t in texts:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if count[data[p:p + length]] > 1:
                gone[p:p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(data), int(gone.sum()), runs, bytes(np.frombuffer(data, "u1")[~gone])))
    return out


@pytest.mark.parametrize("length, largest", [(20, 3), (33, 256)])
def test_repeated_strings(documents, length, largest):
    random.seed(length)
    passage = "".join(random.choice("abcdefgh é") for _ in range(90))
    texts = [(i, "".join(random.choice("abc") for _ in range(random.choice([5, 60, 200])))
              + (passage[random.randrange(20):random.randrange(60, 90)] if i % 2 else "") + "".join(random.choice("xyz") for _ in range(30)))
             for i in range(80)]
    texts += [t for t in ODD if len(t[1] or "") < 600] + [(902, "a" * 300), (903, "ab" * 200), (904, texts[3][1]), (None, texts[5][1]), (906, LINE * 5)]
    got = suffix_dedup(documents(texts).withColumn("n_bytes", F.lit("x")), length, largest=largest).collect()
    assert pairs((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == pairs(plain_repeats(texts, length))
    assert Counter((r.doc_id, r.text) for r in got) == Counter(texts)


def test_repeated_lines_are_few_rows(spark, documents):
    """A line that many texts repeat is settled by as many rows, however often a text has it."""
    random.seed(5)
    heads = ["".join(random.choice("abcdefgh") for _ in range(700)) for _ in range(6)]

    def found(times):
        texts = spark.createDataFrame([(k, head + LINE * times) for k, head in enumerate(heads)], "_t_row long, _t_text string")
        rows = anchors(texts, 400, 100).collect()
        assert all(r.n == 1 if r.at == r.last else r.n > 1 for r in rows)
        return len(rows), sum(r.n for r in rows)

    (few, places), (many, more) = found(40), found(160)
    assert many <= few + len(heads) and more >= places + 6 * 100
    texts = [(k, head + LINE * (40 + k) + head[k:90] + LINE * 9) for k, head in enumerate(heads)] + [(9, LINE * 15 + heads[0][:500] + LINE * 15)]
    got = suffix_dedup(documents(texts), 400).collect()
    assert pairs((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == pairs(plain_repeats(texts, 400))


def test_seams_of_long_texts_repeat_nothing(documents):
    random.seed(6)
    letters = "".join(random.choices("abcdefghijklmnop", k=3 * SEGMENT + 5000))
    passage = letters[2 * SEGMENT - 300:2 * SEGMENT + 300]
    texts = [(1, letters), (2, "<" + passage + ">"), (3, letters[:399]), (4, "short")]
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in suffix_dedup(documents(texts), 400).collect()}
    assert got == {1: (600, 1, letters.replace(passage, "")), 2: (600, 1, "<>"), 3: (0, 0, letters[:399]), 4: (0, 0, "short")}


# archives

def test_archives(spark):
    rows = [(k, f"http://h/{k % 7}\n", None if k % 11 == 0 else f"<p>{k % 5}</p>é" if k % 2 else "x" * k) for k in range(60)]
    rows += [(None, None, "<p>1</p>é"), (None, "u", "alone"), (3, "again", rows[3][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    got = read_archives(write_archives(df)).collect()
    same = defaultdict(list)
    for i, _, h in rows:
        same[h or ""].append(i)
    expected = []
    for i, u, h in rows:
        first, data = lowest(same[h or ""]), (h or "").encode()
        revisit = len(same[h or ""]) > 1 and first is not None and i != first
        expected.append((None if i is None else str(i), "revisit" if revisit else "response", len(data),
                         base64.b32encode(hashlib.sha1(data).digest()).decode(), str(first) if revisit else None))
    assert pairs((r.id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in got) == pairs(expected)
    assert all(r.payload is None if r.record_type == "revisit" else len(r.payload) == r.payload_bytes for r in got)
    large = read_archives(write_archives(df, least_bytes=9)).collect()
    assert all(r.record_type == "response" for r in large if r.payload_bytes < 9) and any(r.record_type == "revisit" for r in large)
    assert read_archives(write_archives(df.limit(0))).count() == 0


def test_zip64_directory(tmp_path):
    import zipfile
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for k in range(66_000):  # more than the plain directory can count
            z.writestr(f"m{k}", b"")
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"hello")
        z.writestr("packed", b"a" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 in a comment"
    data = path.read_bytes()
    found = members(lambda at, n: data[at:at + n], len(data))
    assert len(found) == 66_002 and found[-2].name == "big" and found[-2].size == 5 and found[-2].stored and not found[-1].stored
    with pytest.raises(ValueError):
        members(lambda at, n: b"no zip at all"[at:at + n], 13)


def test_empty_tables(documents):
    none = documents([])
    for op in (lambda d: shard(d, 8), exact_dedup, line_dedup, lambda d: simhash_dedup(fingerprints(d)), suffix_dedup, lambda d: pack(d, WORDS),
               lambda d: prefix_bpe.encode(d, RANKS, public_tokenizers.PATTERN)):
        assert op(none).count() == 0
