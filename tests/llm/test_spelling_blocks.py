"""Spelling groups against a comparison of every word with every other."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_samples import ODD
from pyspark.sql import functions as F

from tracewell.llm import spelling_blocks
from tracewell.llm.spelling_blocks import near_in_blocks, spelled, spelling_groups


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plainly(rows, shortest=7, least=2, factor=10):
    words = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= shortest and n >= least}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items())


def variants(seed=5, stems=60):
    """Texts of stems and damaged stems in a chain of falling frequencies, with upper case and letters beyond ASCII."""
    rng = random.Random(seed)
    letters = "abceinrstéÿ×"
    rows = [*ODD]
    for k in range(stems):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9)))
        for times in (500, 36, 2):
            rows += [(1000 + len(rows) + t, f"{word.upper() if t % 9 == 0 and word.isascii() else word}-{word}") for t in range(times // 2)]
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1:], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1:]])
    rng.shuffle(rows)
    return rows


COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def test_groups(documents):
    rows = variants()
    expected = plainly(rows)
    assert sum(e[3] is not None and e[5] != e[3] for e in expected) > 5  # chains of two steps
    got = spelling_groups(documents(rows).withColumn("word", F.lit(1)).withColumn("n", F.lit(2)))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == expected


def test_small_blocks_and_more_letters(documents, monkeypatch):
    monkeypatch.setattr(spelling_blocks, "BLOCK_WORDS", 3)
    monkeypatch.setattr(spelling_blocks, "BLOCK_BYTES", 20)
    monkeypatch.setattr(spelling_blocks.math, "ceil", lambda x: 23)
    rows = variants(6, 25)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in spelling_groups(documents(rows)).collect()) == plainly(rows)


def test_ties_very_long_words_and_empty_tables(documents):
    long = "ab" * 3000
    rows = [(1, f"{long} {long} {long}x {long}x"), (2, "banana" * 2), (3, "banana" * 2)]
    rows += [(10 + i, "lettersb lettersa") for i in range(30)] + [(50 + i, "letters") for i in range(2)]
    got = spelling_groups(documents(rows))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == plainly(rows)
    assert next(r for r in plainly(rows) if r[0] == "letters")[3] == "lettersa"
    assert spelling_groups(documents([(1, None), (2, ""), (None, "short ones")])).collect() == []
    assert spelling_groups(documents(rows).limit(0)).collect() == []


@pytest.mark.parametrize("grow", [0, 1])
def test_product_and_edits(grow):
    rng = np.random.default_rng(3)
    left, right = rng.integers(97, 100, (200, 5), "u1"), rng.integers(97, 100, (150, 5 + grow), "u1")
    i, j = near_in_blocks(left, right, False)
    text = [[bytes(x).decode() for x in side] for side in (left, right)]
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, x in enumerate(text[0]) for b, y in enumerate(text[1]) if one_edit(x, y)}


def test_occurrences_are_runs(documents):
    rows = [(1, "Abcdefg1hijklmnopĀqrstuvwx")]
    got = sorted(r.word for r in spelled(documents(rows), 7).collect())
    assert got == sorted(w for w in ("abcdefg", "hijklmnop", "qrstuvwx") for h in [zlib.crc32(f"1:{w}".encode())] for w in
                         [w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w] if len(w) >= 7)
