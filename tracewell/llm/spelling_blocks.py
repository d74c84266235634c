"""Spelling variants of the words of a corpus, found by blocked Gram matrices of letter counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import stored, whole_text

#: Letters of words: ASCII letters and U+00C0 to U+00FF, one byte each in Latin-1.
RUN = "[A-Za-zÀ-ÿ]{%d,}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words and bytes of a block; a block is one side of a matrix product.
BLOCK_WORDS, BLOCK_BYTES = 512, 1 << 16
#: Columns of the count matrices; letters that share one only make the bound weaker.
DIMENSIONS = 32
#: Near pairs that a task gathers before it sums them up.
HELD_PAIRS = 2_000_000
#: One in so many occurrences loses a letter.
DAMAGE = 31


def spelled(docs: DataFrame, shortest: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row (word) per occurrence of at least ``shortest`` letters: runs of letters, A-Z in lower case.

    An occurrence loses the letter at ``h % length`` if ``DAMAGE`` divides h,
    the CRC-32 of the id, a colon and the run.
    """
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), whole_text(text).alias("t"))
    run = F.explode(F.regexp_extract_all("t", F.lit(RUN % shortest), F.lit(0)))
    runs = runs.select("id", run.alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)


def _letter_counts(words: np.ndarray) -> np.ndarray:
    """Rows of counts for rows of Latin-1 bytes."""
    n, length = words.shape
    flat = np.repeat(np.arange(n) * DIMENSIONS, length) + words.ravel() % DIMENSIONS
    return np.bincount(flat, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)


def near_in_blocks(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``left`` and ``right`` (Latin-1 bytes, ``right`` as long or one longer) at one edit.

    The product of the two count matrices, with a column each for the lengths
    of the vectors, gives all squared distances of counts; one edit changes
    them by 2 at most. Pairs beyond that are left out, the others are compared
    letter by letter.
    """
    a, b = _letter_counts(left), _letter_counts(right)
    exact = np.float32 if max(left.shape[1], right.shape[1]) < 2000 else np.float64
    ones_a, ones_b = np.ones((len(a), 1), exact), np.ones((len(b), 1), exact)
    x = np.hstack([-2 * a.astype(exact), (a * a).sum(axis=1)[:, None].astype(exact), ones_a])
    y = np.hstack([b.astype(exact), ones_b, (b * b).sum(axis=1)[:, None].astype(exact)]).T
    found = []
    for at in range(0, len(x), BLOCK_WORDS):
        i, j = np.divmod(np.flatnonzero(x[at:at + BLOCK_WORDS] @ y <= 2), len(right))
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            p, q = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
            u, v = left[p], right[q]
            if u.shape[1] == v.shape[1]:
                near = (u != v).sum(axis=1) == 1
            else:
                begins = np.cumprod(u == v[:, :-1], axis=1, dtype="u1").sum(axis=1, dtype="i8")
                ends = np.cumprod((u == v[:, 1:])[:, ::-1], axis=1, dtype="u1").sum(axis=1, dtype="i8")
                near = begins + ends >= u.shape[1]
            found.append((p[near], q[near]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, "i8"), np.zeros(0, "i8"))


def _partners(hits: np.ndarray, partners: np.ndarray) -> pd.DataFrame:
    """For every place in ``hits``: how often it is there, and its first partner."""
    order = np.lexsort((partners, hits))
    place, first, many = np.unique(hits[order], return_index=True, return_counts=True)
    return pd.DataFrame({"place": place, "n_near": many, "best": partners[order[first]]})


def near_words(vocabulary: DataFrame) -> DataFrame:
    """One row (place, n_near, best) per word with a word at one edit; ``vocabulary`` has columns place, word and n.

    place is a distinct number of each word; best is the least of the words
    near. Words are put into blocks of equal length and equal counts of the
    commonest letters; the number of letters grows with the logarithm of the
    vocabulary. One edit adds, takes or exchanges one letter, so a block meets
    only itself, blocks that are one letter longer, and blocks of its length
    with one letter exchanged: an equi-join on the counts. The vocabulary is
    range-partitioned and sorted, and cut into blocks of at most
    ``BLOCK_WORDS``, so that one key may hold any number of words. A task
    gives one row per word for what it has found near it.
    """
    letters = (vocabulary.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count()
               .orderBy(F.desc("count"), "c").select("c"))
    depth = max(4, math.ceil(math.log2(max(2, vocabulary.count()))) - 14)
    common = [r.c for r in letters.take(depth)]  # at most one row per letter of the alphabet
    counts = [F.length("word") - F.length(F.translate("word", c, "")) for c in common]
    keyed = vocabulary.select("word", "place", F.array(F.length("word") - sum(counts, F.lit(0)), *counts).alias("key"))
    ranged = keyed.repartitionByRange("key", "word").sortWithinPartitions("key", "word")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, words, places = None, [], []

        def block() -> tuple:
            return list(held), places[0], len(words[0]), "".join(words).encode("latin-1"), np.array(places, "<i8").tobytes()

        for batch in batches:
            out = []
            for key, word, place in zip(map(tuple, batch["key"]), batch["word"], batch["place"].tolist()):
                if words and (key != held or len(words) >= min(BLOCK_WORDS, max(1, BLOCK_BYTES // len(word)))):
                    out.append(block())
                    words, places = [], []
                held = key
                words.append(word)
                places.append(place)
            yield pd.DataFrame(out, columns=["key", "block", "length", "words", "places"])
        if words:
            yield pd.DataFrame([block()], columns=["key", "block", "length", "words", "places"])

    blocks = stored(ranged.mapInPandas(cut, "key array<int>, block long, length int, words binary, places binary"))
    size = len(common) + 1

    def moved(changes: dict[int, int]) -> Column:
        return F.array(*[F.col("key")[i] + changes.get(i, 0) for i in range(size)])

    meets = [moved({}), *[moved({i: 1}) for i in range(size)], *[moved({i: 1, j: -1}) for i, j in combinations(range(size), 2)]]
    left = blocks.select(F.explode(F.filter(F.array(*meets), lambda k: F.array_min(k) >= 0)).alias("meet"), "key",
                         *[F.col(c).alias(f"{c}_a") for c in ("block", "length", "words", "places")])
    right = blocks.select(F.col("key").alias("meet"), "block", "length", "words", "places")
    pairs = left.join(right.hint("merge"), "meet").where((F.col("key") != F.col("meet")) | (F.col("block_a") <= F.col("block")))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits, partners, held = [], [], 0
        for batch in batches:
            # a block meets all others of a length at once
            sides: dict[tuple, list[int]] = {}
            for at, (a, length, b) in enumerate(zip(batch["block_a"].tolist(), batch["length_a"].tolist(), batch["block"].tolist())):
                sides.setdefault((b, length, a == b), []).append(at)
            lengths, words, words_a = batch["length"].tolist(), batch["words"].tolist(), batch["words_a"].tolist()
            places, places_a = batch["places"].tolist(), batch["places_a"].tolist()
            for (_, length, itself), rows in sides.items():
                left = np.frombuffer(b"".join([words_a[r] for r in rows]), "u1").reshape(-1, length)
                right = np.frombuffer(words[rows[0]], "u1").reshape(-1, lengths[rows[0]])
                i, j = near_in_blocks(left, right, itself)
                if len(i):
                    x = np.frombuffer(b"".join([places_a[r] for r in rows]), "<i8")[i]
                    y = np.frombuffer(places[rows[0]], "<i8")[j]
                    hits += [x, y]
                    partners += [y, x]
                    held += 2 * len(x)
                    if held >= HELD_PAIRS:
                        yield _partners(np.concatenate(hits), np.concatenate(partners))
                        hits, partners, held = [], [], 0
        if held:
            yield _partners(np.concatenate(hits), np.concatenate(partners))

    found = pairs.select("block_a", "length_a", "words_a", "places_a", "block", "length", "words", "places").mapInPandas(
        meet, "place long, n_near long, best long")
    return stored(found).groupBy("place").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """The end of every chain of (word, form), by doubling; counts grow along a chain, so none is a loop."""
    reached = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(reached.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                 F.col("further").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        reached = step.select("word", "root")


def spelling_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = 7, least: int = 2, factor: int = 10) -> DataFrame:
    """One row (word, n, n_near, form, form_n, root) per word of ``shortest`` or more letters that occurs ``least`` times or more.

    Words come from ``spelled``. n_near counts the words at one inserted,
    deleted or replaced letter. A word's form is the most frequent of those
    (ties: first in code-point order) if it occurs ``factor`` times as often,
    else NULL, form_n likewise; root follows forms to the last, a word without
    form is its own. NULL texts hold no words, a NULL id counts as an empty
    string; repeated rows count each. Other columns are not read. A table
    without words gives an empty result. Occurrences are counted before they
    are moved; words of any length are handled, long ones in blocks of fewer.
    """
    counted = spelled(docs, shortest, text, doc_id).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # places follow frequency, then code points; no two words are equal, so a task that is run again gives the same
    ordered = counted.repartitionByRange(F.desc("n"), "word").sortWithinPartitions(F.desc("n"), "word")
    vocabulary = stored(ordered.select(F.monotonically_increasing_id().alias("place"), "word", "n"))
    others = vocabulary.select(F.col("place").alias("best"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = near_words(vocabulary).join(others, "best").select("place", "n_near", "other", "other_n")
    joined = vocabulary.join(near, "place", "left").withColumn("enough", F.col("other_n") >= factor * F.col("n"))
    judged = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                  F.when(F.col("enough"), F.col("other")).alias("form"), F.when(F.col("enough"), F.col("other_n")).alias("form_n")))
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
