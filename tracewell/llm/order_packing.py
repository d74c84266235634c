"""Packing of tokenised documents into windows, in order, by dynamic programming."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.tables import whole_text

#: Cost, in tokens of padding, of cutting a document after a sentence and inside one.
SENTENCE_CUT, BLIND_CUT = 8.0, 48.0
#: Tokens without a boundary after which cuts inside a sentence are offered, and their distance.
LONG_SENTENCE, BLIND_STEP = 96, 48
BATCH_TOKENS = 4_000_000
#: Known words of a worker, and characters of text whose words are looked up together.
CACHED_WORDS, TEXT_TOGETHER = 600_000, 4_000_000


class _Numbers(dict):
    """Numbers of words, given in the order in which they are first looked up."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class WordTokens:
    """Ids of texts by a ``tokenizers`` file whose words do not depend on the white space around them.

    Texts of plain letters, digits and marks are cut by the file's own pattern
    into words; every word has a number, and the ids of numbered words are
    gathered for many texts at once. The library encodes only words that have
    no number yet, many at a time and already normalised (their last token
    carries the word-end mark). Any other text is cut at spaces and line feeds;
    its parts that are not plain go to the library as they are. The store of
    known words starts afresh when full.
    """

    _stores: dict[str, WordTokens] = {}

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """The store of this Python worker, which serves all its tasks."""
        if path not in cls._stores:
            cls._stores[path] = cls(path)
        return cls._stores[path]

    _MARKS = r"\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff"
    PLAIN = re.compile(rf"[{_MARKS}]+").fullmatch
    PLAIN_TEXT = re.compile(rf"[ \n{_MARKS}]*").fullmatch
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^ \na-z\xdf-\xf6\xf8-\xff0-9]+").findall

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit
        self.tokenizer, self.of_words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # words that are cut and in lower case already pass neither the normaliser nor the pattern again
        self.of_words.normalizer = None
        self.of_words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.word_end, self.sentence_end = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in vocabulary.items():
            self.word_end[i] = token.endswith("</w>")
            self.sentence_end[i] = token.endswith("</w>") and token[0] in ".!?"
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.stops = np.zeros(0, "<u4"), np.zeros(1, "i8")  # of number i: ids[stops[i]:stops[i + 1]]

    def _raw(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _is_plain(self, part: str) -> bool:
        return "<|" not in part and self.PLAIN(part) is not None

    def _words(self, text: str) -> list[str]:
        """Plain words in lower case, and parts that are not plain; no part is also a word."""
        if "<|" not in text and self.PLAIN_TEXT(text):
            return self.WORDS(text.lower())
        out = []
        for part in text.replace("\n", " ").split(" "):
            if self._is_plain(part):
                out += self.WORDS(part.lower())
            elif part:
                out.append(part)
        return out

    def _learn(self) -> None:
        """Add the ids of words that have a number but no ids."""
        new = list(islice(self.numbers, len(self.stops) - 1, None))
        ids, sizes = [self.ids], []
        for at in range(0, len(new), 1000):
            some = new[at:at + 1000]
            if all(map(self._is_plain, some)):
                joined = np.array(self.of_words.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
                stops = np.flatnonzero(self.word_end[joined]) + 1
                if len(stops) == len(some):
                    ids.append(joined)
                    sizes.append(np.diff(stops, prepend=0))
                    continue
            each = [self._raw(w) for w in some]
            ids += each
            sizes.append(np.array([len(x) for x in each], "i8"))
        self.ids = np.concatenate(ids)
        self.stops = np.concatenate([self.stops, self.stops[-1] + np.cumsum(np.concatenate([*sizes, np.zeros(0, "i8")]))])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        if len(self.numbers) > CACHED_WORDS:
            self._forget()
        number = self.numbers.__getitem__
        found = [np.fromiter(map(number, words), "i8", len(words)) for words in map(self._words, texts)]
        self._learn()
        numbers = np.concatenate([*found, np.zeros(0, "i8")])
        sizes = np.diff(self.stops)[numbers]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        data = self.ids[np.arange(stops[-1]) + np.repeat(self.stops[numbers] - stops[:-1], sizes)].tobytes()
        ends = (4 * stops[np.cumsum([0, *map(len, found)])]).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _some(rows: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    """Rows (key, text) in lists of about ``most`` characters of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def cut_points(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, and what a cut there costs.

    Ends of documents are free, ends of sentences cost ``SENTENCE_CUT``;
    inside long sentences places at even steps cost ``BLIND_CUT``.
    """
    known = np.union1d(ends, np.flatnonzero(sentence_end[ids]) + 1)
    begins, gaps = np.concatenate([[0], known[:-1]]), np.diff(known, prepend=0)
    far = np.flatnonzero(gaps > LONG_SENTENCE)
    steps = (gaps[far] - 1) // BLIND_STEP
    within = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps) + 1
    blind = np.repeat(begins[far], steps) + BLIND_STEP * within
    points = np.union1d(known, blind)
    costs = np.full(len(points), BLIND_CUT)
    costs[np.searchsorted(points, known)] = SENTENCE_CUT
    costs[np.searchsorted(points, ends)] = 0.0
    return points, costs


def best_cuts(points: np.ndarray, costs: np.ndarray, window: int) -> list[int]:
    """Ends of the windows over the whole stream, of least padding plus cutting costs.

    ``best[j]`` is the least cost of windows that end at point j: the minimum
    over points i at most one window back of best[i] + window - (p[j] - p[i]),
    that is of best[i] + p[i], kept in a monotone queue, so that each point
    enters and leaves it once. The stream's tail may instead be cut into
    windows of lengths that are powers of two, which need no padding.
    """
    p, c = [0, *points.tolist()], [0.0, *costs.tolist()]
    best, back, queue = [0.0], [0], deque([(0.0, 0)])
    for j in range(1, len(p)):
        here = p[j]
        while p[queue[0][1]] < here - window:
            queue.popleft()
        value, i = queue[0]
        cost = value + window - here + c[j]
        best.append(cost)
        back.append(i)
        key = cost + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    last, total, tail = len(p) - 1, p[-1], []
    lowest = best[-1]
    for j in range(len(p) - 2, -1, -1):
        rest = total - p[j]
        if rest > window:
            break
        cost = best[j] + BLIND_CUT * (rest.bit_count() - 1)
        if cost < lowest:
            lowest, last = cost, j
    if last < len(p) - 1:
        rest, at = total - p[last], p[last]
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                at += 1 << bit
                tail.append(at)
    cuts = []
    while last:
        cuts.append(p[last])
        last = back[last]
    return cuts[::-1] + tail


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of documents in windows of at most ``window`` tokens.

    A document is the ids of its whole text by the file at ``path``, then
    ``end_id``; a NULL or empty text is that id alone. Documents are packed in
    the order in which a task reads them, about ``BATCH_TOKENS`` tokens at a
    time, so a task holds a bounded stream and nothing is shuffled; what ends
    a stream wastes less than one window of padding. Rows of one id are
    packed each for itself; NULL ids stay NULL. Columns: the id, start (ids
    of the document before the piece), length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset.
    """
    rows = docs.select(F.col(doc_id).alias(doc_id), whole_text(text).alias("_t_text"))
    schema = T.StructType([rows.schema[0], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def windows(keys: list, packed: list[bytes], words: WordTokens, first: int) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(packed), "<u4")
        ends = np.cumsum([len(x) // 4 for x in packed])
        cuts = np.array(best_cuts(*cut_points(ids, ends, words.sentence_end), window))
        stops = np.union1d(ends, cuts)
        begins = np.concatenate([[0], stops[:-1]])
        doc, seq = np.searchsorted(ends, begins, "right"), np.searchsorted(cuts, begins, "right")
        doc_starts, cut_starts = np.concatenate([[0], ends[:-1]]), np.concatenate([[0], cuts[:-1]])
        data = ids.tobytes()
        return pd.DataFrame({
            doc_id: pd.Series([keys[d] for d in doc.tolist()], dtype=object),
            "start": begins - doc_starts[doc], "length": stops - begins,
            "ids": [data[4 * a:4 * b] for a, b in zip(begins.tolist(), stops.tolist())],
            "doc_tokens": (ends - doc_starts)[doc], "sequence_id": first + seq, "offset": begins - cut_starts[seq]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, keys, packed, held = WordTokens.of(path), [], [], 0
        end, first = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 33
        for batch in batches:
            every = batch.iloc[:, 0].astype(object).where(batch.iloc[:, 0].notna(), None)
            for some in _some(zip(every, batch["_t_text"]), TEXT_TOGETHER):
                for (key, _), ids in zip(some, words.encode_all([content for _, content in some])):
                    keys.append(key)
                    packed.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= BATCH_TOKENS:
                        out = windows(keys, packed, words, first)
                        first, keys, packed, held = int(out["sequence_id"].iloc[-1]) + 1, [], [], 0
                        yield out
        if keys:
            yield windows(keys, packed, words, first)

    return rows.mapInPandas(run, schema)
