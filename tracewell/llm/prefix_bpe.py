"""Byte-level BPE by dynamic programming over byte prefixes.

The encoding of every prefix of a byte string ends in exactly one token, and
the tokens before it are the encoding of the shorter prefix. One last token
per prefix is therefore the whole state: appending goes on from the stored
prefixes, and an edit recomputes only until the last tokens agree again.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import whole_text

CACHED_PIECES, SHORT_PIECE = 200_000, 64


class Vocabulary:
    """Tokens and ranks of a rank file (base64 token and rank per line)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._follows: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``; the token twice for one byte, None if merging never gives it."""
        if token not in self._halves:
            data = self.tokens[token]
            parts = [data[i:i + 1] for i in range(len(data))]
            while len(parts) > 2:
                steps = [self.ranks.get(a + b, token) for a, b in zip(parts, parts[1:])]
                at = min(range(len(steps)), key=steps.__getitem__)
                if steps[at] >= token:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            known = all(p in self.ranks for p in parts)
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[-1]]) if known and len(parts) <= 2 else None
        return self._halves[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart when their bytes are encoded together.

        Undoes merges from the last one on. If at any time the two parts at
        the seam could merge before the next undone merge uses one of them,
        the pair cannot occur. Equal ranks merge from the left.
        """
        known = self._follows.get((left, right))
        if known is None:
            known = self._follows[left, right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        used = float("inf")
        while True:
            seam = self.ranks.get(self.tokens[left] + self.tokens[right])
            if seam is not None and seam < used:
                return False
            if left > right:
                inner = self.halves(left)[1]
                if inner == left:
                    return True
                used, left = left, inner
            else:
                inner = self.halves(right)[0]
                if inner == right:
                    return True
                used, right = right + 0.5, inner

    def extend(self, data: bytes, last: list[int], stop: int) -> None:
        """Add to ``last`` the only token that can end each further prefix of ``data``, up to ``stop`` bytes."""
        get, known, longest = self.ranks.get, self._follows.get, self.longest
        for end in range(len(last), stop + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = get(data[start:end])
                if token is not None:
                    fits = known((last[start], token))
                    if fits is None:
                        fits = self.halves(token) is not None and (not start or self.follows(last[start], token))
                        self._follows[last[start], token] = fits
                    if fits:
                        last.append(token)
                        break
            else:
                raise ValueError(f"the vocabulary has no token for byte {data[end - 1]}")


    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of a piece; of a short one only the prefixes that the answer needs are worked out."""
        if data in self.ranks:
            return [self.ranks[data]]
        if len(data) > SHORT_PIECE:
            return PrefixTable(self, data).ids()
        last: list[int | None] = [-1] + [None] * len(data)
        ids, end = [], len(data)
        while end:
            token = last[end]
            if token is None:
                token = self._solve(data, last, end)
            ids.append(token)
            end -= len(self.tokens[token])
        return ids[::-1]

    def _solve(self, data: bytes, last: list[int | None], end: int) -> int:
        """``extend`` from the end: looks at shorter prefixes only where a token could begin."""
        get, known = self.ranks.get, self._follows.get
        for start in range(end):
            token = get(data[start:end])
            if token is not None:
                before = last[start]
                if before is None:
                    before = self._solve(data, last, start)
                fits = known((before, token))
                if fits is None:
                    fits = self.halves(token) is not None and (not start or self.follows(before, token))
                    self._follows[before, token] = fits
                if fits:
                    last[end] = token
                    return token
        raise ValueError(f"the vocabulary has no token for byte {data[end - 1]}")


class PrefixTable:
    """Last tokens of all prefixes of a piece of text that no pattern splits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact encoding of the longer piece; nothing before is computed again."""
        self.data += more
        self.vocabulary.extend(self.data, self.last, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start to stop; gives the number of prefixes computed again.

        After the edit, prefixes whose last tokens agree with the old ones
        over the length of the longest token agree for good.
        """
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last, agree, again = old[:start + 1], 0, 0
        for end in range(start + 1, len(self.data) + 1):
            if agree >= self.vocabulary.longest and end - start - len(new) > self.vocabulary.longest:
                self.last += old[end - shift:]
                break
            self.vocabulary.extend(self.data, self.last, end)
            again += 1
            agree = agree + 1 if end > start + len(new) and self.last[end] == old[end - shift] else 0
        return again

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        if whole is not None:  # a piece that is a token is that token
            return [whole]
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end])
            end -= len(self.vocabulary.tokens[self.last[end]])
        return found[::-1]


class _Pieces(dict):
    """Packed ids of pieces, worked out when first asked for; starts afresh when full, so its size is bounded."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.encode_piece(piece.encode()), "<u4").tobytes()
        if len(self) >= CACHED_PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class TextTable:
    """Encoding of a text that grows: pieces of the pattern, each with its prefix table."""

    REACH = 3  # characters after a piece that can change where it ends

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).finditer
        self.text, self.ends, self.tables = "", [], []
        self.append(text)

    def append(self, more: str) -> None:
        """Exact encoding of the longer text; pieces out of reach of its end stay, the open one is appended to."""
        before = len(self.text)
        self.text += more
        ends, tables = self.ends, self.tables
        keep = sum(end <= before - self.REACH for end in ends[-8:]) + max(0, len(ends) - 8)
        opened = tables[keep:keep + 1]
        del ends[keep:], tables[keep:]
        for match in self.find(self.text, ends[-1] if ends else 0):
            data = match[0].encode()
            if opened and data.startswith(opened[0].data):
                opened[0].append(data[len(opened[0].data):])
                tables.append(opened[0])
            else:
                tables.append(PrefixTable(self.vocabulary, data))
            opened = []
            ends.append(match.end())

    def ids(self) -> list[int]:
        return [i for table in self.tables for i in table.ids()]


def encoder(path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """A function from text to ids, with a bounded store of pieces it has seen."""
    pieces, find = _Pieces(Vocabulary.load(path)), regex.compile(pattern).findall
    return lambda text: np.frombuffer(b"".join([pieces[p] for p in find(text)]), "<u4")


def decoder(path: str) -> Callable[[np.ndarray], bytes]:
    tokens = Vocabulary.load(path).tokens
    return lambda ids: b"".join([tokens[i] for i in ids.tolist()])


def _once(make: Callable) -> Callable:
    """``make()``, run in the task at first use."""
    made: list = []
    return lambda: made[0] if made else (made.append(make()), made[0])[1]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of each whole text as an array; NULL and empty texts have none.

    ``path`` names the rank file, present on every executor; ``pattern``
    splits the text, and each match is encoded by itself. No special tokens.
    Rows are independent: nothing is shuffled, repeated rows get equal ids.
    """
    get = _once(lambda: encoder(path, pattern))

    @F.pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        run = get()
        return pd.Series([run(t).astype("i4") for t in texts], dtype=object)

    return docs.withColumn(out, ids_of(whole_text(text)))


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes of each array of ids; NULL gives no bytes, an id outside the vocabulary fails."""
    get = _once(lambda: decoder(path))

    @F.pandas_udf("binary")
    def bytes_of(arrays: pd.Series) -> pd.Series:
        run = get()
        return pd.Series([b"" if a is None else run(np.asarray(a)) for a in arrays], dtype=object)

    return tokens.withColumn(out, bytes_of(ids))
