"""Deep redaction of secrets in JSON payload columns.

A value under a sensitive key is replaced whole, at any level. On the canonical
text of a document (compact, with minimal escapes) a scalar under such a key is
found by a regular expression, whatever its depth: one pass, in generated code.
Only a document with a list or an object under a sensitive key, or with an
escape in a key, is read token by token, to any depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import REDACTED, SENSITIVE_PATTERNS, is_sensitive

# An escape pair followed by the end of a key. A quote before a colon ends a key:
# inside a text value it would be escaped.
_ESCAPE_IN_KEY = r'\\.[^"\\]*":'
# Possessive, so that a long text is matched without backtracking or recursion.
_SCALAR = r'(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^,\]\[{}"]+)'


def _any_of(patterns: Sequence[str]) -> str:
    return "|".join(re.escape(p.lower()) for p in patterns)


def _replace_members(text: Column, patterns: Sequence[str]) -> Column:
    """Replace scalars under sensitive keys in canonical JSON text.

    A key is matched from the sensitive word on, and the word by its first
    letter first. Before a container the marker is put in front of the bracket:
    text followed by a bracket is no JSON, so that is easily told.
    """
    first = "".join(sorted({re.escape(p[0].lower()) + re.escape(p[0].upper()) for p in patterns}))
    member = rf'(?=[{first}])((?i:{_any_of(patterns)})[^"\\]*+":)(?:{_SCALAR}|(?=[\[{{]))'
    return F.regexp_replace(text, member, f'$1"{REDACTED}"')


_TEXT = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"')
_TEXT_OR_BRACKET = re.compile(_TEXT.pattern + r"|[\[\]{}]")
_WORD = re.compile(r"[^,\]}]*")


def _value_end(text: str, start: int) -> int:
    """Where the value that starts at ``start`` of canonical JSON ends."""
    if text[start] == '"':
        return _TEXT.match(text, start).end()
    if text[start] not in "{[":
        return _WORD.match(text, start).end()
    depth = 0
    for token in _TEXT_OR_BRACKET.finditer(text, start):
        depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(token[0], 0)
        if depth == 0:
            return token.end()
    return len(text)


def _redact_tokens(text: str, sensitive: re.Pattern) -> str:
    """Replace the values under sensitive keys of canonical JSON text, at any depth, in one pass.

    A text followed by a colon is a key.
    """
    out, kept, at = [], 0, 0
    while (found := _TEXT.search(text, at)) is not None:
        at = found.end()
        if text[at:at + 1] != ":":
            continue
        key = json.loads(found[0]) if "\\" in found[0] else found[0][1:-1]
        if sensitive.search(key.lower()):
            out.append(text[kept:at + 1] + f'"{REDACTED}"')
            kept = at = _value_end(text, at + 1)
    return "".join(out) + text[kept:]


def with_redacted(df: DataFrame, columns: dict[str, str], patterns: Sequence[str] = SENSITIVE_PATTERNS) -> DataFrame:
    """Add redacted JSON text of variant columns, ``{new name: variant column}``.

    NULL and JSON null give ``{}``. The steps are columns of their own, so that
    each is computed once.
    """
    sensitive = re.compile(_any_of(patterns))

    @F.pandas_udf("string")
    def walked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _redact_tokens(t, sensitive))

    text = {n: F.col(f"_text_{n}") for n in columns}
    swapped = {n: F.col(f"_swapped_{n}") for n in columns}
    df = df.withColumns({f"_text_{n}": F.to_json(v) for n, v in columns.items()})
    df = df.withColumns({f"_swapped_{n}": F.when(
        is_sensitive(text[n], patterns), _replace_members(text[n], patterns)) for n in columns})

    def needs_walk(n: str) -> Column:
        # The Kelvin sign is the one other letter that lower-cases to an ASCII one.
        return swapped[n].isNotNull() & (
            swapped[n].contains(f'"{REDACTED}"{{') | swapped[n].contains(f'"{REDACTED}"[')
            | text[n].contains("\u212a") | (text[n].contains("\\") & text[n].rlike(_ESCAPE_IN_KEY)))

    # only the documents that need it cross over; the others are NULL there
    df = df.withColumns({f"_walked_{n}": walked(F.when(needs_walk(n), text[n])) for n in columns})

    def choose(n: str) -> Column:
        return (F.when(text[n].isNull() | (text[n] == "null"), "{}").when(swapped[n].isNull(), text[n])
                .otherwise(F.coalesce(F.col(f"_walked_{n}"), swapped[n])))

    helpers = [f"_{kind}_{n}" for n in columns for kind in ("text", "swapped", "walked")]
    return df.withColumns({n: choose(n) for n in columns}).drop(*helpers)


def redact_json(df: DataFrame, cols: Sequence[str], patterns: Sequence[str] = SENSITIVE_PATTERNS) -> DataFrame:
    """Redact JSON text columns of an event table. Text that is not JSON is replaced whole."""
    parsed = df.withColumns({f"_parsed_{c}": F.try_parse_json(F.col(c)) for c in cols})
    done = with_redacted(parsed, {f"_done_{c}": f"_parsed_{c}" for c in cols}, patterns)

    def clean(c: str) -> Column:
        unreadable = F.col(c).isNotNull() & F.col(f"_parsed_{c}").isNull()
        return F.when(unreadable, F.lit(f'"{REDACTED}"')).otherwise(F.col(f"_done_{c}"))

    return done.select(*[clean(c).alias(c) if c in cols else F.col(c) for c in df.columns])
