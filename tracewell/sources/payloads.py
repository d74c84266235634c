"""What the JSON payload readers share: strict parsing and refused rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.anyvalue import not_string

MALFORMED = "malformed"
WRONG_TYPE = "wrong_type"


class Decoded(NamedTuple):
    """Accepted rows and refused payloads of one read."""

    events: DataFrame
    rejects: DataFrame


def parse_wrapped(wrapped: Column, schema: str) -> Column:
    """Strict JSON parse of ``{"r": [...]}`` to ``struct<r, _corrupt_record>``.

    A container, integer, boolean or number of the wrong JSON type makes the
    parser itself report the record.
    """
    options = {
        "columnNameOfCorruptRecord": "_corrupt_record",
        "allowSingleQuotes": "false",
        "allowNonNumericNumbers": "false",
    }
    return F.from_json(wrapped, f"r array<struct<{schema}>>, _corrupt_record string", options)


def parse_request(body: Column, schema: str) -> Column:
    """Parse one object. It is read as the only element of a list, so that text
    after its closing brace is an error instead of being ignored."""
    return parse_wrapped(F.concat(F.lit('{"r":['), body, F.lit("]}")), schema)


def not_one_request(parsed: Column, body: Column) -> Column:
    return (
        parsed.isNull() | parsed["_corrupt_record"].isNotNull()
        | ((F.length(body) > 0) & (F.coalesce(F.size(parsed["r"]), F.lit(0)) != 1))
    )


def wrong_text(record: Column, names: tuple[str, ...]) -> Column:
    """True when one of the named variant leaves is neither string nor null."""
    bad = F.lit(False)
    for name in names:
        bad = bad | not_string(record[name])
    return bad
