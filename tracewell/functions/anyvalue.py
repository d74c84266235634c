"""OTLP typed values (string, int, bool, double, array, key-value list) to JSON.

Attributes are lists of ``{key, value}`` pairs. A list in which every value is
one well-typed scalar and no key repeats, the overwhelming case, is rewritten to
a JSON object by a regular expression over its canonical text. Any other list
(arrays and key-value lists of any depth, repeated keys, several fields at once,
wrong types) is left as ``ODD`` plus its text, and ``finish_odd`` converts those
of a whole payload in one Arrow batch. Both give JSON text; ``WRONG``, a control
character encoded JSON never contains, marks what must be refused.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tracewell.functions.expr import BIGINT_MAX, BIGINT_MIN, let
from tracewell.functions.scalars import short_float

ODD, WRONG = "\x00", "\x02"
# Possessive throughout: long texts are matched without backtracking or recursion.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_VALUE = (
    rf'\{{(?:"stringValue":({_STRING})|"intValue":"(0|-?[1-9][0-9]{{0,17}})"'
    r'|"boolValue":(true|false)|"doubleValue":(-?[0-9]++(?:\.[0-9]++)?+))\}'
)
_PAIR = rf'\{{"key":({_STRING}),"value":{_VALUE}\}}'
_SIMPLE_LIST = rf"\A\[(?:{_PAIR}(?:,{_PAIR})*+)?+\]\z"
# The same without groups and with numbers that are finite whatever their digits: nothing in such a list can be wrong.
_SAFE_PAIR = (
    rf'\{{"key":{_STRING},"value":\{{(?:"stringValue":{_STRING}|"intValue":"(?:0|-?[1-9][0-9]{{0,17}})"'
    r'|"boolValue":(?:true|false)|"doubleValue":-?[0-9]{1,300}+(?:\.[0-9]++)?+)\}\}'
)
_SAFE_LIST = rf"\A\[(?:{_SAFE_PAIR}(?:,{_SAFE_PAIR})*+)?+\]\z"


def kind(v: Column) -> Column:
    """JSON type name of a variant; ``VOID`` for null and for absent."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def not_string(v: Column) -> Column:
    return v.isNotNull() & ~kind(v).isin("STRING", "VOID")


def text_of(v: Column) -> Column:
    """Text of a string variant, empty when null or absent."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))


def _field(v: Column, path: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", as_type)


def list_text(attributes: Column) -> Column:
    """Canonical text of an attribute list (variant)."""
    return F.coalesce(F.to_json(attributes), F.lit("[]"))


def lone_value_text(v: Column) -> Column:
    """Canonical text of a list that holds a typed value under an empty key."""
    return F.concat(F.lit('[{"key":"","value":'), F.coalesce(F.to_json(v), F.lit("null")), F.lit("}]"))


def list_json(attributes: Column) -> Column:
    """Attribute list (variant) to JSON object text with sorted keys, or ``ODD`` and its text."""
    return _text_json(list_text(attributes))


def lone_value_json(v: Column) -> Column:
    """A typed value, checked like an attribute, under an empty key."""
    return _text_json(lone_value_text(v))


def doubtful(text: Column) -> Column:
    """``_text_json`` of a list's text where the text alone does not show that nothing in it is wrong; else NULL."""
    return let(text, lambda t: F.when(~t.rlike(_SAFE_LIST), _text_json(t)))


def _text_json(text: Column) -> Column:
    def convert(t: Column) -> Column:
        members = F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), _PAIR, "$1:$2$3$4$5")
        # A repeated key does not parse, which leaves the list to the odd ones.
        simple = F.when(t.rlike(_SIMPLE_LIST), F.to_json(F.try_parse_json(F.concat(F.lit("{"), members, F.lit("}")))))
        return F.coalesce(simple, F.concat(F.lit(ODD), t))

    return let(text, convert)


def odd_texts(texts: Column) -> Column:
    """The distinct odd ones of some texts."""
    return F.array_distinct(F.filter(texts, lambda t: t.startswith(ODD)))


def finished_json(text: Column, finished: Column) -> Column:
    """Replace an odd text by its JSON, from the map ``finished``."""
    return F.when(text.startswith(ODD), finished[text]).otherwise(text)


class _WrongType(ValueError):
    """A JSON value of another type than the field allows."""


def _get(node: dict, name: str, allowed: type | tuple[type, ...]):
    value = node.get(name)
    if value is not None and (type(value) not in (allowed if isinstance(allowed, tuple) else (allowed,))):
        raise _WrongType(name)
    return value


def _plain(node) -> object:
    """Typed value to a plain Python value; precedence as in the fast path."""
    if node is None:
        return None
    if type(node) is not dict:
        raise _WrongType("value")
    text, whole = _get(node, "stringValue", str), _get(node, "intValue", str)
    flag, number = _get(node, "boolValue", bool), _get(node, "doubleValue", (int, float))
    if number is not None and not math.isfinite(float(number)):
        raise _WrongType("doubleValue")
    array, pairs = _get(node, "arrayValue", dict), _get(node, "kvlistValue", dict)
    items = None if array is None else [_plain(x) for x in _get(array, "values", list) or []]
    members = None if pairs is None else dict(_plain_pair(p) for p in _get(pairs, "values", list) or [])
    if text is not None:
        return text
    if whole is not None:
        if not re.fullmatch(r"[+-]?[0-9]+", whole, re.ASCII):
            return 0
        digits = whole.lstrip("+-").lstrip("0")
        # decided by the number of digits where there are too many: a text of any length is no poison
        size = int(digits or "0") if len(digits) <= 19 else BIGINT_MAX + 1
        return max(-size, BIGINT_MIN) if whole[0] == "-" else min(size, BIGINT_MAX)
    for value in (flag, None if number is None else float(number), items, members):
        if value is not None:
            return value
    return None


def _plain_pair(pair) -> tuple[str, object]:
    if pair is None:
        return "", None
    if type(pair) is not dict:
        raise _WrongType("pair")
    return _get(pair, "key", str) or "", _plain(pair.get("value"))


def _finish_one(text: str) -> str:
    try:
        pairs = json.loads(text[len(ODD):])
        if pairs is not None and type(pairs) is not list:
            raise _WrongType("attributes")
        members = dict(_plain_pair(p) for p in pairs or [])
        return json.dumps(members, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    except Exception:  # whatever is wrong with one value refuses its payload and nothing else
        return WRONG


#: Payloads whose odd lists are Python objects at one time; a batch may hold thousands.
FINISHED_TOGETHER = 64


@F.arrow_udf(ArrayType(StringType()))
def _finish_list(texts: pa.Array) -> pa.Array:
    parts = [pa.array([[_finish_one(t) for t in row] for row in texts.slice(start, FINISHED_TOGETHER).to_pylist()], pa.list_(pa.string()))
             for start in range(0, len(texts), FINISHED_TOGETHER)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


# Keeps the optimizer from copying the call (and all below it) into a filter.
_finish_list = _finish_list.asNondeterministic()


def finish_odd(odd: Column) -> Column:
    """Odd texts to a map from each text to its JSON."""
    return F.map_from_arrays(odd, _finish_list(odd))


def any_wrong(odd: Column) -> Column:
    """Whether one of the odd texts must be refused."""
    return F.exists(_finish_list(odd), lambda t: t == WRONG)


def any_value(v: Column) -> Column:
    """Typed value to a variant; NULL when it is ill-typed."""
    text = lone_value_json(v)
    done = F.coalesce(F.get(_finish_list(odd_texts(F.array(text))), F.lit(0)), text)
    return F.try_variant_get(F.try_parse_json(F.nullif(done, F.lit(WRONG))), "$['']", "variant")


def any_string(v: Column) -> Column:
    """Typed value to text; composites and null give the empty string."""
    return F.coalesce(
        _field(v, "stringValue", "string"),
        _field(v, "intValue", "string"),
        _field(v, "boolValue", "boolean").cast("string"),
        short_float(_field(v, "doubleValue", "double")),
        F.lit(""),
    )


def service_name(attributes: Column) -> Column:
    """Text of the first ``service.name`` attribute, ``unknown`` without one."""
    items = F.try_variant_get(attributes, "$", "array<variant>")
    hits = F.filter(items, lambda x: _field(x, "key", "string") == "service.name")
    value = F.transform(hits, lambda x: any_string(_field(x, "value")))
    return F.coalesce(F.get(value, F.lit(0)), F.lit("unknown"))
