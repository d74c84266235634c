import json
import random

from tracewell.functions.redaction import redact_json
from tracewell.functions.scalars import REDACTED, SENSITIVE_PATTERNS


def expected(v):
    if isinstance(v, dict):
        return {k: REDACTED if any(p in k.lower() for p in SENSITIVE_PATTERNS) else expected(x) for k, x in v.items()}
    if isinstance(v, list):
        return [expected(x) for x in v]
    return v


def redact(spark, docs, **options):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string")
    return [r.doc for r in redact_json(df, ["doc"], **options).orderBy("i").collect()]


SPELLINGS = (str.lower, str.upper, lambda p: f"x{p.title()}9", lambda p: f"{p}\\", lambda p: f'q"{p}', lambda p: p.replace("s", "\u017f"))
VALUES = ("p", 'say "token": 5', "a\\\"b", "q" * 20000, -1.5e10, True, None, [1, {"b": 2}], {"deep": {"er": [[], {}]}}, [], {})


def test_every_pattern_and_kind_of_value(spark):
    """Each pattern in each spelling over each kind of value, beside a plain member, at the top and within lists and objects."""
    docs = []
    for pattern in SENSITIVE_PATTERNS:
        for k, spell in enumerate(SPELLINGS):
            for value in VALUES[k % 2::2]:
                member = {spell(pattern): value, "plain\u2028": [pattern, value]}
                docs.append([member, {"o": member}, {"l": [[member], "x", member]}][len(docs) % 3])
    assert len(docs) > 200
    got = redact(spark, [json.dumps(d) for d in docs])
    assert [json.loads(g) for g in got] == [expected(d) for d in docs]


def test_random_documents(spark):
    rng = random.Random(7)
    keys = ["a", "token", "x y", "Auth-z", 'q"', "b\\", "n\n", "api_key", "é", "pwd\\", 'secret"s', ":{", "true"]

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.35:
            return {rng.choice(keys): value(depth - 1) for _ in range(rng.randint(0, 4))}
        if depth and kind < 0.5:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice(["t", 'a":"token":{', "\\", "", 1, -2.5, True, None, "token", '"', "[REDACTED]"])

    docs = [{rng.choice(keys): value(5) for _ in range(4)} for _ in range(400)]
    got = redact(spark, [json.dumps(d) for d in docs])
    assert [json.loads(g) for g in got] == [expected(d) for d in docs]


def test_null_and_unreadable(spark):
    assert redact(spark, [None, "null", "{broken", "[1]"]) == ["{}", "{}", f'"{REDACTED}"', "[1]"]


def test_any_depth(spark):
    def nest(levels, inner):
        return '{"a":' * levels + inner + "}" * levels

    docs = [nest(n, inner) for n in (10, 60) for inner in (
        '{"password":"p","b":[1]}', '{"note":"keep me"}', '{"note":"keep me","x":[{"token":{"x":[{"y":1}]},"z":2},3]}')]
    docs += ['{"note":"' + "v" * 50_000 + '","token":[[],{"a":"]}"},"}"],"k":{"secret":{}}}', '{"token":[]}', '{"a":[{"token":-1}],"b":{"token":null}}']
    got = redact(spark, docs)
    assert [json.loads(g) for g in got] == [expected(json.loads(d)) for d in docs]
    assert sum("keep me" in g for g in got) == 4


def test_own_patterns(spark):
    assert redact(spark, ['{"name":"x","token":"y"}'], patterns=["name"]) == ['{"name":"[REDACTED]","token":"y"}']
