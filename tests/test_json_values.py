"""The JSON lexer against Python's parser."""

import json
import random

from decisa.operators.json_values import pointer, truthy, values
from pyspark.sql import functions as F


def strict(text):
    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def constant(name):
        raise ValueError(name)

    value = json.loads(text, object_pairs_hook=once, parse_constant=constant)
    json.dumps(value, allow_nan=False, ensure_ascii=False).encode()
    return value


TEXTS = [
    '{"a": [1, {"b":"x\\ny"}, []], "é~/k": -0.0 , "z":{"q":{}}}', " [ ] ", "3", '"s"', '{"a":1}}', '{"a":1} 2', '[1] "b"', '{"a":1,"a":2}', '{"a":1,"\\u0061":2}', "[NaN]", "Infinity", '["\\ud800"]', '["\\udc00\\ud800"]', '["\\ud83d\\ude00"]',
    '["\\\\ud800"]', "", " ", "[1e400]", '{"a":[[[[[[[[1]]]]]]]]}', '{"a":"x', '["a\tb"]', "[01]", "[1.]", "[.5]", "[-]", "[1,]", ",", ":", "[1 2]", '{"a" 1}', "nul", " ,", " :1", '["\\q"]', "[1E-7,1e+07,-12.50]", '{"":{"":""}}', '{"a":"}]{[,:"}', "[true,false,null]", "\ufeff[]", "[\u00a01]", '"a" "b"', "{}{}",
]


def at(value, path):
    for step in path:
        value = value[int(step)] if isinstance(value, list) else value[step]
    return value


def nested(value, path=()):
    yield path, value
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from nested(v, (*path, str(k)))


def test_values_are_those_of_a_strict_parser(spark):
    rng = random.Random(3)

    def anything(depth):
        pick = rng.randrange(7 if depth else 5)
        leaves = [None, True, rng.randrange(-9, 99), rng.random(), "".join(rng.choices('a"\\é\n😀/~{[,:', k=rng.randrange(6)))]
        return leaves[pick] if pick < 5 else [anything(depth - 1) for _ in range(rng.randrange(4))] if pick == 5 else {"".join(rng.choices('kq"/~é', k=3)): anything(depth - 1) for _ in range(rng.randrange(4))}

    texts = TEXTS + [json.dumps(anything(5), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(150)]
    texts += [t[: rng.randrange(len(t))] for t in texts[-40:]]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, raw string")
    got = {}
    for r in values(df, "raw", 4).select("*", pointer(F.col("path")).alias("pointer"), truthy(F.col("kind"), F.col("token"), F.col("empty")).alias("true")).collect():
        got.setdefault(r["i"], []).append(r)
    assert sorted(got) == list(range(-1, len(texts))) and not any(r["_valid"] for r in got[-1])
    for i, text in enumerate(texts):
        try:
            value = strict(text)
        except ValueError:
            assert not any(r["_valid"] for r in got[i]), text
            continue
        assert all(r["_valid"] for r in got[i]), text
        want = {p: v for p, v in nested(value) if len(p) <= 4}
        assert {tuple(r["path"]) for r in got[i]} == set(want) and len(got[i]) == len(want)
        for r in got[i]:
            v = want[tuple(r["path"])]
            assert json.loads(text.encode()[r["start"] : r["stop"]]) == v and bool(v) == r["true"]
            assert r["pointer"] == "".join("/" + p.replace("~", "~0").replace("/", "~1") for p in r["path"])
            assert r["kind"] == {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
