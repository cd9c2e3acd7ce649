"""Strict JSON against the parser's own pairs, seals, and drift of rows on one side."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

from lanewise.operators import sealed


def written(rng, depth=0):
    kind = rng.choice("onals" if depth < 4 else "ns")
    if kind == "o":
        return "{" + ",".join(f"{json.dumps(rng.choice(['a', 'b', 'é', '}', ',', 'x:', '\"', chr(92), '']))} : {written(rng, depth + 1)}" for _ in range(rng.randint(0, 4))) + "}"
    if kind in "al":
        return "[" + " , ".join(written(rng, depth + 1) for _ in range(rng.randint(0, 3))) + "]"
    return rng.choice(["1", "null", "-2.5e3"]) if kind == "n" else json.dumps(rng.choice(["{", '"a": 1', "]", "\\\\", "é", ""]), ensure_ascii=rng.random() < 0.5)


def test_repeated_keys():
    rng = random.Random(3)
    seen = 0
    for _ in range(3_000):
        text = written(rng)
        want = Counter()
        json.loads(text, object_pairs_hook=lambda pairs: want.update({k: n - 1 for k, n in Counter(k for k, _ in pairs).items() if n > 1}))
        got = sealed.repeated_keys(text)
        assert Counter(k for _, k, _ in got) == want
        seen += len(got)
    assert seen > 300
    assert sealed.repeated_keys('{"a": [0, {"b": 1, "\\u0062": 2}], "a": {"c": {}, "c": []}}') == [("$.a[1]", "b", 3), ("$", "a", 1), ("$.a", "c", 2)]


def test_json_faults(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, None), (3, ""), (4, '{"a": 1, "a": 2}'), (5, "[" * 5_000), (6, '"a"'), (6, '{"x": 1,}')], "id int, doc string")
    got = sorted((r.id, r.fault, r.path or "", r.depth or 0) for r in sealed.json_faults(rows, "id", "doc").collect())
    assert got == [(2, "invalid", "", 0), (3, "invalid", "", 0), (4, "repeated_key", "$", 1), (5, "invalid", "", 0), (6, "invalid", "", 0)]


def test_seals(spark):
    body = {"b": [1, {"ü": None, "a": "漢"}], "a": "x y"}
    raw = json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    good = hashlib.sha256(raw.encode()).hexdigest()
    docs = {"good": json.dumps({sealed.SEAL: good, **body}, indent=2), "changed": json.dumps(body | {"a": "x  y", sealed.SEAL: good}), "bare": json.dumps(body), "list": "[1]", "null": None, "twice": json.dumps(body)[:-1] + ', "a": "x y"}'}
    got = {r.key: (r.fault, r.computed) for r in sealed.seal_faults(spark.createDataFrame([*docs.items()], "key string, doc string"), "key", "doc").collect()}
    assert {k: v[0] for k, v in got.items()} == {"changed": "changed", "bare": "missing_seal", "list": "invalid", "null": "invalid", "twice": "invalid"} and got["bare"][1] == good


def test_drift(spark):
    a = spark.createDataFrame([("k", "x", None), ("only", "x", "y"), ("same", None, "z")], "id string, f string, g string")
    b = spark.createDataFrame([("k", "y", "n"), ("new", "x", "y"), ("same", None, "z")], "id string, f string, g string")
    got = sorted(tuple(map(str, r)) for r in sealed.drift(a, b, "id", {"f": None, "g": None}).collect())
    assert got == [("k", "f", "x", "y"), ("k", "g", "None", "n"), ("new", "unknown", "None", "None"), ("only", "missing", "None", "None")]
    assert sealed.drift(a.filter("false"), b.filter("false"), "id", {"f": None}).count() == 0
