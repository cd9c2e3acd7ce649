"""The least differing pair of each key against all pairs, and in one shuffle."""

from __future__ import annotations

import itertools
import random

from lanewise.operators import keyed


def test_first_differing_pair(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abcdefgh"), rng.randint(1, 9), *(rng.choice([1.0, 2.0, float("nan")]) for _ in range(3))) for _ in range(150)]
    rows += [("z", 1, 1.0, 1.0, 1.0), ("z", 2, 1.0, 2.0, 2.0), ("y", 5, 1.0, 1.0, 1.0), ("y", 5, 2.0, 2.0, 2.0), ("y", 7, 1.0, 3.0, 3.0), ("x", 1, None, 1.0, 1.0)]
    rows += [("w", k, float(k), 0.5 if k in (0, 20_500) else k + 1.0, 1.0 * k) for k in range(21_000)] + [("v", k, 1.0, 1.0, 1.0) for k in range(20_000)]
    want = {}
    for key in "abcdefghzy":
        own = [(m, tuple(map(str, v))) for k, m, *v in rows if k == key]
        pairs = [(a, b) for (a, x), (b, y) in itertools.product(own, own) if a < b and all(p != q for p, q in zip(x, y, strict=True))]
        if pairs:
            want[key] = min(pairs)
    df = spark.createDataFrame(rows, "k string, m long, x double, y double, z double")
    found = keyed.first_differing_pair(df, ["k"], "m", ["x", "y", "z"])
    assert {r.k: (r.first_id, r.second_id) for r in found.collect()} == want | {"w": (0, 1)}
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()  # no shuffle but the one by key
