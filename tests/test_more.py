from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.functions import scalars
from lanewise.operators import keyed
from lanewise.plans import incremental


def test_plain_scalars(spark):
    def one(value, fn):
        return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("x")).first().x

    assert one("・ㄇ ㄚ（又）", scalars.comparator_reading) == "˙ㄇㄚ" and one("ㄅxㄚ", scalars.comparator_reading) == "" and one(None, scalars.comparator_reading) == ""
    assert one("ㄏㄜˊ　ㄕㄤˋ x", scalars.syllables) == ["ㄏㄜˊ", "ㄕㄤˋ"] and one(None, scalars.syllables) == []
    assert one("甲（乙、丙）、丁，，戊", scalars.outside_brackets) == ["甲（乙、丙）", "丁", "戊"]
    assert [one(v, scalars.page_token) for v in ("7.0", "7.5", " iv ", None)] == ["7", "7.5", "iv", ""]
    assert one("a, b　(c)", scalars.context_key) == "a，b（c）"
    assert [one(v, scalars.version_family) for v in ("5.6.1", "5", None)] == ["5.6", None, None]


def test_reuse(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "x")], "k string, v string")
    b = spark.createDataFrame([("1", "x"), ("2", "y"), ("4", "z")], "k string, v string")
    got = {r.k: (r.v, r.basis, r.status) for r in keyed.reuse([("high", a), ("low", b)], ["k"], "v", spark.createDataFrame([("3",)], "k string")).collect()}
    assert got == {"1": ("x", "high", "agreed"), "2": (None, None, "conflict"), "3": (None, None, "quarantined"), "4": ("z", "low", "agreed")}


def test_swap_if(spark):
    now = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 3, "x")], "k string, rev int, v string")
    updates = spark.createDataFrame([("a", 1, "y"), ("b", 1, "y"), ("c", 3, "y"), ("c", 3, "z"), ("d", 1, "y")], "k string, expected int, v string")
    table, refused = keyed.swap_if(now, updates, "k", "rev")
    assert sorted(tuple(r) for r in table.collect()) == [("a", 2, "y"), ("b", 2, "x"), ("c", 3, "x")]
    assert sorted(r.k for r in refused.collect()) == ["b", "c", "c", "d"]


def test_refresh_recomputes_changed_parts_only(spark, tmp_path):
    path = str(tmp_path)
    total = lambda df: df.groupBy("part").agg(F.sum("x").alias("s"), F.max("run").alias("run")).select("s", "run", "part")

    def run(rows, number, depends="v1"):
        df = spark.createDataFrame(rows, "part string, x int")
        done = incremental.refresh(df, "part", depends, lambda d: total(d.withColumn("run", F.lit(number))), path)
        return sorted(r.part for r in done.collect()), {r.part: (r.s, r.run) for r in spark.read.parquet(f"{path}/data").collect()}

    assert run([("a", 1), ("a", 2), ("b", 5)], 1) == (["a", "b"], {"a": (3, 1), "b": (5, 1)})
    assert run([("a", 2), ("a", 1), ("b", 5)], 2) == ([], {"a": (3, 1), "b": (5, 1)})
    assert run([("a", 1), ("a", 2), ("b", 6), ("c", 1)], 3) == (["b", "c"], {"a": (3, 1), "b": (6, 3), "c": (1, 3)})
    assert run([("a", 1), ("a", 2), ("b", 6), ("c", 1)], 4, "v2")[0] == ["a", "b", "c"]


def test_merge_with_provenance(spark):
    from lanewise.operators import reconcile

    events = spark.createDataFrame([("same", "x", None, []), ("known", "x", "a:2", ["b:2"]), ("other", "x", None, []), ("kept", None, "z", None)], "k string, payload string, origin string, others array<string>")
    source = spark.createDataFrame([("same", "x", "a:1"), ("known", "x", "a:2"), ("other", "y", "a:3"), ("new", None, "a:4")], "k string, payload string, identity string")
    none = spark.createDataFrame([], "k string, source_identity string, target_identity string, source_payload string, target_payload string")
    kept, clash, outcomes = reconcile.merge_source(events, source, none, "k")
    assert {r.k: (r.payload, r.origin, r.others) for r in kept.collect()} == {"same": ("x", None, ["a:1"]), "known": ("x", "a:2", ["b:2"]), "kept": (None, "z", []), "new": (None, "a:4", [])}
    assert [tuple(r) for r in clash.collect()] == [("other", "a:3", None, "y", "x")]
    assert {r.k: r.outcome for r in outcomes.collect()} == {"same": "duplicate", "known": "duplicate", "other": "conflict", "new": "import"}
    again, clash2, outcomes = reconcile.merge_source(kept, source, clash, "k")
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect())) and clash2.count() == 1
    assert {r.k: r.outcome for r in outcomes.collect()} == {"same": "duplicate", "known": "duplicate", "other": "replayed", "new": "duplicate"}
