from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lanewise.functions import scalars
from lanewise.operators import keyed, matching, reconcile, sequence
from lanewise.sources import assets
from lanewise.streaming import outbox


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("ㄐㄩㄝˊ", "ㄐㄩㄝˊ"),
        ("ˊㄐㄩㄝ", "ㄐㄩㄝˊ"),
        ("ㄇㄟ˙", "˙ㄇㄟ"),
        ("・ㄇㄟ", "˙ㄇㄟ"),
        ("ㄌㄧㄤˋˋ", "ㄌㄧㄤˋ"),
        ("ㄉㄧㄢˇㄦ", "ㄉㄧㄢˇㄦ"),
        ("ㄉㄧㄢㄦˇ", "ㄉㄧㄢˇㄦ"),
        ("ㄦˊ", "ㄦˊ"),
        ("ㄏㄜˊㄕㄤˋ", "ㄏㄜˊㄕㄤˋ"),
        ("一ˊ", "ㄧˊ"),
        ("ㄅ （又）ㄚ", "ㄅㄚ"),
        ("ㄅˊㄚ", ""),
        ("ㄅㄚˊˋ", ""),
        ("abc", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_canonical_reading(given, wanted):
    assert scalars.canonical_reading(given) == wanted


def test_scalars(spark):
    df = spark.createDataFrame([("10.1255", "ㄅ；ㄆ|ㄅ; "), ("2", ""), ("x", None)], "n string, s string")
    rows = df.select(scalars.canonical_number(F.expr("try_cast(n AS decimal(38,6))")).alias("n"), scalars.value_set(F.col("s")).alias("s")).collect()
    assert [tuple(r) for r in rows] == [("10.126", "ㄅ|ㄆ"), ("2", ""), (None, None)]
    tones = spark.createDataFrame([("ㄅㄚˊ",), ("˙ㄇㄟ",), ("ㄅㄚ",), ("ㄅㄚˊ|ㄅㄚˋ",), ("",)], "r string")
    assert [r[0] for r in tones.select(scalars.tone_class(F.col("r"))).collect()] == [2, 5, 1, None, None]
    made = spark.range(1).select(scalars.occurrence_id(b=F.lit("x"), a=F.lit(None).cast("string")).alias("o")).first().o
    import hashlib

    assert made == "occ_" + hashlib.sha256(b'{"a":null,"b":"x"}').hexdigest()


def test_unanimous_abstains(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None)], "k int, v string")
    got = {r.k: (r.resolved, r.conflict, r.n) for r in keyed.unanimous(df, ["k"], "v").collect()}
    assert got == {1: ("a", False, 2), 2: (None, True, 2), 3: (None, False, 1)}
    assert [tuple(r) for r in keyed.conflicts(df, ["k"], "v").collect()] == [(2, "a|b")]


def test_first_hit_stops_at_a_conflict(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    upper = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y")], "k int, v string")
    lower = spark.createDataFrame([(2, "z"), (3, "z")], "k int, v string")
    got = {r.k: (r.out, r.basis) for r in keyed.first_hit(df, [("a", upper, ["k"], "v"), ("b", lower, ["k"], "v")], "out").collect()}
    assert got == {1: ("x", "a"), 2: (None, "a:conflict"), 3: ("z", "b")}


def test_band_join_edges(spark):
    left = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, -5.0)], "a int, x double").withColumn("k", F.lit(1))
    right = spark.createDataFrame([(7, 5.0), (8, 15.0)], "b int, y double").withColumn("k", F.lit(1))
    got = sorted((r.a, r.b) for r in matching.band_join(left, right, ["k"], "x", "y", 5).collect())
    assert got == [(1, 7), (2, 7), (2, 8)]
    assert [r.a for r in matching.band_join(left, right, ["k"], "x", "y", 5, "left_anti").collect()] == [3]


def test_nearest_join_crosses_empty_cells(spark):
    left = spark.createDataFrame([(1, "g", 0.0), (2, "g", 1000.0), (3, "h", 1.0)], "a int, k string, x double")
    right = spark.createDataFrame([(5, "g", 400.0), (4, "g", -400.0), (6, "g", 990.0), (9, "g", 1010.0)], "b int, k string, y double")
    got = sorted((r.a, r.b, r.distance) for r in matching.nearest_join(left, right, "k", "x", "y", "b", 7).collect())
    assert got == [(1, 4, 400.0), (2, 6, 10.0)]


def test_contain_join_block_by_block(spark):
    texts = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "nothing thing"), (3, None), (4, ""), (2, "nothing thing")], "i int, t string")
    phrases = spark.createDataFrame([(1, "quick brown fox"), (2, "thing"), (3, "thing"), (4, ""), (5, None), (6, "ing t")], "p int, phrase string")
    wanted = [(1, 1), (2, 2), (2, 2), (2, 3), (2, 3), (2, 6), (2, 6)]
    for most in (1 << 20, 6):
        assert sorted((r.i, r.p) for r in matching.contain_join(texts, "t", phrases, "phrase", most).collect()) == wanted
    assert matching.contain_join(texts, "t", phrases.limit(0), "phrase").count() == 0


def test_ratio_is_that_of_difflib(monkeypatch):
    import difflib
    import random

    rng = random.Random(3)
    for k in range(600):
        letters = rng.choice(["ab", "abcd", "abcdefghij \u00e9\u4e2d\U0001f642"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, rng.choice([1, 8, 60])))) for _ in "ab")
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a or b else 1.0
        assert sequence.ratio(a, b) == want
        assert 2 * sequence.matched(a, b, cells=0) == round(want * (len(a) + len(b))) or not (a or b)
    assert sequence.ratio(None, "") == 1.0 and sequence.ratio(None, "x") == 0.0


def test_reconcile_and_merge(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted(tuple(r) for r in reconcile.reconcile(a, b, "k").collect()) == [(1, 2, 0, "left_only"), (2, 1, 1, "both"), (3, 0, 1, "right_only")]
    ours = spark.createDataFrame([(1, "x"), (2, "x")], "k int, v string")
    theirs = spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string")
    assert sorted(tuple(r) for r in reconcile.merge_decisions(ours, theirs, "k", "v").collect()) == [(1, "x", "keep"), (2, None, "conflict"), (3, "z", "import")]


def test_overlap_groups_and_ratio(spark):
    df = spark.createDataFrame([(1, 0, 5, 1), (1, 4, 9, 2), (1, 10, 11, 3)], "k int, lo int, hi int, i int")
    assert [r.c for r in sequence.overlap_groups(df, ["k"], "lo", "hi", "i", "c").orderBy("i").collect()] == [1, 1, 3]
    assert sequence.ratio("", None) == 1.0 and sequence.ratio("ab", "") == 0.0


def test_asset_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿k,v,pdf_contains\n1,x,\n1,y,book\n,z,other\n", encoding="utf-8")
    spec = assets.AssetSpec("a", ["k", "v"], ["k"], least_rows=5, required=["k"])
    df = assets.read_csv(spark, str(tmp_path / "a.csv"), spec)
    assert {(r.violation, r.n) for r in assets.violations(df, spec).collect()} == {("row_count", 3), ("blank_cell", 1), ("conflicting_key", 2), ("blank_key", 1)}
    assert [r.v for r in assets.in_scope(df, "my book 1").orderBy("v").collect()] == ["x", "y"]
    with pytest.raises(ValueError, match="missing columns"):
        assets.read_csv(spark, str(tmp_path / "a.csv"), assets.AssetSpec("a", ["nope"]))


def test_outbox_delivers_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    first = [("a", "1", "p"), ("a", "1", "p"), ("b", "1", "q"), ("c", "1", "r"), ("c", "2", "s")]
    spark.createDataFrame(first, outbox.SCHEMA).coalesce(1).write.mode("append").parquet(source)
    outbox.deliver(spark, source, target, mark).awaitTermination()
    spark.createDataFrame([("a", "1", "p"), ("b", "9", "q"), ("d", "1", "t")], outbox.SCHEMA).coalesce(1).write.mode("append").parquet(source)
    outbox.deliver(spark, source, target, mark).awaitTermination()
    done = sorted((r.intent_id, r.digest) for r in spark.read.parquet(f"{target}/receipts").collect())
    clash = sorted((r.intent_id, r.digest) for r in spark.read.parquet(f"{target}/conflicts").collect())
    assert done == [("a", "1"), ("b", "1"), ("d", "1")]
    assert clash == [("b", "9"), ("c", "1"), ("c", "2")]
