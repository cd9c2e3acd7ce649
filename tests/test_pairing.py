"""Page pairing and greedy choice against plain rewrites that take all pairs in order."""

from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from lanewise.operators import revision, sequence
from lanewise.plans import match_plans


def plain_greedy(rows, order):
    left, right, out = set(), set(), []
    for r in sorted(rows, key=order, reverse=True):
        if r[0] not in left and r[1] not in right:
            left.add(r[0])
            right.add(r[1])
            out.append(r)
    return sorted(out)


@pytest.mark.parametrize("rounds, left_over", [(0, 100_000), (2, 5), (99, 0)])
def test_greedy(spark, monkeypatch, rounds, left_over):
    monkeypatch.setattr(sequence, "GREEDY_LEFT", left_over)
    rng = random.Random(rounds)
    rows = [(a, b, rng.randint(1, 4) / 4) for a in range(14) for b in range(14) if rng.random() < 0.6]
    got = sequence.greedy(spark.createDataFrame(rows, "a long, b long, s double"), [], "a", "b", [F.col("s"), -F.abs(F.col("a") - F.col("b"))], rounds)
    assert sorted(map(tuple, got.collect())) == plain_greedy(rows, lambda r: (r[2], -abs(r[0] - r[1]), r[0], r[1]))


def test_greedy_by_group(spark):
    rows = [(g, a, b, ((a * 7 + b * 3) % 5) / 4) for g in "xy" for a in range(6) for b in range(5)]
    got = sequence.greedy_pairs(spark.createDataFrame(rows, "g string, a long, b long, s double"), "g", "a", "b", "s", 0.5)
    want = [(g, *r) for g in "xy" for r in plain_greedy([r[1:] for r in rows if r[0] == g and r[3] >= 0.5], lambda r: (r[2], -r[0], -r[1]))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sequence.greedy_pairs(spark.createDataFrame([], "g string, a long, b long, s double"), "g", "a", "b", "s", 0.5).count() == 0


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a or b else 1.0


def plain_pairs(old, new):
    """``old``, ``new``: label and text of each page in order."""
    once = lambda pages: {x: k for k, (x, _) in enumerate(pages) if x and sum(y == x for y, _ in pages) == 1}
    a, b = once(old), once(new)
    out = [(a[x], b[x], ratio(old[a[x]][1], new[b[x]][1]), "label") for x in a if x in b and ratio(old[a[x]][1], new[b[x]][1]) >= 0.35]
    used = {r[0] for r in out}, {r[1] for r in out}
    rows = [(i, j, ratio(s, t)) for i, (_, s) in enumerate(old) for j, (_, t) in enumerate(new) if i not in used[0] and j not in used[1] and s and t]
    return sorted(out + [(*r, "content") for r in plain_greedy([r for r in rows if r[2] >= 0.72], lambda r: (r[2], -abs(r[0] - r[1]), r[0], r[1]))])


def edition(spark, pages):
    rows = [(k, x, t) for k, (x, t) in enumerate(pages)]
    return spark.createDataFrame(rows, "number long, label string, text string").withColumn("readings", F.expr("transform(sequence(1, length(text)), i -> '')"))


def test_pair(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("一二三四五六七八九十百千") for _ in range(rng.choice([1, 4, 9, 30, 40]))) for _ in range(18)]
    torn = lambda t: "".join(rng.choice("甲乙") if rng.random() < 0.15 else c for c in t)
    old = [("", t) for t in texts] + [("", "")] * 2 + [("7", ""), ("8", "天地玄黃"), ("9", "x"), ("9", "x")] + [("", "同同同")] * 3
    new = [("", torn(t)) for t in texts[::-1]] + [("", texts[0] + "尾")] + [("", "")] * 2 + [("7", ""), ("8", "宇宙洪荒"), ("9", "x")] + [("", "同同同")] * 4
    got = sorted(map(tuple, revision.pair(edition(spark, old), edition(spark, new)).collect()))
    assert got == plain_pairs(old, new)
    assert {r[3] for r in got} == {"label", "content"}


def test_pair_at_the_bound(spark):
    """No run of four characters is shared: 0.75 is found, 0.7 isn't; pages without text are left."""
    words = ["".join(chr(0x4E00 + 50 * k + i) for i in range(40)) for k in range(2)]
    cut3 = "".join(c if i % 4 else "々" for i, c in enumerate(words[0]))
    low = "".join(c if i % 10 < 7 else "々" for i, c in enumerate(words[1]))
    got = revision.pair(edition(spark, [("", words[0]), ("", words[1]), ("", "")]), edition(spark, [("", ""), ("", low), ("", cut3)]))
    assert [tuple(r) for r in got.collect()] == [(0, 2, 0.75, "content")]
    assert revision.pair(edition(spark, []), edition(spark, [("1", "x")])).count() == 0


def test_keys_of_short_texts_meet_only_where_they_must():
    """Twelve of a hundred characters: all close pairs have a common key, few others do."""
    rng = random.Random(9)
    letters = [chr(20_100 + k) for k in range(100)]
    old = ["".join(rng.choice(letters) for _ in range(12)) for _ in range(150)]
    new = ["".join(rng.choice(letters) if rng.random() < 0.15 else c for c in t if rng.random() > 0.08) for t in old]
    code = lambda t: sorted(ord(c) << 32 | t[:k].count(c) for k, c in enumerate(t))
    keys = [[set(revision._keys(code(t), sorted({len(x) for x in others}), 0.72, side)) for t in texts] for texts, others, side in ((old, new, True), (new, old, False))]
    close = [(i, j) for i, a in enumerate(old) for j, b in enumerate(new) if ratio(a, b) >= 0.72]
    assert len(close) > 50 and all(keys[0][i] & keys[1][j] for i, j in close)
    assert sum(bool(a & b) for a in keys[0] for b in keys[1]) < 2 * len(old)
    long = ["".join(rng.choice(letters) for _ in range(n)) for n in (22, 23, 26, 30)]
    keys = [[set(revision._keys(code(t), [22, 23, 26, 30], 0.72, side)) for t in long] for side in (True, False)]
    assert all(keys[0][i] & keys[1][i] for i in range(4))


def test_pages_of_one_text_are_not_multiplied(spark):
    """A thousand pages of one text on either side: a million pairs of pages, no table of them."""
    n = 1_000
    old = spark.range(n).select((F.col("id") * 3).alias("old_number"), F.lit(1).cast("long").alias("ia"))
    new = spark.range(n).select((F.col("id") * 3 + 1).alias("new_number"), (F.col("id") % 2).alias("ib"))
    links = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.8)], "ia long, ib long, score double")
    got = sorted(map(tuple, revision.nearest_greedy(old, new, links, 99).collect()))
    rows = [(3 * a, 3 * b + 1, 0.8 if b % 2 else 0.9) for a in range(60) for b in range(60)]
    few = revision.nearest_greedy(old.limit(60), new.filter("new_number < 180"), links, 99).collect()
    assert sorted(map(tuple, few)) == plain_greedy(rows, lambda r: (r[2], -abs(r[0] - r[1]), r[0], r[1]))
    assert len(got) == n and len({r[0] for r in got}) == n and len({r[1] for r in got}) == n


def test_scores_are_worked_out_once(spark, tmp_path, monkeypatch):
    """A filter on the score asks for no second worker; nulls count as empty texts."""
    rows = [("x", 1, 2, "abcd", "abxd"), ("x", 3, 4, None, None), ("y", 1, 2, "a", None), ("y", 3, 2, "ab", "cd")]
    pairs = spark.createDataFrame(rows, "grp string, left_id long, right_id long, a string, b string")
    got = sequence.scored_pairs(pairs, "a", "b", "score")
    assert got.columns == ["grp", "left_id", "right_id", "score"]
    assert sorted(map(tuple, got.collect())) == [(*r[:3], ratio(r[3] or "", r[4] or "")) for r in rows]
    workers = []
    monkeypatch.setattr(sequence, "cut", lambda df: workers.append(df._jdf.queryExecution().optimizedPlan().toString()) or df.limit(0))
    spark.createDataFrame([(k, turn, who, "text") for k in range(2) for turn, who in ((0, "user"), (1, "assistant"))], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    match_plans.greedy_page_pairing(spark, str(tmp_path))
    assert workers[0].count("EvalPython") + workers[0].count("MapInArrow") == 1


@pytest.mark.parametrize("rounds, left_over", [(0, 10_000), (2, 10_000), (99, 0)])
def test_nearest_greedy(spark, monkeypatch, rounds, left_over):
    """Texts of several pages, linked to several, with equal scores: by rounds, in one task and by both."""
    monkeypatch.setattr(revision, "NEAREST_LEFT", left_over)
    rng = random.Random(rounds)
    old, new = ([(k, rng.choice([0, 0, 0, *range(9)])) for k in rng.sample(range(90), 60)] for _ in "ab")
    links = [(a, b, rng.randint(3, 5) / 5) for a in range(9) for b in range(9) if rng.random() < 0.5]
    got = revision.nearest_greedy(spark.createDataFrame(old, "old_number long, ia long"), spark.createDataFrame(new, "new_number long, ib long"), spark.createDataFrame(links, "ia long, ib long, score double"), rounds)
    score = {(a, b): s for a, b, s in links}
    rows = [(o, n, score[a, b]) for o, a in old for n, b in new if (a, b) in score]
    assert sorted(map(tuple, got.collect())) == plain_greedy(rows, lambda r: (r[2], -abs(r[0] - r[1]), r[0], r[1]))


def test_a_text_of_many_pages_is_not_copied_for_each_link(spark, monkeypatch):
    """No window looks ahead to its end, which costs the square of a text's pages; 30 links of 600 pages carry 600 rows."""
    plans = []
    real = revision.cut
    monkeypatch.setattr(revision, "cut", lambda df: plans.append(df) or real(df))
    old = spark.range(600).select(F.col("id").alias("old_number"), F.lit(0).cast("long").alias("ia"))
    new = spark.range(600).select(F.col("id").alias("new_number"), (F.col("id") % 30).alias("ib"))
    links = spark.range(30).select(F.lit(0).cast("long").alias("ia"), F.col("id").alias("ib"), F.lit(0.9).alias("score"))
    got = revision.nearest_greedy(old, new, links, 1)
    assert sorted(map(tuple, got.collect())) == [(k, k, 0.9) for k in range(600)]
    looks = [p._jdf.queryExecution().optimizedPlan().toString().lower() for p in plans]
    assert any("windowspec" in p for p in looks) and not any("unboundedfollowing" in p for p in looks)
    tops = links.withColumns({"c_ask": F.lit(20), "c_offer": F.lit(600)})
    assert revision._asked(new, old, tops, "new_number", "ib", "old_number", "ia").count() == 1_200
    tops = links.withColumns({"c_ask": F.lit(600), "c_offer": F.lit(20)})
    assert revision._asked(old, new, tops, "old_number", "ia", "new_number", "ib").count() == 1_200


def test_close_texts(spark):
    """All close pairs of mixed lengths and few letters, and texts of the same characters in another order don't meet."""
    rng = random.Random(3)
    old = ["".join(rng.choice("甲乙丙丁戊己庚辛壬癸") for _ in range(rng.choice([1, 2, 3, 5, 8, 11, 12, 17, 23, 24, 25, 33]))) for _ in range(120)]
    new = ["".join(rng.choice("甲乙丙") if rng.random() < 0.12 else c for c in t if rng.random() > 0.08) for t in old]
    side = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r.a, r.b): r.score for r in revision.close_texts(side(old), side(new)).collect()}
    assert got == {(a, b): ratio(a, b) for a in old for b in new if a and b and ratio(a, b) >= 0.72}
    letters = [chr(20_100 + k) for k in range(12)]
    texts = ["".join(rng.sample(letters, 12)) for _ in range(100)]
    sides = [revision._numbered(side(t)) for t in (texts[:50], texts[50:])]
    assert revision._short_met(sides, [[12], [12]], 0.72).distinct().count() < 625  # of 2,500
    assert len(set(revision._keys(list(range(12)), [11, 12], 0.72, True))) == 56


def test_short_texts_are_scored_together():
    rng = random.Random(4)
    a = ["".join(rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    b = ["".join(rng.choice("abx") if rng.random() < 0.3 else c for c in t if rng.random() > 0.1) for t in a]
    assert revision._ratios(a, b).tolist() == [ratio(s, t) for s, t in zip(a, b, strict=True)]
