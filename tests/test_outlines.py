"""Signatures, groups at the borders of their rules, and readings against all partitions listed."""

from __future__ import annotations

import hashlib
import itertools
import random

import pyarrow as pa
import pytest

from lanewise.operators import outlines

CONTOURS = "contours array<array<struct<x: int, y: int, on: int>>>"


def plain_cycle(seq):
    return min(tuple(d[k:] + d[:k]) for d in (list(seq), list(seq)[::-1]) for k in range(len(d)))


def test_least_rotation():
    rng = random.Random(1)
    for n in range(1, 9):
        for _ in range(60):
            seq = [rng.randint(0, 2) for _ in range(n)]
            assert outlines.least_rotation(seq) == min(seq[k:] + seq[:k] for k in range(n))
    long = [0, 1] * 20_000 + [0]
    assert outlines.least_rotation(long)[:3] == [0, 0, 1]


def box(y0, y1, x0=0, x1=40):
    return [(x0, y0, 1), (x1, y0, 1), (x1, y1, 1), (x0, y1, 1)]


def test_signatures(spark):
    rng = random.Random(2)
    rows = []
    for k in range(30):
        group = [[(rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, 1)) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 3))]
        turned = [[(x + 7, y - 5, on) for x, y, on in (c[j:] + c[:j])[:: rng.choice([1, -1])]] for c in group[::-1] for j in [rng.randrange(len(c))]]
        rows += [(2 * k, group), (2 * k + 1, turned)]
    got = {r.key: r.s for r in spark.createDataFrame(rows, f"key int, {CONTOURS}").select("key", outlines.signature("contours").alias("s")).collect()}
    for key, group in rows:
        x, y = min(p[0] for c in group for p in c), min(p[1] for c in group for p in c)
        cycles = tuple(sorted(plain_cycle([(a - x, b - y, on) for a, b, on in c]) for c in group))
        payload = (max(p[0] for c in group for p in c) - x, max(p[1] for c in group for p in c) - y, cycles)
        assert got[key] == hashlib.sha1(repr(payload).encode()).hexdigest()
    assert all(got[2 * k] == got[2 * k + 1] for k in range(30)) and len(set(got.values())) > 20
    empty = spark.createDataFrame([(None,), ([],), ([[]],)], CONTOURS).select(outlines.signature("contours").alias("s"))
    assert [r.s for r in empty.collect()] == ["", "", ""]
    drawn = [[("moveTo", [(1.5, 2.0)]), ("lineTo", [(4.0, 6.12345)]), ("closePath", [])]]
    df = spark.createDataFrame([(drawn,), ([[(op, [(x + 3, y - 1) for x, y in ps]) for op, ps in c] for c in drawn],)], "g array<array<struct<op: string, points: array<struct<x: double, y: double>>>>>")
    want = repr(((("moveTo", ((0.0, 0.0),)), ("lineTo", ((2.5, 4.123),)), ("closePath", ())),))
    assert {r.s for r in df.select(outlines.relative_signature("g").alias("s")).collect()} == {hashlib.sha1(want.encode()).hexdigest()}


def grouped(spark, contours, how):
    df = spark.createDataFrame([(contours,)], CONTOURS)
    return [list(m) for m in df.select(how.alias("g")).first().g]


@pytest.mark.parametrize(
    "boxes, want",
    [
        ([box(0, 40), box(35, 75)], [[1], [0]]),  # an overlap of 5 isn't more than 5
        ([box(0, 40), box(34, 74)], [[1], [0]]),  # 6 is just 0.15 of 40
        ([box(0, 40), box(33, 73)], [[1, 0]]),
        ([box(0, 100), box(85, 185)], [[1], [0]]),
        ([box(0, 100), box(84, 184)], [[1, 0]]),
        ([box(0, 100), box(95, 105), box(104, 204)], [[2], [1], [0]]),
        ([box(90, 200), box(50, 100), box(0, 60)], [[0, 1, 2]]),  # the grown group takes the third
        ([[], box(0, 10)], [[1]]),
    ],
)
def test_stacks(spark, boxes, want):
    assert grouped(spark, boxes, outlines.stacks("contours")) == want


@pytest.mark.parametrize(
    "boxes, want",
    [
        ([box(0, 100), box(55, 155)], [[1, 0]]),  # 45 of 100
        ([box(0, 100), box(56, 156)], [[1], [0]]),
        ([box(0, 100), box(22, 122)], [[1, 0]]),
        ([box(0, 2), box(0, 100)], [[1, 0]]),
        ([box(50, 50), box(28, 28)], [[0], [1]]),
        ([box(0, 40), box(60, 100), box(20, 80)], [[1, 2, 0]]),
    ],
)
def test_bands(spark, boxes, want):
    assert grouped(spark, boxes, outlines.bands("contours")) == want


def test_tone_side(spark):
    rows = [([box(0, 10), box(0, 10, 320, 341)],), ([box(0, 10), box(0, 10, 320, 340)],), ([box(0, 9, 400, 410), box(0, 9, 500, 510)],), ([],)]
    df = spark.createDataFrame(rows, CONTOURS)
    assert [r.t for r in df.select(outlines.tone_contour("contours").alias("t")).collect()] == [1, None, None, None]


def test_readings_of_all_partitions(spark):
    """The recurrence finds exactly the sequences with one reading, with labels that join to the same text."""
    rng = random.Random(9)
    segments, ends, want = [], [], {}
    for key in range(120):
        n, first = rng.randint(1, 8), rng.randint(0, 1)
        labels = {(i, j): rng.choice(["a", "b", "ab", "aa"]) for i in range(n + 1) for j in range(i + 1, n + 1) if rng.random() < 0.4}
        segments += [(key, i, j, x) for (i, j), x in labels.items()]
        ends.append((key, first, n))
        found = set()
        for parts in range(1, 4):
            for cuts in itertools.combinations(range(first + 1, n), parts - 1):
                at = [first, *cuts, n]
                pieces = [labels.get(p) for p in zip(at, at[1:], strict=False)]
                if first < n and all(pieces):
                    found.add("".join(pieces))
        if found:
            want[key] = (min(found), max(found)) if len(found) == 1 else "several"
    got = outlines.one_reading(spark.createDataFrame(segments, "key int, i int, j int, label string"), spark.createDataFrame(ends, "key int, first int, n int"))
    assert {r.key: (r["least"], r["greatest"]) if r["least"] == r["greatest"] else "several" for r in got.collect()} == want
    assert "several" in want.values() and len(want) > 40


def test_recombine(spark):
    a, b, c = [(0, 0, 1), (30, 0, 1), (15, 20, 1)], box(0, 20), [(0, 0, 1), (30, 5, 0), (30, 25, 1), (5, 20, 1)]
    at = lambda s, y, x=0: [(px + x, py + y, on) for px, py, on in s]
    named = [("symbol", [a], "ㄅ", 2, False), ("symbol", [c], "ㄆ", 1, True), ("symbol", [at(a, 60), b], "ㄑ", 2, False), ("tone", [a], "3", 2, False), ("neutral", [b], "neutral", 5, False), ("symbol", [at(c, 60), a], "ㄎ", 1, False), ("symbol", [at(b, 60), b], "x", 2, False), ("symbol", [at(b, 60), b], "y", 2, False)]
    templates = spark.createDataFrame(named, f"kind string, {CONTOURS}, label string, support_keys int, direct boolean").withColumn("outline_signature", outlines.signature("contours"))
    rows = {
        "direct": [at(a, 200), at(c, 100)],
        "tone": [at(a, 200), at(a, 200, 400)],
        "neutral": [at(b, 300), at(a, 200)],
        "joined": [at(a, 160), at(b, 100)],
        "unknown": [at(c, 160), at(b, 100)],
        "bare": [at(b, 100)],
        "both": [at(b, 300), at(a, 200), at(a, 200, 400)],
        "odd tone": [at(a, 200), at(c, 200, 400)],
        "empty": [],
        "many": [at(a, 100 * k) for k in range(9)],
        "conflict": [at(c, 300), at(b, 160), at(b, 100)],
    }
    got = outlines.recombine(spark.createDataFrame([*rows.items()], f"key string, {CONTOURS}"), templates)
    assert {r.key: (r.reading, r.reason, r.mode) for r in got.collect()} == {
        "direct": ("ㄅㄆ", "ok", "direct_bands"), "tone": ("ㄅˇ", "ok", "direct_bands"), "neutral": ("˙ㄅ", "ok", "direct_bands"), "joined": ("ㄑ", "ok", "partitioned_bands"),
        "unknown": (None, "partition_unknown_symbol", None), "bare": (None, "neutral_without_base", None), "both": (None, "neutral_plus_right_tone", None), "odd tone": (None, "unknown_tone_signature", None),
        "empty": (None, "no_symbol_groups", None), "many": (None, "partition_bad_group_count", None), "conflict": (None, "partition_unknown_symbol", None),
    }
    assert outlines.recombine(spark.createDataFrame([], f"key string, {CONTOURS}"), templates).count() == 0


def test_equal_groups_are_worked_out_once(spark, monkeypatch):
    """Six hundred glyphs of three shapes, wherever they lie: three are worked out, all have the plain signature."""
    shapes = [[[(0, 0, 1), (40, 0, 1), (20, 40, 0)]], [[(0, 0, 1), (9, 0, 1)], [], [(5, 5, 1)]], [[(0, 0, 1), (40, 0, 1), (20, 40, 0)], [(3, 7, 1)]]]
    groups = [[[(x + 7 * k, y - 3 * k, on) for x, y, on in c] for c in shapes[k % 3]] for k in range(600)] + [[], [[]], None]
    told = []
    plain = outlines._signature
    monkeypatch.setattr(outlines, "_signature", lambda contours: told.append(1) or plain(contours))
    outlines._known.clear()
    kind = pa.list_(pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("on", pa.int32())])))
    rows = [g and [[dict(zip(("x", "y", "on"), p, strict=True)) for p in c] for c in g] for g in groups]
    want = [hashlib.sha1(repr(outlines.outline(g)).encode()).hexdigest() for g in groups[:600]]
    assert outlines.signatures(pa.array(rows, kind)) == want + [""] * 3 and len(told) == 3
    assert outlines.signatures(pa.array(rows, kind).slice(1, 5)) == want[1:6]
