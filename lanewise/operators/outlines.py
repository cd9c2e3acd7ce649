"""Outlines of glyphs: exact signatures, stacked groups, and readings from templates.

``contours`` is ``array<array<struct<x int, y int, on int>>>``. Grouping is one fold over
the sorted contours of a glyph, in the engine; signatures are a small function of a
group's points; templates meet signatures in joins. Which readings a sequence of bands
can have is decided by a recurrence over cuts that holds the least and the greatest
reading of each place: they are equal exactly if there is one, so partitions are never
listed.

Cases: contours without points are left out; a glyph without contours has the reason
``no_symbol_groups``; equal heights keep the contours' order; a signature whose templates
differ in label has none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Marks of tones, the border of the tone's side, bands and symbols at most.
TONE_MARKS = {"2": "ˊ", "3": "ˇ", "4": "ˋ"}
NEUTRAL_MARK = "˙"
TONE_SIDE = 330
MOST_BANDS, MOST_SYMBOLS = 8, 3
#: Templates up to which all tasks are sent all of them.
SENT_TEMPLATES = 100_000
STACK_LEAST, STACK_SHARE = 5.0, 0.15
BAND_SHARE, BAND_CENTRE = 0.45, 0.22


def least_rotation(sequence: list) -> list:
    """The rotation that comes first in order, in linear time."""
    n, i, j, k = len(sequence), 0, 1, 0
    while i < n and j < n and k < n:
        a, b = sequence[(i + k) % n], sequence[(j + k) % n]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        j += i == j
        k = 0
    at = min(i, j)
    return sequence[at:] + sequence[:at]


def outline(contours: list[list[tuple[int, int, int]]]) -> tuple | None:
    """Size and closed contours of a group, wherever it lies and wherever its contours begin."""
    points = [p for c in contours for p in c]
    if not points:
        return None
    left, low = min(p[0] for p in points), min(p[1] for p in points)
    cycles = []
    for contour in contours:
        moved = [(x - left, y - low, on) for x, y, on in contour]
        cycles.append(tuple(min(least_rotation(moved), least_rotation(moved[::-1]))) if moved else ())
    return max(p[0] for p in points) - left, max(p[1] for p in points) - low, tuple(sorted(cycles))


#: Groups and contours a worker remembers, each from its own corner.
REMEMBERED = 200_000
_known: dict[tuple[bytes, bytes], str] = {}
_cycles: dict[tuple, list] = {}


def _cycle(contour: list[tuple[int, int, int]]) -> tuple:
    """The contour from its least point and direction; that choice doesn't depend on where it lies."""
    if not contour:
        return ()
    left, low = min(p[0] for p in contour), min(p[1] for p in contour)
    own = tuple((x - left, y - low, on) for x, y, on in contour)
    found = _cycles.get(own)
    if found is None:
        if len(_cycles) >= REMEMBERED:
            _cycles.clear()
        found = _cycles[own] = min(least_rotation(list(own)), least_rotation(list(own[::-1])))
    return tuple((x + left, y + low, on) for x, y, on in found)


def _signature(contours: list[list[tuple[int, int, int]]]) -> str:
    """The signature of a group that lies at its own corner."""
    points = [p for c in contours for p in c]
    told = max(p[0] for p in points), max(p[1] for p in points), tuple(sorted(map(_cycle, contours)))
    return hashlib.sha1(repr(told).encode()).hexdigest()


def signatures(groups: pa.Array) -> list[str]:
    """Signatures of groups of contours; equal groups of a worker are worked out once."""
    contours = groups.flatten()
    sizes = [pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (groups, contours)]
    columns = np.stack([f.to_numpy(zero_copy_only=False).astype(np.int64) for f in contours.flatten().flatten()], axis=1)
    ends = [np.concatenate([[0], np.cumsum(n)]) for n in sizes]
    bounds = ends[1][ends[0]]  # the points of each group
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        corner = np.minimum.reduceat(columns[:, :2], bounds[:-1][filled], axis=0)
        columns[:, :2] -= np.repeat(corner, np.diff(bounds)[filled], axis=0)
    points, lengths = columns.tobytes(), sizes[1].tobytes()
    out = [""] * len(groups)
    firsts, places = ends[0].tolist(), bounds.tolist()
    for g in filled.tolist():
        lo, hi, a, b = firsts[g], firsts[g + 1], places[g], places[g + 1]
        key = points[24 * a : 24 * b], lengths[8 * lo : 8 * hi]
        found = _known.get(key)
        if found is None:
            if len(_known) >= REMEMBERED:
                _known.clear()
            rows, at = list(map(tuple, columns[a:b].tolist())), (ends[1][lo : hi + 1] - a).tolist()
            found = _known[key] = _signature([rows[i:j] for i, j in zip(at, at[1:], strict=False)])
        out[g] = found
    return out


@F.arrow_udf(StringType())
def signature(groups: pa.Array) -> pa.Array:
    """SHA-1 of the outline as its tuple is written; empty for a group without points."""
    return pa.array(signatures(groups), pa.string())


@F.arrow_udf(StringType())
def relative_signature(groups: pa.Array) -> pa.Array:
    """SHA-1 of a group's drawing steps from its least corner, in their order and to three decimals.

    ``array<array<struct<op string, points array<struct<x double, y double>>>>>``.
    """

    def of(group) -> str:
        points = [p for c in group if c is not None for s in c for p in s["points"]] if group is not None else []
        if not points:
            return ""
        left, low = min(p["x"] for p in points), min(p["y"] for p in points)
        drawn = tuple(tuple((s["op"], tuple((round(p["x"] - left, 3), round(p["y"] - low, 3)) for p in s["points"])) for s in c) for c in group)
        return hashlib.sha1(repr(drawn).encode()).hexdigest()

    return pa.array([of(g) for g in groups.to_pylist()], pa.string())


_BOXES = """filter(transform({c}, (c, i) -> struct(i AS i, array_min(transform(c, p -> p.x)) AS x0, array_max(transform(c, p -> p.x)) AS x1,
  array_min(transform(c, p -> p.y)) AS y0, array_max(transform(c, p -> p.y)) AS y1)), b -> b.y0 IS NOT NULL)"""
_STATE = "cast(array() AS array<struct<y0: int, y1: int, members: array<int>>>)"


def _fold(items: str, best: str) -> str:
    """Groups of sorted boxes; ``best`` gives the place (from 1) of the group ``g`` that takes box ``t``, null for none."""
    joined = "transform(g, (q, k) -> if(k + 1 = b, struct(least(q.y0, t.y0) AS y0, greatest(q.y1, t.y1) AS y1, concat(q.members, array(t.i)) AS members), q))"
    opened = "concat(g, array(struct(t.y0 AS y0, t.y1 AS y1, array(t.i) AS members)))"
    return f"aggregate({items}, {_STATE}, (g, t) -> transform(array({best}), b -> if(b IS NULL, {opened}, {joined}))[0])"


def _by(groups: str, key: str) -> Column:
    """Members of each group, by ``key`` and then as they came."""
    return F.expr(f"transform(array_sort(transform({groups}, (q, k) -> struct({key} AS key, k AS k, q.members AS members))), s -> s.members)")


def stacks(contours: str) -> Column:
    """Contours of each stacked symbol, top first: a box joins the group it overlaps most, if by enough.

    Enough is more than ``STACK_LEAST`` and than ``STACK_SHARE`` of the lower one's height.
    """
    items = f"array_sort(transform({_BOXES.format(c=contours)}, b -> struct(-b.y1 AS top, b.i AS i, b.y0 AS y0, b.y1 AS y1)))"
    shared = "(least(t.y1, q.y1) - greatest(t.y0, q.y0))"
    enough = f"greatest({STACK_LEAST}D, {STACK_SHARE}D * least(greatest(1, t.y1 - t.y0), greatest(1, q.y1 - q.y0)))"
    best = f"array_max(transform(g, (q, k) -> if({shared} > {enough}, struct({shared} AS s, -k AS k), null)))"
    return _by(_fold(items, f"1 - {best}.k"), "-q.y1")


def bands(contours: str, without: str = "-1") -> Column:
    """Contours of each vertical band, top first, leaving out the contour ``without``.

    A box joins the band that it overlaps by enough, or whose middle is near; the largest
    relative overlap wins, then the nearest middle, then the later band.
    """
    middle = lambda r: f"(({r}.y0 + {r}.y1) / 2)"
    items = f"array_sort(transform(filter({_BOXES.format(c=contours)}, b -> b.i <> {without}), b -> struct(-{middle('b')} AS top, b.i AS i, b.y0 AS y0, b.y1 AS y1)))"
    shared, apart = "greatest(0, least(t.y1, q.y1) - greatest(t.y0, q.y0))", f"abs({middle('t')} - {middle('q')})"
    fits = f"({shared} >= {BAND_SHARE}D * least(greatest(t.y1 - t.y0, 1), greatest(q.y1 - q.y0, 1)) OR {apart} <= {BAND_CENTRE}D * greatest(t.y1 - t.y0, q.y1 - q.y0, 1))"
    best = f"array_max(transform(g, (q, k) -> if({fits}, struct({shared} / greatest(1, least(t.y1 - t.y0, q.y1 - q.y0)) AS s, -{apart} AS d, k AS k), null)))"
    return _by(_fold(items, f"{best}.k + 1"), f"-{middle('q')}")


def tone_contour(contours: str) -> Column:
    """The one contour on the tone's side; null if there is none or more than one."""
    right = f"filter({_BOXES.format(c=contours)}, b -> (b.x0 + b.x1) / 2 > {TONE_SIDE})"
    return F.expr(f"if(size({right}) = 1, {right}[0].i, null)")


def one_reading(segments: DataFrame, ends: DataFrame, parts: int = MOST_SYMBOLS) -> DataFrame:
    """``key, least, greatest``: readings of the ways to cut each sequence into at most ``parts``.

    ``segments`` has ``key, i, j, label`` of the cuts' pieces that have a label, ``ends`` has
    ``key, first, n``. After k pieces a place is known by its least and greatest reading;
    a common piece keeps two readings apart, so they stay different while any two are.
    """
    state = ends.select("key", F.col("first").alias("pos"), F.lit("").alias("least"), F.lit("").alias("greatest"))
    found = None
    for _ in range(parts):
        met = state.withColumnRenamed("pos", "i").join(segments, ["key", "i"])
        state = met.groupBy("key", F.col("j").alias("pos")).agg(F.min(F.concat("least", "label")).alias("least"), F.max(F.concat("greatest", "label")).alias("greatest"))
        found = state if found is None else found.unionByName(state)
    whole = found.join(ends.select("key", F.col("n").alias("pos")), ["key", "pos"])
    return whole.groupBy("key").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def recombine(glyphs: DataFrame, templates: DataFrame) -> DataFrame:
    """``key, reading, reason, mode``: a reading from exact signatures, or why there is none.

    ``glyphs`` has ``key, contours``; ``templates`` has ``kind`` (symbol, tone, neutral),
    ``outline_signature, label, support_keys, direct``. Templates with fewer than two
    sources count only if they were seen directly.
    """
    known = templates.filter("support_keys >= 2 OR direct").groupBy("kind", "outline_signature").agg(F.min("label").alias("label"), F.max("label").alias("_l")).filter("label = _l").drop("_l")
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
    known = known.groupBy("outline_signature").agg(of("symbol", F.col("label")).alias("symbol"), of("tone", F.col("label")).alias("tone"), of("neutral", F.lit(1)).alias("neutral"))
    if known.limit(SENT_TEMPLATES + 1).count() <= SENT_TEMPLATES:
        known = F.broadcast(known)
    split = glyphs.select("key", "contours", tone_contour("contours").alias("tone_at"))
    split = split.withColumn("bands", bands("contours", "coalesce(tone_at, -1)")).withColumn("n", F.size("bands"))
    whole = f"n <= {MOST_BANDS + 1}"  # one may be the neutral mark
    pieces = f"flatten(transform(sequence(0, n - 1), i -> transform(sequence(i + 1, if({whole}, n, i + 1)), j -> struct('symbol' AS kind, i AS i, j AS j, flatten(slice(bands, i + 1, j - i)) AS members))))"
    tone = "if(tone_at IS NULL, array(), array(struct('tone' AS kind, -1 AS i, -1 AS j, array(tone_at) AS members)))"
    glyph = "array(struct('glyph' AS kind, -1 AS i, -1 AS j, cast(array() AS array<int>) AS members))"
    asked = split.select("key", "contours", "n", F.explode(F.expr(f"concat({glyph}, if(n > 0, {pieces}, array()), {tone})")).alias("p"))
    signed = asked.select("key", "n", "p.kind", "p.i", "p.j", signature(F.transform("p.members", lambda m: F.get("contours", m))).alias("outline_signature"))

    # a glyph's pieces stay together, so that nothing but one row for each glyph is left
    told = signed.join(known, "outline_signature", "left")
    is_symbol, is_tone = F.col("kind") == "symbol", F.col("kind") == "tone"
    rows = told.groupBy("key").agg(
        F.max("n").alias("n"), F.max(F.when(is_tone, True)).alias("has_tone"), F.max(F.when(is_tone, F.col("tone"))).alias("tone"),
        F.coalesce(F.max(F.when(is_symbol & (F.col("i") == 0) & (F.col("j") == 1), F.col("neutral"))), F.lit(0)).alias("first"),
        F.collect_list(F.when(is_symbol & F.col("symbol").isNotNull(), F.struct("i", "j", F.col("symbol").alias("label")))).alias("segments"),
    )
    left = F.col("n") - F.col("first")
    reason = F.when(F.col("n") == 0, "no_symbol_groups").when(left == 0, "neutral_without_base").when((F.col("first") == 1) & F.col("has_tone"), "neutral_plus_right_tone").when(F.col("has_tone") & F.col("tone").isNull(), "unknown_tone_signature")
    rows = rows.withColumn("stopped", reason).withColumn("left", left)

    singles = F.expr("array_sort(filter(segments, s -> s.j = s.i + 1 AND s.i >= first))")
    direct = F.when((F.col("left") <= MOST_SYMBOLS) & (F.size("_singles") == F.col("left")), F.array_join(F.transform("_singles", lambda s: s["label"]), ""))
    found = rows.withColumn("_singles", singles).withColumn("direct", direct)
    found = found.withColumn("_s0", F.array(F.struct(F.col("first").alias("pos"), F.lit("").alias("least"), F.lit("").alias("greatest"))))
    for k in range(MOST_SYMBOLS):  # after k pieces a place is known by its least and greatest reading, as in one_reading
        on = f"transform(filter(_s{k}, f -> exists(segments, s -> s.i = f.pos AND s.j = e)), f -> struct(concat(f.least, filter(segments, s -> s.i = f.pos AND s.j = e)[0].label) AS least, concat(f.greatest, filter(segments, s -> s.i = f.pos AND s.j = e)[0].label) AS greatest))"
        ends = "array_distinct(transform(segments, s -> s.j))"
        step = f"filter(transform({ends}, e -> struct(e AS pos, array_min(transform({on}, w -> w.least)) AS least, array_max(transform({on}, w -> w.greatest)) AS greatest)), x -> x.least IS NOT NULL)"
        found = found.withColumn(f"_s{k + 1}", F.expr(f"if(stopped IS NULL AND left <= {MOST_BANDS} AND direct IS NULL, {step}, array())"))
    ways = f"filter(concat({', '.join(f'_s{k + 1}' for k in range(MOST_SYMBOLS))}), x -> x.pos = n)"
    found = found.withColumn("_w", F.expr(ways)).withColumns({"least": F.array_min(F.transform("_w", lambda w: w["least"])), "greatest": F.array_max(F.transform("_w", lambda w: w["greatest"]))})
    base = F.coalesce("direct", F.when(F.col("least") == F.col("greatest"), F.col("least")))
    mark = F.coalesce(*(F.when(F.col("tone") == t, m) for t, m in TONE_MARKS.items()), F.lit(""))
    reading = F.when(F.col("first") == 1, F.concat(F.lit(NEUTRAL_MARK), base)).otherwise(F.concat(base, mark))
    why = F.coalesce("stopped", F.when(F.col("left") > MOST_BANDS, "partition_bad_group_count").when(base.isNotNull(), "ok").when(F.col("least").isNull(), "partition_unknown_symbol").otherwise("partition_multiple_readings"))
    mode = F.when(F.col("direct").isNotNull(), "direct_bands").when(base.isNotNull(), "partitioned_bands")
    return found.select("key", F.when(why == "ok", reading).alias("reading"), why.alias("reason"), F.when(why == "ok", mode).alias("mode"))
