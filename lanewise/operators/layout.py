"""Text lines from the boxes of a page's glyphs: geometry alone, no reading takes part.

``glyphs``: ``page, block, line, span, ord, glyph_id, char, wmode, x0, y0, x1, y1``;
``ord`` is a glyph's place in its span, ``wmode`` 0 is horizontal. Pages and blocks
aren't looped over: boxes meet others in cells of a grid as fine as the rule that links
them, equal boxes stand for one, and only sums and nearest neighbours leave a cell.

Cases: glyphs without a box are in no line but their own; a box without height or width
counts as ``EPSILON``; equal places are told apart by ``glyph_id``; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected, cut

# How boxes of one text line lie to each other.
EPSILON = 1e-6
BAND_OVERLAP, BAND_CENTRE = 0.80, 0.25
MICRO_GLYPHS, HOST_GLYPHS = 3, 4
WIDTH_RANGE, HOST_OVERLAP, HOST_CENTRE = (0.45, 1.9), 0.72, 0.45
INNER_GAP, EDGE_GAP, EDGE_PENALTY, MOST_OVERLAP, MOST_STEP = 0.60, 0.28, 0.15, 0.22, 1.55
STRONG_STOPS = "。！？!?；;"
CHAIN_GLYPHS, CHAIN_SIZES, CHAIN_REACH, CHAIN_STEP = 4, (0.55, 1.8), 9.0, (0.55, 1.65)
CHAIN_BEND, CHAIN_GAPS = 0.42, (0.45, 1.85)

LINE = ["page", "block", "line"]


def _size(low: str, high: str) -> Column:
    return F.greatest(F.lit(EPSILON), F.col(high) - F.col(low))


def _middle(low: str, high: str) -> Column:
    return (F.col(low) + F.col(high)) / 2


def upper_median(value: str) -> Column:
    """The larger of the two middle values, as an aggregate over value counts."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def fragments(glyphs: DataFrame) -> DataFrame:
    """One box per line record of a block, with its writing mode (-1 where mixed)."""
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    mode = F.when(F.min("wmode") == F.max("wmode"), F.min("wmode")).otherwise(-1)
    return glyphs.groupBy(*LINE).agg(*box, mode.alias("wmode"))


def line_links(boxes: DataFrame) -> DataFrame:
    """``page, block, a, b``: line records of a block that share one visual band.

    Two conditions at once: they overlap by most of the lower one's height, and their
    middles are near for it. Records with one band are linked as a star; different bands
    meet in cells as wide as the lower one's tolerance, one grid for each doubling of
    heights that occurs in the block.
    """
    rows = boxes.filter("wmode = 0 AND y0 IS NOT NULL AND y1 IS NOT NULL")
    bands = cut(rows.groupBy("page", "block", "y0", "y1").agg(F.min("line").alias("first")))
    stars = rows.join(bands, ["page", "block", "y0", "y1"]).filter(F.col("line") != F.col("first")).filter(F.col("y1") - F.col("y0") >= BAND_OVERLAP * _size("y0", "y1"))
    sized = bands.withColumns({"h": _size("y0", "y1"), "c": _middle("y0", "y1")}).withColumn("k", F.floor(F.log2("h")).cast("int"))
    cell = F.floor(F.col("c") / (2 * BAND_CENTRE * F.pow(F.lit(2.0), F.col("k"))))
    lower = sized.withColumn("cell", cell)
    classes = sized.select("page", "block", F.col("k").alias("kk")).distinct()
    higher = sized.join(classes, ["page", "block"]).filter("kk <= k").drop("k").withColumnRenamed("kk", "k")
    higher = higher.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    higher = higher.select("page", "block", "k", "cell", *(F.col(c).alias(f"{c}_") for c in ("y0", "y1", "h", "c", "first")))
    shared = F.greatest(F.lit(0.0), F.least("y1", "y1_") - F.greatest("y0", "y0_"))
    near = (shared / F.col("h") >= BAND_OVERLAP) & (F.abs(F.col("c") - F.col("c_")) <= BAND_CENTRE * F.col("h"))
    met = lower.join(higher, ["page", "block", "k", "cell"]).filter((F.col("h_") >= F.col("h")) & (F.col("first") != F.col("first_")) & near)
    return stars.select("page", "block", F.col("first").alias("a"), F.col("line").alias("b")).unionByName(met.select("page", "block", F.col("first").alias("a"), F.col("first_").alias("b")))


def ordered(glyphs: DataFrame) -> DataFrame:
    """Adds ``text_line`` (the smallest line record of its visual line) and ``pos``, the place in the block.

    Visual lines of several records are read from left to right, others as recorded.
    """
    roots = connected(line_links(fragments(glyphs)), ["page", "block"], "a", "b").select("page", "block", F.col("node").alias("line"), F.col("root").alias("text_line"))
    joined = glyphs.join(roots, LINE, "left")
    several = F.col("text_line").isNotNull()
    rows = joined.withColumns({"_x": F.when(several, F.col("x0")), "_y": F.when(several, F.col("y0")), "text_line": F.coalesce("text_line", "line")})
    inside = F.row_number().over(Window.partitionBy("page", "block", "text_line").orderBy("_x", "_y", "line", "span", "ord", "glyph_id"))
    lines = rows.groupBy("page", "block", "text_line").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("page", "block").orderBy("text_line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = lines.select("page", "block", "text_line", before.alias("_before"))
    return rows.withColumn("_in", inside).join(based, ["page", "block", "text_line"]).withColumn("pos", (F.col("_before") + F.col("_in") - 1).cast("int")).drop("_x", "_y", "_in", "_before")


def host_lines(glyphs: DataFrame, counts: DataFrame) -> DataFrame:
    """Line records long enough to take a stray glyph: sizes, band, ends."""
    rows = glyphs.filter("wmode = 0").withColumns({"w": _size("x0", "x1"), "h": _size("y0", "y1")}).join(counts.filter(F.col("n") >= HOST_GLYPHS).select("page", "block"), ["page", "block"])
    found = rows.groupBy(*LINE).agg(
        F.count(F.lit(1)).alias("n"), upper_median("w").alias("mw"), upper_median("h").alias("mh"), F.min("y0").alias("top"), F.max("y1").alias("foot"),
        F.avg(_middle("y0", "y1")).alias("level"), F.min(_middle("x0", "x1")).alias("first_c"), F.max(_middle("x0", "x1")).alias("last_c"), F.max("pos").alias("last_pos"),
    )
    return found.filter(F.col("n") >= HOST_GLYPHS).withColumnsRenamed({"block": "host_block", "line": "host_line"}).drop("n")


def stray_glyphs(glyphs: DataFrame, counts: DataFrame) -> DataFrame:
    rows = glyphs.filter("wmode = 0").join(counts.filter(F.col("n") <= MICRO_GLYPHS).select("page", "block"), ["page", "block"])
    return rows.select("page", "block", "glyph_id", F.col("char").alias("stray"), F.col("x0").alias("tx0"), F.col("x1").alias("tx1"), F.col("y0").alias("ty0"), F.col("y1").alias("ty1"), _size("x0", "x1").alias("tw"), _middle("x0", "x1").alias("tc"), _middle("y0", "y1").alias("tm"))


def _meeting(strays: DataFrame, hosts: DataFrame) -> DataFrame:
    """Stray glyphs with the line records whose band they overlap, through the page's band cells."""
    unit = hosts.groupBy("page").agg(F.greatest(F.avg(F.col("foot") - F.col("top")), F.lit(EPSILON)).alias("unit"))
    cells = lambda low, high: F.sequence(F.floor(F.col(low) / F.col("unit")), F.floor(F.col(high) / F.col("unit")))
    left = strays.join(unit, "page").withColumn("_from", F.floor(F.col("ty0") / F.col("unit"))).withColumn("cell", F.explode(cells("ty0", "ty1"))).drop("unit")
    right = hosts.join(unit, "page").withColumn("_start", F.floor(F.col("top") / F.col("unit"))).withColumn("cell", F.explode(cells("top", "foot"))).drop("unit")
    met = left.join(right, ["page", "cell"]).filter(F.col("cell") == F.greatest("_from", "_start"))  # once, in their first common cell
    height = F.greatest(F.lit(EPSILON), F.least(F.col("ty1") - F.col("ty0"), F.col("foot") - F.col("top")))
    shared = F.greatest(F.lit(0.0), F.least("ty1", "foot") - F.greatest("ty0", "top"))
    fits = (F.col("block") != F.col("host_block")) & F.col("tw").between(WIDTH_RANGE[0] * F.col("mw"), WIDTH_RANGE[1] * F.col("mw"))
    level = (shared / height >= HOST_OVERLAP) & (F.abs(F.col("tm") - F.col("level")) <= HOST_CENTRE * F.col("mh"))
    return met.filter(fits & level).drop("cell", "_from", "_start")


def fuse(glyphs: DataFrame) -> DataFrame:
    """Stray glyphs put back into the gap or at the end of a longer line of another block.

    ``glyphs`` as :func:`ordered` gives them. One row for each stray glyph that fits:
    ``page, block, glyph_id, host_block, host_line, insert_before, score``. The least
    score wins, then the first block and line. Neighbours are sought in cells of the
    host's own glyph width, so a long line isn't gathered.
    """
    counts = cut(glyphs.groupBy("page", "block").agg(F.count(F.lit(1)).alias("n")))
    hosts = cut(host_lines(glyphs, counts))
    met = cut(_meeting(stray_glyphs(glyphs, counts), hosts))
    step = MOST_STEP * F.col("mw")
    cell = lambda c: F.floor(c / (F.col("mw") * 2))
    own = glyphs.filter("wmode = 0").withColumnsRenamed({"block": "host_block", "line": "host_line"}).join(hosts.select("page", "host_block", "host_line", "mw"), ["page", "host_block", "host_line"])
    own = own.select("page", "host_block", "host_line", _middle("x0", "x1").alias("c"), "pos", "x0", "x1", "char", cell(_middle("x0", "x1")).alias("cell"))
    asked = met.withColumn("cell", F.explode(F.sequence(cell(F.col("tc") - step), cell(F.col("tc") + step))))
    near = asked.join(own, ["page", "host_block", "host_line", "cell"])
    at = F.struct("c", "pos", "x0", "x1", "char")
    keys = ["page", "block", "glyph_id", "host_block", "host_line"]
    sides = near.groupBy(*keys).agg(F.max(F.when(F.col("c") <= F.col("tc"), at)).alias("p"), F.min(F.when(F.col("c") > F.col("tc"), at)).alias("q"))
    rows = met.join(sides, keys)

    left, right = F.col("tx0") - F.col("p.x1"), F.col("q.x0") - F.col("tx1")
    lap = lambda gap: F.greatest(F.lit(0.0), -gap) <= MOST_OVERLAP * F.col("tw")
    near_p, near_q = F.col("tc") - F.col("p.c") <= step, F.col("q.c") - F.col("tc") <= step
    lift = F.abs(F.col("tm") - F.col("level")) / F.greatest("mh", F.lit(EPSILON))
    wide = F.greatest("mw", F.lit(EPSILON))
    before, after = F.col("first_c") > F.col("tc"), F.col("last_c") <= F.col("tc")
    inner = ~before & ~after & (F.col("p.c") < F.col("tc")) & (F.abs(left) <= INNER_GAP * F.col("mw")) & (F.abs(right) <= INNER_GAP * F.col("mw")) & lap(left) & lap(right) & near_p & near_q
    at_start = before & (F.abs(right) <= EDGE_GAP * F.col("mw")) & lap(right) & near_q
    at_end = after & ~F.contains(F.lit(STRONG_STOPS), F.col("p.char")) & (F.abs(left) <= EDGE_GAP * F.col("mw")) & lap(left) & near_p
    score = F.when(inner, lift + F.abs(left) / wide + F.abs(right) / wide).when(at_start, lift + F.abs(right) / wide + EDGE_PENALTY).when(at_end, lift + F.abs(left) / wide + EDGE_PENALTY)
    place = F.when(after, F.col("last_pos") + 1).otherwise(F.col("q.pos"))
    best = rows.withColumns({"score": score, "insert_before": place.cast("int")}).filter("score IS NOT NULL")
    best = best.groupBy("page", "block", "glyph_id").agg(F.min(F.struct("score", "host_block", "host_line", "insert_before")).alias("b"))
    return best.select("page", "block", "glyph_id", "b.host_block", "b.host_line", "b.insert_before", "b.score")


def fused_context(glyphs: DataFrame, fused: DataFrame, radius: int) -> DataFrame:
    """Adds ``context``: the host block's glyphs around the place, with the stray glyph in it."""
    own = glyphs.select("page", F.col("block").alias("host_block"), F.col("pos"), "char")
    marks = fused.join(glyphs.select("page", "block", "glyph_id", F.col("char").alias("stray")), ["page", "block", "glyph_id"])
    asked = marks.withColumn("pos", F.explode(F.sequence(F.col("insert_before") - radius, F.col("insert_before") + radius - 1)))
    met = asked.join(own, ["page", "host_block", "pos"], "left")
    keys = [*fused.columns, "stray"]
    listed = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("char", F.lit("")).alias("char")))).alias("_l"))
    part = lambda test: F.array_join(F.transform(F.filter("_l", test), lambda x: x["char"]), "")
    text = F.concat(part(lambda x: x["pos"] < F.col("insert_before")), F.col("stray"), part(lambda x: x["pos"] >= F.col("insert_before")))
    return listed.select(*fused.columns, text.alias("context"))


def neighbourhoods(glyphs: DataFrame) -> DataFrame:
    """One-glyph blocks with the like-sized one-glyph blocks around each, by block.

    Places that several blocks share are one neighbour with their number in ``same``.
    """
    counts = glyphs.groupBy("page", "block").agg(F.count(F.lit(1)).alias("n"))
    alone = glyphs.filter("wmode = 0 AND x0 IS NOT NULL").join(counts.filter("n = 1").select("page", "block"), ["page", "block"])
    alone = cut(alone.select("page", "block", "glyph_id", "char", _middle("x0", "x1").alias("cx"), _middle("y0", "y1").alias("cy"), _size("x0", "x1").alias("w"), _size("y0", "y1").alias("h")).withColumn("scale", F.greatest("w", "h")))
    places = alone.groupBy("page", "cx", "cy", "w", "h").agg(F.min(F.struct("block", "glyph_id", "char")).alias("_f"), F.count(F.lit(1)).cast("int").alias("same"))
    # a neighbour's larger side is within the size range of the source's, so few grids meet
    k = lambda scale: F.floor(F.log2(scale)).cast("int")
    grid = lambda c, kk: F.floor(c / (CHAIN_REACH * F.pow(F.lit(2.0), kk + 1)))
    around = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    spread = places.withColumn("k", F.explode(F.sequence(k(F.greatest("w", "h") / CHAIN_SIZES[1]), k(F.greatest("w", "h") / CHAIN_SIZES[0])))).withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    spread = spread.select("page", "k", (grid(F.col("cx"), F.col("k")) + F.col("_dx")).alias("gx"), (grid(F.col("cy"), F.col("k")) + F.col("_dy")).alias("gy"), F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("w").alias("nw"), F.col("h").alias("nh"), "_f", "same")
    own = alone.withColumn("k", k(F.col("scale"))).withColumns({"gx": grid(F.col("cx"), F.col("k")), "gy": grid(F.col("cy"), F.col("k"))})
    like = (F.col("nw") / F.col("w")).between(*CHAIN_SIZES) & (F.col("nh") / F.col("h")).between(*CHAIN_SIZES)
    far = F.sqrt((F.col("nx") - F.col("cx")) * (F.col("nx") - F.col("cx")) + (F.col("ny") - F.col("cy")) * (F.col("ny") - F.col("cy"))) <= CHAIN_REACH * F.col("scale")
    met = own.join(spread, ["page", "k", "gx", "gy"]).filter(like & far)
    listed = F.array_sort(F.collect_list(F.struct(F.col("_f.block").alias("block"), F.col("_f.char").alias("char"), "nx", "ny", "nw", "nh", "same")))
    return met.groupBy("page", "block", "glyph_id", "cx", "cy", "w", "h").agg(listed.alias("near")).filter(F.size("near") >= CHAIN_GLYPHS)


def chain(at: tuple[float, float, float, float], chars: list[str], x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, same: np.ndarray) -> tuple[str, int] | None:
    """The text of the straight, even chain through the glyph ``at``, and its place in it."""
    scale = np.maximum(w, h)
    dx, dy = x[None, :] - x[:, None], y[None, :] - y[:, None]
    apart, local = np.sqrt(dx * dx + dy * dy), 0.5 * (scale[:, None] + scale[None, :])
    linked = (apart >= CHAIN_STEP[0] * local) & (apart <= CHAIN_STEP[1] * local)
    source = (x == at[0]) & (y == at[1]) & (w == at[2]) & (h == at[3])
    inside = source
    while not np.array_equal(wider := inside | linked[inside].any(axis=0), inside):
        inside = wider
    own = np.flatnonzero(inside)
    if len(own) < CHAIN_GLYPHS or (same[own] > 1).any():
        return None
    square = np.triu(dx * dx + dy * dy, 1)[np.ix_(own, own)]
    i, j = divmod(int(square.argmax()), len(own))
    if square[i, j] <= 0:
        return None
    ux, uy = dx[own[i], own[j]], dy[own[i], own[j]]
    size = np.sqrt(ux * ux + uy * uy)
    ux, uy = ux / size, uy / size
    if (ux if abs(ux) >= abs(uy) else uy) < 0:
        ux, uy = -ux, -uy
    rx, ry = x[own] - x[own].sum() / len(own), y[own] - y[own].sum() / len(own)
    along, off = rx * ux + ry * uy, np.abs(rx * -uy + ry * ux)
    order = np.argsort(along, kind="stable")
    gaps = np.diff(along[order])
    middle = np.sort(gaps)[len(gaps) // 2]
    if off.max() > CHAIN_BEND * np.sort(scale[own])[len(own) // 2] or gaps.min() <= 0 or gaps.min() < CHAIN_GAPS[0] * middle or gaps.max() > CHAIN_GAPS[1] * middle:
        return None
    text = "".join(chars[k] or "" for k in own[order])
    return (text, int(np.flatnonzero(source[own[order]])[0])) if len(text) >= CHAIN_GLYPHS else None


def chains(glyphs: DataFrame) -> DataFrame:
    """``page, block, glyph_id, text, place`` of every one-glyph block on a straight chain of such blocks.

    Each glyph is judged among its own neighbours (like its size, within its reach): the
    component of links of about one glyph, read along its longest way.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                column = lambda name, near=r.near: np.array([n[name] for n in near], np.float64)
                found = chain((r.cx, r.cy, r.w, r.h), [n["char"] for n in r.near], *map(column, ("nx", "ny", "nw", "nh", "same")))
                if found:
                    rows.append((r.page, r.block, r.glyph_id, *found))
            yield pd.DataFrame(rows, columns=["page", "block", "glyph_id", "text", "place"])

    kinds = dict(glyphs.dtypes)
    return neighbourhoods(glyphs).mapInPandas(run, f"page {kinds['page']}, block {kinds['block']}, glyph_id {kinds['glyph_id']}, text string, place int")
