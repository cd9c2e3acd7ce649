"""Text lines, stray glyphs and chains at the borders of their rules; components of long ways."""

from __future__ import annotations

import pytest

from lanewise.operators import components, layout

COLUMNS = "page string, block int, line int, span int, ord int, glyph_id int, char string, wmode int, x0 double, y0 double, x1 double, y1 double"


def boxes(spark, rows):
    """Rows of block, line, char, x0, y0 and, if not 10 by 10, width, height, wmode."""
    full = []
    for k, (block, line, char, x, y, *rest) in enumerate(rows):
        w, h, mode = [*rest, *(10, 10, 0)[len(rest) :]]
        full.append(("p", block, line, 0, k, k, char, mode, float(x), float(y), float(x + w), float(y + h)))
    return spark.createDataFrame(full, COLUMNS)


def test_long_way(spark):
    links = spark.createDataFrame([("g", k, k + 1) for k in range(60)] + [("h", 5, 9), ("h", 9, 5), ("h", 3, 3)], "g string, a long, b long")
    got = {(r.g, r.node): r.root for r in components.connected(links, ["g"], "a", "b").collect()}
    assert got == {("g", k): 0 for k in range(61)} | {("h", 5): 5, ("h", 9): 5}
    assert components.connected(links.filter("g = 'none'"), ["g"], "a", "b").count() == 0


def read(spark, rows):
    return "".join(r.char for r in sorted(layout.ordered(boxes(spark, rows)).collect(), key=lambda r: (r.block, r.pos)))


def test_fragments_in_reading_order(spark):
    assert read(spark, [(1, 0, "a", 0, 0), (1, 1, "c", 20, 0), (1, 2, "b", 10, 0)]) == "abc"
    # a middle of 2.5 and an overlap of 0.8 are the last that link; beyond either the records stay as they came
    assert read(spark, [(1, 0, "b", 10, 0), (1, 1, "a", 0, 2)]) == "ab"
    assert read(spark, [(1, 0, "b", 10, 0), (1, 1, "a", 0, 2.125)]) == "ba"
    assert read(spark, [(1, 0, "b", 10, 0, 10, 20), (1, 1, "a", 0, 2.5)]) == "ab"
    assert read(spark, [(1, 0, "b", 10, 0, 10, 20), (1, 1, "a", 0, 2.25)]) == "ba"
    # linked through a third one; vertical writing and other blocks are left alone
    assert read(spark, [(1, 0, "c", 20, 0), (1, 1, "b", 10, 2), (1, 2, "a", 0, 4)]) == "abc"
    assert read(spark, [(1, 0, "b", 10, 0, 10, 10, 1), (1, 1, "a", 0, 0, 10, 10, 1)]) == "ba"
    assert read(spark, [(1, 0, "b", 10, 0), (2, 1, "a", 0, 0)]) == "ba"
    assert read(spark, [(1, 0, "b", 10, 0, 10, 0), (1, 1, "a", 0, 0, 10, 0)]) == "ba"


def test_a_block_that_holds_most_rows(spark):
    rows = [(1, k, "x", 500 - k, 20 * (k % 2)) for k in range(400)] + [(2, 0, "y", 0, 0)]
    got = {r.glyph_id: (r.text_line, r.pos) for r in layout.ordered(boxes(spark, rows)).collect()}
    assert got == {k: (k % 2, (399 - k) // 2 + 200 * (k % 2)) for k in range(400)} | {400: (0, 0)}


LINE = [(1, 0, c, 10 * k, 0) for k, c in zip((0, 1, 3, 4), "abde", strict=True)]


@pytest.mark.parametrize(
    "stray, place",
    [
        ((2, 0, "c", 20, 0), 2),
        ((2, 0, "c", 20, 2.75), 2),
        ((2, 0, "c", 20, 3), None),  # overlap below 0.72
        ((2, 0, "c", 17, 0, 10, 10), None),  # laps over the glyph before by more than 0.22 of itself
        ((2, 0, "c", 18, 0, 10, 10), 2),
        ((2, 0, "c", 22, 0, 4, 10), None),  # narrower than 0.45 of the median
        ((2, 0, "f", 50, 0), 4),
        ((2, 0, "f", 52.75, 0), 4),
        ((2, 0, "f", 53, 0), None),  # farther from the end than 0.28
        ((2, 0, "z", -10, 0), 0),
        ((2, 0, "c", 20, 0, 10, 10, 1), None),
        ((1, 9, "c", 20, 0), None),  # of the same block
    ],
)
def test_stray_glyph(spark, stray, place):
    placed = layout.ordered(boxes(spark, [*LINE, stray]))
    got = [(r.host_block, r.insert_before) for r in layout.fuse(placed).collect()]
    assert got == ([(1, place)] if place is not None else [])


def test_stray_glyph_takes_the_nearest_line_then_the_first(spark):
    other = [(3, 0, c, x, y + 1) for _, _, c, x, y in LINE]
    same = [(4, 0, c, x, y) for _, _, c, x, y in LINE]
    placed = layout.ordered(boxes(spark, [*LINE, *other, *same, (2, 0, "c", 20, 0)]))
    found = layout.fuse(placed)
    assert [(r.host_block, r.insert_before, r.context) for r in layout.fused_context(placed, found, 2).collect()] == [(1, 2, "abcde")]
    stopped = [(1, 0, c, x, y) for (_, _, _, x, y), c in zip(LINE, "abd。", strict=True)]
    assert layout.fuse(layout.ordered(boxes(spark, [*stopped, (2, 0, "f", 50, 0)]))).count() == 0
    assert layout.fuse(layout.ordered(boxes(spark, [*LINE[:3], (2, 0, "c", 20, 0)]))).count() == 0


def chained(spark, rows):
    return {r.glyph_id: (r.text, r.place) for r in layout.chains(boxes(spark, rows)).collect()}


def test_chains(spark):
    steps = [(k, 0, c, 100 - 8 * k, 6 * k) for k, c in enumerate("edcba")]
    assert chained(spark, steps) == {k: ("abcde", 4 - k) for k in range(5)}
    assert chained(spark, steps[:3]) == {}
    assert chained(spark, [(k, 0, c, 0, 12 * k) for k, c in enumerate("abcd")]) == {k: ("abcd", k) for k in range(4)}
    bent = [(0, 0, "a", 0, 0), (1, 0, "b", 10, 0), (2, 0, "c", 10, 10), (3, 0, "d", 20, 10)]
    assert chained(spark, bent) == {}
    assert chained(spark, [*steps, (9, 0, "x", 84, 12)]) == {}  # two blocks in one place
    assert chained(spark, [*steps, (8, 0, "x", 84, 112), (8, 0, "y", 94, 112)]) == {k: ("abcde", 4 - k) for k in range(5)}
    uneven = [(k, 0, c, x, 0) for k, (c, x) in enumerate(zip("abcd", (0, 7, 14, 30), strict=True))]
    assert chained(spark, uneven) == {}
