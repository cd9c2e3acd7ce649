"""Text lines, stray glyphs and glyph chains on boxes laid out from ``events``.

Sixty events are a page: two blocks of two lines each with a gap, two blocks whose
glyphs are line records of their own out of order, small blocks near the gaps and
ends, and two rising chains of single glyphs. A jitter from the event's own values
makes some of them fit and others not; all coordinates are sixteenths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout
from .tables import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


#: One text for both engines; ``div`` and ``json`` differ and are filled in.
_BOXES = """
SELECT page, CASE WHEN p < 40 THEN {p10} WHEN p < 46 THEN p WHEN p < 48 THEN 46 ELSE p END AS block,
  CASE WHEN p < 20 THEN {row} WHEN p < 40 THEN (p * 7) % 10 ELSE 0 END AS line, 0 AS span, p AS ord, event_id AS glyph_id, substring('一不人個分天年東西地好玩看妹角色利和。的', k % 20 + 1, 1) AS char,
  CASE WHEN q = 4 AND p % 10 = 9 THEN 1 ELSE 0 END AS wmode, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM (
SELECT *,
  CAST(CASE WHEN p < 20 THEN 10 * (p % 5 + CASE WHEN p % 5 >= 2 THEN 1 ELSE 0 END) + q / 16.0 WHEN p < 40 THEN 10 * (p % 5) + q / 16.0 WHEN p < 48 THEN CASE WHEN p % 2 = 0 THEN 20 WHEN q > 0 THEN -10 ELSE 60 END + q / 4.0
    ELSE 200 + 100 * {chain} + (p - 48) % 6 * CASE WHEN p < 54 THEN 10 ELSE 7.5 END + q / 8.0 END AS DOUBLE) AS x0,
  CAST(CASE WHEN p < 20 THEN 60 * {p10} + 20 * {row} + q % 2 / 8.0 WHEN p < 40 THEN 60 * {p10} + 20 * {row} + q / 2.0 WHEN p < 48 THEN 60 * {micro} + 20 * {half} + q / 2.0
    ELSE 20 + 40 * {chain} + (p - 48) % 6 * 3 + CASE WHEN q = 4 THEN 6 ELSE q / 8.0 END END AS DOUBLE) AS y0,
  CAST(CASE WHEN p < 40 THEN 9 + q / 16.0 WHEN p < 48 THEN 8 + q / 8.0 WHEN q = -4 THEN 20 ELSE 9 END AS DOUBLE) AS w,
  CAST(CASE WHEN p < 20 THEN 10 WHEN p < 40 THEN 10 + q % 3 / 2.0 WHEN p < 48 THEN 10 WHEN q = -4 THEN 20 ELSE 9 END AS DOUBLE) AS h FROM (
SELECT event_id, {page} AS page, CAST(event_id % 60 AS INT) AS p, k, CAST((k * 37 + event_id * 11 + CAST(floor(coalesce(value, 0)) AS BIGINT)) % 9 - 4 AS INT) AS q
FROM (SELECT event_id, value, coalesce({json}, 0) AS k FROM events) AS e) AS e) AS e"""


def _boxes(div: str, json: str) -> str:
    whole = lambda a, b: f"CAST(({a}) {div} {b} AS INT)"
    return _BOXES.format(
        p10=whole("p", 10), row=whole("p % 10", 5), chain=whole("p - 48", 6), micro=whole("p - 40", 4), half=whole("p % 4", 2), page=f"event_id {div} 60", json=json
    )


_SQL = _boxes("//", "CAST(json_extract_string(props, '$.k') AS BIGINT)")
#: Records of one visual line by reachability, and every glyph's place in its block.
_LINES = f"""
g AS ({_SQL}),
f AS (SELECT page, block, line, min(y0) AS y0, max(y1) AS y1, max(y1) - min(y0) AS h, (min(y0) + max(y1)) / 2 AS c, CASE WHEN min(wmode) = max(wmode) THEN min(wmode) ELSE -1 END AS m FROM g GROUP BY ALL),
k AS (SELECT a.page, a.block, a.line AS a, b.line AS b FROM f a JOIN f b ON a.page = b.page AND a.block = b.block AND a.line <> b.line AND a.m = 0 AND b.m = 0
      WHERE greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.h, b.h) >= 0.8 AND abs(a.c - b.c) <= 0.25 * least(a.h, b.h)),
r(page, block, a, b) AS (SELECT page, block, line, line FROM f UNION SELECT r.page, r.block, r.a, k.b FROM r JOIN k ON k.page = r.page AND k.block = r.block AND k.a = r.b),
l AS (SELECT page, block, a AS line, min(b) AS text_line, count(*) AS n FROM r GROUP BY ALL),
o AS (SELECT g.*, text_line, CAST(row_number() OVER (PARTITION BY g.page, g.block ORDER BY text_line, CASE WHEN n > 1 THEN x0 END, CASE WHEN n > 1 THEN y0 END, g.line, span, ord, glyph_id) - 1 AS INTEGER) AS pos FROM g JOIN l ON l.page = g.page AND l.block = g.block AND l.line = g.line)"""


def glyphs(spark: SparkSession, d: str) -> DataFrame:
    read(spark, d, "events", "event_id", "value", "props").createOrReplaceTempView("layout_events")
    return spark.sql(_boxes("div", "CAST(get_json_object(props, '$.k') AS BIGINT)").replace("FROM events", "FROM layout_events"))


@query(f"WITH RECURSIVE {_LINES} SELECT glyph_id, page, block, text_line, pos FROM o")
def text_line_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.ordered(glyphs(spark, d)).select("glyph_id", "page", "block", "text_line", "pos")


@query(f"""
WITH RECURSIVE {_LINES},
b AS (SELECT page, block, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT o.*, x1 - x0 AS w, y1 - y0 AS h, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, b.n FROM o JOIN b USING (page, block) WHERE wmode = 0),
h AS (SELECT page, block, line, list_sort(list(w))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS mw, list_sort(list(h))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS mh, min(y0) AS y0, max(y1) AS y1, avg(cy) AS cy, max(pos) AS last FROM s WHERE n >= 4 GROUP BY ALL HAVING count(*) >= 4),
t AS (SELECT s.page, s.block, s.glyph_id, s.char, s.x0, s.x1, s.w, s.cx, s.cy, h.block AS hb, h.line AS hl, h.mw, h.mh, h.cy AS hcy, h.last FROM s JOIN h ON h.page = s.page AND h.block <> s.block
      WHERE s.n <= 3 AND s.w BETWEEN 0.45 * mw AND 1.9 * mw AND greatest(0, least(s.y1, h.y1) - greatest(s.y0, h.y0)) / least(s.h, h.y1 - h.y0) >= 0.72 AND abs(s.cy - h.cy) <= 0.45 * mh),
p AS (SELECT t.page, t.block, t.glyph_id, hb, hl, max(struct_pack(c := s.cx, pos := s.pos, x1 := s.x1, ch := s.char)) FILTER (s.cx <= t.cx) AS p, min(struct_pack(c := s.cx, pos := s.pos, x0 := s.x0)) FILTER (s.cx > t.cx) AS q
      FROM t JOIN s ON s.page = t.page AND s.block = hb AND s.line = hl GROUP BY ALL),
z AS (SELECT t.*, p.p, p.q, t.x0 - p.p.x1 AS lg, p.q.x0 - t.x1 AS rg, abs(t.cy - hcy) / mh AS lift FROM t JOIN p USING (page, block, glyph_id, hb, hl)),
c AS (SELECT *, CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN CASE WHEN p.c < cx AND abs(lg) <= 0.6 * mw AND abs(rg) <= 0.6 * mw AND -lg <= 0.22 * w AND -rg <= 0.22 * w AND cx - p.c <= 1.55 * mw AND q.c - cx <= 1.55 * mw THEN lift + abs(lg) / mw + abs(rg) / mw END
      WHEN p IS NULL THEN CASE WHEN abs(rg) <= 0.28 * mw AND -rg <= 0.22 * w AND q.c - cx <= 1.55 * mw THEN lift + abs(rg) / mw + 0.15 END
      WHEN NOT contains('。！？!?；;', p.ch) AND abs(lg) <= 0.28 * mw AND -lg <= 0.22 * w AND cx - p.c <= 1.55 * mw THEN lift + abs(lg) / mw + 0.15 END AS score FROM z),
w AS (SELECT *, CASE WHEN q IS NULL THEN last + 1 ELSE q.pos END AS ins, row_number() OVER (PARTITION BY page, block, glyph_id ORDER BY score, hb, hl) AS nth FROM c WHERE score IS NOT NULL),
x AS (SELECT w.glyph_id, hb, hl, w.ins, round(score, 6) AS score, w.char AS stray, string_agg(s.char, '' ORDER BY s.pos) FILTER (s.pos < w.ins) AS l, string_agg(s.char, '' ORDER BY s.pos) FILTER (s.pos >= w.ins) AS r
      FROM w LEFT JOIN o s ON s.page = w.page AND s.block = w.hb AND s.pos BETWEEN w.ins - 4 AND w.ins + 3 WHERE nth = 1 GROUP BY ALL)
SELECT glyph_id, hb AS host_block, hl AS host_line, CAST(ins AS INTEGER) AS insert_before, score, concat(l, stray, r) AS context FROM x""")
def microblock_fusion(spark: SparkSession, d: str) -> DataFrame:
    placed = layout.cut(layout.ordered(glyphs(spark, d)))
    found = layout.fused_context(placed, layout.fuse(placed), 4)
    return found.select("glyph_id", "host_block", "host_line", "insert_before", F.round("score", 6).alias("score"), "context")


@query(f"""
WITH RECURSIVE g AS ({_SQL}),
b AS (SELECT page, block FROM g GROUP BY ALL HAVING count(*) = 1),
n AS (SELECT g.page, g.block, glyph_id AS id, char, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, x1 - x0 AS w, y1 - y0 AS h, greatest(x1 - x0, y1 - y0) AS s FROM g JOIN b USING (page, block) WHERE wmode = 0),
e AS (SELECT s.id AS src, n.* FROM n s JOIN n ON n.page = s.page AND n.w / s.w BETWEEN 0.55 AND 1.8 AND n.h / s.h BETWEEN 0.55 AND 1.8 AND sqrt((n.x - s.x) * (n.x - s.x) + (n.y - s.y) * (n.y - s.y)) <= 9.0 * s.s),
k AS (SELECT a.src, a.id AS a, b.id AS b FROM e a JOIN e b ON a.src = b.src AND a.id <> b.id WHERE sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) BETWEEN 0.55 * (0.5 * (a.s + b.s)) AND 1.65 * (0.5 * (a.s + b.s))),
r(src, id) AS (SELECT src, src FROM e WHERE id = src UNION SELECT r.src, k.b FROM r JOIN k ON k.src = r.src AND k.a = r.id),
c AS (SELECT e.* FROM r JOIN e ON e.src = r.src AND e.id = r.id),
z AS (SELECT src, count(*) AS n, sum(x) / count(*) AS mx, sum(y) / count(*) AS my, list_sort(list(s))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS ms FROM c GROUP BY 1 HAVING count(*) >= 4),
f AS (SELECT a.src, b.x - a.x AS dx, b.y - a.y AS dy, row_number() OVER (PARTITION BY a.src ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) DESC, a.block, b.block) AS nth FROM c a JOIN c b ON a.src = b.src AND a.block < b.block),
u AS (SELECT src, dx / sqrt(dx * dx + dy * dy) AS ux, dy / sqrt(dx * dx + dy * dy) AS uy FROM f WHERE nth = 1 AND dx * dx + dy * dy > 0),
v AS (SELECT src, CASE WHEN (CASE WHEN abs(ux) >= abs(uy) THEN ux ELSE uy END) < 0 THEN -ux ELSE ux END AS ux, CASE WHEN (CASE WHEN abs(ux) >= abs(uy) THEN ux ELSE uy END) < 0 THEN -uy ELSE uy END AS uy FROM u),
t AS (SELECT c.src, c.id, c.char, (c.x - mx) * ux + (c.y - my) * uy AS t, abs((c.x - mx) * -uy + (c.y - my) * ux) AS off, ms FROM c JOIN z USING (src) JOIN v USING (src)),
o AS (SELECT *, lead(t) OVER w - t AS gap, row_number() OVER w - 1 AS nth FROM t WINDOW w AS (PARTITION BY src ORDER BY t)),
a AS (SELECT src, string_agg(char, '' ORDER BY t) AS text, max(nth) FILTER (id = src) AS place, max(off) AS off, any_value(ms) AS ms, min(gap) AS lo, max(gap) AS hi, list_sort(list(gap) FILTER (gap IS NOT NULL))[CAST(floor((count(*) - 1) / 2) AS INTEGER) + 1] AS mid FROM o GROUP BY 1)
SELECT src AS glyph_id, text, CAST(place AS INTEGER) AS place FROM a WHERE off <= 0.42 * ms AND lo > 0 AND lo >= 0.45 * mid AND hi <= 1.85 * mid AND length(text) >= 4""")
def singleton_chains(spark: SparkSession, d: str) -> DataFrame:
    return layout.chains(glyphs(spark, d)).select("glyph_id", "text", "place")
