"""Glyph outlines drawn from ``lineitem``: an order is a glyph, a line one contour.

A line's part gives its shape and its supplier the point and direction it is drawn from;
its number is its height, its order moves the whole glyph, and some lines stand on the
tone's side. Templates are the shapes themselves and pairs of them one step apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outlines
from .tables import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


SHAPES = (
    ((0, 0, 1), (40, 0, 1), (40, 40, 1), (0, 40, 1)),
    ((0, 0, 1), (40, 0, 1), (20, 40, 1)),
    ((0, 0, 1), (40, 10, 0), (40, 50, 1), (10, 50, 0), (0, 20, 1)),
    ((0, 0, 1), (40, 0, 1), (40, 20, 1), (0, 20, 1)),
    ((0, 10, 1), (20, 0, 0), (40, 10, 1), (20, 30, 0)),
)
STEP = 90
_POINTS = ", ".join(f"({kind}, {k}, {len(s)}, {x}, {y}, {on})" for kind, s in enumerate(SHAPES) for k, (x, y, on) in enumerate(s))
_PLACED = f"""
SELECT o, i, CASE WHEN rev = 1 THEN n - 1 - (k + rot) % n ELSE (k + rot) % n END AS pos, CAST(x + 100 + o % 3 + tone * 300 AS INTEGER) AS x, CAST(y + 1000 - {STEP} * ln + o % 5 AS INTEGER) AS y, pen FROM (
  SELECT l_orderkey AS o, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS i, l_partkey % 5 AS kind, l_suppkey AS rot, l_suppkey % 2 AS rev, l_linenumber AS ln,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS tone FROM lineitem) AS l JOIN (VALUES {_POINTS}) AS p(shape, k, n, x, y, pen) ON shape = kind"""


#: A line's contour: its part's shape, turned and moved; SQL's ``_PLACED`` says the same by rows.
_SHAPED = "array(" + ", ".join("array(" + ", ".join(f"named_struct('x', {x}, 'y', {y}, 'pen', {on})" for x, y, on in shape) + ")" for shape in SHAPES) + ")"
_TONE = "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END"
_TURNED = "CASE WHEN l_suppkey % 2 = 1 THEN size(shape) - 1 - (k + l_suppkey) % size(shape) ELSE (k + l_suppkey) % size(shape) END"
_CONTOUR = f"""transform(array_sort(transform(shape, (p, k) -> struct({_TURNED} AS pos, CAST(p.x + 100 + l_orderkey % 3 + {_TONE} * 300 AS INT) AS x,
  CAST(p.y + 1000 - {STEP} * l_linenumber + l_orderkey % 5 AS INT) AS y, p.pen AS on))), p -> struct(p.x AS x, p.y AS y, p.on AS on))"""
_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def _glyphs(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem", "l_orderkey", *_ORDER, "l_returnflag", "l_linestatus").filter(f"l_partkey % 5 BETWEEN 0 AND {len(SHAPES) - 1}")
    drawn = lines.withColumn("shape", F.expr(f"element_at({_SHAPED}, CAST(l_partkey % 5 AS INT) + 1)")).withColumn("c", F.expr(_CONTOUR))
    return drawn.groupBy(F.col("l_orderkey").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*_ORDER, "c"))), lambda l: l["c"]).alias("contours"))


def _labels() -> list[tuple[str, list, str, int, bool]]:
    """Kind, contours, label, sources, seen directly."""
    moved = lambda s, dy: [(x, y + dy, on) for x, y, on in s]
    rows = [("symbol", [SHAPES[k]], "ㄅㄆㄇㄈ"[k], 2 - k // 3, k == 3) for k in range(4)]
    rows += [("symbol", [moved(SHAPES[a], STEP), SHAPES[b]], "ㄉㄊㄋㄌㄍ"[a], 2, False) for a in range(5) for b in range(5) if (a + b) % 2 == 0]
    rows += [("tone", [SHAPES[k]], "234"[k], 2, False) for k in range(3)] + [("tone", [SHAPES[3]], "2", 1, False), ("neutral", [SHAPES[3]], "neutral", 2, False)]
    return rows


def _templates(spark: SparkSession) -> DataFrame:
    kinds = "kind string, contours array<array<struct<x: int, y: int, on: int>>>, label string, support_keys int, direct boolean"
    return spark.createDataFrame(_labels(), kinds).withColumn("outline_signature", outlines.signature("contours")).drop("contours")


#: Each contour once from its own corner: the least of all its rotations in both directions.
_CYCLES = f"""
q AS ({_PLACED}),
c AS (SELECT o, i, list([x, y, pen] ORDER BY pos) AS p, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM q GROUP BY ALL),
r AS (SELECT o, i, x0, x1, y0, y1, list_transform(p, lambda z: [CAST(z[1] - x0 AS INTEGER), CAST(z[2] - y0 AS INTEGER), CAST(z[3] AS INTEGER)]) AS p FROM c),
t AS (SELECT o, i, x0, x1, y0, y1, unnest([p, list_reverse(p)]) AS p FROM r),
cyc AS (SELECT o, i, x0, x1, y0, y1, min(list_concat(p[k + 1:], p[:k])) AS c FROM (SELECT *, unnest(range(len(p))) AS k FROM t) GROUP BY ALL)"""


def _shifted(contour: str, dx: str, dy: str) -> str:
    return f"list_transform({contour}, lambda z: [CAST(z[1] + {dx} AS INTEGER), CAST(z[2] + {dy} AS INTEGER), z[3]])"


def _told(items: str) -> str:
    return f"concat('(', array_to_string({items}, ', '), CASE WHEN len({items}) = 1 THEN ',' ELSE '' END, ')')"


_POINT = "lambda z: concat('(', z[1], ', ', z[2], ', ', z[3], ')')"


@query(f"""
WITH {_CYCLES},
b AS (SELECT o, min(x0) AS l, min(y0) AS b, max(x1) - min(x0) AS w, max(y1) - min(y0) AS h FROM cyc GROUP BY 1),
s AS (SELECT o, w, h, list_sort(list({_shifted('c', '(x0 - l)', '(y0 - b)')})) AS cs FROM cyc JOIN b USING (o) GROUP BY ALL),
w AS (SELECT o, w, h, list_transform(cs, lambda c: {_told(f'list_transform(c, {_POINT})')}) AS told FROM s)
SELECT o AS key, sha1(concat('(', w, ', ', h, ', ', {_told('told')}, ')')) AS outline_signature FROM w""")
def outline_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _glyphs(spark, d).select("key", outlines.signature("contours").alias("outline_signature"))


def _folded(top: str, best: str, where: str, source: str = "SELECT o, i, y0, y1 FROM c") -> str:
    """Groups of each glyph's boxes taken one by one; ``best`` is the group's place from 1."""
    return f"""
it AS (SELECT o, i, y0, y1, row_number() OVER (PARTITION BY o ORDER BY {top}, i) AS nth FROM ({source}) {where}),
f(o, nth, g) AS (
  SELECT DISTINCT o, 0::BIGINT, []::STRUCT(y0 INTEGER, y1 INTEGER, m INTEGER[])[] FROM it
  UNION ALL SELECT x.o, x.nth, CASE WHEN b IS NULL THEN list_append(g, struct_pack(y0 := y0, y1 := y1, m := [i])) ELSE list_transform(g, lambda q, k: CASE WHEN k = b THEN struct_pack(y0 := least(q.y0, y0), y1 := greatest(q.y1, y1), m := list_append(q.m, i)) ELSE q END) END
  FROM (SELECT f.o, it.nth, f.g, it.i, it.y0, it.y1, {best} AS b FROM f JOIN it ON it.o = f.o AND it.nth = f.nth + 1) x)"""


_STACK_BEST = """list_aggregate(list_transform(f.g, lambda q, k: CASE WHEN least(it.y1, q.y1) - greatest(it.y0, q.y0) > greatest(5.0, 0.15 * least(greatest(1, it.y1 - it.y0), greatest(1, q.y1 - q.y0))) THEN struct_pack(s := least(it.y1, q.y1) - greatest(it.y0, q.y0), k := -k) END), 'max')"""
_BAND_BEST = """list_aggregate(list_transform(f.g, lambda q, k: CASE WHEN greatest(0, least(it.y1, q.y1) - greatest(it.y0, q.y0)) >= 0.45 * least(greatest(it.y1 - it.y0, 1), greatest(q.y1 - q.y0, 1)) OR abs((it.y0 + it.y1) / 2 - (q.y0 + q.y1) / 2) <= 0.22 * greatest(it.y1 - it.y0, q.y1 - q.y0, 1)
  THEN struct_pack(s := greatest(0, least(it.y1, q.y1) - greatest(it.y0, q.y0)) / greatest(1, least(it.y1 - it.y0, q.y1 - q.y0)), d := -abs((it.y0 + it.y1) / 2 - (q.y0 + q.y1) / 2), k := k) END), 'max')"""


def _listed(key: str) -> str:
    return f"list_sort(list_transform(g, lambda q, k: struct_pack(key := {key}, k := k, m := q.m)))"


_LAST = "l AS (SELECT f.* FROM f JOIN (SELECT o, max(nth) AS n FROM it GROUP BY 1) e ON e.o = f.o AND f.nth = e.n)"
_TEXT = "array_to_string(list_transform({x}, lambda s: array_to_string(s.m, '+')), ' ')"


@query(f"WITH RECURSIVE {_CYCLES}, {_folded('-y1', f'-{_STACK_BEST}.k', '')}, {_LAST} SELECT o AS key, {_TEXT.format(x=_listed('-q.y1'))} AS stacks FROM l")
def stacked_contours(spark: SparkSession, d: str) -> DataFrame:
    found = _glyphs(spark, d).select("key", outlines.stacks("contours").alias("s"))
    return found.select("key", F.array_join(F.transform("s", lambda m: F.array_join(m.cast("array<string>"), "+")), " ").alias("stacks"))


_TONED = "n AS (SELECT o, CASE WHEN count(*) FILTER ((x0 + x1) / 2 > 330) = 1 THEN max(i) FILTER ((x0 + x1) / 2 > 330) END AS tone FROM c GROUP BY 1)"
_BANDS = f"{_CYCLES}, {_TONED}, {_folded('-(y0 + y1) / 2', f'{_BAND_BEST}.k', '', 'SELECT c.o, i, y0, y1 FROM c JOIN n ON n.o = c.o AND i IS DISTINCT FROM tone')}, {_LAST}"


@query(f"WITH RECURSIVE {_BANDS} SELECT n.o AS key, tone AS tone_at, coalesce({_TEXT.format(x=_listed('-(q.y0 + q.y1) / 2'))}, '') AS bands FROM n LEFT JOIN l USING (o)")
def outline_bands(spark: SparkSession, d: str) -> DataFrame:
    split = _glyphs(spark, d).withColumn("tone_at", outlines.tone_contour("contours"))
    split = split.withColumn("b", outlines.bands("contours", "coalesce(tone_at, -1)"))
    return split.select("key", "tone_at", F.array_join(F.transform("b", lambda m: F.array_join(m.cast("array<string>"), "+")), " ").alias("bands"))


def _template_sql() -> str:
    """Templates with their outlines, written out; only those that count."""
    rows = [(kind, repr(outlines.outline(contours)).replace("'", ""), label) for kind, contours, label, n, direct in _labels() if n >= 2 or direct]
    return ", ".join(f"('{kind}', '{told}', '{label}')" for kind, told, label in rows)


@query(f"""
WITH RECURSIVE {_BANDS}, v(kind, sig, label) AS (VALUES {_template_sql()}),
g AS (SELECT n.o, tone, coalesce({_listed('-(q.y0 + q.y1) / 2')}, []) AS s FROM n LEFT JOIN l USING (o)),
a AS (SELECT o, 'symbol' AS kind, i, j, flatten(list_transform(s[i + 1:j], lambda x: x.m)) AS m FROM (SELECT o, s, i, unnest(range(i + 1, CASE WHEN len(s) <= 9 THEN len(s) ELSE i + 1 END + 1)) AS j FROM (SELECT o, s, unnest(range(len(s))) AS i FROM g))
      UNION ALL SELECT o, 'tone', -1, -1, [tone] FROM g WHERE tone IS NOT NULL),
p AS (SELECT a.o, a.kind, a.i, a.j, cyc.x0, cyc.x1, cyc.y0, cyc.y1, cyc.c FROM (SELECT *, unnest(m) AS mi FROM a) a JOIN cyc ON cyc.o = a.o AND cyc.i = mi),
b AS (SELECT o, kind, i, j, min(x0) AS l, min(y0) AS b, max(x1) - min(x0) AS w, max(y1) - min(y0) AS h FROM p GROUP BY ALL),
s AS (SELECT o, kind, i, j, w, h, list_sort(list({_shifted('c', '(x0 - l)', '(y0 - b)')})) AS cs FROM p JOIN b USING (o, kind, i, j) GROUP BY ALL),
w AS (SELECT o, kind, i, j, w, h, list_transform(cs, lambda c: {_told(f'list_transform(c, {_POINT})')}) AS told FROM s),
z AS (SELECT o, kind, i, j, concat('(', w, ', ', h, ', ', {_told('told')}, ')') AS sig FROM w),
y AS (SELECT o, i, j, label FROM z JOIN v USING (sig) WHERE z.kind = 'symbol' AND v.kind = 'symbol'),
u AS (SELECT g.o, len(s) AS n, g.tone IS NOT NULL AS toned, (SELECT max(label) FROM z JOIN v USING (sig) WHERE z.o = g.o AND z.kind = 'tone' AND v.kind = 'tone') AS mark,
      CASE WHEN EXISTS (SELECT 1 FROM z JOIN v USING (sig) WHERE z.o = g.o AND i = 0 AND j = 1 AND v.kind = 'neutral') THEN 1 ELSE 0 END AS first FROM g),
k AS (SELECT y.o, label AS t, 1 AS parts, i, j, i AS a FROM y UNION ALL SELECT k.o, concat(t, label), parts + 1, y.i, y.j, a FROM k JOIN y ON y.o = k.o AND y.i = k.j WHERE parts < 3),
e AS (SELECT u.o, count(DISTINCT t) AS ways, min(t) AS t, min(t) FILTER (parts = n - first) AS direct FROM u JOIN k ON k.o = u.o AND k.a = first AND k.j = n WHERE n - first <= 8 GROUP BY 1),
x AS (SELECT u.*, ways, CASE WHEN n - first <= 3 AND direct IS NOT NULL THEN direct WHEN ways = 1 THEN t END AS base, n - first <= 3 AND direct IS NOT NULL AS is_direct,
      CASE WHEN n = 0 THEN 'no_symbol_groups' WHEN n = first THEN 'neutral_without_base' WHEN first = 1 AND toned THEN 'neutral_plus_right_tone' WHEN toned AND mark IS NULL THEN 'unknown_tone_signature' WHEN n - first > 8 THEN 'partition_bad_group_count' END AS stopped FROM u LEFT JOIN e USING (o)),
d AS (SELECT *, coalesce(stopped, CASE WHEN base IS NOT NULL THEN 'ok' WHEN ways IS NULL THEN 'partition_unknown_symbol' ELSE 'partition_multiple_readings' END) AS why FROM x)
SELECT o AS key, CASE WHEN why = 'ok' THEN CASE WHEN first = 1 THEN concat('˙', base) ELSE concat(base, CASE mark WHEN '2' THEN 'ˊ' WHEN '3' THEN 'ˇ' WHEN '4' THEN 'ˋ' ELSE '' END) END END AS reading, why AS reason,
       CASE WHEN why = 'ok' THEN CASE WHEN is_direct THEN 'direct_bands' ELSE 'partitioned_bands' END END AS mode FROM d""")
def recombined_readings(spark: SparkSession, d: str) -> DataFrame:
    return outlines.recombine(_glyphs(spark, d), _templates(spark))
