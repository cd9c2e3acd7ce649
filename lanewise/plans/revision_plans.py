"""Two editions of pages made from ``events``: twelve events are an old page.

The new edition drops, changes and empties some, and starts three pages later; some
pages of both say the same, some have labels, and some labels occur twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import revision
from .tables import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


_PER_PAGE = 12


def _character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "utf-32")


def _edition(spark: SparkSession, d: str, new: bool) -> DataFrame:
    rows = read(spark, d, "events", "event_id", "props")
    page, at = F.floor(F.col("event_id") / _PER_PAGE), (F.col("event_id") % _PER_PAGE).cast("int")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    rows = rows.select("event_id", k.alias("k"))  # read once, not in each branch
    code = F.when(page % 40 == 7, 19968 + at).when(page % 40 == 8, 20000 + at % 5).otherwise(20100 + F.col("k"))
    empty = page % 31 == 4
    if new:
        rows = rows.filter(F.col("event_id") % 13 != 5)
        code = F.when((F.col("event_id") % 17 == 3) & (page % 40 != 7), code + 200).otherwise(code)
        empty = page % 29 == 11
    rows = rows.withColumn("code", code)
    rows = rows.select((page + (3 if new else 0)).alias("page"), at.alias("source_row_number"), F.when(empty, "").otherwise(_character(code)).alias("char"))
    first = F.col("page") - (3 if new else 0)
    label = F.when(first % 5 == 0, (first % 400).cast("string"))
    return revision.pages(rows.withColumns({"pdf_order": F.floor(F.col("page") / 100).cast("int"), "label": label}))


_BASE = """
e AS (SELECT event_id, event_id // 12 AS p, CAST(event_id % 12 AS INTEGER) AS i, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events),
c AS (SELECT *, CASE WHEN p % 40 = 7 THEN 19968 + i WHEN p % 40 = 8 THEN 20000 + i % 5 ELSE 20100 + k END AS code FROM e),
o AS (SELECT p AS page, string_agg(CASE WHEN p % 31 = 4 THEN '' ELSE chr(code) END, '' ORDER BY i) AS t FROM c GROUP BY 1),
n AS (SELECT p + 3 AS page, string_agg(CASE WHEN p % 29 = 11 THEN '' WHEN event_id % 17 = 3 AND p % 40 <> 7 THEN chr(code + 200) ELSE chr(code) END, '' ORDER BY i) AS t FROM c WHERE event_id % 13 <> 5 GROUP BY 1),
op AS (SELECT row_number() OVER (ORDER BY page) - 1 AS k, t, CASE WHEN page % 5 = 0 THEN page % 400 END AS label FROM o),
np AS (SELECT row_number() OVER (ORDER BY page) - 1 AS k, t, CASE WHEN (page - 3) % 5 = 0 THEN (page - 3) % 400 END AS label FROM n),
lp AS (SELECT a.k AS o, b.k AS n, a.t AS a, b.t AS b FROM (SELECT label, min(k) AS k, min(t) AS t FROM op WHERE label IS NOT NULL GROUP BY 1 HAVING count(*) = 1) a
       JOIN (SELECT label, min(k) AS k, min(t) AS t FROM np WHERE label IS NOT NULL GROUP BY 1 HAVING count(*) = 1) b ON a.label = b.label),
ot AS (SELECT DISTINCT t FROM op WHERE t <> ''), nt AS (SELECT DISTINCT t FROM np WHERE t <> ''),
oc AS (SELECT t, c, count(*) AS m FROM (SELECT t, unnest(string_split(t, '')) AS c FROM ot) GROUP BY ALL),
nc AS (SELECT t, c, count(*) AS m FROM (SELECT t, unnest(string_split(t, '')) AS c FROM nt) GROUP BY ALL),
cand AS (SELECT a.t AS a, b.t AS b FROM oc a JOIN nc b ON a.c = b.c GROUP BY ALL HAVING 2 * sum(least(a.m, b.m)) / (length(a.t) + length(b.t)) >= 0.72),
texts AS (SELECT row_number() OVER () AS id, a, b, CAST(length(a) AS INTEGER) AS la, CAST(length(b) AS INTEGER) AS lb FROM (SELECT a, b FROM cand UNION SELECT a, b FROM lp)),
runs AS (SELECT id, i, j, max(z) AS s FROM (SELECT id, a, b, la, lb, unnest(range(0, la)) AS i FROM texts) x, (SELECT unnest(range(0, 12)) AS j), (SELECT unnest(range(1, 13)) AS z)
         WHERE i + z <= la AND j + z <= lb AND substring(a, i + 1, z) = substring(b, j + 1, z) GROUP BY ALL),
parts(id, a0, a1, b0, b1, size) AS (
  SELECT id, 0, la, 0, lb, 0 FROM texts
  UNION ALL SELECT id, u[1], u[2], u[3], u[4], u[5] FROM (SELECT id, unnest([[a0, -m.i, b0, -m.j, m.s], [m.s - m.i, a1, m.s - m.j, b1, 0]]) AS u FROM (
    SELECT q.id, a0, a1, b0, b1, max(struct_pack(s := CAST(least(s, a1 - i, b1 - j) AS INTEGER), i := CAST(-i AS INTEGER), j := CAST(-j AS INTEGER))) AS m FROM parts q JOIN runs r ON r.id = q.id AND i >= a0 AND i < a1 AND j >= b0 AND j < b1 WHERE a1 > a0 AND b1 > b0 GROUP BY ALL))),
ratio AS (SELECT a, b, CASE WHEN la + lb = 0 THEN 1.0 ELSE 2.0 * sum(size) / (la + lb) END AS score FROM parts JOIN texts USING (id) GROUP BY id, a, b, la, lb),
labelled AS (SELECT o, n, score FROM lp JOIN ratio r ON r.a = lp.a AND r.b = lp.b WHERE score >= 0.35),
ranked AS (SELECT op.k AS o, np.k AS n, score, row_number() OVER (ORDER BY score DESC, abs(op.k - np.k), op.k DESC, np.k DESC) AS nth FROM ratio r JOIN op ON op.t = r.a JOIN np ON np.t = r.b
           WHERE score >= 0.72 AND r.a <> '' AND r.b <> '' AND op.k NOT IN (SELECT o FROM labelled) AND np.k NOT IN (SELECT n FROM labelled)),
picked(nth, ok, uo, un) AS (
  SELECT 0::BIGINT, false, []::BIGINT[], []::BIGINT[]
  UNION ALL SELECT r.nth, NOT list_contains(uo, r.o) AND NOT list_contains(un, r.n), CASE WHEN list_contains(uo, r.o) OR list_contains(un, r.n) THEN uo ELSE list_append(uo, r.o) END, CASE WHEN list_contains(uo, r.o) OR list_contains(un, r.n) THEN un ELSE list_append(un, r.n) END
  FROM picked p JOIN ranked r ON r.nth = p.nth + 1)"""


@query(f"""
WITH RECURSIVE {_BASE} SELECT o AS old_number, n AS new_number, round(score, 6) AS score, 'label' AS how FROM labelled
UNION ALL SELECT o, n, round(score, 6), 'content' FROM ranked JOIN picked USING (nth) WHERE ok""")
def page_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = revision.pair(_edition(spark, d, False), _edition(spark, d, True))
    return found.select("old_number", "new_number", F.round("score", 6).alias("score"), "how")
