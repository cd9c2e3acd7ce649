"""The second look of the expected lane, with lines, page orders and rules made from ``events``.

Sixty events are a page; its lines are cut into pieces of one to five. Two neighbours on
a page that occur together often enough in the corpus are a rule for the first of them,
stronger the more often, so many rules only fit in the order of the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import expected
from .tables import read

QUERIES: dict = {}
ORACLES: dict = {}

CHARS = "甲乙丙丁戊己庚辛壬癸"
READINGS = ("ㄅㄚ", "ㄆㄛˊ", "ㄇㄧˇ")
LEAST_PAIRS, RADIUS = 3, 4


def layout_rescue(spark: SparkSession, d: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    page, at = F.expr("event_id div 60"), F.expr("event_id div 12")
    rows = read(spark, d, "events", "event_id", "props").select("event_id", page.alias("page"), at.alias("row"), (k % 10).alias("c"))
    rows = rows.withColumns({"char": F.substring(F.lit(CHARS), F.col("c") + 1, F.lit(1)), "piece": F.expr("event_id % 12 div (1 + row % 5)")})
    w, line = Window.partitionBy("page").orderBy("event_id"), Window.partitionBy("row", "piece").orderBy("event_id")
    whole = lambda w: F.array_join(F.collect_list("char").over(w), "")
    rows = rows.withColumns({
        "line": whole(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "pos": F.row_number().over(line) - 1, "fallback": whole(w.rowsBetween(-RADIUS, RADIUS)),
        "fallback_pos": F.least(F.row_number().over(w) - 1, F.lit(RADIUS)), "next": F.lead("char").over(w), "nc": F.lead("c").over(w),
    })
    pairs = rows.filter("next IS NOT NULL AND next <> char").groupBy("char", "next", "c", "nc").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_PAIRS)
    rules = pairs.select(
        F.concat("char", "next").alias("rule_id"), F.least(80 + F.col("n") + (F.col("c") * 7 + F.col("nc")) % 60, F.lit(160)).cast("int").alias("priority"), F.when((F.col("c") + F.col("nc")) % 4 == 0, "derived").otherwise("exact").alias("mode"), F.col("char").alias("target_char"),
        F.concat("char", "next").alias("phrase"), F.get(F.array(*map(F.lit, READINGS)), (F.col("c") + 2 * F.col("nc")) % 3).alias("expected_reading"), F.array().cast("array<string>").alias("excluded_phrases"),
    )
    evidence = expected.Evidence(rules, spark.createDataFrame([], "word string, primary array<string>"), spark.createDataFrame([], "char string, reading string"))
    occ = rows.select(F.col("event_id").alias("occurrence_id"), "line", F.col("pos").cast("int").alias("pos"), "char", "fallback", F.col("fallback_pos").cast("int").alias("fallback_pos"))
    return expected.rescued(occ, evidence).select("occurrence_id", "reading", "basis", "strength", "rescued")


QUERIES["layout_rescue"] = layout_rescue
ORACLES["layout_rescue"] = f"""
WITH e AS (SELECT event_id AS id, event_id // 60 AS page, event_id // 12 AS row, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) % 10 AS c FROM events),
l AS (SELECT *, (id % 12) // (1 + row % 5) AS piece FROM e),
n AS (SELECT *, lead(c) OVER (PARTITION BY page ORDER BY id) AS nc, lead(c) OVER (PARTITION BY row, piece ORDER BY id) AS lc, count(*) OVER (PARTITION BY row, piece) AS size, row_number() OVER (PARTITION BY row, piece ORDER BY id) - 1 AS pos FROM l),
r AS (SELECT c, nc, least(80 + count(*) + (c * 7 + nc) % 60, 160) AS strength, CASE WHEN (c + nc) % 4 = 0 THEN 'derived' ELSE 'exact' END AS mode, list_extract({list(READINGS)}, (c + 2 * nc) % 3 + 1) AS reading FROM n WHERE nc <> c GROUP BY c, nc HAVING count(*) >= {LEAST_PAIRS}),
f AS (SELECT n.*, a.reading AS r1, a.mode AS m1, a.strength AS s1, b.reading AS r2, b.mode AS m2, b.strength AS s2 FROM n LEFT JOIN r a ON a.c = n.c AND a.nc = n.lc LEFT JOIN r b ON b.c = n.c AND b.nc = n.nc),
g AS (SELECT *, r1 IS NULL AND r2 IS NOT NULL AND m2 = 'exact' AND s2 >= 95 AND (size <= 3 OR pos = 0 OR pos = size - 1) AS rescued FROM f)
SELECT id AS occurrence_id, CASE WHEN rescued THEN r2 ELSE r1 END AS reading, CASE WHEN rescued THEN m2 WHEN r1 IS NULL THEN 'none' ELSE m1 END AS basis, CAST(CASE WHEN rescued THEN s2 ELSE s1 END AS INTEGER) AS strength, rescued FROM g"""
