"""Dedupe, unanimity, cascades, priorities, promotion, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import keyed
from .tables import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem)
WHERE rn = 1""")
def visible_layer_argmax(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    return keyed.argmax_dedupe(rows, ["l_orderkey", "l_linenumber"], ["l_extendedprice", "l_partkey", "l_suppkey"])


@query("""
WITH e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, CAST(floor(value / 10) AS BIGINT) AS band FROM events),
k AS (SELECT user_id, event_type, day, min(band) = max(band) AS one, max(event_id) AS last FROM e GROUP BY ALL)
SELECT event_id, user_id, event_type, CAST(day AS VARCHAR) AS day, band FROM e JOIN k USING (user_id, event_type, day) WHERE NOT one OR event_id = last""")
def hidden_duplicate_keep_last(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").cast("string").alias("day"), F.floor(F.col("value") / 10).alias("band"))
    return keyed.keep_last_if_unanimous(rows, ["user_id", "event_type", "day"], "band", "event_id")


@query("""
SELECT l_partkey, l_suppkey, min(l_linestatus) AS reading, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING min(l_linestatus) = max(l_linestatus)""")
def unanimous_map(spark: SparkSession, d: str) -> DataFrame:
    found = keyed.unanimous(read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_linestatus"), ["l_partkey", "l_suppkey"], "l_linestatus")
    return found.filter("resolved IS NOT NULL").select("l_partkey", "l_suppkey", F.col("resolved").alias("reading"), "n")


@query("""
SELECT l_partkey, l_suppkey, string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) AS conflicting FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_linestatus) > 1""")
def unanimous_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return keyed.conflicts(read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_linestatus"), ["l_partkey", "l_suppkey"], "l_linestatus")


@query("""
WITH nation_layer AS (SELECT n_nationkey AS k, 'N' || n_nationkey AS v FROM nation WHERE n_nationkey % 4 = 0),
region_layer AS (SELECT r_regionkey AS k, 'R' || r_regionkey AS v FROM region WHERE r_regionkey IN (0, 2) UNION ALL SELECT r_regionkey, 'X' || r_regionkey FROM region WHERE r_regionkey = 2),
r AS (SELECT k, min(v) AS lo, max(v) AS hi FROM region_layer GROUP BY k)
SELECT c_custkey, CASE WHEN n.v IS NOT NULL THEN n.v WHEN r.k IS NOT NULL THEN CASE WHEN r.lo = r.hi THEN r.lo END ELSE 'G' END AS tier,
       CASE WHEN n.v IS NOT NULL THEN 'nation' WHEN r.k IS NOT NULL THEN CASE WHEN r.lo = r.hi THEN 'region' ELSE 'region:conflict' END ELSE 'global' END AS basis
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN nation_layer n ON n.k = c_nationkey LEFT JOIN r ON r.k = n_regionkey""")
def cascade_first_hit(spark: SparkSession, d: str) -> DataFrame:
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    people = read(spark, d, "customer", "c_custkey", "c_nationkey").join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey")), "c_nationkey").withColumn("everyone", F.lit(1))
    by_nation = nation.filter("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("N"), "n_nationkey").alias("v"))
    by_region = region.filter("r_regionkey IN (0, 2)").select("r_regionkey", F.concat(F.lit("R"), "r_regionkey").alias("v"))
    by_region = by_region.unionByName(region.filter("r_regionkey = 2").select("r_regionkey", F.concat(F.lit("X"), "r_regionkey").alias("v")))
    overall = spark.range(1).select(F.lit(1).alias("everyone"), F.lit("G").alias("v"))
    layers = [("nation", by_nation, ["c_nationkey"], "v"), ("region", by_region, ["r_regionkey"], "v"), ("global", overall, ["everyone"], "v")]
    return keyed.first_hit(people, layers, "tier").select("c_custkey", "tier", "basis")


@query("""
WITH c AS (
  SELECT p_partkey, 'exact' AS mode, 100 AS priority, length(p_brand) AS len, substr(p_type, 1, 1) AS reading FROM part WHERE p_size <= 25
  UNION ALL SELECT p_partkey, 'exact', 100, length(p_type), substr(p_name, 1, 1) FROM part WHERE p_size >= 15
  UNION ALL SELECT p_partkey, 'derived', CASE WHEN p_retailprice > 1000 THEN 110 ELSE 90 END, 1, 'D' FROM part
  UNION ALL SELECT p_partkey, 'derived', 110, 1, 'E' FROM part WHERE p_size % 10 = 0),
t AS (SELECT *, max(priority) OVER (PARTITION BY p_partkey) AS top, count(*) OVER (PARTITION BY p_partkey) AS n FROM c),
x AS (SELECT *, max(CASE WHEN mode = 'exact' THEN len END) OVER (PARTITION BY p_partkey) AS longest FROM t WHERE priority = top),
k AS (SELECT * FROM x WHERE longest IS NULL OR (mode = 'exact' AND len = longest))
SELECT p_partkey, min(n) AS n_candidates, CASE WHEN count(DISTINCT reading) = 1 THEN min(reading) END AS reading,
       CASE WHEN count(DISTINCT reading) > 1 THEN string_agg(DISTINCT reading, '|' ORDER BY reading) END AS conflicting
FROM k GROUP BY p_partkey""")
def priority_resolution(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    rule = lambda when, mode, priority, length, reading: F.when(when, F.struct(F.lit(mode).alias("mode"), priority.cast("int").alias("priority"), length.cast("int").alias("length"), reading.alias("reading")))
    rules = F.array(
        rule(F.col("p_size") <= 25, "exact", F.lit(100), F.length("p_brand"), F.substring("p_type", 1, 1)),
        rule(F.col("p_size") >= 15, "exact", F.lit(100), F.length("p_type"), F.substring("p_name", 1, 1)),
        rule(F.lit(True), "derived", F.when(F.col("p_retailprice") > 1000, 110).otherwise(90), F.lit(1), F.lit("D")),
        rule(F.col("p_size") % 10 == 0, "derived", F.lit(110), F.lit(1), F.lit("E")),
    )
    candidates = part.select("p_partkey", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("p_partkey", "r.*")
    return keyed.resolve_by_priority(candidates, ["p_partkey"])


@query("""
SELECT o_orderkey, count(*) AS n_lines, CASE WHEN count(*) = count(p.p_partkey) THEN string_agg(DISTINCT p_type, ',' ORDER BY p_type) ELSE '' END AS decoded
FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) p ON p.p_partkey = l_partkey GROUP BY 1""")
def lookup_all_elements(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "orders", "o_orderkey").join(read(spark, d, "lineitem", "l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    allowed = read(spark, d, "part", "p_partkey", "p_type", "p_size").filter("p_size <= 40").drop("p_size")
    found = lines.join(allowed, F.col("l_partkey") == F.col("p_partkey"), "left")
    names = F.array_join(F.array_sort(F.collect_set("p_type")), ",")
    return found.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.when(F.count(F.lit(1)) == F.count("p_partkey"), names).otherwise("").alias("decoded"))


@query("""
SELECT l_partkey, max(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS view_a, max(CASE WHEN l_returnflag = 'A' THEN l_suppkey END) AS view_b,
       CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) = max(CASE WHEN l_returnflag = 'A' THEN l_suppkey END) THEN max(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) END AS agreed
FROM lineitem GROUP BY 1""")
def dual_view_agreement(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_returnflag")
    a, b = (F.max(F.when(F.col("l_returnflag") == flag, F.col("l_suppkey"))) for flag in "RA")
    views = lines.groupBy("l_partkey").agg(a.alias("view_a"), b.alias("view_b"))
    return views.withColumn("agreed", F.when(F.col("view_a") == F.col("view_b"), F.col("view_a")))


@query("""
WITH k AS (SELECT l_partkey, l_suppkey, CASE WHEN min(l_linestatus) = max(l_linestatus) AND count(*) = count(l_linestatus) THEN min(l_linestatus) END AS promoted, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT * FROM k WHERE promoted IS NOT NULL""")
def promotion_all_equal(spark: SparkSession, d: str) -> DataFrame:
    return keyed.promote_if_all_equal(read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_linestatus"), ["l_partkey", "l_suppkey"], "l_linestatus")


@query("""
WITH f AS (SELECT l_partkey, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS o, count(*) AS c FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY o, l_suppkey) AS rn FROM f)
SELECT l_partkey, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_distinct, string_agg(CASE WHEN rn <= 20 THEN CAST(l_suppkey AS VARCHAR) END, ',' ORDER BY rn) AS firsts FROM r GROUP BY 1""")
def key_rollup_bounded(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return keyed.rollup(lines, ["l_partkey"], "l_suppkey", "o", 20)


@query("""
WITH b AS (SELECT event_id, sha256(user_id || '|' || event_type) AS base FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY event_id) AS k FROM b)
SELECT event_id, base, CASE WHEN k = 1 THEN base ELSE sha256(base || '|' || k) END AS occurrence FROM r""")
def collision_rehash(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events", "event_id", "user_id", "event_type").select("event_id", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256).alias("base"))
    return keyed.collision_ids(rows, "base", ["event_id"], "occurrence")


@query("""
WITH x AS (SELECT DISTINCT l_partkey, l_suppkey, s_nationkey, l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
p AS (SELECT a.l_partkey, a.l_suppkey AS first_id, b.l_suppkey AS second_id FROM x a JOIN x b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey AND a.s_nationkey <> b.s_nationkey AND a.l_orderkey <> b.l_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY first_id, second_id) AS n FROM p)
SELECT l_partkey, first_id, second_id FROM r WHERE n = 1""")
def quorum_first_pair(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_orderkey").join(read(spark, d, "supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return keyed.first_differing_pair(lines, ["l_partkey"], "l_suppkey", ["s_nationkey", "l_orderkey"])


@query("""
WITH s AS (SELECT source, lang, count(DISTINCT doc_id) AS docs, max(n_chars) AS widest, count(DISTINCT doc_id % 2) AS n_labels, min(doc_id % 2) AS label FROM documents GROUP BY 1, 2)
SELECT source, lang, docs, widest, (docs >= 2 OR widest >= 5000) AND n_labels = 1 AS accepted, CASE WHEN n_labels = 1 THEN label END AS label FROM s""")
def evidence_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents", "source", "lang", "doc_id", "n_chars").withColumn("mark", F.col("doc_id") % 2)
    found = rows.groupBy("source", "lang").agg(F.count_distinct("doc_id").alias("docs"), F.max("n_chars").alias("widest"), F.min("mark").alias("lo"), F.max("mark").alias("hi"))
    one = F.col("lo") == F.col("hi")
    return found.select("source", "lang", "docs", "widest", (((F.col("docs") >= 2) | (F.col("widest") >= 5000)) & one).alias("accepted"), F.when(one, F.col("lo")).alias("label"))


@query("""
WITH have AS (SELECT p_brand, p_type, CASE WHEN min(p_size) = max(p_size) THEN min(p_size) END AS own FROM part WHERE p_size % 5 = 0 AND p_partkey % 3 = 0 GROUP BY 1, 2),
allv AS (SELECT p_type, min(own) AS lo, max(own) AS hi FROM have WHERE own IS NOT NULL GROUP BY 1),
used AS (SELECT DISTINCT p_brand, p_type FROM part)
SELECT u.p_brand, u.p_type, coalesce(h.own, CASE WHEN a.lo = a.hi THEN a.lo END) AS label, CASE WHEN h.own IS NOT NULL THEN 'own' WHEN a.lo = a.hi THEN 'propagated' ELSE 'none' END AS basis
FROM used u LEFT JOIN have h ON u.p_brand = h.p_brand AND u.p_type = h.p_type LEFT JOIN allv a ON u.p_type = a.p_type""")
def propagate_unanimous(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part", "p_brand", "p_type", "p_size", "p_partkey")
    own = keyed.unanimous(part.filter("p_size % 5 = 0 AND p_partkey % 3 = 0"), ["p_brand", "p_type"], "p_size").select("p_brand", "p_type", F.col("resolved").alias("own"))
    shared = keyed.unanimous(own.filter("own IS NOT NULL"), ["p_type"], "own").select("p_type", F.col("resolved").alias("shared"))
    rows = part.select("p_brand", "p_type").distinct().join(own, ["p_brand", "p_type"], "left").join(shared, "p_type", "left")
    basis = F.when(F.col("own").isNotNull(), "own").when(F.col("shared").isNotNull(), "propagated").otherwise("none")
    return rows.select("p_brand", "p_type", F.coalesce("own", "shared").alias("label"), basis.alias("basis"))


@query("""
SELECT c_custkey, count(o_orderkey) AS members, sha256(coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '')) AS snapshot
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def group_snapshot_hash(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders", "o_custkey", "o_orderkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("m"), F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("ids"))
    rows = read(spark, d, "customer", "c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("m", F.lit(0)).alias("members"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("snapshot"))


@query("""
WITH r AS (SELECT doc_id, quality, toxic, (row_number() OVER (ORDER BY doc_id) - 1) % 5 AS fold FROM labels),
p AS (SELECT fold, count(*) AS n, count(*) FILTER (quality = 1) AS predicted, count(*) FILTER (quality = 1 AND toxic = 0) AS right_ones FROM r GROUP BY 1)
SELECT fold, n, predicted, round(CAST(right_ones AS DOUBLE) / nullif(predicted, 0), 6) AS precision_, round(CAST(predicted AS DOUBLE) / n, 6) AS coverage FROM p""")
def kfold_split_metrics(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "labels", "doc_id", "quality", "toxic")
    # the global rank: rows before a block of ranges, before a range in its block, and before a row in its range
    span, block = F.floor(F.col("doc_id") / 1024), F.floor(F.col("doc_id") / (1024 * 65_536))
    cells = labels.groupBy(block.alias("block"), span.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    blocks = cells.groupBy("block").agg(F.sum("c").alias("b"))  # one row for 67 million ids
    earlier = lambda w: F.coalesce(F.sum(w[0]).over(w[1].rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = cells.withColumn("inner", earlier(("c", Window.partitionBy("block").orderBy("cell")))).join(blocks.select("block", earlier(("b", Window.orderBy("block"))).alias("outer")), "block")
    ranked = labels.withColumn("cell", span).join(bases.select("cell", (F.col("inner") + F.col("outer")).alias("base")), "cell")
    ranked = ranked.withColumn("fold", (F.col("base") + F.row_number().over(Window.partitionBy("cell").orderBy("doc_id")) - 1) % 5)
    found = ranked.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("predicted"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("k"))
    return found.select("fold", "n", "predicted", F.round(F.try_divide(F.col("k").cast("double"), F.col("predicted").cast("double")), 6).alias("precision_"), F.round(F.col("predicted").cast("double") / F.col("n"), 6).alias("coverage"))


@query("""
SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, count(*) FILTER (l_returnflag = 'A') AS flag_a, count(*) FILTER (l_returnflag = 'N') AS flag_n, count(*) FILTER (l_returnflag = 'R') AS flag_r FROM lineitem GROUP BY 1""")
def pivot_basis_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem", "l_shipdate", "l_returnflag").groupBy(F.year("l_shipdate").alias("ship_year")).pivot("l_returnflag", ["A", "N", "R"]).count()
    return rows.select("ship_year", *(F.coalesce(f, F.lit(0)).alias(f"flag_{f.lower()}") for f in "ANR"))


@query("""
WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, string_agg(l_linenumber || '×' || n, ';' ORDER BY n DESC, l_linenumber) AS distribution FROM c GROUP BY 1""")
def distribution_text(spark: SparkSession, d: str) -> DataFrame:
    counts = read(spark, d, "lineitem", "l_suppkey", "l_linenumber").groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "l_linenumber")))
    text = F.array_join(F.transform(parts, lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit("×"), (-x["m"]).cast("string"))), ";")
    return counts.groupBy("l_suppkey").agg(text.alias("distribution"))


@query("""
WITH r AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, l_quantity AS upper_median FROM r WHERE i = n // 2""")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list("l_quantity"))
    return read(spark, d, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.get(ordered, F.floor(F.size(ordered) / 2).cast("int")).alias("upper_median"))


@query("""
SELECT l_partkey, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r,
       CASE WHEN round(corr(l_quantity, l_extendedprice), 6) BETWEEN 0.85 AND 0.98 THEN 'rising' WHEN round(corr(l_quantity, l_extendedprice), 6) BETWEEN -0.98 AND -0.85 THEN 'falling' WHEN round(corr(l_quantity, l_extendedprice), 6) BETWEEN -0.20 AND 0.60 THEN 'turning' ELSE 'none' END AS band
FROM lineitem GROUP BY 1 HAVING count(*) >= 3""")
def pearson_bands(spark: SparkSession, d: str) -> DataFrame:
    r = F.round(F.corr("l_quantity", "l_extendedprice"), 6)
    found = read(spark, d, "lineitem", "l_partkey", "l_quantity", "l_extendedprice").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), r.alias("r")).filter("n >= 3")
    band = F.when(F.col("r").between(0.85, 0.98), "rising").when(F.col("r").between(-0.98, -0.85), "falling").when(F.col("r").between(-0.20, 0.60), "turning").otherwise("none")
    return found.withColumn("band", band)
