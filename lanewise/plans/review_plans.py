"""States, reconciliation, gates, quality checks, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keyed, reconcile
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


def _line_facts(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus")
    return lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open_lines"))


_FACTS = "SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open_lines FROM lineitem GROUP BY 1"


@query(f"""
WITH f AS ({_FACTS})
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'DATA_INTEGRITY_ERROR' WHEN returned = n THEN 'EXCLUDED' WHEN returned > 0 AND o_orderstatus = 'F' THEN 'CONFLICT' WHEN open_lines = n AND o_orderstatus <> 'O' THEN 'MISMATCH' WHEN open_lines = 0 THEN 'MATCH' WHEN o_orderstatus = 'P' THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS state
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def state_case_ladder(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders", "o_orderkey", "o_orderstatus").join(_line_facts(spark, d), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    n, back, open_, status = (F.col(c) for c in ("n", "returned", "open_lines", "o_orderstatus"))
    state = (
        F.when(n.isNull(), "DATA_INTEGRITY_ERROR")
        .when(back == n, "EXCLUDED")
        .when((back > 0) & (status == "F"), "CONFLICT")
        .when((open_ == n) & (status != "O"), "MISMATCH")
        .when(open_ == 0, "MATCH")
        .when(status == "P", "AMBIGUOUS")
        .otherwise("UNRESOLVED")
    )
    return rows.select("o_orderkey", state.alias("state"))


@query("""
SELECT s.o_orderstatus, p.o_orderpriority, y.y AS order_year, count(o.o_orderkey) AS n
FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p CROSS JOIN (SELECT CAST(unnest(range(1992, 2003)) AS INTEGER) AS y) y
LEFT JOIN orders o ON o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = p.o_orderpriority AND year(o.o_orderdate) = y.y GROUP BY 1, 2, 3""")
def zero_filled_histogram(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders", "o_orderstatus", "o_orderpriority", "o_orderdate").withColumn("order_year", F.year("o_orderdate"))
    statuses, priorities = orders.select("o_orderstatus").distinct(), orders.select("o_orderpriority").distinct()
    years = F.explode(F.sequence(F.lit(1992), F.lit(2002))).alias("order_year")
    roster = statuses.join(priorities, F.lit(True)).select("*", years)  # a roster of a few fixed values
    return reconcile.zero_filled(orders, roster, ["o_orderstatus", "o_orderpriority", "order_year"])


@query("""
WITH f AS (SELECT o_orderkey, l_orderkey FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON l_orderkey = o_orderkey),
g AS (SELECT count(*) > 0 AS has_rows, count(*) = count(DISTINCT o_orderkey) AS unique_ids, count(*) = count(l_orderkey) AS all_covered, round(CAST(count(l_orderkey) AS DOUBLE) / nullif(count(*), 0), 6) AS coverage FROM f)
SELECT has_rows, unique_ids, all_covered, coalesce(coverage, 0.0) AS coverage, concat_ws(',', CASE WHEN NOT has_rows THEN 'has_rows' END, CASE WHEN NOT unique_ids THEN 'unique_ids' END, CASE WHEN NOT all_covered THEN 'all_covered' END) AS failed,
       CASE WHEN has_rows AND unique_ids AND all_covered THEN 'COMPLETE' WHEN coverage > 0 THEN 'PARTIAL' ELSE 'BLOCKED' END AS status FROM g""")
def completion_gate(spark: SparkSession, d: str) -> DataFrame:
    covered = read(spark, d, "lineitem", "l_orderkey").distinct()
    per_order = read(spark, d, "orders", "o_orderkey").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("c"))
    rows = per_order.join(covered, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    total, unique, have = F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("l_orderkey").isNotNull(), F.col("c")).otherwise(0))
    checks = {"has_rows": total > 0, "unique_ids": total == unique, "all_covered": total == have}
    return reconcile.gate(rows, checks, (have, total))


@query("""
SELECT coalesce(a.k, b.k) AS orderkey, coalesce(na, 0) AS n_left, coalesce(nb, 0) AS n_right, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS side
FROM (SELECT l_orderkey AS k, count(*) AS na FROM lineitem GROUP BY 1) a FULL JOIN (SELECT o_orderkey AS k, count(*) AS nb FROM orders GROUP BY 1) b ON a.k = b.k""")
def reconcile_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.reconcile(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey")), read(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey")), "orderkey")


@query("""
WITH v AS (SELECT o_orderkey, 'open' AS view_ FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 'closed' FROM orders WHERE o_orderstatus = 'F'),
c AS (SELECT o_orderkey, count(DISTINCT view_) AS n FROM v GROUP BY 1)
SELECT o.o_orderkey, coalesce(n, 0) AS n_views, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' ELSE 'overlap' END AS violation FROM orders o LEFT JOIN c ON o.o_orderkey = c.o_orderkey WHERE coalesce(n, 0) <> 1""")
def view_partition_check(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    views = F.array(F.when(F.col("o_orderstatus") == "O", "open"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent"), F.when(F.col("o_orderstatus") == "F", "closed"))
    members = orders.select("o_orderkey", F.explode_outer(views).alias("v")).groupBy("o_orderkey").agg(F.count_distinct("v").alias("n_views"))
    return members.filter("n_views <> 1").withColumn("violation", F.when(F.col("n_views") == 0, "missing").otherwise("overlap"))


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT (l_partkey, l_suppkey)) AS n_values FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def unique_and_missing_ids(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey", "l_suppkey").alias("n_values")).filter("n > 1")


@query("""
WITH cases AS (SELECT p_partkey AS case_id, p_size % 4 AS runs_needed FROM part),
runs AS (SELECT l_partkey AS case_id, count(*) AS executed, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT case_id, coalesce(executed, 0) AS executed, CASE WHEN executed IS NULL THEN 'NOT_EXECUTED' WHEN executed > 1 THEN 'FAIL_DUPLICATE' WHEN failed > 0 THEN 'FAIL' WHEN runs_needed = 0 THEN 'UNEXPECTED' ELSE 'PASS' END AS result FROM cases LEFT JOIN runs USING (case_id)""")
def case_rollup(spark: SparkSession, d: str) -> DataFrame:
    cases = read(spark, d, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("case_id"), (F.col("p_size") % 4).alias("need"))
    runs = read(spark, d, "lineitem", "l_partkey", "l_linenumber", "l_returnflag").filter("l_linenumber = 1").groupBy(F.col("l_partkey").alias("case_id")).agg(F.count(F.lit(1)).alias("e"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    result = F.when(F.col("e").isNull(), "NOT_EXECUTED").when(F.col("e") > 1, "FAIL_DUPLICATE").when(F.col("failed") > 0, "FAIL").when(F.col("need") == 0, "UNEXPECTED").otherwise("PASS")
    return cases.join(runs, "case_id", "left").select("case_id", F.coalesce("e", F.lit(0)).alias("executed"), result.alias("result"))


@query("""
WITH o AS (SELECT l_partkey, list(DISTINCT l_returnflag) AS seen FROM lineitem GROUP BY 1),
a AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['A', 'R'] ELSE ['N'] END AS allowed FROM part)
SELECT p_partkey, array_to_string(list_sort(CASE WHEN len(list_intersect(allowed, coalesce(seen, []))) = 0 THEN allowed ELSE list_intersect(allowed, coalesce(seen, [])) END), '|') AS options,
       len(list_filter(coalesce(seen, []), lambda x: NOT list_contains(allowed, x))) = 0 AS is_subset FROM a LEFT JOIN o ON l_partkey = p_partkey""")
def array_intersect_or_default(spark: SparkSession, d: str) -> DataFrame:
    seen = read(spark, d, "lineitem", "l_partkey", "l_returnflag").groupBy("l_partkey").agg(F.collect_set("l_returnflag").alias("seen"))
    allowed = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("A"), F.lit("R"))).otherwise(F.array(F.lit("N")))
    rows = read(spark, d, "part", "p_partkey", "p_size").withColumn("allowed", allowed).join(seen, F.col("l_partkey") == F.col("p_partkey"), "left")
    rows = rows.withColumn("seen", F.coalesce("seen", F.array().cast("array<string>"))).withColumn("both", F.array_intersect("allowed", "seen"))
    options = F.array_join(F.array_sort(F.when(F.size("both") == 0, F.col("allowed")).otherwise(F.col("both"))), "|")
    return rows.select("p_partkey", options.alias("options"), (F.size(F.array_except("seen", "allowed")) == 0).alias("is_subset"))


@query("""
WITH f AS (SELECT user_id, min(event_id) AS first_at FROM events GROUP BY 1)
SELECT event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, CAST(value AS DECIMAL(18,2)) DESC, event_id) AS place, first_at
FROM events e JOIN f ON e.user_id = f.user_id""")
def multi_key_queue_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    events = read(spark, d, "events", "event_id", "user_id", "event_type", "value")
    lane = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    w = Window.partitionBy("user_id").orderBy(lane, F.col("value").cast("decimal(18,2)").desc(), "event_id")
    firsts = events.groupBy("user_id").agg(F.min("event_id").alias("first_at"))
    return events.withColumn("place", F.row_number().over(w)).join(firsts, "user_id").select("event_id", "place", "first_at")


@query(r"""
SELECT 'documents' AS asset, doc_id AS row_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'blank_text' WHEN lang IS NULL THEN 'blank_lang' WHEN length(text) <> n_chars THEN 'length_drift' ELSE 'marked_up' END AS violation
FROM documents WHERE trim(coalesce(text, '')) = '' OR lang IS NULL OR length(text) <> n_chars OR regexp_matches(text, '[|]{1}')
UNION ALL SELECT 'pages', page_id, 'bad_url' FROM pages WHERE NOT regexp_matches(coalesce(url, ''), '^https?://[a-z0-9.-]+/')""")
def quality_violations(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    kind = F.when(F.trim(text) == "", "blank_text").when(F.col("lang").isNull(), "blank_lang").when(F.length("text") != F.col("n_chars"), "length_drift").when(text.contains("|"), "marked_up")
    docs = read(spark, d, "documents", "doc_id", "text", "lang", "n_chars").select(F.lit("documents").alias("asset"), F.col("doc_id").alias("row_id"), kind.alias("violation")).filter("violation IS NOT NULL")
    pages = read(spark, d, "pages", "page_id", "url").filter(~F.coalesce("url", F.lit("")).rlike("^https?://[a-z0-9.-]+/"))
    return docs.unionByName(pages.select(F.lit("pages").alias("asset"), F.col("page_id").alias("row_id"), F.lit("bad_url").alias("violation")))


@query("""
WITH g AS (SELECT p_brand, p_type, count(*) AS n, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1, 2)
SELECT p_brand, p_type, n, CASE WHEN lo = hi AND n >= 2 THEN 'VERIFIED' WHEN lo = hi THEN 'SINGLE' ELSE 'QUARANTINED' END AS truth FROM g""")
def truth_learning(spark: SparkSession, d: str) -> DataFrame:
    found = keyed.unanimous(read(spark, d, "part", "p_brand", "p_type", "p_size"), ["p_brand", "p_type"], "p_size")
    truth = F.when(F.col("conflict"), "QUARANTINED").when(F.col("n") >= 2, "VERIFIED").otherwise("SINGLE")
    return found.select("p_brand", "p_type", "n", truth.alias("truth"))
