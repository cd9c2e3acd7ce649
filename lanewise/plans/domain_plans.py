"""The library's own operators on the driver's tables, mapped to the columns they name.

Orders are occurrences: their status gives what was observed, their lines what was
expected. Each query calls the operator itself; its SQL says the same anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import audit, bindings, decode, expected, ledger, regression, review
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


def _reading(status: Column) -> Column:
    return F.when(status == "F", "ㄅㄚ").when(status == "O", "ㄅㄛ")


def _actual(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("occurrence_id"),
        F.concat(F.lit("r"), "o_orderkey").alias("review_id"),
        _reading(F.col("o_orderstatus")).alias("actual"),
        F.lit("decoded").alias("actual_evidence"),
        F.when(F.col("o_orderpriority") == "5-LOW", "EXCLUDED_OUT_OF_SCOPE").alias("exclusion_state"),
        F.col("o_orderpriority").alias("pdf_name"),
    )


def _expected(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem", "l_orderkey", "l_linestatus", "l_returnflag")
    found = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(_reading(F.col("l_linestatus")))).alias("s"), F.count_distinct("l_returnflag").alias("flags"))
    status = F.when(F.col("flags") == 3, "CONFLICT").when(F.size("s") > 1, "AMBIGUOUS").otherwise("RESOLVED")
    return found.select(F.col("l_orderkey").cast("string").alias("occurrence_id"), F.array_join("s", "|").alias("expected_set"), status.alias("expected_status"), F.lit("lines").alias("basis"))


_LEDGER = """
l AS (SELECT l_orderkey AS k, count(DISTINCT l_linestatus) AS n, min(l_linestatus) AS lo, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS k, o_orderpriority AS pdf, o_orderstatus IN ('F', 'O') AS seen, o_orderstatus AS st, l.k IS NULL AS broken, o_orderpriority = '5-LOW' AS out_,
      CASE WHEN l.k IS NULL THEN 'UNRESOLVED' WHEN flags = 3 THEN 'CONFLICT' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS es, lo FROM orders LEFT JOIN l ON l.k = o_orderkey),
c AS (SELECT *, CASE WHEN seen THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS acts, CASE WHEN seen AND es = 'RESOLVED' THEN CASE WHEN st = lo THEN 'MATCH' ELSE 'MISMATCH' END ELSE '' END AS cmp FROM b),
s AS (SELECT *, CASE WHEN out_ THEN 'EXCLUDED_OUT_OF_SCOPE' WHEN broken THEN 'DATA_INTEGRITY_ERROR' WHEN NOT seen THEN 'ACTUAL_UNRESOLVED' WHEN es = 'CONFLICT' THEN 'RULE_CONFLICT' WHEN es = 'AMBIGUOUS' THEN 'EXPECTED_AMBIGUOUS'
      WHEN es = 'UNRESOLVED' THEN 'EXPECTED_UNRESOLVED' WHEN cmp = 'MATCH' THEN 'PASS' ELSE 'DIFFERENCE_PENDING_CONFIRMATION' END AS state FROM c)"""


@query(f"WITH {_LEDGER} SELECT CAST(k AS VARCHAR) AS occurrence_id, state, cmp AS comparison_result, acts AS actual_status, es AS expected_status, state NOT IN ('PASS', 'EXCLUDED_OUT_OF_SCOPE') AS active_review FROM s")
def ledger_build(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.build(_actual(spark, d), _expected(spark, d))
    return rows.select("occurrence_id", "state", "comparison_result", "actual_status", "expected_status", "active_review")


_STATES = ", ".join(f"('{s}')" for s in ledger.STATES)


@query(f"WITH {_LEDGER}, r(state) AS (VALUES {_STATES}) SELECT r.state, count(s.k) AS n FROM r LEFT JOIN s ON s.state = r.state GROUP BY 1")
def ledger_state_counts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.state_counts(ledger.build(_actual(spark, d), _expected(spark, d)))


@query(f"""
WITH {_LEDGER}, t AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'PASS' ELSE state END AS told FROM s)
SELECT violation, count(*) AS n FROM (
  SELECT 'state_not_derived' AS violation FROM t WHERE told <> state AND NOT (state = 'EXCLUDED_OUT_OF_SCOPE')
  UNION ALL SELECT 'state_not_derived' FROM t WHERE told <> state AND state = 'EXCLUDED_OUT_OF_SCOPE'
  UNION ALL SELECT 'active_review' FROM t WHERE (state NOT IN ('PASS', 'EXCLUDED_OUT_OF_SCOPE')) <> (told NOT IN ('PASS', 'EXCLUDED_OUT_OF_SCOPE'))
  UNION ALL SELECT 'terminal_without_evidence' FROM t WHERE told = 'PASS' AND (NOT seen OR broken)
  UNION ALL SELECT 'pass_without_match' FROM t WHERE told = 'PASS' AND cmp <> 'MATCH') GROUP BY 1""")
def ledger_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.build(_actual(spark, d), _expected(spark, d))
    tampered = rows.withColumn("state", F.when(F.col("occurrence_id").cast("long") % 11 == 0, "PASS").otherwise(F.col("state")))
    return ledger.violations(tampered).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_LEDGER}, i AS (SELECT * FROM s WHERE NOT out_),
g AS (SELECT (SELECT count(*) FROM i) AS in_scope, (SELECT count(*) FROM i WHERE acts = 'RESOLVED') AS a, (SELECT count(*) FROM i WHERE es = 'RESOLVED') AS e, (SELECT count(*) FROM s WHERE state NOT IN ('PASS', 'EXCLUDED_OUT_OF_SCOPE')) AS pending,
      (SELECT count(*) FROM i WHERE es = 'UNRESOLVED') AS u, (SELECT count(*) FROM i WHERE es = 'AMBIGUOUS') AS m, (SELECT count(*) FROM i WHERE es = 'CONFLICT') AS c, (SELECT count(*) FROM s WHERE state = 'DATA_INTEGRITY_ERROR') AS broken, (SELECT count(*) FROM s WHERE state = 'PASS') AS p)
SELECT concat_ws(',', CASE WHEN in_scope = 0 THEN 'in_scope_occurrence_count_positive' END, CASE WHEN a <> in_scope THEN 'actual_coverage_100' END, CASE WHEN e <> in_scope THEN 'expected_coverage_100' END, CASE WHEN pending > 0 THEN 'pending_zero' END, CASE WHEN a <> in_scope THEN 'decode_error_zero' END,
       CASE WHEN u > 0 THEN 'expected_unresolved_zero' END, CASE WHEN m > 0 THEN 'expected_ambiguous_zero' END, CASE WHEN c > 0 THEN 'rule_conflict_zero' END, CASE WHEN broken > 0 THEN 'data_integrity_error_zero' END, CASE WHEN p <> in_scope THEN 'all_in_scope_terminal' END) AS failed_gates,
       in_scope, round(CAST(a AS DOUBLE) / in_scope, 6) AS actual_coverage, round(CAST(e AS DOUBLE) / in_scope, 6) AS expected_coverage, CASE WHEN broken > 0 THEN 'PIPELINE_BLOCKED' ELSE 'PROCESSING_FINISHED' END AS status FROM g""")
def ledger_completion(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.build(_actual(spark, d), _expected(spark, d))
    cases = spark.createDataFrame([("c", "PASS")], "case_id string, result string")
    found = ledger.completion(rows, rows.select("occurrence_id"), cases)
    return found.withColumns({c: F.round(c, 6) for c in ("actual_coverage", "expected_coverage")})


@query(f"""
WITH {_LEDGER} SELECT pdf AS pdf_name, count(*) AS n_rows, count(*) FILTER (NOT out_) AS in_scope, coalesce(round(CAST(count(*) FILTER (NOT out_ AND seen) AS DOUBLE) / nullif(count(*) FILTER (NOT out_), 0), 6), 0.0) AS actual_coverage,
       coalesce(round(CAST(count(*) FILTER (NOT out_ AND es = 'RESOLVED') AS DOUBLE) / nullif(count(*) FILTER (NOT out_), 0), 6), 0.0) AS expected_coverage FROM s GROUP BY 1""")
def file_coverage(spark: SparkSession, d: str) -> DataFrame:
    return audit.file_coverage(ledger.build(_actual(spark, d), _expected(spark, d)), "pdf_name")


@query(f"""
WITH {_LEDGER},
e AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'resolve' WHEN 1 THEN 'exclude' WHEN 2 THEN 'confirm' ELSE 'keep' END AS act, o_orderkey % 7 = 0 AS stale FROM orders WHERE o_orderkey % 3 = 0),
j AS (SELECT s.*, e.act, CASE WHEN e.k IS NULL THEN 'NONE' WHEN out_ AND act = 'resolve' THEN 'EXPECTED_EVENT_DORMANT_EXCLUDED' WHEN stale THEN 'INVALIDATED_TARGET_DRIFT' ELSE 'APPLIED' END AS event_status FROM s LEFT JOIN e ON e.k = s.k)
SELECT CAST(k AS VARCHAR) AS occurrence_id, event_status, CASE WHEN event_status = 'APPLIED' AND act = 'exclude' THEN 'EXCLUDED_OUT_OF_SCOPE' WHEN event_status = 'APPLIED' AND act = 'resolve' THEN CASE WHEN broken THEN 'DATA_INTEGRITY_ERROR' WHEN NOT seen THEN 'ACTUAL_UNRESOLVED' WHEN st = 'F' THEN 'PASS' ELSE 'DIFFERENCE_PENDING_CONFIRMATION' END
       WHEN event_status = 'APPLIED' AND act = 'confirm' AND cmp = 'MISMATCH' AND state = 'DIFFERENCE_PENDING_CONFIRMATION' THEN 'TEXTBOOK_ERROR_CONFIRMED' ELSE state END AS state FROM j""")
def review_replay(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.build(_actual(spark, d), _expected(spark, d)).withColumns({"target_snapshot": F.lit("t"), "actual_snapshot": F.lit("a")})
    key = F.col("o_orderkey")
    action = F.when(key % 5 == 0, "resolve").when(key % 5 == 1, "exclude").when(key % 5 == 2, "confirm").otherwise("keep")
    gates = F.map_from_arrays(F.array(*map(F.lit, ledger.CONFIRMATIONS)), F.array(*(F.lit(True) for _ in ledger.CONFIRMATIONS)))
    last = read(spark, d, "orders", "o_orderkey").filter("o_orderkey % 3 = 0").select(
        F.concat(F.lit("r"), key).alias("review_id"), F.lit(2).alias("seq"), action.alias("action"), F.lit("ㄅㄚ").alias("expected_set"), F.lit("seen").alias("evidence"),
        F.when(key % 7 == 0, "old").otherwise("t").alias("target_snapshot"), F.lit("a").alias("actual_snapshot"), gates.alias("gates"),
    )
    earlier = last.withColumn("seq", F.lit(1)).withColumn("action", F.lit("exclude"))
    return review.replay(rows, last.unionByName(earlier)).select("occurrence_id", "event_status", "state")


@query("""
WITH r AS (SELECT l_orderkey AS c, CASE WHEN l_returnflag = 'R' THEN 'FAIL' WHEN l_returnflag = 'A' THEN 'NOT_EXECUTED' ELSE 'PASS' END AS result, l_linenumber = 7 AS other FROM lineitem),
g AS (SELECT c, count(*) FILTER (result IN ('PASS', 'FAIL')) AS executed, count(*) FILTER (result = 'FAIL') AS failed, count(*) FILTER (result = 'NOT_EXECUTED') AS missed, count(DISTINCT other) AS d FROM r GROUP BY 1)
SELECT CAST(c AS VARCHAR) AS case_id, executed, CASE WHEN d > 1 THEN 'DEFINITION_DRIFT' WHEN executed > 1 OR failed > 0 THEN 'FAIL' WHEN executed = 1 THEN 'PASS' WHEN missed > 0 THEN 'NOT_EXECUTED' ELSE 'NOT_APPLICABLE' END AS result FROM g""")
def regression_roll_up(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber")
    result = F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "A", "NOT_EXECUTED").otherwise("PASS")
    return regression.roll_up(lines.select(F.col("l_orderkey").cast("string").alias("case_id"), result.alias("result"), F.when(F.col("l_linenumber") == 7, "b").otherwise("a").alias("definition_sha")))


@query("""
WITH n AS (SELECT l_partkey AS c, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS f FROM lineitem GROUP BY 1),
j AS (SELECT p.p_partkey AS r, n.* FROM (SELECT p_partkey FROM part WHERE p_size > 10) p FULL JOIN n ON n.c = p.p_partkey),
a AS (SELECT count(*) FILTER (r IS NOT NULL) AS required, count(*) FILTER (r IS NOT NULL AND c IS NOT NULL) AS executed, count(*) FILTER (r IS NOT NULL AND c IS NULL) AS missing, count(*) FILTER (r IS NULL) AS unexpected, count(*) FILTER (n > 1) AS repeated, CAST(coalesce(sum(f), 0) AS BIGINT) AS failed FROM j)
SELECT *, required > 0 AND missing + unexpected + repeated + failed = 0 AS ok FROM a""")
def regression_report(spark: SparkSession, d: str) -> DataFrame:
    required = read(spark, d, "part", "p_partkey", "p_size").filter("p_size > 10").select(F.col("p_partkey").alias("case_id"))
    ran = read(spark, d, "lineitem", "l_partkey", "l_returnflag")
    return regression.execution_report(required, ran.select(F.col("l_partkey").alias("case_id"), F.when(F.col("l_returnflag") == "R", "FAIL").otherwise("PASS").alias("result")))


@query("""
SELECT CAST(p_brand || p_type AS VARCHAR) AS glyph_sha, CASE WHEN min(p_size) = max(p_size) THEN CAST(min(p_size) AS VARCHAR) END AS reading, count(*) AS n, CASE WHEN min(p_size) <> max(p_size) THEN 'QUARANTINED' WHEN count(*) >= 2 THEN 'VERIFIED' ELSE 'SINGLE' END AS truth FROM part GROUP BY 1""")
def learnt_truth(spark: SparkSession, d: str) -> DataFrame:
    return review.learnt_truth(read(spark, d, "part").select(F.concat("p_brand", "p_type").alias("glyph_sha"), F.col("p_size").cast("string").alias("reading")))


@query("""
WITH x AS (SELECT l_partkey AS g, l_orderkey * 10 + l_linenumber AS e, l_linestatus AS r, l_suppkey AS a, l_orderkey AS b, l_shipdate AS c, l_extendedprice AS dd, l_quantity AS q FROM lineitem),
f AS (SELECT g, min(r) AS lo, max(r) AS hi FROM x GROUP BY 1),
p AS (SELECT x.g, min((x.e, y.e)) AS p FROM x JOIN x y ON x.g = y.g AND x.e < y.e AND x.a <> y.a AND x.b <> y.b AND x.c <> y.c AND x.dd <> y.dd AND x.q <> y.q GROUP BY 1)
SELECT f.g AS glyph_id, CASE WHEN lo = hi THEN lo END AS reading, p[1] AS first_id, p[2] AS second_id, CASE WHEN lo <> hi THEN 'QUARANTINED_CONFLICT' WHEN p IS NOT NULL AND f.g % 2 = 0 THEN 'VERIFIED_GLOBAL' WHEN p IS NOT NULL THEN 'PROMOTION_READY' ELSE 'CANDIDATE' END AS state
FROM f LEFT JOIN p ON p.g = f.g""")
def library_states(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_linestatus", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    evidence = lines.select(
        F.col("l_partkey").alias("glyph_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_linestatus").alias("reading"),
        F.col("l_suppkey").alias("project_id"), F.col("l_orderkey").alias("pdf_sha256"), F.col("l_shipdate").alias("font_sha256"), F.col("l_extendedprice").alias("occurrence_id"), F.col("l_quantity").alias("decision_sha256"),
    )
    return review.library_states(evidence, read(spark, d, "part", "p_partkey").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("glyph_id")))


@query("""
WITH e AS (SELECT l_suppkey AS family, l_partkey % 100 AS signature, l_linestatus AS symbol, l_orderkey AS glyph, l_linenumber AS support FROM lineitem),
f AS (SELECT family, signature, min(symbol) AS lo, max(symbol) AS hi, count(DISTINCT glyph) AS g, max(support) AS s FROM e GROUP BY 1, 2),
o AS (SELECT family, signature, lo AS symbol FROM f WHERE lo = hi AND (g >= 2 OR s >= 2)), sh AS (SELECT signature, min(symbol) AS lo, max(symbol) AS hi FROM o GROUP BY 1)
SELECT f.family, f.signature, coalesce(o.symbol, CASE WHEN sh.lo = sh.hi THEN sh.lo END) AS symbol, CASE WHEN o.symbol IS NOT NULL THEN 'own' WHEN sh.lo = sh.hi THEN 'propagated' ELSE 'none' END AS basis
FROM f LEFT JOIN o ON o.family = f.family AND o.signature = f.signature LEFT JOIN sh ON sh.signature = f.signature""")
def accepted_signatures(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_linestatus", "l_orderkey", "l_linenumber")
    return decode.accepted_signatures(lines.select(F.col("l_suppkey").alias("family"), (F.col("l_partkey") % 100).alias("signature"), F.col("l_linestatus").alias("symbol"), F.col("l_orderkey").alias("glyph_id"), F.col("l_linenumber").alias("support")))


@query("""
WITH c AS (SELECT l_suppkey AS signature, l_returnflag AS symbol, count(*) AS n FROM lineitem GROUP BY 1, 2),
t AS (SELECT signature, sum(n) AS total, max((n, symbol)) AS top FROM c GROUP BY 1)
SELECT signature, top[2] AS symbol, top[1] AS support, round(top[1] / total, 6) AS purity FROM t WHERE top[1] / total >= 0.35 AND top[1] >= 2""")
def template_support(spark: SparkSession, d: str) -> DataFrame:
    found = decode.template_support(read(spark, d, "lineitem", "l_suppkey", "l_returnflag").select(F.col("l_suppkey").alias("signature"), F.col("l_returnflag").alias("symbol")), 0.35, 2)
    return found.withColumn("purity", F.round("purity", 6))


@query("""
WITH m AS (SELECT l_returnflag AS style, CAST(l_suppkey AS VARCHAR) AS sig, CASE WHEN min(y) = max(y) THEN min(y) END AS sym FROM (SELECT *, CASE WHEN l_suppkey % 5 = 0 THEN l_linestatus ELSE 's' || l_suppkey % 7 END AS y FROM lineitem) GROUP BY 1, 2),
g AS (SELECT o.o_orderkey AS k, 'R' AS style, unnest(range(1, CAST(o.o_orderkey % 3 + 2 AS BIGINT))) AS i FROM orders o),
s AS (SELECT k, style, i, CAST((k + i * 7) % 9 + 1 AS VARCHAR) AS sig FROM g),
j AS (SELECT s.k, count(*) AS n, count(m.sym) AS have, string_agg(m.sym, '' ORDER BY i) AS body FROM s LEFT JOIN m ON m.style = s.style AND m.sig = s.sig GROUP BY 1)
SELECT k AS occurrence_id, CASE WHEN k % 2 = 0 THEN '˙' || body ELSE body || 'ˋ' END AS reading FROM j WHERE have = n""")
def decode_signatures(spark: SparkSession, d: str) -> DataFrame:
    symbols = read(spark, d, "lineitem", "l_returnflag", "l_suppkey", "l_linestatus").select(F.col("l_returnflag").alias("style_group"), F.col("l_suppkey").cast("string").alias("signature"), F.when(F.col("l_suppkey") % 5 == 0, F.col("l_linestatus")).otherwise(F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string"))).alias("symbol"))
    places = F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int")), lambda i: ((F.col("o_orderkey") + i * 7) % 9 + 1).cast("string"))
    tone = F.when(F.col("o_orderkey") % 2 == 0, "˙").otherwise("ˋ")
    glyphs = read(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey").alias("occurrence_id"), F.lit("R").alias("style_group"), places.alias("signatures"), tone.alias("tone"))
    return decode.decode_signatures(glyphs, symbols)


@query("""
WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(value / 10) AS BIGINT) AS band, user_id % 5 AS font, event_id % 5 AS visible, floor(value) AS x FROM events),
k AS (SELECT user_id, event_type, x, min((band, font)) = max((band, font)) AS one, max(event_id) AS last, count(*) FILTER (font = visible) AS vis FROM e GROUP BY 1, 2, 3)
SELECT event_id AS occurrence_id FROM e JOIN k USING (user_id, event_type, x) WHERE CASE WHEN one THEN event_id = last WHEN vis = 1 THEN font = visible ELSE true END""")
def hidden_duplicates(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events", "event_id", "user_id", "event_type", "value")
    rows = e.select(
        F.col("event_id").alias("occurrence_id"), F.col("user_id").alias("pdf_sha256"), F.lit(1).alias("page"), F.col("event_type").alias("char"), F.floor("value").cast("double").alias("x0"), F.lit(0.0).alias("y0"),
        F.floor(F.col("value") / 10).alias("actual"), (F.col("user_id") % 5).alias("font"), (F.col("event_id") % 5).alias("visible_font"), F.col("event_id").alias("source_row_number"),
    )
    return decode.hidden_duplicates(rows).select("occurrence_id")


@query("""
WITH p AS (SELECT user_id, event_type, count(*) AS n, string_agg(event_id, ',' ORDER BY event_id) AS members, bool_or(value > 90) AS pending FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n, members FROM p WHERE pending""")
def review_groups(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events", "event_id", "user_id", "event_type", "value")
    rows = e.select("user_id", "event_type", F.lit("f").alias("pdf_sha256"), F.lit(1).alias("page"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("x0"), F.col("event_id").alias("occurrence_id"), F.lit("x").alias("actual"), F.lit("s").alias("state"), (F.col("value") > 90).alias("active_review"))
    found = review.groups(rows, ["user_id", "event_type"])
    return found.select("user_id", "event_type", F.col("n").cast("long").alias("n"), F.array_join(F.transform("members", lambda m: m["occurrence_id"].cast("string")), ",").alias("members"))


@query("""
WITH f AS (SELECT event_type, min((user_id, event_id)) AS f FROM events GROUP BY 1),
q AS (SELECT event_id, user_id % 3 AS lane, row_number() OVER (PARTITION BY user_id % 3 ORDER BY f, e.event_type, user_id, event_id) AS place FROM events e JOIN f USING (event_type) WHERE value > 60)
SELECT event_id AS occurrence_id, lane, place FROM q""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events", "event_id", "user_id", "event_type", "value")
    rows = e.select((F.col("user_id") % 3).alias("lane"), F.col("event_type").alias("char"), F.col("user_id").alias("pdf_order"), F.lit(1).alias("page"), F.col("event_id").alias("source_row_number"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("x0"), F.col("event_id").alias("occurrence_id"), (F.col("value") > 60).alias("active_review"))
    return review.queue(rows, "lane").select("occurrence_id", "lane", "place")


# lines of a small corpus; every part is one of their characters
LINES = ("媽媽和姐姐一起看書", "第一天他不是來買東西", "三個人九十分真的呀", "一定不會有一天重要", "爸爸說謝謝一年一次", "他不敢一看就走了", "音樂會人和", "重")
RULES = [("r1", 100, "exact", "看", "看書", "ㄎㄢˋ", []), ("r2", 40, "default", "重", "", "ㄓㄨㄥˋ", []), ("r3", 50, "default", "和", "", "ㄏㄢˋ", ["人和"]), ("r4", 90, "exact", "說", "爸爸說", "ㄕㄨㄛ", [])]
WORDS = [("音樂", ["ㄧㄣ", "ㄩㄝˋ"]), ("重要", ["ㄓㄨㄥˋ", "ㄧㄠˋ"]), ("一定", ["ㄧˊ", "ㄉㄧㄥˋ"])]
SINGLES = [("起", "ㄑㄧˇ"), ("天", "ㄊㄧㄢ"), ("是", "ㄕˋ"), ("定", "ㄉㄧㄥˋ"), ("會", "ㄏㄨㄟˋ"), ("年", "ㄋㄧㄢˊ"), ("次", "ㄘˋ"), ("敢", "ㄍㄢˇ"), ("書", "ㄕㄨ"), ("人", "ㄖㄣˊ"), ("的", "˙ㄉㄜ")]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{c}'" for c in r) + ")" for r in rows)


@query(f"""
WITH lines(n, line) AS (VALUES {", ".join(f"({k}, '{x}')" for k, x in enumerate(LINES))}),
o AS (SELECT p_partkey AS id, line, CAST(p_partkey // 8 % length(line) AS INTEGER) + 1 AS place FROM part JOIN lines ON n = p_partkey % 8),
q AS (SELECT *, substr(line, place, 1) AS c, CASE WHEN place > 1 THEN substr(line, place - 1, 1) ELSE '' END AS p, substr(line, place + 1, 1) AS f FROM o),
singles(c, r) AS (VALUES {_values(SINGLES)}),
second(c, r) AS (VALUES {_values([(w[0], r) for w, r in expected.SECOND_NEUTRAL])}),
nxt AS (SELECT q.*, CASE WHEN f = '看' AND substr(line, place + 1, 2) = '看書' THEN 'ㄎㄢˋ' WHEN f = '看' THEN NULL WHEN f = '定' AND q.c = '一' THEN 'ㄉㄧㄥˋ' ELSE n.r END AS fr FROM q LEFT JOIN singles n ON n.c = q.f AND n.c <> '的'),
t AS (SELECT *, CASE WHEN fr IS NULL THEN NULL WHEN fr LIKE '%ˋ' THEN 4 WHEN fr LIKE '%ˇ' THEN 3 WHEN fr LIKE '%ˊ' THEN 2 ELSE 1 END AS tone FROM nxt)
SELECT id AS occurrence_id, reading, basis FROM (SELECT t.id, UNNEST([CASE
  WHEN t.c = '西' AND p = '東' AND line LIKE '%買東西%' THEN {{'reading': '˙ㄒㄧ', 'basis': 'semantic_word'}}
  WHEN s2.c IS NOT NULL AND p = t.c THEN {{'reading': s2.r, 'basis': 'handbook_position'}}
  WHEN t.c = '一' AND p = '第' THEN {{'reading': 'ㄧ', 'basis': 'special_yi'}}
  WHEN t.c = '看' AND f = '書' THEN {{'reading': 'ㄎㄢˋ', 'basis': 'exact'}}
  WHEN t.c = '說' AND place > 2 AND substr(line, place - 2, 2) = '爸爸' THEN {{'reading': 'ㄕㄨㄛ', 'basis': 'exact'}}
  WHEN t.c = '一' AND tone IS NOT NULL THEN {{'reading': CASE WHEN tone = 4 THEN 'ㄧˊ' ELSE 'ㄧˋ' END, 'basis': 'special_yi'}}
  WHEN t.c = '不' AND tone IS NOT NULL THEN {{'reading': CASE WHEN tone = 4 THEN 'ㄅㄨˊ；ㄅㄨˋ' ELSE 'ㄅㄨˋ' END, 'basis': 'special_bu'}}
  WHEN t.c IN ('一', '不') THEN {{'reading': NULL, 'basis': 'none'}}
  WHEN t.c = '媽' THEN {{'reading': 'ㄇㄚ', 'basis': 'special_repeat'}}
  WHEN t.c = '姐' THEN {{'reading': 'ㄐㄧㄝˇ', 'basis': 'special_repeat'}}
  WHEN t.c = '個' AND p = '三' THEN {{'reading': 'ㄍㄜˋ；˙ㄍㄜ', 'basis': 'special_ge'}}
  WHEN t.c = '呀' AND f = '' THEN {{'reading': '˙ㄧㄚ', 'basis': 'special_ya'}}
  WHEN t.c = '分' AND p = '十' THEN {{'reading': 'ㄈㄣ', 'basis': 'special_fen'}}
  WHEN t.c = '音' AND f = '樂' THEN {{'reading': 'ㄧㄣ', 'basis': 'concise_word'}}
  WHEN t.c = '樂' AND p = '音' THEN {{'reading': 'ㄩㄝˋ', 'basis': 'concise_word'}}
  WHEN t.c = '重' AND f = '要' THEN {{'reading': 'ㄓㄨㄥˋ', 'basis': 'concise_word'}}
  WHEN t.c = '要' AND p = '重' THEN {{'reading': 'ㄧㄠˋ', 'basis': 'concise_word'}}
  WHEN t.c = '定' AND p = '一' THEN {{'reading': 'ㄉㄧㄥˋ', 'basis': 'concise_word'}}
  WHEN n.r IS NOT NULL AND t.c <> '的' THEN {{'reading': n.r, 'basis': 'concise_single'}}
  WHEN t.c = '和' AND p <> '人' THEN {{'reading': 'ㄏㄢˋ', 'basis': 'default'}}
  ELSE {{'reading': NULL, 'basis': 'none'}} END], recursive := true) FROM t LEFT JOIN singles n ON n.c = t.c LEFT JOIN second s2 ON s2.c = t.c)""")
def expected_layers(spark: SparkSession, d: str) -> DataFrame:
    line = F.get(F.array(*map(F.lit, LINES)), (F.col("p_partkey") % len(LINES)).cast("int"))
    occ = read(spark, d, "part", "p_partkey").withColumn("line", line)
    occ = occ.withColumn("pos", (F.expr("p_partkey div 8") % F.length("line")).cast("int")).withColumn("char", F.substring("line", F.col("pos") + 1, F.lit(1)))
    rules = spark.createDataFrame(RULES, "rule_id string, priority int, mode string, target_char string, phrase string, expected_reading string, excluded_phrases array<string>")
    evidence = expected.Evidence(rules, spark.createDataFrame(WORDS, "word string, primary array<string>"), spark.createDataFrame(SINGLES, "char string, reading string"))
    return expected.decided(occ.select(F.col("p_partkey").alias("occurrence_id"), "line", "pos", "char"), evidence).select("occurrence_id", "reading", "basis")


@query("""
SELECT p_brand, p_type, count(*) AS occurrences, count(*) FILTER (p_size <= 30) AS decoded, count(*) FILTER (p_size > 30) AS undecoded FROM part GROUP BY 1, 2""")
def structural_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part", "p_brand", "p_type", "p_size").withColumn("reading", F.when(F.col("p_size") <= 30, "x"))
    return audit.structural_rollup(rows, "reading", ["p_brand", "p_type"])


@query("""
SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY 1""")
def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    return audit.hits(read(spark, d, "part", "p_type"), "p_type")


@query("""
WITH p AS (SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_suppkey) AS k FROM p),
c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT c.*, string_agg(l_suppkey, ',' ORDER BY l_suppkey) AS places FROM c JOIN r USING (l_returnflag, l_linestatus) WHERE k <= 20 GROUP BY 1, 2, 3""")
def text_distribution(spark: SparkSession, d: str) -> DataFrame:
    return audit.distribution(read(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_suppkey"), ["l_returnflag", "l_linestatus"], "l_suppkey", 20)


@query("""
WITH h AS (SELECT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 3) AS part, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders),
p AS (SELECT part, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(d, '' ORDER BY part)) AS digest FROM p""")
def payload_digest(spark: SparkSession, d: str) -> DataFrame:
    return audit.tree_digest(read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")


@query("""
SELECT l_partkey, count(DISTINCT (l_returnflag, l_linestatus)) AS versions FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1""")
def unequal_reports(spark: SparkSession, d: str) -> DataFrame:
    return audit.unequal_reports(read(spark, d, "lineitem", "l_partkey", "l_returnflag", "l_linestatus"), "l_partkey", ["l_returnflag", "l_linestatus"])


@query("""
SELECT n_nationkey, 'missing' AS fault FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 50 = 0)
UNION ALL SELECT DISTINCT c_nationkey, 'unexpected' FROM customer WHERE c_custkey % 50 = 0 AND c_nationkey NOT IN (SELECT n_nationkey FROM nation)""")
def roster_difference(spark: SparkSession, d: str) -> DataFrame:
    present = read(spark, d, "customer", "c_custkey", "c_nationkey").filter("c_custkey % 50 = 0").select(F.col("c_nationkey").alias("n_nationkey"))
    return audit.roster_difference(read(spark, d, "nation", "n_nationkey"), present, ["n_nationkey"])


@query("""
WITH v AS (SELECT o_orderkey, 'open' AS v FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 'closed' FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, count(DISTINCT v) AS n_views FROM v GROUP BY 1 HAVING count(DISTINCT v) > 1""")
def overlapping_views(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return audit.union_of_views({"open": orders.filter("o_orderstatus = 'O'"), "urgent": orders.filter("o_orderpriority = '1-URGENT'"), "closed": orders.filter("o_orderstatus = 'F'")}, "o_orderkey")[1]


@query("""
WITH r AS (SELECT l_returnflag, l_orderkey * 10 + l_linenumber AS k, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) AS nth, count(*) OVER (PARTITION BY l_returnflag) AS n_faults FROM lineitem WHERE l_quantity > 45)
SELECT * FROM r WHERE nth <= 20""")
def first_faults(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem", "l_returnflag", "l_orderkey", "l_linenumber", "l_quantity").filter("l_quantity > 45").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return audit.first_faults(rows, "l_returnflag", "k", 20)


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)""")
def broken_references(spark: SparkSession, d: str) -> DataFrame:
    good = read(spark, d, "customer", "c_custkey", "c_acctbal").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return audit.broken_references(read(spark, d, "orders", "o_orderkey", "o_custkey"), good, ["o_custkey"])


@query("""
SELECT p_partkey, CAST(p_size AS VARCHAR) AS wanted, CASE WHEN p_partkey % 9 = 0 THEN 'gone' ELSE 'other_value' END AS fault FROM part WHERE p_partkey % 9 = 0 OR (p_partkey % 4 = 0 AND p_size <> 1)""")
def failed_conditions(spark: SparkSession, d: str) -> DataFrame:
    wanted = read(spark, d, "part", "p_partkey", "p_size").select("p_partkey", F.col("p_size").cast("string").alias("v"))
    now = wanted.filter("p_partkey % 9 <> 0").withColumn("v", F.when(F.col("p_partkey") % 4 == 0, "1").otherwise(F.col("v")))
    return audit.failed_conditions(now, wanted, "p_partkey", "v")


@query("""
WITH a AS (SELECT p_name || p_brand AS anchor, count(*) AS n, min(p_partkey) AS id FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), b AS (SELECT p_name || p_brand AS anchor, count(*) AS n, min(p_partkey) AS id FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1)
SELECT a.id AS source_id, b.id AS target_id FROM a JOIN b USING (anchor) WHERE a.n = 1 AND b.n = 1""")
def occurrence_mapping(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part", "p_partkey", "p_name", "p_brand").select(F.col("p_partkey").alias("occurrence_id"), F.concat("p_name", "p_brand").alias("anchor"))
    return bindings.map_rows(part.filter("occurrence_id % 3 <> 0"), part.filter("occurrence_id % 5 <> 0"), ["anchor"])[0]


@query("""
WITH c AS (SELECT c_nationkey AS ident, c_mktsegment AS seg, count(*) AS n, min(c_custkey) AS id, min(CAST(c_custkey % 2 AS VARCHAR)) AS r FROM customer WHERE c_custkey % 10 = 0 GROUP BY 1, 2)
SELECT s_suppkey, CASE WHEN n IS NULL OR n > 1 THEN NULL ELSE id END AS occurrence_id, CASE WHEN n IS NULL THEN 'INSUFFICIENT' WHEN n > 1 THEN 'AMBIGUOUS' WHEN r = CAST(s_suppkey % 2 AS VARCHAR) THEN 'MAPPED' ELSE 'CHANGED' END AS plan
FROM supplier LEFT JOIN c ON ident = s_nationkey AND seg = CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END""")
def migration_plan(spark: SparkSession, d: str) -> DataFrame:
    current = read(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment").filter("c_custkey % 10 = 0").select(F.col("c_nationkey").alias("ident"), F.col("c_mktsegment").alias("seg"), F.col("c_custkey").alias("occurrence_id"), (F.col("c_custkey") % 2).cast("string").alias("reading"))
    legacy = read(spark, d, "supplier", "s_suppkey", "s_nationkey").select("s_suppkey", F.col("s_nationkey").alias("ident"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("seg"), (F.col("s_suppkey") % 2).cast("string").alias("reading"))
    return bindings.migration_plan(legacy, current, ["ident", "seg"]).select("s_suppkey", "occurrence_id", "plan")


@query("""
WITH s AS (SELECT l_suppkey % 10 AS h, min(y) AS r FROM (SELECT l_suppkey, CASE WHEN l_suppkey % 10 < 8 THEN 'x' || l_suppkey % 2 ELSE l_linestatus END AS y FROM lineitem) GROUP BY 1 HAVING min(y) = max(y)),
t AS (SELECT DISTINCT p_brand AS font, p_size AS glyph_id, p_partkey AS v, p_partkey % 10 AS h FROM part)
SELECT font, glyph_id, min(r) AS reading FROM t LEFT JOIN s USING (h) GROUP BY 1, 2 HAVING count(*) = count(r) AND min(r) = max(r)""")
def fingerprint_bridge(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("l_suppkey") % 10
    sources = read(spark, d, "lineitem", "l_suppkey", "l_linestatus").select(key.alias("glyph_sha"), F.when(key < 8, F.concat(F.lit("x"), (F.col("l_suppkey") % 2).cast("string"))).otherwise(F.col("l_linestatus")).alias("reading"))
    targets = read(spark, d, "part", "p_brand", "p_size", "p_partkey").select(F.col("p_brand").alias("font"), F.col("p_size").alias("glyph_id"), F.col("p_partkey").alias("variant"), (F.col("p_partkey") % 10).alias("glyph_sha"))
    return bindings.bridged(targets, sources)


@query("""
WITH n AS (SELECT l_partkey * 1000 + l_suppkey AS sha, count(*) AS n, min(l_orderkey) AS path FROM lineitem GROUP BY 1)
SELECT p_partkey AS kind, CASE WHEN n = 1 THEN path END AS path, CASE WHEN n IS NULL THEN 'MISSING' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'BOUND' END AS binding FROM part LEFT JOIN n ON sha = p_partkey * 1000 + p_size""")
def sealed_binding(spark: SparkSession, d: str) -> DataFrame:
    found = read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_orderkey").select((F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("sha256"), F.col("l_orderkey").alias("path"))
    return bindings.bound_files(read(spark, d, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("kind"), (F.col("p_partkey") * 1000 + F.col("p_size")).alias("sha256")), found)


@query("""
WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'add' WHEN 'error' THEN 'remove' ELSE 'ack' END AS op, user_id % 2 AS token FROM events),
a AS (SELECT user_id, max(event_id) AS added, arg_max(token, event_id) AS token FROM e WHERE op = 'add' GROUP BY 1)
SELECT a.user_id, CAST(token AS VARCHAR) AS token, CAST(added AS VARCHAR) AS payload FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = a.user_id AND e.event_id > a.added AND (op = 'remove' OR (op = 'ack' AND e.token = a.token AND e.event_id % 2 = 0)))""")
def staged_decisions(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events", "event_id", "user_id", "event_type")
    op = F.when(F.col("event_type") == "view", "add").when(F.col("event_type") == "error", "remove").otherwise("ack")
    token = F.when((op == "ack") & (F.col("event_id") % 2 == 1), "other").otherwise((F.col("user_id") % 2).cast("string"))
    changes = e.select("user_id", F.col("event_id").alias("seq"), op.alias("op"), token.alias("token"), F.col("event_id").cast("string").alias("payload"))
    return bindings.staged(changes.select("user_id", "token", "payload").limit(0), changes, "user_id")


@query(r"""
SELECT event_id, regexp_replace(regexp_replace(trim('f' || user_id || '|row: ' || event_id || ';' || event_type), '(?i)(?:^|[|;,])\s*(?:excel_?row|source_?row|row)\s*[:=#]\s*\d+\s*', '', 'g'), '^[|;, ]+|[|;, ]+$', '', 'g') AS key,
       CASE WHEN least((event_id * 7919 // 65536) % 256, (event_id * 7919 // 256) % 256, event_id * 7919 % 256) >= 247 THEN 0 ELSE 1 END AS colour,
       CASE WHEN user_id % 3 = 0 THEN 'ㄇㄚ' ELSE 'ㄇㄚ' END AS base, CASE user_id % 5 WHEN 0 THEN 'neutral' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' ELSE '4' END AS tone FROM events""")
def scalar_forms(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events", "event_id", "user_id", "event_type")
    raw = F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit("|row: "), F.col("event_id").cast("string"), F.lit(";"), "event_type")
    k = F.col("user_id") % 5
    reading = F.when(k == 0, "˙ㄇㄚ").when(k == 1, "ㄇㄚ").when(k == 2, "ㄇㄚˊ").when(k == 3, "ㄇㄚˇ").otherwise("ㄇㄚˋ")
    split = scalars.split_tone(reading)
    return e.select("event_id", scalars.stable_key(raw).alias("key"), scalars.colour_rank((F.col("event_id") * 7919 % (1 << 24)).cast("int")).alias("colour"), split["base"].alias("base"), split["tone"].alias("tone"))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS occurrence_id, CASE WHEN p_size % 5 = 0 THEN 'source_blocked' WHEN p_size % 5 = 1 AND p_partkey % 2 = 1 THEN 'not_pending' WHEN p_partkey % 7 = 0 THEN 'identity_incomplete' WHEN p_retailprice > 1500 THEN 'place_invalid' WHEN p_partkey % 11 = 0 THEN 'actual_unresolved' ELSE '' END AS why FROM part""")
def confirm_blocked(spark: SparkSession, d: str) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size") % 5
    rows = read(spark, d, "part", "p_partkey", "p_size", "p_retailprice").withColumn("occurrence_id", p.cast("string"))
    rows = rows.withColumns(
        {
            "state": F.when(size == 0, "SOURCE_INVALID").when(size == 1, "PASS").otherwise("REVIEW_PENDING"), "blocking_state": F.lit(None).cast("string"), "redecidable": p % 2 == 0,
            "review_id": F.when(p % 7 == 0, "x").otherwise(scalars.review_id(F.col("occurrence_id"))), "char": F.lit("角"), "pdf_sha256": F.lit("a" * 64), "physical_page": F.lit(3),
            "x0": F.col("p_retailprice"), "y0": F.lit(1.0), "x1": F.lit(1500.0), "y1": F.lit(2.0), "actual": F.when(p % 11 != 0, "ㄅㄚ"), "actual_status": F.lit("RESOLVED"), "actual_evidence": F.lit("e"),
        }
    )
    return rows.select("occurrence_id", bindings.confirm_blocked().alias("why"))


@query("""
WITH RECURSIVE t AS (SELECT DISTINCT l_orderkey AS g, l_suppkey % 5 AS p, l_partkey % 6 AS f, l_linenumber AS t FROM lineitem WHERE l_returnflag <> 'A'),
i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, f, t) AS i FROM t),
s(g, i, n, ps, fs, ts) AS (
  SELECT g, i, 1, [p], [f], [t] FROM i
  UNION ALL SELECT s.g, i.i, n + 1, list_append(ps, i.p), list_append(fs, i.f), list_append(ts, i.t) FROM s JOIN i ON i.g = s.g AND i.i > s.i AND NOT list_contains(ps, i.p) AND NOT list_contains(fs, i.f) AND NOT list_contains(ts, i.t))
SELECT CAST(o AS VARCHAR) AS glyph_id, CAST(coalesce(max(n), 0) AS INTEGER) AS independent FROM (SELECT DISTINCT l_orderkey AS o FROM lineitem) LEFT JOIN s ON g = o GROUP BY 1""")
def independent_sources(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag")
    evidence = lines.select(F.col("l_orderkey").cast("string").alias("glyph_id"), (F.col("l_suppkey") % 5).cast("string").alias("project_id"), (F.col("l_partkey") % 6).cast("string").alias("pdf_sha256"), F.col("l_linenumber").cast("string").alias("font_sha256"), (F.col("l_returnflag") != "A").cast("int").alias("counts_toward_global_quorum"))
    return review.independent_sources(evidence)
