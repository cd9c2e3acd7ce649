"""Strict JSON, sealed documents, evidence rows and lane drift, seeded with faults by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sealed
from .tables import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


#: The same text in both engines.
_TEXT = """CASE WHEN event_id % 7 = 0 THEN concat(substring(props, 1, length(props) - 1), ', "k": 1, "é": {"k": 2}, "k": [3]}')
  WHEN event_id % 11 = 0 THEN concat(replace('{"a": {"k": "}, ~"k~": 1", "b": [', '~', chr(92)), props, ', {"x": 1, "x": 2, "y": [2, {"x": 3, "z": 5, "x": 4}]}]}, "e": "k"}')
  WHEN event_id % 13 = 0 THEN concat(props, '}') ELSE props END"""
_PATHS = "('$', 1), ('$.a', 2), ('$.a.b[1]', 4), ('$.a.b[1].y[1]', 6)"


@query(f"""
WITH t AS (SELECT event_id, {_TEXT} AS t FROM events),
g AS (SELECT *, json_valid(t) AS ok FROM t),
k AS (SELECT event_id, path, depth, unnest(json_keys(t, path)) AS name FROM g, (VALUES {_PATHS}) p(path, depth) WHERE ok AND json_exists(t, path)),
n AS (SELECT event_id, path, depth, name, count(*) AS n FROM k GROUP BY ALL HAVING count(*) > 1)
SELECT event_id, 'repeated_key' AS fault, path, name, CAST(depth AS INTEGER) AS depth FROM (SELECT *, unnest(range(1, n)) FROM n)
UNION ALL SELECT event_id, 'invalid', NULL, NULL, NULL FROM g WHERE NOT coalesce(ok, false)""")
def json_repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events", "event_id", "props").withColumn("doc", F.expr(_TEXT))
    return sealed.json_faults(rows, "event_id", "doc")


_CANON = """concat('{"key":', o_orderkey, ',"note":"é / 好","priority":"', o_orderpriority, '","status":"', STATUS, '"}')"""


@query(f"""
WITH d AS (SELECT o_orderkey, sha256({_CANON.replace("STATUS", "o_orderstatus")}) AS sealed, sha256({_CANON.replace("STATUS", "CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END")}) AS now FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'invalid' WHEN o_orderkey % 11 = 0 THEN 'missing_seal' ELSE 'changed' END AS fault, CASE WHEN o_orderkey % 13 <> 0 THEN now END AS computed
FROM d WHERE o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 OR sealed <> now""")
def sealed_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    key = F.col("o_orderkey")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    seal = F.sha2(F.expr(_CANON.replace("STATUS", "o_orderstatus")), 256)
    status = F.when(key % 9 == 0, "X").otherwise(F.col("o_orderstatus"))
    parts = [F.concat(F.lit('"status": '), text(status)), F.concat(F.lit('"note" : '), F.lit('"é / \\u597d"')), F.concat(F.lit('"priority":'), text(F.col("o_orderpriority"))), F.concat(F.lit('"key": '), key.cast("string"))]
    parts += [F.when(key % 11 != 0, F.concat(F.lit(f'"{sealed.SEAL}": '), text(seal))), F.when(key % 13 == 0, F.lit('"key": 0'))]
    document = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    return sealed.seal_faults(rows.select("o_orderkey", document.alias("doc")), "o_orderkey", "doc")


_LANE = """
WITH s AS (SELECT o_orderkey AS k, o_orderkey % 6 <> 0 AS seen, CASE o_orderstatus WHEN 'F' THEN 'ㄅㄚ' WHEN 'O' THEN 'ㄅㄛˊ' ELSE 'ㄅ' END AS r, CAST(o_custkey AS DOUBLE) AS x FROM orders)"""


@query(f"""{_LANE}
SELECT CAST(k AS VARCHAR) AS occurrence_id, 'missing' AS field, NULL AS was, NULL AS now FROM s WHERE k % 37 = 0
UNION ALL SELECT concat('new', k), 'unknown', NULL, NULL FROM s WHERE k % 41 = 0
UNION ALL SELECT CAST(k AS VARCHAR), 'review_id', concat('r', k), 'r0' FROM s WHERE k % 37 <> 0 AND k % 17 = 0 AND k <> 0
UNION ALL SELECT CAST(k AS VARCHAR), 'actual', r, 'ㄇㄚ' FROM s WHERE k % 37 <> 0 AND seen AND k % 19 = 0
UNION ALL SELECT CAST(k AS VARCHAR), 'actual_evidence', 'decoded', '' FROM s WHERE k % 37 <> 0 AND seen AND k % 23 = 0
UNION ALL SELECT CAST(k AS VARCHAR), 'state', 'EXCLUDED_OUT_OF_SCOPE', 'PASS' FROM s WHERE k % 37 <> 0 AND NOT seen AND k % 5 = 0
UNION ALL SELECT CAST(k AS VARCHAR), 'exclusion_reason', 'off page', 'other' FROM s WHERE k % 37 <> 0 AND NOT seen AND k % 7 = 0
UNION ALL SELECT CAST(k AS VARCHAR), 'x0', concat(x, ''), concat(x + 0.5, '') FROM s WHERE k % 37 <> 0 AND k % 29 = 0""")
def lane_drift_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_custkey")
    k, seen = F.col("o_orderkey"), F.col("o_orderkey") % 6 != 0
    name = k.cast("string")
    read_as = F.when(F.col("o_orderstatus") == "F", "ㄅㄚ").when(F.col("o_orderstatus") == "O", "ㄅㄛˊ").otherwise("ㄅ")
    box = {"x0": F.col("o_custkey").cast("double")}
    source = rows.select(name.alias("occurrence_id"), F.when(seen, "actual").otherwise("structural").alias("kind"), F.concat(F.lit("r"), name).alias("review_id"), read_as.alias("actual"), F.lit("decoded").alias("actual_evidence"), F.when(~seen, "off page").alias("exclusion_reason"), *(c.alias(n) for n, c in box.items()))
    now = rows.filter("o_orderkey % 37 <> 0").select(
        name.alias("occurrence_id"), F.when((k % 17 == 0) & (k != 0), "r0").otherwise(F.concat(F.lit("r"), name)).alias("review_id"), F.when(k % 19 == 0, "ㄇㄚ").otherwise(F.concat(F.lit(" "), read_as)).alias("actual"),
        F.when(k % 23 != 0, "decoded").alias("actual_evidence"), F.when(seen | (k % 5 == 0), "PASS").otherwise(sealed.EXCLUDED_STATE).alias("state"), F.lit(sealed.EXCLUDED_VIEW).alias("source_view"),
        F.when(~seen, F.when(k % 7 == 0, "other").otherwise("off page")).alias("exclusion_reason"), F.when(k % 29 == 0, box["x0"] + 0.5).otherwise(box["x0"]).alias("x0"),
    )
    extra = rows.filter("o_orderkey % 41 = 0").select(F.concat(F.lit("new"), name).alias("occurrence_id"))
    return sealed.lane_drift(source, now.unionByName(extra, allowMissingColumns=True), ["x0"])


@query("""
WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS kind, p_size AS n, md5(p_name) AS h, p_brand FROM part),
e AS (SELECT k, kind, n, CASE WHEN n % 5 = 0 THEN h WHEN n % 5 = 1 THEN upper(concat(h, h)) WHEN n % 5 = 2 THEN concat(h, h, 'z') ELSE concat(h, h) END AS sha, n % 3 = 0 AS exact FROM p)
SELECT k AS p_partkey, 'reading' AS fault FROM e WHERE kind <> 3 AND k % 7 = 0
UNION ALL SELECT k, 'glyph_sha256' FROM e WHERE kind = 1 AND exact AND length(sha) <> 64
UNION ALL SELECT k, 'exact_key' FROM e WHERE kind = 2 AND exact AND (k % 8 = 2 OR length(sha) <> 64)
UNION ALL SELECT k, 'conflict_kind' FROM e WHERE kind = 3 AND n % 4 = 1
UNION ALL SELECT k, 'conflict_sha256' FROM e WHERE kind = 3 AND length(sha) <> 64
UNION ALL SELECT k, 'conflict_status' FROM e WHERE kind = 3 AND n % 6 = 2
UNION ALL SELECT k, 'conflict_readings' FROM e WHERE kind = 3 AND n % 4 <> 3""")
def evidence_row_faults(spark: SparkSession, d: str) -> DataFrame:
    k, n, h = F.col("p_partkey"), F.col("p_size"), F.md5("p_name")
    two = F.concat(h, h)
    sha = F.when(n % 5 == 0, h).when(n % 5 == 1, F.upper(two)).when(n % 5 == 2, F.concat(two, F.lit("z"))).otherwise(two)
    rows = read(spark, d, "part", "p_partkey", "p_size", "p_name").select(
        "p_partkey", F.element_at(F.array(*map(F.lit, ("override", "glyf", "cff", "conflict"))), (k % 4 + 1).cast("int")).alias("kind"), F.when(k % 7 == 0, "none").when(k % 7 == 1, "").otherwise("ㄅㄚˊ").alias("reading"),
        F.when(n % 3 == 0, sealed.EXACT_LEVEL).otherwise("SINGLE").alias("verification_level"), sha.alias("glyph_sha256"), F.when(k % 8 != 2, "kai").alias("style_group"), F.when(n % 4 != 1, " CFF_GLYPH_SHA256").otherwise("other").alias("conflict_kind"),
        F.when(n % 6 != 2, sealed.CONTESTED_STATE).alias("status"), F.when(n % 4 == 3, "ㄅㄚ|ㄅㄚˊ|").when(n % 4 == 1, "ㄅㄚ|ㄅㄚ").otherwise("ㄅㄚ|none").alias("readings"),
    )
    return sealed.evidence_faults(rows, "p_partkey")
