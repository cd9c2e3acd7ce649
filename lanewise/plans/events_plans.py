"""Ordered and event-sourced queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import reconcile, sequence
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


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")


def _order():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("""
WITH e AS (SELECT event_id, substr(event_type, 1, 1) AS c, row_number() OVER w AS rn, lag(substr(event_type, 1, 1), 2) OVER w AS b2, lag(substr(event_type, 1, 1), 1) OVER w AS b1, lead(substr(event_type, 1, 1), 1) OVER w AS a1, lead(substr(event_type, 1, 1), 2) OVER w AS a2
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, concat(b2, b1, c, a1, a2) AS context, CAST(least(rn - 1, 2) AS INTEGER) AS context_offset FROM e""")
def neighbor_context_concat(spark: SparkSession, d: str) -> DataFrame:
    return sequence.neighbourhood(_events(spark, d), ["user_id"], ["ts", "event_id"], F.substring("event_type", 1, 1), 2, "context").select("event_id", "context", "context_offset")


@query("""
SELECT event_id, event_type, CASE lead(event_type) OVER w WHEN 'purchase' THEN 'before_purchase' WHEN 'click' THEN 'before_step' WHEN 'view' THEN 'before_step' WHEN 'signup' THEN 'before_step' END AS label
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lead_dependent_label(spark: SparkSession, d: str) -> DataFrame:
    following = F.lead("event_type").over(_order())
    label = F.when(following == "purchase", "before_purchase").when(following.isin("click", "view", "signup"), "before_step")
    return _events(spark, d).select("event_id", "event_type", label.alias("label"))


@query("""
SELECT event_id, event_type, coalesce(event_type = lag(event_type) OVER w, false) AND (lag(event_type, 2) OVER w IS NULL OR event_type <> lag(event_type, 2) OVER w) AS second_of_pair
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lag_pair_rule(spark: SparkSession, d: str) -> DataFrame:
    one, two = F.lag("event_type", 1).over(_order()), F.lag("event_type", 2).over(_order())
    return _events(spark, d).select("event_id", "event_type", (F.coalesce(F.col("event_type") == one, F.lit(False)) & (two.isNull() | (F.col("event_type") != two))).alias("second_of_pair"))


@query("""
SELECT user_id, event_type, min(event_id) AS first_at, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id), event_type) AS appearance FROM events GROUP BY 1, 2""")
def first_appearance_rank(spark: SparkSession, d: str) -> DataFrame:
    return sequence.first_appearance(_events(spark, d), ["user_id"], "event_type", "event_id")


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT c_custkey, event_id AS last_event, event_type AS last_type, coalesce(event_type, 'none') AS action FROM customer LEFT JOIN (SELECT * FROM l WHERE n = 1) e ON e.user_id = c_custkey""")
def last_event_per_key(spark: SparkSession, d: str) -> DataFrame:
    last = _events(spark, d).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"))
    rows = read(spark, d, "customer", "c_custkey").join(last, F.col("c_custkey") == F.col("user_id"), "left")
    return rows.select("c_custkey", F.col("e.event_id").alias("last_event"), F.col("e.event_type").alias("last_type"), F.coalesce("e.event_type", F.lit("none")).alias("action"))


@query("""
WITH m AS (SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS after FROM events)
SELECT event_id, before, after FROM m WHERE before IS NOT NULL AND (before, after) NOT IN (VALUES ('view','click'), ('click','purchase'), ('signup','view'), ('view','view'), ('click','view'), ('purchase','view'), ('error','error'))""")
def transition_violations(spark: SparkSession, d: str) -> DataFrame:
    moves = _events(spark, d).select("event_id", F.lag("event_type").over(_order()).alias("before"), F.col("event_type").alias("after"))
    allowed = spark.createDataFrame([("view", "click"), ("click", "purchase"), ("signup", "view"), ("view", "view"), ("click", "view"), ("purchase", "view"), ("error", "error")], "before string, after string")
    return reconcile.transition_violations(moves, allowed, "before", "after").select("event_id", "before", "after")


@query("""
WITH i AS (SELECT event_id, user_id, event_id AS lo, event_id + CAST(floor(value) AS BIGINT) AS hi FROM events),
o AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
f AS (SELECT *, CASE WHEN reach IS NULL OR lo > reach THEN event_id END AS opened FROM o)
SELECT event_id, user_id, max(opened) OVER (PARTITION BY user_id ORDER BY lo, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS component FROM f""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("event_id", "user_id", F.col("event_id").alias("lo"), (F.col("event_id") + F.floor("value")).alias("hi"))
    return sequence.overlap_groups(rows, ["user_id"], "lo", "hi", "event_id", "component").select("event_id", "user_id", "component")


@query("""
SELECT event_id, user_id, sha256(event_type || '|' || user_id) AS digest, CASE WHEN r.k IS NULL THEN 'PENDING' ELSE 'DIGEST_MISMATCH' END AS delivery
FROM events LEFT JOIN (SELECT event_id AS k, CASE WHEN event_id % 7 = 0 THEN sha256('stale') ELSE sha256(event_type || '|' || user_id) END AS dg FROM events WHERE event_id % 3 = 0) r ON event_id = r.k
WHERE r.k IS NULL OR r.dg <> sha256(event_type || '|' || user_id)""")
def outbox_left_anti(spark: SparkSession, d: str) -> DataFrame:
    intents = _events(spark, d).select("event_id", "user_id", F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), 256).alias("digest"))
    receipts = intents.filter("event_id % 3 = 0").select("event_id", F.when(F.col("event_id") % 7 == 0, F.sha2(F.lit("stale"), 256)).otherwise(F.col("digest")).alias("digest"))
    return reconcile.undelivered(intents, receipts, "event_id", "digest")


@query("""
WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, event_id) AS v FROM events WHERE event_id % 2 = 1 AND user_id % 5 <> 0 GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.v IS NULL OR b.v IS NULL OR a.v = b.v THEN coalesce(a.v, b.v) END AS merged,
       CASE WHEN a.v IS NULL THEN 'import' WHEN b.v IS NULL THEN 'keep' WHEN a.v = b.v THEN 'duplicate' ELSE 'conflict' END AS outcome
FROM a FULL JOIN b ON a.user_id = b.user_id""")
def merge_first_wins(spark: SparkSession, d: str) -> DataFrame:
    last = lambda rows: rows.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("v"))
    events = _events(spark, d)
    return reconcile.merge_decisions(last(events.filter("event_id % 2 = 0")), last(events.filter("event_id % 2 = 1 AND user_id % 5 <> 0")), "user_id", "v")


@query("""
WITH base AS (SELECT event_id AS review_id, user_id, CASE WHEN value >= 250 THEN 'PENDING' ELSE 'CONFIRMED' END AS state, value FROM events WHERE event_type = 'view'),
ev AS (SELECT event_id - 1 AS review_id, arg_max(event_type, event_id) AS action, arg_max(floor(value / 100), event_id) AS seen FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT b.review_id, CASE WHEN e.action IS NULL THEN b.state WHEN e.action = 'error' THEN 'EXCLUDED' WHEN e.seen <> floor(b.value / 100) THEN 'INVALIDATED_DRIFT' WHEN e.action = 'purchase' THEN 'CONFIRMED' ELSE b.state END AS state
FROM base b LEFT JOIN ev e ON b.review_id = e.review_id""")
def event_replay(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    base = events.filter("event_type = 'view'").select(F.col("event_id").alias("review_id"), F.when(F.col("value") >= 250, "PENDING").otherwise("CONFIRMED").alias("s"), F.floor(F.col("value") / 100).alias("seen_now"))
    last = events.filter("event_type <> 'view'").select((F.col("event_id") - 1).alias("review_id"), "event_id", "event_type", F.floor(F.col("value") / 100).alias("seen"))
    last = last.groupBy("review_id").agg(F.max_by(F.struct("event_type", "seen"), "event_id").alias("e"))
    rows = base.join(last, "review_id", "left")
    state = F.when(F.col("e").isNull(), F.col("s")).when(F.col("e.event_type") == "error", "EXCLUDED").when(F.col("e.seen") != F.col("seen_now"), "INVALIDATED_DRIFT").when(F.col("e.event_type") == "purchase", "CONFIRMED").otherwise(F.col("s"))
    return rows.select("review_id", state.alias("state"))


def _merge_step(n: int) -> str:
    """Merge number ``n`` of ``s{n}`` into the events and conflicts of the one before."""
    return f"""
j{n} AS (SELECT coalesce(e.k, s.k) AS k, e.k IS NOT NULL AS ours, e.v, e.origin, e.others, s.k IS NOT NULL AS theirs, s.v AS sv, s.i, EXISTS (SELECT 1 FROM c{n - 1} c WHERE c.k = s.k AND c.si = s.i AND c.sv = s.v) AS told FROM e{n - 1} e FULL JOIN s{n} s ON s.k = e.k),
o{n} AS (SELECT *, CASE WHEN NOT theirs THEN 'keep' WHEN told THEN 'replayed' WHEN NOT ours THEN 'import' WHEN v = sv THEN 'duplicate' ELSE 'conflict' END AS outcome FROM j{n}),
e{n} AS (SELECT k, CASE outcome WHEN 'import' THEN sv ELSE v END AS v, CASE outcome WHEN 'import' THEN i ELSE origin END AS origin, CASE WHEN outcome = 'import' THEN [] WHEN outcome = 'duplicate' AND NOT list_contains(others, i) AND i IS DISTINCT FROM origin THEN list_append(others, i) ELSE others END AS others FROM o{n} WHERE outcome <> 'conflict' AND (ours OR outcome = 'import')),
c{n} AS (SELECT * FROM c{n - 1} UNION ALL SELECT k, i, origin, sv, v FROM o{n} WHERE outcome = 'conflict')"""


@query(f"""
WITH last AS (SELECT user_id AS k, event_id % 3 AS g, arg_max(event_type, event_id) AS v, max(event_id) AS i FROM events GROUP BY ALL),
e0 AS (SELECT k, v, CAST(NULL AS VARCHAR) AS origin, CAST([] AS VARCHAR[]) AS others FROM last WHERE g = 0 AND k % 7 <> 0),
c0 AS (SELECT k, 'a:1' AS si, CAST(NULL AS VARCHAR) AS ti, v AS sv, 'none' AS tv FROM last WHERE g = 1 AND false),
s1 AS (SELECT k, v, concat('a:', i) AS i FROM last WHERE g = 1), s2 AS (SELECT k, v, concat('b:', i) AS i FROM last WHERE g = 2), s3 AS (SELECT * FROM s1),
{_merge_step(1)}, {_merge_step(2)}, {_merge_step(3)}
SELECT k AS user_id, 'event' AS part, v AS payload, origin, array_to_string(others, ',') AS more FROM e3 UNION ALL SELECT k, 'conflict', sv, si, tv FROM c3 UNION ALL SELECT k, outcome, NULL, NULL, NULL FROM o3 WHERE theirs""")
def merge_with_provenance(spark: SparkSession, d: str) -> DataFrame:
    last = _events(spark, d).groupBy("user_id", (F.col("event_id") % 3).alias("g")).agg(F.max_by("event_type", "event_id").alias("payload"), F.max("event_id").alias("i"))
    events = last.filter("g = 0 AND user_id % 7 <> 0").select("user_id", "payload", F.lit(None).cast("string").alias("origin"), F.array().cast("array<string>").alias("others"))
    a, b = (last.filter(F.col("g") == g).select("user_id", "payload", F.concat(F.lit(f"{name}:"), "i").alias("identity")) for g, name in ((1, "a"), (2, "b")))
    conflicts = spark.createDataFrame([], "user_id long, source_identity string, target_identity string, source_payload string, target_payload string")
    for source in (a, b, a):  # the first project comes again
        events, conflicts, outcomes = reconcile.merge_source(events, source, conflicts, "user_id")
    none = F.lit(None).cast("string")
    rows = events.select("user_id", F.lit("event").alias("part"), "payload", "origin", F.array_join("others", ",").alias("more"))
    rows = rows.unionByName(conflicts.select("user_id", F.lit("conflict").alias("part"), F.col("source_payload").alias("payload"), F.col("source_identity").alias("origin"), F.col("target_payload").alias("more")))
    return rows.unionByName(outcomes.select("user_id", F.col("outcome").alias("part"), none.alias("payload"), none.alias("origin"), none.alias("more")))
