"""A ledger followed event by event against a replay of everything."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lanewise.operators import ledger, review
from lanewise.streaming import replay

EVENT = "review_id string, seq int, action string, expected_set string, evidence string, target_snapshot string, actual_snapshot string, gates map<string,boolean>"


@pytest.fixture(scope="module")
def baseline(spark):
    rows = [(f"o{k}", f"r{k}", "ㄅ", None if k % 2 else "ㄆ", "e", f"t{k}", f"a{k}") for k in range(8)]
    df = spark.createDataFrame(rows, "occurrence_id string, review_id string, actual string, expected_set string, actual_evidence string, target_snapshot string, actual_snapshot string")
    blank = {c: F.lit(None).cast("string") for c in ("actual_status", "expected_status", "exclusion_state", "blocking_state", "state")}
    df = df.withColumns({"expected_evidence": F.when(F.col("expected_set").isNotNull(), "d"), **blank}).withColumn("confirmation_gates", F.lit(None).cast("map<string,boolean>"))
    df = ledger.refreshed(df)
    return spark.createDataFrame(df.collect(), df.schema)


def event(k, seq, action, **other):
    gates = dict.fromkeys(ledger.CONFIRMATIONS, True)
    return (f"r{k}", seq, action, other.get("expected"), "me", other.get("target", f"t{k}"), other.get("actual", f"a{k}"), gates)


BATCHES = [
    [event(1, 1, "supply", expected="ㄆ"), event(2, 1, "exclude")],
    [event(1, 3, "supply", expected="ㄅ"), event(3, 1, "exclude", target="old")],
    [event(1, 2, "exclude"), event(1, 3, "exclude"), event(2, 1, "exclude")],  # late and again
    [event(0, 1, "confirm"), event(4, 1, "confirm", actual="old"), event(2, 5, "keep"), event(5, 1, "exclude"), event(5, 2, "supply", expected="ㄅ")],
]


def facts(df):
    return {r.review_id: (r.state, r.event_status, r.expected_set, r.comparison_result, r.active_review) for r in df.collect()}


def test_followed_batch_by_batch(spark, baseline, tmp_path, monkeypatch):
    source, target, mark = (str(tmp_path / n) for n in ("in", "ledger", "mark"))
    kinds = spark.createDataFrame([], EVENT).schema

    def send(rows, kind, n):
        replay.as_messages(rows, kind).coalesce(1).write.mode("append").parquet(source)
        replay.follow(spark, source, target, mark, baseline.schema, kinds).awaitTermination()

    early = baseline.filter("review_id <> 'r5'")
    send(early, "baseline", 0)
    assert facts(replay.current(spark, target)) == facts(review.replay(early, spark.createDataFrame([], EVENT)))
    sent = []
    for n, rows in enumerate(BATCHES):
        batch = spark.createDataFrame(rows, EVENT)
        sent += rows
        if n == 1:
            whole = replay.replay_changed

            def broken(*args):
                whole(*args).write.format("noop").mode("overwrite").save()
                raise RuntimeError("lost on the way")

            with monkeypatch.context() as patch:
                patch.setattr(replay, "replay_changed", broken)
                with pytest.raises(Exception, match="lost on the way"):
                    send(batch, "event", n)
            replay.follow(spark, source, target, mark, baseline.schema, kinds).awaitTermination()
        else:
            send(batch, "event", n)
        # of one seq the first to come stays
        firsts = {(e[0], e[1]): e for e in reversed(sent)}
        known = [e for e in firsts.values() if e[0] != "r5"]
        assert facts(replay.current(spark, target)) == facts(review.replay(early, spark.createDataFrame(known, EVENT)))
    send(baseline.filter("review_id = 'r5'"), "baseline", 9)
    full = review.replay(baseline, spark.createDataFrame([*firsts.values()], EVENT))
    assert facts(replay.current(spark, target)) == facts(full)
    parts = spark.read.option("basePath", target).parquet(target).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in parts)[:2] == [1, 2] and facts(full)["r5"][0] == "PASS"
