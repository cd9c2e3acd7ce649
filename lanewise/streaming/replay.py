"""The reviewed ledger as keyed state: a saved event costs its own review, not the ledger.

Baseline rows and events come in one stream. Each review has one state: its baseline
row and its last event by ``seq``. What a micro-batch changes is recomputed by the same
columns as the batch replay and appended as that batch's part of the ledger; a reader takes
each review's row of its latest batch. A batch that is run again after a failure
overwrites its own part.

Cases: events that come late (a smaller ``seq``) or again (the same) change nothing; an event
before its baseline waits for it; a baseline that comes again replaces the old one and
the last event is applied to it anew; null review ids are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import review

#: What the stream carries: ``kind`` is ``baseline`` or ``event``, ``body`` the row as JSON.
SCHEMA = "review_id string, kind string, seq long, body string"
_STATE = "baseline string, seq long, event string"
_CHANGED = "review_id string, baseline string, event string"


def as_messages(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of the ledger's baseline or of events in the stream's form."""
    seq = F.col("seq").cast("long") if kind == "event" else F.lit(None).cast("long")
    body = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.filter("review_id IS NOT NULL").select("review_id", F.lit(kind).alias("kind"), seq.alias("seq"), body.alias("body"))


def _keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A review's baseline and last event; a row if it has a baseline and either changed."""
    baseline, seq, event = state.get if state.exists else (None, None, None)
    changed = False
    for frame in frames:
        for kind, number, body in zip(frame["kind"], frame["seq"], frame["body"], strict=True):
            if kind == "baseline":
                changed, baseline = changed or body != baseline, body
            elif seq is None or number > seq:
                changed, seq, event = True, int(number), body
    state.update((baseline, seq, event))
    if changed and baseline is not None:
        yield pd.DataFrame([(key[0], baseline, event)], columns=["review_id", "baseline", "event"])


def replay_changed(changed: DataFrame, baseline: StructType, events: StructType) -> DataFrame:
    """Ledger rows of the changed reviews."""
    rows = changed.select(F.from_json("baseline", baseline).alias("b")).select("b.*")
    last = changed.filter("event IS NOT NULL").select(F.from_json("event", events).alias("e")).select("e.*")
    return review.replay(rows, last)


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, baseline: StructType, events: StructType) -> StreamingQuery:
    """Start a query that takes what is in ``source``, then stops."""

    def apply(batch: DataFrame, number: int) -> None:
        # one file a batch would be re-read for each output; the changed rows are few
        replay_changed(batch, baseline, events).write.mode("overwrite").parquet(f"{target}/batch={number}")

    messages = spark.readStream.schema(SCHEMA).parquet(source)
    changed = messages.groupBy("review_id").applyInPandasWithState(_keep, _CHANGED, _STATE, "update", GroupStateTimeout.NoTimeout)
    return changed.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The ledger as of the last batch: each review's latest row."""
    rows = spark.read.option("basePath", target).option("mergeSchema", "true").parquet(target)
    last = rows.groupBy("review_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["review_id", "batch"], "left_semi").drop("batch")
