"""Delivery of intents from a stream: each once, and the same payload every time.

An addition to the batch operators: the outbox as Structured Streaming. Intents
arrive as files; each micro-batch delivers those whose id has no receipt yet and
appends receipts, so a batch replayed after a failure delivers nothing twice. An
id that comes again with another payload is kept apart as a conflict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyed import unanimous

SCHEMA = "intent_id string, digest string, payload string"


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], SCHEMA)


def settle(batch: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New deliveries and conflicts of one batch, given the receipts so far."""
    known = receipts.groupBy("intent_id").agg(F.min("digest").alias("_had"))
    agreed = unanimous(batch, ["intent_id"], "digest").select("intent_id", "resolved")
    rows = batch.dropDuplicates(["intent_id", "digest"]).join(agreed, "intent_id").join(known, "intent_id", "left")
    fresh = rows.filter("resolved IS NOT NULL AND _had IS NULL").select("intent_id", "digest", "payload")
    clash = rows.filter("resolved IS NULL OR _had <> digest").select("intent_id", "digest", "payload")
    return fresh, clash


def deliver(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Start a query that takes what is in ``source``, then stops."""

    def apply(batch: DataFrame, number: int) -> None:
        # folders are named by batch: a replay overwrites its own, and sees only earlier ones
        done = _read(spark, f"{target}/receipts").withColumn("_b", F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("long"))
        fresh, clash = settle(batch, done.filter(F.col("_b") < number).drop("_b"))
        clash.write.mode("overwrite").parquet(f"{target}/conflicts/batch={number}")
        fresh.write.mode("overwrite").parquet(f"{target}/receipts/batch={number}")

    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
