"""Connected components of link rows, by hooks and pointer jumps over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where a local session names no ``spark.checkpoint.dir`` (tests).
DEFAULT_SHARED_DIR = "/tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """The rows from a checkpoint in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()


def _shared(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or DEFAULT_SHARED_DIR


def connected(links: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """``keys, node, root``: for every linked node the smallest node it reaches.

    Nodes live inside their ``keys``, which aren't null. Each round hooks every node to its
    smallest neighbour, follows these pointers to their ends by doubling, and contracts the
    links, so a long way costs the logarithm of its length.
    """
    keys = list(keys)
    ends = links.select(*keys, F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).filter("_a <> _b").distinct()
    ends, roots = cut(ends), None
    while not ends.isEmpty():
        both = ends.unionByName(ends.select(*keys, F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        hooks = cut(both.groupBy(*keys, F.col("_a").alias("node")).agg(F.least("node", F.min("_b")).alias("to")))
        moved = True
        while moved:
            onward = hooks.select(*keys, F.col("node").alias("to"), F.col("to").alias("_next"))
            jumped = cut(hooks.join(onward, [*keys, "to"]).select(*keys, "node", F.col("_next").alias("to"), (F.col("_next") != F.col("to")).alias("_moved")))
            moved, hooks = not jumped.filter("_moved").isEmpty(), jumped.drop("_moved")
        if roots is None:
            roots = hooks.withColumnRenamed("to", "root")
        else:
            roots = cut(roots.join(hooks.withColumnRenamed("node", "root"), [*keys, "root"], "left").select(*keys, "node", F.coalesce("to", "root").alias("root")))
        for side in ("_a", "_b"):
            ends = ends.join(hooks.withColumnRenamed("node", side), [*keys, side]).drop(side).withColumnRenamed("to", side)
        ends = cut(ends.select(*keys, F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).filter("_a <> _b").distinct())
    if roots is None:
        return ends.select(*keys, F.col("_a").alias("node"), F.col("_b").alias("root"))
    return roots
