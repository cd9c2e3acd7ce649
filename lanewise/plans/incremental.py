"""Recompute only what changed: one fingerprint per part, parts overwritten in place.

A part's fingerprint is the hash of its rows' hashes, in order, together with the
version of the code and of the assets that it depends on. Parts whose fingerprint
is known are left alone; the others are recomputed and overwrite their own folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprints(rows: DataFrame, part: str, depends: str) -> DataFrame:
    """``part, fingerprint``: independent of row order, sensitive to repeats.

    Rows are hashed (SHA-256) and the four quarters of their hashes added up as
    numbers, which combine before the shuffle, so a part of any size costs one row
    per task; two parts that differ agree with a chance of about 2**-256.
    """
    whole = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    quarters = [F.conv(F.substring("_h", 16 * k + 1, 16), 16, 10).cast("decimal(38,0)").alias(f"q{k}") for k in range(4)]
    hashed = rows.select(part, whole.alias("_h")).select(part, *quarters)
    sums = hashed.groupBy(part).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"q{k}").alias(f"q{k}") for k in range(4)))
    return sums.select(part, F.sha2(F.concat_ws("|", F.lit(depends), *(F.col(c).cast("string") for c in ("n", "q0", "q1", "q2", "q3"))), 256).alias("fingerprint"))


def _known(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def _clear(spark: SparkSession, path: str, parts: DataFrame, part: str) -> None:
    """Remove the folders of ``parts`` from ``path/data``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for row in parts.select(F.col(part).cast("string")).distinct().toLocalIterator():
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/data/{escape(part, row[0])}"), True)


def refresh(rows: DataFrame, part: str, depends: str, compute: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Bring ``path/data`` up to date with ``rows`` and return the parts recomputed.

    ``compute`` maps the rows of whole parts to results that keep ``part``. Parts
    that are gone from ``rows``, and stale ones, lose their folders before the fresh
    rows are written, so a part with no result has none. The marks of these parts
    are dropped first and the new ones written last: a run that fails in between is
    repeated for them.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[part]
    schema = f"`{part}` {kind}, fingerprint string"
    now = fingerprints(rows, part, depends)
    before = _known(spark, f"{path}/marks", schema)
    now.write.mode("overwrite").parquet(f"{path}/now")
    now = spark.read.schema(schema).parquet(f"{path}/now")
    now.join(before, [part, "fingerprint"], "left_anti").write.mode("overwrite").parquet(f"{path}/stale")
    stale = spark.read.schema(schema).parquet(f"{path}/stale")
    kept = before.join(now, [part, "fingerprint"], "left_semi")
    gone = before.join(now.select(part), part, "left_anti").select(part).unionByName(stale.select(part))
    gone.write.mode("overwrite").parquet(f"{path}/gone")
    _swap(spark, kept, f"{path}/marks", schema)
    _clear(spark, path, spark.read.schema(f"`{part}` {kind}").parquet(f"{path}/gone"), part)
    fresh = compute(rows.join(stale.select(part), part, "left_semi"))
    fresh.write.mode("overwrite").partitionBy(part).option("partitionOverwriteMode", "dynamic").parquet(f"{path}/data")
    _swap(spark, _known(spark, f"{path}/marks", schema).unionByName(stale), f"{path}/marks", schema)
    return stale


def _swap(spark: SparkSession, marks: DataFrame, path: str, schema: str) -> None:
    """Replace the marks by a table that is made from them."""
    marks.write.mode("overwrite").parquet(f"{path}-next")
    spark.read.schema(schema).parquet(f"{path}-next").write.mode("overwrite").parquet(path)
