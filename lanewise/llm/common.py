"""Shared plumbing: tables in the cluster's shared folder, grouped streaming
over sorted partitions, splitting of hot groups, and connected components.

Nothing here keeps state on a machine-local disk, and nothing collects rows
that grow with the input to the driver.
"""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Used only where a local session names no ``spark.checkpoint.dir`` (tests).
DEFAULT_SHARED_DIR = "/tmp/checkpoints"
#: Rows of an Arrow batch: a row may be a whole document, so fewer than Spark's default of 10,000.
BATCH_ROWS = 1_000
#: Keys that hold more than one row in so many are hot: there are fewer of them than this.
HOT_SHARE = 1_024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from the session's own settings."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or DEFAULT_SHARED_DIR


def named(column: str, of: str = "") -> Column:
    """A column by its own name, whatever is in it: dots, spaces, backticks."""
    quoted = "`" + column.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def whole_row(columns: list[str]) -> Column:
    """The columns as one struct ``row``, which Python passes on untouched."""
    return F.struct(*(named(c).alias(c) for c in columns)).alias("row")


def with_row(rows: DataFrame, others: str = "") -> StructType:
    """The schema of ``row`` and then ``others``."""
    more = StructType.fromDDL(others).fields if others else []
    return StructType([StructField("row", rows.schema["row"].dataType), *more])


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, unless the session says how much that is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


class Workspace:
    """Intermediate tables of one operator run, as Parquet in the shared folder.

    Writing cuts lineage, so a lost executor costs one stage and not the whole
    job. ``drop`` removes a table once everything read from it is written; all
    that is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/lanewise/{label}-{uuid.uuid4().hex}"
        self.marked = False
        small_batches(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = f"{self.root}/{name}", df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        if not self.marked:
            root, files = self._path(self.root)
            files.deleteOnExit(root)
            self.marked = True
        del df  # its shuffle files can go, unless the caller keeps the frame
        self.release()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._path(f"{self.root}/{name}")
            files.delete(path, True)

    def _path(self, name: str):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())

    def release(self) -> None:
        """Let the context cleaner remove shuffle files of finished jobs now."""
        gc.collect()  # first the handles on this side
        self.spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for explicit repartitions: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_group(
    df: DataFrame, key: str, order: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, rows: int = 65_536
) -> DataFrame:
    """Run ``fn`` over runs of whole ``key`` groups.

    Rows are dealt by ``key`` and sorted by ``key`` and ``order`` within each
    partition (a spilling JVM sort); Python then sees tables of about ``rows``
    rows that never cut a group. The caller bounds the size of a group.
    """
    dealt = df.repartition(shuffle_width(df.sparkSession), F.col(key)).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < rows:
                continue
            whole = pa.Table.from_batches(held)
            keys = whole.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut == 0:
                continue
            out = fn(whole.slice(0, cut))
            if out is not None and out.num_rows:
                yield out
            held, n = whole.slice(cut).combine_chunks().to_batches(), whole.num_rows - cut
        if n:
            out = fn(pa.Table.from_batches(held))
            if out is not None and out.num_rows:
                yield out

    return dealt.mapInArrow(run, schema)


def blocks_of_groups(ws: Workspace, df: DataFrame, key: str, member: str, block: int, name: str = "sizes") -> DataFrame:
    """Split groups of more than ``block`` rows so that pairs still meet.

    A group of n rows is dealt to b = ceil(n / block) blocks by a hash of
    ``member``; each unordered pair of blocks is one unit of work and each row
    goes to the b units it takes part in. Adds ``unit`` (long, the new group
    key), ``own`` and ``other`` (the two blocks) and ``blk`` (the row's own). A
    group of one block yields one unit. Every pair of rows meets in at least
    one unit; the two rows of a pair in the same block b meet in unit (b, b)
    and also in (b, x), so a unit with own != other compares across blocks only.
    Rows of hot groups are dealt where they are, without meeting in a task.
    """
    sizes = ws.write(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), name)
    return deal_blocks(join_hot(df, sizes, key, "_n"), key, [member], block)


def deal_blocks(sized: DataFrame, key: str, members: list[str], block: int) -> DataFrame:
    """The split of ``blocks_of_groups`` for rows that have their group's size in ``_n``."""
    blocks = F.ceil(F.col("_n") / F.lit(block))
    sized = sized.withColumn("_b", blocks).withColumn("blk", F.pmod(F.xxhash64(*members, F.lit(7)), F.col("_b")).cast("int"))
    sized = sized.withColumn("_x", F.explode(F.sequence(F.lit(0), (F.col("_b") - 1).cast("int"))))
    sized = sized.withColumn("own", F.least("blk", "_x")).withColumn("other", F.greatest("blk", "_x"))
    return sized.withColumn("unit", F.xxhash64(F.col(key), F.col("own"), F.col("other"))).drop("_n", "_b", "_x")


def deal_once(sized: DataFrame, key: str, members: list[str], block: int, shared: int = 8) -> DataFrame:
    """A first look at groups: each row, with its group's size in ``_n``, goes to one block of its group.

    About ``shared`` rows of a group, taken by hash, go to all its blocks, so that what
    is near them is joined across blocks. Rows grow in proportion. Adds ``unit`` and the columns
    of ``blocks_of_groups``; the pairs of different blocks are left to ``deal_apart``.
    """
    blocks = F.ceil(F.col("_n") / F.lit(block))
    own = F.pmod(F.xxhash64(*members, F.lit(7)), blocks).cast("int")
    everywhere = F.pmod(F.xxhash64(*members, F.lit(11)), F.col("_n")) < shared
    dealt = sized.withColumn("blk", F.explode(F.when(everywhere, F.sequence(F.lit(0), (blocks - 1).cast("int"))).otherwise(F.array(own))))
    return dealt.withColumn("own", F.col("blk")).withColumn("other", F.col("blk")).withColumn("unit", F.xxhash64(key, "blk")).drop("_n")


def deal_apart(df: DataFrame, counts: DataFrame, key: str, label: str, members: list[str], block: int) -> DataFrame:
    """Split groups into pairs of blocks so that rows of different labels still meet, and as few others as can be.

    ``counts`` has ``(key, label, _n)``, numbers of rows that may be rough, of the groups that
    are to be split: a written table. A label of more than ``block`` rows has blocks of its own, which meet all but
    each other; a group of one large label and few other rows so takes rows in proportion to it.
    Only pairs of large labels, or of very many small ones, take more: those all have to be compared.
    Columns as in ``blocks_of_groups``; a unit with own != other compares across blocks only.
    """
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    large = counts.filter(F.col("_n") > block).select(key, label, blocks.alias("_b"))
    large = large.withColumn("_at", F.sum("_b").over(Window.partitionBy(key).orderBy(label)).cast("int") - F.col("_b"))
    small = F.sum(F.when(F.col("_n") > block, 0).otherwise(F.col("_n")))
    groups = counts.groupBy(key).agg(F.greatest(F.lit(1), F.ceil(small / F.lit(block))).cast("int").alias("_r"), F.sum(F.when(F.col("_n") > block, blocks).otherwise(0)).cast("int").alias("_l"))
    sized = df.join(F.broadcast(groups), key, "left").join(F.broadcast(large), [key, label], "left").fillna(1, ["_r"]).fillna(0, ["_l"])
    start = F.when(F.col("_b").isNull(), 0).otherwise(F.col("_r") + F.col("_at"))
    count = F.coalesce("_b", "_r")
    last = F.col("_r") + F.col("_l") - 1
    beyond = F.when(start + count <= last, F.sequence(start + count, last)).otherwise(F.array().cast("array<int>"))
    others = F.concat(F.sequence(F.lit(0), start - 1), beyond)  # of a large label, which has small ones before it
    sized = sized.withColumn("blk", (start + F.pmod(F.xxhash64(*members, F.lit(7)), count)).cast("int"))
    sized = sized.withColumn("_x", F.explode(F.when(F.col("_b").isNull(), F.sequence(F.lit(0), last)).otherwise(others)))
    sized = sized.withColumn("own", F.least("blk", "_x")).withColumn("other", F.greatest("blk", "_x"))
    return sized.withColumn("unit", F.xxhash64(key, "own", "other")).drop("_r", "_l", "_b", "_at", "_x")


def label_counts(ws: Workspace, df: DataFrame, key: str, label: str, block: int, name: str) -> DataFrame:
    """``counts`` for ``deal_apart``: of groups with more than ``block`` rows."""
    by_label = ws.write(df.groupBy(key, label).agg(F.count(F.lit(1)).alias("_n")), f"{name}-all")
    hot = by_label.groupBy(key).agg(F.sum("_n").alias("_t")).filter(F.col("_t") > block).select(key)
    return ws.write(by_label.join(hot, key, "left_semi"), name)


def join_hot(left: DataFrame, right: DataFrame, key: str, size: str = "n") -> DataFrame:
    """Inner join where ``right`` has one row a key, and in ``size`` how many ``left`` rows it meets.

    Rows of hot keys (one in ``HOT_SHARE`` of all or more, so at most that many keys)
    stay where they are and meet a broadcast; only the others are shuffled by key.
    Both sides are read more than once, so they should be written tables.
    """
    total = right.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT_SHARE >= total
    there = left.join(F.broadcast(right.filter(hot)), key)
    others = left.join(F.broadcast(right.filter(hot).select(key)), key, "left_anti")
    return there.unionByName(others.join(right.filter(~hot), key))


_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """This Python worker's cache for one operator.

    Workers outlive tasks and jobs; what another operator has left here is dropped
    first, so that a worker never holds more than one operator's cache.
    """
    if owner not in _caches:
        left = any(_caches.values())
        _caches.clear()
        if left and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
    return _caches.setdefault(owner, {})


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable for each of n nodes, by pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        label = new
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def connected_components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Components of an edge list ``(src long, dst long)``.

    Returns ``(node, component_id)`` for every node with an edge;
    ``component_id`` is the smallest node reachable. Each round hooks every
    node to its smallest neighbour, follows two pointers, and contracts the
    edges; the number of rounds is logarithmic in the longest shortest path.
    Minimums are combined before the shuffle, and hot nodes only occur in
    joins, which adaptive execution splits. Self loops and repeats are allowed.
    """
    edges = ws.write(edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), f"{name}-e0")
    labels = None
    k = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hooks = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("m"))
        hooks = ws.write(hooks, f"{name}-h{k}")
        jump = hooks.join(hooks.select(F.col("node").alias("m"), F.col("m").alias("mm")), "m").select("node", F.col("mm").alias("to"))
        jump = ws.write(jump, f"{name}-j{k}")
        if labels is None:
            labels = jump.select("node", F.col("to").alias("component_id"))
        else:
            labels = labels.join(jump.select(F.col("node").alias("component_id"), "to"), "component_id", "left").select("node", F.coalesce("to", "component_id").alias("component_id"))
            labels = ws.write(labels, f"{name}-l{k}")
        contracted = edges.join(jump.select(F.col("node").alias("src"), F.col("to").alias("s")), "src").join(jump.select(F.col("node").alias("dst"), F.col("to").alias("d")), "dst")
        contracted = contracted.filter("s <> d").select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).distinct()
        edges = ws.write(contracted, f"{name}-e{k + 1}")
        k += 1
    if labels is None:
        return ws.spark.createDataFrame([], "node long, component_id long")
    return labels


def chained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Components of nodes, of which ``outer`` has those of ``inner``'s labels: ``(node, component_id)`` of the nodes in either."""
    nodes = inner.unionByName(outer.select("node", F.col("node").alias("component_id"))).distinct()
    moved = outer.select(F.col("node").alias("component_id"), F.col("component_id").alias("to"))
    return nodes.join(moved, "component_id", "left").select("node", F.coalesce("to", "component_id").alias("component_id"))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    for value in column:
        raw = value.as_buffer() if value.is_valid else None
        yield raw.to_pybytes() if raw is not None else b""


def repo_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
