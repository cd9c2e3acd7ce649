"""A Merkle manifest of a dataset: one root, and a proof for every row.

Rows are the leaves of one tree for each source, by id; the trees' roots are the
leaves of a last tree, by source. Every ``FANOUT`` consecutive nodes become their
hash, a shorter last run too, without padding, until one node is left.

*Building.* Leaves are hashed where the texts are and go on as digests. They are
dealt by ranges of source and id, so a hot source is many ranges; the counts of the
ranges give each its first index. In a range a stack of unfinished runs, one for
each level, takes the leaves in order: a run that is full (or ends its level)
becomes a node of the level above, a carry that may fill the next run, and its
members go out as node records. Runs that a range's edge cuts go out as unfinished
peaks. Peaks are merged in rounds of ``BLOCK`` levels, grouped by the node above
them, so a group never holds more than ``FANOUT ** BLOCK`` nodes and the nodes
between; the rounds grow with the logarithm of the rows.

*Proving.* From the top down, blocks of ``BLOCK`` levels of node records receive
the siblings above them and pass theirs to the blocks below. A leaf's siblings are
hashed into its proof, and a row's present digest is folded with them into the root
it would give.

Cases: null fields are ``-``; null ids come first and are never tampered with by the
query; rows with equal ids are ordered by their digests, so repeated rows change
the root but their order doesn't; the null source comes first; extra columns are
ignored; an empty table gives an empty result and no root.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, by_group, shuffle_width, table

FANOUT = 3
BLOCK = 6
#: Leaves of a range, and those below which more ranges aren't worth a task.
RANGE_ROWS = 100_000
LEAST_ROWS = 10_000

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, total long, level int, idx long, digest string, pending boolean, doc_id long, other string"
_CARRIED = ("doc_id", "other")


def digest_of(*fields: Column) -> Column:
    """SHA-256 of the fields, each ``-`` or its UTF-8 byte count, a colon, and itself."""
    told = [F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")) for f in fields]
    return F.sha2(F.concat(*(F.coalesce(t, F.lit("-")) for t in told)), 256)


def node(members: list[str]) -> str:
    return hashlib.sha256("".join(members).encode()).hexdigest()


def widths(total: int) -> list[int]:
    """Nodes of each level over ``total`` leaves; the last is 1."""
    found = [total]
    while found[-1] > 1:
        found.append(-(-found[-1] // FANOUT))
    return found


class Peaks:
    """The stack over consecutive leaves of one tree; ``records`` gathers its nodes."""

    def __init__(self, tree: str | None, total: int, records: list[tuple]):
        self.tree, self.total, self.records = tree, total, records
        self.widths = widths(total)
        self.runs: list[list[tuple]] = [[] for _ in self.widths]

    def push(self, level: int, idx: int, digest: str, *carried) -> None:
        run = self.runs[level]
        run.append((idx, digest, *carried))
        last = idx == self.widths[level] - 1
        if idx % FANOUT != FANOUT - 1 and not last:
            return
        whole = run[0][0] % FANOUT == 0
        self.emit(level, pending=not whole)
        if whole and self.widths[level] > 1:
            self.push(level + 1, idx // FANOUT, node([m[1] for m in run]), *[None] * len(_CARRIED))

    def emit(self, level: int, pending: bool) -> None:
        self.records += [(self.tree, self.total, level, m[0], m[1], pending, *m[2:]) for m in self.runs[level]]
        self.runs[level] = []

    def close(self) -> None:
        for level in range(len(self.runs)):
            self.emit(level, pending=True)


def _batch(records: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in _NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*records, strict=True), kinds, strict=True)], names)


def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node records of the ranges whose leaves come in order."""
    peaks, at, idx, records = None, None, 0, []
    for batch in batches:
        for pid, tree, start, total, digest, *carried in zip(*(batch.column(c).to_pylist() for c in ("pid", "tree", "start", "total", "digest", *_CARRIED)), strict=True):
            if peaks is None or at != (pid, tree):
                if peaks is not None:
                    peaks.close()
                peaks, at, idx = Peaks(tree, total, records), (pid, tree), start
            peaks.push(0, idx, digest, *carried)
            idx += 1
        if records:
            yield _batch(records)
            records.clear()
    if peaks is not None:
        peaks.close()
    if records:
        yield _batch(records)


def _same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & a[c].eqNullSafe(b[c])
    return on


def _ancestor(level: int) -> Column:
    """Index of the node at ``level`` above each node."""
    return F.expr(f"idx div cast(pow({FANOUT}, {level} - level) as bigint)")


def merged(rows: pa.Table, base: int, block: int) -> pa.RecordBatch | None:
    """Nodes above unfinished peaks of ``block`` levels; the rows of one ``anc`` of a tree are together."""
    groups: dict[tuple, dict[tuple[int, int], str]] = defaultdict(dict)
    totals: dict[str | None, int] = {}
    for tree, total, anc, level, idx, digest in zip(*(rows.column(c).to_pylist() for c in ("tree", "total", "anc", "level", "idx", "digest")), strict=True):
        groups[tree, anc][level, idx] = digest
        totals[tree] = total
    top, records = base + block, []
    for (tree, _), nodes in groups.items():
        wide = widths(totals[tree])
        for level in range(base, min(top, len(wide) - 1)):
            runs = defaultdict(list)
            for _, idx in sorted(k for k in nodes if k[0] == level):
                runs[idx // FANOUT].append(nodes[level, idx])
            for idx, members in runs.items():
                if len(members) == min(FANOUT, wide[level] - FANOUT * idx):
                    nodes[level + 1, idx] = node(members)
                    records.append((tree, totals[tree], level + 1, idx, nodes[level + 1, idx], level + 1 == top, None, None))
    return _batch(records) if records else None


def build(ws: Workspace, leaves: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """All node records of the trees over ``leaves``, and the most levels of a tree.

    ``leaves`` is a written table of ``tree, digest, doc_id, other`` and the columns of ``order``.
    """
    spark = leaves.sparkSession
    rows = leaves.count()
    ranges = max(-(-rows // RANGE_ROWS), min(shuffle_width(spark), -(-rows // LEAST_ROWS)), 1)
    by = ["tree", *order]
    placed = ws.write(leaves.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("pid", F.spark_partition_id()), f"{name}-ranges")
    sizes = placed.groupBy("tree", "pid").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("tree")  # a row for each range
    start = F.coalesce(F.sum("n").over(w.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ws.write(sizes.select("tree", "pid", start.alias("start"), F.sum("n").over(w).alias("total")), f"{name}-sizes")
    most = sizes.agg(F.max("total")).first()[0] or 0
    indexed = placed.join(sizes.withColumnsRenamed({"tree": "t", "pid": "p"}), F.col("tree").eqNullSafe(F.col("t")) & (F.col("pid") == F.col("p"))).drop("t", "p")
    dealt = indexed.repartitionById(ranges, F.pmod("pid", F.lit(ranges))).sortWithinPartitions("pid", *by)
    nodes = ws.write(dealt.select("pid", "tree", "start", "total", "digest", *_CARRIED).mapInArrow(stacked, _NODE), f"{name}-nodes0")
    ws.drop(f"{name}-ranges")

    levels = len(widths(most)) if most else 0
    every, peaks = nodes, nodes.filter("pending")
    carried, block = None, BLOCK
    for base in range(0, levels, block):
        here = peaks.filter(f"level >= {base} AND level < {base + block}")
        if carried is not None:
            here = here.unionByName(carried)
        here = here.withColumn("anc", _ancestor(base + block)).withColumn("key", F.xxhash64("tree", "anc"))
        here = here.select("key", "tree", "total", "anc", "level", "idx", "digest")
        made = ws.write(by_group(here, "key", ["level", "idx"], lambda rows, base=base: merged(rows, base, block), _NODE), f"{name}-nodes{base + 1}")
        every, carried = every.unionByName(made), made.filter("pending")
    return every, levels


def roots(nodes: DataFrame) -> DataFrame:
    """``tree, digest`` of every tree's root."""
    top = F.expr("level = 0 AND total = 1 OR level > 0 AND idx = 0 AND cast(pow(%d, level) as bigint) >= total" % FANOUT)
    return nodes.filter(top).select("tree", "digest")


_ABOVE = "tree string, idx long, siblings string, shape string, subroot string, root string"


def _paths(rows: pa.Table, base: int, block: int) -> Iterator[tuple]:
    """``(tree, idx, digest, siblings, shape, subroot, root, doc_id, other)`` of the nodes at ``base``.

    ``siblings`` are the other members of each run up to the root, lowest first;
    ``shape`` has two digits a level: the node's place in its run and the run's length.
    """
    columns = ("tree", "anc", "total", "level", "idx", "digest", *_CARRIED, "siblings", "shape", "subroot", "root")
    nodes: dict[tuple, dict[int, dict[int, tuple]]] = defaultdict(lambda: defaultdict(dict))
    above: dict[tuple, tuple] = {}
    for tree, anc, total, level, idx, digest, doc_id, other, *path in zip(*(rows.column(c).to_pylist() for c in columns), strict=True):
        if level is None:
            above[tree, anc] = tuple(path)
        else:
            nodes[tree, anc][level][idx] = (total, digest, doc_id, other)
    for (tree, anc), levels in nodes.items():
        *path, subroot, root = above[tree, anc]
        total = next(iter(levels[base].values()))[0]
        top = min(base + block, len(widths(total)) - 1)
        known = {anc: tuple(path)}
        for level in range(top - 1, base - 1, -1):
            members, here = levels[level], {}
            for idx in members:
                first = idx - idx % FANOUT
                run = [k for k in range(first, first + FANOUT) if k in members]
                siblings, shape = known[idx // FANOUT]
                here[idx] = ("".join(members[k][1] for k in run if k != idx) + siblings, f"{idx - first}{len(run)}{shape}")
            known = here
        for idx, (_, digest, doc_id, other) in levels[base].items():
            yield tree, idx, digest, *known[idx], subroot, root, doc_id, other


def fold(digest: str, siblings: str, shape: str) -> str:
    """The root that a node's digest gives with its siblings."""
    size = len(digest)
    for k in range(0, len(shape), 2):
        place, length = int(shape[k]), int(shape[k + 1])
        run = [siblings[size * j : size * (j + 1)] for j in range(length - 1)]
        siblings = siblings[size * (length - 1) :]
        digest = node([*run[:place], digest, *run[place:]])
    return digest


def prove(ws: Workspace, nodes: DataFrame, levels: int, outer: DataFrame, name: str, finish, schema: str) -> DataFrame:
    """Pass siblings down from each tree's root; ``finish`` makes rows of the leaves' paths.

    ``outer`` has for each tree the siblings above its root: ``tree, siblings, shape, subroot, root``.
    """
    height = nodes.select("tree", "total").filter("total IS NOT NULL").distinct().join(outer.withColumnRenamed("tree", "t"), F.col("tree").eqNullSafe(F.col("t"))).drop("t")
    height = ws.write(height, f"{name}-outer")
    blank = lambda df, *kinds: df.withColumns({c: F.lit(None).cast(k) for c, k in kinds})
    passed, block = None, BLOCK
    for base in range(max(levels - 1, 0) // block * block, -1, -block):
        # a tree enters at the block that holds its root: at most FANOUT ** (base + block - 1) leaves, and more than the block below takes
        least = FANOUT ** (base - 1) if base else 0
        above = height.filter(f"total > {least} AND total <= {FANOUT ** (base + block - 1)}").select("tree", F.lit(0).cast("long").alias("anc"), "siblings", "shape", "subroot", "root")
        if passed is not None:
            above = above.unionByName(passed.withColumnRenamed("idx", "anc"))
        here = nodes.filter(f"level >= {base} AND level < {base + block}").withColumn("anc", _ancestor(base + block)).drop("pending")
        here = blank(here, *((c, "string") for c in ("siblings", "shape", "subroot", "root")))
        both = here.unionByName(blank(above, ("total", "long"), ("level", "int"), ("idx", "long"), ("digest", "string"), ("doc_id", "long"), ("other", "string")))
        both = both.withColumn("key", F.xxhash64("tree", "anc"))
        if not base:
            return by_group(both, "key", ["level", "idx"], lambda rows: finish(_paths(rows, 0, block)), schema)
        passed = ws.write(by_group(both, "key", ["level", "idx"], lambda rows, base=base: _passed(_paths(rows, base, block)), _ABOVE), f"{name}-above{base}")
    return passed


def _rows(found: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names) if found else None


def _passed(paths: Iterator[tuple]) -> pa.RecordBatch | None:
    names = [c.split()[0] for c in _ABOVE.split(", ")]
    return _rows([(tree, idx, *rest) for tree, idx, _, *rest, _, _ in paths], names, [pa.string(), pa.int64(), *[pa.string()] * 4])


def _outer(paths: Iterator[tuple]) -> pa.RecordBatch | None:
    """A last tree's leaf is the root of the tree named in ``other``."""
    found = [(other, siblings, shape, digest, root) for _, _, digest, siblings, shape, _, root, _, other in paths]
    return _rows(found, ["tree", "siblings", "shape", "subroot", "root"], [pa.string()] * 5)


_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(paths: Iterator[tuple]) -> pa.RecordBatch | None:
    found = []
    for _, _, digest, siblings, shape, subroot, root, doc_id, other in paths:
        folded = fold(other or digest, siblings, shape)
        found.append((doc_id, digest, subroot, root, hashlib.sha256(siblings.encode()).hexdigest(), folded, folded == root))
    return _rows(found, [c.split()[0] for c in _PROVED.split(", ")], [pa.int64(), *[pa.string()] * 5, pa.bool_()])


def verify(docs: DataFrame, present: Column) -> DataFrame:
    """Every row's place in the manifest of ``docs``, and whether its present text still fits.

    ``present`` is the text as it is found now; null where it is unchanged.
    """
    ws = Workspace(docs.sparkSession, "manifest")
    fields = [F.col(f) for f in FIELDS]
    leaves = docs.select(F.col("source").cast("string").alias("tree"), digest_of(*fields).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.when(present.isNotNull(), digest_of(*fields[:-1], present)).alias("other"))
    leaves = ws.write(leaves.withColumn("rid", F.monotonically_increasing_id()), "leaves")
    nodes, levels = build(ws, leaves, ["doc_id", "digest", "rid"], "trees")
    subroots = roots(nodes).select(F.lit("").alias("tree"), "digest", F.lit(None).cast("long").alias("doc_id"), F.col("tree").alias("other"))
    over, high = build(ws, ws.write(subroots, "subroots"), ["other"], "top")
    root = roots(over).select("tree", F.lit("").alias("siblings"), F.lit("").alias("shape"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    outer = ws.write(prove(ws, over, high, root, "top", _outer, "tree string, siblings string, shape string, subroot string, root string"), "outer")
    return prove(ws, nodes, levels, outer, "trees", _proved, _PROVED)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id has an even CRC-32 have lost their line feeds since the manifest was made."""
    docs = table(spark, sf_dir, "documents")
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    return verify(docs, F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))


def _told(field: str) -> str:
    return f"CASE WHEN {field} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({field} AS VARCHAR))), ':', CAST({field} AS VARCHAR)) END"


#: Trees level by level by recursion; CRC-32 bit by bit; each path folded over a list.
OP13_SQL = f"""
WITH RECURSIVE c AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 2 = 0 AS hit FROM documents),
h AS (SELECT doc_id, source, concat({", ".join(map(_told, FIELDS[:-1]))}) AS told, text, CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS now FROM c),
d AS (SELECT *, sha256(concat(told, {_told("text")})) AS leaf, sha256(concat(told, {_told("now")})) AS present, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM h),
i AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS rid FROM d),
t(s, lvl, idx, h, n) AS (
  SELECT s, 0, i, leaf, count(*) OVER (PARTITION BY s) FROM i
  UNION ALL SELECT s, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), any_value(n + 2) // 3 FROM t WHERE n > 1 GROUP BY s, lvl, idx // 3),
u(lvl, idx, h, n) AS (
  SELECT 0, s, h, count(*) OVER () FROM t WHERE n = 1
  UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), any_value(n + 2) // 3 FROM u WHERE n > 1 GROUP BY lvl, idx // 3),
m AS (
  SELECT rid, 0 AS tree, lvl, idx, i // CAST(pow(3, lvl) AS BIGINT) AS own, h FROM i JOIN t ON t.s = i.s AND t.n > 1 AND t.idx // 3 = i // CAST(pow(3, lvl) AS BIGINT) // 3
  UNION ALL SELECT rid, 1, lvl, idx, s // CAST(pow(3, lvl) AS BIGINT), h FROM i JOIN u ON u.n > 1 AND u.idx // 3 = s // CAST(pow(3, lvl) AS BIGINT) // 3),
r AS (SELECT rid, tree, lvl, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx < own), '') AS l, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx > own), '') AS r FROM m GROUP BY ALL),
p AS (SELECT rid, string_agg(concat(l, r), '' ORDER BY tree, lvl) AS siblings, list(concat(l, '|', r) ORDER BY tree, lvl) AS steps FROM r GROUP BY 1),
f AS (SELECT i.*, coalesce(siblings, '') AS siblings, list_reduce(list_prepend(present, coalesce(steps, [])), lambda a, x: sha256(concat(split_part(x, '|', 1), a, split_part(x, '|', 2)))) AS folded FROM i LEFT JOIN p USING (rid))
SELECT doc_id, leaf, t.h AS subroot, u.h AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = u.h AS verified FROM f JOIN t ON t.s = f.s AND t.n = 1 JOIN u ON u.n = 1
"""
