"""Near-duplicates: SimHash groups and pivot distance tables, then the exact Jaccard similarity.

Two documents are linked where their sets of shingles are at least ``LEAST`` =
4/5 similar; a document's group is its connected component. SimHash finds the
candidates, and no sketch decides:

* A set has a 512-bit SimHash. As in ``simhash``, fingerprints meet where they share
  bits: each of many tables takes some ``bits`` of the first ``KEY_BITS`` by fixed
  random places, as many as leave about ``IN_GROUP`` fingerprints in a group, and
  the number of tables makes up for those a pair may differ in. Sets at 0.8 differ in
  15 % of the bits; with the numbers of ``table_plan`` some 1 in 100,000 pairs at exactly
  0.8 meets in no table, and fewer above it (the README has figures).
* In a group, sizes must be within 4/5 of each other. A table holds each row's distances
  to ``PIVOTS`` rows of its own group; by the triangle inequality pairs whose
  distances differ by more than ``RADIUS`` are discarded, and those left are
  counted over the 128 bits that no key takes.
* SimHash is coarse for few shingles: sets at 4 of 5 differ in 19 % of the bits. Sets of up to
  ``FEW`` shingles therefore meet by the first n // 5 + 1 of them as well, of which similar
  ones share one, and are counted over 128 other bits there; larger sets meet by SimHash alone.
* Spanning edges of the candidates give loose clusters. The sets of their members,
  and of no other document, are made again from the text, and pairs inside a
  cluster whose whole fingerprints differ in at most ``SLACK`` bits (eight standard errors
  above the worst mean) are compared set against set, nearest fingerprints first, unless
  verified links connect them already.

Groups and clusters above their block size are first looked at block by block; what is
linked there has one label, and pairs of blocks then only meet for different labels
(in clusters, only where those share a rare shingle). Only spanning edges leave a block. Shingles are known by their 64-bit hashes, sets
by 128-bit ones.

Cases: as in ``simhash``: documents without words have the empty set and link with
each other; null doc_ids are dropped; rows with one doc_id are one document with all
their texts' groups; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, by_group, chained, connected_components, deal_apart, deal_once, join_hot, label_counts, local_components, text_bytes, worker_cache
from .simhash import as_words, fingerprint, shingle_hashes

LEAST = (4, 5)
WORDS = 8
SLACK = 166
#: Bits that keys are drawn from; the others are counted inside groups, where pairs differ in at most ``RADIUS`` of them.
KEY_BITS = 384
RADIUS = 40
#: Bits of a key at least, fingerprints that a group is to hold beyond that, tables for keys of no bits, and the chance that a pair at 0.8 has an equal bit.
LEAST_BITS = 4
IN_GROUP = 48
TABLES = 17.7
EQUAL_BIT = 0.848
TABLE_SEED = 20_202
PIVOTS = 4
#: Tables that are looked at first, for labels.
FIRST_TABLES = 8
#: Sets of up to so many shingles meet by shingles too.
FEW = 24
GROUP_BLOCK = 2_048
CLUSTER_BLOCK = 256
FILTER_BITS = 24


def shingle_set(text: bytes, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The keys of a set: its first n // 5 + 1 shingles, common ones last."""
    last = np.isin(hashes, common, assume_unique=True)
    least, of = LEAST
    return np.concatenate([hashes[~last], hashes[last]])[: len(hashes) - -(-least * len(hashes) // of) + 1]


def prints(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, digest, fp, size, few)`` of every whole text; ``few``: the keys of a small set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("neardup")
        none = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            digests, fps, sizes, few = [], [], [], []
            for text in text_bytes(batch.column("text")):
                hashes = shingle_set(text, width)
                digests.append(digest(hashes))
                fps.append(fingerprint(hashes, WORDS))
                sizes.append(len(hashes))
                few.append(prefix(hashes, none).view(np.int64) if 0 < len(hashes) <= FEW else [])
            columns = [pa.array(digests, pa.binary()), pa.array(fps, pa.binary()), pa.array(sizes, pa.int32()), pa.array(few, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "digest", "fp", "size", "few"])

    return docs.mapInArrow(run, "doc_id long, digest binary, fp binary, size int, few array<long>")


def table_plan(count: int) -> np.ndarray:
    """The places of the bits that each table takes, for so many fingerprints: tables x bits."""
    bits = max(LEAST_BITS, round(np.log2(max(count, 1) / IN_GROUP)))
    rng = np.random.default_rng(TABLE_SEED)
    return np.stack([rng.choice(KEY_BITS, bits, replace=False) for _ in range(int(np.ceil(TABLES / EQUAL_BIT**bits)))])


def table_keys(fps: np.ndarray, plan: np.ndarray) -> np.ndarray:
    """The key of each fingerprint in each table."""
    bits = np.unpackbits(fps.view(np.uint8), axis=1)
    codes = bits[:, plan] @ (1 << np.arange(plan.shape[1], dtype=np.int64))
    return codes | np.arange(len(plan), dtype=np.int64) << 32


def group_rows(first: DataFrame, plan: np.ndarray) -> DataFrame:
    """``(key, rep, label, size, low, high)``: a skinny row for each group that a fingerprint joins, with the bits to count there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                fps = as_words(part.column("fp"), part.num_rows)
                few = part.column("few").to_pylist()
                keys = np.concatenate([table_keys(fps, plan).ravel(), np.array([k for ks in few for k in ks], dtype=np.int64) | np.int64(-(1 << 63))])
                row = np.concatenate([np.repeat(np.arange(len(fps)), len(plan)), np.repeat(np.arange(len(fps)), [len(ks) for ks in few])])
                rep, label, size = (part.column(c).to_numpy()[row] for c in ("rep", "label", "size"))
                other = np.arange(len(row)) >= part.num_rows * len(plan)  # groups of shingles count words of their own
                low, high = (np.where(other, fps[row, k], fps[row, KEY_BITS // 64 + k]).view(np.int64) for k in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, rep, label, size, low, high)], ["key", "rep", "label", "size", "low", "high"])

    return first.select("rep", "label", "size", "fp", "few").mapInArrow(run, "key long, rep long, label long, size int, low long, high long")


def counted_groups(first: DataFrame, plan: np.ndarray, block: int) -> DataFrame:
    """``(key, label, _n)`` of the groups above ``block``, roughly.

    It is counted on one fingerprint in ``block // 128``, which leaves their keys few enough to
    meet the rows by broadcast, where they are. Which rows are counted only changes the blocks.
    """
    nth = max(1, block // 128)
    some = group_rows(first.filter(F.pmod(F.xxhash64("digest"), F.lit(nth)) == 0), plan)
    counted = some.groupBy("key", "label").agg((F.count(F.lit(1)) * nth).alias("_n"))
    hot = some.groupBy("key").agg((F.count(F.lit(1)) * nth).alias("_t")).filter(F.col("_t") > block)
    return counted.join(hot, "key", "left_semi")


def loose_clusters(ws: Workspace, first: DataFrame, block: int) -> DataFrame:
    """``(node, component_id)`` of the candidates.

    A large group of near copies would give its edges again in each of many tables, and in each
    pair of blocks. So ``FIRST_TABLES`` tables are looked at first, block by block; what they join has
    one label, and all tables then only look for pairs of different labels, and give edges of labels.
    """
    plan = table_plan(first.count())

    def edges(dealt: DataFrame, node: str) -> DataFrame:
        rows = dealt.select("unit", "own", "other", "blk", F.col(node).alias("label"), "size", "low", "high")
        return by_group(rows, "unit", ["size", "label"], lambda whole: _spanning(whole.column("label").to_numpy(), *candidate_pairs(whole, apart=True)), "src long, dst long")

    alone = first.withColumn("label", F.col("rep")).withColumn("few", F.array().cast("array<bigint>"))
    hot = ws.write(counted_groups(alone, plan[:FIRST_TABLES], block).groupBy("key").agg(F.sum("_n").alias("_n")), "hot")
    looked = deal_once(group_rows(alone, plan[:FIRST_TABLES]).join(F.broadcast(hot), "key", "left").fillna(1, ["_n"]), "key", ["rep", "low"], block)
    joined = ws.write(connected_components(ws, edges(looked, "rep"), "joined"), "joined")

    labelled = ws.write(first.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component_id", "rep")).drop("component_id"), "labelled")
    counts = ws.write(counted_groups(labelled, plan, block), "counts")
    dealt = deal_apart(group_rows(labelled, plan), counts, "key", "label", ["rep", "low"], block)
    return chained(joined, connected_components(ws, edges(dealt, "label"), "loose"))


def candidate_pairs(whole: pa.Table, radius: int = RADIUS, sketch: np.ndarray | None = None, apart: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Indices of candidates that span all candidate pairs, of rows sorted by unit and size; ``apart``: those of different labels."""
    unit, size, own, other, blk = (whole.column(c).to_numpy() for c in ("unit", "size", "own", "other", "blk"))
    label = whole.column("label").to_numpy() if apart else np.arange(len(unit))
    if sketch is None:
        low, high = (whole.column(c).to_numpy() for c in ("low", "high"))
        sketch = np.stack([low, high], axis=1).view(np.uint64)  # bits of signed numbers count those of the absolute value
    lead = np.searchsorted(unit, unit)
    count = np.searchsorted(unit, unit, side="right") - lead
    tables = [np.bitwise_count(sketch ^ sketch[lead + count * k // PIVOTS]).sum(axis=1, dtype=np.int16) for k in range(PIVOTS)]
    led = tables[0] <= radius
    left, right = [lead[led]], [np.flatnonzero(led)]
    at = np.arange(len(unit) - 1)
    step = 1
    while len(at):
        to = at + step
        inside = to < len(unit)
        at, to = at[inside], to[inside]
        near = (unit[at] == unit[to]) & (LEAST[1] * size[at].astype(np.int64) >= LEAST[0] * size[to].astype(np.int64))
        at, to = at[near], to[near]  # later rows are larger: a start that left the window never comes back
        test = ((own[at] == other[at]) | (blk[at] != blk[to])) & ~(led[at] & led[to]) & (label[at] != label[to])  # the leader joins those already
        a, b = at[test], to[test]
        for distances in tables:
            kept = np.abs(distances[a] - distances[b]) <= radius
            a, b = a[kept], b[kept]
        hit = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int16) <= radius
        left.append(a[hit])
        right.append(b[hit])
        step += 1
    return np.concatenate(left), np.concatenate(right)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``LEAST``."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return LEAST[1] * common >= LEAST[0] * (len(both) - common)


def verified_links(sets: list[np.ndarray], fps: np.ndarray, label: np.ndarray, blk: np.ndarray | None) -> list[tuple[int, int]]:
    """Pairs that span the links among the sets of different labels; only pairs whose ``blk`` differs where it is given."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    distance = np.stack([np.bitwise_count(fps ^ f).sum(axis=1, dtype=np.int64) for f in fps])
    a, b = np.triu_indices(n, 1)
    fits = (distance[a, b] <= SLACK) & (LEAST[1] * np.minimum(size[a], size[b]) >= LEAST[0] * np.maximum(size[a], size[b])) & (label[a] != label[b])
    if blk is not None:
        fits &= blk[a] != blk[b]
    a, b = a[fits], b[fits]
    nearest = np.argsort(distance[a, b], kind="stable")
    label = label.copy()
    found = []
    for i, j in zip(a[nearest].tolist(), b[nearest].tolist(), strict=True):
        if label[i] != label[j] and similar(sets[i], sets[j]):
            label[label == label[j]] = label[i]
            found.append((i, j))
    return found


def verified(whole: pa.Table) -> pa.RecordBatch:
    """Edges of labels: the links of each unit."""
    unit, label, own, other, blk = (whole.column(c).to_numpy() for c in ("unit", "label", "own", "other", "blk"))
    fps = as_words(whole.column("fp"), len(unit))
    sets = [np.frombuffer(s, dtype=np.uint64) for s in whole.column("shingles").to_pylist()]
    starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]])).tolist()
    pairs = [
        (label[lo + i], label[lo + j])
        for lo, hi in zip(starts, starts[1:], strict=False)
        for i, j in verified_links(sets[lo:hi], fps[lo:hi], label[lo:hi], None if own[lo] == other[lo] else blk[lo:hi])
    ]
    src, dst = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _spanning(rep: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = rep[a], rep[b]
    node = np.unique(np.concatenate([a, b]))
    label = node[local_components(len(node), np.searchsorted(node, a), np.searchsorted(node, b))]
    moved = label != node
    return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(label[moved])], ["src", "dst"])


def _bits(members: DataFrame) -> np.ndarray:
    """A bitmap of bounded size over the hashed ids of the members."""
    slot = F.pmod(F.xxhash64("rep"), F.lit(1 << FILTER_BITS))
    rows = members.select(slot.alias("slot")).groupBy(F.expr("slot div 32").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 32 AS INT)))").alias("bits")).collect()
    out = np.zeros((1 << FILTER_BITS) // 32, dtype=np.uint32)
    for r in rows:
        out[r["at"]] = r.bits
    return out


def member_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``(doc_id, digest, shingles)`` of the documents that may be members."""
    shared = docs.sparkSession.sparkContext.broadcast(_bits(members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((shared.value[slot >> 5] >> (slot & 31).astype(np.uint32) & 1).astype(bool)))
            sets = [shingle_set(t, width) for t in text_bytes(batch.column("text"))]
            columns = [pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "digest", "shingles"])

    slotted = docs.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)))
    return slotted.mapInArrow(run, "doc_id long, digest binary, shingles binary")


def rare_shingles(ws: Workspace, sets: DataFrame) -> DataFrame:
    """``(key, rep, digest)``: the first n // 5 + 1 shingles of each set, rare ones first, where sets of different labels have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 64) for at in range(0, batch.num_rows, 64)):
                hashes = [np.frombuffer(s, dtype=np.int64) for s in part.column("shingles").to_pylist()]
                row = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
                columns = [part.column(c).take(pa.array(row)) for c in ("rep", "digest", "label")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), *columns], ["key", "rep", "digest", "label"])

    single = ws.write(sets.select("rep", "digest", "label", "shingles").mapInArrow(run, "key long, rep long, digest binary, label long"), "shingles")
    common = ws.write(single.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("label") < F.max("label")).alias("mixed")), "common")
    ranked = join_hot(single.drop("label"), common, "key").groupBy("rep", "digest").agg(F.sort_array(F.collect_list(F.struct("n", "key", "mixed"))).alias("all"))
    least, of = LEAST
    first = F.slice("all", 1, F.size("all") - F.ceil(F.size("all") * F.lit(least) / F.lit(of)).cast("int") + 1)
    return ranked.select("rep", "digest", F.explode(first).alias("s")).filter("s.mixed").select("s.key", "rep", "digest")


def links_between(ws: Workspace, docs: DataFrame, unsettled: DataFrame, width: int, block: int, cluster_block: int) -> DataFrame:
    """Edges of labels: the links between different labels of large clusters.

    Similar sets share one of their first n // 5 + 1 shingles in any one order. With
    those that are rare in these clusters first, texts that have a common passage, or
    are like nothing else, don't meet, and what meets falls into small clusters.
    """
    sets = member_sets(docs, unsettled.select("rep"), width).withColumnRenamed("doc_id", "rep")
    sets = ws.write(sets.join(unsettled, ["rep", "digest"]), "unsettled-sets")
    keyed = ws.write(rare_shingles(ws, sets).join(unsettled.select("rep", "digest", "label", "size", "fp"), ["rep", "digest"]), "rare")
    dealt = deal_apart(keyed, label_counts(ws, keyed, "key", "label", block, "rare-counts"), "key", "label", ["rep", "digest"], block)

    def meet(whole: pa.Table) -> pa.RecordBatch:
        fps = as_words(whole.column("fp"), whole.num_rows)
        return _spanning(whole.column("label").to_numpy(), *candidate_pairs(whole, SLACK, fps, apart=True))

    edges = by_group(dealt.select("unit", "own", "other", "blk", "label", "size", "fp"), "unit", ["size", "label"], meet, "src long, dst long", rows=8_192)
    tight = connected_components(ws, edges, "tight").withColumnRenamed("node", "label")
    near = ws.write(unsettled.select("rep", "digest", "fp", "label").join(tight, "label"), "near")
    counts = label_counts(ws, near, "component_id", "label", cluster_block, "near-counts")
    units = ws.write(deal_apart(near, counts, "component_id", "label", ["rep", "digest"], cluster_block).drop("component_id"), "near-units")
    return by_group(units.join(sets.select("rep", "digest", "shingles"), ["rep", "digest"]), "unit", ["rep"], verified, "src long, dst long", rows=4 * cluster_block)


def near_groups(docs: DataFrame, width: int, block: int = GROUP_BLOCK, cluster_block: int = CLUSTER_BLOCK) -> DataFrame:
    """``(doc_id, component_id)`` for every document of ``docs``."""
    ws = Workspace(docs.sparkSession, "neardup")
    docs = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = ws.write(prints(docs, width), "prints")
    named = ws.write(coded.select("doc_id", "digest").distinct(), "named")
    reps = ws.write(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "reps")
    first = coded.withColumnRenamed("doc_id", "rep").join(reps.drop("n"), ["rep", "digest"]).dropDuplicates(["rep", "digest"])
    first = ws.write(first, "first")
    ws.drop("prints")

    clusters = ws.write(loose_clusters(ws, first, block), "clusters")
    members = ws.write(first.select("rep", "digest", "fp", "size").join(clusters.withColumnRenamed("node", "rep"), "rep"), "members")
    sizes = ws.write(members.groupBy("component_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "cluster-sizes")
    dealt = deal_once(join_hot(members, sizes, "component_id", "_n"), "component_id", ["rep", "digest"], cluster_block)
    units = ws.write(dealt.select("unit", "own", "other", "blk", "rep", "digest", "fp"), "units")
    sets = member_sets(docs, clusters.select(F.col("node").alias("rep")), width).withColumnRenamed("doc_id", "rep")
    whole_units = units.join(sets, ["rep", "digest"]).withColumn("label", F.col("rep"))
    edges = by_group(whole_units, "unit", ["rep"], verified, "src long, dst long", rows=4 * cluster_block)
    labels = ws.write(connected_components(ws, edges), "labels")

    large = join_hot(members, sizes.filter(F.col("_n") > cluster_block), "component_id", "_n").join(labels.select(F.col("node").alias("rep"), F.col("component_id").alias("label")), "rep", "left")
    large = ws.write(large.withColumn("label", F.coalesce("label", "rep")), "large")
    mixed = large.groupBy("component_id").agg((F.min("label") < F.max("label")).alias("mixed")).filter("mixed").select("component_id")
    unsettled = ws.write(large.join(F.broadcast(mixed), "component_id", "left_semi").drop("component_id", "_n"), "unsettled")
    if not unsettled.isEmpty():
        labels = chained(labels, connected_components(ws, links_between(ws, docs, unsettled, width, block, cluster_block), "between"))
    grouped = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "n", F.coalesce("component_id", "rep").alias("component_id"))
    return join_hot(named, ws.write(grouped, "grouped"), "digest").select("doc_id", "component_id")
