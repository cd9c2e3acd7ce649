"""Embedding near-duplicates by cross-polytope hashing.

Each vector is rotated by random signs and fast Hadamard transforms; its hash is
the nearest vertex of the cross-polytope (the largest coordinate and its sign),
``HASHES`` of them to a code. Each of ``TABLES`` codes is also probed at the
likeliest neighbours, ``PROBES`` buckets with its own, made by replacing the best
vertices of one or two hashes by their runners-up, least loss first. Vectors of one
label that meet in a bucket are compared by cosine in double precision. A code has
(2 * width)**3 values, so unlike vectors hardly ever meet, and a pair at 0.98 meets
in a table with a chance of 0.82 in 64 dimensions and 0.71 in 512: of such pairs
about one in a million, and one in 20,000, is missed by all tables.

Equal vectors are collapsed to the smallest id and counted as weights. Pairs
that meet in many buckets are counted in the first of them only, known from the
codes that each row carries; buckets above ``BLOCK`` rows are split into pairs
of blocks. Only sums per vector and spanning edges leave a block, never pairs.

Cases: a null label, and vectors that are null, empty, zero or hold null or
non-finite components, link with nothing and are kept as their own component;
vectors of different lengths are not compared; repeated rows of one vec_id are
one vector (the first by value); null vec_ids are dropped; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, blocks_of_groups, by_group, connected_components, join_hot, local_components, table

THRESHOLD = 0.98
TABLES = 8
HASHES = 3
PROBES = 4
BLOCK = 1_024
SEED = 7_919
#: Which of its three best vertices each hash of a code takes: its own, then the probes.
CHOICES = [(0,) * HASHES, *(c for c in product(range(3), repeat=HASHES) if 1 <= sum(c) <= 2)]
#: A slot is a table's number and, below this bit, a code.
SLOT_BITS = 50


@lru_cache(16)
def signs(width: int) -> np.ndarray:
    """Three random sign flips for each hash of each table."""
    return np.random.default_rng([SEED, width]).choice(np.array([-1.0, 1.0]), (TABLES, HASHES, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis (a power of two)."""
    n, step = x.shape[-1], 1
    while step < n:
        y = x.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        x = np.concatenate([y[..., :1, :] + y[..., 1:, :], y[..., :1, :] - y[..., 1:, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x / np.sqrt(n)


def codes(vectors: np.ndarray) -> np.ndarray:
    """(rows, TABLES, PROBES) bucket codes of unit vectors; the first is the row's own."""
    width = 1 << max(1, (vectors.shape[1] - 1).bit_length())
    wide = np.zeros((len(vectors), width))
    wide[:, : vectors.shape[1]] = vectors
    flips = signs(width)
    out = np.empty((len(vectors), TABLES, PROBES), np.int64)
    rows = np.arange(len(vectors))
    for t in range(TABLES):
        every, cost = np.zeros((len(vectors), len(CHOICES)), np.int64), np.zeros((len(vectors), len(CHOICES)))
        for h in range(HASHES):
            y = wide
            for k in range(3):
                y = hadamard(y * flips[t, h, k])
            best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, np.minimum(np.arange(3), width - 1)]
            size = np.take_along_axis(y, best, 1)
            vertex = 2 * best + (size < 0)
            loss = np.square(np.abs(size[:, :1]) - np.abs(size))
            taken = [c[h] for c in CHOICES]
            every = every * (2 * width) + vertex[:, taken]
            cost += loss[:, taken]
        cost[:, 0] = -1
        take = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
        out[:, t] = every[rows[:, None], take]
    return out


def _usable(values: list | None) -> bool:
    if not values or any(v is None for v in values):
        return False
    a = np.array(values, dtype=np.float64)
    return bool(np.isfinite(a).all() and a.any())


def _pairs(whole: pa.Table, threshold: float) -> pa.RecordBatch:
    """Sums of links and spanning edges of whole units."""
    unit, rep, weight = (whole.column(c).to_numpy() for c in ("unit", "rep", "weight"))
    own, other, blk, probe, slot = (whole.column(c).to_numpy() for c in ("own", "other", "blk", "probe", "slot"))
    length = whole.column("size").to_numpy()
    raw, coded = whole.column("v").to_pylist(), whole.column("codes").to_pylist()
    nodes, counts, src, dst = [], [], [], []
    edges = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a < 2:
            continue
        n = int(length[a])
        v = np.frombuffer(b"".join(raw[a:b]), np.float64).reshape(b - a, n)
        c = np.frombuffer(b"".join(coded[a:b]), np.int64).reshape(b - a, TABLES, PROBES)
        near = v @ v.T >= threshold
        near &= (probe[a:b] == 0)[:, None] | (probe[a:b] == 0)[None, :]  # one of the two is at home here
        near &= slot[a:b][:, None] == slot[a:b][None, :]  # two buckets whose keys collide stay apart
        if own[a] != other[a]:
            near &= blk[a:b][:, None] != blk[a:b][None, :]
        i, j = np.nonzero(np.triu(near, 1))
        differ = rep[a:b][i] != rep[a:b][j]
        i, j = i[differ], j[differ]
        if not len(i):
            continue
        here = int(slot[a])
        first = np.zeros(len(i), bool)
        for at in range(0, len(i), 65_536):
            x, y = c[i[at : at + 65_536]], c[j[at : at + 65_536]]
            met = (x[:, :, :1] == y) | (x == y[:, :, :1])  # x's home among y's buckets, or y's among x's
            # meeting places in order: table, then the bucket's code
            place = np.minimum(np.where(x[:, :, :1] == y, y, np.iinfo(np.int64).max), np.where(x == y[:, :, :1], x, np.iinfo(np.int64).max)).min(axis=2)
            table_met = met.any(axis=2)
            t = table_met.argmax(axis=1)
            code = place[np.arange(len(t)), t]
            first[at : at + 65_536] = (t << SLOT_BITS) + code == here
        i, j = i[first], j[first]
        if not len(i):
            continue
        links = np.bincount(i, weights=weight[a:b][j], minlength=b - a) + np.bincount(j, weights=weight[a:b][i], minlength=b - a)
        linked = np.flatnonzero(links)
        nodes.append(rep[a:b][linked])
        counts.append(links[linked].astype(np.int64))
        label = local_components(b - a, i, j)
        moved = np.flatnonzero(label != np.arange(b - a))
        src.append(rep[a:b][moved])
        dst.append(rep[a:b][label[moved]])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    nodes, counts, src, dst = map(join, (nodes, counts, src, dst))
    empty = np.full(len(nodes), -1), np.zeros(len(src), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([nodes, src])), pa.array(np.concatenate([counts, empty[1]])), pa.array(np.concatenate([empty[0], dst])), pa.array(np.concatenate([np.zeros(len(nodes), bool), np.ones(len(src), bool)]))], ["rep", "links", "dst", "edge"])


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every vector."""
    ws = Workspace(vectors.sparkSession, "embeddings")
    rows = vectors.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    # repeated rows of an id: the smallest value, combined before the shuffle
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "e")).alias("x")).select("vec_id", "x.label", "x.e")

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], []
            for values, label in zip(batch.column("e").to_pylist(), batch.column("label").to_pylist(), strict=True):
                if label is None or not _usable(values):
                    out.append(None)
                    size.append(0)
                    continue
                a = np.array(values, dtype=np.float64)
                out.append((a + 0.0).tobytes())
                size.append(len(a))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary()), pa.array(size, pa.int32())], ["vec_id", "label", "raw", "size"])

    usable = rows.mapInArrow(normal, "vec_id long, label string, raw binary, size int")
    everyone = ws.write(usable.withColumn("same", F.when(F.col("raw").isNotNull(), F.sha2("raw", 256))), "vectors")
    fit = everyone.filter("raw IS NOT NULL")
    reps = ws.write(fit.groupBy("label", "same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "reps")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, size = batch.column("raw").to_pylist(), batch.column("size").to_numpy()
            unit: list[bytes] = [b""] * len(raw)
            coded: list[bytes] = [b""] * len(raw)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                v = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), n)
                v = v / np.abs(v).max(axis=1, keepdims=True)
                v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
                c = codes(v)
                for i, x, y in zip(at.tolist(), v, c, strict=True):
                    unit[i], coded[i] = x.tobytes(), y.tobytes()
            slots = [(np.frombuffer(y, np.int64).reshape(TABLES, PROBES) + (np.arange(TABLES, dtype=np.int64) << SLOT_BITS)[:, None]).ravel().tolist() for y in coded]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("label"), batch.column("weight"), batch.column("size"), pa.array(unit, pa.binary()), pa.array(coded, pa.binary()), pa.array(slots, pa.list_(pa.int64()))], ["rep", "label", "weight", "size", "v", "codes", "slots"])

    distinct = fit.join(reps.withColumnRenamed("rep", "vec_id"), ["vec_id", "label", "same"]).select(F.col("vec_id").alias("rep"), "label", "weight", "size", "raw")
    coded = ws.write(distinct.mapInArrow(hashed, "rep long, label string, weight long, size int, v binary, codes binary, slots array<long>"), "codes")
    homes = coded.select("label", "size", "rep", F.posexplode("slots").alias("at", "slot"))
    homes = homes.withColumn("probe", (F.col("at") % PROBES).cast("int")).withColumn("key", F.xxhash64("label", "size", "slot"))
    # a bucket nobody is at home in, or with one row, compares nothing: skinny rows decide, then vectors follow
    busy = ws.write(homes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("probe").alias("p")).filter("n > 1 AND p = 0").select("key", "n"), "busy")
    placed = ws.write(join_hot(homes, busy, "key").select("key", "slot", "probe", "rep"), "homes")
    dealt = blocks_of_groups(ws, placed, "key", "rep", block).join(coded.select("rep", "weight", "size", "v", "codes"), "rep")
    found = ws.write(by_group(dealt.select("unit", "rep", "weight", "size", "v", "codes", "slot", "probe", "own", "other", "blk"), "unit", ["probe", "rep"], lambda whole: _pairs(whole, threshold), "rep long, links long, dst long, edge boolean", rows=16_384), "links")
    labels = connected_components(ws, found.filter("edge").select(F.col("rep").alias("src"), "dst"))
    sums = found.filter("NOT edge").groupBy("rep").agg(F.sum("links").alias("links"))
    judged = reps.join(sums, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    judged = judged.select("label", "same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    known = fit.select("vec_id", "label", "same").join(judged, ["label", "same"]).select("vec_id", "n_links", "component_id")
    alone = everyone.filter("raw IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))
