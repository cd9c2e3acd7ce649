"""SimHash near-duplicates by pivot distance tables.

A fingerprint has ``words`` times 64 bits. Its row in the pivot table holds its
Hamming distances to many reference fingerprints. By the triangle inequality two
fingerprints within ``radius`` bits differ by at most ``radius`` in every
coordinate, so a pair whose largest coordinate difference is above it is
discarded without a look at the fingerprints; survivors are verified by counting
differing bits.

Pairs are enumerated only inside groups that share bits, in one of two ways.
With one word, groups share two of five bit blocks: at most three blocks can hold
three differing bits, so every pair within three bits shares at least two blocks
and none is lost. With several words, for a wide radius that stands for a
similarity of shingles, groups share one block of ``BAND_BITS`` bits: eight words
have 32 blocks, so a pair at similarity 0.8 shares one with a probability of
about 0.9, and a pair at 0.9 with one above 0.999.

Inside a group the rows are swept in the order of the first pivot coordinate.
Groups above ``block`` rows are split into pairs of blocks, so no task holds a
whole hot group, and only spanning edges leave a block.

Cases: null and empty texts, and texts without words, have fingerprint zero
and link with each other; repeated rows of one doc_id count as one document
per fingerprint; null doc_ids are dropped; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, blocks_of_groups, by_group, connected_components, join_hot, local_components, table, text_bytes, worker_cache

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
PIVOTS = 16
PIVOT_SEED = 20_201
#: Bit ranges of the five blocks; each pair of blocks is a key.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
BAND_BITS = 16
GROUP_BLOCK = 2_048
_CHUNK = 1 << 13


def radius_for(similarity: float, words: int) -> int:
    """Expected differing bits of texts of one length with that Jaccard similarity."""
    return int(64 * words * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Further hashes of a shingle, made from its XXH64; the first is that itself."""
    if k == 0:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, width: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of one text (UTF-8), in order and with repeats."""
    tokens = text.lower().split()  # on bytes both are ASCII only: A-Z, and \x20 \x09-\x0D
    if not tokens:
        return np.zeros(0, dtype="<u8")
    if len(tokens) <= width:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), dtype="<u8")


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """The SimHash of shingles given by their hashes: ``words`` big-endian 64-bit words."""
    ones = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        wide = np.stack([_mixed(part, k) for k in range(words)], axis=1).view(np.uint8)
        ones += np.unpackbits(wide, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return bits.view("<u8").astype(">u8").tobytes()


def fingerprint_of(text: bytes, width: int = SHINGLE_WORDS, words: int = 1, seed: int = SEED) -> bytes:
    """The SimHash of one text (UTF-8): ``words`` big-endian 64-bit words."""
    return fingerprint(shingle_hashes(text, width, seed), words)


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, words: int = 1) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for batch in batches:
            prints = pa.array([fingerprint_of(t, width, words) for t in text_bytes(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints], ["doc_id", "fp"])

    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp binary")


def as_words(column: pa.Array | pa.ChunkedArray, count: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(count, -1)


def pivots(words: int, count: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed pseudo-random bits."""
    return np.random.default_rng(PIVOT_SEED).integers(0, 2**64, (count, words), dtype=np.uint64)


def block_keys(fps: np.ndarray, radius: int) -> np.ndarray:
    """Keys of the groups that each fingerprint joins, one column per group."""
    if fps.shape[1] == 1:
        if radius >= len(BLOCKS):
            raise ValueError("with one word the radius must be below the number of bit blocks")
        masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in BLOCKS]
        chosen = [sum(c) for c in combinations(masks, len(BLOCKS) - radius)]
        parts = [fps[:, 0] & np.uint64(m) for m in chosen]
    else:
        low = np.uint64((1 << BAND_BITS) - 1)
        parts = [(fps[:, w] >> np.uint64(s)) & low for w in range(fps.shape[1]) for s in range(0, 64, BAND_BITS)]
    return np.stack([_mixed(part ^ (np.uint64(k) << np.uint64(57)), 1 + k) for k, part in enumerate(parts)], axis=1).view(np.int64)


def pivot_table(distinct: DataFrame, words: int, radius: int, count: int = PIVOTS) -> DataFrame:
    """Adds ``pv``, the distances to the pivots; ``p0``, the first; and ``keys``."""
    reference = pivots(words, count)
    columns = distinct.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = as_words(batch.column("fp"), batch.num_rows)
            rows = np.bitwise_count(fps[:, None, :] ^ reference[None]).sum(axis=2, dtype=np.uint16)
            coded = pa.array([r.tobytes() for r in rows], pa.binary())
            keys = pa.array(block_keys(fps, radius).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, coded, pa.array(rows[:, 0].astype(np.int32)), keys], [*columns, "pv", "p0", "keys"])

    kinds = ", ".join(f"{c} {t}" for c, t in distinct.dtypes)
    return distinct.mapInArrow(run, f"{kinds}, pv binary, p0 int, keys array<long>")


def near_pairs(whole: pa.Table, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of verified pairs among rows sorted by unit and first pivot."""
    unit = whole.column("unit").to_numpy()
    first = whole.column("p0").to_numpy()
    fps = as_words(whole.column("fp"), len(unit))
    own, other, blk = (whole.column(c).to_numpy() for c in ("own", "other", "blk"))
    coords = np.frombuffer(b"".join(whole.column("pv").to_pylist()), "<u2").reshape(len(unit), -1).astype(np.int16)
    left, right = [], []
    at = np.arange(len(unit) - 1)
    step = 1
    while len(at):
        to = at + step
        inside = to < len(unit)
        at, to = at[inside], to[inside]
        near = (unit[at] == unit[to]) & (first[to] - first[at] <= radius)
        at, to = at[near], to[near]  # a start that left the sweep's window never comes back
        test = (own[at] == other[at]) | (blk[at] != blk[to])
        a, b = at[test], to[test]
        if len(a):
            kept = np.abs(coords[a] - coords[b]).max(axis=1) <= radius
            a, b = a[kept], b[kept]
            hit = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int64) <= radius
            left.append(a[hit])
            right.append(b[hit])
        step += 1
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def links(ws: Workspace, distinct: DataFrame, words: int, radius: int, block: int = GROUP_BLOCK) -> DataFrame:
    """Spanning edges ``(src, dst)`` between representatives within radius.

    ``distinct`` has ``rep`` (a document) and ``fp``, one row per fingerprint.
    """
    coded = ws.write(pivot_table(distinct, words, radius), "pivots")
    # skinny rows are dealt and split first; fingerprints join those that share a group
    dealt = blocks_of_groups(ws, coded.select("rep", F.explode("keys").alias("key")), "key", "rep", block)
    dealt = dealt.select("unit", "own", "other", "blk", "rep").join(coded.select("rep", "fp", "pv", "p0"), "rep")

    def run(whole: pa.Table) -> pa.RecordBatch:
        a, b = near_pairs(whole, radius)
        rep = whole.column("rep").to_numpy()
        node = np.unique(np.concatenate([a, b]))
        label = node[local_components(len(node), np.searchsorted(node, a), np.searchsorted(node, b))]
        moved = label != node
        return pa.RecordBatch.from_arrays([pa.array(rep[node[moved]]), pa.array(rep[label[moved]])], ["src", "dst"])

    return by_group(dealt.select("unit", "p0", "rep", "fp", "pv", "own", "other", "blk"), "unit", ["p0", "rep"], run, "src long, dst long")


def simhash_groups(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS, words: int = 1, block: int = GROUP_BLOCK) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every document of ``docs``."""
    ws = Workspace(docs.sparkSession, "simhash")
    prints = ws.write(fingerprints(docs, width, words).distinct(), "prints")
    distinct = ws.write(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "distinct")
    labels = connected_components(ws, links(ws, distinct.drop("n"), words, radius, block))
    named = distinct.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "n", F.coalesce("component_id", "rep").alias("component_id"))
    return join_hot(prints, ws.write(named, "named"), "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
