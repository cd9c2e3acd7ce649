"""Which keyed places occur again elsewhere: one packed shuffle, safe for hot keys.

Places ``(key, doc, pos)`` are gathered in Python into chunks of about
``CHUNK`` places. Each chunk is combined first: what a chunk can decide alone
(a place whose key has an earlier place in the same chunk) never leaves it, and
of every key only its first document's places go on. So however hot a key is,
its reducer receives one document's places per chunk. The rest travels as one
compressed row per chunk and bucket and is settled per bucket with sorted arrays.
Buckets and partitions grow with the bytes of the input, so that a bucket's share
of it does not.

Results are ranges ``(doc_id, start, stop)`` of positions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width

CHUNK = 600_000
BUCKETS_PER_PARTITION = 4
#: Text for each partition of the shuffles, where the session sets no more of them.
PARTITION_BYTES = 64 << 20
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_ODD = np.uint64(0x9E3779B97F4A7C15)
RANGES = "doc_id long, start int, stop int"
_PARCEL = "bucket int, n long, blob binary"

Places = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # key, key2, doc, pos, route
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _BASES[which]
        steps = [np.full(size, np.uint64(b), np.uint64) for b in (base, pow(base, -1, 2**64))]
        for s in steps:
            s[0] = 1
        have = _POWERS[which] = tuple(np.cumprod(s, dtype=np.uint64) for s in steps)
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(values: np.ndarray, which: int) -> np.ndarray:
    """Sums from which :func:`span_hash` takes the hash of any span."""
    up, _ = powers(which, len(values))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up, dtype=np.uint64)])


def span_hash(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray, which: int) -> np.ndarray:
    """Hashes of ``values[start:stop]``, the same wherever the span lies."""
    _, down = powers(which, len(sums))
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * _ODD)


def to_ranges(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of adjoining positions of one document."""
    if not len(doc):
        return doc, pos, pos
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], pos[first], pos[last] + 1


def range_batch(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["doc_id", "start", "stop"])


def _by_byte(kind: np.dtype) -> bool:
    """Whether a column is sent byte by byte of its numbers, which compresses well."""
    return kind.kind in "iu" and kind.itemsize > 1


def packed(*columns: np.ndarray) -> bytes:
    parts = []
    for column in map(np.ascontiguousarray, columns):
        if _by_byte(column.dtype):
            column = np.ascontiguousarray(column.view(np.uint8).reshape(-1, column.dtype.itemsize).T)
        parts.append(column.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(n: int, blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    blob = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    for kind in map(np.dtype, kinds):
        if _by_byte(kind):
            a = np.frombuffer(blob, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
            a = np.ascontiguousarray(a.T).view(kind).ravel()
        else:
            a = np.frombuffer(blob, kind, n, at)
        out.append(a)
        at += a.nbytes
    return out


_KINDS = ["u8", "u8", "i8", "i4", "u1"]


def _groups(key: np.ndarray, key2: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, doc, pos; where a key begins in that order; each one's key number."""
    order = np.lexsort((pos, doc, key2, key))
    k, k2 = key[order], key2[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def combine(places: Places, across_docs: bool, any_repeat: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices decided here, indices to send, and which of those only stand for their key."""
    key, key2, doc, pos, _ = places
    order, first, number = _groups(key, key2, doc, pos)
    d, p = doc[order], pos[order]
    same = (d == d[first][number]) & (across_docs | (p == p[first][number]))
    if not any_repeat:
        return order[~same], order[same], np.zeros(int(same.sum()), np.uint8)
    repeated = np.zeros(len(first), bool)
    repeated[number[~same]] = True
    lead = np.zeros(len(order), bool)
    lead[first] = True
    send = lead | ~repeated[number]
    return order[repeated[number]], order[send], repeated[number][send].astype(np.uint8)


def settle(key, key2, doc, pos, stands, across_docs: bool, any_repeat: bool) -> np.ndarray:
    """Indices of the places sent to a bucket that have the match asked for."""
    order, first, number = _groups(key, key2, doc, pos)
    d, p = doc[order], pos[order]
    same = (d == d[first][number]) & (across_docs | (p == p[first][number]))
    if not any_repeat:
        return order[~same]
    repeated = np.zeros(len(first), bool)
    repeated[number[~same]] = True
    repeated[number[stands[order] == 1]] = True
    return order[repeated[number] & (stands[order] == 0)]


def parcels(route: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """One binary row per bucket, in document order within it."""
    bucket = (mix(route) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((columns[3], columns[2], bucket))
    bucket = bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
        part = order[a:b]
        yield int(bucket[a]), len(part), packed(*(c[part] for c in columns))


def parcel_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, n, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(n, pa.int64()), pa.array(blob, pa.binary())], ["bucket", "n", "blob"])


def gathered(chunks: Iterator[Places], most: int = CHUNK) -> Iterator[Places]:
    held, n = [], 0
    for chunk in chunks:
        if len(chunk[0]):
            held.append(chunk)
            n += len(chunk[0])
        if n >= most:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Parcels of each bucket together, from rows sorted by bucket."""
    at, held = None, []
    for batch in batches:
        for b, n, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "blob")), strict=True):
            if b != at and held:
                yield at, held
                held = []
            at = b
            held.append((n, blob))
    if held:
        yield at, held


def partitions_for(source: DataFrame) -> int:
    """Partitions of the shuffles of an operator that reads ``source``."""
    size = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(shuffle_width(source.sparkSession), -(-size // PARTITION_BYTES))


def dealt(rows: DataFrame, partitions: int) -> DataFrame:
    """Parcels of one bucket in one partition; buckets are spread evenly."""
    return rows.repartitionById(partitions, F.pmod(F.col("bucket"), F.lit(partitions))).sortWithinPartitions("bucket")


def repeated_places(source: DataFrame, places: Callable[[Iterator[pa.RecordBatch]], Iterator[Places]], across_docs: bool, any_repeat: bool, partitions: int) -> DataFrame:
    """``(doc_id, start, stop)`` ranges of the places whose key is repeated.

    ``places`` turns batches of ``source`` into places. With ``across_docs``
    only places in another document count as a match, otherwise any other
    place does. With ``any_repeat`` a place is returned if its key matches
    anywhere, otherwise only if the match lies in a smaller document (or, within
    one document, at an earlier position).
    """
    buckets = BUCKETS_PER_PARTITION * partitions

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, chunk in enumerate(gathered(places(batches))):
            here, send, stands = combine(chunk, across_docs, any_repeat)
            key, key2, doc, pos, route = chunk
            rows = [*parcels(route[send], [key[send], key2[send], doc[send], pos[send], stands], buckets)]
            if len(here):
                found = to_ranges(doc[here], pos[here])
                rows.append((-1 - (int(doc[here[0]]) + k) % buckets, len(found[0]), packed(found[0].astype("i8"), found[1].astype("i4"), found[2].astype("i4"))))
            yield parcel_batch(rows)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in by_bucket(batches):
            if bucket < 0:
                for n, blob in parts:
                    yield range_batch(*unpacked(n, blob, ["i8", "i4", "i4"]))
                continue
            key, key2, doc, pos, stands = (np.concatenate(c) for c in zip(*(unpacked(n, blob, _KINDS) for n, blob in parts), strict=True))
            hit = settle(key, key2, doc, pos, stands, across_docs, any_repeat)
            if len(hit):
                yield range_batch(*to_ranges(doc[hit], pos[hit]))

    return dealt(source.mapInArrow(gather, _PARCEL), partitions).mapInArrow(decide, RANGES)


def per_document(ranges: DataFrame) -> DataFrame:
    """``(doc_id, spans)``: each document's ranges in one array, bounded by its length."""
    return ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def span_arrays(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and stops of each row's ``spans``; empty where null."""
    flat = column.values if isinstance(column, pa.ListArray) else column.combine_chunks().values
    starts, stops = flat.field("start").to_numpy(zero_copy_only=False), flat.field("stop").to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    for i, good in enumerate(column.is_valid().to_pylist()):
        a, b = (ends[i], ends[i + 1]) if good else (0, 0)
        yield starts[a:b], stops[a:b]


def covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Mask of the positions below n that the ranges cover."""
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, np.minimum(starts, n), 1)
    np.add.at(marks, np.minimum(stops, n), -1)
    return np.cumsum(marks[:n]) > 0
