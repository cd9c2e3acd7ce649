"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a ``LENGTH``-byte string that also starts earlier is
removed. Strings are brought together by anchors: of the ``SPAN`` k-grams in a
string the one with the least hash (the first of equals) depends on the string
alone, so equal strings have equal anchors at equal offsets. Anchors that occur
once are dropped. Around each other anchor the strings that hold it are taken
in pieces of ``WIDTH`` neighbouring starts; their common middle, the core, is
hashed (128 bits), and pieces with equal cores meet.

Pieces that are equal throughout are collapsed to the earliest one. Where pieces
with one core differ, a suffix array over all of them (the core as one symbol)
is built by linear grouping, and strings that are equal stand side by side in it.
A chunk sends at most ``CHUNK_CAP`` different pieces of one core and a suffix
array takes at most ``ARRAY_CAP``; cores above either bound are settled string
by string under the hash of each (128 bits), which no longer meet in one place.

Cases: null and empty texts, and texts below ``LENGTH`` bytes, are kept whole;
matches never cross documents, but overlapping ones within a document count;
equal texts of repeated rows with one doc_id count as one place; null doc_ids
are dropped; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table, text_bytes, whole_row, with_row, worker_cache
from .repeats import (
    _PARCEL,
    BUCKETS_PER_PARTITION,
    RANGES,
    Places,
    by_bucket,
    combine,
    covered,
    dealt,
    mix,
    packed,
    parcel_batch,
    parcels,
    partitions_for,
    per_document,
    prefix,
    range_batch,
    repeated_places,
    settle,
    span_arrays,
    span_hash,
    to_ranges,
    unpacked,
)
from .suffixarray import classes

LENGTH = 100
GRAM = 37
SPAN = LENGTH - GRAM + 1  # 64 k-grams, in pieces of 16
WIDTH = 16
SIDE = WIDTH - 1
CHUNK_PIECES = 250_000
CHUNK_CAP = 256
ARRAY_CAP = 4_096
ARRAY_SYMBOLS = 200_000

_BYTES = tuple(np.random.default_rng(s).integers(1, 2**63, 256, dtype=np.uint64) for s in (100, 101))
_WEIGHTS = tuple(np.random.default_rng(s).integers(1, 2**63, 2 * SIDE, dtype=np.uint64) | np.uint64(1) for s in (102, 103))
_POS_BITS = np.uint64(22)
_POS_MASK = np.uint64((1 << 22) - 1)
_SEGMENT = (1 << 22) - 4 * LENGTH


def _anchors_of(raw: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of one segment: position, hash, first and last string start that has it."""
    n = len(raw) - LENGTH + 1
    at = np.arange(n + SPAN - 1)
    key = span_hash(sums, at, at + GRAM, 0)
    ranked = (key & ~_POS_MASK) | at.astype(np.uint64)
    low, step = ranked, 1
    while 2 * step <= SPAN:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    chosen = (low[:n] & _POS_MASK).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    pos = chosen[first]
    return pos, key[pos], first, last


def segments(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Parts of a text with their offsets; neighbours share ``LENGTH - 1`` bytes."""
    for at in range(0, max(1, len(text) - LENGTH + 1), _SEGMENT):
        yield at, text[at : at + _SEGMENT + LENGTH - 1]


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[Places]:
    """Every anchor under its hash; a place is the anchor's position."""
    worker_cache("suffix")
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
            if len(text) < LENGTH:
                continue
            for offset, part in segments(text):
                raw = np.frombuffer(part, np.uint8)
                if len(raw) < LENGTH:
                    continue
                pos, key, _, _ = _anchors_of(raw, prefix(_BYTES[0][raw], 0))
                yield key, np.zeros(len(key), np.uint64), np.full(len(key), doc_id, np.int64), (pos + offset).astype(np.int32), key


#: What is sent of a piece: core, core2, doc, anchor position, piece number, how many
#: bytes lie before and after the core, those bytes, and whether it only marks its core.
_SENT = ["u8", "u8", "i8", "i4", "u1", "u1", "u1", f"V{SIDE}", f"V{SIDE}", "u1"]
#: In memory the hash of the whole piece (128 bits) follows the core's.
Pieces = list[np.ndarray]


def with_whole(sent: list[np.ndarray]) -> Pieces:
    """Adds the hash of the whole piece, made from the core's and the bytes around it."""
    pre, post = (np.ascontiguousarray(sent[k]).view(np.uint8).reshape(-1, SIDE).astype(np.uint64) + np.uint64(1) for k in (7, 8))
    sizes = sent[5].astype(np.uint64) * np.uint64(256) + sent[6] + np.uint64(977)
    whole = []
    for k in (0, 1):
        sides = (pre * _WEIGHTS[k][:SIDE]).sum(axis=1, dtype=np.uint64) + (post * _WEIGHTS[k][SIDE:]).sum(axis=1, dtype=np.uint64)
        whole.append(mix(mix(sides) ^ sent[k]) + mix(sizes))
    return [*sent[:2], *whole, *sent[2:]]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Pieces]:
    """The pieces around each document's repeated anchors."""
    worker_cache("suffix")
    for batch in batches:
        for doc_id, text, (start, stop) in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), span_arrays(batch.column("spans")), strict=True):
            if len(text) < LENGTH or not len(start):
                continue
            wanted = covered(len(text), start, stop)
            for offset, part in segments(text):
                raw = np.frombuffer(part, np.uint8)
                if len(raw) < LENGTH:
                    continue
                sums = prefix(_BYTES[0][raw], 0)
                pos, _, first, last = _anchors_of(raw, sums)
                kept = wanted[pos + offset]
                pos, first, last = pos[kept], first[kept], last[kept]
                if not len(pos):
                    continue
                # an anchor at p serves starts p - o for o from p - last to p - first
                low, high = (pos - last) // WIDTH, (pos - first) // WIDTH
                each = high - low + 1
                p = np.repeat(pos, each)
                q = np.repeat(low, each) + np.arange(len(p)) - np.repeat(np.cumsum(each) - each, each)
                core, end = p - q * WIDTH, p - q * WIDTH - SIDE + LENGTH
                before, after = np.minimum(SIDE, core), np.minimum(SIDE, len(raw) - end)
                sums2 = prefix(_BYTES[1][raw], 1)
                wide = np.concatenate([np.zeros(SIDE, np.uint8), raw, np.zeros(SIDE, np.uint8)])
                side = np.arange(SIDE)
                pre, post = wide[core[:, None] + side], wide[end[:, None] + SIDE + side]
                yield with_whole(
                    [
                        span_hash(sums, core, end, 0) + mix(q.astype(np.uint64)),
                        span_hash(sums2, core, end, 1),
                        np.full(len(p), doc_id, np.int64),
                        (p + offset).astype(np.int32),
                        q.astype(np.uint8),
                        before.astype(np.uint8),
                        after.astype(np.uint8),
                        np.ascontiguousarray(pre).view(f"V{SIDE}").ravel(),
                        np.ascontiguousarray(post).view(f"V{SIDE}").ravel(),
                        np.zeros(len(p), np.uint8),
                    ]
                )


def starts_of(piece: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """First and last string start of each piece."""
    p, q, before, after = (piece[k].astype(np.int64) for k in (5, 6, 7, 8))
    core = p - q * WIDTH
    return core - before, core - np.maximum(0, SIDE - after)


def _ordered(piece: Pieces) -> tuple[Pieces, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces by core, whole, place; which are the first of their kind, and which
    lie elsewhere than it; core numbers; kinds per core."""
    order = np.lexsort((piece[5], piece[4], piece[3], piece[2], piece[1], piece[0]))
    piece = [c[order] for c in piece]
    step = lambda a: a[1:] != a[:-1]
    new_core = np.concatenate([[True], step(piece[0]) | step(piece[1])])
    lead = new_core | np.concatenate([[True], step(piece[2]) | step(piece[3])])
    own = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))
    elsewhere = (piece[4] != piece[4][own]) | (piece[5] != piece[5][own])
    number = np.cumsum(new_core) - 1
    return piece, lead, elsewhere, number, np.bincount(number, weights=lead).astype(np.int64)


def _places(piece: Pieces, rows: np.ndarray) -> Places:
    """Each string of the given pieces under its own hash."""
    pre = np.ascontiguousarray(piece[9][rows]).view(np.uint8).reshape(-1, SIDE).astype(np.uint64)
    post = np.ascontiguousarray(piece[10][rows]).view(np.uint8).reshape(-1, SIDE).astype(np.uint64)
    before, after = piece[7][rows], piece[8][rows]
    core = piece[5][rows].astype(np.int64) - piece[6][rows].astype(np.int64) * WIDTH
    out = []
    for t in range(WIDTH):
        ok = (before >= t) & (after >= SIDE - t)
        if not ok.any():
            continue
        keys = []
        for k in (0, 1):
            w = _WEIGHTS[k]
            sides = ((pre[ok][:, SIDE - t :] + np.uint64(1)) * w[:t]).sum(axis=1, dtype=np.uint64) + ((post[ok][:, : SIDE - t] + np.uint64(1)) * w[SIDE : 2 * SIDE - t]).sum(axis=1, dtype=np.uint64)
            keys.append(mix(mix(sides) ^ (piece[k][rows][ok] + np.uint64((t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))))
        out.append((*keys, piece[4][rows][ok], (core[ok] - t).astype(np.int32), keys[0]))
    if not out:
        return tuple(np.zeros(0, k) for k in ("u8", "u8", "i8", "i4", "u8"))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


Row = tuple[int, int, bytes]


def _range_row(doc: np.ndarray, first: np.ndarray, last: np.ndarray, buckets: int, salt: int) -> list[Row]:
    if not len(doc):
        return []
    return [(-1 - (int(doc[0]) + salt) % buckets, len(doc), packed(doc.astype("i8"), first.astype("i4"), (last + 1).astype("i4")))]


def _string_rows(piece: Pieces, rows: np.ndarray, buckets: int, salt: int, base: int) -> list[Row]:
    """Strings of overfull cores: decided here where possible, else sent on by hash."""
    places = _places(piece, rows)
    if not len(places[0]):
        return []
    here, send, stands = combine(places, False, False)
    doc, start, stop = to_ranges(places[2][here], places[3][here].astype(np.int64))
    sent = parcels(places[4][send], [places[0][send], places[1][send], places[2][send], places[3][send], stands], buckets)
    return [*_range_row(doc, start, stop - 1, buckets, salt), *((base + b, n, blob) for b, n, blob in sent)]


def chunk_rows(piece: Pieces, buckets: int, salt: int, cap: int = CHUNK_CAP) -> list[Row]:
    """What one chunk decides, and what it sends to the cores' buckets."""
    piece, lead, elsewhere, number, kinds = _ordered(piece)
    first, last = starts_of(piece)
    out = _range_row(piece[4][elsewhere], first[elsewhere], last[elsewhere], buckets, salt)
    over = kinds[number] > cap
    out += _string_rows(piece, np.flatnonzero(lead & over), buckets, salt, buckets)
    heads = np.concatenate([[True], number[1:] != number[:-1]])
    piece[11] = (heads & over).astype(np.uint8)
    send = np.flatnonzero((lead & ~over) | (heads & over))
    return out + [*parcels(piece[0][send], [c[send] for c in (*piece[:2], *piece[4:])], buckets)]


def array_ranges(piece: Pieces, rows: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings of the given pieces that start earlier in another: doc and start.

    One suffix array over all pieces: the bytes before the core, the core's own
    symbol, the bytes after it, and a separator.
    """
    pre = np.ascontiguousarray(piece[9][rows]).view(np.uint8).reshape(-1, SIDE).astype(np.int64) + 2
    post = np.ascontiguousarray(piece[10][rows]).view(np.uint8).reshape(-1, SIDE).astype(np.int64) + 2
    before, after = piece[7][rows].astype(np.int64), piece[8][rows].astype(np.int64)
    column = np.arange(2 * WIDTH)
    grid = np.concatenate([pre, (258 + number - number[0])[:, None], post, np.ones((len(rows), 1), np.int64)], axis=1)
    filled = ((column >= SIDE - before[:, None]) & (column <= SIDE + after[:, None])) | (column == 2 * SIDE + 1)
    row, col = np.nonzero(filled)
    order, kind = classes(grid[filled].tolist(), WIDTH)
    row, col = row[order], col[order]
    back = SIDE - col  # bytes before the core
    ok = (back >= 0) & (after[row] >= SIDE - back)
    row, kind = row[ok], kind[ok]
    start = piece[5][rows][row].astype(np.int64) - piece[6][rows][row].astype(np.int64) * WIDTH - back[ok]
    doc = piece[4][rows][row]
    order = np.lexsort((start, doc, kind))
    kind, doc, start = kind[order], doc[order], start[order]
    head = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    own = np.repeat(head, np.diff([*head, len(kind)]))
    later = (doc != doc[own]) | (start != start[own])
    return doc[later], start[later]


def settle_pieces(piece: Pieces, buckets: int, salt: int, most: int = ARRAY_CAP) -> list[Row]:
    """One bucket of cores: collapse equal pieces, then suffix arrays over the others."""
    piece, lead, elsewhere, number, kinds = _ordered(piece)
    marked = np.bincount(number, weights=piece[11]).astype(bool)
    first, last = starts_of(piece)
    whole = (piece[11] == 0) & elsewhere & ~marked[number]
    out = _range_row(piece[4][whole], first[whole], last[whole], buckets, salt)
    by_string = marked | (kinds > most)
    out += _string_rows(piece, np.flatnonzero((lead | marked[number]) & by_string[number] & (piece[11] == 0)), buckets, salt, 0)
    rows = np.flatnonzero(lead & ~by_string[number] & (kinds[number] > 1))
    at = 0
    while at < len(rows):
        end = min(len(rows), at + ARRAY_SYMBOLS // (2 * WIDTH))
        while end < len(rows) and number[rows[end]] == number[rows[end - 1]]:
            end += 1  # a core's pieces stay together
        doc, start, stop = to_ranges(*array_ranges(piece, rows[at:end], number[rows[at:end]]))
        out += _range_row(doc, start, stop - 1, buckets, salt)
        at = end
    return out


def _gather(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    held, n, k = [], 0, 0

    def flush() -> pa.RecordBatch:
        return parcel_batch(chunk_rows([np.concatenate(c) for c in zip(*held, strict=True)], buckets, k))

    for piece in pieces(batches):
        held.append(piece)
        n += len(piece[0])
        if n >= CHUNK_PIECES:
            yield flush()
            held, n, k = [], 0, k + 1
    if n:
        yield flush()


def _settle(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for bucket, parts in by_bucket(batches):
        if 0 <= bucket < buckets:
            sent = [np.concatenate(c) for c in zip(*(unpacked(n, blob, _SENT) for n, blob in parts), strict=True)]
            rows = settle_pieces(with_whole(sent), buckets, bucket)
        else:
            rows = [(bucket if bucket < 0 else bucket - buckets, n, blob) for n, blob in parts]
        if rows:
            yield parcel_batch(rows)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, parts in by_bucket(batches):
        if bucket < 0:
            for n, blob in parts:
                yield range_batch(*unpacked(n, blob, ["i8", "i4", "i4"]))
            continue
        key, key2, doc, pos, stands = (np.concatenate(c) for c in zip(*(unpacked(n, blob, ["u8", "u8", "i8", "i4", "u1"]) for n, blob in parts), strict=True))
        hit = settle(key, key2, doc, pos, stands, False, False)
        if len(hit):
            yield range_batch(*to_ranges(doc[hit], pos[hit]))


def repeated_strings(ws: Workspace, docs: DataFrame) -> DataFrame:
    """Ranges of starts whose ``LENGTH``-byte string also starts earlier."""
    partitions = partitions_for(docs)
    buckets = BUCKETS_PER_PARTITION * partitions
    shared = ws.write(repeated_places(docs, anchors, False, True, partitions), "anchors")
    near = docs.join(per_document(shared), "doc_id")
    sent = dealt(near.mapInArrow(lambda b: _gather(b, buckets), _PARCEL), partitions)
    settled = ws.write(sent.mapInArrow(lambda b: _settle(b, buckets), _PARCEL), "settled")
    ws.drop("anchors")  # all that was read from it is written
    strings = ws.write(dealt(settled, partitions).mapInArrow(_decide, RANGES), "strings")
    ws.drop("settled")
    return strings


def cut_out(text: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[int, int, int, bytes]:
    """Bytes, bytes removed, runs removed, and what is left."""
    if not len(start):
        return len(text), 0, 0, text
    gone = covered(len(text), start, stop + (LENGTH - 1))
    runs = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
    return len(text), int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, finish: Callable[[bytes], object], kind: pa.DataType, declared: str, keep: list[str]) -> DataFrame:
    """``(row, n_bytes, n_removed, n_spans, kept)`` for every row of ``docs``.

    ``row`` is a struct of the columns named in ``keep``; ``kept`` is ``finish``
    of what is left, of Arrow type ``kind`` and Spark type ``declared``.
    """
    source = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = per_document(repeated_strings(Workspace(docs.sparkSession, "suffix"), source))
    carried = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", whole_row(keep))
    joined = carried.join(spans, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut_out(text, *ranges) for text, ranges in zip(text_bytes(batch.column("text")), span_arrays(batch.column("spans")), strict=True)]
            n, gone, runs, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array([finish(k) for k in kept], kind)], ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select("row", "text", "spans").mapInArrow(run, with_row(carried, f"n_bytes long, n_removed long, n_spans long, kept {declared}"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), lambda kept: hashlib.sha256(kept).hexdigest(), pa.string(), "string", ["doc_id"])
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))
