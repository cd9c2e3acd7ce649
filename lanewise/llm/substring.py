"""Substring dedup by difference-cover anchors.

A difference cover modulo ``PERIOD`` holds, for any two residues, a shift that
moves both into it. Two equal passages of ``WINDOW`` words, wherever they start,
so have a position within the first ``PERIOD`` words at which both lie on the
cover, and the ``WINDOW - PERIOD + 1`` words from there on are an anchor that
both share. Only windows at cover positions are hashed and compared at first.
An anchor found in two documents is then extended: every window that contains
it is hashed whole (twice 64 bits, from independent hashes of its words) and removed where the same window starts in a
document with a smaller id.

Cases: null and empty texts have no words; documents below ``WINDOW`` words keep
all of theirs; repetitions within one document stay; repeated rows of one
doc_id are one document's text given twice, and each is judged; null doc_ids
are dropped; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table, text_bytes
from .repeats import Places, covered, mix, partitions_for, per_document, prefix, repeated_places, span_arrays, span_hash

WINDOW = 50
#: A perfect difference set modulo 31.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LANE = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(31).integers(1, 2**63, 2, dtype=np.uint64)
_SEGMENT = 2 << 20


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words of UTF-8 bytes."""
    space = np.concatenate([[True], _SPACE[raw], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[0::2], edge[1::2]


def _segments(text: bytes) -> Iterator[bytes]:
    """The text in parts cut at white space, so that work space stays bounded."""
    at = 0
    while at < len(text):
        end = at + _SEGMENT
        if end < len(text):
            while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                end += 1
        yield text[at:end]
        at = end


def word_hashes(text: bytes, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; those of another ``which`` are independent of it.

    A word is read in lanes of eight bytes. Each lane is scrambled with its place and the
    seed before the lanes are added, so unlike sums of powers there is no pair of
    words that collides whatever the seed.
    """
    found = []
    for part in _segments(text):
        raw = np.frombuffer(part + bytes(8), np.uint8)
        start, stop = word_spans(raw[:-8])
        if not len(start):
            continue
        length = stop - start
        lanes = (length + 7) // 8
        first = np.cumsum(lanes) - lanes
        within = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
        left = np.minimum(np.repeat(length, lanes) - 8 * within, 8).astype(np.uint64)
        value = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))[np.repeat(start, lanes) + 8 * within]
        value = value & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
        mixed = mix(value ^ mix(within.astype(np.uint64) * _LANE + _SEEDS[which]))
        found.append(mix(np.add.reduceat(mixed, first) ^ mix(length.astype(np.uint64) + _SEEDS[which])))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[Places]:
    """Hashes of the anchor windows at cover positions."""
    on_cover = np.zeros(PERIOD, bool)
    on_cover[list(COVER)] = True
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
            words = word_hashes(text)
            if len(words) < WINDOW:
                continue
            at = np.flatnonzero(on_cover[np.arange(len(words) - ANCHOR + 1) % PERIOD])
            key = span_hash(prefix(words, 0), at, at + ANCHOR, 0)
            yield key, np.zeros(len(at), np.uint64), np.full(len(at), doc_id, np.int64), at.astype(np.int32), key


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    n, step, low = len(values) - width + 1, 1, values
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return np.minimum(low[:n], low[width - step : width - step + n])


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[Places]:
    """Whole windows around each document's shared anchors."""
    for batch in batches:
        for doc_id, text, (start, stop) in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), span_arrays(batch.column("spans")), strict=True):
            words = word_hashes(text)
            if len(words) < WINDOW or not len(start):
                continue
            near = covered(len(words) - WINDOW + 1, np.maximum(start - (WINDOW - ANCHOR), 0), stop)
            at = np.flatnonzero(near)
            key = span_hash(prefix(words, 0), at, at + WINDOW, 0)
            key2 = span_hash(prefix(word_hashes(text, 1), 1), at, at + WINDOW, 1)
            yield key, key2, np.full(len(at), doc_id, np.int64), at.astype(np.int32), _least(words, WINDOW)[at]


def repeated_windows(ws: Workspace, docs: DataFrame) -> DataFrame:
    """Ranges of window starts that also occur in a smaller document."""
    partitions = partitions_for(docs)
    shared = ws.write(repeated_places(docs, anchors, True, True, partitions), "anchors")
    near = docs.join(per_document(shared), "doc_id")
    found = ws.write(repeated_places(near, windows, True, False, partitions), "windows")
    ws.drop("anchors")
    return found


def kept_words(text: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept words joined by one space."""
    words = text.split()
    if not len(start):
        return len(words), 0, b" ".join(words)
    gone = covered(len(words), start, stop + (WINDOW - 1))
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: every document's text without repeats."""
    return _apply(docs, lambda kept: kept.decode("utf-8"), "kept string")


def _apply(docs: DataFrame, finish, column: str) -> DataFrame:
    source = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = per_document(repeated_windows(Workspace(docs.sparkSession, "substring"), source))
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_words(text, *ranges) for text, ranges in zip(text_bytes(batch.column("text")), span_arrays(batch.column("spans")), strict=True)]
            n, gone, kept = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([finish(k) for k in kept], pa.string())], ["doc_id", "n_words", "n_removed", name])

    return source.join(spans, "doc_id", "left").mapInArrow(run, f"doc_id long, n_words long, n_removed long, {column}")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply(table(spark, sf_dir, "documents"), lambda kept: hashlib.sha256(kept).hexdigest(), "kept_sha256 string")
