"""Best-fit decreasing packing of tokenized documents into sequences.

Each document becomes its ids and an end id, cut into pieces of at most
``capacity`` only where it is longer. Only the piece lengths matter for the
packing, and there are at most ``capacity`` of them, so the plan is made from
the histogram of lengths: pieces are taken in decreasing length and each goes
to the open bin with the least room that still holds it, found in a segment
tree over remaining capacities in logarithmic time. Equal pieces that meet
equal bins are placed in one step, which gives the same bins as one by one.

Every piece then finds its place by its rank among the pieces of its length:
ranks are local to a written part plus the counts of the parts before it, so no
window over a hot length and no global sort is needed. The plan's size depends
on ``capacity`` alone, not on the data, and is broadcast; the counts grow with
the parts and are joined by merging.

Cases: a null or empty text is the end id alone; documents of exactly
``capacity`` fill a sequence; repeated rows are packed as often as they occur;
a word of any length is coded whole and only short ones are remembered;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, table
from .pretoken import id_bytes, lookup

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"


class Fullest:
    """Segment tree over remaining capacities 0..capacity, marking which have bins."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.width)

    def mark(self, room: int, on: bool) -> None:
        i = room + self.width
        self.any[i] = on
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least marked capacity that is at least ``need``."""
        i = need + self.width
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``{length: pieces}``.

    Rows are (length, first rank, pieces, first bin, pieces per bin, offset):
    the piece of rank r goes to bin ``first bin + (r - first rank) // per bin``
    at ``offset + length * ((r - first rank) % per bin)``.
    """
    rooms: dict[int, deque[tuple[int, int]]] = defaultdict(deque)  # room -> runs of bins (first, count)
    tree, rows, bins = Fullest(capacity), [], 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            rooms[room].append((first, count))
            tree.mark(room, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = rooms[room].popleft()
                if not rooms[room]:
                    tree.mark(room, False)
            each = room // length
            used = min(count, -(-left // each))
            put(room, first + used, count - used)
            taken = min(left, used * each)
            rows.append((length, rank, taken, first, each, capacity - room))
            full, rest = divmod(taken, each)
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            rank, left = rank + taken, left - taken
    return rows


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces with ``part`` and ``nth``: the place among equals within the part."""
    tail = id_bytes([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        words = lookup(path, "ids", id_bytes)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for doc_id, text in zip(ids, batch.column("text"), strict=True):
                body = words.of(text.as_py() or "", b"".join) + tail
                n = len(body) // 4
                first = n % capacity or capacity  # the short piece comes first, the rest are full
                start = 0
                for k in range(-(-n // capacity)):
                    end = first + k * capacity
                    rows.append((doc_id, k, start, end - start, zlib.crc32(body[4 * start : 4 * end]), part, seen[end - start]))
                    seen[end - start] += 1
                    start = end
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = source.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long, part long, nth long")
    return found.withColumn("piece", F.col("piece").cast("int"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``."""
    ws = Workspace(docs.sparkSession, "packing")
    cut = ws.write(pieces(docs, path, capacity, end_id), "pieces")
    counts = ws.write(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("length", "part", before.alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows = np.array(plan(histogram, capacity), dtype=np.int64).reshape(-1, 6)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    most = 1 + (int(rows[:, 2].max()) if len(rows) else 0) + (int(rows[:, 1].max()) if len(rows) else 0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        keys = steps[:, 0] * most + steps[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = steps[np.searchsorted(keys, length * most + rank, side="right") - 1]
            nth = rank - at[:, 1]
            sequence = at[:, 3] + nth // at[:, 4]
            offset = at[:, 5] + length * (nth % at[:, 4])
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = cut.join(bases.hint("merge"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "nth", "base")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
