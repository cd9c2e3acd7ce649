"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with runs of white space as one space. An
item of n characters may differ by ``floor(rate * n)`` edits; cut into one piece
more than that, at least one piece of any match is untouched. Documents are
scanned for all pieces at once (Aho-Corasick); each hit fixes where the item
would lie, up to the error budget, and Myers' bit-parallel distance decides.

The items are a stated query set against all documents: they are read in blocks
of at most ``BLOCK_CHARS`` characters, and each block is broadcast and scanned
on its own, so any number of items works. No document is shuffled.

Items below ``SHORT_CHARS`` characters have a budget of 1 or 0 edits by the same rule.
They are found like all others, and their rows are marked ``short``, since such
a text may also stand in a document by chance.

Cases: null and empty texts match nothing; null and empty items have nothing to
look for; equal items all match; repeated rows of a document are compared each, and give repeated rows;
a null doc_id is compared like others; of equally good places of an item the first one
found from the left counts; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, small_batches, table, whole_row, with_row, worker_cache

ERROR_RATE = 0.05
SHORT_CHARS = 25
BLOCK_CHARS = 8 << 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(item: str, rate: float = ERROR_RATE) -> int:
    return int(rate * len(item))


def cut(item: str, parts: int) -> list[tuple[int, str]]:
    """``parts`` adjoining pieces of nearly equal length, with their offsets."""
    ends = [len(item) * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def best_end(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to any substring of ``text``, and its end.

    Myers' bit-parallel recurrence; one word of len(item) bits per character.
    """
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    match: dict[str, int] = {}
    for i, c in enumerate(item):
        match[c] = match.get(c, 0) | (1 << i)
    up, down, score = full, 0, n
    best, at = n, 0
    for j, c in enumerate(text, 1):
        eq = match.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if score < best:
            best, at = score, j
    return best, at


class Items:
    """A block of items and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, normal(t)) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(self.items):
            for offset, piece in cut(text, budget(text, rate) + 1):
                places.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()
        self.rate = rate

    def matches(self, text: str) -> list[tuple[int, int, int, bool]]:
        """(item id, distance, end, short) of each item that ``text`` holds, at its best."""
        starts: dict[int, list[int]] = {}
        for end, (size, at) in self.automaton.iter(text):
            for k, offset in at:
                starts.setdefault(k, []).append(end + 1 - size - offset)
        found = []
        for k, guesses in starts.items():
            item_id, item = self.items[k]
            most = budget(item, self.rate)
            best = None
            covered = -1
            for guess in sorted(guesses):
                if guess <= covered:
                    continue
                covered = guess + most  # one window serves guesses that lie this close
                low = max(0, guess - most)
                distance, end = best_end(item, text[low : covered + len(item) + most])
                if distance <= most and (best is None or distance < best[0]):
                    best = (distance, low + end)
                    if distance == 0:
                        break
            if best:
                found.append((item_id, *best, len(item) < SHORT_CHARS))
        return found


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    rows = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    for row in rows.toLocalIterator():
        if not normal(row.text):
            continue
        if held and size + len(row.text) > most:
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text)
    if held:
        yield held


def _items(block: list[tuple[int, str]], name: str, rate: float) -> Items:
    """The automaton of a block, kept by a worker from task to task."""
    held = worker_cache("items")
    if (name, rate) not in held:
        held.clear()
        held[name, rate] = Items(block, rate)
    return held[name, rate]


def _name(block: list[tuple[int, str]]) -> str:
    return hashlib.sha256(repr(block).encode()).hexdigest()


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, most: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, distance, end_char, short)``: the items that each document holds.

    ``end_char`` counts characters of the normalised text; ``short`` marks items
    below ``SHORT_CHARS`` characters.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, item_id long, distance int, end_char long, short boolean"
    source = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    result = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, most):
        shared, name = spark.sparkContext.broadcast(block), _name(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                items = _items(shared.value, name, rate)
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    rows += [(doc_id, *m) for m in items.matches(normal(text.as_py()))]
                columns = zip(*rows, strict=True) if rows else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()), strict=True)], ["doc_id", "item_id", "distance", "end_char", "short"])

        result = result.unionByName(source.mapInArrow(run, schema))
    return result


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, most: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item: each is judged where it is read."""
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "clean")
    for k, block in enumerate(_blocks(benchmark, most)):
        if k:
            docs = ws.write(docs, f"block{k}")  # one automaton at a time in a worker
        shared, name, columns = spark.sparkContext.broadcast(block), _name(block), docs.columns
        rows = docs.select(whole_row(columns), "text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                items = _items(shared.value, name, rate)
                good = [not text.is_valid or not items.matches(normal(text.as_py())) for text in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(good, pa.bool_()))], ["row"])

        docs = rows.mapInArrow(run, with_row(rows)).select("row.*")
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
