"""Token counts by a map-side lookup in two tiers, without a shuffle of pre-tokens.

Tier one is a compact table of the frequent words (see ``pretoken``) of the
documents and their token counts. All documents are counted for it, each task
into a bounded table of its own, of which the most frequent ``TIER_WORDS`` go
on; these tables are merged ``FAN`` at a time to one. Words above ``WORD_CHARS``
characters stay out of it, so its size has a bound, and it is broadcast as one
blob of keys with their ends and counts, from which each worker process makes
its hash table once. Tier two is a bounded cache in each worker, filled by the
tokenizer with the words that tier one misses. Which words tier one holds never
changes a count.

Cases: a null text counts as empty (no bytes, no tokens); repeated rows are counted
each; null doc_ids are kept; extra columns are ignored; an empty table gives an
empty result. Other libraries' files (``.model``) are encoded text by text.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table
from .pretoken import lookup, opened

LIMIT = 1024
VOCABULARY = "byte_bpe_50k.json"
TIER_WORDS = 50_000
WORD_CHARS = 32
#: Text that a task counts at once.
CHUNK_BYTES = 16 << 20
#: Words that a task's own table may hold; past it the rarer half is forgotten.
COUNTED = 300_000
FAN = 32
_COUNTS = "part long, words array<string>, counts array<long>"


def _counts_batch(part: int, counts: Counter, most: int) -> pa.RecordBatch:
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]
    names, times = zip(*top, strict=True) if top else ((), ())
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([names], pa.list_(pa.string())), pa.array([times], pa.list_(pa.int64()))], ["part", "words", "counts"])


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.ChunkedArray]:
    """The texts of several batches together, about ``most`` bytes at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch.column("text"))
        size += held[-1].nbytes
        if size >= most:
            yield pa.chunked_array(held)
            held, size = [], 0
    if held:
        yield pa.chunked_array(held)


def word_counts(batches: Iterator[pa.RecordBatch], part: int, most: int = TIER_WORDS, chunk: int = CHUNK_BYTES, held: int = COUNTED) -> pa.RecordBatch:
    """The frequent words of one task's texts: one row.

    Words that occur once in a chunk are passed over, so a count may be too low by
    one a chunk; that leaves frequent words frequent.
    """
    counts: Counter = Counter()
    for texts in _chunks(batches, chunk):
        for cut in pc.split_pattern(texts, " ").iterchunks():
            found = pc.value_counts(cut.flatten())
            found = found.filter(pc.greater(found.field("counts"), 1))
            names = found.field("values")
            found = found.filter(pc.less_equal(pc.utf8_length(names), WORD_CHARS))
            counts.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)))
        if len(counts) > held:
            counts = Counter(dict(counts.most_common(held // 2)))
    return _counts_batch(part, counts, most)


def merged_counts(group: pa.Table, fan: int, most: int = TIER_WORDS) -> pa.Table:
    total: Counter = Counter()
    for names, times in zip(group.column("words"), group.column("counts"), strict=True):
        for name, n in zip(names.as_py(), times.as_py(), strict=True):
            total[name] += n
    return pa.Table.from_batches([_counts_batch(group.column("part")[0].as_py() // fan, total, most)])


def frequent_words(ws: Workspace, docs: DataFrame, most: int = TIER_WORDS, fan: int = FAN) -> list[str]:
    """The most frequent words of all texts, at most ``most``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield word_counts(batches, TaskContext.get().partitionId(), most)

    tables = ws.write(docs.select("text").mapInArrow(count, _COUNTS), "words0")
    k = 0
    while True:
        parts = tables.agg(F.max("part")).first()[0]
        if not parts:
            break
        k += 1
        grouped = tables.groupBy(F.expr(f"part div {fan}").alias("group"))
        tables = ws.write(grouped.applyInArrow(lambda group: merged_counts(group, fan, most), _COUNTS), f"words{k}")
    rows = tables.select("words").collect()  # one row of at most `most` words
    return sorted(rows[0].words) if rows else []


@dataclass
class Tier:
    """Words in order, as one blob with their ends, and the token count of each."""

    blob: bytes
    ends: np.ndarray
    counts: np.ndarray
    name: str

    @classmethod
    def of(cls, names: list[str], path: str) -> Tier:
        code = opened(path)
        names = [w for w in names if code.exact(" " + w)]
        raw = [w.encode() for w in names]
        counts = np.array([len(code.word_ids(w)) for w in names], dtype=np.uint16)
        blob = b"".join(raw)
        return cls(blob, np.cumsum([len(r) for r in raw], dtype=np.int64).astype(np.int32), counts, hashlib.sha256(blob).hexdigest())

    def lengths(self) -> dict[str, int]:
        starts = [0, *self.ends[:-1].tolist()]
        return {self.blob[a:b].decode(): n for a, b, n in zip(starts, self.ends.tolist(), self.counts.tolist(), strict=False)}


def _piece_counts(path: str, texts: list[str]) -> list[int]:
    from sentencepiece import SentencePieceProcessor

    return [len(ids) for ids in SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``."""
    pieces = path.endswith(".model")
    names = [] if pieces else frequent_words(Workspace(docs.sparkSession, "tokens"), docs)
    shared = docs.sparkSession.sparkContext.broadcast(None if pieces else Tier.of(names, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if pieces:
                counts = _piece_counts(path, [t or "" for t in batch.column("text").to_pylist()])
            else:
                tier = shared.value
                found = lookup(path, "lengths", len, tier.name, tier.lengths)
                counts = [found.of(t.as_py() or "", sum) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
