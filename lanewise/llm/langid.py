"""Language identification: averaged hashed subword embeddings, linear softmax.

A text's features are its letters' byte n-grams (``ORDERS``), lower-cased, with
words bounded by one space; each is hashed to one of ``2**BITS`` rows of an
embedding table, the rows are averaged, and a linear softmax gives the language.
Training is plain stochastic gradient descent in numpy on the driver, over at
most ``SAMPLE`` labelled documents of at most ``SAMPLE_BYTES`` each, chosen by the
smallest hashes of their ids.
A part of the sample is kept out of training to fit one temperature and the
rejection threshold: a text is rejected if its calibrated probability is below
the threshold, or if it has no letters.

The model is linear, so prediction needs only the product of both tables: one
row of class scores per bucket. It has a fixed size and is broadcast; every
whole text is scored where it is read, with no shuffle.

Cases: null texts, and texts without a letter, are ``und`` with score 0 and are
rejected; a null label is not trained on; a null doc_id is scored, never trained on, and
neither held out nor not (null); repeated rows are scored each; with no
labelled rows at all every text is ``und``; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, whole_row, with_row, worker_cache

UNKNOWN = "und"
ORDERS = (2, 3, 4)
BITS = 16
WIDTH = 16
SAMPLE = 4_000
SAMPLE_BYTES = 32_768
EPOCHS = 6
BATCH = 16
RATE = 2.0
CALIBRATION = 5
#: Share of the calibration part's right answers that the threshold may reject.
REJECTED = 0.001
CEILING = 0.5
SEED = 11

_SCORE_SPAN = 1 << 18


def _byte_table() -> np.ndarray:
    """Bytes to features: A-Z lower-cased, letters kept, all else a space."""
    t = np.full(256, 32, np.uint8)
    t[128:] = np.arange(128, 256)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    return t


_BYTES = _byte_table()


def has_letter(text: str) -> bool:
    """Whether any character is a letter by its Unicode category."""
    return any(map(str.isalpha, text))


def letters(text: str) -> np.ndarray:
    """The normalised bytes of a text: words of letters with one space around each."""
    raw = _BYTES[np.frombuffer(text.lower().encode("utf-8") if not text.isascii() else text.encode(), np.uint8)]
    raw = np.concatenate([[32], raw, [32]]).astype(np.uint8)
    return raw[~((raw == 32) & np.concatenate([[False], raw[:-1] == 32]))]


def features(raw: np.ndarray, bits: int = BITS) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of each order."""
    wide = raw.astype(np.uint64)
    code = wide
    for n in range(2, max(ORDERS) + 1):
        if len(wide) < n:
            return
        code = code[:-1] * np.uint64(257) + wide[n - 1 :]
        if n in ORDERS:
            yield (((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    found = [*features(letters(text), bits)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    total = np.bincount(np.concatenate(found), minlength=1 << bits)
    at = np.flatnonzero(total)
    return at, total[at].astype(np.float64)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (buckets, languages): what one n-gram adds
    bias: np.ndarray
    temperature: float
    threshold: float
    bits: int = BITS

    def logits(self, text: str) -> np.ndarray | None:
        """Class scores of a whole text, None if it has no letters."""
        if not has_letter(text):
            return None
        raw = letters(text)
        total, n = np.zeros(len(self.languages)), 0
        longest = max(ORDERS) - 1
        for at in range(0, max(1, len(raw) - longest), _SCORE_SPAN):
            part = raw[at : at + _SCORE_SPAN + longest]
            for order, bucket in zip(ORDERS, features(part, self.bits), strict=False):
                # spans overlap by the longest order; an n-gram belongs to the span it starts in
                if at + _SCORE_SPAN + longest < len(raw):
                    bucket = bucket[: _SCORE_SPAN]
                n += len(bucket)
                for c in range(len(self.languages)):
                    total[c] += self.scores[c][bucket].sum(dtype=np.float64)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether to reject it."""
        logits = self.logits(text) if text and self.languages else None
        if logits is None:
            return UNKNOWN, 0.0, True
        p = softmax(logits / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], bits: int = BITS) -> Model:
    """Fit on (text, language) rows; every ``CALIBRATION``-th one is for calibration."""
    rows = [r for r in rows if has_letter(r[0])]
    names = sorted({lang for _, lang in rows})
    if not names:
        return Model([], np.zeros((0, 1 << bits), np.float32), np.zeros(0), 1.0, 0.0, bits)
    rng = np.random.default_rng(SEED)
    embed = rng.normal(0, 0.1, (1 << bits, WIDTH))
    out, bias = rng.normal(0, 0.1, (WIDTH, len(names))), np.zeros(len(names))
    data = [(*counts(text, bits), names.index(lang)) for text, lang in rows]
    data = [(b, c / c.sum(), y) for b, c, y in data if len(b)]
    held = data[::CALIBRATION]
    learnt = [d for k, d in enumerate(data) if k % CALIBRATION] or data
    weight = 1.0 / np.maximum(1, np.bincount([y for _, _, y in learnt], minlength=len(names)))
    weight *= len(learnt) / len(names)
    steps, step = EPOCHS * -(-len(learnt) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(learnt))
        for at in range(0, len(order), BATCH):
            group = [learnt[k] for k in order[at : at + BATCH]]
            mean = np.stack([c @ embed[b] for b, c, _ in group])
            p = softmax(mean @ out + bias)
            y = np.array([k for _, _, k in group])
            p[np.arange(len(y)), y] -= 1
            p *= weight[y][:, None] / len(y)
            rate = RATE * (1 - step / steps)
            back = p @ out.T
            out -= rate * (mean.T @ p)
            bias -= rate * p.sum(axis=0)
            for (b, c, _), g in zip(group, back, strict=True):
                embed[b] -= (rate * len(b) ** 0.5) * (c[:, None] * g[None, :])
            step += 1
    model = Model(names, np.ascontiguousarray((embed @ out).T.astype(np.float32)), bias, 1.0, 0.0, bits)
    return calibrate(model, held)


def calibrate(model: Model, held: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Temperature by likelihood on held rows; the threshold keeps their right answers."""
    if not held:
        return model
    logits = np.stack([model.scores[:, b] @ c + model.bias for b, c, _ in held])
    y = np.array([k for _, _, k in held])
    grid = np.geomspace(0.05, 20, 61)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-300)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / model.temperature)
    right = p.argmax(axis=1) == y
    if right.any():
        model.threshold = float(min(CEILING, np.quantile(p.max(axis=1)[right], REJECTED)))
    return model


def held_out(doc_id: Column) -> Column:
    """Documents that are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def sample(docs: DataFrame, most: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``most`` labelled documents that aren't held out, by hashed id."""
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= SAMPLE_BYTES))
    ids = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = labelled.join(F.broadcast(ids.distinct()), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x"))
    rows = chosen.select(F.xxhash64("doc_id").alias("h"), "x.text", "x.lang").collect()  # at most `most`, each of bounded size
    return [(r.text, r.lang) for r in sorted(rows)]


def predictions(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """Every row of ``docs`` as ``row``, a struct of ``columns``, with ``lang_pred, score, rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    rows = docs.select(whole_row(columns), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("langid")
        fitted = shared.value
        for batch in batches:
            found = [fitted.predict(text.as_py()) for text in batch.column("text")]
            lang, score, no = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(no, pa.bool_())], ["row", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, with_row(rows, "lang_pred string, score double, rejected boolean"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predictions(docs, train(sample(docs)), ["doc_id"])
    doc_id = F.col("row.doc_id")
    return found.select(doc_id.cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score", "rejected")
