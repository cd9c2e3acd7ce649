"""Ordered operators: neighbours, dependence on the next row, overlaps, similarity."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .components import cut

#: Pairs of places up to which two texts are compared as one matrix.
MATRIX_CELLS = 8 << 20


def neighbourhood(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, radius: int, out: str) -> DataFrame:
    """Values of the rows around each row, joined, with the row's own offset among them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    parts = [F.lag(value, d).over(w) for d in range(radius, 0, -1)] + [value] + [F.lead(value, d).over(w) for d in range(1, radius + 1)]
    offset = F.least(F.row_number().over(w) - 1, F.lit(radius))
    return df.withColumn(out, F.concat_ws("", *parts)).withColumn(f"{out}_offset", offset)


def first_appearance(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Values ranked by where they first occur within their key."""
    firsts = df.groupBy(*keys, value).agg(F.min(order).alias("first_at"))
    return firsts.withColumn("appearance", F.row_number().over(Window.partitionBy(*keys).orderBy("first_at", value)))


def sentence_at(text: Column, position: Column, stops: str) -> Column:
    """The stretch between the last stop before ``position`` (from 1) and the first from it on."""
    before = F.regexp_extract(F.substring(text, F.lit(1), position - 1), rf"[^{stops}]*\z", 0)
    after = F.regexp_extract(F.substring(text, position, F.length(text)), rf"\A[^{stops}]*", 0)
    return F.concat(before, after)


def overlap_groups(df: DataFrame, keys: Sequence[str], low: str, high: str, tie: str, out: str) -> DataFrame:
    """Connected components of overlapping intervals, named by their first interval's ``tie``.

    Sorted by start, a component ends where a start lies beyond every end so far.
    """
    order = Window.partitionBy(*keys).orderBy(low, tie)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("_new", F.when(reach.isNull() | (F.col(low) > reach), F.col(tie)))
    return opened.withColumn(out, F.last("_new", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def matched(a: str, b: str, cells: int = MATRIX_CELLS) -> int:
    """How many characters the matching blocks of two texts hold.

    The longest common run, first in ``a`` and then in ``b`` of equals, and so on to
    both of its sides. The length of the run that ends at each pair of places is
    worked out once as a matrix; inside a part of it a run can't be longer than the
    way to the part's edge. Texts too long for a matrix are left to difflib, which
    finds the same blocks.
    """
    if len(a) * len(b) > cells or max(len(a), len(b)) > 32_000:
        return sum(size for _, _, size in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    runs, way = np.zeros((len(x) + 1, len(y) + 1), np.int16), np.arange(1, max(len(x), len(y)) + 1, dtype=np.int16)
    for i, same in enumerate(x[:, None] == y):
        np.multiply(runs[i, :-1] + 1, same, out=runs[i + 1, 1:])
    runs = runs[1:, 1:]
    total, parts = 0, [(0, len(x), 0, len(y))]
    while parts:
        a0, a1, b0, b1 = parts.pop()
        if a0 == a1 or b0 == b1:
            continue
        part = runs[a0:a1, b0:b1]
        if a0:
            part = np.minimum(part, way[: a1 - a0, None])
        if b0:
            part = np.minimum(part, way[: b1 - b0])
        at = int(part.argmax())
        i, j = divmod(at, b1 - b0)
        size = int(part[i, j])
        if size:
            total += size
            parts += [(a0, a0 + i + 1 - size, b0, b0 + j + 1 - size), (a0 + i + 1, a1, b0 + j + 1, b1)]
    return total


def matched_short(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As :func:`matched` for each row of two tables of characters, short texts of one length a side."""
    (rows, n), m = x.shape, y.shape[1]
    runs, same = np.zeros((rows, n + 1, m + 1), np.int8), x[:, :, None] == y[:, None, :]
    for i in range(n):
        runs[:, i + 1, 1:] = (runs[:, i, :-1] + 1) * same[:, i]
    runs, total = runs[:, 1:, 1:], np.zeros(rows, np.int64)
    parts = np.stack([np.arange(rows), *(np.full(rows, v) for v in (0, n, 0, m))])
    while parts.shape[1]:
        row, a0, a1, b0, b1 = parts
        ways = []
        for low, high, size in ((a0, a1, n), (b0, b1, m)):
            at = np.arange(size)[None]
            ways.append(np.where(at < high[:, None], np.maximum(at - low[:, None] + 1, 0), 0).astype(np.int8))
        part = np.minimum(np.minimum(runs[row], ways[0][:, :, None]), ways[1][:, None, :]).reshape(len(row), -1)
        at = part.argmax(axis=1)
        size = part[np.arange(len(row)), at].astype(np.int64)
        np.add.at(total, row, size)
        i, j = at // m + 1, at % m + 1
        parts = np.concatenate([np.stack([row, a0, i - size, b0, j - size])[:, size > 0], np.stack([row, i, a1, j, b1])[:, size > 0]], axis=1)
        parts = parts[:, (parts[1] < parts[2]) & (parts[3] < parts[4])]
    return total


def ratio(a: str | None, b: str | None) -> float:
    """Longest-matching-block similarity of two texts; two empty ones are alike."""
    a, b = a or "", b or ""
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def scored_pairs(pairs: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """``pairs`` with the similarity of two texts in their place.

    Each pair is worked out once, row by row in the task's one Python worker: a filter on
    the result of a scalar function works it out again, in a second worker beside it.
    """
    names = [c for c in pairs.columns if c not in (left, right)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column(left), batch.column(right), strict=True)
            scores = pa.array([ratio(a.as_py(), b.as_py()) for a, b in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), scores], [*names, out])

    return pairs.mapInArrow(run, StructType([*pairs.select(*names).schema.fields, StructField(out, DoubleType())]))


def opcodes(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Edit steps from ``left`` to ``right`` by words: kind, ranges and the words themselves."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, a, b in zip(frame[key], frame[left], frame[right], strict=True):
                x, y = (a or "").split(), (b or "").split()
                steps = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
                rows += [(k, n, kind, i, j, p, q) for n, (kind, i, j, p, q) in enumerate(steps) if kind != "equal"]
            yield pd.DataFrame(rows, columns=["key", "step", "kind", "left_from", "left_to", "right_from", "right_to"])

    return pairs.select(key, left, right).mapInPandas(run, "key long, step int, kind string, left_from int, left_to int, right_from int, right_to int")


#: Rounds of mutually best pairs before few enough leftovers are taken in their order by one task.
GREEDY_ROUNDS = 12
GREEDY_LEFT = 100_000


def greedy(scored: DataFrame, keys: Sequence[str], left: str, right: str, better: Sequence[Column], rounds: int = GREEDY_ROUNDS) -> DataFrame:
    """The pairs that taking the best first would choose, each side used once; ``scored``'s columns.

    ``better`` orders pairs, larger first; with both sides after it no two are equal. A pair
    that is the best of both its sides is in the sequential choice, whatever else is; each
    round takes all of those at once and drops what they use. Ties in a row can make
    rounds as long as the row: after ``rounds`` of them up to ``GREEDY_LEFT`` leftover
    pairs are taken in order in one sorted pass, more of them in further rounds.
    """
    keys, names = list(keys), scored.columns
    rest = cut(scored.withColumn("_o", F.struct(*better, left, right)).select(*names, "_o"))
    taken, n = None, 0
    while not rest.isEmpty():
        if n >= rounds and rest.limit(GREEDY_LEFT + 1).count() <= GREEDY_LEFT:
            last = _in_order(rest, keys, left, right).select(*names)
            return last if taken is None else taken.select(*names).unionByName(last)
        by_left = rest.groupBy(*keys, left).agg(F.max("_o").alias("_o"))
        by_right = rest.groupBy(*keys, right).agg(F.max("_o").alias("_o"))
        mutual = by_left.select(*keys, left, f"_o.{right}").join(by_right.select(*keys, f"_o.{left}", right), [*keys, left, right])
        chosen = cut(rest.join(mutual, [*keys, left, right], "left_semi"))
        taken = chosen if taken is None else taken.unionByName(chosen)
        for side in (left, right):
            rest = rest.join(chosen.select(*keys, side), [*keys, side], "left_anti")
        rest, n = cut(rest), n + 1
    return (rest if taken is None else taken).select(*names)


def _in_order(rest: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Few pairs, best first, in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: tuple[set, set] = set(), set()
        for frame in frames:
            own = [*zip(*(frame[k] for k in keys), strict=True)] if keys else [()] * len(frame)
            marks = []
            for key, a, b in zip(own, frame[left], frame[right], strict=True):
                free = (key, a) not in used[0] and (key, b) not in used[1]
                if free:
                    used[0].add((key, a))
                    used[1].add((key, b))
                marks.append(free)
            yield frame[marks]

    flat = rest.orderBy(F.desc("_o")).drop("_o").coalesce(1)
    return flat.mapInPandas(run, flat.schema)


def greedy_pairs(scored: DataFrame, group: str, left: str, right: str, score: str, least: float) -> DataFrame:
    """One-to-one pairs per group, best score first, ties by left and right."""
    rows = scored.filter(F.col(score) >= least).select(F.col(group).alias("grp"), F.col(left).alias("left_id"), F.col(right).alias("right_id"), F.col(score).alias("score"))
    return greedy(rows, ["grp"], "left_id", "right_id", [F.col("score"), -F.col("left_id"), -F.col("right_id")])
