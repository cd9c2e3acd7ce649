"""Keyed combinators: one row per key, one value per key, or none.

The rule throughout is to abstain: a key with more than one distinct value has
no value, and is reported as a conflict instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def argmax_dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "max") -> DataFrame:
    """One row per key: the one with the greatest (or least) ``order`` tuple.

    An aggregate with a partial step before the shuffle, not a window, so a hot
    key costs one row per task. All columns are kept.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    whole = F.struct(*order, *rest)
    best = F.max(whole) if keep == "max" else F.min(whole)
    found = df.groupBy(*keys).agg(best.alias("_best"))
    return found.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in [*order, *rest])).select(*df.columns)


def unanimous(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: ``resolved``, the value where it is the only one, else null; ``conflict``, whether there are several; ``n``, the rows."""
    low, high = F.min(value), F.max(value)
    return df.groupBy(*keys).agg(F.when(low == high, low).alias("resolved"), F.coalesce(low != high, F.lit(False)).alias("conflict"), F.count(F.lit(1)).alias("n"))


def conflicts(df: DataFrame, keys: Sequence[str], value: str, mark: str = "|") -> DataFrame:
    """Keys with several values, and those values in order as one text."""
    distinct = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("_v"))
    return distinct.filter(F.size("_v") > 1).select(*keys, F.array_join("_v", mark).alias("conflicting"))


def keep_last_if_unanimous(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Keys with one value keep their last row by ``order``; others keep all rows."""
    seen = df.groupBy(*keys).agg((F.min(value) == F.max(value)).alias("_one"), F.max(order).alias("_last"))
    return df.join(seen, list(keys)).filter(~F.coalesce("_one", F.lit(False)) | (F.col(order) == F.col("_last"))).select(*df.columns)


def first_hit(df: DataFrame, layers: Sequence[tuple[str, DataFrame, Sequence[str], str]], out: str) -> DataFrame:
    """Look up through layers; the first with any hit decides, and a conflict in it stops the search.

    Each layer is (name, table, key columns, value column). Adds ``out`` and
    ``basis`` (the deciding layer, with ``:conflict`` where it abstains).
    """
    for k, (_, lookup, keys, value) in enumerate(layers):
        facts = unanimous(lookup, keys, value).select(*keys, F.struct("resolved", "conflict").alias(f"_l{k}"))
        df = df.join(facts, list(keys), "left")
    result, basis = F.lit(None), F.lit(None).cast("string")
    for k, (name, _, _, _) in reversed(list(enumerate(layers))):
        hit = F.col(f"_l{k}").isNotNull()
        result = F.when(hit, F.col(f"_l{k}.resolved")).otherwise(result)
        basis = F.when(hit & F.col(f"_l{k}.conflict"), F.lit(f"{name}:conflict")).when(hit, F.lit(name)).otherwise(basis)
    return df.withColumn(out, result).withColumn("basis", basis).drop(*(f"_l{k}" for k in range(len(layers))))


def resolve_by_priority(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates (priority, mode, length, reading) to one reading or a conflict.

    The highest priority counts; if any of those is exact, only the exact ones of
    the greatest length do. One distinct reading resolves, several conflict. The
    three steps are one aggregate each on ever fewer rows.
    """
    top = candidates.groupBy(*keys).agg(F.max("priority").alias("_p"), F.count(F.lit(1)).alias("n_candidates"))
    kept = candidates.join(top, list(keys)).filter("priority = _p")
    longest = kept.groupBy(*keys).agg(F.max(F.when(F.col("mode") == "exact", F.col("length"))).alias("_len"))
    kept = kept.join(longest, list(keys)).filter("_len IS NULL OR (mode = 'exact' AND length = _len)")
    found = kept.groupBy(*keys, "n_candidates").agg(F.array_sort(F.collect_set("reading")).alias("_r"))
    return found.select(*keys, "n_candidates", F.when(F.size("_r") == 1, F.get("_r", F.lit(0))).alias("reading"), F.when(F.size("_r") > 1, F.array_join("_r", "|")).alias("conflicting"))


def promote_if_all_equal(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys of which every row has the value, and the same one."""
    seen = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("_have"), F.min(value).alias("promoted"), F.max(value).alias("_high"))
    return seen.filter("n = _have AND promoted = _high").select(*keys, "n", "promoted")


def rollup(df: DataFrame, keys: Sequence[str], value: str, order: str, most: int) -> DataFrame:
    """Per key: rows, distinct values, and the first ``most`` of them by first ``order``.

    Ranks distinct values per key, so a key's memory is bounded by ``most``.
    """
    firsts = df.groupBy(*keys, value).agg(F.min(order).alias("_o"), F.count(F.lit(1)).alias("_n"))
    ranked = firsts.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_o", value)))
    few = F.when(F.col("_r") <= most, F.struct("_r", F.col(value).cast("string").alias("_v")))
    found = ranked.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.array_sort(F.collect_list(few)).alias("_few"))
    return found.select(*keys, "n", "n_distinct", F.array_join(F.transform("_few", lambda x: x["_v"]), ",").alias("firsts"))


def collision_ids(df: DataFrame, base: str, order: Sequence[str], out: str) -> DataFrame:
    """Unique ids: the first row of a base id keeps it, later ones hash it with their rank."""
    rank = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn("_k", rank).withColumn(out, F.when(F.col("_k") == 1, F.col(base)).otherwise(F.sha2(F.concat_ws("|", base, F.col("_k").cast("string")), 256))).drop("_k")


def first_differing_pair(df: DataFrame, keys: Sequence[str], member: str, axes: Sequence[str]) -> DataFrame:
    """Per key the least pair of members that differ on every axis; a null differs from nothing.

    No pairs are made of a key's rows: they go through one pass in order of the
    member, streamed from a sort that spills. Most keys are settled by their first
    member, if only one row has it: the first later row that differs from it on every
    axis makes the least pair, found for a whole batch at once. Where none does so, the rows go
    one by one, and of those seen only what can still be a least partner is held
    (:class:`FirstAvoiding`), whatever a key's size: at most 326 for five axes.
    """
    names = [f"_x{i}" for i in range(len(axes))]
    kinds = dict(df.dtypes)
    plain = ("string", "tinyint", "smallint", "int", "bigint", "boolean", "date", "timestamp", "binary")
    told = {a: F.col(a) if kinds[a] in plain else F.col(a).cast("string") for a in axes}  # as text NaN equals itself and -0 isn't 0
    rows = df.select(*keys, member, *(told[a].alias(n) for a, n in zip(axes, names, strict=True))).dropna(subset=[*keys, member, *names])
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, member, *names).select(*keys, member, *names)
    columns = [*keys, "first_id", "second_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, best = None, None, None
        settled = False  # whether no later row of the key can better its pair
        for batch in batches:
            n, out = batch.num_rows, []
            if not n:
                continue
            starts = _starts(batch, keys)
            ends = np.append(starts[1:], n)
            lead = np.repeat(starts, ends - starts)
            away = _differs(batch, [member], lead)
            for name in names:
                away &= _differs(batch, [name], lead)
            hits = np.flatnonzero(away)
            nth = np.searchsorted(hits, starts)
            for start, end, hit in zip(starts.tolist(), ends.tolist(), np.append(hits, n)[nth].tolist(), strict=True):
                key = tuple(batch.column(k)[start].as_py() for k in keys)
                if key != at:
                    if best is not None:
                        out.append((*at, *best))
                    at, tree, best, settled = key, None, None, False
                    own = batch.column(len(keys))
                    if hit < end and own[start] != own[start + 1]:
                        best, settled = (own[start].as_py(), own[hit].as_py()), True
                if settled:
                    continue
                tree = tree or FirstAvoiding()
                for row in zip(*(batch.column(c).slice(start, end - start).to_pylist() for c in range(len(keys), batch.num_columns)), strict=True):
                    own, values = row[0], row[1:]
                    partner = tree.first(values)
                    if partner is not None and partner != own and (best is None or partner < best[0]):
                        best = (partner, own)
                    tree.add(own, values)
            yield _told(out)
        if best is not None:
            yield _told([(*at, *best)])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"first_id {kinds[member]}", f"second_id {kinds[member]}"])
    types = to_arrow_schema(df.select(*keys, F.col(member).alias("first_id"), F.col(member).alias("second_id")).schema)
    _told = lambda out: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], types.field(k).type) for k in range(len(columns))], columns)
    return dealt.mapInArrow(run, schema)


def _differs(batch: pa.RecordBatch, columns: Sequence[str], other: np.ndarray) -> np.ndarray:
    """Whether each row differs from the row at ``other`` on some of the columns, none of them null."""
    found = np.zeros(batch.num_rows, bool)
    for c in columns:
        column = batch.column(c)
        found |= pc.not_equal(column, column.take(pa.array(other))).to_numpy(zero_copy_only=False)
    return found


def _starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """The first row of each run of equal keys."""
    before = np.maximum(np.arange(batch.num_rows) - 1, 0)
    found = _differs(batch, keys, before)
    found[0] = True
    return np.flatnonzero(found)


class FirstAvoiding:
    """The first row added whose values differ from given ones on every axis.

    A tree of rows: the root is the first row of all; below a row there is, for
    each axis not used above it, the first later row with another value there. A
    search that meets its own value on an axis goes on below that axis, where no
    row has that value any more, so each axis is passed at most once.
    """

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, member: object, values: tuple) -> None:
        fresh = lambda axes: [member, values, dict.fromkeys(axes)]
        if self.root is None:
            self.root = fresh(range(len(values)))
            return
        waiting = [self.root]
        while waiting:
            _, held, below = waiting.pop()
            for axis, node in below.items():
                if values[axis] == held[axis]:
                    continue
                if node is None:
                    below[axis] = fresh(a for a in below if a != axis)
                else:
                    waiting.append(node)

    def first(self, values: tuple) -> object | None:
        node = self.root
        while node is not None:
            member, held, below = node
            clash = next((axis for axis in below if held[axis] == values[axis]), None)
            if clash is None:
                return member
            node = below[clash]
        return None


def reuse(sources: list[tuple[str, DataFrame]], keys: Sequence[str], value: str, quarantined: DataFrame) -> DataFrame:
    """Readings that independent sources agree on; any disagreement or quarantine gives none.

    ``sources`` are named, strongest first; ``basis`` is the strongest that knows
    the key. Gives every key that any source knows.
    """
    every = None
    for rank, (name, table) in enumerate(sources):
        rows = table.select(*keys, F.col(value).alias("_v"), F.lit(rank).alias("_rank"), F.lit(name).alias("_name"))
        every = rows if every is None else every.unionByName(rows)
    facts = every.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.min(F.struct("_rank", "_name")).alias("_b"))
    facts = facts.join(quarantined.select(*keys, F.lit(True).alias("_q")).distinct(), list(keys), "left")
    status = F.when(F.col("_q"), "quarantined").when(F.col("_lo") != F.col("_hi"), "conflict").otherwise("agreed")
    return facts.select(*keys, F.when(status == "agreed", F.col("_lo")).alias(value), F.when(status == "agreed", F.col("_b._name")).alias("basis"), status.alias("status"))


def swap_if(current: DataFrame, updates: DataFrame, key: str, revision: str) -> tuple[DataFrame, DataFrame]:
    """Compare and swap by revision: the new table, and the updates refused.

    An update names the revision it saw as ``expected``; it holds only if that is
    still the row's, and then the revision goes up by one. Two updates of one key
    are both refused, since neither can be first.
    """
    once = updates.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    judged = updates.join(once, key).join(current.select(key, F.col(revision).alias("_now")), key, "left")
    fits = F.coalesce((F.col("_n") == 1) & (F.col("_now") == F.col("expected")), F.lit(False))
    held, refused = judged.filter(fits), judged.filter(~fits).select(*updates.columns)
    changed = [c for c in updates.columns if c not in (key, "expected")]
    fresh = held.select(key, *(F.col(c).alias(f"_u_{c}") for c in changed), F.lit(True).alias("_hit"))
    merged = current.join(fresh, key, "left")
    columns = {c: F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)) for c in changed}
    columns[revision] = F.when(F.col("_hit"), F.col(revision) + 1).otherwise(F.col(revision))
    return merged.withColumns(columns).select(*current.columns), refused
