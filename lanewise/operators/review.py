"""Reviews: reusable rules, events on a baseline, groups, queues, learnt truth."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import keyed, ledger
from .components import connected, cut


def reusable_readings(occ: DataFrame, rules: DataFrame) -> DataFrame:
    """The best reusable rule per occurrence: one with context, then the longer context; a tie of readings abstains.

    ``rules``: ``rule_id, phrase, target_char, target_index, expected_set,
    context_contains, enabled``; the phrase must stand so that its target is the
    occurrence's place.
    """
    hits = occ.join(rules.filter("enabled"), occ["char"] == rules["target_char"])
    start = F.col("pos") - F.col("target_index")
    context = F.coalesce("context_contains", F.lit(""))
    placed = (start >= 0) & (F.substring(F.col("line"), start + 1, F.length("phrase")) == F.col("phrase"))
    hits = hits.filter(placed & ((context == "") | F.contains(F.col("line"), context)))
    rank = (F.when(context != "", 1_000_000).otherwise(0) + F.length(context)).cast("int")
    candidates = hits.select("occurrence_id", rank.alias("priority"), F.lit("derived").alias("mode"), F.lit(0).alias("length"), F.col("expected_set").alias("reading"))
    return keyed.resolve_by_priority(candidates, ["occurrence_id"]).select("occurrence_id", "reading", "conflicting")


def last_events(events: DataFrame) -> DataFrame:
    """The event in force per review: the last by sequence."""
    rest = F.struct(*(c for c in events.columns if c != "review_id"))
    return events.groupBy("review_id").agg(F.max_by(rest, "seq").alias("_e")).select("review_id", "_e.*")


def unknown_events(baseline: DataFrame, events: DataFrame) -> DataFrame:
    """Events of reviews that the ledger doesn't have; a sound log has none."""
    return events.join(baseline.select("review_id").distinct(), "review_id", "left_anti")


def replay(baseline: DataFrame, events: DataFrame) -> DataFrame:
    """The ledger after its events, always from the baseline, so replays agree.

    ``events``: ``review_id, seq, action, expected_set, evidence, target_snapshot,
    actual_snapshot, gates``; ``baseline`` has ``target_snapshot`` and
    ``actual_snapshot`` beside the ledger's columns. Actions: keep, supply and
    resolve (set the expected lane), confirm (a difference, bound to both
    snapshots), exclude. An event on a changed target is kept but has no effect.
    Events of unknown reviews raise when the ledger is read.
    """
    lost = unknown_events(baseline, events).agg(F.count(F.lit(1)).alias("_lost"), F.min("review_id").alias("_example"))
    failed = F.raise_error(F.concat(F.lit("events of unknown reviews, such as "), F.col("_example")))
    checked = lost.select(F.when(F.col("_lost") > 0, failed).otherwise(F.lit(0)).alias("_checked"))  # one row
    e = last_events(events).select("review_id", *(F.col(c).alias(f"e_{c}") for c in ("action", "expected_set", "evidence", "target_snapshot", "actual_snapshot", "gates")))
    rows = baseline.join(e, "review_id", "left").join(F.broadcast(checked), F.col("_checked") == 0).drop("_checked")
    action, target = F.col("e_action"), F.col("e_target_snapshot") == F.col("target_snapshot")
    excluded = F.col("state").isin(*ledger.EXCLUDED)
    status = (
        F.when(action.isNull(), "NONE")
        .when(excluded & action.isin("supply", "resolve"), "EXPECTED_EVENT_DORMANT_EXCLUDED")
        .when(~F.coalesce(target, F.lit(False)), "INVALIDATED_TARGET_DRIFT")
        .when((action == "confirm") & ~F.coalesce(F.col("e_actual_snapshot") == F.col("actual_snapshot"), F.lit(False)), "INVALIDATED_ACTUAL_DRIFT")
        .otherwise("APPLIED")
    )
    rows = rows.withColumn("event_status", status)
    on = F.col("event_status") == "APPLIED"
    setting = on & action.isin("supply", "resolve")
    rows = rows.withColumns(
        {
            "expected_set": F.when(setting, F.col("e_expected_set")).otherwise(F.col("expected_set")),
            "expected_evidence": F.when(setting, F.col("e_evidence")).otherwise(F.col("expected_evidence")),
            "expected_status": F.when(setting, "RESOLVED").otherwise(F.col("expected_status")),
            "exclusion_state": F.when(on & (action == "exclude"), "EXCLUDED_OUT_OF_SCOPE").otherwise(F.col("exclusion_state")),
            "confirmation_gates": F.when(on & (action == "confirm"), F.col("e_gates")).otherwise(F.col("confirmation_gates")),
            "state": F.when(on & (action == "confirm"), "TEXTBOOK_ERROR_CONFIRMED").otherwise(F.when(setting | (on & (action == "exclude")), F.lit(None)).otherwise(F.col("state"))),
        }
    )
    return ledger.refreshed(rows).drop(*(c for c in rows.columns if c.startswith("e_")))


def changed_only(baseline: DataFrame, current: DataFrame, events: DataFrame, touched: DataFrame) -> DataFrame:
    """The ledger with only the touched reviews replayed; equal to a full replay."""
    fresh = replay(baseline.join(touched, "review_id", "left_semi"), events.join(touched, "review_id", "left_semi"))
    return current.join(touched, "review_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def groups(rows: DataFrame, identity: list[str]) -> DataFrame:
    """Review groups with a pending member: ids, members in order, a snapshot hash."""
    member = F.struct("pdf_sha256", "page", "y0", "x0", "occurrence_id", "actual", "state")
    found = rows.groupBy(*identity).agg(F.max("active_review").alias("_p"), F.array_sort(F.collect_list(member)).alias("members")).filter("_p")
    ids = F.concat(F.lit("agr_"), F.substring(F.sha2(F.to_json(F.struct(*sorted(identity))), 256), 1, 24))
    return found.select(ids.alias("group_id"), *identity, F.size("members").alias("n"), "members", F.sha2(F.to_json("members"), 256).alias("snapshot"))


def queue(rows: DataFrame, lane: str) -> DataFrame:
    """Review order as ``place``: lane, first appearance of the character, file, page, row, position, id.

    Ranked inside each lane; lanes themselves are few and ordered by name. Rows are dealt
    by ranges of lane and order, each range is ranked by itself, and the counts of the
    ranges before it are added, so a lane is as many tasks as it needs.
    """
    order = ["_f", "char", "pdf_order", "page", "source_row_number", "y0", "x0", "occurrence_id"]
    firsts = rows.groupBy("char").agg(F.min(F.struct("pdf_order", "page", "source_row_number")).alias("_f"))
    pending = rows.filter("active_review").join(firsts, "char")
    dealt = cut(pending.repartitionByRange(lane, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(lane, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(lane).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    bases = counts.select(F.col(lane).alias("_lane"), F.col("_range").alias("_r"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(lane, "_range").orderBy(*order))
    placed = dealt.withColumn("_in", inside).join(bases, F.col(lane).eqNullSafe(F.col("_lane")) & (F.col("_range") == F.col("_r")))
    return placed.withColumn("place", (F.col("_before") + F.col("_in")).cast("int")).drop("_f", "_range", "_in", "_lane", "_r", "_before")


def learnt_truth(evidence: DataFrame) -> DataFrame:
    """Per glyph: one example is single, two or more verified, a contradiction quarantines it without a reading."""
    found = keyed.unanimous(evidence, ["glyph_sha"], "reading")
    truth = F.when(F.col("conflict"), "QUARANTINED").when(F.col("n") >= 2, "VERIFIED").otherwise("SINGLE")
    return found.select("glyph_sha", F.col("resolved").alias("reading"), "n", truth.alias("truth"))


AXES = ["project_id", "pdf_sha256", "font_sha256", "occurrence_id", "decision_sha256"]


def library_states(evidence: DataFrame, approvals: DataFrame) -> DataFrame:
    """States of library glyphs: candidate, ready at an independent pair, verified once approved, quarantined on conflict.

    ``evidence``: ``glyph_id, evidence_id, reading`` and the five axes on which an
    independent pair must differ.
    """
    agreed = keyed.unanimous(evidence, ["glyph_id"], "reading")
    pairs = keyed.first_differing_pair(evidence, ["glyph_id"], "evidence_id", AXES)
    rows = agreed.join(pairs, "glyph_id", "left").join(approvals.select("glyph_id", F.lit(True).alias("_ok")).distinct(), "glyph_id", "left")
    state = F.when(F.col("conflict"), "QUARANTINED_CONFLICT").when(F.col("first_id").isNotNull() & F.col("_ok"), "VERIFIED_GLOBAL").when(F.col("first_id").isNotNull(), "PROMOTION_READY").otherwise("CANDIDATE")
    return rows.select("glyph_id", F.col("resolved").alias("reading"), "first_id", "second_id", state.alias("state"))


def _most_distinct(sources: list[tuple]) -> int:
    """The largest set of sources that differ pairwise on every axis, by exact search.

    A source whose rivals all share one axis with it is taken: they exclude each other
    anyway. Parts without rivals between them are counted apart, and sets met again are
    looked up. Otherwise the source with most rivals is taken or left; leaving it is tried
    only where the fewest values of an axis allow more.
    """
    axes = range(len(sources[0])) if sources else ()
    values: list[dict] = [{} for _ in axes]
    for k, s in enumerate(sources):
        for a in axes:
            values[a][s[a]] = values[a].get(s[a], 0) | 1 << k
    shares = [[values[a][s[a]] for a in axes] for s in sources]
    rivals = [functools.reduce(operator.or_, shares[k]) & ~(1 << k) for k in range(len(sources))]
    known: dict[int, int] = {0: 0}

    def members(mask: int) -> Iterator[int]:
        while mask:
            low = mask & -mask
            yield low.bit_length() - 1
            mask ^= low

    def part(mask: int) -> int:
        reached = front = mask & -mask
        while front:
            front = functools.reduce(operator.or_, (rivals[k] for k in members(front))) & mask & ~reached
            reached |= front
        return reached

    def most(mask: int) -> int:
        if mask not in known:
            known[mask] = _count(mask)
        return known[mask]

    def _count(mask: int) -> int:
        taken, simple = 0, True
        while simple:
            simple = False
            for k in members(mask):
                near = rivals[k] & mask
                if mask >> k & 1 and any(near & ~own == 0 for own in shares[k]):
                    mask &= ~(near | 1 << k)
                    taken, simple = taken + 1, True
        if not mask:
            return taken
        one = part(mask)
        if one != mask:
            return taken + most(one) + most(mask & ~one)
        k = max(members(mask), key=lambda i: (rivals[i] & mask).bit_count())
        best = 1 + most(mask & ~(rivals[k] | 1 << k))
        rest = mask & ~(1 << k)
        if best < min(sum(1 for v in values[a].values() if v & rest) for a in axes):
            best = max(best, most(rest))
        return taken + best

    return most((1 << len(sources)) - 1)


def independent_sources(evidence: DataFrame) -> DataFrame:
    """``glyph_id, independent``: how many sources of a glyph differ pairwise in project, file and font.

    Only evidence that ``counts_toward_global_quorum`` is counted, where that column is there.
    Glyphs of up to ``FEW_ROWS`` rows are searched where their rows meet. For larger ones,
    before anything is searched, sources that can stand for others are told by counts
    alone: a source whose other two values nothing else has can replace every source
    it shares the third with. What is left falls into parts without common values; each part
    is searched by itself, exactly, and their numbers add up.
    """
    axes = ["project_id", "pdf_sha256", "font_sha256"]
    counted = evidence.filter("counts_toward_global_quorum = 1") if "counts_toward_global_quorum" in evidence.columns else evidence
    told = counted.select("glyph_id", *(F.coalesce(F.col(a), F.lit("")).alias(a) for a in axes))
    large = cut(told.groupBy("glyph_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FEW_ROWS).select("glyph_id"))
    some = not large.isEmpty()
    few = (told.join(large, "glyph_id", "left_anti") if some else told).groupBy("glyph_id").agg(F.array_sort(F.collect_set(F.struct(*axes))).alias("s"))
    each = few.select("glyph_id", _searched("s").alias("n"))
    if some:
        each = each.unionByName(_of_large(cut(told.join(large, "glyph_id", "left_semi").distinct()), axes))
    return evidence.select("glyph_id").distinct().join(each, "glyph_id", "left").na.fill(0, ["n"]).select("glyph_id", F.col("n").cast("int").alias("independent"))


#: Rows up to which a glyph is searched as a whole, in the row that holds its sources.
FEW_ROWS = 64


@F.arrow_udf(LongType())
def _searched(sources: pa.Array) -> pa.Array:
    """How many of each row's sources differ pairwise on every axis; like patterns of equal values are searched once."""
    known: dict[tuple, int] = {}
    out = []
    for row in sources.to_pylist():
        numbers: list[dict] = [{} for _ in row[0]] if row else []
        pattern = tuple(tuple(n.setdefault(v, len(n)) for n, v in zip(numbers, s.values(), strict=True)) for s in row)
        if pattern not in known:
            known[pattern] = _most_distinct(list(pattern))
        out.append(known[pattern])
    return pa.array(out, pa.int64())


def _of_large(sources: DataFrame, axes: list[str]) -> DataFrame:
    """``glyph_id, n`` of glyphs of any size, over tables of their distinct sources."""
    alone, rest = None, sources
    while not rest.isEmpty():
        marked = rest
        for a in axes:
            held = rest.groupBy("glyph_id", a).agg(F.count(F.lit(1)).alias(f"n_{a}"))
            marked = marked.join(held, ["glyph_id", a])
        lone = [F.col(f"n_{a}") == 1 for a in axes]
        free = F.when(lone[1] & lone[2], 0).when(lone[0] & lone[2], 1).when(lone[0] & lone[1], 2)
        marked = cut(marked.withColumn("free", free))
        # of the sources that stand for one value's sources, the first is taken, and the value with it
        takers = cut(functools.reduce(DataFrame.unionByName, (marked.filter(f"free = {k}").groupBy("glyph_id", a).agg(F.min(F.struct(*axes)).alias("s")).select("glyph_id", "s.*") for k, a in enumerate(axes))))
        if takers.isEmpty():
            break
        alone = takers if alone is None else alone.unionByName(takers)
        for a in axes:
            rest = rest.join(takers.select("glyph_id", a), ["glyph_id", a], "left_anti")
        rest = cut(rest)
    numbered = cut(rest.withColumn("id", F.monotonically_increasing_id()))
    links = functools.reduce(DataFrame.unionByName, (numbered.join(numbered.groupBy("glyph_id", a).agg(F.min("id").alias("first")), ["glyph_id", a]).select("glyph_id", "id", "first") for a in axes))
    parts = connected(links, ["glyph_id"], "id", "first")
    grouped = numbered.join(parts.withColumnRenamed("node", "id"), ["glyph_id", "id"], "left").withColumn("root", F.coalesce("root", "id"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        found = _most_distinct(sorted(frame[axes].itertuples(index=False, name=None)))
        return pd.DataFrame([(frame["glyph_id"].iloc[0], found)], columns=["glyph_id", "n"])

    each = grouped.groupBy("glyph_id", "root").applyInPandas(search, "glyph_id string, n long")
    if alone is not None:
        each = each.unionByName(alone.groupBy("glyph_id").agg(F.count(F.lit(1)).alias("n")))
    return each.groupBy("glyph_id").agg(F.sum("n").alias("n"))
