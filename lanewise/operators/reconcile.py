"""Set reconciliation, zero-filled counts and completion gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Where each key stands: in the left only, the right only, or both; with row counts.

    Both sides are counted per key first, so repeated keys do not multiply.
    """
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    side = F.when(F.col("n_right").isNull(), "left_only").when(F.col("n_left").isNull(), "right_only").otherwise("both")
    return a.join(b, key, "full").select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"), side.alias("side"))


def zero_filled(df: DataFrame, roster: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of every key of the roster, zero where none occurs."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return roster.join(counts, list(keys), "left").select(*roster.columns, F.coalesce("_n", F.lit(0)).alias("n"))


def gate(df: DataFrame, checks: dict[str, Column], ratio: tuple[Column, Column]) -> DataFrame:
    """One row: each check's truth over all rows, the coverage ratio, what failed, and the status."""
    held = [F.coalesce(c, F.lit(False)).alias(name) for name, c in checks.items()]
    share = F.coalesce(F.try_divide(ratio[0].cast("double"), ratio[1].cast("double")), F.lit(0.0))
    row = df.agg(*held, F.round(share, 6).alias("coverage"))
    failed = F.array_join(F.filter(F.array(*(F.when(~F.col(n), F.lit(n)) for n in checks)), lambda x: x.isNotNull()), ",")
    row = row.withColumn("failed", failed)
    status = F.when(F.col("failed") == "", "COMPLETE").when(F.col("coverage") > 0, "PARTIAL").otherwise("BLOCKED")
    return row.withColumn("status", status)


def transition_violations(moves: DataFrame, allowed: DataFrame, before: str, after: str) -> DataFrame:
    """Moves that the table of allowed ones does not list; a first move is always allowed."""
    return moves.filter(F.col(before).isNotNull()).join(allowed, [before, after], "left_anti")


def merge_decisions(ours: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """Two decision sets as one: absent here imports, equal repeats, different conflicts and has no value."""
    a, b = ours.select(key, F.col(value).alias("_a")), theirs.select(key, F.col(value).alias("_b"))
    outcome = F.when(F.col("_a").isNull(), "import").when(F.col("_b").isNull(), "keep").when(F.col("_a") == F.col("_b"), "duplicate").otherwise("conflict")
    merged = a.join(b, key, "full").withColumn("outcome", outcome)
    return merged.select(key, F.when(F.col("outcome") != "conflict", F.coalesce("_a", "_b")).alias("merged"), "outcome")


def merge_source(events: DataFrame, source: DataFrame, conflicts: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One project's decisions taken over into another's, with where each came from.

    ``events``: ``key, payload, origin, others array<string>``; ``source``: ``key, payload,
    identity``, one row a key; ``conflicts``: ``key, source_identity, target_identity,
    source_payload, target_payload`` of earlier merges. A decision that is absent is
    imported with its identity as origin. An equal one is a duplicate, and its identity joins ``others``
    unless it is known. A different one takes the decision away: both are kept in a conflict.
    What already led to a recorded conflict is a duplicate and does nothing again.
    Returns the events, all conflicts, and ``key, outcome`` of the source's rows. For
    several projects, merge one after the other.
    """
    told = conflicts.select(F.col(key).alias("_k"), F.col("source_identity").alias("_i"), F.col("source_payload").alias("_p"), F.lit(True).alias("_told")).distinct()
    again = source.join(told, (F.col(key) == F.col("_k")) & F.col("identity").eqNullSafe(F.col("_i")) & F.col("payload").eqNullSafe(F.col("_p")), "left")
    theirs = again.select(key, F.lit(True).alias("_theirs"), F.col("payload").alias("_new"), "identity", F.coalesce("_told", F.lit(False)).alias("_told"))
    rows = events.withColumn("_ours", F.lit(True)).join(theirs, key, "full")
    came = F.coalesce("_theirs", F.lit(False)) & ~F.coalesce("_told", F.lit(False))
    same = F.col("payload").eqNullSafe(F.col("_new"))
    outcome = F.when(F.col("_theirs").isNull(), "keep").when(F.col("_told"), "replayed").when(F.col("_ours").isNull(), "import").when(same, "duplicate").otherwise("conflict")
    rows = rows.withColumn("outcome", outcome)
    others = F.coalesce("others", F.array().cast("array<string>"))
    known = F.array_contains(F.array_append(others, F.coalesce("origin", F.lit(""))), F.col("identity"))
    new_event = F.col("outcome") == "import"
    kept = rows.filter("outcome <> 'conflict' AND (_ours OR outcome = 'import')").select(
        key, F.when(new_event, F.col("_new")).otherwise(F.col("payload")).alias("payload"), F.when(new_event, F.col("identity")).otherwise(F.col("origin")).alias("origin"),
        F.when((F.col("outcome") == "duplicate") & ~known, F.array_append(others, F.col("identity"))).otherwise(others).alias("others"),
    )
    clash = rows.filter("outcome = 'conflict'").select(key, F.col("identity").alias("source_identity"), F.col("origin").alias("target_identity"), F.col("_new").alias("source_payload"), F.col("payload").alias("target_payload"))
    return kept, conflicts.unionByName(clash), rows.filter(came | F.col("_told")).select(key, "outcome")


def undelivered(intents: DataFrame, receipts: DataFrame, key: str, digest: str) -> DataFrame:
    """Intents without a receipt, and those whose receipt names another payload."""
    known = receipts.select(key, F.col(digest).alias("_d"))
    state = F.when(F.col("_d").isNull(), "PENDING").when(F.col("_d") != F.col(digest), "DIGEST_MISMATCH")
    return intents.join(known, key, "left").withColumn("delivery", state).filter("delivery IS NOT NULL").drop("_d")
