"""What a decision was made on: snapshots, bindings, imports, and their fate when things change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from . import ledger

# What snapshots of each kind cover, and the versions they name.
SESSION, REVIEW = "5.2", "2.5.0"
EXPECTED_FIELDS = ("occurrence_id", "review_id", "expected_set", "expected_evidence", "context_evidence")
FULL_FIELDS = (*EXPECTED_FIELDS, "state", "actual", "actual_evidence")
TARGET_FIELDS = ("occurrence_id", "review_id", "pdf_name", "physical_page", "printed_page", "char", "line", "local_context")
# Actions that need the target alone, and those that do nothing.
EXPECTED_ACTIONS = ("supply", "resolve")
NO_ACTIONS = ("", "keep")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def snapshot(fields: Sequence[str]) -> Column:
    """SHA-256 of named fields as JSON in alphabetical order, with the versions of the session and the ids."""
    parts = {f: _text(f) for f in fields} | {"session_schema_version": F.lit(SESSION), "review_id_schema_version": F.lit(REVIEW)}
    return F.sha2(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts)))), 256)


def with_snapshots(rows: DataFrame) -> DataFrame:
    """Adds ``full_snapshot`` (both lanes and the state), ``expected_snapshot`` (that lane alone) and
    ``target_snapshot`` (the printed place and its context, without anything resolved)."""
    return rows.withColumns({"full_snapshot": snapshot(FULL_FIELDS), "expected_snapshot": snapshot(EXPECTED_FIELDS), "target_snapshot": snapshot(TARGET_FIELDS)})


def semantic_key(*parts: Column) -> Column:
    """SHA-1 of the parts of a context, punctuation and white space levelled, as a JSON list."""
    return F.sha1(F.to_json(F.array(*(scalars.context_key(p.cast("string")) for p in parts))))


def needs_expected_review() -> Column:
    """Whether a row belongs to those who judge the expected reading."""
    blocked = F.col("state").isin(*ledger.BLOCKING, *ledger.EXCLUDED)
    open_ = F.col("expected_status").isin("UNRESOLVED", "AMBIGUOUS", "CONFLICT")
    return ~blocked & (open_ | F.col("state").isin("DIFFERENCE_PENDING_CONFIRMATION", "REVIEW_PENDING"))


def confirm_blocked() -> Column:
    """Why the observed reading can't be confirmed as expected; empty if it can.

    Needs ``state, blocking_state, redecidable, occurrence_id, review_id, char,
    pdf_sha256, physical_page, x0, y0, x1, y1, actual, actual_status, actual_evidence``.
    """
    hard = F.col("state").isin(*ledger.BLOCKING) | F.coalesce("blocking_state", F.lit("")).isin(*ledger.BLOCKING)
    pending = F.col("state").isin(*ledger.NON_TERMINAL) | (F.col("state").isin("PASS", "TEXTBOOK_ERROR_CONFIRMED") & F.coalesce("redecidable", F.lit(False)))
    named = (_text("occurrence_id") != "") & (_text("char") != "") & (F.col("review_id") == scalars.review_id(F.col("occurrence_id"))) & _text("pdf_sha256").rlike("^[0-9a-f]{64}$")
    number = lambda c: F.col(c).cast("string").try_cast("double")
    page, box = number("physical_page"), [number(c) for c in ("x0", "y0", "x1", "y1")]
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300)
    placed = finite(page) & (page == F.floor(page)) & (page >= 1) & (box[0] <= box[2]) & (box[1] < box[3])
    for c in box:
        placed = placed & finite(c)
    seen = (F.col("actual_status") == "RESOLVED") & (_text("actual") != "") & (F.trim(_text("actual_evidence")) != "")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(F.coalesce(hard, F.lit(False)), "source_blocked").when(no(pending), "not_pending").when(no(named), "identity_incomplete").when(no(placed), "place_invalid").when(no(seen), "actual_unresolved").otherwise("")


def matches(rows: DataFrame, statuses: Sequence[str], words: Sequence[str], status: str = "state", fields: Sequence[str] = ("occurrence_id",)) -> DataFrame:
    """Rows in one of the states (any, if none is given) that hold every word in one of the fields, in any case."""
    text = F.lower(F.concat_ws(" ", *fields))
    keep = F.col(status).isin(*statuses) if statuses else F.lit(True)
    for w in words:
        keep = keep & F.contains(text, F.lit(w.lower()))
    return rows.filter(keep)


def judged_bindings(rows: DataFrame, bindings: DataFrame, session: str, fingerprint: str) -> DataFrame:
    """Expected decisions and whether they still bind: ``review_id, binding``.

    ``bindings``: ``review_id, session_id, fingerprint, target_snapshot,
    baseline_snapshot, resolution, event_resolution, seal``; the seal is the
    SHA-256 of the other parts. MALFORMED has no valid seal or another resolution
    than its event; STALE was made in another session, on other assets, on another
    target or on another baseline; BOUND holds.
    """
    parts = F.struct(*(F.col(c) for c in sorted(("session_id", "fingerprint", "target_snapshot", "baseline_snapshot", "resolution"))))
    sealed = (F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256) == F.col("seal")) & F.col("resolution").eqNullSafe(F.col("event_resolution"))
    now = rows.select("review_id", F.col("target_snapshot").alias("_t"), F.col("baseline_snapshot").alias("_b"))
    fresh = (F.col("session_id") == session) & (F.col("fingerprint") == fingerprint) & (F.col("_t") == F.col("target_snapshot")) & (F.col("_b") == F.col("baseline_snapshot"))
    state = F.when(~F.coalesce(sealed, F.lit(False)), "MALFORMED").when(F.coalesce(fresh, F.lit(False)), "BOUND").otherwise("STALE")
    return bindings.join(now, "review_id", "left").select("review_id", state.alias("binding"))


def sealed(bindings: DataFrame) -> DataFrame:
    """Adds the ``seal`` of each binding."""
    parts = F.struct(*(F.col(c) for c in sorted(("session_id", "fingerprint", "target_snapshot", "baseline_snapshot", "resolution"))))
    return bindings.withColumn("seal", F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256))


def revoked(events: DataFrame, changed: DataFrame) -> DataFrame:
    """Events after the observed reading of the ``changed`` reviews has changed.

    A confirmed difference rests on it: it falls back to the expected evidence that
    it holds, if that is complete, and goes otherwise. Other events stay.
    """
    rows = events.join(changed.select("review_id").distinct().withColumn("_hit", F.lit(True)), "review_id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("action") == "confirm")
    complete = (_text("expected_set") != "") & (F.trim(_text("evidence")) != "") & (F.trim(_text("context_evidence")) != "")
    kept = rows.filter(~hit | complete)
    fallen = F.coalesce("_hit", F.lit(False)) & (F.col("action") == "confirm")
    return kept.withColumn("gates", F.when(fallen, F.lit(None)).otherwise(F.col("gates"))).withColumn("action", F.when(fallen, "resolve").otherwise(F.col("action"))).drop("_hit")


def import_decisions(rows: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A batch of decisions, all or none: those to take, and the errors.

    ``rows``: ``row_no, review_id, action, state, full_snapshot, target_snapshot,
    expected_set``; ``entries`` are the ledger's with the same snapshots. Rows without
    an action are passed over. An expected-only action needs its target unchanged,
    any other the state and the full snapshot as well. One error refuses the batch.
    """
    asked = rows.filter(~F.coalesce("action", F.lit("")).isin(*NO_ACTIONS))
    now = entries.select("review_id", F.col("state").alias("_state"), F.col("full_snapshot").alias("_full"), F.col("target_snapshot").alias("_target"))
    twice = asked.groupBy("review_id").agg(F.count(F.lit(1)).alias("_times"))
    judged = asked.join(now, "review_id", "left").join(twice, "review_id")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    setting = F.col("action").isin(*EXPECTED_ACTIONS)
    error = (
        F.when(F.col("_state").isNull(), "unknown_review")
        .when(F.col("_times") > 1, "repeated_review")
        .when(~F.col("action").isin(*EXPECTED_ACTIONS, "confirm", "exclude"), "unknown_action")
        .when(setting & (_text("expected_set") == ""), "no_reading")
        .when(setting & ~same("target_snapshot", "_target"), "target_changed")
        .when(~setting & ~same("state", "_state"), "state_changed")
        .when(~setting & ~same("full_snapshot", "_full"), "evidence_changed")
    )
    judged = judged.withColumn("error", error)
    errors = judged.filter("error IS NOT NULL").select("row_no", "review_id", "error")
    any_error = errors.limit(1).select(F.lit(True).alias("_refused"))  # at most one row
    taken = judged.join(F.broadcast(any_error), F.lit(True), "left").filter("_refused IS NULL").select(*rows.columns)
    return taken, errors


def staged(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A staging table after adds, removals and acknowledgements, in order of ``seq``.

    ``current``: key, ``token, payload``; ``changes``: key, ``seq, op (add, remove,
    ack), token, payload``. The last add of a key stands unless it is removed later, or
    acknowledged later with its own token.
    """
    first = current.select(key, F.lit(-1).cast("long").alias("seq"), F.lit("add").alias("op"), "token", "payload")
    every = first.unionByName(changes.select(key, F.col("seq").cast("long").alias("seq"), "op", "token", "payload"))
    added = every.filter("op = 'add'").groupBy(key).agg(F.max(F.struct("seq", "token", "payload")).alias("_a"))
    ended = every.filter("op <> 'add'").join(added, key).filter((F.col("seq") > F.col("_a.seq")) & ((F.col("op") == "remove") | (F.col("token") == F.col("_a.token"))))
    return added.join(ended.select(key).distinct(), key, "left_anti").select(key, F.col("_a.token").alias("token"), F.col("_a.payload").alias("payload"))


def open_conflicts(conflicts: DataFrame, resolutions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Conflict receipts that no resolution of the same payloads has closed."""
    return conflicts.join(resolutions.select(*keys, "payload_a", "payload_b").distinct(), [*keys, "payload_a", "payload_b"], "left_anti")


def library_faults(glyphs: DataFrame, evidence: DataFrame, approvals: DataFrame, conflicts: DataFrame) -> DataFrame:
    """What a sound library has none of: ``glyph_id, fault``.

    ``glyphs``: ``glyph_id, state, reading``; ``evidence``: ``glyph_id, evidence_id,
    reading``; ``approvals``: ``glyph_id``; ``conflicts``: ``glyph_id, open``.
    """
    facts = evidence.groupBy("glyph_id").agg(F.count(F.lit(1)).alias("n"), F.min("reading").alias("lo"), F.max("reading").alias("hi"))
    rows = glyphs.join(facts, "glyph_id", "left").join(approvals.select("glyph_id", F.lit(True).alias("ok")).distinct(), "glyph_id", "left")
    rows = rows.join(conflicts.filter("open").select("glyph_id", F.lit(True).alias("clash")).distinct(), "glyph_id", "left")
    verified, bad = F.col("state") == "VERIFIED_GLOBAL", F.col("state") == "QUARANTINED_CONFLICT"
    checks = {
        "no_evidence": F.col("n").isNull(),
        "verified_without_approval": verified & F.col("ok").isNull(),
        "verified_in_conflict": verified & F.col("clash").isNotNull(),
        "quarantined_with_reading": bad & F.col("reading").isNotNull(),
        "quarantined_without_conflict": bad & F.col("clash").isNull() & (F.col("lo") == F.col("hi")),
        "disagreement_not_quarantined": ~bad & (F.col("lo") != F.col("hi")),
        "reading_not_of_evidence": ~bad & F.col("reading").isNotNull() & (F.col("reading") != F.col("lo")) & (F.col("lo") == F.col("hi")),
    }
    named = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()))
    found = rows.select("glyph_id", F.explode(F.filter(named, lambda v: v.isNotNull())).alias("fault"))
    lost = evidence.select("glyph_id").distinct().join(glyphs, "glyph_id", "left_anti").select("glyph_id", F.lit("evidence_without_glyph").alias("fault"))
    return found.unionByName(lost)


def match_files(source: DataFrame, target: DataFrame) -> DataFrame:
    """Files of two projects that are one: ``source_file, target_file, how``.

    Both: ``file, sha256, pages array<string>`` (digests in page order). Equal bytes
    come first; what is left is matched by equal pages, where one file of each side
    has them and no other.
    """
    a, b = source.select(F.col("file").alias("source_file"), "sha256", "pages"), target.select(F.col("file").alias("target_file"), "sha256", "pages")
    same = a.join(b, "sha256").groupBy("source_file").agg(F.min("target_file").alias("target_file")).withColumn("how", F.lit("identical"))
    same = same.groupBy("target_file").agg(F.min("source_file").alias("source_file"), F.min("how").alias("how")).select("source_file", "target_file", "how")
    once = lambda df, name: df.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min(name).alias(name)).filter("n = 1").drop("n")
    digest = F.sha2(F.array_join("pages", ","), 256).alias("_p")
    left = a.join(same, "source_file", "left_anti").filter(F.size("pages") > 0).select("source_file", digest)
    right = b.join(same, "target_file", "left_anti").filter(F.size("pages") > 0).select("target_file", digest)
    alike = once(left, "source_file").join(once(right, "target_file"), "_p").select("source_file", "target_file", F.lit("equivalent").alias("how"))
    return same.unionByName(alike)


def map_rows(source: DataFrame, target: DataFrame, anchor: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Occurrences of two projects by their anchors: the one-to-one pairs, and why others have none.

    Both: ``occurrence_id`` and the anchor's columns. A mapping may be used only if
    there are no faults.
    """
    side = lambda df, name: df.groupBy(*anchor).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min("occurrence_id").alias(f"{name}_id"))
    both = side(source, "source").join(side(target, "target"), list(anchor), "full")
    fault = F.when(F.col("n_target").isNull(), "unmapped_source").when(F.col("n_source").isNull(), "unmapped_target").when((F.col("n_source") > 1) | (F.col("n_target") > 1), "ambiguous")
    both = both.withColumn("fault", fault)
    return both.filter("fault IS NULL").select("source_id", "target_id"), both.filter("fault IS NOT NULL").select(*anchor, "fault")


def bound_files(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Sealed files by digest: ``kind, path, binding`` (BOUND, MISSING or AMBIGUOUS).

    ``declared``: ``kind, sha256``; ``found``: ``path, sha256``.
    """
    n = found.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    rows = declared.join(n, "sha256", "left")
    state = F.when(F.col("n").isNull(), "MISSING").when(F.col("n") > 1, "AMBIGUOUS").otherwise("BOUND")
    return rows.select("kind", F.when(state == "BOUND", F.col("path")).alias("path"), state.alias("binding"))


def migration_plan(legacy: DataFrame, current: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Old evidence against the occurrences of now: adds ``occurrence_id`` and ``plan``.

    MAPPED meets one occurrence with its reading, CHANGED one with another,
    AMBIGUOUS several, INSUFFICIENT none or lacks a part of its identity.
    """
    now = current.groupBy(*identity).agg(F.count(F.lit(1)).alias("_n"), F.min("occurrence_id").alias("occurrence_id"), F.min("reading").alias("_r"))
    rows = legacy.join(now, list(identity), "left")
    plan = F.when(F.col("_n").isNull(), "INSUFFICIENT").when(F.col("_n") > 1, "AMBIGUOUS").when(F.col("reading") == F.col("_r"), "MAPPED").otherwise("CHANGED")
    return rows.withColumn("plan", plan).withColumn("occurrence_id", F.when(F.col("plan").isin("MAPPED", "CHANGED"), F.col("occurrence_id"))).drop("_n", "_r")


def bridged(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Readings carried over by equal glyph bytes: ``font, glyph_id, reading``.

    ``targets``: ``font, glyph_id, variant, glyph_sha``; ``sources``: ``glyph_sha,
    reading``. A hash counts if all its sources agree, a glyph if all its variants
    are known and agree.
    """
    safe = sources.groupBy("glyph_sha").agg(F.min("reading").alias("reading"), F.max("reading").alias("_hi")).filter("reading = _hi").drop("_hi")
    rows = targets.select("font", "glyph_id", "variant", "glyph_sha").distinct().join(safe, "glyph_sha", "left")
    found = rows.groupBy("font", "glyph_id").agg(F.count(F.lit(1)).alias("n"), F.count("reading").alias("k"), F.min("reading").alias("reading"), F.max("reading").alias("hi"))
    return found.filter("n = k AND reading = hi").select("font", "glyph_id", "reading")


def roster_faults(rows: DataFrame) -> DataFrame:
    """What an exact roster has none of: ``occurrence_id, fault``.

    Needs the columns of ``ledger.with_identity`` beside the ids to be proved.
    """
    proved = ledger.with_identity(rows.withColumnsRenamed({"occurrence_id": "_told", "review_id": "_told_review"}))
    checks = {
        "id_not_recomputed": ~F.col("_told").eqNullSafe(F.col("occurrence_id")),
        "review_id_not_recomputed": ~F.col("_told_review").eqNullSafe(F.col("review_id")),
        "fallback_identity": F.col("identity_confidence") != "PDF_STABLE",
        "collision": F.col("identity_collision_base").isNotNull(),
    }
    named = F.array(*(F.when(c, F.lit(n)) for n, c in checks.items()))
    return proved.select(F.col("_told").alias("occurrence_id"), F.explode(F.filter(named, lambda v: v.isNotNull())).alias("fault"))
