"""The ledger: both lanes per occurrence, its state, its checks, its gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import reconcile

# States, gates and the moves between states.
NON_TERMINAL = ("ACTUAL_UNRESOLVED", "ACTUAL_DECODE_ERROR", "EXPECTED_UNRESOLVED", "EXPECTED_AMBIGUOUS", "RULE_CONFLICT", "REVIEW_PENDING", "DIFFERENCE_PENDING_CONFIRMATION", "REGRESSION_BLOCKED", "SOURCE_INVALID", "DATA_INTEGRITY_ERROR")
TERMINAL = ("PASS", "TEXTBOOK_ERROR_CONFIRMED", "EXCLUDED_NONINDEPENDENT_LAYER", "EXCLUDED_OUT_OF_SCOPE")
EXCLUDED = ("EXCLUDED_NONINDEPENDENT_LAYER", "EXCLUDED_OUT_OF_SCOPE")
BLOCKING = ("SOURCE_INVALID", "DATA_INTEGRITY_ERROR", "REGRESSION_BLOCKED")
COMPARABLE = ("PASS", "TEXTBOOK_ERROR_CONFIRMED")
CONFIRMATIONS = ("actual_current_evidence", "expected_current_evidence", "actual_expected_independent", "context_position_verified", "source_priority_verified", "human_confirmation")
MOVES = {
    "EXPECTED_UNRESOLVED": ("PASS", "DIFFERENCE_PENDING_CONFIRMATION", "EXCLUDED_OUT_OF_SCOPE"),
    "EXPECTED_AMBIGUOUS": ("PASS", "DIFFERENCE_PENDING_CONFIRMATION", "EXCLUDED_OUT_OF_SCOPE"),
    "REVIEW_PENDING": ("PASS", "DIFFERENCE_PENDING_CONFIRMATION", "EXCLUDED_OUT_OF_SCOPE"),
    "DIFFERENCE_PENDING_CONFIRMATION": ("TEXTBOOK_ERROR_CONFIRMED", "REVIEW_PENDING", "EXCLUDED_OUT_OF_SCOPE"),
    "ACTUAL_UNRESOLVED": ("EXCLUDED_OUT_OF_SCOPE",),
    "ACTUAL_DECODE_ERROR": ("EXCLUDED_OUT_OF_SCOPE",),
    "RULE_CONFLICT": ("EXCLUDED_OUT_OF_SCOPE",),
    "REGRESSION_BLOCKED": ("PASS", "DIFFERENCE_PENDING_CONFIRMATION", "REVIEW_PENDING"),
}
STATES = NON_TERMINAL + TERMINAL
IDENTITY = ("physical_page", "stable_key", "font", "font_xref", "glyph_id", "zhuyin_component_id", "char", "x0", "y0", "x1", "y1")


def with_identity(rows: DataFrame) -> DataFrame:
    """Adds ``occurrence_id, review_id, identity_confidence``.

    The id hashes twelve fields of place and glyph; the source row number takes
    part only where nothing else tells rows apart, and the row is then marked.
    Of rows that cannot be told apart the first keeps the plain id.
    """
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    number = lambda c: F.coalesce(scalars.canonical_number(F.expr(f"try_cast(`{c}` AS decimal(38,6))")), text(c))
    fields = {c: number(c) if c in ("x0", "y0", "x1", "y1") else text(c) for c in IDENTITY}
    fields["pdf_sha256"] = F.lower(text("pdf_sha256"))
    plain = scalars.occurrence_id(**fields)
    marked = scalars.occurrence_id(**fields, fallback_source_row_number=F.col("source_row_number").cast("string"))
    nothing = (fields["pdf_sha256"] == "") | (F.concat(*(fields[c] for c in IDENTITY)) == "")
    rank = F.row_number().over(Window.partitionBy("_base").orderBy("source_row_number"))
    rows = rows.withColumn("_plain", plain).withColumn("_marked", marked).withColumn("_none", nothing)
    rows = rows.withColumn("_base", F.when(F.col("_none"), F.col("_marked")).otherwise(F.col("_plain"))).withColumn("_rank", rank)
    fallback = F.col("_none") | (F.col("_rank") > 1)
    rows = rows.withColumn("occurrence_id", F.when(fallback, F.col("_marked")).otherwise(F.col("_plain")))
    rows = rows.withColumn("identity_confidence", F.when(fallback, "FALLBACK_SOURCE_ROW").otherwise("PDF_STABLE"))
    rows = rows.withColumn("identity_collision_base", F.when(F.col("_rank") > 1, F.col("_base")))
    return rows.withColumn("review_id", scalars.review_id(F.col("occurrence_id"))).drop("_plain", "_marked", "_none", "_base", "_rank")


def actual_status() -> Column:
    given = F.upper(F.coalesce("actual_status", F.lit("")))
    state = F.coalesce("state", F.lit(""))
    seen = (F.coalesce("actual", F.lit("")) != "") & (F.coalesce("actual_evidence", F.lit("")) != "")
    return F.when(given.isin("RESOLVED", "UNRESOLVED", "DECODE_ERROR", "EXCLUDED"), given).when(state.isin(*EXCLUDED), "EXCLUDED").when(state == "ACTUAL_DECODE_ERROR", "DECODE_ERROR").when(state == "ACTUAL_UNRESOLVED", "UNRESOLVED").when(seen, "RESOLVED").otherwise("UNRESOLVED")


def expected_status() -> Column:
    given = F.upper(F.coalesce("expected_status", F.lit("")))
    state = F.coalesce("state", F.lit(""))
    known = (F.coalesce("expected_set", F.lit("")) != "") & (F.coalesce("expected_evidence", F.lit("")) != "")
    named = F.when(state.isin(*EXCLUDED), "EXCLUDED").when(state == "RULE_CONFLICT", "CONFLICT").when(state == "EXPECTED_AMBIGUOUS", "AMBIGUOUS").when(state == "EXPECTED_UNRESOLVED", "UNRESOLVED").when(known, "RESOLVED").otherwise("UNRESOLVED")
    return F.when(given.isin("RESOLVED", "UNRESOLVED", "AMBIGUOUS", "CONFLICT", "EXCLUDED"), given).otherwise(named)


def comparison(actual: Column | None = None, expected: Column | None = None) -> Column:
    """MATCH or MISMATCH where both lanes are resolved, else empty.

    The lanes' statuses may be given as columns, so that plans stay small.
    """
    actual = actual_status() if actual is None else actual
    expected = expected_status() if expected is None else expected
    both = (actual == "RESOLVED") & (expected == "RESOLVED") & (F.coalesce("actual", F.lit("")) != "") & (F.coalesce("expected_set", F.lit("")) != "")
    return F.when(both, F.when(F.array_contains(F.split("expected_set", r"\|"), F.col("actual")), "MATCH").otherwise("MISMATCH")).otherwise("")


def derived_state(actual: Column, expected: Column, compared: Column, preserve_confirmed: bool = True) -> Column:
    """The state that both lanes give: exclusion, block, actual, expected, comparison."""
    state, excluded, blocking = (F.coalesce(c, F.lit("")) for c in ("state", "exclusion_state", "blocking_state"))
    confirmed = F.lit(False)
    if preserve_confirmed:
        confirmed = state == "TEXTBOOK_ERROR_CONFIRMED"
        for g in CONFIRMATIONS:
            confirmed = confirmed & F.coalesce(F.element_at("confirmation_gates", g), F.lit(False))
    return (
        F.when(excluded.isin(*EXCLUDED), excluded)
        .when(state.isin(*EXCLUDED), state)
        .when(blocking.isin(*BLOCKING), blocking)
        .when(state.isin(*BLOCKING), state)
        .when(actual == "DECODE_ERROR", "ACTUAL_DECODE_ERROR")
        .when(actual == "UNRESOLVED", "ACTUAL_UNRESOLVED")
        .when(expected == "CONFLICT", "RULE_CONFLICT")
        .when(expected == "AMBIGUOUS", "EXPECTED_AMBIGUOUS")
        .when(expected == "UNRESOLVED", "EXPECTED_UNRESOLVED")
        .when(compared == "MATCH", "PASS")
        .when((compared == "MISMATCH") & confirmed, "TEXTBOOK_ERROR_CONFIRMED")
        .when(compared == "MISMATCH", "DIFFERENCE_PENDING_CONFIRMATION")
        .otherwise("REVIEW_PENDING")
    )


def build(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Joins the lanes: every actual row stays; without an expected row its integrity is broken.

    ``actual`` needs the columns of :func:`with_identity` and ``actual,
    actual_evidence``; ``expected`` has ``occurrence_id, expected_set,
    expected_status, basis``.
    """
    lane = expected.select("occurrence_id", "expected_set", "expected_status", F.col("basis").alias("expected_evidence"), F.lit(True).alias("_has"))
    rows = actual.join(lane, "occurrence_id", "left")
    blank = {"actual_status": "string", "state": "string", "exclusion_state": "string", "confirmation_gates": "map<string,boolean>"}
    for name, kind in blank.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumn("blocking_state", F.when(F.col("_has").isNull(), "DATA_INTEGRITY_ERROR")).drop("_has")
    return refreshed(rows)


def refreshed(rows: DataFrame, preserve_confirmed: bool = True) -> DataFrame:
    """All derived columns anew, from the lanes as they are."""
    rows = with_state(rows, preserve_confirmed)
    rows = rows.withColumns({"state": F.col("_s"), "comparison_result": F.col("_c"), "actual_status": F.col("_a"), "expected_status": F.col("_e")})
    return rows.withColumn("active_review", F.col("state").isin(*NON_TERMINAL)).drop("_s", "_c", "_a", "_e")


def with_state(rows: DataFrame, preserve_confirmed: bool = True) -> DataFrame:
    """Adds the derived ``_a, _e`` (statuses), ``_c`` (comparison) and ``_s`` (state), step by step."""
    rows = rows.withColumns({"_a": actual_status(), "_e": expected_status()})
    rows = rows.withColumn("_c", comparison(F.col("_a"), F.col("_e")))
    return rows.withColumn("_s", derived_state(F.col("_a"), F.col("_e"), F.col("_c"), preserve_confirmed))


def violations(ledger: DataFrame) -> DataFrame:
    """Rows that a sound ledger has none of: ``occurrence_id, violation``."""
    gates = F.lit(True)
    for g in CONFIRMATIONS:
        gates = gates & F.coalesce(F.element_at("confirmation_gates", g), F.lit(False))
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    ended = F.col("state").isin("PASS", "TEXTBOOK_ERROR_CONFIRMED")
    checks = {
        "unknown_state": ~F.col("state").isin(*STATES),
        "state_not_derived": F.col("state") != F.col("_s"),
        "active_review": F.col("active_review") != F.col("state").isin(*NON_TERMINAL),
        "terminal_without_evidence": ended & (missing("actual") | missing("actual_evidence") | missing("expected_set") | missing("expected_evidence")),
        "pass_without_match": (F.col("state") == "PASS") & (F.col("comparison_result") != "MATCH"),
        "error_without_mismatch": (F.col("state") == "TEXTBOOK_ERROR_CONFIRMED") & ((F.col("comparison_result") != "MISMATCH") | ~gates),
        "resolved_without_evidence": (F.col("expected_status") == "RESOLVED") & (missing("expected_set") | missing("expected_evidence")),
    }
    named = F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()))
    rows = with_state(ledger).select("occurrence_id", F.explode(F.filter(named, lambda v: v.isNotNull())).alias("violation"))
    twice = [ledger.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("occurrence_id").alias("occurrence_id")).filter("n > 1").select("occurrence_id", F.lit(f"repeated_{c}").alias("violation")) for c in ("occurrence_id", "review_id")]
    return rows.unionByName(twice[0]).unionByName(twice[1])


def allowed_moves(spark) -> DataFrame:
    """Every allowed (from, to): staying, breaking, and the listed ones."""
    pairs = {(s, t) for s in STATES for t in (s, "DATA_INTEGRITY_ERROR", "SOURCE_INVALID")} | {(s, t) for s, ts in MOVES.items() for t in ts}
    return spark.createDataFrame(sorted(pairs), "before string, after string")


def state_counts(ledger: DataFrame) -> DataFrame:
    roster = ledger.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return reconcile.zero_filled(ledger, roster, ["state"])


def completion(ledger: DataFrame, source_ids: DataFrame, regressions: DataFrame, source_ok: bool = True, fatal: str = "") -> DataFrame:
    """One row: fifteen gates, those that failed, coverage of both lanes, status.

    ``regressions``: one row per case with ``result`` (PASS, FAIL, NOT_EXECUTED).
    """
    inside = ~F.col("state").isin(*EXCLUDED)
    n = lambda c: F.count_if(c)
    resolved = inside & (F.col("expected_status") == "RESOLVED") & (F.coalesce("expected_set", F.lit("")) != "") & (F.coalesce("expected_evidence", F.lit("")) != "")
    lane = lambda c, v: inside & (F.col(c) == v)
    facts = ledger.agg(
        n(inside).alias("in_scope"), n(lane("actual_status", "RESOLVED")).alias("actual_covered"), n(resolved).alias("expected_covered"), n(F.col("state").isin(*NON_TERMINAL)).alias("pending"),
        n(lane("actual_status", "DECODE_ERROR") | lane("actual_status", "UNRESOLVED")).alias("undecoded"), n(lane("expected_status", "UNRESOLVED")).alias("unresolved"), n(lane("expected_status", "AMBIGUOUS")).alias("ambiguous"),
        n(lane("expected_status", "CONFLICT")).alias("conflicts"), n(F.col("state") == "DATA_INTEGRITY_ERROR").alias("broken"), n(F.col("state") == "SOURCE_INVALID").alias("invalid"), n(F.col("state").isin(*COMPARABLE)).alias("comparable"),
    )
    sides = reconcile.reconcile(source_ids.select("occurrence_id"), ledger.select("occurrence_id"), "occurrence_id").agg(n((F.col("side") != "both") | (F.col("n_left") != 1) | (F.col("n_right") != 1)).alias("drift"))
    ran = regressions.agg(F.count(F.lit(1)).alias("required"), n(F.col("result") == "PASS").alias("passed"))
    one = facts.join(sides, F.lit(True)).join(ran, F.lit(True))  # three single rows
    c = F.col
    gates = {
        "source_validation": F.lit(source_ok), "runtime_fatal_error_zero": F.lit(not fatal), "ledger_reconciliation": c("drift") == 0, "in_scope_occurrence_count_positive": c("in_scope") > 0,
        "actual_coverage_100": (c("in_scope") > 0) & (c("actual_covered") == c("in_scope")), "expected_coverage_100": (c("in_scope") > 0) & (c("expected_covered") == c("in_scope")), "pending_zero": c("pending") == 0,
        "decode_error_zero": c("undecoded") == 0, "expected_unresolved_zero": c("unresolved") == 0, "expected_ambiguous_zero": c("ambiguous") == 0, "rule_conflict_zero": c("conflicts") == 0,
        "data_integrity_error_zero": c("broken") == 0, "source_invalid_zero": c("invalid") == 0, "regression_gate": (c("required") > 0) & (c("passed") == c("required")), "all_in_scope_terminal": c("comparable") == c("in_scope"),
    }
    failed = F.array_join(F.filter(F.array(*(F.when(~g, F.lit(k)) for k, g in gates.items())), lambda x: x.isNotNull()), ",")
    blocked = F.lit(not source_ok or bool(fatal)) | (c("drift") > 0) | (c("broken") > 0) | (c("invalid") > 0)
    share = lambda part: F.coalesce(F.try_divide(c(part).cast("double"), c("in_scope").cast("double")), F.lit(0.0))
    row = one.select(failed.alias("failed_gates"), blocked.alias("_b"), "in_scope", share("actual_covered").alias("actual_coverage"), share("expected_covered").alias("expected_coverage"))
    status = F.when(c("_b"), "PIPELINE_BLOCKED").when(c("failed_gates") == "", "PROOFREAD_COMPLETE").otherwise("PROCESSING_FINISHED")
    return row.withColumn("status", status).drop("_b")
