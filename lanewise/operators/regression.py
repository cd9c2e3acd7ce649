"""Regression cases: whether they apply, where they stand, how they end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def applicability(cases: DataFrame, pdf_sha256: str, stem: str) -> DataFrame:
    """Adds ``applies`` and ``why``: hard gates bind to one file's hash, portable ones to its name, references never count."""
    named = (F.coalesce("pdf_contains", F.lit("")) == "") | F.contains(F.lit(stem), F.col("pdf_contains"))
    bound = F.lower(F.coalesce("source_pdf_sha256", F.lit(""))) == pdf_sha256.lower()
    why = (
        F.when(F.col("applicability_mode") == "reference_only", "REFERENCE_ONLY")
        .when(~named, "OTHER_FILE")
        .when((F.col("applicability_mode") == "hard_gate") & ~bound, "OTHER_EDITION")
        .when(F.col("applicability_mode").isin("hard_gate", "portable_gate"), "APPLIES")
        .otherwise("UNKNOWN_MODE")
    )
    return cases.withColumn("why", why).withColumn("applies", F.col("why") == "APPLIES")


def located(cases: DataFrame, occ: DataFrame) -> DataFrame:
    """Case and occurrence pairs: the case's phrase covers the target at its place, page and context fit.

    A case's target is the n-th occurrence (from 1) of its character in the phrase.
    """
    place = F.expr("get(filter(sequence(0, length(phrase) - 1), i -> substring(phrase, i + 1, 1) = target_char), target_occurrence_index - 1)")
    wanted = cases.filter("applies").withColumn("_at", place).filter("_at IS NOT NULL")
    hits = wanted.join(occ, wanted["target_char"] == occ["char"])
    start = F.col("pos") - F.col("_at")
    fits = (start >= 0) & (F.substring(F.col("line"), start + 1, F.length("phrase")) == F.col("phrase"))
    page = (F.col("applicability_mode") == "portable_gate") | (F.coalesce("page", F.lit("")) == "") | (F.col("page") == F.col("printed_page"))
    context = (F.coalesce("locator_context", F.lit("")) == "") | F.contains(F.col("line"), F.col("locator_context"))
    return hits.filter(fits & page & context).select("case_id", "occurrence_id", F.col("actual").alias("found_actual"), F.col("expected_set").alias("found_expected"))


def execute(cases: DataFrame, occ: DataFrame) -> DataFrame:
    """One result per case: PASS, FAIL, NOT_EXECUTED (no place or several) or NOT_APPLICABLE."""
    hits = located(cases, occ).groupBy("case_id").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("found_actual", "found_expected")).alias("_h"))
    rows = cases.join(hits, "case_id", "left")
    right = (F.col("_h.found_actual") == F.col("actual_reading")) & F.array_contains(F.split(F.col("_h.found_expected"), r"\|"), F.col("expected_reading"))
    result = F.when(~F.col("applies"), "NOT_APPLICABLE").when(F.coalesce("places", F.lit(0)) != 1, "NOT_EXECUTED").when(F.coalesce(right, F.lit(False)), "PASS").otherwise("FAIL")
    return rows.select("case_id", "why", F.coalesce("places", F.lit(0)).alias("places"), result.alias("result"))


def roll_up(results: DataFrame) -> DataFrame:
    """Results over several files: one per case; several executions fail, drifting definitions are an error."""
    ran = F.col("result").isin("PASS", "FAIL")
    found = results.groupBy("case_id").agg(F.count_if(ran).alias("executed"), F.count_if(F.col("result") == "FAIL").alias("failed"), F.count_if(F.col("result") == "NOT_EXECUTED").alias("missed"), F.count_distinct("definition_sha").alias("_d"))
    result = F.when(F.col("_d") > 1, "DEFINITION_DRIFT").when(F.col("executed") > 1, "FAIL").when(F.col("failed") > 0, "FAIL").when(F.col("executed") == 1, "PASS").when(F.col("missed") > 0, "NOT_EXECUTED").otherwise("NOT_APPLICABLE")
    return found.select("case_id", "executed", result.alias("result"))


def execution_report(required: DataFrame, results: DataFrame) -> DataFrame:
    """One row of counts: required, executed, missing, unexpected, repeated, failed, and whether all is well."""
    seen = results.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("result") == "FAIL").alias("f"))
    rows = required.select("case_id", F.lit(True).alias("_r")).distinct().join(seen, "case_id", "full")
    need, have = F.col("_r").isNotNull(), F.col("n").isNotNull()
    counts = rows.agg(F.count_if(need).alias("required"), F.count_if(need & have).alias("executed"), F.count_if(need & ~have).alias("missing"), F.count_if(~need).alias("unexpected"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum("f"), F.lit(0)).alias("failed"))
    return counts.withColumn("ok", (F.col("required") > 0) & (F.col("missing") + F.col("unexpected") + F.col("repeated") + F.col("failed") == 0))


def mandatory_result(resolved: DataFrame, cases: DataFrame) -> DataFrame:
    """Mandatory cases, run as occurrences through the expected lane, against what they demand."""
    rows = cases.join(resolved.select(F.col("occurrence_id").alias("case_id"), F.col("expected_set").alias("got_set"), F.col("expected_status").alias("got_status")), "case_id", "left")
    wanted = F.array_sort(F.split(F.coalesce("expected_set", F.lit("")), r"\|"))
    same = F.array_sort(F.split(F.coalesce("got_set", F.lit("")), r"\|")) == wanted
    good = F.when(F.col("expected_resolution") == "ANY", F.lit(True)).otherwise((F.col("got_status") == F.col("expected_resolution")) & same)
    return rows.select("case_id", "got_status", "got_set", F.when(F.coalesce(good, F.lit(False)), "PASS").otherwise("FAIL").alias("result"))
