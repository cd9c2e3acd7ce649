"""Both lanes end to end on a small synthetic book."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lanewise.operators import expected, ledger, reconcile

RULES = [
    ("r1", 100, "exact", "角", "角色", "ㄐㄩㄝˊ", []),
    ("r2", 50, "default", "和", "", "ㄏㄢˋ", ["天時地利人和"]),
    ("r3", 100, "exact", "和", "天時地利人和", "ㄏㄜˊ", []),
    ("r4", 100, "exact", "頭", "額頭", "ㄊㄡˊ", []),
    ("r5", 100, "exact", "頭", "額頭", "˙ㄊㄡ", []),
    ("r6", 100, "exact", "當", "當作", "ㄉㄤˋ", ["當作好"]),
    ("r7", 40, "default", "當", "", "ㄉㄤ", ["當作禮"]),
    ("r8", 90, "exact", "名", "一名", "ㄇㄧㄥˊ", []),
]
WORDS = [("轉盤", ["ㄓㄨㄢˇ", "ㄆㄢˊ"]), ("轉成", ["ㄓㄨㄢˇ", "ㄔㄥˊ"]), ("成功", ["ㄔㄥˊ", "ㄍㄨㄥ"]), ("下巴", ["ㄒㄧㄚˋ", "˙ㄅㄚ"]), ("長大", ["ㄓㄤˇ", "ㄉㄚˋ"]), ("長大成人", ["ㄓㄤˇ", "ㄉㄚˋ", "ㄔㄥˊ", "ㄖㄣˊ"])]
CHARACTERS = [("個", ["ㄍㄜˋ"]), ("角", ["ㄐㄧㄠˇ", "ㄐㄩㄝˊ"])]
SINGLES = [("天", "ㄊㄧㄢ"), ("年", "ㄋㄧㄢˊ"), ("起", "ㄑㄧˇ"), ("個", "ㄍㄜˋ"), ("是", "ㄕˋ"), ("敢", "ㄍㄢˇ"), ("看", "ㄎㄢˋ"), ("轉", "ㄓㄨㄢˇ")]

CASES = [
    ("角色", 0, "RESOLVED", "ㄐㄩㄝˊ"),
    ("媽媽", 0, "RESOLVED", "ㄇㄚ"),
    ("媽媽", 1, "RESOLVED", "˙ㄇㄚ"),
    ("額頭", 1, "CONFLICT", "˙ㄊㄡ|ㄊㄡˊ"),
    ("一天", 0, "RESOLVED", "ㄧˋ"),
    ("一年", 0, "RESOLVED", "ㄧˋ"),
    ("一起", 0, "RESOLVED", "ㄧˋ"),
    ("一個", 0, "RESOLVED", "ㄧˊ"),
    ("第一名", 1, "RESOLVED", "ㄧ"),
    ("看一看", 1, "RESOLVED", "ㄧˊ"),
    ("一龘", 0, "UNRESOLVED", ""),
    ("一", 0, "UNRESOLVED", ""),
    ("不是", 0, "RESOLVED", "ㄅㄨˊ|ㄅㄨˋ"),
    ("不敢", 0, "RESOLVED", "ㄅㄨˋ"),
    ("不龘", 0, "UNRESOLVED", ""),
    ("我和他", 1, "RESOLVED", "ㄏㄢˋ"),
    ("天時地利人和", 5, "RESOLVED", "ㄏㄜˊ"),
    ("把它當作禮物", 2, "RESOLVED", "ㄉㄤˋ"),
    ("應當作好準備", 1, "RESOLVED", "ㄉㄤ"),
    ("大轉盤", 1, "RESOLVED", "ㄓㄨㄢˇ"),
    ("下巴", 1, "RESOLVED", "˙ㄅㄚ"),
    ("他長大成人了", 1, "RESOLVED", "ㄓㄤˇ"),
    ("三個", 1, "RESOLVED", "ㄍㄜˋ|˙ㄍㄜ"),
    ("媽呀！", 1, "RESOLVED", "˙ㄧㄚ"),
    ("哎呀！", 1, "UNRESOLVED", ""),
    ("九十分", 2, "RESOLVED", "ㄈㄣ"),
    ("角︀色", 0, "RESOLVED", "ㄐㄩㄝˊ"),
    ("大︁角色", 2, "RESOLVED", "ㄐㄩㄝˊ"),
    ("", 0, "UNRESOLVED", ""),
]


@pytest.fixture(scope="module")
def assets(spark):
    rules = spark.createDataFrame(RULES, "rule_id string, priority int, mode string, target_char string, phrase string, expected_reading string, excluded_phrases array<string>")
    return rules, spark.createDataFrame(WORDS, "word string, primary array<string>"), spark.createDataFrame(SINGLES, "char string, reading string")


@pytest.fixture(scope="module")
def characters(spark):
    known = spark.createDataFrame(CHARACTERS, "char string, readings array<string>")
    return expected.constrained(known, spark.createDataFrame([], "char string, allowed array<string>"))


@pytest.fixture(scope="module")
def occurrences(spark):
    rows = [(f"o{k}", line, pos, line[pos : pos + 1]) for k, (line, pos, _, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "occurrence_id string, line string, pos int, char string")


def test_expected_lane(occurrences, assets, characters):
    got = {r.occurrence_id: r for r in expected.expected_lane(occurrences, *assets, characters=characters).collect()}
    for k, (line, pos, status, options) in enumerate(CASES):
        r = got[f"o{k}"]
        assert (r.expected_status, set(r.expected_set.split("|"))) == (status, set(options.split("|"))), (line, pos, r)


def test_word_across_the_boundary_is_refused(spark, assets):
    occ = spark.createDataFrame([("a", "轉成功", 0, "轉")], "occurrence_id string, line string, pos int, char string")
    rows = expected.dictionary_reading(occ, assets[1]).collect()
    assert rows == []


def test_ledger_and_gate(spark, occurrences, assets):
    characters = spark.createDataFrame([("個", ["ㄍㄜˋ"])], "char string, readings array<string>").withColumn("allowed", F.lit(None).cast("array<string>"))
    lane = expected.expected_lane(occurrences, *assets, characters=characters)
    lane = spark.createDataFrame(lane.collect(), lane.schema)
    actual = lane.select("occurrence_id", F.get(F.split("expected_set", r"\|"), F.lit(0)).alias("actual"), F.lit("decoded").alias("actual_evidence"))
    extra = spark.createDataFrame([("lost", "ㄅㄚ", "decoded")], "occurrence_id string, actual string, actual_evidence string")
    wrong = F.when(F.col("occurrence_id") == "o0", "ㄐㄧㄠˇ").otherwise(F.col("actual"))
    rows = ledger.build(actual.withColumn("actual", wrong).unionByName(extra).withColumn("review_id", F.col("occurrence_id")), lane)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    state = {r.occurrence_id: r.state for r in rows.collect()}
    assert state["o0"] == "DIFFERENCE_PENDING_CONFIRMATION" and state["o1"] == "PASS" and state["o3"] == "RULE_CONFLICT"
    assert state["lost"] == "DATA_INTEGRITY_ERROR" and state["o10"] == "ACTUAL_UNRESOLVED"
    assert ledger.violations(rows).count() == 0
    counts = {r.state: r.n for r in ledger.state_counts(rows).collect()}
    assert len(counts) == 14 and sum(counts.values()) == len(CASES) + 1 and counts["REVIEW_PENDING"] == 0
    cases = spark.createDataFrame([("c", "PASS")], "case_id string, result string")
    gate = ledger.completion(rows, rows.select("occurrence_id"), cases).first()
    assert gate.status == "PIPELINE_BLOCKED" and "data_integrity_error_zero" in gate.failed_gates
    good = rows.filter("state = 'PASS'")
    assert ledger.completion(good, good.select("occurrence_id"), cases).first().status == "PROOFREAD_COMPLETE"
    partly = rows.filter("state <> 'DATA_INTEGRITY_ERROR'")
    assert ledger.completion(partly, partly.select("occurrence_id"), cases).first().status == "PROCESSING_FINISHED"
    assert ledger.completion(good, rows.select("occurrence_id"), cases).first().status == "PIPELINE_BLOCKED"


def test_confirmed_error_needs_every_gate(spark):
    base = {"occurrence_id": "a", "review_id": "r", "actual": "ㄅㄚ", "actual_evidence": "x", "expected_set": "ㄅㄚˋ", "expected_evidence": "y", "actual_status": None, "expected_status": None, "exclusion_state": None, "blocking_state": None, "state": "TEXTBOOK_ERROR_CONFIRMED"}
    kinds = ", ".join(f"{k} string" for k in base) + ", confirmation_gates map<string,boolean>"
    for gates, want in ((dict.fromkeys(ledger.CONFIRMATIONS, True), "TEXTBOOK_ERROR_CONFIRMED"), ({"human_confirmation": True}, "DIFFERENCE_PENDING_CONFIRMATION")):
        df = spark.createDataFrame([tuple(base.values()) + (gates,)], kinds)
        assert ledger.refreshed(df).first().state == want


def test_identity(spark):
    columns = "pdf_sha256 string, physical_page int, stable_key string, font string, font_xref int, glyph_id int, zhuyin_component_id int, char string, x0 double, y0 double, x1 double, y1 double, source_row_number int"
    row = ("A" * 64, 1, "F#12", "F", 9, 23, 12, "角", 10.125, 20.25, 30.5, 40.75)
    rows = [(*row, 5), (*row, 3), (*row[:7], "色", *row[8:], 4), (None,) * 12 + (8,)]
    got = {r.source_row_number: r for r in ledger.with_identity(spark.createDataFrame(rows, columns)).collect()}
    assert len({r.occurrence_id for r in got.values()}) == 4 and len({r.review_id for r in got.values()}) == 4
    assert got[3].identity_confidence == "PDF_STABLE" and got[5].identity_confidence == "FALLBACK_SOURCE_ROW"
    assert got[5].identity_collision_base == got[3].occurrence_id and got[8].identity_confidence == "FALLBACK_SOURCE_ROW"
    import hashlib
    import json

    plain = {"pdf_sha256": "a" * 64, "physical_page": "1", "stable_key": "F#12", "font": "F", "font_xref": "9", "glyph_id": "23", "zhuyin_component_id": "12", "char": "角", "x0": "10.125", "y0": "20.25", "x1": "30.5", "y1": "40.75"}
    assert got[3].occurrence_id == "occ_" + hashlib.sha256(json.dumps(plain, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_moves(spark):
    moves = spark.createDataFrame([("PASS", "PASS"), ("PASS", "REVIEW_PENDING"), ("REVIEW_PENDING", "PASS")], "before string, after string")
    bad = reconcile.transition_violations(moves, ledger.allowed_moves(spark), "before", "after").collect()
    assert [tuple(r) for r in bad] == [("PASS", "REVIEW_PENDING")]
