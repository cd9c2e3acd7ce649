"""The expected lane's layers in their order, what they give, and where occurrences go."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lanewise.operators import expected

RULE = "rule_id string, priority int, mode string, target_char string, phrase string, expected_reading string, excluded_phrases array<string>"
RULES = [
    ("mama", 200, "exact", "媽", "媽媽", "ㄇㄚˇ", []),
    ("ge", 40, "default", "個", "", "ㄍㄜˋ", []),
    ("chong", 40, "default", "重", "", "ㄓㄨㄥˋ", []),
    ("le", 40, "default", "樂", "", "ㄌㄜˋ", []),
    ("name", 300, "skip", "重", "重山村", "", []),
    ("odd", 150, "exact", "行", "行走", "ㄏㄤˊ", []),
    ("odd2", 150, "exact", "看", "看門", "ㄎㄢ", []),
    ("far", 90, "derived", "著", "著急", "ㄓㄠˊ", []),
    ("block", 10, "exact", "轉", "轉盤", "ㄓㄨㄢˇ", ["轉盤子"]),
]
HANDBOOK = [("h1", 500, "exact", "和", "和平", "ㄏㄜˊ", []), ("h2", 500, "exact", "答", "答應", "ㄉㄚ", []), ("h3", 500, "exact", "答", "答應", "ㄉㄚˊ", [])]
WORDS = [("轉盤", ["ㄓㄨㄢˇ", "ㄆㄢˊ"]), ("音樂", ["ㄧㄣ", "ㄩㄝˋ"]), ("重要", ["ㄓㄨㄥˋ", "ㄧㄠˋ"]), ("行人", ["ㄒㄧㄥˊ", "ㄖㄣˊ"]), ("人和", ["ㄖㄣˊ", "ㄏㄜˊ"])]
SINGLES = [("天", "ㄊㄧㄢ"), ("的", "˙ㄉㄜ"), ("看", "ㄎㄢˋ"), ("門", "ㄇㄣˊ")]
CHARACTERS = [("行", ["ㄒㄧㄥˊ", "ㄏㄤˊ"], ["ㄒㄧㄥˊ"]), ("看", ["ㄎㄢˋ", "ㄎㄢ"], ["ㄎㄢˋ", "ㄎㄢ", "ㄎㄢˇ"]), ("樂", ["ㄌㄜˋ", "ㄩㄝˋ"], None), ("臺", ["ㄊㄞˊ"], None), ("走", ["ㄗㄡˇ", "ㄗㄡˋ"], ["ㄗㄡˇ", "ㄗㄡˋ"]), ("會", ["ㄏㄨㄟˋ", "ㄎㄨㄞˋ"], None)]
EXAMPLES = [("會", "會計", "ㄎㄨㄞˋ"), ("會", "開會", "ㄏㄨㄟˋ"), ("會", "一會", "ㄏㄨㄟˋ"), ("會", "一會", "ㄏㄨㄟˇ")]

# line, place, reading or conflicting readings, basis
CASES = [
    ("媽媽", 0, "ㄇㄚˇ", "exact"),  # a rule comes before the doubled word
    ("媽媽", 1, "˙ㄇㄚ", "handbook_position"),  # and after the handbook's place
    ("姐姐", 0, "ㄐㄧㄝˇ", "special_repeat"),
    ("這個", 1, "ㄍㄜˋ；˙ㄍㄜ", "special_ge"),  # a default rule waits
    ("他個", 1, "ㄍㄜˋ", "default"),
    ("重", 0, None, "none"),  # a lone character is left open
    ("重的", 0, "ㄓㄨㄥˋ", "default"),
    ("音樂會", 1, "ㄩㄝˋ", "concise_word"),
    ("快樂", 1, "ㄌㄜˋ", "default"),
    ("重山村", 0, "", "skip"),
    ("行走", 0, "ㄒㄧㄥˊ", "handbook_constraint"),  # the rule breaks the handbook, which allows one reading
    ("和平", 0, "ㄏㄜˊ", "exact"),
    ("答應", 0, "ㄉㄚ|ㄉㄚˊ", "handbook:conflict"),
    ("寶寶", 1, "˙ㄅㄠ", "company_position"),
    ("買東西", 2, "˙ㄒㄧ", "semantic_word"),
    ("東西走向", 1, "ㄒㄧ", "semantic_word"),
    ("好玩的書", 0, "ㄏㄠˇ", "semantic_word"),
    ("你看看風景", 2, "ㄎㄢˋ", "semantic_word"),
    ("會計", 0, "ㄎㄨㄞˋ", "dictionary_example"),
    ("一會", 1, None, "none"),  # an example under two readings is none
    ("天", 0, "ㄊㄧㄢ", "concise_single"),
    ("的", 0, None, "none"),
    ("轉盤子", 0, None, "none"),  # the rule is excluded, and so is its word
    ("家人和他", 2, None, "none"),
    ("天時地利人和", 5, "ㄏㄜˊ", "concise_word"),
    ("第一天", 1, "ㄧ", "special_yi"),
    ("一行", 0, "ㄧˋ", "special_yi"),  # the next character by its only allowed reading
]


@pytest.fixture(scope="module")
def evidence(spark):
    characters = spark.createDataFrame(CHARACTERS, "char string, readings array<string>, allowed array<string>")
    limits = characters.filter("allowed IS NOT NULL").select("char", "allowed")
    return expected.Evidence(
        spark.createDataFrame(RULES, RULE),
        spark.createDataFrame(WORDS, "word string, primary array<string>"),
        spark.createDataFrame(SINGLES, "char string, reading string"),
        spark.createDataFrame(HANDBOOK, RULE),
        expected.constrained(characters, limits),
        spark.createDataFrame(EXAMPLES, "char string, example string, reading string"),
    )


def occurrences(spark, cases):
    return spark.createDataFrame([(f"o{k}", c[0], c[1], c[0][c[1] : c[1] + 1]) for k, c in enumerate(cases)], "occurrence_id string, line string, pos int, char string")


def test_layers(spark, evidence):
    got = {r.occurrence_id: r for r in expected.decided(occurrences(spark, CASES), evidence).collect()}
    assert len(got) == len(CASES)
    for k, (line, pos, reading, basis) in enumerate(CASES):
        r = got[f"o{k}"]
        assert (r.conflicting or r.reading, r.basis) == (reading, basis), (line, pos, r)


def test_materialised_and_routed(spark, evidence):
    cases = [
        ("臺北", 0, "ㄊㄞˊ", "single", "RESOLVED", "ㄊㄞˊ", "single_agrees"),
        ("臺北", 0, "ㄊㄞ", "single", "RESOLVED", "ㄊㄞˊ", "single_mismatches"),
        ("臺北", 0, "", "single", "RESOLVED", "ㄊㄞˊ", "actual_missing"),
        ("行走", 0, "ㄒㄧㄥˊ", "single", "RESOLVED", "ㄒㄧㄥˊ", "single_agrees"),
        ("走", 0, "ㄗㄡˋ", "handbook_allowed_set", "RESOLVED", "ㄗㄡˇ；ㄗㄡˋ", "lexical_agrees"),
        ("走", 0, "ㄗㄡˊ", "handbook_allowed_set", "RESOLVED", "ㄗㄡˇ；ㄗㄡˋ", "lexical_mismatches"),
        ("會的", 0, "ㄏㄨㄟˋ", "ambiguous", "AMBIGUOUS", "", "multi_unresolved"),
        ("龘", 0, "ㄉㄚˊ", "unresolved", "UNRESOLVED", "", "expected_uncovered"),
        ("答應", 0, "ㄉㄚ", "conflict", "CONFLICT", "ㄉㄚ；ㄉㄚˊ", "rule_conflicts"),
        ("著急", 0, "ㄓㄠˊ", "lexical", "RESOLVED", "ㄓㄠˊ", "lexical_agrees"),
        ("著急", 0, "ㄓㄨˋ", "lexical", "RESOLVED", "ㄓㄠˊ", "weak_lexical_mismatches"),
        ("重山村", 0, "ㄔㄨㄥˊ", "skipped", "EXCLUDED", "", "scope_skipped"),
        ("看門", 0, "ㄎㄢ", "lexical", "RESOLVED", "ㄎㄢ", "lexical_agrees"),
    ]
    actual = spark.createDataFrame([(f"o{k}", c[2]) for k, c in enumerate(cases)], "occurrence_id string, actual string")
    rows = expected.routed(expected.materialised(expected.decided(occurrences(spark, cases), evidence)).join(actual, "occurrence_id"))
    got = {r.occurrence_id: (r.kind, r.expected_status, r.expected, r.source_view) for r in rows.collect()}
    assert got == {f"o{k}": c[3:] for k, c in enumerate(cases)}
    assert {c[6] for c in cases} == set(expected.VIEWS)


def test_sole_reading_against_weak_evidence(spark, evidence):
    characters = spark.createDataFrame([("重", ["ㄔㄨㄥˊ"])], "char string, readings array<string>").withColumn("allowed", F.lit(None).cast("array<string>"))
    own = expected.Evidence(evidence.rules, evidence.words, evidence.singles, characters=characters)
    got = expected.materialised(expected.decided(occurrences(spark, [("重的", 0), ("重要", 0)]), own)).orderBy("occurrence_id").collect()
    assert [(r.kind, r.expected) for r in got] == [("conflict", "ㄓㄨㄥˋ"), ("single", "ㄓㄨㄥˋ")]


def test_rescue_and_hints(spark, evidence):
    rows = [("甲", 0, True), ("甲乙丙", 1, True), ("甲乙丙丁", 1, False), ("甲乙丙丁", 3, True), ("甲乙丙。丁", 4, False), ("甲。乙丙丁", 0, False), ("", 0, False), (None, 0, False), ("甲乙丙丁", None, False), ("甲乙丙丁", 9, False)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, line string, pos int, want boolean")
    got = df.select("line", "pos", "want", expected.coordinate_rescue_fits(F.col("line"), F.col("pos"), F.lit("甲")).alias("got")).collect()
    assert all(r.got == r.want for r in got), got
    hints = expected.example_hints(occurrences(spark, [("他會計算開會", 1), ("沒有", 0)]), evidence.examples).collect()
    assert [(r.occurrence_id, r.hints) for r in hints] == [("o0", "會計→ㄎㄨㄞˋ；開會→ㄏㄨㄟˋ")]


def test_each_place_of_a_line_is_searched_once(spark):
    """Nine thousand occurrences at four places, nulls among them: four rows are searched, all are answered."""
    places = [("重的", 0, "重"), ("重的", 1, "的"), (None, None, "重"), (None, None, None)]
    occ = spark.createDataFrame([(str(k), *places[k % 4]) for k in range(9_000)], "occurrence_id string, line string, pos int, char string")
    seen = []

    def search(rows):
        seen.append(rows.count())
        return rows.select("occurrence_id", F.coalesce("char", F.lit("-")).alias("char"))

    got = {r.occurrence_id: r.char for r in expected.by_context(occ, search).collect()}
    assert seen == [4] and got == {str(k): places[k % 4][2] or "-" for k in range(9_000)}
