"""The second look in the order of the page: taken, refused, and left alone."""

from __future__ import annotations

from lanewise.operators import expected

RULES = [
    ("a", 100, "exact", "角", "角色", "ㄐㄩㄝˊ", []),
    ("b", 94, "exact", "色", "角色", "ㄙㄜˋ", []),
    ("c", 100, "derived", "長", "長大", "ㄓㄤˇ", []),
    ("d", 40, "default", "重", "", "ㄓㄨㄥˋ", []),
    ("e", 120, "exact", "重", "重來", "ㄔㄨㄥˊ", []),
    ("f", 120, "exact", "樂", "樂曲", "ㄩㄝˋ", []),
    ("g", 120, "exact", "樂", "快樂", "ㄌㄜˋ", []),
    ("h", 99, "skip", "了", "了了", "", []),
]
CASES = {
    "taken": ("角", 0, "角", "大角色", 1),
    "weak": ("色", 0, "色", "大角色", 2),
    "not exact": ("長", 0, "長", "長大了", 0),
    "default given up": ("重", 0, "重", "重來", 0),
    "long line": ("大家看角落的人", 3, "角", "角色", 0),
    "edge of a line": ("大家看見角", 4, "角", "角色", 0),
    "edge by a stop": ("大家看見。角", 5, "角", "角色", 0),
    "clash": ("樂", 0, "樂", "快樂曲", 1),
    "known": ("角色", 0, "角", "重來", 0),
    "no order": ("角", 0, "角", None, None),
    "word": ("音", 0, "音", "音樂", 0),
    "word, no line": ("", 0, "音", "音樂", 0),
    "skipped": ("了了", 0, "了", "角色", 0),
}


def test_rescued(spark):
    rules = spark.createDataFrame(RULES, "rule_id string, priority int, mode string, target_char string, phrase string, expected_reading string, excluded_phrases array<string>")
    evidence = expected.Evidence(rules, spark.createDataFrame([("音樂", ["ㄧㄣ", "ㄩㄝˋ"])], "word string, primary array<string>"), spark.createDataFrame([], "char string, reading string"))
    occ = spark.createDataFrame([(k, *v) for k, v in CASES.items()], "occurrence_id string, line string, pos int, char string, fallback string, fallback_pos int")
    got = {r.occurrence_id: (r.reading, r.rescued) for r in expected.rescued(occ, evidence).collect()}
    assert {k for k, v in got.items() if v[1]} == {"taken", "default given up", "edge of a line", "word"}
    assert got["taken"][0] == got["edge of a line"][0] == "ㄐㄩㄝˊ" and got["default given up"][0] == "ㄔㄨㄥˊ" and got["word"][0] == "ㄧㄣ"
    assert all(got[k][0] is None for k in ("weak", "not exact", "long line", "edge by a stop", "clash", "no order", "word, no line")) and got["known"][0] == "ㄐㄩㄝˊ"
    assert expected.rescued(occ.filter("false"), evidence).count() == 0
