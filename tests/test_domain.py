"""Decoding, reviews, regressions and revisions on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lanewise.operators import decode, ledger, regression, review, revision


def test_visible_layer_and_components(spark):
    columns = "pdf_sha256 string, page int, codepoint string, x0 double, y0 double, x1 double, y1 double, nonwhite boolean, opacity double, seqno int, ordinal int"
    rows = [("p", 1, "a", 1.1, 2, 3, 4, True, 1.0, 5, 1), ("p", 1, "a", 1.2, 2, 3, 4, False, 1.0, 9, 2), ("p", 1, "a", 1.0, 2, 3, 4, True, 1.0, 5, 3), ("p", 1, "b", 1.0, 2, 3, 4, False, 0.1, 1, 4)]
    rows = [(*r[:4], *(float(x) for x in r[4:7]), *r[7:]) for r in rows]
    got = sorted(r.ordinal for r in decode.visible_layer(spark.createDataFrame(rows, columns)).collect())
    assert got == [1, 4]
    comps = spark.createDataFrame([([(1, 0), (2, 600)],), ([(1, 0), (2, 10)],), ([(1, 700), (2, 600)],)], "c array<struct<gid int, x int>>")
    assert [tuple(r.m) if r.m else None for r in comps.select(decode.main_and_annotation(F.col("c")).alias("m")).collect()] == [(1, 2), None, None]


def test_layers_of_decoding(spark):
    glyphs = spark.createDataFrame([(k, "p", 1, 9, f, c, sha, sig) for k, f, c, sha, sig in [("a", "Kai-1", 5, "s1", "o1"), ("b", "Kai-1", 6, "s2", "o1"), ("c", "Kai-2", 5, "s3", "o1"), ("d", "Sung", 7, "t1", "o9"), ("e", "Sung", 8, "x", "o2"), ("f", "Sung", 9, "x", "o1"), ("g", "Kai-2", 7, "x", "o9")]], "occurrence_id string, pdf_sha256 string, page int, font_xref int, font string, component_id int, glyph_sha string, outline_signature string")
    exact = spark.createDataFrame([("Kai-1", 5, "ㄅ"), ("Kai-1", 7, "ㄇ"), ("Kai-3", 7, "ㄈ"), ("Kai-1", 6, "ㄆ")], "font string, component_id int, reading string")
    groups = spark.createDataFrame([("kai", "^kai", 1), ("any", ".*", 2)], "group_id string, font_regex string, file_order int")
    page = spark.createDataFrame([("p", 1, 9, 5, "ㄉ")], "pdf_sha256 string, page int, font_xref int, component_id int, reading string").filter("component_id = 99")
    fix = spark.createDataFrame([("Kai-1", 6, "s2", "ㄊ")], "font string, component_id int, glyph_sha string, reading string")
    moves = spark.createDataFrame([("Sung", 7, "ㄅ", "Kai-1", 5, ["t1"], "safe"), ("Sung", 8, "ㄌ", "Kai-1", 5, ["x"], "safe"), ("Sung", 8, "ㄅ", "Kai-1", 5, ["x"], "weak")], "target_font string, target_component_id int, reading string, source_font string, source_component_id int, target_shas array<string>, confidence string")
    outlines = spark.createDataFrame([("o2", "ㄋ"), ("o1", "ㄍ"), ("o1", "ㄎ")], "outline_signature string, reading string")
    got = {r.occurrence_id: (r.actual, r.basis) for r in decode.decode(glyphs, exact, groups, page, fix, moves, outlines).collect()}
    assert got == {"a": ("ㄅ", "exact"), "b": ("ㄊ", "correction"), "c": ("ㄅ", "font_group"), "d": ("ㄅ", "transform"), "e": ("ㄋ", "outline"), "f": (None, "outline:conflict"), "g": (None, "font_group:conflict")}


def test_overrides_and_exclusions(spark):
    columns = "occurrence_id string, pdf_sha256 string, page int, char string, stable_key string, x0 double, y0 double, actual string, basis string, font_xref int, font string, glyph_id int, component_id int"
    rows = spark.createDataFrame([("a", "p", 1, "角", "k1", 10.0, 20.0, "x", "exact", 1, "f", 2, 3), ("b", "p", 1, "角", "k2", 10.1, 20.1, "x", "exact", 1, "f", 2, 3), ("c", "p", 1, "角", "k2", 10.7, 20.0, "x", "exact", 1, "f", 2, 4)], columns)
    over = spark.createDataFrame([("p", 1, "角", "k1", 10.0, 20.0, "y", 1), ("p", 1, "角", "k1", 10.0, 20.0, "z", 2)], "pdf_sha256 string, page int, char string, stable_key string, x0 double, y0 double, reading string, file_order int")
    got = {r.occurrence_id: (r.actual, r.automatic, r.basis) for r in decode.apply_overrides(rows, over).collect()}
    assert got == {"a": ("y", "x", "override"), "b": ("y", "x", "override"), "c": ("x", "x", "exact")}
    out = spark.createDataFrame([("p", 1, "角", 1, "f", 2, 4, 10.0, 20.0, None, 1)], "pdf_sha256 string, page int, char string, font_xref int, font string, glyph_id int, component_id int, x0 double, y0 double, reason string, file_order int")
    kept, gone = decode.split_excluded(rows, out)
    assert sorted(r.occurrence_id for r in kept.collect()) == ["a", "b"] and [r.occurrence_id for r in gone.collect()] == ["c"]


def test_duplicates_signatures_pages(spark):
    columns = "pdf_sha256 string, page int, char string, x0 double, y0 double, actual string, font string, visible_font string, source_row_number int"
    rows = [("p", 1, "a", 1.01, 1.0, "x", "f", "f", 1), ("p", 1, "a", 1.02, 1.0, "x", "f", "f", 2), ("p", 1, "b", 1.0, 1.0, "x", "f", "g", 3), ("p", 1, "b", 1.0, 1.0, "y", "g", "g", 4), ("p", 1, "c", 1.0, 1.0, "x", "f", None, 5), ("p", 1, "c", 1.0, 1.0, "y", "g", None, 6)]
    assert sorted(r.source_row_number for r in decode.hidden_duplicates(spark.createDataFrame(rows, columns)).collect()) == [2, 4, 5, 6]
    glyphs = spark.createDataFrame([("a", "s", ["1", "2"], "ˊ"), ("b", "s", ["1", "9"], None), ("c", "s", ["1", "3"], None), ("d", "s", ["2"], "˙")], "occurrence_id string, style_group string, signatures array<string>, tone string")
    symbols = spark.createDataFrame([("s", "1", "ㄐ"), ("s", "2", "ㄩ"), ("s", "3", "ㄝ"), ("s", "3", "ㄟ")], "style_group string, signature string, symbol string")
    assert {r.occurrence_id: r.reading for r in decode.decode_signatures(glyphs, symbols).collect()} == {"a": "ㄐㄩˊ", "d": "˙ㄩ"}
    evidence = spark.createDataFrame([("A", "1", "x", 1, 1), ("A", "1", "x", 2, 1), ("A", "2", "y", 1, 1), ("B", "1", "z", 1, 1), ("B", "2", "y", 1, 3)], "family string, signature string, symbol string, glyph_id int, support int")
    assert {(r.family, r.signature): (r.symbol, r.basis) for r in decode.accepted_signatures(evidence).collect()} == {("A", "1"): ("x", "own"), ("A", "2"): ("y", "propagated"), ("B", "1"): ("x", "propagated"), ("B", "2"): ("y", "own")}
    words = spark.createDataFrame([("p", 1, "12", 10.0, 20.0, 90.0, 100.0, 100.0, None), ("p", 1, "99", 50.0, 55.0, 95.0, 100.0, 100.0, None), ("p", 2, "7", 90.0, 95.0, 95.0, 100.0, 100.0, "iv"), ("p", 3, "x", 1.0, 2.0, 95.0, 100.0, 100.0, "")], "pdf_sha256 string, page int, text string, x0 double, x1 double, y0 double, width double, height double, label string")
    assert {r.page: r.printed_page for r in decode.printed_page(words).collect()} == {1: "12", 2: "iv", 3: None}


def test_visible_font_and_context(spark):
    rows = spark.createDataFrame([("a", "p", 1, "x", 0.0, 0.0, 1), ("b", "p", 1, "x", 10.0, 0.0, 2)], "occurrence_id string, pdf_sha256 string, page int, char string, cx double, cy double, ordinal int")
    chars = spark.createDataFrame([("p", 1, "x", 2.9, 0.0, "far"), ("p", 1, "x", -1.0, 1.0, "near"), ("p", 1, "y", 10.0, 0.0, "other")], "pdf_sha256 string, page int, char string, cx double, cy double, font string")
    assert [(r.occurrence_id, r.visible_font, r.distance) for r in decode.visible_font(rows, chars).collect()] == [("a", "near", 5.0)]
    assert {r.occurrence_id: (r.context, r.context_pos) for r in decode.context(rows, 1).collect()} == {"a": ("xx", 0), "b": ("xx", 1)}


@pytest.fixture(scope="module")
def baseline(spark):
    base = {"actual_evidence": "e", "expected_evidence": None, "actual_status": None, "expected_status": None, "exclusion_state": None, "blocking_state": None, "state": None}
    rows = [(f"r{k}", f"r{k}", "ㄅ", x, *base.values(), f"t{k}", f"a{k}") for k, x in enumerate([None, None, "ㄆ", "ㄆ", None])]
    kinds = "occurrence_id string, review_id string, actual string, expected_set string, " + ", ".join(f"{k} string" for k in base) + ", target_snapshot string, actual_snapshot string"
    df = spark.createDataFrame(rows, kinds).withColumn("expected_evidence", F.when(F.col("expected_set").isNotNull(), "d")).withColumn("confirmation_gates", F.lit(None).cast("map<string,boolean>"))
    df = ledger.refreshed(df)
    return spark.createDataFrame(df.collect(), df.schema)


def test_replay(spark, baseline):
    gates = dict.fromkeys(ledger.CONFIRMATIONS, True)
    events = [("r0", 1, "supply", "ㄆ", "me", "t0", "a0", None), ("r0", 2, "supply", "ㄅ", "me", "t0", "a0", None), ("r1", 3, "supply", "ㄅ", "me", "old", "a1", None), ("r2", 4, "confirm", None, None, "t2", "a2", gates), ("r3", 5, "confirm", None, None, "t3", "old", gates), ("r4", 6, "exclude", None, "why", "t4", "a4", None)]
    df = spark.createDataFrame(events, "review_id string, seq int, action string, expected_set string, evidence string, target_snapshot string, actual_snapshot string, gates map<string,boolean>")
    full = review.replay(baseline, df)
    got = {r.review_id: (r.state, r.event_status) for r in full.collect()}
    assert got == {"r0": ("PASS", "APPLIED"), "r1": ("EXPECTED_UNRESOLVED", "INVALIDATED_TARGET_DRIFT"), "r2": ("TEXTBOOK_ERROR_CONFIRMED", "APPLIED"), "r3": ("DIFFERENCE_PENDING_CONFIRMATION", "INVALIDATED_ACTUAL_DRIFT"), "r4": ("EXCLUDED_OUT_OF_SCOPE", "APPLIED")}
    current = review.replay(baseline, df.filter("seq < 6"))
    partly = review.changed_only(baseline, current, df, spark.createDataFrame([("r4",)], "review_id string"))
    assert {r.review_id: (r.state, r.event_status) for r in partly.collect()} == got


def test_reusable_and_truth(spark):
    occ = spark.createDataFrame([("a", "大角色", 1, "角"), ("b", "角落", 0, "角")], "occurrence_id string, line string, pos int, char string")
    rules = spark.createDataFrame([("1", "角色", "角", 0, "x", None, True), ("2", "角", "角", 0, "y", "落", True), ("3", "角", "角", 0, "z", "落", True), ("4", "角", "角", 0, "w", None, False)], "rule_id string, phrase string, target_char string, target_index int, expected_set string, context_contains string, enabled boolean")
    assert {r.occurrence_id: (r.reading, r.conflicting) for r in review.reusable_readings(occ, rules).collect()} == {"a": ("x", None), "b": (None, "y|z")}
    evidence = spark.createDataFrame([("g", "x"), ("g", "x"), ("h", "x"), ("i", "x"), ("i", "y")], "glyph_sha string, reading string")
    assert {r.glyph_sha: (r.reading, r.truth) for r in review.learnt_truth(evidence).collect()} == {"g": ("x", "VERIFIED"), "h": ("x", "SINGLE"), "i": (None, "QUARANTINED")}
    columns = "glyph_id string, evidence_id string, reading string, project_id string, pdf_sha256 string, font_sha256 string, occurrence_id string, decision_sha256 string"
    rows = [("g", "1", "x", "p1", "f1", "t1", "o1", "d1"), ("g", "2", "x", "p1", "f2", "t2", "o2", "d2"), ("g", "3", "x", "p2", "f2", "t3", "o3", "d3"), ("h", "1", "x", "p1", "f1", "t1", "o1", "d1"), ("i", "1", "x", "p1", "f1", "t1", "o1", "d1"), ("i", "2", "y", "p2", "f2", "t2", "o2", "d2")]
    library = spark.createDataFrame(rows, columns)
    none = spark.createDataFrame([("h",)], "glyph_id string")
    assert {r.glyph_id: (r.state, r.first_id, r.second_id) for r in review.library_states(library, none).collect()} == {"g": ("PROMOTION_READY", "1", "3"), "h": ("CANDIDATE", None, None), "i": ("QUARANTINED_CONFLICT", "1", "2")}
    assert {r.glyph_id: r.independent for r in review.independent_sources(library).collect()} == {"g": 2, "h": 1, "i": 2}


def test_groups_and_queue(spark):
    columns = "occurrence_id string, pdf_sha256 string, pdf_order int, page int, source_row_number int, y0 double, x0 double, char string, stable_key string, actual string, state string, active_review boolean, lane string"
    rows = [("a", "p", 1, 2, 5, 1.0, 1.0, "角", "k", "x", "PASS", False, "l"), ("b", "p", 1, 1, 3, 1.0, 1.0, "角", "k", None, "REVIEW_PENDING", True, "l"), ("c", "p", 1, 1, 1, 1.0, 1.0, "色", "m", "x", "PASS", False, "l"), ("d", "p", 1, 3, 9, 1.0, 1.0, "色", "m", None, "REVIEW_PENDING", True, "l")]
    df = spark.createDataFrame(rows, columns)
    got = {r.stable_key: (r.n, [m.occurrence_id for m in r.members]) for r in review.groups(df, ["stable_key"]).collect()}
    assert got == {"k": (2, ["b", "a"]), "m": (2, ["c", "d"])}
    assert {r.occurrence_id: r.place for r in review.queue(df, "lane").collect()} == {"d": 1, "b": 2}
    many = spark.createDataFrame([(f"o{k}", "p", 1, k % 7, k, 0.0, 0.0, "角色一"[k % 3], "k", None, "REVIEW_PENDING", True, "l" if k % 5 else None) for k in range(500)], columns)
    places = [(r.lane, r.place) for r in review.queue(many, "lane").collect()]
    assert sorted(p for lane, p in places if lane) == [*range(1, 401)] and sorted(p for lane, p in places if not lane) == [*range(1, 101)]


def test_regressions(spark):
    columns = "case_id string, pdf_contains string, page string, phrase string, target_char string, target_occurrence_index int, locator_context string, actual_reading string, expected_reading string, applicability_mode string, source_pdf_sha256 string"
    rows = [("1", "", "3", "妹妹", "妹", 2, "", "˙ㄇㄟ", "˙ㄇㄟ", "hard_gate", "AB"), ("2", "", "", "妹妹", "妹", 1, "", "ㄇㄟˋ", "ㄇㄟˋ", "portable_gate", ""), ("3", "", "3", "妹妹", "妹", 2, "nowhere", "x", "x", "hard_gate", "ab"), ("4", "other", "", "妹", "妹", 1, "", "x", "x", "portable_gate", ""), ("5", "", "", "妹妹", "妹", 2, "", "ㄇㄟˋ", "x", "portable_gate", ""), ("6", "", "", "x", "x", 1, "", "", "", "hard_gate", "cd"), ("7", "", "", "x", "x", 1, "", "", "", "reference_only", "")]
    occ = spark.createDataFrame([("a", "我妹妹", 1, "妹", "ㄇㄟˋ", "ㄇㄟˋ", "3"), ("b", "我妹妹", 2, "妹", "˙ㄇㄟ", "˙ㄇㄟ", "3")], "occurrence_id string, line string, pos int, char string, actual string, expected_set string, printed_page string")
    cases = regression.applicability(spark.createDataFrame(rows, columns), "ab", "my book")
    got = regression.execute(cases, occ)
    assert {r.case_id: r.result for r in got.collect()} == {"1": "PASS", "2": "PASS", "3": "NOT_EXECUTED", "4": "NOT_APPLICABLE", "5": "FAIL", "6": "NOT_APPLICABLE", "7": "NOT_APPLICABLE"}
    several = spark.createDataFrame([("1", "PASS", "d"), ("1", "NOT_APPLICABLE", "d"), ("2", "PASS", "d"), ("2", "PASS", "d"), ("3", "PASS", "d"), ("3", "PASS", "e"), ("4", "NOT_EXECUTED", "d")], "case_id string, result string, definition_sha string")
    rolled = regression.roll_up(several)
    assert {r.case_id: r.result for r in rolled.collect()} == {"1": "PASS", "2": "FAIL", "3": "DEFINITION_DRIFT", "4": "NOT_EXECUTED"}
    report = regression.execution_report(spark.createDataFrame([("1",), ("9",)], "case_id string"), rolled).first()
    assert (report.required, report.executed, report.missing, report.unexpected, report.failed, report.ok) == (2, 1, 1, 3, 1, False)


def test_revision(spark):
    def edition(texts):
        rows = [(1, p, label, k, c, f"{c}{k % 2}") for p, (label, text) in enumerate(texts, 1) for k, c in enumerate(text)]
        return revision.pages(spark.createDataFrame(rows, "pdf_order int, page int, label string, source_row_number int, char string, reading string"))

    old = edition([("1", "abcdefghij"), ("2", "klmnopqrst"), ("", "uvwxyzuvwxyz")])
    new = edition([("1", "abcdefghij"), ("", "uvwxyzuvwxyz"), ("2", "klmXopqrstq")])
    pairs = revision.pair(old, new)
    assert sorted((r.old_number, r.new_number, r.how) for r in pairs.collect()) == [(0, 0, "label"), (1, 2, "label"), (2, 1, "content")]
    changed = new.withColumn("readings", F.transform("readings", lambda x, i: F.when((F.col("number") == 0) & (i == 4), "changed").otherwise(x)))
    got = sorted((r.pair, r.kind, r.char, r.old_index, r.new_index) for r in revision.events(old, changed, pairs).collect())
    assert got == [("0:0", "reading_changed", "e", 4, 4), ("1:2", "added", "q", None, 10), ("1:2", "uncertain_new", "X", None, 3), ("1:2", "uncertain_old", "n", 3, None)]
