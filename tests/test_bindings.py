"""Scalars, audits and bindings on small tables."""

from __future__ import annotations

import random

import hashlib

import pytest
from pyspark.sql import functions as F

from lanewise.functions import scalars
from lanewise.operators import audit, bindings, keyed, ledger, matching, review
from lanewise.plans import incremental


def of(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in rows.select("k", fn(F.col("v")).alias("x")).orderBy("k").collect()]


def test_further_scalars(spark):
    assert of(spark, ["角", "a", "", None, "𠀀", "豈"], scalars.is_han) == [True, False, False, False, False, True]
    assert of(spark, ["DFBiaoKaiZhuIn-W5", "Arial"], scalars.is_annotation_font) == [True, False]
    assert of(spark, ["F#12|excel_row: 7", "row=3", "a; Source_Row#9 ", "F#1", None], scalars.stable_key) == ["F#12", "", "a", "F#1", ""]
    assert of(spark, ["DFYuanPoIn2-W3", "dfheizhuin-w7", "x"], scalars.first_named) == ["YUAN_W3W5", "HEI_W7", ""]
    assert of(spark, ["PASS", "odd", None], scalars.state_name) == ["正確", "odd", ""]
    assert of(spark, [0xFFFFFF, 0xF7F8F9, 0xF6FFFF, 0], scalars.colour_rank, "int") == [0, 0, 1, 1]
    assert of(spark, [[1.0, 1.0, 0.97], [0.2, 1.0, 1.0], [255.0, 250.0, 248.0], [1.0]], scalars.colour_rank_of, "array<double>") == [0, 1, 0, 1]
    assert of(spark, ["2.0005", "x", None], scalars.safe_round) == [2.0, None, None] and of(spark, ["a\x01b\tc", None], scalars.safe_text) == ["ab\tc", ""]
    for r in ("˙ㄇㄚ", "ㄇㄚˊ", "ㄇㄚˇ", "ㄇㄚˋ", "ㄇㄚ"):
        assert of(spark, [r], lambda c: scalars.with_tone(scalars.split_tone(c)["base"], scalars.split_tone(c)["tone"])) == [r]
    assert of(spark, ["ㄑㄧㄠˊ讀;ㄑㄧㄠˋ語", "一", "ㄅㄚ；ㄅㄚ", None, "見ㄅㄚ"], scalars.annotated_readings) == [["ㄑㄧㄠˊ", "ㄑㄧㄠˋ"], ["ㄧ"], ["ㄅㄚ"], [], []]
    assert of(spark, ["ㄅㄚ˙、ㄇㄚˇ", None], scalars.handbook_readings) == [["˙ㄅㄚ", "ㄇㄚˇ"], []]
    assert of(spark, ["「爸 爸」、；見", None], scalars.handbook_phrase) == ["爸爸", ""]
    assert of(spark, ["甲（乙、（丙，丁）戊）、己", "（甲、乙", "甲）、乙"], scalars.outside_brackets) == [["甲（乙、（丙，丁）戊）", "己"], ["（甲、乙"], ["甲）", "乙"]]
    rows = spark.createDataFrame([("看一看", 2, "看一看", "看"), ("看看", 0, "看看", "看"), ("x", 0, "一角", "角"), ("x", 0, "角角", "角")], "line string, pos int, phrase string, ch string")
    assert [r.x for r in rows.select(scalars.phrase_target(F.col("line"), F.col("pos"), F.col("phrase"), F.col("ch")).alias("x")).collect()] == [2, 0, 1, None]
    word = spark.createDataFrame([("長大", ["ㄓㄤˇ", "ㄉㄚˋ"], 1, "大"), ("長大", ["ㄓㄤˇ"], 0, "長"), ("長大", ["ㄓㄤˇ", "ㄉㄚˋ"], 1, "長")], "w string, p array<string>, i int, c string")
    assert [r.x for r in word.select(scalars.reading_at(F.col("w"), F.col("p"), F.col("i"), F.col("c")).alias("x")).collect()] == ["ㄉㄚˋ", None, None]
    moved = spark.createDataFrame([("ａ b︀c", 4), ("㍿x", 1), (None, 0), ("ab", None), ("a b", 1)], "t string, p int").select(scalars.nfkc_context("t", "p").alias("x")).select("x.*").collect()
    assert [tuple(r) for r in moved] == [("abc", 2), ("株式会社x", 4), ("", None), ("ab", None), ("ab", None)]
    assert of(spark, ["a"], lambda c: scalars.made_id("gly_", sha=c)) == ["gly_" + hashlib.sha256(b'{"sha":"a"}').hexdigest()]


def test_audit(spark):
    rows = spark.createDataFrame([("f", "x", "r"), ("f", "x", None), ("f", "y", ""), ("g", "x", "r")], "font string, how string, reading string")
    assert {tuple(r) for r in audit.structural_rollup(rows, "reading", ["font", "how"]).collect()} == {("f", "x", 2, 1, 1), ("f", "y", 1, 0, 1), ("g", "x", 1, 1, 0)}
    assert {r.how: (r.n, r.place) for r in audit.hits(rows, "how").collect()} == {"x": (3, 1), "y": (1, 2)}
    assert {r.font: (r.n, r.places) for r in audit.distribution(rows, ["font"], "how", 1).collect()} == {"f": (3, "x"), "g": (1, "x")}
    one, other = audit.tree_digest(rows, "how").first(), audit.tree_digest(rows.orderBy(F.desc("reading")).repartition(3), "how").first()
    assert one == other and one.n_rows == 4 and audit.tree_digest(rows.limit(3), "how").first().digest != one.digest and audit.tree_digest(rows.limit(0), "how").first().n_rows == 0
    assert [(r.font, r.versions) for r in audit.unequal_reports(rows, "font", ["how"]).collect()] == [("f", 2)]
    every, overlap = audit.union_of_views({"a": rows.filter("font = 'f'").select("font", "how"), "b": rows.filter("how = 'x'")}, "how")
    assert every.count() == 6 and [r.how for r in overlap.collect()] == ["x"]
    assert {tuple(r) for r in audit.roster_difference(rows.filter("font = 'f'"), rows.filter("how = 'x'"), ["font"]).collect()} == {("g", "unexpected")}
    assert {(r.how, r.nth, r.n_faults) for r in audit.first_faults(rows, "how", "font", 2).collect()} == {("x", 1, 3), ("x", 2, 3), ("y", 1, 1)}
    assert [r.reading for r in audit.broken_references(rows, spark.createDataFrame([("q",)], "reading string"), ["reading"]).dropDuplicates(["reading"]).orderBy("reading").collect()] == ["", "r"]
    now = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "k string, v string")
    want = spark.createDataFrame([("a", "1"), ("b", None), ("c", "4"), ("d", "5")], "k string, v string")
    assert {tuple(r) for r in audit.failed_conditions(now, want, "k", "v").collect()} == {("c", "4", "other_value"), ("d", "5", "gone")}
    paths = spark.createDataFrame([("a", "x/a.csv"), ("A", "x/b.csv"), ("c", "../c"), ("d", "/d"), ("e", "x\\a.csv"), ("f", "C:x"), ("g", None), ("h", "X/B.csv")], "name string, path string")
    assert {(r.name, r.fault) for r in audit.path_faults(paths).collect()} == {("A", "repeated_name"), ("A", "repeated_path"), ("c", "outside_root"), ("d", "outside_root"), ("f", "outside_root"), ("g", "outside_root")}
    pins = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest().upper()), ("b", "00"), ("c", "00")], "path string, sha256 string")
    found = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"x"))], "path string, content binary")
    assert {tuple(r) for r in audit.digest_faults(pins, found).collect()} == {("b", "changed"), ("c", "missing")}
    cells = spark.createDataFrame([(1, "ㄅㄚ；ㄇㄚˇ"), (2, "ㄅㄚ ㄇㄚˇ"), (3, "ㄅㄚ語"), (4, ""), (5, None), (6, "無"), (7, "ㄅㄚ；")], "k int, v string")
    bad = lambda mode, **kw: sorted(r.k for r in audit.reading_faults(cells, "k", "v", mode, **kw).collect())
    assert bad("single") == [3, 6, 7] and bad("syllable_sequence", exempt=["無"]) == [3] and bad("annotated_single", allow_empty=False) == [4, 5, 6, 7]
    assert of(spark, [["b", None, "a"], None], lambda c: audit.all_values(c, F.array(F.lit("a"))), "array<string>") == ["a|b", "a"]


def test_file_coverage(spark):
    rows = spark.createDataFrame([("f", "PASS", "ㄅ", "e", "RESOLVED", "x"), ("f", "ACTUAL_UNRESOLVED", None, None, "UNRESOLVED", None), ("g", "EXCLUDED_OUT_OF_SCOPE", "ㄅ", "e", "RESOLVED", "x")], "pdf string, state string, actual string, actual_evidence string, expected_status string, expected_evidence string")
    assert {tuple(r) for r in audit.file_coverage(rows, "pdf").collect()} == {("f", 2, 1 + 1, 0.5, 0.5), ("g", 1, 0, 0.0, 0.0)}


ENTRY = "occurrence_id string, review_id string, expected_set string, expected_evidence string, context_evidence string, state string, actual string, actual_evidence string, pdf_name string, physical_page int, printed_page string, char string, line string, local_context string"


def entries(spark, **change):
    base = {"occurrence_id": "o", "review_id": "r", "expected_set": "ㄅ", "expected_evidence": "e", "context_evidence": "c", "state": "REVIEW_PENDING", "actual": "ㄆ", "actual_evidence": "a", "pdf_name": "p", "physical_page": 1, "printed_page": "1", "char": "角", "line": "角色", "local_context": "角色"}
    return bindings.with_snapshots(spark.createDataFrame([tuple((base | change).values())], ENTRY))


def test_snapshots_cover_what_they_say(spark):
    names = ("full_snapshot", "expected_snapshot", "target_snapshot")
    base = entries(spark).first()
    differ = lambda **c: {n for n in names if entries(spark, **c).first()[n] != base[n]}
    assert differ(actual="ㄇ") == {"full_snapshot"} and differ(state="PASS") == {"full_snapshot"}
    assert differ(expected_set="ㄇ") == {"full_snapshot", "expected_snapshot"} and differ(line="角") == {"target_snapshot"} and differ(review_id="q") == set(names)


def test_import_is_all_or_none(spark):
    now = entries(spark)
    e = now.first()
    schema = "row_no int, review_id string, action string, state string, full_snapshot string, target_snapshot string, expected_set string"
    good = [(2, "r", "resolve", "old", "old", e.target_snapshot, "ㄅ"), (3, "x", "keep", None, None, None, None), (4, "y", None, None, None, None, None)]
    taken, errors = bindings.import_decisions(spark.createDataFrame(good, schema), now)
    assert [r.row_no for r in taken.collect()] == [2] and errors.count() == 0
    for row, why in [((5, "z", "confirm", "", "", "", ""), "unknown_review"), ((5, "r", "exclude", "REVIEW_PENDING", "old", "", ""), "repeated_review")]:
        taken, errors = bindings.import_decisions(spark.createDataFrame([*good, row], schema), now)
        assert taken.count() == 0 and why in {r.error for r in errors.collect()}
    for row, why in [((2, "r", "confirm", "PASS", e.full_snapshot, "", ""), "state_changed"), ((2, "r", "confirm", "REVIEW_PENDING", "old", "", ""), "evidence_changed"), ((2, "r", "resolve", "", "", "old", "ㄅ"), "target_changed"), ((2, "r", "resolve", "", "", e.target_snapshot, ""), "no_reading"), ((2, "r", "odd", "", "", "", ""), "unknown_action")]:
        assert [r.error for r in bindings.import_decisions(spark.createDataFrame([row], schema), now)[1].collect()] == [why]
    assert bindings.import_decisions(spark.createDataFrame([(2, "r", "confirm", "REVIEW_PENDING", e.full_snapshot, "", "")], schema), now)[0].count() == 1


def test_bindings_and_revocation(spark):
    rows = spark.createDataFrame([("r", "t", "b"), ("s", "t", "b")], "review_id string, target_snapshot string, baseline_snapshot string")
    made = bindings.sealed(spark.createDataFrame([("r", "s1", "f", "t", "b", "x", "x"), ("s", "s1", "f", "t", "old", "x", "x"), ("q", "s1", "f", "t", "b", "x", "x")], "review_id string, session_id string, fingerprint string, target_snapshot string, baseline_snapshot string, resolution string, event_resolution string"))
    broken = made.filter("review_id = 'r'").withColumn("resolution", F.lit("y")).withColumn("review_id", F.lit("s"))
    assert {(r.review_id, r.binding) for r in bindings.judged_bindings(rows, made.unionByName(broken), "s1", "f").collect()} == {("r", "BOUND"), ("s", "STALE"), ("s", "MALFORMED"), ("q", "STALE")}
    events = spark.createDataFrame([("a", "confirm", "ㄅ", "e", "c", {"g": True}), ("b", "confirm", "ㄅ", "", "c", {"g": True}), ("c", "exclude", None, None, None, None), ("d", "confirm", "ㄅ", "e", "c", {"g": True})], "review_id string, action string, expected_set string, evidence string, context_evidence string, gates map<string,boolean>")
    after = {r.review_id: (r.action, r.gates) for r in bindings.revoked(events, spark.createDataFrame([("a",), ("b",), ("c",)], "review_id string")).collect()}
    assert after == {"a": ("resolve", None), "c": ("exclude", None), "d": ("confirm", {"g": True})}


def test_staging_conflicts_and_library(spark):
    now = spark.createDataFrame([("a", "t1", "p"), ("b", "t2", "p"), ("c", "t3", "p")], "k string, token string, payload string")
    changes = spark.createDataFrame([("a", 1, "ack", "t1", None), ("b", 1, "add", "t4", "q"), ("b", 2, "ack", "t2", None), ("c", 1, "remove", None, None), ("c", 2, "add", "t5", "r"), ("d", 1, "add", "t6", "s")], "k string, seq int, op string, token string, payload string")
    assert {tuple(r) for r in bindings.staged(now, changes, "k").collect()} == {("b", "t4", "q"), ("c", "t5", "r"), ("d", "t6", "s")}
    clash = spark.createDataFrame([("a", "1", "2"), ("b", "1", "2")], "k string, payload_a string, payload_b string")
    assert [r.k for r in bindings.open_conflicts(clash, clash.filter("k = 'a'"), ["k"]).collect()] == ["b"]
    glyphs = spark.createDataFrame([("g1", "VERIFIED_GLOBAL", "x"), ("g2", "CANDIDATE", "x"), ("g3", "QUARANTINED_CONFLICT", "x"), ("g4", "CANDIDATE", "z")], "glyph_id string, state string, reading string")
    evidence = spark.createDataFrame([("g1", "e1", "x"), ("g2", "e2", "x"), ("g2", "e3", "y"), ("g3", "e4", "x"), ("g4", "e5", "x"), ("g9", "e6", "x")], "glyph_id string, evidence_id string, reading string")
    conflicts = spark.createDataFrame([("g1", True)], "glyph_id string, open boolean")
    got = {tuple(r) for r in bindings.library_faults(glyphs, evidence, spark.createDataFrame([("g2",)], "glyph_id string"), conflicts).collect()}
    assert got == {("g1", "verified_without_approval"), ("g1", "verified_in_conflict"), ("g2", "disagreement_not_quarantined"), ("g3", "quarantined_with_reading"), ("g3", "quarantined_without_conflict"), ("g4", "reading_not_of_evidence"), ("g9", "evidence_without_glyph")}


def test_portability(spark):
    file = "file string, sha256 string, pages array<string>"
    a = spark.createDataFrame([("a1", "s1", ["p"]), ("a2", "s2", ["q", "r"]), ("a3", "s3", ["w"]), ("a4", "s4", ["w"]), ("a5", "s5", [])], file)
    b = spark.createDataFrame([("b1", "s1", ["z"]), ("b2", "t2", ["q", "r"]), ("b3", "t3", ["w"])], file)
    assert {tuple(r) for r in bindings.match_files(a, b).collect()} == {("a1", "b1", "identical"), ("a2", "b2", "equivalent")}
    x = spark.createDataFrame([("o1", "k1"), ("o2", "k2"), ("o3", "k3"), ("o4", "k3")], "occurrence_id string, anchor string")
    y = spark.createDataFrame([("n1", "k1"), ("n3", "k3"), ("n5", "k5")], "occurrence_id string, anchor string")
    pairs, faults = bindings.map_rows(x, y, ["anchor"])
    assert [tuple(r) for r in pairs.collect()] == [("o1", "n1")] and {tuple(r) for r in faults.collect()} == {("k2", "unmapped_source"), ("k3", "ambiguous"), ("k5", "unmapped_target")}
    declared, found = spark.createDataFrame([("c", "1"), ("d", "2"), ("e", "3")], "kind string, sha256 string"), spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "2")], "path string, sha256 string")
    assert {tuple(r) for r in bindings.bound_files(declared, found).collect()} == {("c", "p", "BOUND"), ("d", None, "AMBIGUOUS"), ("e", None, "MISSING")}
    legacy = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "x"), (None, "x")], "ident string, reading string")
    current = spark.createDataFrame([("1", "o1", "x"), ("2", "o2", "y"), ("4", "o4", "x")], "ident string, occurrence_id string, reading string")
    assert {(r.ident, r.occurrence_id, r.plan) for r in bindings.migration_plan(legacy, current, ["ident"]).collect()} == {("1", "o1", "MAPPED"), ("2", "o2", "CHANGED"), ("3", None, "INSUFFICIENT"), (None, None, "INSUFFICIENT")}
    targets = spark.createDataFrame([("f", 1, "v1", "h1"), ("f", 1, "v2", "h2"), ("f", 2, "v1", "h1"), ("f", 2, "v2", "h9"), ("f", 3, "v1", "h3"), ("f", 4, "v1", "h1"), ("f", 4, "v2", "h4")], "font string, glyph_id int, variant string, glyph_sha string")
    sources = spark.createDataFrame([("h1", "x"), ("h2", "x"), ("h3", "x"), ("h3", "y"), ("h4", "z")], "glyph_sha string, reading string")
    assert [tuple(r) for r in bindings.bridged(targets, sources).collect()] == [("f", 1, "x")]


def test_roster_and_review_predicates(spark):
    columns = "pdf_sha256 string, physical_page int, stable_key string, font string, font_xref int, glyph_id int, zhuyin_component_id int, char string, x0 double, y0 double, x1 double, y1 double, source_row_number int"
    row = ("a" * 64, 1, "F#12", "F", 9, 23, 12, "角", 10.0, 20.0, 30.0, 40.0, 1)
    named = ledger.with_identity(spark.createDataFrame([row, (*row[:7], "色", *row[8:12], 2)], columns)).select(*[c.split()[0] for c in columns.split(", ")], "occurrence_id", "review_id")
    assert bindings.roster_faults(named).count() == 0
    assert {r.fault for r in bindings.roster_faults(named.withColumn("char", F.lit("角"))).collect()} == {"id_not_recomputed", "review_id_not_recomputed", "fallback_identity", "collision"}
    base = named.limit(1).withColumns({"state": F.lit("REVIEW_PENDING"), "blocking_state": F.lit(None).cast("string"), "redecidable": F.lit(False), "actual": F.lit("ㄅ"), "actual_status": F.lit("RESOLVED"), "actual_evidence": F.lit("e")})
    why = lambda **c: base.withColumns({k: F.lit(v) for k, v in c.items()}).select(bindings.confirm_blocked().alias("w")).first().w
    assert why() == "" and why(state="SOURCE_INVALID") == "source_blocked" and why(state="PASS") == "not_pending" and why(state="PASS", redecidable=True) == ""
    assert why(review_id="x") == "identity_incomplete" and why(x0=99.0) == "place_invalid" and why(physical_page=0) == "place_invalid" and why(actual="") == "actual_unresolved"
    states = spark.createDataFrame([("PASS", "RESOLVED"), ("PASS", "CONFLICT"), ("SOURCE_INVALID", "CONFLICT"), ("REVIEW_PENDING", "RESOLVED")], "state string, expected_status string")
    assert [r.n for r in states.select(bindings.needs_expected_review().alias("n")).collect()] == [False, True, False, True]
    assert bindings.matches(states.withColumn("occurrence_id", F.lit("Abc")), ["PASS"], ["aB", "c"]).count() == 2 and bindings.matches(states.withColumn("occurrence_id", F.lit("Abc")), [], ["zz"]).count() == 0
    assert len({r.k for r in spark.createDataFrame([("a, b", "x"), ("a，b", "x"), ("a", "x")], "p string, q string").select(bindings.semantic_key(F.col("p"), F.col("q")).alias("k")).collect()}) == 2


def test_unknown_reviews_raise(spark):
    base = "occurrence_id string, review_id string, actual string, actual_evidence string, expected_set string, expected_evidence string, actual_status string, expected_status string, exclusion_state string, blocking_state string, state string, confirmation_gates map<string,boolean>, target_snapshot string, actual_snapshot string"
    rows = spark.createDataFrame([("o", "r", "ㄅ", "e", None, None, None, None, None, None, None, None, "t", "a")], base)
    event = "review_id string, seq int, action string, expected_set string, evidence string, target_snapshot string, actual_snapshot string, gates map<string,boolean>"
    good = spark.createDataFrame([("r", 1, "resolve", "ㄅ", "x", "t", "a", None)], event)
    assert review.replay(rows, good).first().state == "PASS"
    with pytest.raises(Exception, match="unknown reviews, such as q"):
        review.replay(rows, good.unionByName(spark.createDataFrame([("q", 1, "resolve", "ㄅ", "x", "t", "a", None)], event))).collect()


def most_distinct(sources):
    if not sources:
        return 0
    first, rest = sources[0], sources[1:]
    return max(most_distinct(rest), 1 + most_distinct([s for s in rest if all(x != y for x, y in zip(first, s, strict=True))]))


def test_independent_sources_are_exact(spark):
    rng = random.Random(6)
    glyphs = {f"g{k}": [tuple(f"{a}{rng.randrange(w)}" for a, w in zip("pft", rng.choice([(2, 9, 9), (3, 3, 3), (4, 5, 6)]), strict=True)) for _ in range(rng.randint(1, 13))] for k in range(40)}
    rows = [(g, *s, 1) for g, own in glyphs.items() for s in own] + [("none", "p", "f", "t", 0), ("g0", "px", "fx", "tx", 0), ("null", None, None, None, 1), ("null", None, "f", "t", 1)]
    many = [("many", f"p{k}", f"f{k // 2}", f"t{k}", 1) for k in range(300)] + [("hot", "p", f"f{k}", f"t{k}", 1) for k in range(3_000)]
    df = spark.createDataFrame(rows + many, "glyph_id string, project_id string, pdf_sha256 string, font_sha256 string, counts_toward_global_quorum int")
    got = {r.glyph_id: r.independent for r in review.independent_sources(df).collect()}
    assert got == {g: most_distinct(sorted(set(own))) for g, own in glyphs.items()} | {"none": 0, "null": 1, "many": 150, "hot": 1}


def test_search_without_a_cap():
    """A grid of 15 by 15 by 15 values, and odd rings in which nobody can be taken first."""
    grid = [(a, (a * b + b) % 15, (a + 2 * b) % 15) for a in range(15) for b in range(6)]
    assert review._most_distinct(sorted(set(grid))) == 15
    ring = lambda n, k: [(f"{k}p{i // 2}" if i < n - 1 or n % 2 == 0 else f"{k}x", f"{k}q{(i + 1) // 2 % (n // 2 + 1)}", f"{k}r{i}") for i in range(n)]
    rings = [s for k in range(40) for s in ring(5, k)]
    assert review._most_distinct(rings) == 40 * most_distinct(ring(5, 0))



def test_first_differing_pair_on_a_hot_key(spark):
    import random

    rng = random.Random(4)
    rows = [(k, rng.randint(0, 40), rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, 2)) for k in "ab" for _ in range(150)] + [("c", m, 1, m, m) for m in range(50)] + [("d", 1, None, 2, 3), ("d", 2, 5, 6, 7), (None, 1, 1, 1, 1), (None, 2, 2, 2, 2)]
    df = spark.createDataFrame(rows, "k string, m int, x int, y int, z int").repartition(3)
    want = {}
    for k in "abcd":
        mine = [r for r in rows if r[0] == k and None not in r]
        pairs = [(a[1], b[1]) for a in mine for b in mine if a[1] < b[1] and all(p != q for p, q in zip(a[2:], b[2:], strict=True))]
        if pairs:
            want[k] = min(pairs)
    got = {r.k: (r.first_id, r.second_id) for r in keyed.first_differing_pair(df, ["k"], "m", ["x", "y", "z"]).collect()}
    assert got == want and len(want) == 2


def test_nearest_keeps_repeated_rows(spark):
    left = spark.createDataFrame([("k", 1.0), ("k", 1.0), ("k", None), ("z", 1.0)], "k string, x double")
    right = spark.createDataFrame([("k", 3.0, 2), ("k", -1.0, 1), ("k", 900.0, 3)], "k string, y double, b int")
    assert [tuple(r) for r in matching.nearest_join(left, right, "k", "x", "y", "b", 7).collect()] == [("k", 1.0, 1, 2.0)] * 2


def test_refresh_drops_what_is_gone(spark, tmp_path):
    path = str(tmp_path)

    def run(rows):
        df = spark.createDataFrame(rows, "part string, x int")
        incremental.refresh(df, "part", "v", lambda d: d.filter("x > 0").select("x", "part"), path)
        return sorted((r.part, r.x) for r in spark.read.schema("x int, part string").parquet(f"{path}/data").collect())

    assert run([("a", 1), ("b/c", 2)]) == [("a", 1), ("b/c", 2)]
    assert run([("a", 1), ("b/c", -1)]) == [("a", 1)]
    assert run([("b/c", 5)]) == [("b/c", 5)]
