"""Character and context overrides, and the block that a glyph stands in."""

from __future__ import annotations

from lanewise.operators import decode

ROWS = "occurrence_id string, pdf_sha256 string, page int, char string, stable_key string, x0 double, y0 double, cx double, cy double, line string, pos int"


def rows(spark):
    return spark.createDataFrame([("a", "p", 1, "角", "k", 10.0, 10.0, 10.0, 10.0, "角", 0), ("b", "p", 1, "角", "k", 50.0, 10.0, 50.0, 10.0, "角", 0), ("c", "p", 2, "色", "k", 10.0, 10.0, 10.0, 10.0, "色", 0)], ROWS)


def test_character_override_keeps_the_original(spark):
    overrides = spark.createDataFrame([("p", 1, "角", 10.7, 9.4, "甪", "k", 1), ("p", 1, "角", 50.9, 10.0, "甪", "k", 2), ("p", 2, "角", 10.0, 10.0, "甪", "k", 3)], "pdf_sha256 string, page int, char string, x0 double, y0 double, corrected_char string, stable_key string, file_order int")
    got = {r.occurrence_id: (r.char, r.original_char) for r in decode.override_characters(rows(spark), overrides).collect()}
    assert got == {"a": ("甪", "角"), "b": ("角", None), "c": ("色", None)}


def test_context_override_must_hold_the_character(spark):
    overrides = spark.createDataFrame([("p", 1, "角", 10.9, 10.0, "主角", 1, "k", 2), ("p", 1, "角", 50.0, 10.0, "主角", 0, "k", 1), ("p", 1, "角", 50.0, 10.0, "主角", 1, "k", 5)], "pdf_sha256 string, page int, char string, x0 double, y0 double, context_text string, target_index int, stable_key string, file_order int")
    got = {r.occurrence_id: (r.line, r.pos, r.context_repaired) for r in decode.override_contexts(rows(spark), overrides).collect()}
    assert got == {"a": ("主角", 1, True), "b": ("角", 0, False), "c": ("色", 0, False)}


def test_near_ties_prefer_the_longer_block(spark):
    chars = [("p", 1, "角", 10.0, 10.0, 7, 0, "角"), ("p", 1, "角", 10.5, 10.2, 3, 1, "主角登場"), ("p", 1, "角", 12.0, 10.0, 1, 2, "更長的一行角色"), ("p", 1, "角", 49.0, 10.0, 9, 0, "角色"), ("p", 1, "角", 51.0, 10.0, 8, 0, "角色"), ("p", 1, "甪", 10.0, 10.0, 4, 0, "甪")]
    table = spark.createDataFrame(chars, "pdf_sha256 string, page int, char string, cx double, cy double, block_no int, char_no int, text string")
    got = {r.occurrence_id: (r.block_no, r.char_no, r.text) for r in decode.located_blocks(rows(spark), table).collect()}
    assert got == {"a": (3, 1, "主角登場"), "b": (8, 0, "角色")}
