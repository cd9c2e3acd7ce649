"""Benchmark items below 25 characters are looked for like all others."""

from __future__ import annotations

from lanewise.llm import decontaminate


def test_short_items_are_found_and_marked(spark):
    items = [(1, "Seven  Score"), (2, "abcdefghijklmnopqrstuvw"), (3, ""), (4, None), (5, "x" * 25), (6, " \n"), (7, "seven score and twelve")]
    texts = ["we say seven\nscore here", "seven scor", "abcdefghijkmnopqrstuvw", "abcdefghijklm12nopqrstuvw", "x" * 24, "", None, "seven score", "seven score and twelwe"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.distance, r.short) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, 1): (0, True), (7, 1): (0, True), (8, 1): (0, True), (2, 2): (1, True), (4, 5): (1, False), (8, 7): (1, True)}
