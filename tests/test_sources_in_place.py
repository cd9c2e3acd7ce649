"""Small glyphs are searched in place, large ones over tables, with the same numbers."""

from __future__ import annotations

import random

from lanewise.operators import review


def test_small_and_large_glyphs_agree(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(str(k % 12), *(rng.choice("abcd") for _ in range(3)), k % 9 and 1) for k in range(150)] + [("none", "a", "a", "a", 0), ("null", None, "a", "b", 1), ("null", "", "a", "c", 1)]
    df = spark.createDataFrame(rows, "glyph_id string, project_id string, pdf_sha256 string, font_sha256 string, counts_toward_global_quorum int")
    asked = []
    large = review._of_large
    monkeypatch.setattr(review, "_of_large", lambda *args: asked.append(1) or large(*args))
    few = {r.glyph_id: r.independent for r in review.independent_sources(df).collect()}
    assert asked == []
    monkeypatch.setattr(review, "FEW_ROWS", 10)
    assert {r.glyph_id: r.independent for r in review.independent_sources(df).collect()} == few and asked == [1]
    assert few["none"] == 0 and few["null"] == 1
