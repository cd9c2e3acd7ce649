from __future__ import annotations

from lanewise.plans import match_plans


def test_containment_join_needs_the_whole_text(spark, tmp_path):
    item = "An opening of forty characters and more, then the part that decides."
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, f"before {item} after"), (2, f"before {item[:40]} something else"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = match_plans.QUERIES["containment_join"](spark, str(tmp_path))
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, 1)]
