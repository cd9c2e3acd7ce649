"""The pipeline writes each stage's result and reads it again for the next."""

from __future__ import annotations

import corpus_pipeline


def test_every_stage_reads_what_the_one_before_wrote(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    read = []

    def stage(spark, docs, sf_dir):
        read.append(docs.inputFiles())
        return docs.filter("doc_id > 0")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", stage), ("second", stage), ("third", stage)])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]
    assert all("/documents.parquet/" in f for f in read[0])
    for at, files in (("first", read[1]), ("second", read[2]), ("third", out.inputFiles())):
        assert files and all(f"/{at}/" in f for f in files)
