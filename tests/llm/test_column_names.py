"""Extra columns with odd and clashing names pass every stage of the pipeline unchanged."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F


def test_odd_names_pass(spark, tmp_path):
    rng = random.Random(8)
    words = {"en": ["the", "house", "with", "river", "and", "stone"], "de": ["das", "haus", "und", "der", "fluss", "stein"]}
    text = lambda lang: " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "n"]) for _ in range(60))
    rows = [(k, text(lang := ("en", "de")[k % 2]), lang, "s", 0) for k in range(60)]
    odd = {"a.b": 1, "c`d": 2, "row": 3, "spans": 4, "kept": 5, "kept_id": 6, "score": 7, "x y": 8}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumns({name: F.col("doc_id") * 10 + k for name, k in odd.items()})
    spark.createDataFrame([(1, "nothing that is said anywhere in here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.Workspace(spark, "names").write(stage(spark, docs, str(tmp_path)), "docs")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *odd]
        rows = docs.collect()
        assert len(rows) > 40 and all(r[name] == r["doc_id"] * 10 + k for r in rows for name, k in odd.items())
    assert corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).count() >= len(rows)
