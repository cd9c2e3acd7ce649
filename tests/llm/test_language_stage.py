"""The pipeline's language stage keeps exactly the rows its model doesn't reject, judged text by text."""

from __future__ import annotations

import random

import corpus_pipeline
from lanewise.llm import langid

ENGLISH = "the of and to in that was his with for as had you not be her is at on by which".split()
GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()


def test_language_stage_keeps_exactly_what_the_model_accepts(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice((ENGLISH, GERMAN)[k % 2]) for _ in range(30)), ("en", "de")[k % 2]) for k in range(120)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "12 34 !?", "en"), (203, "qqq zzz xxx", None), (204, "zażółć gęślą jaźń", None), (205, "der the und and", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(langid.sample(docs))
    want = sorted((i, t, lang) for i, t, lang in rows if not model.predict(t)[2])
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.lang) for r in kept.collect()) == want
    assert {i for i, _, _ in want} >= set(range(120)) and not {i for i, _, _ in want} & {200, 201, 202}
