"""Nulls, repeated rows, clashing names and empty tables, operator by operator and stage by stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lanewise.llm import decontaminate, embdedup, langid, simhash, substring, sufdedup, tokencount, urlfilter, warc
from lanewise.llm.common import Workspace, join_hot

LONG = "some words that come again and again in a text of no great length but of more than one hundred bytes " * 3
ROWS = [(1, "der die das", "de"), (1, "der die das", "de"), (2, None, None), (None, "the and of", "en"), (3, "", "en"), (4, LONG, "en"), (4, LONG, "en"), (5, "x" + LONG, "en"), (6, "1 2 3", None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(2)
    return df.select("*", *(F.lit(9).alias(c) for c in ("row", "words", "n", "key", "fp", "rep", "spans", "found", "kept")))


def test_join_hot_is_a_plain_join(spark):
    left = spark.createDataFrame([(k, i) for k in range(3) for i in range(1500 if k == 0 else 2)], "key int, i int")
    right = spark.createDataFrame([(0, "a", 1500), (1, "b", 2), (2, "c", 2), (9, "d", 0)], "key int, v string, n long")
    got = sorted(tuple(r) for r in join_hot(left, right, "key").select("key", "i", "v").collect())
    assert got == sorted(tuple(r) for r in left.join(right.drop("n"), "key").select("key", "i", "v").collect())


def test_repeated_rows_and_null_ids(spark, docs):
    model = langid.train(langid.sample(docs))
    assert sorted((r.row.doc_id or 0) for r in langid.predictions(docs, model, ["doc_id"]).collect()) == [0, 1, 1, 2, 3, 4, 4, 5, 6]
    counted = tokencount.token_counts(docs, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted((r.doc_id or 0, r.n_bytes) for r in counted.collect()) == sorted((i or 0, len(t or "")) for i, t, _ in ROWS)
    prints = simhash.simhash_groups(docs).collect()
    assert sorted(r.doc_id for r in prints) == [1, 2, 3, 4, 5, 6]
    two = spark.createDataFrame([(7, "a b c d"), (7, "e f g h"), (8, "e f g h")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.simhash_groups(two).collect()) == [(7, 7), (7, 7), (8, 7)]
    removed = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring._apply(docs, lambda kept: kept.decode(), "kept string").collect())
    assert removed == [(1, 3, 0), (1, 3, 0), (2, 0, 0), (3, 0, 0), (4, 63, 0), (4, 63, 0), (5, 63, 62), (6, 3, 0)]
    import pyarrow as pa

    cut = sufdedup.remove_repeats(docs, bytes, pa.binary(), "binary", ["doc_id"]).collect()
    assert sorted(r.row.doc_id for r in cut) == [1, 1, 2, 3, 4, 4, 5, 6]
    bench = spark.createDataFrame([(1, "der die das"), (1, "der die das")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.contaminated(docs, bench).collect()) == [1, 1, 1, 1]
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and sorted((r.doc_id or 0) for r in clean.collect()) == [0, 2, 3, 4, 4, 5, 6]
    for most in (5, 1 << 20):  # block by block as well
        assert decontaminate.clean(docs, bench, most=most).count() == 7


def test_vectors_pages_and_urls(spark):
    v = spark.createDataFrame([(None, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a")], "vec_id long, embedding array<double>, label string")
    assert sorted(tuple(r) for r in embdedup.embedding_groups(v).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]
    pages = spark.createDataFrame([(None, "u", "h"), (1, "http://org/", "h"), (1, "http://org/", "h"), (2, "a\r\nb", "h" * 100)], "page_id long, url string, html string")
    got = warc.read_archive(*warc.write_archive(Workspace(spark, "t"), pages))
    assert sorted(r.page_id for r in warc.records(got).collect()) == [1, 1, 2]
    assert [bytes(r.header).decode().split("\r\n")[2] for r in got.filter("page_id = 2").collect()] == ["WARC-Target-URI: a%0D%0Ab"]
    assert sorted((r.page_id or 0, r.rule or "") for r in urlfilter.filter_urls(pages).collect()) == [(0, ""), (1, "org/"), (1, "org/"), (2, "")]


def test_a_lost_payload_of_a_revisit_is_seen(spark):
    pages = spark.createDataFrame([(1, "u", "h" * 200), (2, "u", "h" * 200), (3, "u", "k")], "page_id long, url string, html string")
    headers, payloads = warc.write_archive(Workspace(spark, "t"), pages)
    revisits = headers.filter("kind = 'revisit'")
    for broken in (payloads.filter("octet_length(payload) < 100"), payloads.withColumn("payload", F.lit(b"other"))):
        with pytest.raises(Exception, match="fails its digest"):
            warc.records(warc.read_archive(revisits, broken)).collect()
    assert [(r.page_id, r.payload_bytes, r.refers_to) for r in warc.records(warc.read_archive(revisits, payloads)).collect()] == [(2, 200, 1)]


def test_pipeline_stages_take_all_cases(spark, docs, tmp_path):
    spark.createDataFrame([(1, "never said in any text of these")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        kept, nothing = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
        assert nothing.count() == 0, name
        if name != "best_fit_packing":
            assert kept.columns == nothing.columns == docs.columns
        ids = sorted({r.doc_id for r in kept.collect() if r.doc_id})
        assert ids == {"language_id": [1, 4, 5], "simhash_near_dedup": [1, 2, 4, 6], "suffix_array_dedup": [1, 4, 5, 6], "benchmark_decontamination": [1, 2, 3, 4, 5, 6], "best_fit_packing": [1, 2, 3, 4, 5, 6]}[name], name
