"""A corpus pipeline of five stages over ``documents``.

Each stage is a function of (spark, docs, sf_dir), where ``docs`` is what the
stage before it kept, and returns the columns of ``documents`` (the last one
returns the packed sequences' pieces). All columns but the text pass unchanged;
a stage that changes the text sets ``n_chars`` to the new length.

* language ID drops documents without letters and those whose language the
  model rejects (its threshold keeps confident documents of every language);
* SimHash near-dedup keeps the smallest doc_id of each group of documents whose
  sets of five-word shingles have a Jaccard similarity of 0.8 or more; it is
  counted on the sets, for pairs that SimHash groups and pivot tables find;
* suffix-array dedup removes bytes of repeated 100-byte strings, then the
  documents of which nothing is left; a cut inside a character drops its bytes;
* decontamination drops documents that hold a benchmark item within the error
  budget;
* best-fit packing gives every token of every kept document its place.

Cases: null doc_ids are dropped by the second stage, null texts by the first;
repeated rows with one doc_id are one document to the second stage, which keeps
all rows of the document it keeps; empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import decontaminate, langid, neardup, packing, sufdedup
from lanewise.llm.common import Workspace, named

SHINGLE_WORDS = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = langid.predictions(docs, langid.train(langid.sample(docs)), docs.columns)
    return judged.filter("NOT rejected").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = neardup.near_groups(docs, SHINGLE_WORDS)
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi")


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = sufdedup.remove_repeats(docs, lambda kept: kept.decode("utf-8", "ignore"), pa.string(), "string", docs.columns)
    columns = {c: named(c, "row").alias(c) for c in docs.columns}
    columns["text"] = F.col("kept").alias("text")
    if "n_chars" in columns:
        columns["n_chars"] = F.length("kept").cast(dict(docs.dtypes)["n_chars"]).alias("n_chars")
    return cut.filter(F.trim("kept") != "").select(*columns.values())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, benchmark)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_strings),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is written, and read again as the next stage's ``docs``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return docs
