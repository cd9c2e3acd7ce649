"""The queries of this subpackage, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, embdedup, langid, manifest, oracles, packing, secretscan, simhash, substring, sufdedup, tokencount, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": langid.op1_language_id,
    "op2_embeddings": embdedup.op2_embeddings,
    "op3_packing": packing.op3_packing,
    "op4_warc": warc.op4_warc,
    "op5_token_counts": tokencount.op5_token_counts,
    "op6_simhash": simhash.op6_simhash,
    "op7_suffix_array": sufdedup.op7_suffix_array,
    "op8_substring": substring.op8_substring,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_url_filters": urlfilter.op10_url_filters,
    "op11_divergence": divergence.op11_divergence,
    "op12_secrets": secretscan.op12_secrets,
    "op13_manifest": manifest.op13_manifest,
}

ORACLES: dict[str, str] = {
    "op2_embeddings": oracles.OP2_SQL,
    "op4_warc": warc.OP4_SQL,
    "op8_substring": oracles.OP8_SQL,
    "op10_url_filters": urlfilter.OP10_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op12_secrets": secretscan.OP12_SQL,
    "op13_manifest": manifest.OP13_SQL,
}
