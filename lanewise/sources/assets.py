"""Declared CSV assets: read with their contract, checked in full, or not at all."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AssetSpec:
    """Columns that must be there, the unique key, and the rows at least expected."""

    name: str
    columns: Sequence[str]
    key: Sequence[str] = ()
    least_rows: int = 0
    exact_rows: int | None = None
    required: Sequence[str] = field(default_factory=tuple)


def read_csv(spark: SparkSession, path: str, spec: AssetSpec) -> DataFrame:
    """All cells as trimmed text, blank for missing; demands the declared header."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, quote='"', escape='"', inferSchema=False)
    names = [c.lstrip("﻿").strip() for c in raw.columns]
    if any(not n or n.startswith("_c") for n in names) or len(set(names)) != len(names):
        raise ValueError(f"{spec.name}: blank or repeated header")
    missing = [c for c in spec.columns if c not in names]
    if missing:
        raise ValueError(f"{spec.name}: missing columns {missing}")
    return raw.toDF(*names).select(*(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in names))


def violations(df: DataFrame, spec: AssetSpec) -> DataFrame:
    """Everything that breaks the contract: ``(asset, violation, detail, n)``."""
    row = lambda kind, detail, n: (F.lit(spec.name).alias("asset"), F.lit(kind).alias("violation"), detail.alias("detail"), n.alias("n"))
    found = df.groupBy().agg(F.count(F.lit(1)).alias("c"))
    bad_count = (F.col("c") < spec.least_rows) if spec.exact_rows is None else (F.col("c") != spec.exact_rows)
    result = found.filter(bad_count).select(*row("row_count", F.lit(""), F.col("c")))
    for column in spec.required:
        blank = df.filter(F.col(column) == "").groupBy().agg(F.count(F.lit(1)).alias("c")).filter("c > 0")
        result = result.unionByName(blank.select(*row("blank_cell", F.lit(column), F.col("c"))))
    if spec.key:
        text = F.concat_ws("|", *spec.key)
        repeated = df.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("c"), F.count_distinct(F.struct(*df.columns)).alias("v")).filter("c > 1")
        kind = F.when(F.col("v") > 1, "conflicting_key").otherwise("repeated_key")
        result = result.unionByName(repeated.select(F.lit(spec.name).alias("asset"), kind.alias("violation"), text.alias("detail"), F.col("c").alias("n")))
        empty = df.filter(text == "|" * (len(spec.key) - 1)).groupBy().agg(F.count(F.lit(1)).alias("c")).filter("c > 0")
        result = result.unionByName(empty.select(*row("blank_key", F.lit(""), F.col("c"))))
    return result


def in_scope(df: DataFrame, stem: str, include: str = "pdf_contains", exclude: str | None = None) -> DataFrame:
    """Rows whose scope names this file: a blank scope fits all, an exclusion list rules out."""
    name = F.lit(stem)
    fits = (F.coalesce(F.col(include), F.lit("")) == "") | F.contains(name, F.col(include))
    if exclude:
        fits = fits & ~F.exists(F.split(F.coalesce(F.col(exclude), F.lit("")), r"[;,|]"), lambda x: (F.trim(x) != "") & F.contains(name, F.trim(x)))
    return df.filter(fits)


def list_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of one folder by name, with size, time and SHA-256 of their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256")).orderBy("path")
