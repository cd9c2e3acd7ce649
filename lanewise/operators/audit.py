"""Counts, checks and digests of whole tables: what a report shows and what a run must not have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import ledger


def structural_rollup(rows: DataFrame, reading: str, keys: Sequence[str]) -> DataFrame:
    """Per key: occurrences, decoded and undecoded ones."""
    seen = F.coalesce(F.col(reading), F.lit("")) != ""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"), F.count_if(seen).alias("decoded"), F.count_if(~seen).alias("undecoded"))


def hits(rows: DataFrame, key: str) -> DataFrame:
    """How often each value occurs, and its place: most frequent first, then by value.

    The counts are ranked inside ranges of equal counts, so no task orders them all.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select("n", F.coalesce(F.sum("_c").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # one row per distinct count
    return counts.join(before, "n").select(key, "n", (F.col("_b") + F.row_number().over(Window.partitionBy("n").orderBy(key))).alias("place"))


def distribution(rows: DataFrame, keys: Sequence[str], place: str, most: int = 20) -> DataFrame:
    """Per key: rows, and the first ``most`` distinct places in order."""
    places = rows.select(*keys, place).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(place))).filter(F.col("_k") <= most)
    few = places.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(place)).cast("array<string>"), ",").alias("places"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(few, list(keys), "left")


def file_coverage(rows: DataFrame, file: str) -> DataFrame:
    """Per file of a ledger: rows, rows in scope, and the share of them that each lane covers (0 where none is)."""
    inside = ~F.coalesce("state", F.lit("")).isin(*ledger.EXCLUDED)
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    actual = inside & filled("actual") & filled("actual_evidence")
    expected = inside & (F.col("expected_status") == "RESOLVED") & filled("expected_evidence")
    found = rows.groupBy(file).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(inside).alias("in_scope"), F.count_if(actual).alias("a"), F.count_if(expected).alias("e"))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("in_scope").cast("double")), F.lit(0.0)), 6)
    return found.select(file, "n_rows", "in_scope", share("a").alias("actual_coverage"), share("e").alias("expected_coverage"))


def tree_digest(rows: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """One row: the digest of a table, whatever its order and size.

    Rows are hashed; the hashes are sorted and hashed inside the parts that the
    first ``digits`` of the key's own hash make, and the parts' digests once more.
    Only one digest a part meets in the last task.
    """
    whole = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    hashed = rows.select(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, digits).alias("part"), whole.alias("h"))
    parts = hashed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), "")
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.sha2(joined, 256).alias("digest"))


def unequal_reports(rows: DataFrame, case: str, values: Sequence[str]) -> DataFrame:
    """Cases whose reports differ between partitions, and in how many ways."""
    whole = F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256)
    return rows.groupBy(case).agg(F.count_distinct(whole).alias("versions")).filter("versions > 1")


def union_of_views(views: dict[str, DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """One table of several disjoint views with ``source_view``, and the keys that stand in more than one."""
    every = None
    for name, view in views.items():
        rows = view.withColumn("source_view", F.lit(name))
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
    overlap = every.groupBy(key).agg(F.count_distinct("source_view").alias("n_views")).filter("n_views > 1")
    return every, overlap


def roster_difference(required: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is required and missing, and what is present and not required."""
    a, b = required.select(*keys).distinct().withColumn("_r", F.lit(True)), present.select(*keys).distinct().withColumn("_p", F.lit(True))
    both = a.join(b, list(keys), "full")
    return both.filter("_r IS NULL OR _p IS NULL").select(*keys, F.when(F.col("_p").isNull(), "missing").otherwise("unexpected").alias("fault"))


def all_values(*cells: Column) -> Column:
    """The union of the values of several array cells, sorted and joined."""
    empty = F.array().cast("array<string>")
    found = F.flatten(F.array(*(F.coalesce(c, empty) for c in cells)))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda v: F.coalesce(v, F.lit("")) != ""))), "|")


def first_faults(faults: DataFrame, kind: str, order: str, most: int = 20) -> DataFrame:
    """The first ``most`` faults of each kind, with how many there are."""
    counts = faults.groupBy(kind).agg(F.count(F.lit(1)).alias("n_faults"))
    few = faults.withColumn("nth", F.row_number().over(Window.partitionBy(kind).orderBy(order))).filter(F.col("nth") <= most)
    return few.join(counts, kind)


def broken_references(rows: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose reference has no parent; a reference with a null part is none."""
    return rows.dropna(subset=list(keys)).join(parents.select(*keys), list(keys), "left_anti")


def failed_conditions(current: DataFrame, conditions: DataFrame, key: str, value: str) -> DataFrame:
    """What was to hold after a change and doesn't: ``key, wanted, fault``."""
    rows = conditions.select(key, F.col(value).alias("wanted")).join(current.select(key, F.col(value).alias("_now"), F.lit(True).alias("_here")), key, "left")
    fault = F.when(F.col("_here").isNull(), "gone").when(~F.col("_now").eqNullSafe(F.col("wanted")), "other_value")
    return rows.withColumn("fault", fault).filter("fault IS NOT NULL").select(key, "wanted", "fault")


def path_faults(assets: DataFrame) -> DataFrame:
    """Declared assets with a faulty path: one that leaves its root, or a name or path given twice.

    ``assets``: ``name, path``.
    """
    path = F.replace(F.coalesce("path", F.lit("")), F.lit("\\"), F.lit("/"))
    away = (path == "") | F.startswith(path, F.lit("/")) | path.rlike("^[A-Za-z]:") | F.array_contains(F.split(path, "/"), "..")
    outside = assets.filter(away).select("name", "path", F.lit("outside_root").alias("fault"))
    twice = lambda c, fault: assets.groupBy(F.lower(c).alias("_c")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"), F.min("path").alias("path")).filter("n > 1").select("name", "path", F.lit(fault).alias("fault"))
    return outside.unionByName(twice("name", "repeated_name")).unionByName(twice("path", "repeated_path"))


def digest_faults(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Assets whose bytes aren't those that are pinned: ``path, fault``.

    ``declared``: ``path, sha256``; ``found``: ``path, content`` as ``binaryFile`` reads it.
    """
    now = found.select("path", F.sha2("content", 256).alias("_now"))
    rows = declared.join(now, "path", "left")
    fault = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.lower("sha256"), "changed")
    return rows.withColumn("fault", fault).filter("fault IS NOT NULL").select("path", "fault")


def reading_cell(value: Column, mode: str) -> Column:
    """Readings of a cell, empty if any part is none: ``single``, ``syllable_sequence`` or ``annotated_single``."""
    parts = F.transform(F.split(F.trim(F.coalesce(value, F.lit(""))), "[;；|]"), lambda x: F.trim(x))
    if mode == "syllable_sequence":
        parts = F.filter(F.flatten(F.transform(parts, lambda x: F.split(x, r"\s+"))), lambda x: x != "")

    def one(part: Column) -> Column:
        plain = scalars.comparator_reading(part)
        if mode != "annotated_single":
            return plain
        bare = F.regexp_extract(part, f"^([{scalars.LETTERS}{scalars.TONES}]+)(?:語|讀|限讀)$", 1)
        return F.when(plain != "", plain).otherwise(bare)

    read = F.transform(parts, one)
    return F.when(F.exists(read, lambda r: r == ""), F.array().cast("array<string>")).otherwise(read)


def reading_faults(rows: DataFrame, key: str, column: str, mode: str, exempt: Sequence[str] = (), allow_empty: bool = True) -> DataFrame:
    """Cells that hold no reading and should: ``key, value``."""
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    bad = (F.size(reading_cell(text, mode)) == 0) | (text == "")
    if allow_empty:
        bad = bad & (text != "")
    if exempt:
        bad = bad & ~text.isin(*exempt)
    return rows.filter(bad).select(key, text.alias("value"))
