"""Joins on tolerance, nearness, containment, patterns and dictionary windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a side counts as small enough to be sent to every task.
SMALL_ROWS = 50_000
#: Characters of phrases that one automaton takes.
BLOCK_CHARS = 4 << 20


def is_small(df: DataFrame, most: int = SMALL_ROWS) -> bool:
    """Whether a table has at most ``most`` rows; reads no more than that."""
    return df.limit(most + 1).count() <= most


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str, tolerance: float, how: str = "inner") -> DataFrame:
    """Rows with equal keys whose values differ by at most ``tolerance``.

    The right side is copied to the cell of its value and both neighbours, so
    the join is on keys and cell, and no key meets all of its rows at once.
    ``how`` is inner, left_semi or left_anti.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(tolerance))
    near = right.withColumn("_cell", F.explode(F.array(*(cell(right_value) + d for d in (-1, 0, 1)))))
    own = left.withColumn("_cell", cell(left_value))
    if how == "inner":
        return own.join(near, [*keys, "_cell"]).filter(F.abs(F.col(left_value) - F.col(right_value)) <= tolerance).drop("_cell")
    condition = F.abs(own[left_value] - near[right_value]) <= tolerance
    for k in [*keys, "_cell"]:
        condition = condition & (own[k] == near[k])
    return own.join(near, condition, how).drop("_cell")


def nearest_join(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str, right_id: str, width: float) -> DataFrame:
    """For each left row the right row of its key with the nearest value, ties to the least id.

    Values are cut into cells of ``width``. Within a cell both sides are merged in
    order of value, and each left row looks at the right rows just before and after
    it; across empty cells only each cell's lowest and highest row count, and a
    window over cells (not rows) carries them to the neighbours. So a dense cell
    costs a sort, not its pairs. Left rows are kept as often as they occur; those
    without a key, a value or any right row of their key are left out.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    points = right.filter(F.col(right_value).isNotNull()).groupBy(key, F.col(right_value).alias("_at")).agg(F.min(right_id).alias("_id"))
    points = points.select(key, F.floor(F.col("_at") / width).alias("_cell"), "_at", F.struct(F.col("_at").alias("v"), F.col("_id").alias("i")).alias("_p"))
    own = left.filter(F.col(left_value).isNotNull() & F.col(key).isNotNull()).select(key, cell(left_value).alias("_cell"), F.col(left_value).alias("_at"), F.struct(*left.columns).alias("_row"))
    edges = points.groupBy(key, "_cell").agg(F.min("_p").alias("_low"), F.max("_p").alias("_high"))
    wanted = own.select(key, "_cell").distinct().join(edges, [key, "_cell"], "full")
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(key).orderBy("_cell").rowsBetween(1, Window.unboundedFollowing)
    sides = wanted.select(key, "_cell", F.last("_high", True).over(before).alias("_left"), F.first("_low", True).over(after).alias("_right"))
    merged = own.unionByName(points, allowMissingColumns=True)
    w = Window.partitionBy(key, "_cell").orderBy("_at", F.col("_row").isNotNull())
    near = merged.withColumns({"_b": F.last("_p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_a": F.first("_p", True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    found = near.filter(F.col("_row").isNotNull()).join(sides, [key, "_cell"])
    sought = F.filter(F.array("_b", "_a", "_left", "_right"), lambda p: p.isNotNull())
    best = F.array_min(F.transform(sought, lambda p: F.struct(F.abs(F.col("_at") - p["v"]).alias("d"), p["i"].alias("i"))))
    found = found.withColumn("_best", best).filter(F.col("_best").isNotNull())
    return found.select("_row.*", F.col("_best.i").alias(right_id), F.col("_best.d").alias("distance"))


def phrase_blocks(phrases: DataFrame, phrase: str, most: int) -> Iterator[list[str]]:
    """The distinct phrases that aren't empty, about ``most`` characters at a time."""
    held, size = [], 0
    for row in phrases.select(phrase).filter(F.length(phrase) > 0).distinct().toLocalIterator():
        if held and size + len(row[0]) > most:
            yield held
            held, size = [], 0
        held.append(row[0])
        size += len(row[0])
    if held:
        yield held


def contain_join(texts: DataFrame, text: str, phrases: DataFrame, phrase: str, most: int = BLOCK_CHARS) -> DataFrame:
    """Texts with the phrases they contain; empty phrases and nulls match nothing.

    The phrases go to the tasks in blocks of at most ``most`` characters, each as
    one automaton that reads every text once, so the work grows with the length of
    the texts and not with texts times phrases; what is found joins the phrases'
    own rows. Texts aren't shuffled.
    """
    schema = f"{', '.join(f'`{c}` {t}' for c, t in texts.dtypes)}, _found string"
    result = texts.withColumn("_found", F.lit(None).cast("string")).limit(0)
    columns = texts.columns
    for block in phrase_blocks(phrases, phrase, most):
        shared = texts.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for p in shared.value:
                automaton.add_word(p, p)
            automaton.make_automaton()
            for batch in batches:
                rows, found = [], []
                for k, t in enumerate(batch.column(text)):
                    here = {p for _, p in automaton.iter(t.as_py())} if t.is_valid else ()
                    rows += [k] * len(here)
                    found += sorted(here)
                some = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found, pa.string())], [*columns, "_found"])

        result = result.unionByName(texts.mapInArrow(run, schema))
    return result.join(phrases, F.col("_found") == F.col(phrase)).drop("_found")


def first_pattern(df: DataFrame, column: Column, patterns: Sequence[tuple[str, str]], out: str) -> DataFrame:
    """The name of the first pattern (in order) that the column matches, else null."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        found = F.when(column.rlike(pattern), F.lit(name)).otherwise(found)
    return df.withColumn(out, found)


def word_windows(df: DataFrame, words: str, least: int, most: int) -> DataFrame:
    """Every run of ``least``..``most`` words as ``gram`` with its ``size``."""
    grams = F.expr(
        f"flatten(transform(sequence({least}, {most}), n -> CASE WHEN size(`{words}`) < n THEN array() ELSE "
        f"transform(sequence(1, size(`{words}`) - n + 1), i -> named_struct('gram', array_join(slice(`{words}`, i, n), ' '), 'size', n)) END))"
    )
    return df.withColumn("_g", F.explode(grams)).select("*", "_g.gram", "_g.size").drop("_g")


def longest_entry(df: DataFrame, key: str, words: str, dictionary: DataFrame, least: int, most: int) -> DataFrame:
    """Per key the longest dictionary entry among its word windows, the first by text of equals."""
    hits = word_windows(df.select(key, words), words, least, most).select(key, "gram", "size").distinct().join(dictionary, "gram")
    return hits.groupBy(key).agg(F.min(F.struct((-F.col("size")).alias("s"), "gram")).alias("_b")).select(key, F.col("_b.gram").alias("entry"), (-F.col("_b.s")).alias("size"))
