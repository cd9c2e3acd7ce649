"""Source divergence audit: how each source's use of words departs from its language's.

Texts are tokenised where they are; each task sends one row for each language,
source and term of what it has gathered (at most ``HELD_BYTES`` of terms at a
time), so a hot source or word costs a row for each task. One shuffle by language
and term gives a posting list per term: the sources that use it, with counts.
Terms of at least ``MIN_DOCS`` documents of a language are kept.

*Terms.* Which kept terms a source uses above its language's rate is an
upper-bound search. A group's terms lie in buckets of like counts. The value of a
term is p(count) - q(term), p rises with the count, so no term of a bucket exceeds
p(largest count) - (smallest q). Each round evaluates every group's buckets with the
highest bounds, a few more each time; a group is done once all unseen bounds are
strictly below its k-th value, since equal ones may still win by their order.

*Pairs.* The distance of two sources is a sum over all kept terms, of which most
are used by neither. Posting lists give what both use; what only one uses is a
function of its count, so a sorted sweep over the group's distinct counts with
running sums answers it for every other source at once; the terms that neither
uses all add the same. All sums are whole numbers.

Cases: null text, language and source are ``''``; documents without terms still
make their group; a language without kept terms gives pairs of value 0 and no term
rows; repeated rows are documents of their own; doc_id plays no part; extra columns
are ignored; ties go to the smaller item; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, shuffle_width, table, text_bytes

MIN_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
SMOOTHING = 5
#: Buckets for each doubling of a count, and those evaluated in a group's first round.
STEPS = 4
FIRST_BUCKETS = 8
#: Terms gathered before a task sends them, in bytes with what an entry costs.
HELD_BYTES = 128 << 20
_ENTRY = 220

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, lower-cased, and of all characters beyond ASCII."""
    return text.translate(_FOLD).split()


_COUNTED = "lang string, source string, term binary, n long, docs long"


def count_terms(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term, sent when ``most`` bytes are held; a row without a term counts the group's documents."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    groups: Counter = Counter()
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        for group, (n, docs) in held.items():
            words = list(n)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                columns = [pa.array([group[0]] * len(part)), pa.array([group[1]] * len(part)), pa.array(part, pa.binary()), pa.array([n[w] for w in part], pa.int64()), pa.array([docs[w] for w in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()
        size = 0

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), text_bytes(batch.column("text")), strict=True):
            groups[lang, source] += 1
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            counted = Counter(terms(text))
            size += sum(len(w) + _ENTRY for w in counted if w not in n)
            n.update(counted)
            docs.update(counted.keys())
            if size > most:
                yield from flush()
    yield from flush()
    if groups:
        names = [*groups]
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in names]), pa.array([g[1] for g in names]), pa.nulls(len(names), pa.binary()), pa.array([groups[g] for g in names], pa.int64()), pa.array([0] * len(names), pa.int64())], ["lang", "source", "term", "n", "docs"])


def _rate(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (count + 5) / (total + 5 * kept))`` in whole numbers; null where nothing is kept."""
    above = (count + SMOOTHING).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + kept * SMOOTHING).cast("decimal(19,0)")
    return F.when(kept > 0, F.call_function("div", above, below) + 1)


def bucket_of(count: Column) -> Column:
    """Counts that differ by less than a step of a doubling share a bucket; bounds come from what is in it."""
    return F.floor(F.log2(count) * STEPS).cast("int")


def kept_postings(counted: DataFrame, least: int) -> DataFrame:
    """``lang, term, lang_n, uses``: kept terms with ``(source, n)`` of each source that has them."""
    dealt = counted.filter("term IS NOT NULL").repartition(shuffle_width(counted.sparkSession), "lang", "term")  # one shuffle for both steps
    each = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("uses"))
    return whole.filter(F.col("docs") >= least).select("lang", F.col("term").cast("string").alias("term"), "lang_n", "uses")


def group_facts(counted: DataFrame, postings: DataFrame) -> DataFrame:
    """A row for each language and source: their totals, kept terms, and the rate of an unused term."""
    groups = counted.filter("term IS NULL").select("lang", "source").distinct()
    totals = postings.select("lang", F.explode("uses").alias("u")).groupBy("lang", F.col("u.source").alias("source")).agg(F.sum("u.n").alias("total"), F.count(F.lit(1)).alias("used"))
    langs = postings.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    facts = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "used", "kept", "lang_total"])
    return facts.withColumn("p0", _rate(F.lit(0), F.col("total"), F.col("kept")))


def term_uses(postings: DataFrame, facts: DataFrame) -> DataFrame:
    """Every kept term of every group that has it: count, rate ``p``, the language's rate ``q``, bucket."""
    each = postings.select("lang", "term", "lang_n", F.explode("uses").alias("u")).select("lang", "term", "lang_n", "u.source", "u.n")
    each = each.join(facts, ["lang", "source"])
    p, q = _rate(F.col("n"), F.col("total"), F.col("kept")), _rate(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    return each.select("lang", "source", "term", "n", p.alias("p"), q.alias("q"), "p0", bucket_of(F.col("n")).alias("bucket"))


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))


def top_terms(ws: Workspace, uses: DataFrame, k: int = TOP_TERMS) -> DataFrame:
    """``lang, source, item, value, rank`` of each group's k terms furthest above the language.

    Rounds of best-first evaluation over all groups at once; few buckets are ever
    looked into, and what a round keeps is k rows a group.
    """
    bounds = uses.groupBy("lang", "source", "bucket").agg((F.max("p") - F.min("q")).alias("bound")).filter("bound > 0")
    nth = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket"))  # a few hundred a group at most
    bounds = ws.write(bounds.withColumn("nth", nth), "bounds")
    best = None
    done, step, k_round = 0, FIRST_BUCKETS, 0
    while True:
        due = bounds.filter((F.col("nth") > done) & (F.col("nth") <= done + step))
        unseen = bounds.filter(F.col("nth") > done)
        if best is not None:
            last = best.filter(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
            open_ = F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))
            due, unseen = (b.join(last, ["lang", "source"], "left").filter(open_) for b in (due, unseen))
        if unseen.isEmpty():
            break
        seen = uses.join(due.select("lang", "source", "bucket"), ["lang", "source", "bucket"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        if best is not None:
            seen = seen.unionByName(best.drop("rank"))
        best = ws.write(seen.withColumn("rank", _rank()).filter(F.col("rank") <= k), f"best-{k_round}")
        done, step, k_round = done + step, 2 * step, k_round + 1
    return best


#: Sources of a posting list that are paired in one unit of work.
POSTING_BLOCK = 256


def shared_terms(uses: DataFrame) -> DataFrame:
    """``lang, a, b, both, excess`` for pairs of sources (a < b) that share kept terms.

    ``excess`` corrects what :func:`lone_sums` says of the shared terms. Posting lists carry
    their rates; long ones are cut into blocks that are paired in tasks of their own.
    """
    lists = uses.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("uses")).filter("size(uses) > 1")
    cut = f"transform(sequence(0, (size(uses) - 1) div {POSTING_BLOCK}), i -> slice(uses, i * {POSTING_BLOCK} + 1, {POSTING_BLOCK}))"
    blocks = lists.select("lang", "term", F.expr(cut).alias("c"))
    units = blocks.select("lang", "term", F.size("c").alias("blocks"), F.explode(F.expr("flatten(transform(c, (x, i) -> transform(slice(c, i + 1, size(c)), (y, j) -> struct(x, y, j = 0 AS own))))")).alias("u"))
    spread = units.filter("blocks > 1").repartition(shuffle_width(uses.sparkSession), F.xxhash64("lang", "term"), F.xxhash64("u.x", "u.y"))
    units = units.filter("blocks = 1").unionByName(spread)
    pairs = units.select("lang", F.explode(F.expr("flatten(transform(u.x, x -> transform(filter(u.y, y -> NOT u.own OR x.source < y.source), y -> if(x.source < y.source, struct(x AS a, y AS b), struct(y AS a, x AS b)))))")).alias("p"))
    pairs = pairs.select("lang", F.col("p.a.source").alias("a"), F.col("p.b.source").alias("b"), F.col("p.a.p").alias("ap"), F.col("p.b.p").alias("bp"), F.col("p.a.p0").alias("a0"), F.col("p.b.p0").alias("b0"))
    excess = F.abs(F.col("ap") - F.col("bp")) - F.abs(F.col("ap") - F.col("b0")) - F.abs(F.col("bp") - F.col("a0"))
    return pairs.groupBy("lang", "a", "b").agg(F.count(F.lit(1)).alias("both"), F.sum(excess).alias("excess"))


def lone_sums(uses: DataFrame, facts: DataFrame) -> DataFrame:
    """``lang, source, item, lone``: sum over the source's terms of ``abs(p - the other's unused rate)``.

    One window for each source over its distinct counts and the other sources' rates.
    """
    counts = uses.groupBy("lang", "source", F.col("p").alias("at")).agg(F.count(F.lit(1)).alias("m"))
    counts = counts.select("lang", "source", "at", "m", F.lit(None).cast("string").alias("item"))
    others = facts.select("lang", F.col("source").alias("item"), F.col("p0").alias("at"))
    asked = facts.select("lang", "source").join(others, "lang").filter("source <> item").select("lang", "source", "at", F.lit(0).cast("long").alias("m"), "item")
    by = Window.partitionBy("lang", "source")
    upto = by.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    mass = F.col("m") * F.col("at")
    swept = counts.unionByName(asked).select("lang", "source", "item", "at", F.sum("m").over(upto).alias("n_low"), F.sum(mass).over(upto).alias("low"), F.sum("m").over(by).alias("n_all"), F.sum(mass).over(by).alias("all"))
    lone = F.col("at") * F.col("n_low") - F.col("low") + (F.col("all") - F.col("low")) - F.col("at") * (F.col("n_all") - F.col("n_low"))
    return swept.filter("item IS NOT NULL").select("lang", "source", "item", F.coalesce(lone, F.lit(0).cast("long")).alias("lone"))


def pair_distances(ws: Workspace, uses: DataFrame, facts: DataFrame) -> DataFrame:
    """``lang, source, item, value, rank`` of every source and every other of its language."""
    lone = ws.write(lone_sums(uses, facts), "lone")
    shared = shared_terms(uses)
    there = lone.filter("source < item").select("lang", F.col("source").alias("a"), F.col("item").alias("b"), F.col("lone").alias("ab"))
    back = lone.filter("source > item").select("lang", F.col("item").alias("a"), F.col("source").alias("b"), F.col("lone").alias("ba"))
    found = there.join(back, ["lang", "a", "b"]).join(shared, ["lang", "a", "b"], "left").na.fill(0, ["both", "excess"])
    for side in "ab":
        found = found.join(facts.select("lang", F.col("source").alias(side), F.col("used").alias(f"{side}_used"), F.col("p0").alias(f"{side}0"), *([F.col("kept")] if side == "a" else [])), ["lang", side])
    neither = F.col("kept") - F.col("a_used") - F.col("b_used") + F.col("both")
    value = F.col("ab") + F.col("ba") + F.col("excess") + neither * F.abs(F.col("a0") - F.col("b0"))
    found = found.withColumn("value", F.when(F.col("kept") > 0, value).otherwise(0).cast("long"))
    each = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    found = found.select("lang", "value", F.explode(each).alias("s")).select("lang", "s.source", "s.item", "value")
    return found.withColumn("rank", _rank())


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``; ``part`` is ``pair`` or ``term``."""
    ws = Workspace(docs.sparkSession, "divergence")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    most = HELD_BYTES
    counted = ws.write(rows.mapInArrow(lambda batches: count_terms(batches, most), _COUNTED), "counted")
    postings = ws.write(kept_postings(counted, min_docs), "postings")
    facts = ws.write(group_facts(counted, postings), "facts")
    ws.drop("counted")
    uses = ws.write(term_uses(postings, facts), "uses")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    found = pair_distances(ws, uses, facts).withColumn("part", F.lit("pair")).select(*columns)
    best = top_terms(ws, uses, k)
    return found if best is None else found.unionByName(best.withColumn("part", F.lit("term")).select(*columns))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


#: Every group's rate of every kept term, worked out in full.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
r AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
      CAST(1 + 1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT) // (t.total + 5 * l.v) AS BIGINT) AS p, CAST(1 + 1000000000 * CAST(k.lang_n + 5 AS HUGEINT) // (l.lang_total + 5 * l.v) AS BIGINT) AS q
      FROM t JOIN k ON k.lang = t.lang JOIN l ON l.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM r WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
"""
