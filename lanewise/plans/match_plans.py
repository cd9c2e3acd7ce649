"""Tolerance, nearest, containment, pattern and dictionary joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import matching, sequence
from .tables import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _people(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    customers = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    suppliers = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    return customers, suppliers


@query("""
SELECT c_custkey, min(s_suppkey) AS s_suppkey, count(*) AS n_near FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 250 GROUP BY 1""")
def band_join_tolerance(spark: SparkSession, d: str) -> DataFrame:
    customers, suppliers = _people(spark, d)
    near = matching.band_join(customers, suppliers, ["nation"], "c_acctbal", "s_acctbal", 250)
    return near.groupBy("c_custkey").agg(F.min("s_suppkey").alias("s_suppkey"), F.count(F.lit(1)).alias("n_near"))


@query("""
SELECT c_custkey, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 250)""")
def band_anti_join(spark: SparkSession, d: str) -> DataFrame:
    customers, suppliers = _people(spark, d)
    return matching.band_join(customers, suppliers, ["nation"], "c_acctbal", "s_acctbal", 250, "left_anti").select("c_custkey", "c_acctbal")


@query("""
WITH r AS (SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) AS dist, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) AS n FROM supplier JOIN customer ON c_nationkey = s_nationkey)
SELECT s_suppkey, c_custkey, CAST(dist AS DECIMAL(18,4)) AS distance FROM r WHERE n = 1""")
def nearest_neighbor(spark: SparkSession, d: str) -> DataFrame:
    customers, suppliers = _people(spark, d)
    found = matching.nearest_join(suppliers, customers, "nation", "s_acctbal", "c_acctbal", "c_custkey", 500)
    return found.select("s_suppkey", "c_custkey", F.col("distance").cast("decimal(18,4)").alias("distance"))


@query("""
SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)""")
def containment_join(spark: SparkSession, d: str) -> DataFrame:
    phrases = read(spark, d, "benchmark").select("item_id", F.col("text").alias("phrase"))
    return matching.contain_join(read(spark, d, "documents", "doc_id", "text"), "text", phrases, "phrase").select("doc_id", "item_id")


@query("""
WITH g(ord, name, pattern) AS (VALUES (1, 'thrift', '^ECON'), (2, 'promo', 'PROMO|SMALL'), (3, 'size', '^(LARGE|MEDIUM|SMALL)$')),
m AS (SELECT p_partkey, name, row_number() OVER (PARTITION BY p_partkey ORDER BY ord) AS n FROM part JOIN g ON regexp_matches(p_type, pattern))
SELECT p.p_partkey, p.p_type, m.name AS font_group FROM part p LEFT JOIN m ON p.p_partkey = m.p_partkey AND m.n = 1""")
def regex_theta_join(spark: SparkSession, d: str) -> DataFrame:
    patterns = [("thrift", "^ECON"), ("promo", "PROMO|SMALL"), ("size", "^(LARGE|MEDIUM|SMALL)$")]
    return matching.first_pattern(read(spark, d, "part", "p_partkey", "p_type"), F.col("p_type"), patterns, "font_group")


@query(r"""
WITH w AS (SELECT page_id, list_filter(string_split_regex(url, '[/.:?=&#]+'), lambda x: x <> '') AS words FROM pages),
g AS (SELECT DISTINCT page_id, array_to_string(words[i : i + n - 1], ' ') AS gram, n FROM w, (SELECT unnest(range(2, 6)) AS n) s, LATERAL (SELECT unnest(range(1, greatest(len(words) - n + 2, 1))) AS i) p),
d AS (SELECT gram FROM g GROUP BY gram HAVING count(*) >= 5),
r AS (SELECT page_id, gram, n, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, gram) AS k FROM g JOIN d USING (gram))
SELECT page_id, gram AS entry, CAST(n AS INTEGER) AS size FROM r WHERE k = 1""")
def window_ngram_dictionary_longest(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages", "page_id", "url").select("page_id", F.filter(F.split("url", "[/.:?=&#]+"), lambda x: x != "").alias("words"))
    grams = matching.word_windows(pages, "words", 2, 5).select("page_id", "gram").distinct()
    dictionary = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5").select("gram")
    return matching.longest_entry(pages, "page_id", "words", dictionary, 2, 5)


@query(r"""
SELECT doc_id, regexp_extract(substr(text, 1, 99), '[^.!?\n]*\z', 0) || regexp_extract(substr(text, 100), '\A[^.!?\n]*', 0) AS sentence FROM documents""")
def sentence_window(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", sequence.sentence_at(F.col("text"), F.lit(100), r".!?\n").alias("sentence"))


@query(r"""
SELECT page_id, upper(regexp_replace(regexp_replace(url, '^https?://(www\.|m\.)?', ''), '[?#].*$', '')) AS family, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS variant FROM pages""")
def regex_rewrite_key(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", r"^https?://(www\.|m\.)?", ""), r"[?#].*$", "")
    return read(spark, d, "pages", "page_id", "url").select("page_id", F.upper(bare).alias("family"), F.regexp_extract("url", r"[?&]page=([0-9]+)", 1).alias("variant"))


@query("""
WITH p AS (SELECT l_orderkey, unnest(string_split(string_agg(l_returnflag || l_linestatus || '; ' || l_linenumber % 3, '|' ORDER BY l_linenumber, l_partkey, l_suppkey), '|')) AS a FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, trim(unnest(string_split(a, ';'))) AS v FROM p)
SELECT l_orderkey, string_agg(DISTINCT v, '|' ORDER BY v) AS readings FROM s WHERE v <> '' GROUP BY 1""")
def split_canonical_set(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")
    raw = F.concat(F.col("l_returnflag"), F.col("l_linestatus"), F.lit("; "), (F.col("l_linenumber") % 3).cast("string"))
    cells = lines.groupBy("l_orderkey").agg(F.array_join(F.collect_list(raw), "|").alias("cell"))
    return cells.select("l_orderkey", scalars.value_set(F.col("cell")).alias("readings"))


@query(r"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, regexp_replace(regexp_replace(CAST(CAST(round(CAST(l_extendedprice AS DECIMAL(18,6)), 3) AS DECIMAL(18,3)) AS VARCHAR), '0+$', ''), '\.$', '') AS price FROM lineitem""")
def canonical_number(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalars.canonical_number(F.col("l_extendedprice")).alias("price"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events", "event_id", "props").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query(None)
def nfkc_canonicalise(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", scalars.nfkc("text").alias("text"), scalars.canonical_readings("text").alias("reading"))


def _turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations", "conv_id", "turn", "text")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return turns.join(following, ["conv_id", "turn"])


@query(None)
def sequence_similarity(spark: SparkSession, d: str) -> DataFrame:
    pairs = _turn_pairs(spark, d)
    return pairs.select("conv_id", "turn", F.round(sequence.similarity("text", "answer"), 6).alias("similarity"))


@query(None)
def sequence_opcodes(spark: SparkSession, d: str) -> DataFrame:
    pairs = _turn_pairs(spark, d).withColumn("pair_id", F.col("conv_id") * 1000 + F.col("turn"))
    return sequence.opcodes(pairs, "pair_id", "text", "answer")


@query(None)
def greedy_page_pairing(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations", "conv_id", "turn", "role", "text").withColumn("grp", F.col("conv_id").cast("string"))
    ask = turns.filter("role = 'user'").select("grp", F.col("turn").alias("left_id"), F.col("text").alias("a"))
    reply = turns.filter("role = 'assistant'").select("grp", F.col("turn").alias("right_id"), F.col("text").alias("b"))
    scored = sequence.scored_pairs(ask.join(reply, "grp"), "a", "b", "score").withColumn("score", F.round("score", 6))
    return sequence.greedy_pairs(scored, "grp", "left_id", "right_id", "score", 0.05)
