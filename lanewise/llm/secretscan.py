"""Secret scans judged by who owns a candidate across the whole corpus.

Every text is scanned once, in its own partition. Three base kinds always count:
``assign`` (a keyword, ``:`` or ``=``, and a value), ``access`` (key ids that begin
with AKIA) and ``hex`` (long lower-case hexadecimal runs). Besides them, opaque
runs are candidates: ``OPAQUE_LENGTH`` characters or more of ``[A-Za-z0-9+/_=-]``
with a capital, a small letter, a digit and ``OPAQUE_DISTINCT`` different
characters, outside all base spans.

A pattern alone can't tell a key that a tutorial prints from one that works. The
hashes of all candidates' values are therefore aggregated over the corpus, by
distinct repositories and by distinct owners:

* ``live``: one owner, however many repositories and copies of that owner;
* ``example``: ``EXAMPLE_OWNERS`` owners or more, a widely copied value;
* ``shared``: any number between.

Base spans stay whatever their verdict; an opaque run becomes a span (kind
``owned``) only if its value is ``live``. Only candidates leave their partition,
as a hash with its owner and repository: repeats are combined before each
shuffle, and a value that holds a good part of all candidates meets its verdict
by broadcast (``join_hot``). No value is ever sent or stored.

Cases: null texts are empty; null owners and repositories count as ``''``; null
and repeated doc_ids are judged row by row; extra columns are ignored, whatever
their names; matches of one kind never overlap, those of different kinds may;
offsets are code points; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, join_hot, table, text_bytes

# The base kinds in their order, and their least lengths.
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20, "hex": 24}
OWNED = "owned"

OPAQUE_LENGTH = 20
OPAQUE_DISTINCT = 12
EXAMPLE_OWNERS = 3

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_OPAQUE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % OPAQUE_LENGTH)
_CLASSES = [re.compile(c) for c in (rb"[A-Z]", rb"[a-z]", rb"[0-9]")]

_CANDIDATE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("hash", pa.binary())])
_SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, base_spans string, candidates array<struct<kind: string, start: long, stop: long, hash: binary>>"

Span = tuple[str, int, int, int, int]  # kind, start, stop, and the value's place


def base_spans(raw: bytes) -> list[Span]:
    """Base matches of UTF-8 bytes, as byte offsets, by start and then by kind."""
    found = [("assign", *m.span(), *m.span(1)) for m in _ASSIGN.finditer(raw.translate(_LOWER)) if m.end(1) - m.start(1) >= LEAST["assign"]]
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        found += [(kind, *m.span(), *m.span()) for m in pattern.finditer(raw) if m.end() - m.start() >= LEAST[kind]]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def opaque_spans(raw: bytes, base: list[Span]) -> list[Span]:
    """Runs that look like credentials and touch no base span."""
    found, at, reach = [], 0, 0
    for m in _OPAQUE.finditer(raw):
        start, stop = m.span()
        while at < len(base) and base[at][1] < stop:
            reach = max(reach, base[at][2])
            at += 1
        run = m.group()
        if reach <= start and len(set(run)) >= OPAQUE_DISTINCT and all(c.search(run) for c in _CLASSES):
            found.append((OWNED, start, stop, start, stop))
    return found


def in_code_points(raw: bytes, offsets: list[int]) -> dict[int, int]:
    """Code points before each byte offset."""
    if raw.isascii():
        return {at: at for at in offsets}
    out, done, n = {}, 0, 0
    for at in sorted(set(offsets)):
        n += len(raw[done:at].decode("utf-8"))
        done = at
        out[at] = n
    return out


def scan_text(raw: bytes) -> tuple[int, int, int, str, str, list[dict]]:
    base = base_spans(raw)
    every = base + opaque_spans(raw, base)
    point = in_code_points(raw, [at for s in every for at in s[1:3]])
    listed = ",".join(f"{kind}:{point[a]}:{point[b]}" for kind, a, b, _, _ in base)
    counts = (sum(s[0] == kind for s in base) for kind in KINDS)
    candidates = [{"kind": kind, "start": point[a], "stop": point[b], "hash": hashlib.sha256(raw[c:d]).digest()[:16]} for kind, a, b, c, d in every]
    return *counts, hashlib.sha256(listed.encode()).hexdigest(), listed, candidates


def scan(rows: DataFrame) -> DataFrame:
    """Adds to ``doc_id, owner, repository`` what each ``text`` holds."""
    carried = ["doc_id", "owner", "repository"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*zip(*(scan_text(raw) for raw in text_bytes(batch.column("text"))), strict=True)] or [()] * 6
            kinds = [*[pa.int64()] * 3, pa.string(), pa.string(), pa.list_(_CANDIDATE)]
            names = [*carried, "n_assign", "n_access", "n_hex", "base_sha256", "base_spans", "candidates"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows.select(*carried, "text").mapInArrow(run, f"doc_id long, owner string, repository string, {_SCANNED}")


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, n, repositories, owners, verdict`` of each candidate value.

    Each step combines what it has before it shuffles, so a value found everywhere
    costs one row for each task, repository and owner, in that order.
    """
    places = candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = places.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"))
    values = owners.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))
    verdict = F.when(F.col("owners") == 1, "live").when(F.col("owners") >= EXAMPLE_OWNERS, "example").otherwise("shared")
    return values.withColumn("verdict", verdict)


def find_secrets(docs: DataFrame, owner: Column, repository: Column) -> tuple[DataFrame, DataFrame]:
    """Documents with their spans and counts, and every span with its verdict.

    The first has a row for each row of ``docs``: ``doc_id, n_assign, n_access, n_hex,
    base_sha256, spans, n_live, n_example``. The second has ``doc_id, kind, start,
    stop, repositories, owners, verdict`` for each reported span.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "secrets")
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank(owner).alias("owner"), blank(repository).alias("repository"), "text")
    scanned = ws.write(scan(rows).withColumn("rid", F.monotonically_increasing_id()), "scanned")
    each = scanned.filter("size(candidates) > 0").select("rid", "doc_id", "owner", "repository", F.explode("candidates").alias("c"))
    each = ws.write(each.select("rid", "doc_id", "owner", "repository", "c.*"), "candidates")
    judged = join_hot(each, ws.write(ownership(each), "ownership"), "hash").filter(f"kind <> '{OWNED}' OR verdict = 'live'")
    spans = ws.write(judged.select("rid", "doc_id", "kind", "start", "stop", "repositories", "owners", "verdict"), "spans")
    ws.drop("candidates")

    order = F.create_map(*(F.lit(x) for k, name in enumerate((*KINDS, OWNED)) for x in (name, k)))
    listed = F.array_sort(F.collect_list(F.struct("start", order[F.col("kind")].alias("k"), F.concat_ws(":", "kind", "start", "stop").alias("s"))))
    per_row = spans.groupBy("rid").agg(F.concat_ws(",", F.transform(listed, lambda x: x["s"])).alias("spans"), F.count_if(F.col("verdict") == "live").alias("n_live"), F.count_if(F.col("verdict") == "example").alias("n_example"))
    kept = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    zero = F.lit(0).cast("long")
    # most rows hold no candidate and are done where they are
    plain = scanned.filter("size(candidates) = 0").select(*kept, F.col("base_spans").alias("spans"), zero.alias("n_live"), zero.alias("n_example"))
    found = scanned.filter("size(candidates) > 0").drop("candidates", "base_spans").join(per_row, "rid", "left")
    found = found.select(*kept, F.coalesce("spans", F.lit("")).alias("spans"), *(F.coalesce(c, zero).alias(c) for c in ("n_live", "n_example")))
    return plain.unionByName(found), spans.drop("rid")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its owner; source and language together are the repository."""
    docs = table(spark, sf_dir, "documents")
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return find_secrets(docs, F.col("source"), repository)[0]


#: Matches and the pieces between them give every match its place.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, concat(coalesce(source, ''), '/', coalesce(lang, '')) AS repo, coalesce(text, '') AS t FROM documents),
p(kind, k, pattern, least) AS (VALUES
  ('assign', 0, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', 6),
  ('access', 1, 'AKIA[A-Z0-9]+', 20), ('hex', 2, '[0-9a-f]{24,}', 24), ('owned', 3, '[A-Za-z0-9+/_=-]{20,}', 20)),
m AS (SELECT rid, kind, k, least, regexp_extract_all(t, pattern) AS hits, regexp_split_to_array(t, pattern) AS gaps FROM d, p WHERE regexp_matches(t, pattern)),
e AS (SELECT rid, kind, k, least, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM m),
o AS (SELECT rid, kind, k, least, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, k ORDER BY i) AS stop FROM e),
v AS (SELECT rid, kind, k, CAST(stop - length(hit) AS BIGINT) AS a, CAST(stop AS BIGINT) AS b, CASE WHEN k = 0 THEN regexp_extract(hit, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE hit END AS val, least FROM o),
base AS (SELECT * FROM v WHERE k < 3 AND length(val) >= least),
free AS (SELECT * FROM v WHERE k = 3 AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[0-9]') AND len(list_distinct(string_split(val, ''))) >= 12
         AND NOT EXISTS (SELECT 1 FROM base x WHERE x.rid = v.rid AND x.a < v.b AND x.b > v.a)),
c AS (SELECT x.*, owner FROM (SELECT * FROM base UNION ALL SELECT * FROM free) x JOIN d USING (rid)),
n AS (SELECT val, count(DISTINCT owner) AS owners FROM c GROUP BY 1),
s AS (SELECT c.*, owners FROM c JOIN n USING (val) WHERE k < 3 OR owners = 1),
g AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, k) FILTER (k < 3) AS listed,
      string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, k) AS spans, count(*) FILTER (owners = 1) AS n_live, count(*) FILTER (owners >= 3) AS n_example FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (rid)
"""
