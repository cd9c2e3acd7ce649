"""URL filters by a sort-merge range join over reversed hosts.

A rule's host becomes a canonical key: its labels reversed, each followed by
``\\x01``. A host and all its subdomains are then one interval of keys, and
intervals of rules are nested or disjoint. URLs are range partitioned and
sorted by the same key; each partition merges them with the sorted rules and
keeps a stack of the rule hosts whose intervals are open, from which the
fitting rule with the longest host and path together is taken (at equal length
the one with the longer host, then the first by text). A host may itself hold the
mark, so the rule's host is compared once more before it is taken.

The rules are the caller's own list, held by the driver already; it is sent to
the workers only up to ``MAX_RULE_BYTES``. Longer lists are cut into sets below
the bound, one sweep each, and the best match of all sets is kept.

Cases: a null url, or one without ``://``, has an empty host and path and fits
no rule; user data and ports stay part of the host as written; repeated
rows and null page_ids are kept; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_width, table

MAX_RULE_BYTES = 16 << 20
DEFAULT_VERDICT = "allow"
_END = "\x01"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: str, path: str) -> bool:
        return path.startswith(self.path) and (host == self.host or host.endswith("." + self.host))

    @property
    def key(self) -> str:
        return "".join(label + _END for label in reversed(self.host.split(".")))


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, empty where it has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host: Column) -> Column:
    """The canonical key: labels reversed, each ended by a mark below any letter."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), _END), F.lit(_END))


def _sets(rules: Sequence[Rule], most: int) -> Iterator[list[Rule]]:
    held, size = [], 0
    for rule in rules:
        size += len(rule.text.encode()) + 64
        if held and size > most:
            yield held
            held, size = [], len(rule.text.encode()) + 64
        held.append(rule)
    if held:
        yield held


def _sweep(batches: Iterator[pa.RecordBatch], hosts: list[tuple[str, list[Rule]]]) -> Iterator[pa.RecordBatch]:
    """Merge sorted urls with sorted rule hosts; ``open_`` holds nested intervals."""
    at, open_ = 0, []
    for batch in batches:
        found: list[Rule | None] = []
        for key, host, path in zip(*(batch.column(c).to_pylist() for c in ("key", "host", "path")), strict=True):
            while at < len(hosts) and hosts[at][0] <= key:
                while open_ and not hosts[at][0].startswith(open_[-1][0]):
                    open_.pop()
                open_.append(hosts[at])
                at += 1
            while open_ and not key.startswith(open_[-1][0]):
                open_.pop()
            best = None
            for _, rules in open_:
                longest = next((r for r in rules if r.fits(host, path)), None)  # longest path first
                if longest is not None and (best is None or len(longest.text) >= len(best.text)):
                    best = longest
            found.append(best)
        names = ["page_id", "host", "path"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array([r.text if r else None for r in found], pa.string()), pa.array([len(r.host) if r else 0 for r in found], pa.int32()), pa.array([r.verdict if r else None for r in found], pa.string())],
            [*names, "rule", "host_length", "found"],
        )


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = DEFAULT_VERDICT, most: int = MAX_RULE_BYTES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``."""
    host, path = host_path(F.col("url"))
    keyed = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = keyed.withColumn("key", F.when(F.col("host") != "", reversed_host(F.col("host"))).otherwise(F.lit("")))
    width = shuffle_width(pages.sparkSession)
    result = None
    for k, some in enumerate(_sets(rules, most) if rules else [[]]):
        by_host: dict[str, list[Rule]] = {}
        for rule in sorted(some, key=lambda r: (-len(r.path), r.path, r.verdict)):
            by_host.setdefault(rule.key, []).append(rule)
        hosts = sorted(by_host.items())
        if k == 0:
            source = keyed
        else:
            source = result.withColumn("key", F.when(F.col("host") != "", reversed_host(F.col("host"))).otherwise(F.lit("")))
        swept = source.repartitionByRange(width, "key", "path", "page_id").sortWithinPartitions("key")
        if k == 0:
            result = swept.select("page_id", "host", "path", "key").mapInArrow(lambda b, h=hosts: _sweep(b, h), "page_id long, host string, path string, rule string, host_length int, found string")
        else:
            inner = swept.select("page_id", "host", "path", "key", F.struct("rule", "host_length", "found").alias("before"))
            result = _merge(inner, hosts)
    return result.select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))


def _merge(swept: DataFrame, hosts: list[tuple[str, list[Rule]]]) -> DataFrame:
    """A later set's sweep: the longer of the match so far and this set's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept.append(batch)
                yield batch

        for new in _sweep(seen(), hosts):
            before = kept.pop(0).column("before").to_pylist()
            rows = new.to_pylist()
            for row, old in zip(rows, before, strict=True):
                if old["rule"] is not None and (row["rule"] is None or (len(old["rule"]), old["host_length"]) > (len(row["rule"]), row["host_length"])):
                    row.update(old)
            yield pa.RecordBatch.from_pylist(rows, schema=new.schema)

    return swept.mapInArrow(run, "page_id long, host string, path string, rule string, host_length int, found string")


OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
hit AS (
  SELECT page_id, verdict, rhost || rpath AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
  FROM cut, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT c.page_id, c.host, c.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM cut c LEFT JOIN hit h ON c.page_id = h.page_id AND h.n = 1
"""


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
