"""A content-addressed WARC archive.

The archive is two tables in the shared folder: ``payloads`` holds each payload
once under its verified SHA-256, and ``headers`` holds every record's exact
header bytes with the digest it refers to. Reading back joins the two on the
digest, checks each payload against its digest, and gives the original records:
a response is its header block followed by the payload, a revisit its header
block alone (profile identical-payload-digest) with the record it refers to. A
revisit's digest and size are those of the stored payload it is joined to.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with
the smallest id is the response and the others revisit it; smaller payloads are
responses all. Payloads are shuffled once, by page; headers and digests are the
only rows that meet per digest, minima are combined before the shuffle, and the
join on small hot payloads is dealt over ``SALTS``. Digests that hold a good part
of all records meet by broadcast (``join_hot``).

Cases: a null payload is empty; repeated rows of one page_id give repeated
records, one of which holds the payload; a null url has an empty target, and
line ends in a url are percent-encoded; null
page_ids are dropped; extra columns are ignored; an empty table gives an empty
archive.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, join_hot, table

MIN_REVISIT = 100
SALTS = 32
EPOCH = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column) -> Column:
    """A stable UUID-shaped id made from the page's id."""
    h = F.sha2(F.concat(F.lit("page:"), page_id.cast("string")), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def header(url: Column, page_id: Column, kind: Column, digest: Column, size: Column, original: Column) -> Column:
    """The header block of one record, up to and with the empty line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(original)), line("WARC-Refers-To-Page", original.cast("string")))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Target-URI", F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Date", F.lit(EPOCH)),
        line("WARC-Record-ID", _record_id(page_id)),
        line("WARC-Page-ID", page_id.cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        line("WARC-Payload-Length", size.cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "response", size).otherwise(F.lit(0)).cast("string")),
        F.when(kind == "revisit", revisit).otherwise(F.lit("")),
        F.lit("\r\n"),
    )


def write_archive(ws: Workspace, pages: DataFrame, least: int = MIN_REVISIT) -> tuple[DataFrame, DataFrame]:
    """Write ``headers`` and ``payloads``; both are returned as reread."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    source = pages.filter("page_id IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    keyed = ws.write(source.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size")), "keys")
    firsts = ws.write(keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    judged = join_hot(keyed, firsts, "digest")
    kind = F.when((F.col("size") < least) | (F.col("page_id") == F.col("first")), F.lit("response")).otherwise(F.lit("revisit"))
    judged = judged.withColumn("kind", kind)
    block = header(F.col("url"), F.col("page_id"), F.col("kind"), F.col("digest"), F.col("size"), F.col("first"))
    headers = ws.write(judged.select("page_id", "digest", "kind", "size", F.encode(block, "utf-8").alias("header")), "headers")
    stored = source.withColumn("digest", F.sha2("payload", 256)).join(firsts.select(F.col("first").alias("page_id"), "digest"), ["page_id", "digest"])
    nth = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("page_id"))  # repeated rows, in the join's own partitions
    bodies = stored.withColumn("nth", nth).filter("nth = 1").select("digest", "payload")
    return headers, ws.write(bodies, "payloads")


def read_archive(headers: DataFrame, payloads: DataFrame, salts: int = SALTS) -> DataFrame:
    """Records as archived: ``(page_id, header, payload, stored_digest, stored_bytes)``.

    The payload is null for revisits; the last two are taken from the payload that
    the record refers to by its digest, and null where there is none.

    Large payloads have one response each, so that side needs no salt; payloads
    below the revisit size may have any number and are few bytes, so each is
    copied to every salt. Revisits meet facts of the payload, not its bytes.
    """
    facts = [F.sha2("payload", 256).alias("stored_digest"), F.octet_length("payload").cast("long").alias("stored_bytes")]
    spread = payloads.select(F.col("digest").alias("d"), "payload", *facts)
    spread = spread.withColumn("s", F.explode(F.when(F.octet_length("payload") < MIN_REVISIT, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))))
    responses = headers.filter("kind = 'response'").withColumn("s", F.when(F.col("size") < MIN_REVISIT, F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).otherwise(F.lit(-1)))
    names = ["page_id", "header", "payload", "stored_digest", "stored_bytes"]
    whole = responses.join(spread, (F.col("digest") == F.col("d")) & (responses["s"] == spread["s"]), "left").select(*names)
    revisits = headers.filter("kind = 'revisit'")
    met = revisits.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).join(payloads.select("digest", *facts), "digest", "left")
    return whole.unionByName(join_hot(revisits, met, "digest").withColumn("payload", F.lit(None).cast("binary")).select(*names))


def field(name: str) -> Column:
    """The value of one header line, null where the line is missing."""
    found = F.regexp_extract_all(F.decode("header", "utf-8"), F.lit(rf"\r\n{name}: ([^\r\n]*)\r\n"), F.lit(1))
    return F.get(found, F.lit(0))


def records(archive: DataFrame) -> DataFrame:
    """What the reread records say, with the payload facts recomputed from the stored bytes."""
    failed = F.raise_error(F.concat(F.lit("archive record fails its digest, page "), F.col("page_id").cast("string")))
    stated = F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "")
    digest = F.when(F.col("stored_digest").eqNullSafe(stated), F.col("stored_digest")).otherwise(failed)
    return archive.select(field("WARC-Page-ID").cast("long").alias("page_id"), F.col("stored_bytes").alias("payload_bytes"), digest.alias("payload_digest"), field("WARC-Type").alias("record_type"), field("WARC-Refers-To-Page").cast("long").alias("refers_to"))


def export_files(archive: DataFrame, folder: str) -> None:
    """Write the records as gzip members of WARC text, one file column per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [gzip.compress(h + (p or b"") + b"\r\n\r\n", mtime=0) for h, p in zip(batch.column("header").to_pylist(), batch.column("payload").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(members, pa.binary())], ["page_id", "member"])

    archive.select("page_id", "header", "payload").mapInArrow(run, "page_id long, member binary").write.mode("overwrite").parquet(folder)


OP4_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < 100 OR page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "warc")
    headers, payloads = write_archive(ws, table(spark, sf_dir, "pages"))
    ws.drop("keys", "firsts")
    ws.release()
    return records(read_archive(headers, payloads))
