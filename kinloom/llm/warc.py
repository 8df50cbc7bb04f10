"""Content-addressed web archive.

Payload bytes are stored once, under their SHA-256; the exact record headers are stored apart; joins on the
digest give the original records back. Everything is a DataFrame expression.

Archive layout below one folder, both parts Parquet:

* ``headers``  - page_id, header (exact WARC header and HTTP head), payload_sha256, holds_payload
* ``payloads`` - payload_sha256, payload

Edge cases: a null body is an empty payload; a null address is written as an empty target; a null page_id is
kept, and refers to the smallest non-null one of its payload; repeated rows with the smallest page_id are all
written as response, their payload still once; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Ids and digests (40 bytes) that are sent to every task at most; beyond that, payloads are joined with them.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class ArchiveOptions:
    """``min_revisit_bytes``: smaller payloads are never turned into revisit records."""

    min_revisit_bytes: int = 0
    warc_date: str = "2020-01-01T00:00:00Z"


def base32_of_hex(hexed: Column, groups: int = 8) -> Column:
    """Base32 of a hex string: five hex digits are four base32 characters."""
    out = []
    for g in range(groups):
        n = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("record:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def records(pages: DataFrame, options: ArchiveOptions = ArchiveOptions()) -> DataFrame:
    """One record header per page: page_id, header, payload_sha256, holds_payload.

    Only digests and ids are shuffled: of each payload that occurs more than once the smallest page_id is found
    with a partial aggregate, and joined back.
    """
    body = F.coalesce(pages["html"].cast("binary"), F.lit(b""))
    base = pages.select(
        pages["page_id"],
        F.coalesce(pages["url"], F.lit("")).alias("url"),
        F.unhex(F.sha2(body, 256)).alias("payload_sha256"),
        F.sha1(body).alias("sha1"),
        F.octet_length(body).cast("long").alias("n"),
    )
    again = (
        base.filter(F.col("n") >= options.min_revisit_bytes)
        .groupBy("payload_sha256")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 AND first_id IS NOT NULL")
        .drop("copies")
    )
    r = base.join(again, "payload_sha256", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("n").cast("string"),
        F.lit(CRLF * 2),
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(options.warc_date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", record_id(F.col("first_id"))),
                line("X-Refers-To-Page", F.col("first_id").cast("string")),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string")),
        F.lit(CRLF),
        http,
    )
    return r.select("page_id", head.alias("header"), "payload_sha256", (~revisit).alias("holds_payload"))


def write_archive(pages: DataFrame, path: str, options: ArchiveOptions = ArchiveOptions()) -> None:
    """Write both parts below ``path``. Payload bytes are moved if more than BROADCAST_ROWS pages revisit, or if rows with
    the smallest page_id of a payload repeat."""
    spark = pages.sparkSession
    records(pages, options).write.parquet(f"{path}/headers")
    headers = spark.read.parquet(f"{path}/headers")
    body = F.coalesce(pages["html"].cast("binary"), F.lit(b""))
    held = pages.select(pages["page_id"], F.unhex(F.sha2(body, 256)).alias("payload_sha256"), body.alias("payload"))
    # A page is left out if it revisits; what remains is unique per digest but for repeated rows.
    gone = headers.filter("NOT holds_payload").select("page_id", "payload_sha256")
    same = held["page_id"].eqNullSafe(gone["page_id"]) & (held["payload_sha256"] == gone["payload_sha256"])
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # then payloads stay where they lie
    first = held.join(F.broadcast(gone) if few else gone, same, "left_anti")
    digests = headers.filter("holds_payload").groupBy("payload_sha256").count()
    if digests.filter("count > 1").limit(1).count():  # rows repeated with the smallest page_id
        first = first.dropDuplicates(["payload_sha256"])
    first.select("payload_sha256", "payload").write.parquet(f"{path}/payloads")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Headers with their parsed fields."""
    h = spark.read.parquet(f"{path}/headers")
    field = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    refers = field("X-Refers-To-Page")
    return h.select(
        "*",
        field("WARC-Type").alias("record_type"),
        F.substring(field("WARC-Payload-Digest"), 6, 32).alias("header_digest"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The original records: page_id, header, record_type, refers_to, payload_sha256, payload, record.

    ``payload`` is null in revisit records, whose record is the header alone. A payload whose bytes do not have
    the digest that they are stored under stops the read.
    """
    p = spark.read.parquet(f"{path}/payloads")
    checked = F.when(F.unhex(F.sha2("payload", 256)) == F.col("payload_sha256"), F.col("payload")).otherwise(
        F.raise_error(F.lit("a stored payload differs from its digest")).cast("binary")
    )
    p = p.select("payload_sha256", checked.alias("payload"))
    h = read_headers(spark, path)
    joined = h.filter("holds_payload").join(p, "payload_sha256", "left")
    bare = h.filter("NOT holds_payload").withColumn("payload", F.lit(None).cast("binary"))
    end = F.lit((CRLF * 2).encode())
    whole = F.concat(F.col("header").cast("binary"), F.coalesce("payload", F.lit(b"")), end)
    return joined.unionByName(bare).withColumn("record", whole)


def page_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per page what its archived record says, with length and digest of the restored payload bytes."""
    back = restore(spark, path)
    own = F.struct(
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_of_hex(F.sha1("payload")).alias("payload_digest"),
    )
    responses = back.filter("holds_payload").select("page_id", "payload_sha256", own.alias("p"), "record_type", "refers_to")
    payloads = spark.read.parquet(f"{path}/payloads").select("payload_sha256", own.alias("p"))
    revisits = read_headers(spark, path).filter("NOT holds_payload").join(payloads, "payload_sha256", "left")
    cols = ["page_id", "p.payload_bytes", "p.payload_digest", "record_type", "refers_to"]
    return responses.select(cols).unionByName(revisits.select(cols))
