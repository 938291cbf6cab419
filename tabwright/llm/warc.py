"""A content-addressed archive of web records.

Two tables make up the archive: `payloads` holds every different payload once, under its SHA-256; `headers` holds each
record's exact header block, with the digest that names its payload. Of equal payloads of at least `revisit_from` bytes the
record with the largest page id is the response, the others are revisits that refer to it. Records are put together again
by joining the two tables, after every payload has been checked against its digest and length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import HOT_SHARE, hot_join, row_id, store, text_or_empty
from tabwright.plans.scratch import scratch_path

#: Value of WARC-Date where the caller has no capture time.
UNKNOWN_DATE = "1970-01-01T00:00:00Z"
#: Fixed value: the profile that the WARC 1.1 standard names for revisits with the same payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits at a time make four base32 digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page: Column, url: Column) -> Column:
    digits = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digits, i, n) for i, n in cuts]), F.lit(">"))


def _one_line(text: Column) -> Column:
    """Control characters and spaces of a URI, percent-encoded, so that a header stays one line."""
    for code in (*range(0x21), 0x7F):
        text = F.replace(text, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return text


def write_archive(pages: DataFrame, revisit_from: int = 0) -> dict[str, str]:
    """Write the archive of (page_id, url, html) rows to the shared folder; returns the folders of headers and payloads.

    Null html is an empty payload; a null url gives an empty target, a null page id is smaller than any other. Of rows with
    the same payload and page id one is the response. Other columns are not looked at.
    """
    spark = pages.sparkSession
    payload = text_or_empty("html").cast("binary")
    whole = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = store(
        whole.select(
            "page_id",
            "url",
            row_id().alias("_row"),
            F.unhex(F.sha2("payload", 256)).alias("digest"),
            base32_sha1(F.col("payload")).alias("sha1"),
            F.octet_length("payload").cast("long").alias("bytes"),
        ),
        "warc-rows",
    )
    total = rows.count()
    keep = F.max(F.struct(F.col("page_id").alias("page"), F.col("_row").alias("row"), F.col("url").alias("url")))
    groups = store(rows.groupBy("digest").agg(F.count("*").alias("copies"), keep.alias("keep")), "warc-groups")
    out = hot_join(rows, groups, ["digest"], "copies", total)
    revisit = (F.col("bytes") >= revisit_from) & (F.col("_row") != F.col("keep.row"))
    kind = F.when(revisit, "revisit").otherwise("response")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("url"))),
        F.lit(f"WARC-Date: {UNKNOWN_DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.coalesce("url", F.lit("")))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("keep.page"), F.col("keep.url")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    ]
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))
    # A hot payload is read back in several copies, so that its records are not one task; `shares` says in how many.
    shares = F.greatest(F.lit(1), F.ceil(F.col("copies") * F.lit(HOT_SHARE) / F.lit(max(total, 1)))).cast("int")
    folders = {"headers": scratch_path(spark, "warc-headers"), "payloads": scratch_path(spark, "warc-payloads")}
    out.select(
        "page_id",
        "digest",
        F.when(revisit, F.col("keep.page")).alias("refers_to"),
        header.alias("header"),
        shares.alias("shares"),
    ).write.parquet(folders["headers"])
    once = whole.select(F.unhex(F.sha2("payload", 256)).alias("digest"), "payload")
    once = once.groupBy("digest").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(folders["payloads"])
    return folders


def read_archive(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Records put together again: page_id, header, payload, refers_to, verified, bytes and sha1 of the payload.

    A record whose payload is missing, or fails its digest, comes back with verified = false.
    """
    headers = spark.read.parquet(folders["headers"])
    payloads = spark.read.parquet(folders["payloads"])
    good = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    payloads = payloads.select(
        "digest",
        "payload",
        good.alias("verified"),
        F.octet_length("payload").cast("long").alias("bytes"),
        base32_sha1(F.col("payload")).alias("sha1"),
    )
    # shares > 1 only for payloads with over 1 / HOT_SHARE of the records: fewer than HOT_SHARE rows
    hot = headers.filter("shares > 1").groupBy("digest").agg(F.max("shares").alias("_shares"))
    payloads = payloads.join(F.broadcast(hot), "digest", "left")
    share = F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)).alias("_share")
    payloads = payloads.select("digest", "payload", "verified", "bytes", "sha1", share)
    headers = headers.withColumn("_share", F.pmod(F.hash("header"), F.col("shares")))
    out = headers.join(payloads, ["digest", "_share"], "left")
    same_length = F.regexp_extract("header", r"Content-Length: (\d+)", 1).cast("long") == F.col("bytes")
    same_digest = F.regexp_extract("header", r"WARC-Payload-Digest: sha1:(\w+)", 1) == F.col("sha1")
    fits = F.col("verified") & same_digest & (same_length | F.col("refers_to").isNotNull())
    return out.select(
        "page_id", "header", "payload", "refers_to", F.coalesce(fits, F.lit(False)).alias("verified"), "bytes", "sha1"
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """The exact bytes of each record; a revisit has no block."""
    is_response = F.col("header").contains("\r\nWARC-Type: response\r\n")
    block = F.when(is_response, F.col("payload")).otherwise(F.lit(b""))
    end = F.lit("\r\n\r\n").cast("binary")
    return records.select("page_id", F.concat(F.col("header").cast("binary"), block, end).alias("record"))


def archived_pages(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write the archive and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to, verified."""
    records = read_archive(pages.sparkSession, write_archive(pages, revisit_from))
    return records.select(
        "page_id",
        F.col("bytes").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        F.regexp_extract("header", r"WARC-Type: (\w+)", 1).alias("record_type"),
        "refers_to",
        "verified",
    )
