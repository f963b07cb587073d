"""Content-addressed WARC archive: exact headers and payloads in two tables, records rebuilt by a join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm.common import join_hot
from linework.sources.scratch import fresh_path, save

CRLF = "\r\n"
#: One fixed date keeps archives of the same rows the same.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-record:"
#: Characters that are coded in values that break lines, the percent sign first.
BREAKING, CODED = "%\r\n", "-Percent-Coded"
#: Records of one digest go to joins in parts of about this many.
PART_RECORDS = 100_000
BASE32_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """The SHA-1 in upper-case base32: 20 bits of the hex digest make four digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE32_DIGITS, BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value.

    A value with a line break would end the header: it stands under the name with CODED behind it,
    its breaks and percent signs percent-coded, and reads back exactly.  Others stand as they are.
    """
    value = value.cast("string")
    coded = value
    for c in BREAKING:
        coded = F.replace(coded, F.lit(c), F.lit(f"%{ord(c):02X}"))
    line = F.when(value.rlike("[\r\n]"), F.concat(F.lit(f"{name}{CODED}: "), coded)).otherwise(F.concat(F.lit(f"{name}: "), value))
    return F.coalesce(F.concat(line, F.lit(CRLF)), F.lit(""))


@dataclass
class Archive:
    """Where an archive's two tables stand: headers (record_id, sha256, part, header) and payloads (sha256, parts, payload).

    The headers of a payload are dealt into its parts, so that a payload of very many records (an
    error page) is read by several tasks.
    """

    path: str

    def headers(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("record_id string, sha256 string, part int, header string").parquet(f"{self.path}/headers")

    def payloads(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("sha256 string, parts int, payload binary").parquet(f"{self.path}/payloads")


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", path: str | None = None, min_bytes: int = 0) -> Archive:
    """Archive each row of pages as one WARC/1.1 record; payload bytes stand once for each SHA-256.

    A string payload is its UTF-8; null is empty.  Of equal payloads of at least min_bytes bytes the
    record with the largest id is a response and the others revisit it; smaller ones are responses
    each.  Payloads travel in one shuffle, copies in a task merged before it; types and headers need
    ids and digests alone.  Rows with a repeated id are records of their own and, with
    equal payloads, of the same type; a null id sorts below all others and its record names no id.
    A null url is the record's own name.  Other columns are ignored, so their names can't clash.
    """
    spark = pages.sparkSession
    archive = Archive(path or fresh_path(spark, "warc"))
    kind = dict(pages.dtypes)[payload_col]
    raw = F.col(payload_col) if kind == "binary" else F.encode(F.col(payload_col).cast("string"), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(raw, F.lit(b"")).alias("payload"))
    slim = save(rows.select("id", "url", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("n"), sha1_base32(F.col("payload")).alias("sha1"), F.monotonically_increasing_id().alias("row")), "warc-digests")
    top = save(slim.groupBy("sha256").agg(F.max("id").alias("top"), F.count("*").alias("n")), "warc-groups")
    known = join_hot(slim.withColumnRenamed("n", "bytes"), top, "sha256", top.agg(F.sum("n")).first()[0] or 0, 128)
    parts = F.ceil(F.col("n") / PART_RECORDS).cast("int")
    revisit = F.coalesce((F.col("bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("top")), F.lit(False))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", urn("id")),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.coalesce("url", urn("id"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("WARC-Refers-To", F.when(revisit, urn("top"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))),
        _line("X-Payload-Length", F.col("bytes")),
        _line("X-Payload-SHA256", F.col("sha256")),
    )
    part = F.pmod(F.xxhash64("row"), parts).cast("int")
    known.select(F.col("id").cast("string").alias("record_id"), "sha256", part.alias("part"), header.alias("header")).write.parquet(f"{archive.path}/headers")
    keyed = rows.select(F.sha2("payload", 256).alias("sha256"), "payload")
    counted = keyed.groupBy("sha256").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
    counted.select("sha256", parts.alias("parts"), "payload").write.parquet(f"{archive.path}/payloads")
    return archive


def _field(name: str, pattern: str = r"([^\r\n]*)", head: str = "head") -> Column:
    """A header's value as it was written; null if the header is absent."""
    found = lambda n, p: F.when(F.instr(head, f"{CRLF}{n}: ") > 0, F.regexp_extract(head, rf"\r\n{n}: {p}\r\n", 1))
    plain = found(f"{name}{CODED}", r"([^\r\n]*)")
    for c in reversed(BREAKING):
        plain = F.replace(plain, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.coalesce(found(name, pattern), plain)


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """(record_id, record, payload): each record's WARC bytes, header to trailer, and the payload it stands for.

    A response's block is the payload, a revisit's is empty.
    """
    stored = archive.payloads(spark).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = archive.headers(spark).join(stored, ["sha256", "part"])
    block = F.when(F.instr("header", f"{CRLF}WARC-Type: revisit{CRLF}") > 0, F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.encode("header", "UTF-8"), F.lit(b"\r\n"), block, F.lit(b"\r\n\r\n"))
    return rows.select("record_id", record.alias("record"), "payload")


def read_records(rows: DataFrame) -> DataFrame:
    """records() parsed from their bytes: record_id, record_type, refers_to, target_uri, payload,
    payload_bytes, payload_digest, verified, record_bytes, record_sha256 and record.

    The header ends at the first empty line and its Content-Length says how long the block is.  A
    response's payload is its block, a revisit's the one it refers to; bytes and digest are
    computed from that.  verified: they are what the header says, with the SHA-256 there, and
    the record ends where it should.
    """
    split = rows.withColumn("head", F.concat(F.substring_index(F.col("record").cast("string"), CRLF * 2, 1), F.lit(CRLF)))
    split = split.withColumns({"length": _field("Content-Length").try_cast("long"), "record_type": _field("WARC-Type"), "at": F.octet_length("head") + 2})
    block = F.substring("record", F.col("at") + 1, F.col("length").cast("int"))
    body = F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(block)
    split = split.withColumn("body", body).withColumns({"payload_bytes": F.octet_length("body").cast("long"), "payload_digest": sha1_base32(F.col("body"))})
    urn = rf"<{URN}([^\r\n]*)>"
    sound = (_field("X-Payload-Length").try_cast("long") == F.col("payload_bytes")) & (_field("WARC-Payload-Digest", "sha1:([A-Z2-7]*)") == F.col("payload_digest"))
    sound &= (_field("X-Payload-SHA256") == F.sha2("body", 256)) & (F.octet_length("record") == F.col("at") + F.col("length") + 4)
    return split.select(
        "record_id", "record_type", _field("WARC-Refers-To", urn).alias("refers_to"), _field("WARC-Target-URI").alias("target_uri"), F.col("body").alias("payload"), "payload_bytes", "payload_digest",
        F.coalesce(sound, F.lit(False)).alias("verified"), F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"), "record",
    )


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """The archive's records, rebuilt and parsed (read_records)."""
    return read_records(records(spark, archive))


_SHA1 = ", ".join(f"lpad(to_base(('0x' || substr(p.h, {5 * i + 1}, 5))::bigint, 32), 4, '0')" for i in range(8))
#: The contract's rows in DuckDB, and the length and digest of each record's text.
SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS t, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY 1),
r AS (SELECT page_id, octet_length(b)::bigint AS payload_bytes, t, sha256(b) AS s, translate(concat({_SHA1}), '{BASE32_DIGITS}', '{BASE32}') AS payload_digest, '<{URN}' || page_id || '>' AS urn, url,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM p JOIN m ON p.h = m.h),
w AS (SELECT *, concat('WARC/1.1~WARC-Type: ', record_type, '~WARC-Record-ID: ', urn, '~WARC-Date: {DATE}~WARC-Target-URI: ', coalesce(url, urn), '~WARC-Payload-Digest: sha1:', payload_digest,
  CASE WHEN refers_to IS NOT NULL THEN concat('~WARC-Refers-To: <{URN}', refers_to, '>~WARC-Profile: {PROFILE}') END, '~Content-Type: text/html~Content-Length: ', CASE WHEN refers_to IS NULL THEN payload_bytes ELSE 0 END,
  '~X-Payload-Length: ', payload_bytes, '~X-Payload-SHA256: ', s, '~~') AS head FROM r),
x AS (SELECT *, concat(replace(head, '~', chr(13) || chr(10)), CASE WHEN refers_to IS NULL THEN t END, chr(13), chr(10), chr(13), chr(10)) AS record FROM w)
SELECT page_id, payload_bytes, payload_digest, record_type, refers_to, true AS verified, octet_length(encode(record))::bigint AS record_bytes, sha256(record) AS record_sha256 FROM x
"""
