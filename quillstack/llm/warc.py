"""A content-addressed WARC archive.

An archive is two tables in one folder. ``payloads`` holds each distinct payload once under its
SHA-256; ``heads`` holds the exact header bytes of every record and the digest of its payload.
Records are rebuilt by joining the two, and every payload is verified against its digest when it is
written (all rows of a digest must agree in length and in a second digest) and when it is read.

Of the records with equal payloads of ``least`` bytes or more, the one with the smallest page_id is a
response and the others revisit it; smaller payloads are always responses. A response carries its
payload; a revisit carries no payload in the archive, only the response it refers to.

Defined cases: a null html is an empty payload, a null url an empty target; rows that repeat the
smallest page_id are all responses; line ends of any kind in a url are percent-encoded; rows without page_id are revisits of a response with an id, and
responses where there is none; an empty table makes an empty archive; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Part of the record format: RFC 4648 letters, and the digits of base 32 as conv() writes them.
BASE32, DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CRLF = "\r\n"
#: Line ends of any kind in an address are percent-encoded, so that a header line is one line to every reader.
LINE_ENDS = {"\n": "%0A", "\x0b": "%0B", "\x0c": "%0C", "\r": "%0D", "\x85": "%C2%85", "\u2028": "%E2%80%A8", "\u2029": "%E2%80%A9"}
#: Date of all records: the archive of a table is the same whenever it is written.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1: four groups of 40 bits make eight letters each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*groups)), DIGITS32, BASE32)


def _uuid(page_id: Column) -> Column:
    """A record id that depends on the page alone."""
    digest = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("none"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def one_line(url: Column) -> Column:
    for char, code in LINE_ENDS.items():
        url = F.replace(url, F.lit(char), F.lit(code))
    return url


def write_archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes page_id, url, html as records to path."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha256": F.sha2("payload", 256), "sha1": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})
    seen = rows.groupBy("sha256").agg(F.first("payload").alias("payload"), F.min("sha1").alias("sha1"), F.max("sha1").alias("other"), F.min("bytes").alias("bytes"), F.max("bytes").alias("most"), F.min("page_id").alias("first_id"))
    honest = (F.col("sha1") == F.col("other")) & (F.col("bytes") == F.col("most"))
    seen.select(F.when(honest, F.col("sha256")).otherwise(F.raise_error(F.lit("two payloads share a digest"))).alias("sha256"), "sha1", "bytes", "first_id", "payload").write.parquet(f"{path}/payloads")
    firsts = pages.sparkSession.read.parquet(f"{path}/payloads").select("sha256", "first_id")
    joined = rows.drop("payload").join(firsts, "sha256")
    revisit = (F.col("bytes") >= least) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    empty = F.lit("")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _uuid(F.col("page_id"))),
        F.when(F.col("page_id").isNull(), empty).otherwise(_line("X-Page-ID", F.col("page_id").cast("string"))),
        _line("WARC-Target-URI", one_line(F.col("url"))),
        _line("WARC-Date", F.lit(DATE)),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _uuid(F.col("first_id"))), _line("X-Refers-To-Page", F.col("first_id").cast("string")))).otherwise(empty),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )
    joined.select("sha256", head.cast("binary").alias("head"), F.sha2(head, 256).alias("head_sha256")).write.parquet(f"{path}/heads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record again: head, payload (of a revisit: of the response it refers to), its sha256, sha1 and bytes.

    Each payload is verified once, where it is stored, and each head on its own. The digest and the length that the join carries are
    those of the verified bytes, so a payload is read and verified whether or not it is asked for itself.
    """
    held = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    sound = F.sha2("payload", 256) == F.col("sha256")
    payload = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not match its digest")))
    held = held.select("sha256", payload.alias("payload"))
    payloads = held.select("sha256", "payload", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    heads = spark.read.parquet(f"{path}/heads")
    head = F.when(F.sha2("head", 256) == F.col("head_sha256"), F.col("head")).otherwise(F.raise_error(F.lit("a head does not match its digest")))
    back = heads.select("sha256", head.alias("head")).join(payloads, "sha256", "left")
    there = F.when(F.col("bytes").isNotNull(), F.col("sha256")).otherwise(F.raise_error(F.lit("a record's payload is not stored")))
    return back.select("head", "payload", there.alias("sha256"), "sha1", "bytes")


def fields(head: Column) -> Column:
    """A map of the header lines of a record, read up to the blank line; the first line of a name counts. Only CR LF ends a line."""
    lines = F.split(F.substring_index(head.cast("string"), CRLF * 2, 1), CRLF)
    pairs = F.transform(F.filter(lines, lambda x, i: (i > 0) & x.contains(": ")), lambda x: F.struct(F.substring_index(x, ": ", 1).alias("name"), F.substring(x, F.instr(x, ": ") + 2, F.length(x)).alias("value")))
    names = F.transform(pairs, lambda p: p["name"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(names, p["name"]) == i + 1))


def record_bytes(records: DataFrame) -> DataFrame:
    """The records as they stand in a WARC file: head, block, two line ends; a revisit has an empty block."""
    block = F.when(fields(F.col("head"))["WARC-Type"] == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select(F.concat("head", block, F.lit((CRLF * 2).encode())).alias("record"))


def describe(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, read off the records' own bytes."""
    told = records.select(fields(F.col("head")).alias("f"), "sha1", "bytes")
    digest = F.substring(F.col("f")["WARC-Payload-Digest"], 6, 32)
    return told.select(
        F.col("f")["X-Page-ID"].cast("long").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.when(digest == F.col("sha1"), digest).otherwise(F.raise_error(F.lit("a payload does not match its record's digest"))).alias("payload_digest"),
        F.col("f")["WARC-Type"].alias("record_type"),
        F.col("f")["X-Refers-To-Page"].cast("long").alias("refers_to"),
        F.coalesce(F.col("f")["WARC-Target-URI"], F.lit("")).alias("url"),
    )


#: DuckDB SQL for the query: base32 by five bits at a time.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     f AS (SELECT h, min(page_id) AS first_id, sha1(h) AS d FROM p GROUP BY h),
     b AS (SELECT *, list_reduce(list_prepend('', list_transform(range(1, 41), lambda i: ('0000000100100011010001010110011110001001101010111100110111101111')[(4 * (instr('0123456789abcdef', d[i]) - 1) + 1):(4 * instr('0123456789abcdef', d[i]))])), lambda x, y: x || y) AS bits FROM f),
     c AS (SELECT h, first_id, list_reduce(list_prepend('', list_transform(range(0, 32), lambda k: ('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[1 + 16 * bits[5 * k + 1]::INT + 8 * bits[5 * k + 2]::INT + 4 * bits[5 * k + 3]::INT + 2 * bits[5 * k + 4]::INT + bits[5 * k + 5]::INT])), lambda x, y: x || y) AS digest FROM b)
SELECT p.page_id, octet_length(encode(p.h)) AS payload_bytes, digest AS payload_digest,
       CASE WHEN p.page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN c ON p.h = c.h
"""
