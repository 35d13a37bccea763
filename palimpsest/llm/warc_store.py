"""Content-addressed WARC archive.

An archive is two Parquet tables in one folder. ``payloads`` holds every distinct
payload once under its SHA-256; ``headers`` holds the exact header block of every
record (WARC header lines and the HTTP head, without the payload) and the address
of its payload. The two together give back the original records by a join.
Digests are verified on reading: a stored payload whose bytes no longer give its
address is an error.

No Python runs on the rows; payload bytes are shuffled only once, when written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, materialize

_CRLF = "\r\n"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, by five hex digits (20 bits) to four characters."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(name: Column) -> Column:
    h = F.md5(name)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


_CONTROLS = [*range(32), 127]


def header_safe(text: Column) -> Column:
    """``text`` with control characters percent-encoded, so that it stays within its header line."""
    out = text
    for code in _CONTROLS:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(text.rlike("[\\x00-\\x1F\\x7F]"), out).otherwise(text)


def _key_text(key: Column) -> Column:
    """A key as a header value that gives it back exactly; null is empty."""
    return F.coalesce(F.url_encode(key.cast("string")), F.lit(""))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for every row of ``pages`` to the archive at ``path``.

    The payload is the html in UTF-8; null counts as empty. Of records with equal
    payloads of at least ``min_bytes``, the one with the largest key is a response
    and the others revisit it; below that size each is a response. Repeated rows
    (same key, same payload) have the same type. A null key is smaller than any
    other; a null url is written as an empty target. Equal payloads are one stored
    payload, whatever their number.

    Control characters of a url are percent-encoded in its header line; the exact url
    stays in the column ``target``. A record's id comes from its key, url and payload,
    so only repeated rows share one. The keys of a record and of what it revisits stand
    in extension fields of its header.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("record_id"), F.coalesce(F.col(url), F.lit("")).alias("target"), payload.alias("payload"))
    rows = rows.withColumns({"address": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    heads = rows.withColumn("payload_digest", sha1_base32(F.col("payload"))).drop("payload")
    # Only addresses with more than one record take part in the join.
    newest = F.max(F.struct("record_id", "target"))
    groups = heads.groupBy("address").agg(newest["record_id"].alias("first_id"), newest["target"].alias("first_target"), F.count("*").alias("n")).where("n > 1")
    heads = join_hot(heads, materialize(groups, "payload-groups"), "address")
    revisit = F.col("first_id").isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    heads = heads.withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit"), F.col("first_id")))
    http = F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}{_CRLF}")
    uri = lambda key, url: F.concat(F.lit("<urn:uuid:"), _uuid(F.concat_ws(" ", F.lit("record"), "address", _key_text(F.col(key)), F.coalesce(url, F.lit("")))), F.lit(">"))
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    length = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("payload_bytes"))
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    warc = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), kind,
        F.lit(f"{_CRLF}WARC-Record-ID: "), uri("record_id", "target"),
        F.lit(f"{_CRLF}WARC-Date: {date}{_CRLF}WARC-Target-URI: "), header_safe(F.col("target")),
        F.lit(f"{_CRLF}Record-Key: "), _key_text(F.col("record_id")),
        F.lit(f"{_CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(F.col("revisit"), F.concat(F.lit(f"{_CRLF}WARC-Refers-To: "), uri("refers_to", "first_target"), F.lit(f"{_CRLF}Refers-To-Key: "), _key_text(F.col("refers_to")), F.lit(f"{_CRLF}WARC-Profile: {profile}"))).otherwise(""),
        F.lit(f"{_CRLF}Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "), length.cast("string"),
        F.lit(_CRLF + _CRLF), http,
    )
    heads.select("record_id", "address", "target", warc.alias("head")).write.parquet(f"{path}/headers")
    # Grouping by the address keeps one copy of the bytes, already within each task.
    rows.groupBy("address").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")


def _headers(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/headers")
    field = lambda name: F.regexp_extract("head", f"(?:^|\\r\\n){name}: ([^\\r\\n]*)", 1)
    kind = rows.schema["record_id"].dataType
    refers_to = F.when(field("WARC-Type") == "revisit", F.url_decode(F.nullif(field("Refers-To-Key"), F.lit(""))).cast(kind))
    return rows.withColumns({"record_type": field("WARC-Type"), "refers_to": refers_to, "stated_digest": F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "")})


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/payloads")
    good = F.assert_true(F.sha2("payload", 256) == F.col("address"), F.concat(F.lit("payload does not give its address "), F.col("address")))
    return rows.where(good.isNull())


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per record: record_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest are taken from the stored bytes, once for each distinct payload,
    before the join with the headers; they must agree with the digest that the
    header states, and a record whose payload is not stored is an error. The type and
    what a revisit refers to are read from the header. Payloads with many records
    (the empty one, for example) are joined apart, so no task gets all of one's records.
    """
    stored = _payloads(spark, path).select("address", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))
    heads = spark.read.parquet(f"{path}/headers").select("address")
    counts = heads.groupBy("address").agg(F.count("*").alias("n"))
    named = materialize(stored.join(counts, "address"), "payload-digests")
    rows = join_hot(_headers(spark, path).drop("target", "head"), named, "address", total=heads.count())
    agree = F.assert_true(F.col("payload_digest") == F.col("stated_digest"), F.lit("header and payload digests differ"))
    return rows.where(agree.isNull()).select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def read_records(spark: SparkSession, path: str, expand_revisits: bool = False) -> DataFrame:
    """Per record: record_id, record_type, refers_to, payload, and ``record``: its exact bytes.

    A revisit record has no payload bytes of its own in ``record``; ``payload`` is the
    full payload in either case. With ``expand_revisits`` the revisits' payload is
    also put into ``record``.
    """
    rows = _headers(spark, path).join(_payloads(spark, path), "address")
    own = F.when((F.col("record_type") == "response") | F.lit(expand_revisits), F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.col("head").cast("binary"), own, F.lit(f"{_CRLF}{_CRLF}").cast("binary"))
    return rows.select("record_id", "record_type", "refers_to", "payload", record.alias("record"))
