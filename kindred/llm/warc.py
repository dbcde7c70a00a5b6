"""WARC archives of pages: write, read back, assemble transactions.

Each page becomes three WARC records: a request, a response (or, where a page
with an equal payload and a larger id exists, a revisit that refers to it) and
a metadata record. Response and metadata name the request in
``WARC-Concurrent-To``. The archives are gzipped WARC/1.0 text files that Spark
writes and cuts into records by itself: the reader's line separator is the end of one
record's last line and the version line of the next.

A payload may hold that version line. It is then sent with
``Transfer-Encoding: chunked`` and a chunk ends inside each such line, so it
never occurs within a record; the reader joins the chunks. Digests and lengths
are those of the payload itself.

Reading parses records into a table and joins the three kinds by the
concurrent-to identifier: one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import stage, whole_text
from kindred.session import scratch_path

BREAK = "\r\n"
RECORD_END = "\r\n\r\n"
VERSION = "WARC/1.0\r\n"
# No proper prefix of it recurs inside it, so a line reader that meets half of
# it at the end of a buffer needs no look back.
SEPARATOR = "\n" + VERSION
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed values: RFC 4648 base 32

RECORD_SCHEMA = ("kind string, record_id string, concurrent_to string, refers_to_id string, "
                 "target_uri string, payload_digest string, payload_bytes long, payload binary, "
                 "fields map<string,string>")


def base32_sha1(text):
    """Column: bare upper-case base 32 SHA-1 of a string's UTF-8 bytes."""
    hexed = F.sha1(text.cast("binary"))
    out = []
    for k in range(8):  # five hex digits are four base 32 digits
        v = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        for s in (15, 10, 5, 0):
            out.append(F.substring(F.lit(ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def _urn(*parts):
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                    F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"),
                    F.substring(h, 21, 12), F.lit(">"))


def page_records(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``record string``: three WARC records per page, without the final blank lines.

    Null html is an empty payload, a null url leaves the target out, a null
    page_id is written as an empty field (it loses against any other as the
    response of equal payloads). Repeated pages keep captures of their own, with
    record ids of their own; revisits refer to one of them.
    Payloads under ``min_bytes`` are never revisits.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"),
                     F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")),
                                      r"[\x00-\x20\x7F]", "%20").alias("url"),
                     whole_text("html").alias("html")) \
        .withColumn("bytes", F.octet_length("html")) \
        .withColumn("sha256", F.sha2(F.col("html").cast("binary"), 256))
    leads = p.where(F.col("bytes") >= min_bytes).groupBy("sha256", "page_id") \
        .agg(F.count(F.lit(1)).alias("copies")).groupBy("sha256") \
        .agg(F.max(F.struct("page_id", "copies")).alias("lead")) \
        .select("sha256", F.col("lead.page_id").alias("lead_id"), F.col("lead.copies").alias("copies"))
    leads = stage(leads, "warc-leads")
    # Hot payloads: the page side of this join is split by AQE, the other has one row per payload.
    p = p.join(leads, "sha256", "left")
    if leads.where("copies > 1").isEmpty():
        p = p.withColumn("nth", F.monotonically_increasing_id()).withColumn("own", F.lit(None).cast("long"))
    else:
        # Several rows of one lead: numbered in a table, as numbers made anew may differ; one keeps the plain id.
        again = F.col("page_id").eqNullSafe(F.col("lead_id")) & (F.coalesce("copies", F.lit(0)) > 1)
        rows = stage(p.where(again).withColumn("nth", F.monotonically_increasing_id()), "warc-repeated")
        first = rows.groupBy("sha256").agg(F.min("nth").alias("first"))
        rows = rows.join(first, "sha256").withColumn("own", F.when(F.col("nth") != F.col("first"), F.col("nth"))).drop("first")
        p = p.where(~again).withColumn("nth", F.monotonically_increasing_id()) \
            .withColumn("own", F.lit(None).cast("long")).unionByName(rows)
    p = p.withColumn("digest", base32_sha1(F.col("html"))) \
        .withColumn("is_revisit", F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("lead_id"))) \
        .withColumn("request_id", _urn(F.lit("request"), F.col("page_id"), F.col("sha256"), F.col("nth")))
    target = F.when(F.col("url") != "", F.concat(F.lit("WARC-Target-URI: "), F.col("url"), F.lit(BREAK))) \
        .otherwise(F.lit(""))

    def record(kind, record_id, headers, content_type, block):
        return F.concat(F.lit(VERSION), F.lit("WARC-Type: "), kind, F.lit(BREAK + "WARC-Record-ID: "), record_id,
                        F.lit(f"{BREAK}WARC-Date: {date}{BREAK}"), target, headers,
                        F.lit(f"Content-Type: {content_type}{BREAK}Content-Length: "),
                        F.octet_length(block).cast("string"), F.lit(RECORD_END), block)

    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), F.col("request_id"), F.lit(BREAK))
    request = record(F.lit("request"), F.col("request_id"), F.lit(""), "application/http; msgtype=request",
                     F.concat(F.lit("GET "), F.when(F.col("url") == "", F.lit("/")).otherwise(F.col("url")),
                              F.lit(" HTTP/1.1" + RECORD_END)))
    pieces = F.split("html", r"(?<=WARC/)(?=1\.0\r\n)", -1)
    chunked = F.concat(F.array_join(F.transform(F.filter(pieces, lambda x: x != ""), lambda x: F.concat(
        F.lower(F.hex(F.octet_length(x).cast("long"))), F.lit(BREAK), x, F.lit(BREAK))), ""),
        F.lit("0" + RECORD_END))
    needs_chunks = F.instr("html", VERSION) > 0
    body = F.when(F.col("is_revisit"), F.lit("")).when(needs_chunks, chunked).otherwise(F.col("html"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.when(needs_chunks & ~F.col("is_revisit"), F.lit("Transfer-Encoding: chunked\r\n"))
        .otherwise(F.concat(F.lit("Content-Length: "), F.col("bytes").cast("string"), F.lit(BREAK))),
        F.lit(BREAK), body)
    # Payloads without a lead are named by their row.
    own = F.coalesce("own", F.when(F.col("copies").isNull(), F.col("nth")))
    refers = F.when(F.col("is_revisit"), F.concat(
        F.lit("WARC-Refers-To: "), _urn(F.lit("response"), F.col("lead_id"), F.col("sha256"), F.lit(None)),
        F.lit(BREAK + "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" + BREAK))) \
        .otherwise(F.lit(""))
    answer = record(
        F.when(F.col("is_revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        F.when(F.col("is_revisit"), _urn(F.lit("revisit"), F.col("page_id"), F.col("sha256"), F.col("nth")))
        .otherwise(_urn(F.lit("response"), F.col("page_id"), F.col("sha256"), own)),
        F.concat(concurrent, refers, F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(BREAK)),
        "application/http; msgtype=response", http)
    about = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                     F.lit(BREAK + "payload_bytes: "), F.col("bytes").cast("string"), F.lit(BREAK))
    metadata = record(F.lit("metadata"),
                      _urn(F.lit("metadata"), F.col("page_id"), F.col("sha256"), F.col("nth")),
                      concurrent, "application/warc-fields", about)
    return p.select(F.explode(F.array(request, answer, metadata)).alias("record"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Gzip files, one per write task; a task's share bounds what one reader gets."""
    page_records(pages, min_bytes).write.option("lineSep", RECORD_END).text(path, compression="gzip")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path`` (``RECORD_SCHEMA``).

    A record whose lengths or payload digest don't hold is an error, not a
    skipped row. ``payloads=False`` checks and measures payloads but leaves
    them out of the rows.
    """
    lines = spark.read.option("lineSep", SEPARATOR).text(path) \
        .select(F.col("value").cast("binary").alias("value"))
    return lines.mapInPandas(lambda f: _parse(f, payloads), RECORD_SCHEMA)


def _headers(block: bytes) -> dict:
    out = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode().strip().lower()] = value.decode().strip()
    return out


def _payload(http: bytes):
    """Headers and body of an HTTP message; chunks are joined."""
    head, _, body = http.partition(b"\r\n\r\n")
    h = _headers(head)
    if h.get("transfer-encoding") != "chunked":
        return h, body
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end], 16)
        if n == 0:
            return h, b"".join(parts)
        parts.append(body[end + 2:end + 2 + n])
        at = end + 4 + n


def _parse(frames, payloads):
    import pandas as pd
    for frame in frames:
        rows = []
        for raw in frame["value"]:
            raw = bytes(raw)
            if raw.startswith(VERSION.encode()):  # the first record of a file
                raw = raw[len(VERSION):]
            if not raw:
                continue
            head, _, rest = raw.partition(b"\r\n\r\n")
            h = _headers(head)
            n = int(h["content-length"])
            if len(rest) < n or rest[n:].strip(b"\r\n"):  # cut at its length, so blank lines stay
                raise ValueError(f"record {h.get('warc-record-id')}: wrong length")
            block, kind = rest[:n], h["warc-type"]
            payload = size = None
            fields = {}
            digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
            if kind == "response":
                _, payload = _payload(block)
                size = len(payload)
                if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"record {h['warc-record-id']}: wrong payload digest")
                payload = payload if payloads else None
            elif kind == "revisit":
                size = int(_payload(block)[0]["content-length"])
            elif kind == "metadata":
                fields = _headers(block)
            rows.append((kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"),
                         h.get("warc-target-uri"), digest, size, payload, fields))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD_SCHEMA.split(", ")])


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``page_id, request, answer, metadata, refers_to``.

    ``answer`` is the response or revisit; ``refers_to`` the page id of the
    response that a revisit's ``WARC-Refers-To`` names.
    """
    part = F.struct("record_id", "target_uri", "refers_to_id", "payload_digest", "payload_bytes", "payload")
    request = records.where("kind = 'request'").select(
        F.col("record_id").alias("cid"), F.struct("record_id", "target_uri").alias("request"))
    answer = records.where("kind in ('response', 'revisit')").select(
        F.col("concurrent_to").alias("cid"), F.col("kind").alias("record_type"), part.alias("answer"))
    meta = records.where("kind = 'metadata'").select(
        F.col("concurrent_to").alias("cid"), F.struct("record_id", "fields").alias("metadata"))
    got = request.join(answer, "cid").join(meta, "cid").drop("cid") \
        .withColumn("page_id", F.expr("try_cast(metadata.fields['page_id'] as bigint)"))
    return got


def refer(captures: DataFrame) -> DataFrame:
    """Add ``refers_to``: the page id of the response each revisit refers to."""
    named = captures.where("record_type = 'response'").groupBy(F.col("answer.record_id").alias("rid")) \
        .agg(F.max("page_id").alias("refers_to"))
    return captures.join(named, F.col("answer.refers_to_id") == F.col("rid"), "left").drop("rid")


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0,
               payloads: bool = True) -> DataFrame:
    """Write ``pages`` as WARC files under the shared folder, read and assemble them.

    Without payloads the parsed records are small; they are kept as a table, so
    that the archives are parsed once for all joins.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write_warc(pages, path, min_bytes)
    records = read_warc(spark, path, payloads)
    return refer(assemble(records if payloads else stage(records, "warc-records")))
