"""WARC archives: written by Spark's text sink, read back record by record,
and assembled into captures through concurrent-to identifiers.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BREAK = "\r\n\r\n"  # ends a header block, and a record
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits make four base-32 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def urn(*parts: Column) -> Column:
    """A record id that follows from what the record is about."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    pieces = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def record(kind: Column, record_id: Column, headers: dict[str, Column], block: Column) -> Column:
    """A whole record but for the break after it; null headers are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers.items()]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(BREAK), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_revisit: int = 0) -> None:
    """Write a request, a response or revisit, and a metadata record for each page.

    Of pages with equal bodies of at least `least_revisit` bytes, the one with
    the largest id is the response and the others revisit it.  A null body is
    empty, a null url gives no target header, a null id is smaller than any.
    Page rows repeated in full are written as often as they stand, under the
    one record id that follows from what they hold.
    """
    rows = pages.select(
        pages[id_col].alias("id"),
        F.regexp_replace(F.regexp_replace(pages[url_col], "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(pages[body_col], F.lit("")).alias("body"),
    ).withColumn("sha", F.sha2("body", 256))
    tops = (
        rows.where(F.octet_length("body") >= least_revisit)
        .groupBy("sha")
        .agg(F.max("id").alias("top"), F.max_by("url", "id").alias("top_url"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    body, url, page = F.col("body"), F.col("url"), F.col("id")
    revisits = F.col("top").isNotNull() & ~page.eqNullSafe(F.col("top"))
    own = urn(F.lit("capture"), page, url, F.col("sha"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(BREAK))
    target = {"WARC-Target-URI": url}
    captured = record(
        F.when(revisits, "revisit").otherwise("response"),
        own,
        target
        | {
            "WARC-Payload-Digest": F.concat(F.lit("sha1:"), base32_sha1(body.cast("binary"))),
            "WARC-Profile": F.when(revisits, PROFILE),
            "WARC-Refers-To": F.when(revisits, urn(F.lit("capture"), F.col("top"), F.col("top_url"), F.col("sha"))),
            "Content-Type": F.lit("application/http; msgtype=response"),
        },
        F.when(revisits, http).otherwise(F.concat(http, body)),
    )
    host = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    asked = F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(BREAK))
    request = record(F.lit("request"), urn(F.lit("request"), own), target | {"WARC-Concurrent-To": own, "Content-Type": F.lit("application/http; msgtype=request")}, asked)
    fields = F.coalesce(F.concat(F.lit("page-id: "), page.cast("string"), F.lit("\r\n")), F.lit(""))
    metadata = record(F.lit("metadata"), urn(F.lit("metadata"), own), target | {"WARC-Concurrent-To": own, "Content-Type": F.lit("application/warc-fields")}, fields)
    joined = rows.join(tops, "sha", "left")
    joined.select(F.concat_ws(BREAK, request, captured, metadata).alias("value")).write.option("lineSep", BREAK).option("compression", "gzip").text(path)


RECORD = pa.schema(
    [(n, pa.string()) for n in ("record_id", "kind", "concurrent_to", "refers_to", "target_uri", "date", "declared_digest", "http")]
    + [("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)
RECORD_DDL = "record_id string, kind string, concurrent_to string, refers_to string, target_uri string, date string, declared_digest string, http string, payload binary, payload_bytes bigint, payload_digest string"


def parsed(head: bytes, block: bytes) -> tuple:
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    http, payload = None, block
    if fields.get(b"content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = top.decode("utf-8", "replace")
    get = fields.get
    digest = get(b"warc-payload-digest")
    return (
        get(b"warc-record-id"), get(b"warc-type"), get(b"warc-concurrent-to"), get(b"warc-refers-to"), get(b"warc-target-uri"), get(b"warc-date"),
        digest and digest.partition(":")[2], http, payload, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
    )


def _records(batches):
    """Rejoin what the text source split at every break, by the declared lengths."""
    brk, buffer, need, head = b"\r\n\r\n", bytearray(), None, b""
    out: list[tuple] = []
    size = 0
    for batch in batches:
        for part in batch.column(0).to_pylist():
            buffer += part
            buffer += brk
            while True:
                if need is None:
                    while buffer[:2] == b"\r\n":
                        del buffer[:2]
                    end = buffer.find(brk)
                    if end < 0:
                        break
                    head = bytes(buffer[:end])
                    length = next((line for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")), None)
                    if not head.startswith(b"WARC/") or length is None:
                        raise ValueError(f"no WARC record at {head[:60]!r}")
                    at = end + 4
                    need = at + int(length.partition(b":")[2])
                if len(buffer) < need + 4:
                    break
                out.append(parsed(head, bytes(buffer[at:need])))
                size += need
                del buffer[: need + 4]
                need = None
            if size > 4_000_000 or len(out) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), RECORD)], schema=RECORD)
                out, size = [], 0
    if need is not None:
        raise ValueError("an archive ends inside a record")
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), RECORD)], schema=RECORD)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of gzipped archives; a payload may hold any bytes.

    Compressed files are never split, so a task sees the parts of a record in
    order.  An archive cut off inside a record is an error, not a silent loss.
    """
    parts = spark.read.option("lineSep", BREAK).text(path)
    return parts.select(F.col("value").cast("binary").alias("value")).mapInArrow(_records, RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture, request, response, metadata, n_requests, n_metadata, n_responses).

    A response or revisit record is a capture; request and metadata records
    join it by their concurrent-to id (without one, by their own).  Of several
    requests or metadata records the one with the smallest record id is shown
    and all are counted.  Records without a response make a row with a null
    response; a record id met twice is one record, and `n_responses` says how
    often a capture's was met: as often as its page row was written.
    """
    def of(kinds: list[str], key: Column, prefix: str) -> DataFrame:
        names = [c for c in records.columns]
        return records.where(F.col("kind").isin(kinds)).select(key.alias("capture"), *[F.col(n).alias(f"{prefix}_{n}") for n in names])

    def gathered(prefix: str) -> DataFrame:
        own = of([prefix], F.coalesce("concurrent_to", "record_id"), prefix).dropDuplicates([f"{prefix}_record_id"])
        rest = [c for c in own.columns if c not in ("capture", f"{prefix}_record_id")]
        best = F.min(f"{prefix}_record_id").alias(f"{prefix}_record_id")
        return own.groupBy("capture").agg(best, F.count(F.lit(1)).alias(f"n_{prefix}"), *[F.min_by(c, f"{prefix}_record_id").alias(c) for c in rest])

    captured = of(["response", "revisit"], F.col("record_id"), "response")
    response = captured.groupBy("capture").agg(F.count(F.lit(1)).alias("n_response"), *[F.first(c).alias(c) for c in captured.columns if c != "capture"])
    joined = response.join(gathered("request"), "capture", "full").join(gathered("metadata"), "capture", "full")

    def nested(prefix: str) -> Column:
        fields = [F.col(f"{prefix}_{n}").alias(n) for n in records.columns]
        return F.when(F.col(f"{prefix}_record_id").isNotNull(), F.struct(*fields)).alias(prefix)

    return joined.select(
        "capture", nested("request"), nested("response"), nested("metadata"),
        F.coalesce("n_request", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"),
        F.coalesce("n_response", F.lit(0)).alias("n_responses"),
    )


def page_of(metadata: Column) -> Column:
    """The page id in a capture's metadata fields, as text."""
    return F.nullif(F.regexp_extract(metadata.getField("payload").cast("string"), "page-id: ([^\r\n]*)", 1), F.lit(""))


def resolved(captures: DataFrame) -> DataFrame:
    """A row for each time a capture was met, with the payload facts of a revisit taken from the response it refers to."""
    flat = captures.select(
        F.greatest("n_responses", F.lit(1)).alias("met"),
        page_of(F.col("metadata")).alias("page"),
        F.col("response.target_uri").alias("url"),
        F.col("response.kind").alias("record_type"),
        F.col("response.record_id").alias("record_id"),
        F.col("response.refers_to").alias("refers_to"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
    )
    sources = flat.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page").alias("source_page"), F.col("payload_bytes").alias("source_bytes"), F.col("payload_digest").alias("source_digest")
    )
    joined = flat.join(sources, "refers_to", "left")
    revisit = F.col("record_type") == "revisit"
    joined = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("met"))))
    return joined.select(
        "page", "url", "record_type",
        F.when(revisit, F.col("source_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("source_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(revisit, F.col("source_page")).alias("refers_to"),
    )
