"""WARC archives: write captures, read records, assemble transactions.

Each capture becomes three records: response (or revisit), request and metadata; the latter two name
the first by WARC-Concurrent-To.  Archives are written by Spark's text writer, whose line separator
is the end of a WARC record, so they go to any store Spark can write; files stay near
``FILE_BYTES`` of payload.  Reading goes by Content-Length, so payloads may hold anything.
``assemble`` joins the records through their concurrent-to identifiers into one nested row each.

Defined cases: a null payload is empty; control characters and blanks in URLs are percent-encoded, a
null URL gives no target header; rows with null ids are written and come back with null ids; of
repeated rows with the smallest id all are responses; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, written

FILE_BYTES = 16_000_000
#: Payloads below this are always stored.
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
EOL, END = "\r\n", "\r\n\r\n"
#: Fixed value: the profile of revisits by payload digest.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "record_id string, type string, concurrent_to array<string>, target_uri string, date string, payload_digest string, "
    "content_type string, content_length long, http_header string, payload binary"
)


def _record(kind, record_id, headers: list, content_type: str, block):
    """One record without its closing blank lines; header entries may be null and are then left out."""
    head = [F.lit(f"WARC/1.1{EOL}WARC-Type: "), kind, F.lit(f"{EOL}WARC-Record-ID: <urn:uuid:"), record_id, F.lit(f">{EOL}WARC-Date: {DATE}{EOL}")]
    for name, value in headers:
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit("")))
    return F.concat(*head, F.lit(f"Content-Type: {content_type}{EOL}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def plan_captures(captures: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """id, url, payload, digest, refers_to: the id of the response that a revisit points to."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    firsts = large.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first_id")
    joined = rows.join(firsts, rows["digest"] == firsts["d"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return joined.select("id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_archives(captures: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write captures as gzipped archives below ``path``."""
    size, n = captures.agg(F.sum(F.octet_length(F.col(payload_col).cast("string"))), F.count("*")).first()
    per_file = max(1, int(FILE_BYTES / max(1.0, (size or 0) / max(n, 1) + 1500)))
    rows = plan_captures(captures, id_col, url_col, payload_col)
    rows = rows.select("*", F.uuid().alias("rid"), F.uuid().alias("qid"), F.uuid().alias("mid"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    revisit = F.col("refers_to").isNotNull()
    size_text = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), size_text, F.lit(END))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"), F.col("rid"),
        [("WARC-Target-URI", url), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("WARC-Profile", F.when(revisit, REVISIT_PROFILE))],
        "application/http; msgtype=response", F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload"))),
    )
    concurrent = ("WARC-Concurrent-To", F.concat(F.lit("<urn:uuid:"), F.col("rid"), F.lit(">")))
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    target = F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^#]*)", 1)
    request = _record(
        F.lit("request"), F.col("qid"), [("WARC-Target-URI", url), concurrent], "application/http; msgtype=request",
        F.concat(F.lit("GET "), F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(F.lit("/"), target)), F.lit(f" HTTP/1.1{EOL}Host: "), host, F.lit(END)),
    )
    fields = F.concat(
        F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(EOL)), F.lit("")), F.lit("payload-bytes: "), size_text, F.lit(EOL),
        F.coalesce(F.concat(F.lit("refers-to-page: "), F.col("refers_to").cast("string"), F.lit(EOL)), F.lit("")),
    )
    metadata = _record(F.lit("metadata"), F.col("mid"), [("WARC-Target-URI", url), concurrent], "application/warc-fields", fields)
    text = rows.select(F.concat(response, F.lit(END), request, F.lit(END), metadata).alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(content: bytes):
    """Records of one archive (gzipped or not) as tuples in RECORD_SCHEMA's order."""
    if content[:2] == b"\x1f\x8b":
        parts = []
        while content:  # one member or many
            member = zlib.decompressobj(31)
            parts.append(member.decompress(content) + member.flush())
            content = member.unused_data
        content = b"".join(parts)
    at = 0
    while (at := content.find(b"WARC/", at)) >= 0:
        stop = content.index(b"\r\n\r\n", at)
        head: dict[str, list[str]] = {}
        for line in content[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head.setdefault(name.strip().lower(), []).append(value.strip())
        n = int(head["content-length"][0])
        block = content[stop + 4 : stop + 4 + n]
        at = stop + 4 + n
        one = lambda k: head.get(k, [None])[0]
        http = None
        if (one("content-type") or "").startswith("application/http"):
            top, gap, rest = block.partition(b"\r\n\r\n")
            http, block = top.decode("utf-8", "replace"), rest if gap else b""
        yield one("warc-record-id"), one("warc-type"), head.get("warc-concurrent-to", []), one("warc-target-uri"), one("warc-date"), one("warc-payload-digest"), one("content-type"), n, http, block


def read_archives(spark: SparkSession, path: str, digest_payloads: bool = False) -> DataFrame:
    """All records below ``path``.  With ``digest_payloads`` the payloads of responses are digested where
    they are read: payload_bytes and payload_sha256 take the payload's place."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    schema = RECORD_SCHEMA
    if digest_payloads:
        names, types = [*names, "payload_bytes", "payload_sha256"], [*types, pa.int64(), pa.string()]
        schema += ", payload_bytes long, payload_sha256 string"

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for row in parse(content.as_py()):
                    if digest_payloads:
                        row = (*row[:-1], None if row[1] == "response" else row[-1], len(row[-1]), hashlib.sha256(row[-1]).hexdigest())
                    rows.append(row)
                    size += len(row[9] or b"") + 500
                    if size > 4_000_000:
                        yield emit(rows)
                        rows, size = [], 0
        if rows:
            yield emit(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response (or revisit), requests, metadata.

    ``records`` should be a stored table: it is read three times.  Requests and metadata without their
    response come out with a null response.
    """
    fields = [c for c in records.columns if c != "concurrent_to"]
    main = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.struct(*fields).alias("response"))
    out = main
    for kind, name in (("request", "requests"), ("metadata", "metadata")):
        side = records.where(F.col("type") == kind).select(F.explode("concurrent_to").alias("capture_id"), F.struct(*fields).alias("r"))
        out = out.join(side.groupBy("capture_id").agg(F.collect_list("r").alias(name)), "capture_id", "full_outer")
    return out


def field(block, name: str):
    """A field of application/warc-fields."""
    got = F.regexp_extract(F.concat(F.lit("\n"), block), rf"\n{re.escape(name)}: ?([^\r\n]*)", 1)
    return F.when(got != "", got)


def round_trip(captures: DataFrame, path: str | None = None, id_col: str = "page_id") -> DataFrame:
    """Write archives, read them back, and give id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = captures.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(captures, path, id_col)
    nested = assemble(written(read_archives(spark, path, digest_payloads=True), "records"))
    block = F.col("metadata")[0]["payload"].cast("string")
    stored = F.col("response.type") == "response"
    kind = captures.schema[id_col].dataType.simpleString()
    return nested.where(F.col("response").isNotNull()).select(
        field(block, "page-id").cast(kind).alias(id_col),
        F.when(stored, F.col("response.payload_bytes")).otherwise(field(block, "payload-bytes").cast("long")).alias("payload_bytes"),
        F.when(stored, F.col("response.payload_sha256")).otherwise(F.substring_index("response.payload_digest", ":", -1)).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        field(block, "refers-to-page").cast(kind).alias("refers_to"),
        F.col("response.target_uri").alias("target_uri"),
    )
