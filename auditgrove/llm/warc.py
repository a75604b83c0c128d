"""Content-addressed WARC archive.

``payloads``  sha256, n_bytes, payload: each distinct payload once, dealt by digest.
``headers``   page_id, record (the exact bytes of WARC header and HTTP header block), sha256, record_type.

Of the records with equal payloads the one with the largest page_id is the response, the others are revisits that refer to it;
payloads under ``least`` bytes are never deduplicated by reference (their records are all responses) but still stored once. ``read_index`` verifies every payload against its digest and
parses the stored headers; ``reconstruct`` joins both into the original records.

Defined results: a null html is an empty payload; rows with one page_id and payload are equal records, of which all with the
largest page_id are responses; a null page_id is record ``page:null`` and sorts below all others; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditgrove.llm.shared import Scratch, alias_free, bound_batches, emit

LEAST_BYTES = 0
#: Pages carry no time of their own; every record needs a WARC-Date.
DATE = "1970-01-01T00:00:00Z"
UNSAFE = re.compile(r"[\s\x00-\x1f\x7f]+")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DIGESTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("sha256", pa.binary()), ("sha1", pa.binary()), ("n_bytes", pa.int64())])
INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("sha256", pa.binary())])


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(value: str) -> int | None:
    number = value[len("<urn:page:") : -1]
    return None if number == "null" else int(number)


def header_bytes(page_id, url, sha1: bytes, n_bytes: int, owner, response: bool, date: str = DATE) -> bytes:
    """Exact bytes of a record before its payload."""
    http = HTTP % n_bytes
    target = UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")
    fields = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}"]
    if target != (url or ""):  # white space and control characters cannot stand in a header
        fields.append(f"X-Original-URI: {(url or '').encode('unicode_escape').decode()}")
    if not response:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(owner)}"]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (n_bytes if response else 0)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http


def parse_header(raw: bytes) -> dict:
    """What the index tells of a record, from its stored header bytes."""
    warc, http = raw.split(b"\r\n\r\n", 1)
    fields = dict((line + " ").split(": ", 1) if line.endswith(":") else line.split(": ", 1) for line in warc.decode().split("\r\n")[1:])
    length = next(int(line.split(b": ")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
    owner = fields.get("WARC-Refers-To")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "url": fields["X-Original-URI"].encode().decode("unicode_escape") if "X-Original-URI" in fields else fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": fields["WARC-Type"], "refers_to": page_of(owner) if owner else None}


def write_archive(pages: DataFrame, root: str, least: int = LEAST_BYTES, date: str = DATE) -> None:
    """Write the archive of ``pages`` (page_id, url, html), fetched at ``date``, below ``root``. The html is shuffled once."""
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "warc")
    bound_batches(spark)
    source = alias_free(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))

    def digests(batches):
        for batch in batches:
            raw = batch.column("payload").to_pylist()
            yield emit({"page_id": batch.column("page_id"), "url": batch.column("url"), "sha256": [hashlib.sha256(p).digest() for p in raw], "sha1": [hashlib.sha1(p).digest() for p in raw], "n_bytes": [len(p) for p in raw]}, DIGESTS)

    known = scratch.keep(source.mapInArrow(digests, "page_id long, url string, sha256 binary, sha1 binary, n_bytes long"), "digests")
    payloads = source.select(F.unhex(F.sha2("payload", 256)).alias("sha256"), F.length("payload").cast("long").alias("n_bytes"), "payload")
    payloads.dropDuplicates(["sha256", "n_bytes"]).write.option("compression", "zstd").parquet(f"{root}/payloads")
    # owners are counted per digest before the shuffle; copies of one payload meet only as small rows
    owners = known.groupBy("sha256").agg(F.max("page_id").alias("owner"))
    joined = known.join(owners, "sha256")

    def headers(batches):
        for batch in batches:
            rows = batch.to_pylist()
            kinds = [r["n_bytes"] < least or r["page_id"] == r["owner"] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([header_bytes(r["page_id"], r["url"], r["sha1"], r["n_bytes"], r["owner"], k, date) for r, k in zip(rows, kinds)], pa.binary()), batch.column("sha256"), pa.array(["response" if k else "revisit" for k in kinds])], names=["page_id", "record", "sha256", "record_type"])

    joined.select("page_id", "url", "sha1", "n_bytes", "owner", "sha256").mapInArrow(headers, "page_id long, record binary, sha256 binary, record_type string").write.option("compression", "zstd").parquet(f"{root}/headers")
    scratch.drop(known)


def _headers(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("page_id long, record binary, sha256 binary, record_type string").parquet(f"{root}/headers")


def _payloads(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("sha256 binary, n_bytes long, payload binary").parquet(f"{root}/payloads")


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """One row per record, from the stored headers, checked against the digests and sizes of the stored payloads."""
    bound_batches(spark)

    def verify(batches):
        for batch in batches:
            raw, claimed = batch.column("payload").to_pylist(), batch.column("sha256").to_pylist()
            if any(hashlib.sha256(p).digest() != d for p, d in zip(raw, claimed)):
                raise ValueError("a payload does not match its digest")
            yield pa.RecordBatch.from_arrays([batch.column("sha256"), pa.array([len(p) for p in raw], pa.int64()), pa.array([base64.b32encode(hashlib.sha1(p).digest()).decode() for p in raw])], names=["sha256", "stored_bytes", "stored_digest"])

    stored = _payloads(spark, root).select("sha256", "payload").mapInArrow(verify, "sha256 binary, stored_bytes long, stored_digest string")

    def parse(batches):
        for batch in batches:
            rows = [parse_header(r) for r in batch.column("record").to_pylist()]
            yield emit({f.name: batch.column("sha256") if f.name == "sha256" else [r[f.name] for r in rows] for f in INDEX}, INDEX)

    index = _headers(spark, root).select("record", "sha256").mapInArrow(parse, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, sha256 binary")
    out = index.join(stored, "sha256", "left")
    same = (F.col("payload_bytes") == F.col("stored_bytes")) & (F.col("payload_digest") == F.col("stored_digest"))
    checked = F.when(F.coalesce(same, F.lit(False)), F.col("stored_bytes")).otherwise(F.raise_error(F.lit("a record does not match its payload")).cast("long"))
    return out.select("page_id", "url", checked.alias("payload_bytes"), F.col("stored_digest").alias("payload_digest"), "record_type", "refers_to")


def reconstruct(spark: SparkSession, root: str) -> DataFrame:
    """page_id and the exact bytes of every record; a revisit has no payload of its own."""
    headers, end = _headers(spark, root), F.lit(bytes(b"\r\n\r\n"))
    full = headers.where("record_type = 'response'").join(_payloads(spark, root), "sha256").select("page_id", F.concat("record", "payload", end).alias("record"))
    return full.unionByName(headers.where("record_type = 'revisit'").select("page_id", F.concat("record", end).alias("record")))


def original_payloads(spark: SparkSession, root: str) -> DataFrame:
    """page_id and payload of every record, revisits resolved."""
    return _headers(spark, root).select("page_id", "sha256").join(_payloads(spark, root), "sha256").select("page_id", "payload")
