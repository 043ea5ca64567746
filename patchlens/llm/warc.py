"""WARC archives: writing, reading, and revisit resolution.

Archives are WARC/1.1 in which each record is a gzip member of its own, so a record can be read by itself. Spark's text sink
writes them and its text source reads them back: the line separator is an empty gzip member, which any gzip reader passes
over, so a file is split at record boundaries into tasks of bounded bytes, and a task holds a few records at a time, never an
archive. Each file begins with a warcinfo record.

Revisit resolution unpacks the heads of the records alone, shuffles the headers by payload digest, finds one original response
for each digest, joins the other records to it as revisits, and writes new archives with fresh headers, in which each payload
stands once. Originals come from a pre-aggregated groupBy; headers with a digest that holds a large share of the records are
joined without a shuffle by digest. Payloads are moved once, packed as they are, by record, and only those that may be
originals: within a batch of records, the largest of its digest.

Defined cases: a null payload is an empty one, and empty payloads are equal to each other; a null or empty url gives a urn;
payloads of any length are worked whole, one at a time; of records with equal payloads and page_id one is the response and the
others revisit it; a null page_id is smaller than any other and stays null; an empty table gives archives of warcinfo records
alone; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm.common import delete, drop_kept, join_hot, keep, new_path, table

END = b"\r\n\r\n"
#: An empty gzip member; what stands between the records of a file.
BETWEEN = bytes.fromhex("1f8b08000000000002ff03000000000000000000")
HEADER_KIND = "record_id string, record_type string, page_id long, url string, captured string, payload_digest string, payload_bytes long, refers_to long"
#: Records are handed on after so many bytes.
ANSWER_BYTES = 8_000_000


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def packed(record: bytes, level: int = 6) -> bytes:
    """The record as a gzip member; with another level where the bytes of BETWEEN would occur in it."""
    for x in (level, *range(1, 10)):
        made = zlib.compressobj(x, zlib.DEFLATED, 31)
        member = made.compress(record) + made.flush()
        if BETWEEN not in member:
            return member
    raise ValueError("a record can't be told from the separator")


def head_of(member: bytes) -> dict[str, str]:
    """The header fields of a record, unpacking no more than they need."""
    unpack, head = zlib.decompressobj(31), b""
    while END not in head:
        part = unpack.decompress(unpack.unconsumed_tail if head else member, 1024)
        if not part:
            raise ValueError("a record has no end of its header")
        head += part
    lines = head[: head.index(END)].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    return dict(x.split(": ", 1) for x in lines[1:])


def payload_of(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record; lengths and the digest of a response must agree."""
    record = zlib.decompress(member, 31)
    fields, begin = head_of(member), record.index(END) + 4
    block = record[begin : begin + int(fields["Content-Length"])]
    if record[begin + len(block) :] != END or len(block) != int(fields["Content-Length"]):
        raise ValueError(f"{fields['WARC-Record-ID']}: the record has another length than its header says")
    payload = block[block.index(END) + 4 :] if fields["WARC-Type"] in ("response", "revisit") else block
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{payload_digest(payload)}":
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload has another digest than its header says")
    return fields, payload


def record_bytes(kind: str, record_id: str, page_id: int | None, uri: str, captured: str, digest: str, length: int, payload: bytes = b"", original: tuple | None = None) -> bytes:
    """One record. A revisit has the HTTP header alone as its block. original: record id, page_id, uri, date of the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload
    fields = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {captured}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {length}"]
    if page_id is not None:
        fields.append(f"WARC-Page-ID: {page_id}")
    if original:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {original[0]}", f"WARC-Refers-To-Target-URI: {original[2]}", f"WARC-Refers-To-Date: {original[3]}"]
        if original[1] is not None:
            fields.append(f"WARC-Refers-To-Page-ID: {original[1]}")
    return "\r\n".join([*fields, f"Content-Length: {len(block)}", "", ""]).encode() + block + END


def _info(records: Iterator[bytes], captured: str) -> Iterator[bytes]:
    """The members of a file: a warcinfo record, then records."""
    block = b"software: patchlens\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{uuid.uuid5(uuid.NAMESPACE_URL, captured).urn}>", f"WARC-Date: {captured}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    yield packed("\r\n".join(head).encode() + block + END)
    yield from records


def _batches(members: Iterator[bytes], name: str) -> Iterator[pa.RecordBatch]:
    """The members in batches of bounded bytes."""
    held: list[bytes] = []
    size = 0
    for member in members:
        held.append(member)
        size += len(member)
        if size >= ANSWER_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=[name])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=[name])


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _write(members: DataFrame, path: str) -> None:
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", BETWEEN.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """member: the packed records of the archives under path, one a row."""
    read = spark.read.option("lineSep", BETWEEN.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return read.select(F.col("value").cast("binary").alias("member"))


def _fields(fields: dict[str, str]) -> tuple:
    number = [int(x) if (x := fields.get(k)) else None for k in ("WARC-Page-ID", "WARC-Refers-To-Page-ID")]
    return fields["WARC-Record-ID"], fields["WARC-Type"], number[0], fields["WARC-Target-URI"], fields["WARC-Date"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"]), number[1]


def read_archive(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The headers of responses and revisits. With verify, payloads are unpacked and must have the length and digest told."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch["member"]:
                fields = payload_of(x.as_py())[0] if verify else head_of(x.as_py())
                if fields["WARC-Type"] != "warcinfo":
                    rows.append(_fields(fields))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in HEADER_KIND.split(", ")])

    return read_members(spark, path).mapInArrow(read, HEADER_KIND)


def archive_pages(pages: DataFrame, path: str, captured: str | None = None) -> None:
    """A response record for each row of pages(page_id, url, html), captured at a time, by default now."""
    date = captured or _now()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for row, page_id, url, html in zip(*[batch[c] for c in ("row", "page_id", "url", "html")], strict=True):
                    row, page_id, url, payload = row.as_py(), page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "replace")
                    uri = quote(url, safe="".join(map(chr, range(33, 127)))) if url else f"urn:page:{page_id}"
                    record_id = f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{date}:{row}').urn}>"
                    yield packed(record_bytes("response", record_id, page_id, uri, date, payload_digest(payload), len(payload), payload))

        yield from _batches(_info(records(), date), "member")

    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    _write(rows.mapInArrow(build, "member binary"), path)


def resolve_revisits(spark: SparkSession, source: str, target: str, least_bytes: int = 0) -> None:
    """Rewrite the archives of `source` to `target` with each payload of at least least_bytes stored once.

    Of records with equal payloads the one with the largest page_id is the response; the others become revisits of it.
    """
    headers = keep(read_archive(spark, source, verify=False).where("record_type = 'response'"), "headers")
    place = F.struct("page_id", "record_id", "url", "captured")
    originals = headers.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max(place).alias("original"), F.count(F.lit(1)).alias("n"))
    counts = originals.select("payload_digest", "n")
    decided = join_hot(headers.drop("refers_to", "record_type"), originals.drop("n"), "payload_digest", counts)
    own = (F.col("payload_bytes") < least_bytes) | (F.col("original.record_id") == F.col("record_id"))
    plain = ["record_id", "page_id", "url", "captured", "payload_digest", "payload_bytes"]
    revisits = decided.where(~own).select(*plain, "original", F.lit(None).cast("binary").alias("member"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the records of a batch those that may be originals: the largest of each digest, in the order of `place`, and all small ones."""
        for batch in batches:
            most: dict[str, tuple] = {}
            rows = []
            for k, x in enumerate(batch["member"]):
                fields = head_of(x.as_py())
                if fields["WARC-Type"] != "response":
                    continue
                record_id, _, page_id, uri, captured, digest, length, _ = _fields(fields)
                if length < least_bytes:
                    rows.append((record_id, k))
                else:
                    most[digest] = max(most.get(digest, ()), ((page_id is not None, page_id or 0, record_id, uri, captured), record_id, k))
            rows += [x[1:] for x in most.values()]
            at = pa.array([k for _, k in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.string()), batch["member"].take(at)], names=["record_id", "member"])

    bodies = read_members(spark, source).mapInArrow(candidates, "record_id string, member binary")
    kind = revisits.schema["original"].dataType
    # a response's fields stand in its own record
    empty = [F.lit(None).cast(revisits.schema[c].dataType).alias(c) for c in plain[1:]]
    responses = decided.where(own).select("record_id").join(bodies, "record_id").select("record_id", *empty, F.lit(None).cast(kind).alias("original"), "member")
    date = _now()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for values in zip(*[batch[c] for c in (*plain, "original", "member")], strict=True):  # one record at a time
                    record_id, page_id, url, captured, digest, length, original, member = (x.as_py() for x in values)
                    if member is None:
                        first = (original["record_id"], original["page_id"], original["url"], original["captured"])
                        yield packed(record_bytes("revisit", record_id, page_id, url, captured, digest, length, original=first))
                    else:
                        fields, payload = payload_of(member)
                        record_id, _, page_id, url, captured, digest, length, _ = _fields(fields)
                        yield packed(record_bytes("response", record_id, page_id, url, captured, digest, length, payload))

        yield from _batches(_info(records(), date), "member")

    _write(responses.unionByName(revisits).mapInArrow(build, "member binary"), target)
    drop_kept(headers)


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, final = new_path(spark, "warc"), new_path(spark, "warc")
    archive_pages(table(spark, sf_dir, "pages"), raw)
    resolve_revisits(spark, raw, final)
    delete(spark, raw)
    return read_archive(spark, final).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: DuckDB SQL: SHA-1 in base32, 20 bits (five hex digits) to four characters; the largest page_id of a payload is the response.
ORACLE_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, url, octet_length(encode(body))::BIGINT AS payload_bytes, array_to_string(list_transform(range(8), lambda i:
    array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(sha1(body), 5 * i + 1, 5))::BIGINT >> s) % 32, 1)), '')), '') AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to,
  coalesce(nullif(url, ''), 'urn:page:' || page_id) AS url FROM r"""
