"""WARC archives: writing, reading, and assembling transactions through concurrent-to identifiers.

``write_archives`` writes three records for every page: the request, the response or (where an equal payload has its
response elsewhere) a revisit, and metadata; the latter two name the response in WARC-Concurrent-To. An archive is a
series of gzip members, one per record, so a chunk of it is read from a member's offset. A task writes one archive
under a new name; only archives in the committed list count.

``read_records`` gives one row per record. ``transactions`` joins the records: a request or metadata record belongs
to the response that it names, or that names it, and one nested row per capture comes out; a capture without a
request or metadata has null there.

Digests: bare upper-case base32 SHA-1 of the payload. Of rows with equal payloads of at least ``min_bytes`` bytes the
one with the smallest page_id (null last) is the response; rows that share that page_id and payload all are. Null html counts as empty; a null url gives a record
without a target. Digests that occur once are not joined with anything large: the join with the written groups of
several rows is split by Spark where a digest is frequent. Extra columns are ignored; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrove.llm.common import open_input, open_output, scratch, small_batches, stage, text_bytes

CHUNK_SCHEMA = "path string, at long, length long"
RECORD_SCHEMA = (
    "record_id string, type string, concurrent_to array<string>, refers_to_uri string, target_uri string, date string, "
    "content_type string, payload_digest string, digest_ok boolean, payload_bytes long, fields map<string,string>, payload binary"
)
#: Uncompressed bytes after which a new chunk begins.
CHUNK = 32 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, date: str, content_type: str, block: bytes, headers: list[tuple[str, str | None]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    lines += [f"{k}: {v}" for k, v in headers if v is not None]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records_of(page: dict, capture: str, date: str) -> list[bytes]:
    """The three records of a page: page_id, url, payload, again, response_id, response_url. ``capture`` names it."""
    name = lambda kind: f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind}:{capture}')}"
    safe = lambda url: None if url is None else quote(url, safe="/:?#[]@!$&'()*+,;=%-._~")
    payload, target = page["payload"], safe(page["url"])
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    extra = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if page["again"]:
        extra += [("WARC-Profile", REVISIT), ("WARC-Refers-To-Target-URI", safe(page["response_url"])), ("WARC-Refers-To-Date", date)]
    fields = {"page-id": page["page_id"], "payload-bytes": len(payload), "refers-to-page-id": page["response_id"] if page["again"] else None}
    about = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    ask = f"GET {target or '/'} HTTP/1.1\r\n\r\n".encode()
    linked = [("WARC-Target-URI", target), ("WARC-Concurrent-To", f"<{name('response')}>")]
    return [
        record("revisit" if page["again"] else "response", name("response"), date, "application/http; msgtype=response", head if page["again"] else head + payload, extra),
        record("request", name("request"), date, "application/http; msgtype=request", ask, linked),
        record("metadata", name("metadata"), date, "application/warc-fields", about.encode(), linked),
    ]


def write_archives(pages: DataFrame, folder: str, *, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html); returns the committed list of chunks (path, at, length)."""
    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", text_bytes("html").alias("payload"))
    digests = rows.where(F.length("payload") >= min_bytes).select("page_id", "url", F.sha1("payload").alias("sha"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first")
    groups = digests.groupBy("sha").agg(F.count("*").alias("copies"), first).where("copies > 1")
    groups = stage(groups.select("sha", F.col("first.page_id").alias("response_id"), F.col("first.url").alias("response_url")), "payload-groups")
    again = F.col("_group").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    marked = (
        rows.withColumn("sha", F.when(F.length("payload") >= min_bytes, F.sha1("payload")))
        .join(groups.withColumn("_group", F.lit(True)), "sha", "left")
        .select("page_id", "url", "payload", again.alias("again"), "response_id", "response_url")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, begun, raw, chunks, path = None, 0, 0, 0, [], f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    out = open_output(path)
                for data in records_of({c: batch[c][i].as_py() for c in batch.schema.names}, f"{path}:{at}", date):
                    member = gzip.compress(data, 6, mtime=0)
                    out.write(member)
                    at, raw = at + len(member), raw + len(data)
                if raw >= CHUNK:
                    chunks.append((path, begun, at - begun))
                    begun, raw = at, 0
        if out is not None:
            out.close()
            chunks += [(path, begun, at - begun)] if at > begun else []
            yield pa.record_batch([pa.array(x) for x in zip(*chunks)], ["path", "at", "length"])

    return stage(marked.mapInArrow(write, CHUNK_SCHEMA), "warc-chunks")


def parse(data: bytes) -> dict:
    """One record. The payload of HTTP blocks is what follows their header, that of others the whole block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    headers: dict[str, list[str]] = {}
    for line in lines:
        key, _, value = line.partition(":")
        headers.setdefault(key.strip().lower(), []).append(value.strip())
    get = lambda key: headers.get(key, [None])[0]
    bare = lambda value: value and value.strip("<>")
    block = rest[: int(get("content-length"))]
    kind, content_type = get("warc-type"), get("content-type") or ""
    payload = block.partition(b"\r\n\r\n")[2] if content_type.startswith("application/http") else block
    digest = (get("warc-payload-digest") or "").removeprefix("sha1:") or None
    fields = {}
    if content_type.startswith("application/warc-fields"):
        for line in block.decode().split("\r\n"):
            key, colon, value = line.partition(":")
            if colon:
                fields[key.strip()] = value.strip()
    return {
        "record_id": bare(get("warc-record-id")), "type": kind, "concurrent_to": [bare(v) for v in headers.get("warc-concurrent-to", [])], "refers_to_uri": get("warc-refers-to-target-uri"),
        "target_uri": get("warc-target-uri"), "date": get("warc-date"), "content_type": content_type, "payload_digest": digest,
        "digest_ok": base32_sha1(payload) == digest if digest and kind == "response" else None, "payload_bytes": len(payload), "fields": fields, "payload": payload,
    }


def members(file, at: int, length: int) -> Iterator[bytes]:
    """The gzip members of a chunk, one after another; the file is read in pieces."""
    import zlib

    file.seek(at)
    left, data = length, b""
    while left or data:
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            if not data:
                data = file.read(min(left, 1 << 20))
                left -= len(data)
                if not data:
                    raise EOFError("a record is cut off")
            parts.append(unzip.decompress(data))
            data = unzip.unused_data
        yield b"".join(parts)


def read_records(chunks: DataFrame, payload: bool = True) -> DataFrame:
    """One row per record of the listed chunks; without ``payload`` that column is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to_uri", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
            ("content_type", pa.string()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
        ])
        for batch in batches:
            for chunk in batch.to_pylist():
                with open_input(chunk["path"]) as file:
                    rows, held = [], 0
                    for data in members(file, chunk["at"], chunk["length"]):
                        row = parse(data)
                        row["fields"] = list(row["fields"].items())
                        held += len(data) if payload else 512
                        rows.append(row if payload else row | {"payload": None})
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    spread = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(spread).mapInArrow(run, RECORD_SCHEMA)


def transactions(records: DataFrame) -> DataFrame:
    """capture_id, response STRUCT, request STRUCT, metadata STRUCT; ``records`` should be a written table."""
    row = F.struct("*").alias("record")
    answers = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), row)

    def side(kind: str) -> DataFrame:
        """Records of a kind by capture: through their own link, or, where they have none, through the answer's."""
        those = records.where(F.col("type") == kind)
        own = those.where(F.size("concurrent_to") > 0).select(F.explode("concurrent_to").alias("capture_id"), row)
        other = answers.select("capture_id", F.explode("record.concurrent_to").alias("_id"))
        back = those.where(F.size("concurrent_to") == 0).select(F.col("record_id").alias("_id"), row).join(other, "_id").select("capture_id", "record")
        return own.unionByName(back).withColumnRenamed("record", kind)

    joined = answers.withColumnRenamed("record", "response").join(side("request"), "capture_id", "left").join(side("metadata"), "capture_id", "left")
    return joined.select("capture_id", "response", "request", "metadata")


def page_report(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each capture written by ``write_archives``."""
    about = F.col("metadata.fields")
    return captures.select(
        about["page-id"].cast("long").alias("page_id"), about["payload-bytes"].cast("long").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.when(F.col("response.type") == "revisit", about["refers-to-page-id"].cast("long")).alias("refers_to"),
        F.coalesce("response.digest_ok", F.lit(True)).alias("digest_ok"),
    )


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Write, read back, assemble, report."""
    chunks = write_archives(pages, scratch(pages.sparkSession, "warc"), **options)
    return page_report(transactions(stage(read_records(chunks, payload=False), "warc-records")))
