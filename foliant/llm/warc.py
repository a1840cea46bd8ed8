"""Zstandard-compressed web archives: one frame a record, with a shared dictionary.

An archive starts with a skippable frame that holds the dictionary (as it is, or as a Zstandard frame of its
own); every record after it is one frame. The reader streams: it loads the dictionary, decodes one frame at
a time, and checks each record's version line, headers, block length, trailer, HTTP length and payload digest.

Of records with equal payloads that with the largest id is written as ``response`` with the payload, the
others as ``revisit`` records that refer to it and have the HTTP header only. Which payloads are equal is found
by SHA-256 before anything is written, with a count in each task before the shuffle.

The writer's tasks write to shared storage under names of their own attempt, and the manifest that Spark
commits names the attempt that counts; files of lost or repeated attempts are never read. An archive is closed
when it reaches ``ARCHIVE_BYTES``. The dictionary is trained from ``SAMPLE_ROWS`` payloads, of ``SAMPLE_BYTES`` each at
most, with the least hashes: it changes sizes only, never contents. Where that is too little to train on there is none.

Cases: a null payload is empty, and empty payloads count as equal. Rows that repeat the largest id of a group are
all responses; other repeats all revisit. A null id is written without an id header, ranks below others, and
is read back as null. Line ends in a URL are percent-encoded; a null URL has no header. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import materialise, new_path

#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "2024-01-01T00:00:00Z"

ARCHIVE_BYTES = 64 << 20
SAMPLE_ROWS = 256
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
MIN_REVISIT_BYTES = 0
#: Tables of repeated payloads up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_GROUPS = 200_000

MANIFEST = "path string, records long, bytes long"
RECORD = (
    "path string, offset long, record_type string, record_id string, refers_to_id string, target_uri string, "
    "page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    name = uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")
    return f"<urn:uuid:{name}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response, or with ``refers_to`` a revisit without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}"]
    head += [f"WARC-Date: {WARC_DATE}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    found = {}
    for line in data.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line[:80]!r}")
        found[name.strip().lower()] = value.strip()
    return found


def parse_record(data: bytes) -> dict:
    """The fields of one record. ValueError if a header, a length or the digest is wrong."""
    top, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = top.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"not a WARC record: {data[:40]!r}")
    head = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise ValueError(f"no {name} header")
    if not head["content-length"].isdigit():
        raise ValueError(f"length {head['content-length']!r}")
    length = int(head["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, header says {length}")
    kind, block = head["warc-type"], rest[:length]
    out = {
        "record_type": kind,
        "record_id": head["warc-record-id"],
        "refers_to_id": head.get("warc-refers-to"),
        "target_uri": head.get("warc-target-uri"),
        "page_id": int(head["x-page-id"]) if "x-page-id" in head else None,
        "refers_to": int(head["x-refers-to-page-id"]) if "x-refers-to-page-id" in head else None,
        "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload_bytes": length,
        "payload": block,
    }
    if head.get("content-type", "").startswith("application/http"):
        http, gap, body = block.partition(b"\r\n\r\n")
        status, _, fields = http.partition(b"\r\n")
        if not gap or not status.startswith(b"HTTP/"):
            raise ValueError("no HTTP header")
        stated = _headers(fields).get("content-length") if fields else None
        out |= {"payload": body, "payload_bytes": int(stated) if stated else len(body)}
        if kind == "response" and out["payload_bytes"] != len(body):
            raise ValueError(f"payload of {len(body)} bytes, HTTP header says {stated}")
    if kind == "response" and out["payload_digest"] and sha1_base32(out["payload"]) != out["payload_digest"]:
        raise ValueError("payload digest differs")
    if kind == "revisit" and not out["refers_to_id"]:
        raise ValueError("revisit without WARC-Refers-To")
    return out


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary


def read_frames(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each frame of an archive, one in memory at a time."""
    buffer, offset = stream.read(8), 0
    dictionary = None
    if len(buffer) == 8 and struct.unpack("<I", buffer[:4])[0] == SKIPPABLE_MAGIC:
        size = struct.unpack("<I", buffer[4:])[0]
        held = stream.read(size)
        if len(held) != size:
            raise ValueError("dictionary cut short")
        if held[:4] == ZSTD_MAGIC:
            held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
        dictionary = zstandard.ZstdCompressionDict(held) if held else None
        buffer, offset = b"", 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        buffer = buffer or stream.read(chunk)
        if not buffer:
            return
        frame, parts, used = decoder.decompressobj(), [], 0
        while not frame.eof:
            if not buffer:
                buffer = stream.read(chunk)
                if not buffer:
                    raise ValueError(f"frame at {offset} cut short")
            parts.append(frame.decompress(buffer))
            used += len(buffer)
            buffer = frame.unused_data if frame.eof else b""
        used -= len(buffer)
        yield offset, b"".join(parts)
        offset += used


def read_records(stream) -> Iterator[dict]:
    for offset, data in read_frames(stream):
        try:
            yield {"offset": offset} | parse_record(data)
        except ValueError as e:
            raise ValueError(f"record at {offset}: {e}") from e


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def train_dictionary(pages: DataFrame, payload_col: str = "html") -> bytes:
    """A dictionary from a bounded sample, or none if the sample is too small."""
    hashed = pages.select(F.coalesce(F.col(payload_col), F.lit("")).alias("p")).withColumn("h", F.xxhash64("p"))
    # Hashes first, so that no task sends payloads that aren't chosen.
    least = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    if least is None:
        return b""
    chosen = hashed.where(F.col("h") <= least).groupBy("h").agg(F.first(F.substring("p", 1, SAMPLE_BYTES)).alias("p"))
    sample = chosen.orderBy("h").select("p").collect()
    samples = [r.p.encode()[:SAMPLE_BYTES] for r in sample if r.p]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 16 or size < 1024:
        return b""
    return zstandard.train_dictionary(size, samples).as_bytes()


def write_archives(
    pages: DataFrame, folder: str, dictionary: bytes = b"", min_revisit_bytes: int = MIN_REVISIT_BYTES, level: int = 3
) -> DataFrame:
    """Write (page_id, url, html) as archives under ``folder``; returns the manifest of files that count."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"))
    digest = F.unhex(F.sha2(F.col("html").cast("binary"), 256))
    repeated = materialise(
        rows.where(F.octet_length("html") >= min_revisit_bytes)
        .select("page_id", digest.alias("digest"))
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("first_id"))
        .where("n > 1")
        .select("digest", "first_id"),
        "warc-groups",
    )
    if repeated.count() <= BROADCAST_GROUPS:
        repeated = F.broadcast(repeated)
    typed = (
        rows.withColumn("digest", digest)
        .join(repeated, "digest", "left")
        .select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        encoder = zstandard.ZstdCompressor(level=level, dict_data=held)
        done, out, name, count, size = [], None, "", 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", count, size))
                out = None

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (column[i].as_py() for column in batch.columns)
                if out is None:
                    name, count = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.zst", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(lead := dictionary_frame(dictionary))
                    size = len(lead)
                out.write(frame := encoder.compress(build_record(page_id, url, html.encode(), refers_to)))
                count, size = count + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        columns = list(zip(*done, strict=True)) or [[], [], []]
        types = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "records", "bytes"])

    return materialise(typed.mapInArrow(write, MANIFEST), "warc-manifest")


def _batches(path: str, stream, with_payload: bool, schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for record in read_records(stream):
        size += 200 + (len(record["payload"]) if with_payload else 0)
        rows.append({"path": path} | record | ({} if with_payload else {"payload": None}))
        if size >= limit:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema)


def _record_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (field.split() for field in RECORD.split(", "))])


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives that ``manifest`` names, streamed file by file."""
    schema = _record_schema()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = _open(path)
                with store.open_input_stream(name, compression=None) as stream:
                    yield from _batches(path, stream, with_payload, schema)

    files = manifest.select("path")
    # A file is the unit of work: spread them, however few rows the manifest has in a part.
    files = files.repartition(max(1, min(files.count(), 10_000)), "path")
    return files.mapInArrow(read, RECORD)


def read_archive_folder(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The same for any folder that Spark's readers can open; a whole file is in memory at a time."""
    schema = _record_schema()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _batches(path, io.BytesIO(content.as_py()), with_payload, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", "content").mapInArrow(read, RECORD)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives on shared storage, and read the records back."""
    folder = new_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, train_dictionary(pages))
    return read_archives(manifest, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE_SQL = """
WITH coded AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
           ((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1
           AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM coded WINDOW w AS (PARTITION BY payload)
"""
