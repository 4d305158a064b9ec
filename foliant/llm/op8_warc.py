"""WARC archives with an embedded Zstandard dictionary.

An archive file starts with a skippable frame that holds a dictionary built from the archive's own records;
after it every record is a Zstandard frame of its own, compressed with that dictionary, so any
record can be read by its offset. Files are written to the folder that all executors share, under a
temporary name first, so that a repeated or lost task leaves whole files only.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collisions import NO_ID
from .common import batch, input_bytes, located, materialise, partitions_for, read, shared_dir, text_columns

#: Payload bytes of an archive file, at least one record; and the bytes of its records that the dictionary is built from.
ARCHIVE_BYTES = 16 << 20
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 32 << 10
PIECE_BYTES = 64 << 10
LEVEL = 3
#: Payload bytes that a partition of the writing stage should hold.
TARGET = 24 << 20
#: Fixed value: the skippable frame that holds the dictionary of a .warc.zst file.
MAGIC = 0x184D2A5D
#: A payload shorter than this is never a revisit.
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1, 32 characters.

    >>> digest(b"")
    '3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ'
    """
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def _headed(head: dict, block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {str(v).translate({10: '%0A', 13: '%0D'})}" for k, v in {**head, "Content-Length": len(block)}.items() if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, mark: str, refers_to: int | None, revisit: bool, turn: int = 0) -> bytes:
    """One WARC 1.1 record: an HTTP response whose body is the payload.

    A revisit has the HTTP head alone; X-Payload-Length and the digest are those of the full payload. turn numbers the rows that
    repeat an id and a payload, so that no two records share their id.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, mark, *(["revisit", turn] if revisit else [])),
        "WARC-Date": DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{mark}",
        "WARC-Refers-To": record_id(refers_to, mark) if revisit else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "X-Page-ID": page_id,
        "X-Payload-Length": len(payload),
        "X-Refers-To-Page-ID": refers_to if revisit else None,
        "Content-Type": "application/http; msgtype=response",
    }
    return _headed(head, http + (b"" if revisit else payload))


def info(name: str) -> bytes:
    """The record that describes an archive file."""
    head = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("warcinfo", name), "WARC-Date": DATE, "WARC-Filename": name, "Content-Type": "application/warc-fields"}
    return _headed(head, b"software: foliant\r\nformat: WARC File Format 1.1\r\n")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the payload of one record: the body of its HTTP response, or the block of a warcinfo."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return headers, rest[:n] if headers["WARC-Type"] == "warcinfo" else rest[:n].partition(b"\r\n\r\n")[2]


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary built from pieces spread evenly over the archive's records.

    Where they are too few or too short to train one, the pieces themselves are the dictionary (raw content, as the format allows).
    """
    pieces = [r[k : k + PIECE_BYTES] for r in records for k in range(0, len(r), PIECE_BYTES)]
    sample = pieces[:: max(1, sum(map(len, pieces)) // SAMPLE_BYTES)]
    try:
        return zstandard.train_dictionary(size, sample, d=8, k=256, steps=1, threads=0).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(sample)[-size:]


def write_archive(out, records: list[bytes]) -> None:
    raw = dictionary(records)
    out.write(struct.pack("<II", MAGIC, len(raw)) + raw)
    made = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True)
    for r in records:
        out.write(made.compress(r))


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an open archive file, one frame at a time."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    raw = source.read(size)
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    held = source.read(1 << 20)
    while held:
        frame, text = plain.decompressobj(), []
        while not frame.eof:
            if not held and not (held := source.read(1 << 20)):
                raise ValueError("the archive ends inside a record")
            text.append(frame.decompress(held))
            held = frame.unused_data if frame.eof else b""
        yield parse(b"".join(text))
        held = held or source.read(1 << 20)


def decisions(marks: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(key, hex, first): for each id and payload digest of marks(key, hex, bytes) the largest page_id that holds the payload.

    Made from digests alone, summed before the shuffle; first is null where the payload is shorter than least.
    """
    first = marks.groupBy("hex").agg(F.max("key").alias("first"), F.max("bytes").alias("n")).where(F.col("n") >= least)
    # a payload that a third of all pages hold is split over tasks by the adaptive plan
    return marks.select("key", "hex").distinct().join(first.select("hex", "first"), "hex", "left")


FILES = pa.schema([("path", pa.string()), ("records", pa.int64())])


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Write every row of pages to archives under folder and return (path, records), one row per file.

    Of rows that repeat an id and a payload, the first written is the response and the others revisit it.
    A null html is an empty payload; a null page_id is smaller than any other. An empty table writes no file.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    n = partitions_for(spark, input_bytes(pages, "html"), TARGET)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = text_columns(pages, "page_id", "url", "html").select(F.coalesce("page_id", F.lit(NO_ID)).alias("key"), F.sha1(payload).alias("hex"), F.octet_length(payload).cast("bigint").alias("bytes"), "url", "html")
    known = materialise(decisions(keyed.select("key", "hex", "bytes"), least), "decisions")
    # by id and digest, so that rows without an id are spread, and rows that repeat both meet
    wide = keyed.repartition(n, "key", "hex").join(known.repartition(n, "key", "hex"), ["key", "hex"]).sortWithinPartitions("key", "hex", "url")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = located(folder)
        store.create_dir(root, recursive=True)
        held: list[bytes] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            # the name follows from the content, so a task that runs twice leaves one file
            name = hashlib.sha256(b"".join(hashlib.sha256(r).digest() for r in held)).hexdigest()[:40]
            path = f"{root}/{name}.warc.zst"
            part = f"{path}.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(part, compression=None) as out:
                write_archive(out, [info(f"{name}.warc.zst"), *held])
            store.move(part, path)
            return batch(FILES, [f"{folder}/{name}.warc.zst"], [len(held)])

        turn = 0
        for b in batches:
            for key, code, first, url, html in zip(*(b.column(c).to_pylist() for c in ("key", "hex", "first", "url")), b.column("html")):
                payload = (html.as_py() or "").encode()
                turn = turn + 1 if (key, code) == last else 0
                last = (key, code)
                name = lambda k: None if k == NO_ID else k
                revisit = first is not None and (key != first or turn > 0)
                held.append(record(name(key), url, payload, base64.b32encode(bytes.fromhex(code)).decode(), name(first), revisit, turn))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return materialise(wide.mapInArrow(written, "path string, records bigint"), "archives")


ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(files: DataFrame) -> DataFrame:
    """One row per record of the archives in files(path); the payload of a response is held against its digest and length."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                store, place = located(path)
                with store.open_input_stream(place, compression=None) as source:
                    rows = []
                    for h, payload in read_archive(source):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        mark, n, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), h["WARC-Type"]
                        if kind == "response" and (digest(payload) != mark or len(payload) != n):
                            raise ValueError(f"{path}: a payload does not match its digest")
                        number = [int(h[k]) if k in h else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
                        rows.append((number[0], n, mark, kind, number[1]))
                if rows:
                    yield batch(ROWS, *zip(*rows))

    # one file a task at most, as the files are large beside their names
    spread = files.repartition(max(1, min(1000, files.count())), "path")
    return spread.mapInArrow(records, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back: one row per row; a null html is empty, repeated rows have records of their own, an empty table gives no row, payloads are written whole."""
    return read_archives(write_archives(read(spark, sf_dir, "pages")))


#: DuckDB: the same rows from the table alone. Five hexadecimal digits of a SHA-1 are four base32 characters.
SQL = """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(sha1(coalesce(html, '')), 1 + 5 * (k // 4)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31)::INT, 1)), '') AS payload_digest
  FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first,
             row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC) AS k FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k = 1 THEN NULL ELSE first END AS refers_to
FROM r
"""
