"""WARC archives as seekable Zstandard bundles.

A task writes its records into bundles in the shared folder. Records are grouped into independent
Zstandard frames of about ``frame_bytes`` and a bundle ends with the seek table of the seekable format
(a skippable frame that lists the frames' sizes), so any record is read by decompressing one frame. The
index maps record ids to bundle, frame and the offset inside the frame.

Pages with equal payloads of at least ``least`` bytes are found by the digest of the payload and its
length: the page with the smallest id is a response, the others are revisits that refer to it. Only
digests that occur twice are joined back, so adaptive execution can broadcast a short list and split a
hot digest; the pages themselves move only when that list is long.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presentia.llm.arrow_text import bounded
from presentia.plans.materialize import materialize, scratch_path

# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEK_TABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: WARC asks for a date; pages have none, and archives of equal pages should be equal.
WARC_DATE = "1970-01-01T00:00:00Z"
INDEX_SCHEMA = "record_id string, page_id bigint, bundle string, frame int, frame_offset bigint, record_offset bigint, record_bytes bigint"


class BundleWriter:
    """One bundle: frames of whole records, then the seek table."""

    def __init__(self, filesystem: fs.FileSystem, path: str, level: int = 3):
        self._out = filesystem.open_output_stream(path, compression=None)
        self._zstd = zstandard.ZstdCompressor(level=level)
        self._pending: list[bytes] = []
        self.pending_bytes = self.written = 0
        self.frames: list[tuple[int, int]] = []

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame number, where that frame starts in the bundle, and the record's offset inside it."""
        at = self.pending_bytes
        self._pending.append(record)
        self.pending_bytes += len(record)
        return len(self.frames), self.written, at

    def end_frame(self) -> None:
        if self._pending:
            data = self._zstd.compress(b"".join(self._pending))
            self._out.write(data)
            self.frames.append((len(data), self.pending_bytes))
            self.written += len(data)
            self._pending, self.pending_bytes = [], 0

    def close(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", c, d) for c, d in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_TABLE_MAGIC)
        self._out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self._out.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, filesystem: fs.FileSystem, path: str):
        self._file = filesystem.open_input_file(path)
        size = self._file.size()
        self._file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", self._file.read(9))
        if magic != SEEK_TABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        self._file.seek(size - 9 - 8 * count)
        entries = self._file.read(8 * count)
        self.frames, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", entries, 8 * k)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        self._file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self._file.read(packed), max_output_size=plain)

    def close(self) -> None:
        self._file.close()


def _line(value: str) -> str:
    """A header value without line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(record_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        f"WARC-Date: {WARC_DATE}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Bytes: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head.append(f"Content-Length: {len(body)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "replace") + body + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload (empty for a revisit) and the end of the record that starts at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    body = data[start:stop]
    return headers, body[body.index(b"\r\n\r\n") + 4 :], stop + 4


def roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to for every page.

    Null html counts as empty, null urls and ids stay null; a null id is never referred to. Of equal payloads the
    smallest id is the response, with all rows that repeat that id; an empty table gives none. Other columns,
    whatever their names, are not read.
    """
    src = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    long = src.filter(F.octet_length("html") >= least)
    copies = long.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first_id")
    copies = materialize(copies, "warc-copies")
    revisit = F.coalesce((F.octet_length("html") >= least) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    return src.join(copies, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to")
    )


def write_archive(pages: DataFrame, path: str, frame_bytes: int = 256 << 10, bundle_bytes: int = 256 << 20, **columns) -> DataFrame:
    """Writes the pages' records below ``path`` (a URI all executors reach) and returns the index, materialised.

    A bundle's name holds the task attempt, so a repeated task never writes over what another one's index
    refers to. Nulls, equal payloads, repeated rows and further columns are treated as by :func:`roles`; payloads
    longer than a frame have one of their own; an empty table gives an empty index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = fs.FileSystem.from_uri(path)
        filesystem.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        made, bundle, name = 0, None, ""
        for b in bounded(batches, "html", 4 << 20):
            rows = []
            cols = (b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "record_type", "refers_to"))
            for page_id, url, html, digest, kind, refers_to in zip(*cols, strict=True):
                if bundle is None:
                    name = f"bundle-{attempt}-{made}.warc.zst"
                    bundle, made = BundleWriter(filesystem, f"{root}/{name}"), made + 1
                rid = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{url}/{digest}"))
                record = record_bytes(rid, page_id, url, html, digest, kind, refers_to)
                frame, start, at = bundle.add(record)
                rows.append((rid, page_id, name, frame, start, at, len(record)))
                if bundle.pending_bytes >= frame_bytes:
                    bundle.end_frame()
                    if bundle.written >= bundle_bytes:
                        bundle.close()
                        bundle = None
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if bundle is not None:
            bundle.close()

    return materialize(roles(pages, **columns).mapInArrow(run, INDEX_SCHEMA), "warc-index")


def read_archive(index: DataFrame, path: str) -> DataFrame:
    """Reads whole bundles back, frame by frame.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, bundle, frame,
    record_offset. A response's length and digest are computed from the payload read; where they differ
    from its header the task fails.
    """
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, bundle string, frame int, record_offset bigint"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for bundle in b.column("bundle").to_pylist():
                reader = BundleReader(filesystem, f"{root}/{bundle}")
                for number in range(len(reader.frames)):
                    data, at, rows = reader.frame(number), 0, []
                    while at < len(data):
                        start = at
                        head, payload, at = parse_record(data, at)
                        digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Bytes"])
                        if head["WARC-Type"] == "response":
                            found = hashlib.sha256(payload).hexdigest()
                            if (found, len(payload)) != (digest, size):
                                raise ValueError(f"{bundle}, frame {number}: payload differs from its header")
                        ids = [int(head[k]) if k in head else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
                        rows.append((ids[0], size, digest, head["WARC-Type"], ids[1], head["WARC-Record-ID"][10:-1], bundle, number, start))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                reader.close()

    # A bundle is the unit of reading and its size is bounded: one task for each, whatever their rows weigh.
    bundles = materialize(index.select("bundle").distinct(), "warc-bundles")
    return bundles.repartition(max(1, bundles.count())).mapInArrow(run, schema)


def read_record(path: str, bundle: str, frame: int, record_offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: decompresses a single frame."""
    filesystem, root = fs.FileSystem.from_uri(path)
    reader = BundleReader(filesystem, f"{root}/{bundle}")
    try:
        headers, payload, _ = parse_record(reader.frame(frame), record_offset)
    finally:
        reader.close()
    return headers, payload


def warc_round_trip(spark: SparkSession, pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Writes all pages as WARC records and reads the archives back: one row for each page.

    Null html is an empty payload; payloads under 100 bytes are all responses. Of rows that repeat the
    smallest page_id of a payload each is a response; a null page_id is never the smallest unless the
    payload has no other. An empty table gives an empty result and no bundle.
    """
    path = path or scratch_path(spark, "warc")
    return read_archive(write_archive(pages, path, **columns), path)
