"""WARC archives as seekable Zstandard bundles, written as files to a shared folder and read back through an index.

A bundle is a file of frames, each of some whole records, and a last skippable frame that holds the sizes of all
frames (the public seekable format). The index, a Parquet table, maps a record's identifier to its bundle, its frame
and its offset inside the decompressed frame, so one record costs one frame. A task writes a bundle under a
name made from its content and moves it into place; the index is written by Spark's commit protocol and names only the
bundles of committed tasks, so lost executors leave at most files that no index names.

Revisits are decided by payload digest, page_id and url, never by the order of rows, so a task that runs again decides
alike. Defined results: a null html is an empty payload; records with equal payloads refer to the one with the smallest
page_id (of tied ones, one is the response); rows without page_id come after all others, and are responses
where no equal payload has a page_id; a null url is left out of the record; repeated rows are records of their own;
payloads of any length are written whole; other columns are not read; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.sources.session import shared_folder

SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
INDEX_SCHEMA = "bundle string, bytes long, record_ids array<string>, frames array<int>, offsets array<int>"

#: Fixed by the seekable format: magic of a skippable frame, magic of the seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 4 << 20
#: Up to so many payloads that repeat, their map is broadcast (44 bytes each); beyond, pages are joined with it by shuffle.
BROADCAST_PAYLOADS = 200_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, serial: str = "") -> str:
    """serial: empty for the response that revisits of a page refer to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{serial}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, serial: str = "") -> tuple[str, bytes]:
    """(identifier, bytes) of a record; ``refers_to`` makes it a revisit without its payload."""
    own = record_id(page_id, serial)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"X-Page: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return own, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Groups records into frames and frames into a bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.out, self.table, self.frame, self.raw = io.BytesIO(), [], [], 0
        self.ids: list[str] = []
        self.frames: list[int] = []
        self.offsets: list[int] = []

    def add(self, own: str, data: bytes) -> None:
        if self.raw and self.raw + len(data) > self.frame_bytes:
            self._end_frame()
        self.ids.append(own)
        self.frames.append(len(self.table))
        self.offsets.append(self.raw)
        self.frame.append(data)
        self.raw += len(data)

    def _end_frame(self) -> None:
        packed = self.compressor.compress(b"".join(self.frame))
        self.out.write(packed)
        self.table.append((len(packed), self.raw))
        self.frame, self.raw = [], 0

    @property
    def size(self) -> int:
        return self.out.tell() + self.raw

    def finish(self) -> bytes:
        if self.raw:
            self._end_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return self.out.getvalue() + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


class BundleReader:
    """Reads single records of a bundle (an open file of that size) by frame and offset; holds the last frame."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        frames, flags, magic = struct.unpack("<IBI", self._part(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        table = self._part(size - 9 - width * frames, width * frames)
        sizes = [struct.unpack_from("<II", table, width * k) for k in range(frames)]
        self.places, at = [], 0
        for packed, raw in sizes:
            self.places.append((at, packed, raw))
            at += packed
        self.now, self.data = -1, b""

    def _part(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        if k != self.now:
            at, packed, raw = self.places[k]
            self.now, self.data = k, zstandard.ZstdDecompressor().decompress(self._part(at, packed), max_output_size=raw)
        return self.data

    def record(self, k: int, offset: int) -> tuple[dict[str, str], bytes]:
        """(headers, block) of the record at an offset inside frame k."""
        data = self.frame(k)
        end = data.index(b"\r\n\r\n", offset)
        lines = data[offset:end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        return headers, data[end + 4 : end + 4 + int(headers["Content-Length"])]


def store(folder: str):
    """(Arrow file system, path in it) of a folder that all executors share: a path, or a URI that Arrow opens."""
    from pyarrow import fs

    if "://" in folder and not folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")


def marked(pages: DataFrame, min_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, html, refers_to (null for a response). Payloads are shuffled only if very many of them repeat."""
    shared_folder(pages.sparkSession)
    src = pages.select(
        pages[id_column].cast("long").alias("page_id"), pages[url_column].cast("string").alias("url"), F.coalesce(pages[html_column], F.lit("")).alias("html")
    ).withColumns({"digest": F.when(F.octet_length("html") >= min_bytes, F.unhex(F.sha1(F.encode("html", "UTF-8")))), "of_url": F.xxhash64("url")})
    # Rows that repeat under one page_id and url count first, so a digest of very many copies is summed up before it is shuffled.
    rows = src.where("digest is not null").groupBy("digest", "page_id", "of_url").agg(F.count("*").alias("m"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "of_url", "m"))).alias("first")
    payloads = rows.groupBy("digest").agg(first, F.sum("m").alias("n")).where("n > 1 and first is not null")
    payloads = payloads.select(F.col("digest").alias("of"), "first.page_id", "first.of_url", F.col("first.m").alias("m")).toDF("of", "first_id", "first_url", "m").checkpoint()
    side = payloads if payloads.count() > BROADCAST_PAYLOADS else F.broadcast(payloads)
    joined = src.join(side, F.col("digest") == F.col("of"), "left")
    is_first = F.col("of").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("of_url") == F.col("first_url"))
    tied = is_first & (F.col("m") > 1)
    alone = joined.where(~tied).select("page_id", "url", "html", F.when(~is_first, F.col("first_id")).alias("refers_to"))
    if payloads.where("m > 1").isEmpty():
        return alone
    # Of rows that repeat in all of page_id, url and payload, one is the response and each of the others revisits it.
    once = joined.where(tied).groupBy("digest", "page_id", "of_url").agg(F.first("url").alias("url"), F.first("html").alias("html"), F.first("m").alias("m"))
    return alone.unionByName(once.select("page_id", "url", "html", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.array_repeat(F.col("page_id"), (F.col("m") - 1).cast("int")))).alias("refers_to")))


def write(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Writes the records of ``pages`` as bundles under ``folder`` when it runs; rows of the index, one per bundle."""

    def run(batches):
        place, root = store(folder)
        place.create_dir(root, recursive=True)
        part, count, writer = TaskContext.get().partitionId(), 0, BundleWriter()
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, html, refers_to = (batch.column(c)[k].as_py() for c in range(4))
                count += 1
                serial = "" if refers_to is None and page is not None else f"{part}/{count}"
                writer.add(*record(page, url, html.encode("utf-8", "surrogatepass"), refers_to, serial))
                if writer.size >= BUNDLE_BYTES:
                    yield _place(writer, place, root)
                    writer = BundleWriter()
        if writer.size:
            yield _place(writer, place, root)

    return marked(pages, **options).mapInArrow(run, INDEX_SCHEMA)


def _place(writer: BundleWriter, place, root: str) -> pa.RecordBatch:
    data = writer.finish()
    name = f"{hashlib.sha1(data).hexdigest()}.warc.zst"
    own = f"{root}/_{uuid.uuid4().hex}.tmp"
    with place.open_output_stream(own) as f:
        f.write(data)
    place.move(own, f"{root}/{name}")
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([len(data)], pa.int64()), pa.array([writer.ids]), pa.array([writer.frames], pa.list_(pa.int32())), pa.array([writer.offsets], pa.list_(pa.int32()))],
        names=["bundle", "bytes", "record_ids", "frames", "offsets"],
    )


def read(index: DataFrame, folder: str) -> DataFrame:
    """One row per record, each read from its bundle through the index; the digest of a response is checked against its payload."""

    def run(batches):
        place, root = store(folder)
        for batch in batches:
            for k in range(batch.num_rows):
                with place.open_input_file(f"{root}/{batch.column(0)[k].as_py()}") as f:
                    reader, rows = BundleReader(f, batch.column(1)[k].as_py()), []
                    for own, frame, offset in zip(*(batch.column(c)[k].as_py() for c in (2, 3, 4)), strict=True):
                        headers, block = reader.record(frame, offset)
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                        if headers["WARC-Record-ID"] != own or kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"record {own} is damaged")
                        to = headers.get("X-Refers-To-Page")
                        rows.append((int(headers["X-Page"]) if headers["X-Page"] else None, size, digest, kind, int(to) if to else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.select("bundle", "bytes", "record_ids", "frames", "offsets").mapInArrow(run, SCHEMA)


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the bundles of ``pages`` and their index to a new folder under ``folder`` (else the shared one), reads them back, and returns a row per record."""
    spark = pages.sparkSession
    place = f"{(folder or shared_folder(spark)).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, f"{place}/bundles", **options).write.parquet(f"{place}/index")
    return read(spark.read.schema(INDEX_SCHEMA).parquet(f"{place}/index"), f"{place}/bundles")
