"""WARC archives whose records are compressed one by one against an embedded dictionary.

Each task gathers its records, trains a Zstandard dictionary on an even spread of them,
writes it in a leading skippable frame, and then writes every record as a frame of its own,
so a reader can start at any record once it has the dictionary. A task starts a new archive
after ``ROLL`` bytes of records, so memory does not grow with the table. Archives lie in the
shared folder; a file gets its final name only when it is whole, and names hold the task
attempt, so a repeated task leaves no half or double archive in the index.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascope.session import cut_lineage, shared_path

#: Least payload that can be a revisit; bytes of records per archive; dictionary and sample bytes; compression level.
LEAST_REVISIT, ROLL, DICTIONARY, SAMPLE, LEVEL = 1000, 16 << 20, 64 << 10, 2 << 20, 3
#: Magic of the frame that holds the dictionary, HTTP lines, profile of a revisit, date of synthetic captures.
MAGIC = 0x184D2A5D
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

_INDEX = "path string, records long, bytes long"
_OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string, intact boolean"


def decided(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, payload, digest, first``: ``first`` is the page that a revisit refers to, else null.

    The last page of those with equal payloads is the response. Rows that repeat its id are
    responses too; a null id comes before all others, and null ids alone are all responses.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies"))
    joined = rows.join(large.where("copies > 1 and last is not null").select("digest", "last"), "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("first"))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    value = (name or "")[len("<urn:page:") : -1]
    return int(value) if value and value != "null" else None


def _header(value: str) -> str:
    """A header value on one line: control characters and spaces as percent codes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC 1.1 record; a revisit holds the HTTP header alone."""
    block = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if first is None:
        block += payload
    else:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(first)}", "WARC-Truncated: length"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def train(records: list[bytes], size: int = DICTIONARY, sample: int = SAMPLE) -> bytes | None:
    """A dictionary from records spread evenly over the archive, up to ``sample`` bytes; null if they are too few."""
    step = max(1, sum(map(len, records)) // sample)
    taken = [r[: 64 << 10] for r in records[::step]]  # of a long record its start, for training only
    try:
        return zstandard.train_dictionary(size, taken, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def write_archive(sink, records: list[bytes]) -> None:
    """The dictionary frame, where there is a dictionary, and one frame per record."""
    dictionary = train(records)
    if dictionary is not None:
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        sink.write(struct.pack("<II", MAGIC, len(packed)) + packed)
    data = None if dictionary is None else zstandard.ZstdCompressionDict(dictionary)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True)
    for r in records:
        sink.write(compressor.compress(r))


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record, in order; holds one record at a time."""
    start = source.read(8)
    data = None
    if len(start) == 8 and struct.unpack("<II", start)[0] == MAGIC:
        data = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(source.read(struct.unpack("<II", start)[1])))
        start = b""
    plain = zstandard.ZstdDecompressor(dict_data=data).stream_reader(_Joined(start, source), read_across_frames=True)
    lines = io.BufferedReader(plain, 1 << 20)
    while version := lines.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError("not at the start of a record")
        headers = {}
        while (line := lines.readline().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(": ")
            headers[key] = value
        block = lines.read(int(headers["Content-Length"]))
        if lines.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")
        yield headers, block


class _Joined(io.RawIOBase):
    """Bytes already read, then the rest of a stream."""

    def __init__(self, start: bytes, rest) -> None:
        self.start, self.rest = start, rest

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        if self.start:
            out, self.start = self.start, b""
            return out
        return self.rest.read(size)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``decided`` below ``folder``; returns the index of whole archives."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        held: list[bytes] = []
        size = part = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, part
            name = f"{root}/pages-{context.partitionId():06d}-{context.taskAttemptId()}-{part:04d}.warc.zst"
            with store.open_output_stream(name + ".open", compression=None) as sink:
                write_archive(sink, held)
            store.move(name + ".open", name)
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])
            held, size, part = [], 0, part + 1
            return out

        for batch in batches:
            page_ids, urls, digests, firsts = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for page_id, url, payload, digest, first in zip(page_ids, urls, batch.column(2), digests, firsts):
                held.append(record(page_id, url, payload.as_py(), digest, first))
                size += len(held[-1])
                if size >= ROLL:
                    yield close()
        if held:
            yield close()

    return cut_lineage(rows.select("page_id", "url", "payload", "digest", "first").mapInArrow(write, _INDEX), "warc-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives in ``index``; ``intact`` compares a response's payload with its digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = [c.split()[0] for c in _OUT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as source:
                    for headers, block in read_archive(source):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                        intact = kind == "revisit" or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest)
                        rows.append((_page(headers["WARC-Record-ID"]), size, digest, kind, _page(headers.get("WARC-Refers-To")), headers.get("WARC-Target-URI"), path, intact))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    # One archive is one task: a fixed number of partitions is not merged for being small.
    return index.select("path").repartition(max(1, index.count())).mapInArrow(read, _OUT)


def archive_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive the pages and read the archives back, one row per page.

    Null html is an empty payload; a null url leaves its header out; a null page_id keeps a
    null id; repeated rows give records each. Very long pages make an archive of their own.
    An empty table writes no archive and gives no rows. Other columns are ignored.
    """
    folder = folder or _uri(shared_path(pages.sparkSession, f"warc-{uuid.uuid4().hex[:8]}"))
    return read_archives(write_archives(decided(pages), folder), folder)


def _uri(path: str) -> str:
    return path if ":/" in path else f"file://{path}"
