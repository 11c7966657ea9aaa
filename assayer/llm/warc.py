"""WARC archives as a chunked record table.

Writing: a record is a run of lines, each a row of Spark's text writer, which puts a line feed after
every row.  Header lines carry their own carriage return; a payload is cut after line feeds into
chunks of ``CHUNK`` to twice ``CHUNK`` bytes, so no record is ever put together as a whole.  Where no
line feed comes in time, the record ends as a segment and goes on in a continuation record (WARC 1.1
segmentation) behind it in the same archive.  Archives are gzip files; readers unpack them as streams
and never split them, so each is read by one task in order; a partition is one archive of any length.

Reading: a state machine walks the lines and gives one row per chunk, (record id, chunk number,
bytes), with the digest and length so far carried along; the last chunk of a record has the totals.
``assemble`` is for callers that want payloads back; digests never need it.

Equal payloads of at least ``least`` bytes are stored once: the smallest id has the response, the
others are revisits that name it and repeat digest and length in their headers.

Nulls and edges: a null payload is an empty payload; a null id is written as an empty target and read
back as null, and never refers or is referred to; rows that repeat the smallest id with its payload
are all responses; an empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.session import scratch_path

CHUNK = 64 << 10
LEAST = 100
DATE = "2000-01-01T00:00:00Z"  # archives of equal tables are equal


def with_references(pages: DataFrame, id_col: str, payload_col: str, least: int = LEAST) -> DataFrame:
    """``id``, ``payload``, ``digest``, ``size`` and ``refers_to`` (null for a response)."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    # only digests seen twice need their payload rows to meet the smallest id
    first = (rows.filter(F.col("size") >= least).filter("id IS NOT NULL").groupBy("digest")
             .agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    joined = rows.join(first, "digest", "left")
    return joined.select("id", "payload", "digest", "size",
                         F.when(F.col("id") > F.col("first"), F.col("first")).alias("refers_to"))


def _segments(data: bytes) -> Iterator[list[bytes]]:
    """Pieces without the line feed that ended them, in runs; a run ends where no line feed did, between characters."""
    at, run = 0, []
    while len(data) - at > CHUNK:
        cut = data.find(b"\n", at + CHUNK, at + 2 * CHUNK)
        if cut >= 0:
            run.append(data[at:cut])
            at = cut + 1
            continue
        cut = at + 2 * CHUNK
        if cut >= len(data):
            break
        while data[cut] & 0xC0 == 0x80:
            cut -= 1
        yield [*run, data[at:cut]]
        at, run = cut, []
    yield [*run, data[at:]]


def record_lines(name: str, payload: bytes, digest: str, size: int, refers_to: str | None) -> Iterator[bytes]:
    """A record, or its segments, as rows that a line feed follows each."""
    kind = "response" if refers_to is None else "revisit"
    ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{name} {digest}")
    about = [f"WARC-Date: {DATE}".encode(), f"WARC-Target-URI: page:{name}".encode()]
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <urn:uuid:{ident}>".encode(), *about,
            f"WARC-Payload-Digest: sha256:{digest}".encode(), f"X-Payload-Length: {size}".encode()]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To-Target-URI: page:{refers_to}".encode()]
    segments = _segments(payload if refers_to is None else b"")
    run, number = next(segments), 1
    while run is not None:
        after = next(segments, None)
        if number > 1:
            own = uuid.uuid5(ident, str(number))
            head = [b"WARC/1.1", b"WARC-Type: continuation", f"WARC-Record-ID: <urn:uuid:{own}>".encode(), *about,
                    f"WARC-Segment-Origin-ID: <urn:uuid:{ident}>".encode()]
        if number > 1 or after is not None:
            head.append(f"WARC-Segment-Number: {number}".encode())
        if number > 1 and after is None:
            head.append(f"WARC-Segment-Total-Length: {size}".encode())
        length = sum(map(len, run)) + len(run) - 1
        for line in [*head, f"Content-Length: {length}".encode(), b""]:
            yield line + b"\r"
        *most, last = run
        yield from most
        yield last + b"\r"
        yield b"\r"
        run, number = after, number + 1


def write(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html",
          least: int = LEAST) -> None:
    """Write gzip archives below ``path``."""
    def run(batches):
        for batch in batches:
            lines, held = [], 0
            for i in range(batch.num_rows):
                name, payload, digest, size, refers = (batch.column(c)[i].as_py() for c in range(5))
                for line in record_lines("" if name is None else str(name), payload, digest, size,
                                         None if refers is None else str(refers)):
                    lines.append(line)
                    held += len(line)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["value"])
                    lines, held = [], 0
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["value"])

    rows = with_references(pages, id_col, payload_col, least).mapInArrow(run, "value binary")
    (rows.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "gzip")
     .option("maxRecordsPerFile", 0).text(path))  # a session's limit would cut archives inside records


def _header(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.split(b": ", 1) for line in lines if b": " in line)
    return {k.decode().lower(): v.decode() for k, v in pairs}


class Reader:
    """Rows of one archive, fed a line at a time (without its line feed)."""

    def __init__(self):
        self.head: list[bytes] | None = []
        self.record: dict[str, str] = {}
        self.left = self.number = self.size = self.tail = 0
        self.final = True  # no continuation follows
        self.digest = hashlib.sha256()

    def _row(self, part: bytes, last: bool) -> tuple:
        h, whole = self.record, self.digest.hexdigest() if last else None
        row = (h["warc-record-id"], self.number, part, h["warc-type"],
               h["warc-target-uri"].removeprefix("page:") or None,
               h.get("warc-refers-to-target-uri", "").removeprefix("page:") or None,
               h["warc-payload-digest"].removeprefix("sha256:"), int(h["x-payload-length"]), last, whole, self.size)
        self.number += 1
        return row

    def feed(self, line: bytes) -> Iterator[tuple]:
        if self.tail:  # the blank line after a record
            self.tail -= 1
        elif self.head is not None:
            if line != b"\r":
                self.head.append(line.removesuffix(b"\r"))
                return
            header, self.head = _header(self.head), None
            self.left = int(header["content-length"])
            self.final = "warc-segment-number" not in header or "warc-segment-total-length" in header
            if header["warc-type"] != "continuation":
                self.record, self.number, self.size = header, 0, 0
                self.digest = hashlib.sha256()
        else:
            part = line + b"\n" if len(line) < self.left else line[:self.left]
            self.left -= len(part)
            self.size += len(part)
            self.digest.update(part)
            done = self.left == 0 and len(line) >= len(part)
            yield self._row(part, done and self.final)
            if done:  # what is left of the line is the first of two closing line ends
                self.head, self.tail = [], 1


CHUNK_SCHEMA = ("record_id string, chunk int, bytes binary, record_type string, target string, refers_to string, "
                "payload_digest string, payload_bytes long, last boolean, computed_digest string, read_bytes long")
_FIELDS = [pa.string(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(),
           pa.bool_(), pa.string(), pa.int64()]


def read_chunks(spark, path: str) -> DataFrame:
    """The chunk table of all archives below ``path``."""
    names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FIELDS, strict=True)], names)

    def run(batches):
        reader, current = Reader(), None
        for batch in batches:
            rows, held = [], 0
            files = batch.column("file").to_pylist()
            for i, line in enumerate(batch.column("value")):
                if files[i] != current:
                    reader, current = Reader(), files[i]
                for row in reader.feed(line.as_py()):
                    rows.append(row)
                    held += len(row[2])
                if held > 8 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file")
                        ).mapInArrow(run, CHUNK_SCHEMA)


def index(chunks: DataFrame, id_type: str) -> DataFrame:
    """One row per record, from its last chunk; a stored payload has the digest that was computed on the way."""
    stored = F.col("record_type") == "response"
    return chunks.filter("last").select(
        F.col("target").cast(id_type).alias("page_id"),
        F.when(stored, F.col("read_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(stored, F.col("computed_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


def assemble(chunks: DataFrame) -> DataFrame:
    """``target`` and whole ``payload`` of the stored responses (needs memory for the longest)."""
    parts = F.array_sort(F.collect_set(F.struct("chunk", "bytes")))  # repeated records are equal
    whole = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["bytes"]))
    return (chunks.filter("record_type = 'response'").groupBy("record_id", "target")
            .agg(whole.alias("payload")).drop("record_id"))


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read their index back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, id_col, payload_col)
    return index(read_chunks(spark, path), pages.schema[id_col].dataType.simpleString())
