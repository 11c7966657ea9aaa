"""Token ids as binary files: frequency-ranked, byte-aligned variable-length, with separate control bytes.

Ids are counted over all documents and replaced by their rank (most frequent first; ties: smaller id), so
common ids take one byte.  Of every four ranks a control byte holds the lengths (two bits each: 1 to 4
bytes); the ranks' bytes follow in a data stream of their own.  Reading looks control bytes up in a table of
lengths, sums them to positions and gathers whole blocks at once.

Files below ``path``:

* ``ids/`` holds blocks, each ended by a line feed (rows of Spark's text writer, so its commit protocol holds).  A
  block is a header (``HEADER``), a table of its pieces (``PIECE``: document id, number of ids, data bytes, number
  within the document, flags), control bytes and data bytes.  Every piece starts on a control byte of its own, so a
  document can be read alone.  A piece has at most ``PIECE_IDS`` ids, a block about ``BLOCK_IDS``, a file
  ``FILE_BLOCKS`` blocks; longer documents go on in the next piece.  All numbers are little-endian.
* ``ranks/`` is a Parquet table of at most one row per vocabulary entry: rank, id, count.

Documents stand in ascending order of their id: one range exchange, and blocks carry the number of their range and
what came before them in it.  Where a document starts among all ids follows on reading from one total per range.

Nulls, edges, ties: a null or empty text is the end id alone; null ids come first; rows that share an id follow
each other in the order of the stored table, each a document of its own; texts of any length are cut into pieces after
encoding; an empty table gives an empty result; columns beside id and text are left out, whatever their names;
ids are integers (another type fails when the files are written); a damaged block fails its checksum on reading.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from assayer.llm import packing, words
from assayer.session import materialize, scratch_path

END = 0
PIECE_IDS = 1 << 16
BLOCK_IDS = 1 << 18
FILE_BLOCKS = 32
MAGIC = 0x31444954  # "TID1"
HEADER = np.dtype([("magic", "<u4"), ("crc", "<u4"), ("range", "<u4"), ("pieces", "<u4"), ("first", "<i8"),
                   ("documents", "<i8"), ("control", "<u4"), ("data", "<u4")])
PIECE = np.dtype([("id", "<i8"), ("ids", "<u4"), ("data", "<u4"), ("number", "<u4"), ("flags", "<u4")])
NULL_ID, LAST = 1, 2
_FOUR = np.arange(4)
_CODES = np.arange(256)[:, None] >> 2 * _FOUR & 3
LENGTHS = (_CODES + 1).astype(np.uint8)  # bytes of the four values behind a control byte
_KEPT = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control and data bytes of unsigned 32-bit values."""
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[:len(values)] = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    control = (codes.reshape(-1, 4) << (2 * _FOUR).astype(np.uint8)).sum(1, dtype=np.uint8)
    split = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control, split[_FOUR <= codes[:len(values), None]]


def decode_values(counts: np.ndarray, control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Values of consecutive pieces of ``counts`` values, each on control bytes of its own."""
    groups = -(-counts // 4)
    length = LENGTHS[control].ravel()
    used = np.ones(len(length), bool)
    ends, spare = np.cumsum(groups) * 4, groups * 4 - counts
    for k in range(3):
        used[ends[spare > k] - 1 - k] = False
    length = length[used].astype(np.int64)
    at = np.cumsum(length) - length
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    value = np.zeros(len(at), np.uint32)
    for k in range(4):
        value |= padded[at + k].astype(np.uint32) << np.uint32(8 * k)
    return value & _KEPT[length]


def _shifts() -> list[list[int]]:
    """For each k the images of 32 single bits of a CRC-32 behind ``2 ** k`` zero bytes."""
    def times(m: list[int], v: int) -> int:
        out = 0
        for row in m:
            if v & 1:
                out ^= row
            v >>= 1
        return out

    bit = [0xEDB88320] + [1 << n for n in range(31)]
    for _ in range(3):
        bit = [times(bit, x) for x in bit]
    out = [bit]
    for _ in range(40):
        bit = [times(bit, x) for x in bit]
        out.append(bit)
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of pieces put together, from their (CRC-32, number of bytes)."""
    shifts, crc = _shifts(), 0
    for own, size in parts:
        k = 0
        while size:
            if size & 1:
                moved = 0
                for bit, row in enumerate(shifts[k]):
                    if crc >> bit & 1:
                        moved ^= row
                crc = moved
            size >>= 1
            k += 1
        crc ^= own
    return crc


def _batches_of(batches, column: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        yield from words.row_blocks(whole, column, 4 << 20)


def token_pieces(docs: DataFrame, ranks_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``row`` (stored order), ``number``, ``last`` and ``ids`` (little-endian bytes) per piece.

    ``row`` holds only once the rows are stored.  Ids take two bytes each where all of a piece fit, else four.
    """
    def run(batches):
        enc, row = packing.encoder(ranks_file), TaskContext.get().partitionId() << 33
        for batch in _batches_of(batches, "text"):
            source, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(enc.encode_to_numpy(text or "", allowed_special="all"), END).astype("<u4")
                for number, at in enumerate(range(0, len(ids), PIECE_IDS)):
                    part = ids[at:at + PIECE_IDS]
                    wide = "<u2" if part.max() < 1 << 16 else "<u4"
                    source.append(i)
                    out.append((row, number, at + PIECE_IDS >= len(ids), len(part), part.astype(wide).tobytes()))
                row += 1
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(source)), *columns],
                                             ["id", "row", "number", "last", "n", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, row long, number int, last boolean, n int, ids binary")


def _unpacked(buffer: bytes, n: int) -> np.ndarray:
    return np.frombuffer(buffer, "<u2" if len(buffer) == 2 * n else "<u4")


def id_counts(pieces: DataFrame) -> DataFrame:
    """``id`` and ``count``: every task counts its ids, at most one row per vocabulary entry."""
    def run(batches):
        seen: Counter = Counter()
        for batch in _batches_of(batches, "ids"):
            both = zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True)
            ids = np.concatenate([np.zeros(0, "<u4"), *(_unpacked(b, n) for b, n in both)])
            for i, n in zip(*(x.tolist() for x in np.unique(ids, return_counts=True)), strict=True):
                seen[i] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())],
                                         ["id", "count"])

    counted = pieces.select("n", "ids").mapInArrow(run, "id long, count long")
    return counted.groupBy("id").agg(F.sum("count").alias("count"))


class _Block:
    """Pieces of one block on their way into a file."""

    def __init__(self, part: int):
        self.part, self.first, self.documents = part, 0, 0
        self.table, self.control, self.data, self.held = [], [], [], 0

    def add(self, ident: int | None, number: int, last: bool, values: np.ndarray) -> None:
        control, data = encode_values(values)
        flags = (NULL_ID if ident is None else 0) | (LAST if last else 0)
        self.table.append((ident or 0, len(values), len(data), number, flags))
        self.control.append(control)
        self.data.append(data)
        self.held += len(values)

    def take(self) -> bytes:
        table = np.array(self.table, PIECE)
        control, data = np.concatenate(self.control), np.concatenate(self.data)
        body = table.tobytes() + control.tobytes() + data.tobytes()
        head = np.array((MAGIC, zlib.crc32(body), self.part, len(table), self.first, self.documents,
                         len(control), len(data)), HEADER)
        self.first += self.held
        self.documents += int((table["number"] == 0).sum())
        self.table, self.control, self.data, self.held = [], [], [], 0
        return head.tobytes() + body


def write(docs: DataFrame, path: str, ranks_file: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts, write the ranks and the id files below ``path``."""
    pieces, store = token_pieces(docs, ranks_file, id_col, text_col), scratch_path(docs.sparkSession, "token-pieces")
    pieces.write.option("compression", "zstd").parquet(store)
    stored = docs.sparkSession.read.schema(pieces.schema).parquet(store)
    # at most one row per vocabulary entry
    counts = sorted(id_counts(stored).collect(), key=lambda r: (-r["count"], r["id"]))
    rows = [(rank, r["id"], r["count"]) for rank, r in enumerate(counts)]
    docs.sparkSession.createDataFrame(rows, "rank long, id long, count long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max((r[1] for r in rows), default=0) + 1, np.uint32)
    for rank, ident, _ in rows:
        rank_of[ident] = rank

    def run(batches):
        block = _Block(TaskContext.get().partitionId())
        for batch in _batches_of(batches, "ids"):
            columns = (batch.column(c).to_pylist() for c in ("id", "number", "last", "n", "ids"))
            for ident, number, last, n, ids in zip(*columns, strict=True):
                block.add(ident, number, last, rank_of[_unpacked(ids, n)])
                if block.held >= BLOCK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([block.take()], pa.binary())], ["value"])
        if block.held:
            yield pa.RecordBatch.from_arrays([pa.array([block.take()], pa.binary())], ["value"])

    order = ["id", "row", "number"]
    blocks = stored.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "value binary")
    (blocks.select(F.col("value").cast("string")).write.option("lineSep", "\n")
     .option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/ids"))


def blocks_of(content: memoryview | bytes) -> Iterator[tuple[np.void, np.ndarray, np.ndarray, np.ndarray]]:
    """Header, piece table, control and data bytes of each block of a file."""
    at = 0
    while at < len(content):
        head = np.frombuffer(content, HEADER, 1, at)[0]
        size = int(head["pieces"]) * PIECE.itemsize + int(head["control"]) + int(head["data"])
        at += HEADER.itemsize
        if head["magic"] != MAGIC or zlib.crc32(content[at:at + size]) != head["crc"]:
            raise ValueError("damaged block of token ids")
        table = np.frombuffer(content, PIECE, int(head["pieces"]), at)
        control = np.frombuffer(content, np.uint8, int(head["control"]), at + table.nbytes)
        data = np.frombuffer(content, np.uint8, int(head["data"]), at + table.nbytes + len(control))
        at += size + 1
        yield head, table, control, data


def read_pieces(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per piece as the files hold it; places are those within its range."""
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    names = ["range", "first", "document", "id", "n", "number", "last", "crc"] + ["ids"] * with_ids

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for head, table, control, data in blocks_of(memoryview(batch.column(0)[i].as_buffer())):
                    counts = table["ids"].astype(np.int64)
                    ids = by_rank[decode_values(counts, control, data)].astype("<u4")
                    ends = np.cumsum(counts)
                    parts = [ids[a:b] for a, b in zip(ends - counts, ends, strict=True)]
                    fresh = np.cumsum(table["number"] == 0)
                    n = len(table)
                    out = [pa.array(np.full(n, head["range"], np.int32)), pa.array(head["first"] + ends - counts),
                           pa.array(head["documents"] + fresh - 1),
                           pa.array(table["id"].astype(np.int64), mask=table["flags"] & NULL_ID > 0), pa.array(counts),
                           pa.array(table["number"].astype(np.int32)), pa.array(table["flags"] & LAST > 0),
                           pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                    if with_ids:
                        out.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(out, names)

    kinds = ["int", "long", "long", "long", "long", "int", "boolean", "long", "array<int>"]
    files = spark.read.format("binaryFile").load(f"{path}/ids").select("content")
    return files.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in zip(names, kinds, strict=False)))


def read(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document: its id, ``start`` among all ids, ``n_tokens``, ``ids_crc32`` and, if asked, ``ids``."""
    pieces = materialize(read_pieces(spark, path, with_ids), "read-pieces")
    # one row per range that was written
    totals = pieces.groupBy("range").agg(F.sum("n").alias("_n"), F.sum((F.col("number") == 0).cast("long")).alias("_d"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_d")])
    placed = (pieces.join(bases, "range").withColumn("start", F.col("first") + F.col("_n"))
              .withColumn("document", F.col("document") + F.col("_d")))
    extra = ["ids"] if with_ids else []
    whole = placed.filter("number = 0 AND last").select("id", "start", F.col("n").alias("n_tokens"),
                                                        F.col("crc").alias("ids_crc32"), *extra)
    # a document has at most its bytes / PIECE_IDS pieces
    fields = ["start", "n", "crc", *extra]
    cut = placed.filter("NOT (number = 0 AND last)").groupBy("document").agg(
        F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct(*fields))).alias("parts"))

    def run(batches):
        for batch in batches:
            crc = [joined_crc([(p["crc"], 4 * p["n"]) for p in parts]) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crc, pa.int64())], [*batch.schema.names, "crc"])

    small = cut.select("id", F.transform("parts", lambda p: F.struct(p["n"].alias("n"), p["crc"].alias("crc")))
                       .alias("parts"), F.col("parts")[0]["start"].alias("start"), F.aggregate(
        "parts", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_tokens"),
        *[F.flatten(F.transform("parts", lambda p: p[c])).alias(c) for c in extra])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in small.schema)
    joined = small.mapInArrow(run, f"{kinds}, crc long").select(
        "id", "start", "n_tokens", F.col("crc").alias("ids_crc32"), *extra)
    return whole.unionAll(joined).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, ranks_file: str, id_col: str = "doc_id", text_col: str = "text",
               with_ids: bool = False) -> DataFrame:
    """Write the files to a fresh folder of the shared place and read them back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write(docs, path, ranks_file, id_col, text_col)
    return read(docs.sparkSession, path, id_col, with_ids)
