"""Pack token sequences by exact-complement hashing.

Every document becomes pieces of at most ``size`` tokens.  Only the histogram of piece lengths (at
most ``size`` numbers) reaches the driver.  There, lengths are taken from the longest down; the gap
each leaves is looked up among the available single lengths, pair sums and triple sums, and the
combination found is consumed as often as the counts allow.  What no combination completes goes to
the fullest open sequence it fits (best fit), again by count.  The plan is a table of patterns;
pieces find their place by their rank among pieces of equal length.  Ranks are made without a
window over pieces: each task numbers its pieces per length while it writes them, and one row per
task and length holds the offset.

Nulls and edges: a null or empty text is one piece holding the end token; a null id is packed like
any other; repeated rows are packed once per row; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from assayer.llm import words
from assayer.session import materialize

SIZE = 2048
END = 0
# fixed values: the published pattern and special token of this vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = {"<|endoftext|>": 50256}


def ranks_path(json_path: str) -> str:
    """The rank file of the same vocabulary, beside the tokenizer file."""
    return str(Path(json_path).with_suffix(".tiktoken"))


def encoder(path: str) -> tiktoken.Encoding:
    def load() -> tiktoken.Encoding:
        lines = Path(path).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    return words.kept(f"encoder {path}", load)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: the first takes what is left over."""
    first = n % size or size
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           size: int = SIZE) -> DataFrame:
    """One row per piece, with its task ``part`` and its number ``nth`` among equal lengths there.

    The two numbers hold only once the rows are stored.
    """
    def run(batches):
        enc, seen, part = encoder(path), Counter(), TaskContext.get().partitionId()
        for whole in batches:
            for batch in words.row_blocks(whole, "text", 4 << 20):
                rows, out = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    ids = np.append(enc.encode_to_numpy(text or "", allowed_special="all"), END).astype("<u4")
                    for k, (at, n) in enumerate(cut(len(ids), size)):
                        rows.append(i)
                        out.append((k, at, n, zlib.crc32(ids[at:at + n].tobytes()), part, seen[n]))
                        seen[n] += 1
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(rows)), *columns],
                    ["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {id_type}, piece int, start long, length long, "
                                  "ids_crc32 long, part int, nth long")


def _complement(have: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """Longest-first single, pair or triple of available lengths that sums to ``gap``."""
    if have[gap]:
        return (gap,)

    def pair(total: int, counts: np.ndarray) -> tuple[int, int] | None:
        if total < 2:
            return None
        low = np.arange(1, total // 2 + 1)  # smaller part first: the larger part is as long as can be
        fits = (counts[low] > 0) & (counts[total - low] > 0)
        fits[-1] &= total % 2 == 1 or counts[total // 2] > 1
        at = int(fits.argmax())
        return (total - int(low[at]), int(low[at])) if fits[at] else None

    if two := pair(gap, have):
        return two
    for first in np.flatnonzero(have[:max(0, gap - 1)])[::-1]:
        counts = have.copy()
        counts[first] -= 1
        if two := pair(gap - int(first), counts):
            return (int(first), *two)
    return None


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order) and how many sequences follow each."""
    have = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    done: Counter = Counter()
    rest: dict[int, int] = {}
    done[(size,)] = int(have[size])
    have[size] = 0
    for longest in range(size - 1, 0, -1):
        while have[longest]:
            have[longest] -= 1
            found = _complement(have, size - longest)
            have[longest] += 1
            if not found:
                break
            whole = (longest, *found)
            times = min(int(have[x]) // k for x, k in Counter(whole).items())
            for x in whole:
                have[x] -= times
            done[whole] += times
        if have[longest]:
            rest[longest] = int(have[longest])
            have[longest] = 0
    # best fit, by count: open[gap] holds patterns with that much room
    open_: dict[int, list] = defaultdict(list)
    for length, left in rest.items():
        while left:
            gap = min((g for g, bins in open_.items() if g >= length and bins), default=size)
            pattern, many = open_[gap].pop() if open_.get(gap) else ((), left)
            each = gap // length  # the fullest sequence stays the fullest until it has no room
            full = min(many, left // each)
            parts = [(each, full)] if full else [(left, 1)]
            used = sum(k * t for k, t in parts)
            if pattern and many > parts[0][1]:
                open_[gap].append((pattern, many - parts[0][1]))
            for k, t in parts:
                open_[gap - k * length].append((pattern + (length,) * k, t))
            left -= used
    for bins in open_.values():
        for pattern, many in bins:
            done[pattern] += many
    return [(p, n) for p, n in done.items() if n and p]


def slots(patterns: list[tuple[tuple[int, ...], int]], size: int) -> np.ndarray:
    """Rows (length, first rank, sequence, offset), sorted: where pieces of a length go from a rank on."""
    taken, rows, sequence = Counter(), [], 0
    for pattern, many in patterns:
        at = 0
        for length in pattern:
            rows.append((length, taken[length], sequence, at))
            taken[length] += many
            at += length
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(stored: DataFrame, size: int = SIZE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces."""
    by_task = stored.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = slots(plan(counts, size), size)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = (stored.join(offsets, ["part", "length"])
              .withColumn("rank", F.col("nth") + F.col("before")).drop("part", "nth", "before"))
    starts = {int(n): place[place[:, 0] == n] for n in np.unique(place[:, 0])}

    def run(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.zeros((2, len(rank)), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                table = starts[int(n)]
                at = np.searchsorted(table[:, 1], rank[mine], "right") - 1
                sequence[mine] = table[at, 2] + rank[mine] - table[at, 1]
                offset[mine] = table[at, 3]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(sequence), pa.array(offset)],
                [*keep, "sequence_id", "offset"])

    keep = ["id", "piece", "start", "length", "ids_crc32"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema if f.name in keep)
    return ranked.select(*keep, "rank").mapInArrow(run, fields + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   size: int = SIZE) -> DataFrame:
    """Pieces of all documents and their places; ``path`` names the rank file of the vocabulary."""
    stored = materialize(pieces(docs, path, id_col, text_col, size), "pieces")
    return pack(stored, size).withColumnRenamed("id", id_col)
