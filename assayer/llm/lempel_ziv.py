"""Remove repeated passages by content-cut blocks and windows, in place of a relative Lempel-Ziv parse.

The reference is the whole corpus.  Each document is cut by its own content into blocks: the windows
of ``window`` words that share the same smallest 5-gram, together with all words they cover.  Equal
passages give equal blocks wherever they stand.  The index holds, for every block that could occur
twice, the smallest document that has it.  Of a document, all words of the blocks that the index has
from a smaller document are duplicates.  Where a block is found only in part, single windows are looked
up in a window index built from just those blocks.  Neighbouring and overlapping finds are one span
(``factors``): the words that greedy factors of ``window`` words and more would cover, without extending
matches over the texts of other documents.

The index is exact: a 5-gram that only one document selects cannot lie in a repeated window, and it
is dropped first.  Lists per document are never longer than the document.

Nulls and edges: null and empty texts have no words; texts shorter than a window keep all; a document
without id neither loses words nor serves as reference; rows that repeat an id do not remove words
from each other; only id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm import words
from assayer.session import materialize

WINDOW = 13
GRAM = 5
_BASE = 0xA0761D6478BD642F


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return words.kept(f"range powers {size}", lambda: _both_powers(size))


def _both_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Ranges:
    """Hash of any range of words of a slice."""

    def __init__(self, found: np.ndarray):
        size = max(1 << 19, 1 << len(found).bit_length())
        # only the common size is worth keeping
        up, self.down = _powers(size) if size <= 1 << 20 else _both_powers(size)
        self.total = np.zeros(len(found) + 1, np.uint64)
        np.cumsum(found * up[:len(found)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        spread = (self.total[ends] - self.total[starts]) * self.down[starts]
        return words.mix(spread + (ends - starts).astype(np.uint64))


def least_grams(found: np.ndarray, splits: np.ndarray, window: int, k: int) -> np.ndarray:
    """Smallest k-gram hash of the window at each word (windows may leave the text)."""
    gram, _ = words.grams(found, splits, k)
    have, want = 1, window - k + 1
    low = gram
    while have < want:
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:]) if step < len(low) else low[:0]
        have += step
    return low


def blocks(texts: list[bytes | None], window: int, k: int):
    """For each text of a slice: (words before it, words, block starts, block ends, anchors), and Ranges.

    Starts and ends count windows from the slice's first word; the end is exclusive.
    """
    found, splits = words.hashed(texts, lower=False)
    low = least_grams(found, splits, window, k)
    ranges = Ranges(found)
    out = []
    for a, z in zip(splits[:-1].tolist(), splits[1:].tolist(), strict=True):
        last = z - window + 1
        if last <= a:
            out.append((a, z - a, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)))
            continue
        mine = low[a:last]
        starts = np.concatenate([[0], np.flatnonzero(mine[1:] != mine[:-1]) + 1])
        ends = np.append(starts[1:], last - a)
        out.append((a, z - a, starts + a, ends + a, mine[starts]))
    return out, ranges


def _each(batches, *columns: str):
    """(batch, rows of a slice, their texts) over Arrow batches."""
    for whole in batches:
        for batch in words.row_blocks(whole, "text", 4 << 20):
            texts = words.as_bytes(batch.column("text"))
            for i, j in words.slices(texts):
                yield batch.slice(i, j - i), texts[i:j]


def _pairs(ids: pa.Array, parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """Rows of 64-bit columns, as many for each id as its arrays are long."""
    columns = [np.concatenate(c) if c else np.zeros(0, np.uint64) for c in zip(*parts, strict=True)]
    rows = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(rows)), *[pa.array(c.astype(np.uint64).view(np.int64)) for c in columns]],
        ["id", *names])


def _listed(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    return [np.asarray(v.values, np.int64).view(np.uint64) if v.is_valid else np.zeros(0, np.uint64)
            for v in column]


def duplicate_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    window: int = WINDOW, k: int = GRAM, carry: bool = False) -> DataFrame:
    """``id_col``, ``n_words``, ``factors`` (start and end word) and ``kept_text`` of each row.

    ``carry`` adds the whole input row as ``rest`` (its text null) and leaves a text that loses
    nothing as it was, so that nobody has to join the texts again.
    """
    none = F.lit(None).cast(docs.schema[text_col].dataType)
    rest = F.struct(*[none.alias(c) if c == text_col else F.col(c) for c in docs.columns])
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"),
                         *([rest.alias("rest")] if carry else []))
    base = source.filter("id IS NOT NULL")
    kind = source.schema["id"].dataType.simpleString()

    def anchors(batches):
        for batch, texts in _each(batches):
            found, _ = blocks(texts, window, k)
            yield _pairs(batch.column("id"), [[np.unique(b[4])] for b in found], ["anchor"])

    def shared_blocks(batches):
        for batch, texts in _each(batches):
            found, ranges = blocks(texts, window, k)
            parts = []
            for (_, _, starts, ends, anchor), wanted in zip(found, _listed(batch, "anchors"), strict=True):
                use = np.isin(anchor, wanted)
                block = ranges(starts[use], ends[use] + window - 1)
                block, first = np.unique(block, return_index=True)
                parts.append([anchor[use][first], block])
            yield _pairs(batch.column("id"), parts, ["anchor", "block"])

    def boundary_windows(batches):
        for batch, texts in _each(batches):
            found, ranges = blocks(texts, window, k)
            parts = []
            for (_, _, starts, ends, _), wanted in zip(found, _listed(batch, "blocks"), strict=True):
                use = np.isin(ranges(starts, ends + window - 1), wanted)
                at = np.concatenate([np.zeros(0, np.int64), *map(np.arange, starts[use], ends[use])])
                parts.append([np.unique(ranges(at, at + window))])
            yield _pairs(batch.column("id"), parts, ["win"])

    def parse(batches):
        for batch, texts in _each(batches):
            found, ranges = blocks(texts, window, k)
            sizes, spans, kept = [], [], []
            rows = zip(texts, found, _listed(batch, "blocks"), _listed(batch, "wins"), strict=True)
            for text, (a, n, starts, ends, _), whole, single in rows:
                covered = np.zeros(n + 1, np.int64)
                if len(whole):
                    use = np.isin(ranges(starts, ends + window - 1), whole)
                    np.add.at(covered, starts[use] - a, 1)
                    np.add.at(covered, ends[use] + window - 1 - a, -1)
                if len(single):
                    at = np.arange(a, a + n - window + 1)
                    at = at[np.isin(ranges(at, at + window), single)] - a
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + window, -1)
                gone = np.cumsum(covered[:-1]) > 0
                sizes.append(n)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append(edge.tolist())
                if carry and not len(edge):
                    kept.append(text)
                elif not text:
                    kept.append(b"")
                elif not len(edge):
                    kept.append(b" ".join(text.split()))
                else:
                    kept.append(b" ".join([w for w, g in zip(text.split(), gone.tolist(), strict=True) if not g]))
            more = [batch.column("rest")] if carry else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.int64())),
                 pa.array(kept, pa.binary()).cast(pa.string()), *more],
                ["id", "n_words", "factors", "kept_text"] + ["rest"] * carry)

    selected = base.mapInArrow(anchors, f"id {kind}, anchor long")
    shared = selected.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    lists = materialize(selected.join(shared, "anchor").groupBy("id")
                        .agg(F.collect_set("anchor").alias("anchors")), "anchors")

    found = base.join(lists, "id").mapInArrow(shared_blocks, f"id {kind}, anchor long, block long")
    index = found.groupBy("anchor", "block").agg(F.min("id").alias("first"))
    copied = found.join(index, ["anchor", "block"]).filter("id > first").selectExpr("id", "block", "null AS win")
    # anchors whose blocks differ: some windows may still be shared
    partly = index.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    open_blocks = (index.join(partly, "anchor").groupBy(F.col("first").alias("id"))
                   .agg(F.collect_set("block").alias("blocks")))
    window_rows = base.join(open_blocks, "id").mapInArrow(boundary_windows, f"id {kind}, win long")
    first = window_rows.groupBy("win").agg(F.min("id").alias("first"))
    single = window_rows.join(first, "win").filter("id > first").selectExpr("id", "null AS block", "win")
    flags = copied.unionByName(single).groupBy("id").agg(
        F.collect_set("block").alias("blocks"), F.collect_set("win").alias("wins"))
    out = f"id {kind}, n_words long, factors array<bigint>, kept_text string"
    out += f", rest {source.schema['rest'].dataType.simpleString()}" if carry else ""
    parsed = base.join(flags, "id", "left").mapInArrow(parse, out)
    unnamed = (source.filter("id IS NULL").selectExpr("*", "cast(null AS array<bigint>) AS blocks",
                                                      "cast(null AS array<bigint>) AS wins").mapInArrow(parse, out))
    return parsed.unionAll(unnamed).withColumnRenamed("id", id_col)


def digests(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    # factors alternate start, end; they do not overlap
    removed = F.expr("aggregate(transform(factors, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    return parsed.select(id_col, "n_words", removed.alias("n_removed"),
                         F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with repeated passages cut out; a text that loses nothing stays as it is.

    Ids must be unique.  Documents that lose every word go; empty ones that lost nothing stay.
    ``n_chars``, if there, is set anew.
    """
    parsed = duplicate_words(docs, id_col, text_col, carry=True).filter("size(factors) = 0 OR kept_text <> ''")
    changed = F.size("factors") > 0
    columns = {c: F.col("rest").getField(c) for c in docs.columns} | {text_col: F.col("kept_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(
            columns["n_chars"])
    return parsed.select(*[v.alias(c) for c, v in columns.items()])
