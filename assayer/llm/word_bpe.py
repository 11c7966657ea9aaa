"""Byte-pair encoding through a distinct-word table.

Words are split and counted over the whole corpus in Spark.  The most frequent ones (at most ``frequent`` of at
most ``LONGEST`` bytes, all those above a count that a histogram gives) are encoded once, by all tasks; their
ids go to every task as a broadcast table and are joined back to the word positions.  Rarer and
longer words are encoded once per task, in the task's own distinct-word table.  (Joining those by position as well would move the ids of nearly
every document through a shuffle.)  Ids are decoded through an id-to-piece table, as large as the
vocabulary.

Nulls and edges: a null text is an empty text, which has no ids; a text holding a special token is
cut there; repeated rows give repeated rows; words of equal count are listed together or not at all;
texts of any length are read whole; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from assayer.llm import words
from assayer.session import materialize

FREQUENT = 1 << 18
LONGEST = 64  # bytes of a listed word: the table sent to every task has a bound in bytes
STEPS = 16  # classes of counts per doubling
TABLE_FLUSH = 1 << 18
# fixed values: the published word pattern of this vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
EXACT = regex.compile(PATTERN)
# the same words for texts without the characters that the two engines class differently
QUICK = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
ODD = regex.compile(r"[\p{No}\p{Nl}\x1c-\x1f]")


def split_words(text: str) -> list[str]:
    """Words of a text without special tokens, after composition and lower-casing."""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return (EXACT if ODD.search(text) else QUICK).findall(text)


class Coder:
    """Encodes single words and decodes ids with one tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        self.at_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.piece = {i: p for p, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}

    def encode_word(self, word: str) -> list[int]:
        if word in self.special:  # never a word of split_words: those are shorter runs
            return [self.special[word]]
        mapped = "".join(p for p, _ in self.alphabet.pre_tokenize_str(word))
        return [t.id for t in self.tokenizer.model.tokenize(mapped)]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.piece[i] for i in ids)

    def words(self, text: str) -> list[str]:
        if not self.at_special.search(text):
            return split_words(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += split_words(text[at:m.start()])
            out.append(m.group())
            at = m.end()
        return out + split_words(text[at:])


def coder(path: str) -> Coder:
    return words.kept(f"coder {path}", lambda: Coder(path))


def word_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``word`` and ``n`` over all texts."""
    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def run(batches):
        code, seen = coder(path), Counter()
        for whole in batches:
            for batch in words.row_blocks(whole, "text", 4 << 20):
                for text in batch.column("text").to_pylist():
                    seen.update(code.words(text or ""))
                if len(seen) > TABLE_FLUSH:
                    yield rows(seen)
                    seen.clear()
        if seen:
            yield rows(seen)

    return (docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def word_table(counts: DataFrame, path: str, frequent: int = FREQUENT) -> DataFrame:
    """``word`` and ``ids`` of the most frequent words of stored ``counts``, each encoded once.

    One row per class of counts reaches the driver, which says from which class on words are listed.
    """
    def run(batches):
        code = coder(path)
        for batch in batches:
            listed = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.array([code.encode_word(w) for w in listed], pa.list_(pa.int32()))],
                ["word", "ids"])

    short = counts.filter(F.octet_length("word") <= LONGEST).withColumn(
        "class", F.floor(F.log2(F.col("n")) * STEPS).cast("int"))
    total, least = 0, None
    for r in sorted(short.groupBy("class").agg(F.count("*").alias("m")).collect(), key=lambda r: -r["class"]):
        total += r["m"]
        if total > frequent:
            break
        least = r["class"]
    listed = short.filter(F.col("class") >= (2**31 - 1 if least is None else least)).select("word")
    return listed.mapInArrow(run, "word string, ids array<int>")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  frequent: int = FREQUENT) -> DataFrame:
    """``ids`` (little-endian unsigned 32-bit) and ``decoded`` text of each document."""
    spark = docs.sparkSession
    counts = materialize(word_counts(docs, path, text_col), "word-counts")
    listed = word_table(counts, path, frequent).toArrow()
    ids = listed.column("ids").to_pylist()
    shared = spark.sparkContext.broadcast((
        "\n".join(listed.column("word").to_pylist()), np.array([len(x) for x in ids], np.int32),
        np.array([i for x in ids for i in x], np.uint32)))

    def run(batches):
        code = coder(path)
        text, each, flat = shared.value
        at = {w: i for i, w in enumerate(text.split("\n"))} if len(each) else {}
        own, ends = 0, np.cumsum(each)
        parts = np.split(flat, ends[:-1]) if len(each) else []
        decoded = [code.decode(p.tolist()) for p in parts]
        raw = [p.astype("<u4").tobytes() for p in parts]
        for whole in batches:
            for batch in words.row_blocks(whole, "text", 4 << 20):
                texts = [code.words(t or "") for t in batch.column("text").to_pylist()]
                if own > TABLE_FLUSH:  # the task's own words start anew; the shared ones stay
                    for w in list(at)[len(each):]:
                        del at[w]
                    del raw[len(each):], decoded[len(each):]
                    own = 0
                for w in set().union(*texts).difference(at):
                    found = code.encode_word(w)
                    at[w] = len(raw)
                    raw.append(np.array(found, "<u4").tobytes())
                    decoded.append(code.decode(found))
                    own += 1
                places = [list(map(at.__getitem__, t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"),
                     pa.array([b"".join([raw[i] for i in p]) for p in places], pa.large_binary()),
                     pa.array([" ".join([decoded[i] for i in p]) for p in places], pa.large_string())],
                    ["id", "ids", "decoded"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    return (source.mapInArrow(run, f"id {id_type}, ids binary, decoded string")
            .withColumnRenamed("id", id_col))


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_col, F.expr("CAST(octet_length(ids) / 4 AS long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
