"""Toxicity by a character n-gram linear classifier over naive Bayes log-count ratios.

A text's features are its distinct character n-grams (bytes, A-Z lower-cased), hashed to
``2 ** bits`` buckets and scaled by r = log((p / |p|) / (q / |q|)), where p and q count the toxic and
the other training texts that hold the bucket, and brought to unit length.  A logistic regression on
the scaled features is fitted on at most ``per_class`` labelled rows of each class, drawn by the hash of their id; its bias
is set back to the class shares of all labelled training rows.  Ids and labels only choose and mark
the training rows; a score depends on the text alone.

Nulls and edges: a null text is an empty text and scores the bias; rows with a null label or id are
not used for training; with no row of one class every score is 0; repeated rows and extra columns
change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from assayer.llm import words

SIZES = (3, 4, 5)
BITS = 18
PER_CLASS = 3000
EPOCHS = 6
RATE = 0.4


def held_out(key: Column, of: int = 5) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % of == 0, F.lit(False))


def gram_buckets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Distinct n-gram buckets of each text of a slice; a very long text is read in pieces."""
    seen = np.zeros(1 << BITS, bool)
    values = words._byte_values(True)
    base, shift = np.uint64(words._BASE), np.uint64(64 - BITS)
    overlap = max(SIZES) - 1
    for text in texts:
        data = np.frombuffer(text or b"", np.uint8)
        for at in range(0, len(data), words.SLICE_BYTES):
            x = values[data[at:at + words.SLICE_BYTES + overlap]]
            h = x
            for n in range(2, max(SIZES) + 1):
                h = h[:-1] * base + x[n - 1:] if len(h) else h
                if n in SIZES and len(h):
                    seen[((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


Model = tuple[np.ndarray, np.ndarray, float]  # weight * ratio and ratio ** 2 per bucket, bias


def fit(texts: list[bytes | None], toxic: np.ndarray, prior: float) -> Model:
    """``prior`` is the log odds of the toxic class among all labelled rows."""
    rows = list(gram_buckets(texts))
    size = 1 << BITS
    p, q = np.ones(size), np.ones(size)
    for row, y in zip(rows, toxic, strict=True):
        (p if y else q)[row] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    weights, bias = np.zeros(size), 0.0
    order = words.stream(7, len(rows)).argsort()
    for _ in range(EPOCHS):
        for i in order:
            row = rows[i]
            x = ratio[row]
            x = x / math.sqrt(x @ x + 1e-9)
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, weights[row] @ x + bias)))) - toxic[i]
            weights[row] -= RATE * error * x
            bias -= RATE / 10 * error
    drawn = math.log(max(1, toxic.sum()) / max(1, len(toxic) - toxic.sum()))
    return weights * ratio, ratio * ratio, bias + prior - drawn


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                  per_class: int) -> tuple[DataFrame, float] | None:
    """A bounded sample (``text``, ``toxic``) of labelled rows and the log odds of all of them."""
    usable = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
              .filter(~held_out(F.col("id"))).filter("id IS NOT NULL AND toxic IN (0, 1)"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    some = lambda y: usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
    chosen = some(0).unionAll(some(1)).dropDuplicates(["id"])
    # at most 2 * per_class rows: bounded, whatever the tables hold
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
             .join(F.broadcast(chosen), "id"))
    return texts, math.log(counts[1] / counts[0])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", per_class: int = PER_CLASS) -> Model | None:
    """The fitted model, made in one task over the bounded sample."""
    sample = training_rows(docs, labels, id_col, text_col, label_col, per_class)
    if sample is None:
        return None
    rows, prior = sample

    def run(batches):
        texts, toxic, ids = [], [], []
        for batch in batches:
            texts += words.as_bytes(batch.column("text"))
            toxic += batch.column("toxic").to_pylist()
            ids += batch.column("id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or b""))
        if ids:
            *tables, bias = fit([texts[i] for i in order], np.array([toxic[i] for i in order]), prior)
            columns = [pa.array([t.astype("<f4").tobytes()], pa.binary()) for t in tables]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([bias])], ["weights", "squares", "bias"])

    model = rows.repartition(1).mapInArrow(run, "weights binary, squares binary, bias double").first()
    return (*(np.frombuffer(t, "<f4") for t in model[:2]), model["bias"]) if model else None


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``doc`` (the row as one struct, so its columns may have any names) and ``score`` in [0, 1]."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in words.row_blocks(whole, "text"):
                texts = words.as_bytes(batch.column("text"))
                if shared.value is None:
                    scores = np.zeros(len(texts))
                else:
                    weights, squares, bias = shared.value
                    raw = [weights[row].sum(dtype=np.float64) / math.sqrt(squares[row].sum(dtype=np.float64) + 1e-9)
                           for row in gram_buckets(texts)]
                    scores = 1 / (1 + np.exp(-np.clip(np.array(raw) + bias, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(scores, pa.float64())], ["doc", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema["doc"], StructField("score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` for each row."""
    model = train(docs, labels, id_col, text_col, label_col, per_class)
    scored = score(docs.select(id_col, text_col), model, text_col).select(F.col("doc")[id_col].alias(id_col), "score")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that score below one half."""
    return score(docs, train(docs, labels)).filter("score < 0.5").select("doc.*")
