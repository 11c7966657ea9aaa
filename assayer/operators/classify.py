"""Distributed text and vector classifiers on Spark MLlib."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, IDF, Normalizer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.linalg import DenseVector, SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer import terms
from assayer.functions import text as tx
from assayer.operators.metrics import binary_metrics, multiclass_summary
from assayer.session import materialize, scratch_path

CANDIDATE_C = (0.1, 0.3, 1.0, 3.0)


@lru_cache(maxsize=1)
def _unaccented() -> tuple[str, str]:
    """Characters of the basic plane and what their decomposition leaves without combining marks."""
    changed, dropped = {}, []
    for c in map(chr, [*range(0xA0, 0xD800), *range(0xE000, 0x10000)]):
        left = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if not left:
            dropped.append(c)
        elif left != [c] and len(left) == 1:
            changed[c] = left[0]
    # characters of the source beyond the target's length are removed
    return "".join([*changed, *dropped]), "".join(changed.values())


def strip_accents(c: Column | str) -> Column:
    """Text without accents and combining marks, in any script (mapping derived from Unicode).

    Characters that decompose into several letters (ligatures, Hangul syllables) stay as they are.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(c, *_unaccented())


@F.udf(VectorUDT())
def _sublinear(v):
    return SparseVector(v.size, v.indices, 1.0 + np.log(v.values))


def _grams(text: str) -> tuple[Column, Column]:
    """Words of two characters or more, and from a column ``_words`` of them all words and pairs of neighbours."""
    clean = F.lower(strip_accents(F.lower(tx.text_of(text))))
    words = F.regexp_extract_all(clean, F.lit(terms.WORD_OF_TWO), F.lit(0))
    pairs = F.zip_with(F.slice("_words", 1, F.greatest(F.size("_words") - 1, F.lit(0))),
                       F.slice("_words", 2, F.size("_words")), lambda a, b: F.concat(a, F.lit(" "), b))
    return words, F.concat("_words", pairs)


@dataclass
class TextFeatures:
    """Fitted TF-IDF features: tokens -> 1-2-grams -> counts -> weights -> unit length.

    ``trained`` has the training rows without their text, with counts that are stored: no pass over them
    cuts texts again.
    """

    counts: CountVectorizerModel
    weights: ElementwiseProduct
    vocabulary: list[str]
    sublinear: bool
    text: str
    trained: DataFrame

    def counted(self, df: DataFrame) -> DataFrame:
        """Rows with the (sublinear) counts of their terms."""
        return _counted(df, self.counts, self.text, self.sublinear)

    def weigh(self, counted: DataFrame) -> DataFrame:
        weighted = self.weights.transform(counted)
        unit = Normalizer(p=2.0, inputCol="_weighted", outputCol="features").transform(weighted)
        return unit.drop("_tf", "_weighted")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.weigh(self.counted(df))


def _with_grams(df: DataFrame, text: str) -> DataFrame:
    words, grams = _grams(text)
    return df.withColumn("_words", words).withColumn("_grams", grams).drop("_words")


def _counted(df: DataFrame, model: CountVectorizerModel, text: str, sublinear: bool) -> DataFrame:
    out = model.transform(_with_grams(df, text)).drop("_grams")
    return out.withColumn("_tf", _sublinear("_tf")) if sublinear else out


# --- words of several texts of a row, cut once ----------------------------------

@dataclass(frozen=True)
class TextViews:
    """Texts of a row made of the same columns: each column is cut into words once, whatever texts it is part of.

    ``views`` has per text its parts in order: a number stands for that column's words, a tuple for fixed words.
    """

    columns: list[str]
    views: list[list[int | tuple[str, ...]]]

    def cut(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return df.select(*keep, *[_grams(c)[0].alias(f"_w{i}") for i, c in enumerate(self.columns)])


def template_views(templates: list[str]) -> TextViews | None:
    """The views of filled templates; None if a slot has anything but a blank beside it, as words could then join."""
    columns, views = [], []
    for template in templates:
        parts, view = re.split(r"\{(\w+)\}", template), []
        for i, p in enumerate(parts):
            if i % 2:
                columns += [p] if p not in columns else []
                view.append(columns.index(p))
                continue
            after, before = i > 0, i + 1 < len(parts)  # a slot comes before, or after, these fixed characters
            if not p.isascii() or after and before and not p or p and (
                    after and not p[0].isspace() or before and not p[-1].isspace()):
                return None
            view.append(tuple(re.findall(r"[a-z0-9_]{2,}", p.lower())))
        views.append(view)
    return TextViews(columns, views)


PART_WORDS = 1 << 20  # words of a batch that are counted at once
HELD_PAIRS = 1 << 22  # pairs that a task holds before it hands them on


def _word_parts(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where their words pass ``PART_WORDS``; a row stays whole."""
    for batch in batches:
        words = sum(pc.list_value_length(batch.column(f"_w{i}")).to_numpy(zero_copy_only=False).astype(np.int64)
                    for i in range(columns))
        part = np.cumsum(words) // PART_WORDS
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
        for at, end in zip(edges, edges[1:]):
            if end > at:
                yield batch.slice(at, end - at)


def _coded(batch: pa.RecordBatch, columns: int, views: list[list]) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """The words of a batch, and per view the places in them of the words of all rows, with their rows."""
    lists = [batch.column(f"_w{i}") for i in range(columns)]
    sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    flat = [x.flatten() for x in lists]
    fixed = sorted({w for view in views for p in view if isinstance(p, tuple) for w in p})
    coded = pa.concat_arrays([*flat, pa.array(fixed, flat[0].type)]).dictionary_encode()
    codes = np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([len(x) for x in flat]))
    code = dict(zip(fixed, codes[-1]))
    found = []
    for view in views:
        size = sum(len(p) if isinstance(p, tuple) else sizes[p] for p in view) + np.zeros(batch.num_rows, np.int64)
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        for p in view:
            if isinstance(p, tuple):
                for w in p:
                    out[at] = code[w]
                    at = at + 1
            else:
                n = sizes[p]
                out[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(codes[p]))] = codes[p]
                at = at + n
        found.append((out, np.repeat(np.arange(batch.num_rows), size)))
    return coded.dictionary, found


def _summed(keys: np.ndarray, *numbers: np.ndarray) -> list[np.ndarray]:
    """Each key once, with the sums of its numbers."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return [keys[first], *[np.add.reduceat(x[order], first) if len(first) else x for x in numbers]]


def _per_row(rows: np.ndarray, keys: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key below ``many`` and number of each (row, key) that occurs, in this order."""
    if many > 1 << 48:  # row and key do not fit one number
        known, keys = np.unique(keys, return_inverse=True)
        row, key, n = _per_row(rows, keys, len(known) + 1)
        return row, known[key], n
    both, n = np.unique(rows * many + keys, return_counts=True)
    return both // many, both % many, n


def _row_pairs(ids: np.ndarray, rows: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys ``first * many + second`` of neighbours of the same row; a word left out has an id below 0."""
    met = np.flatnonzero((rows[1:] == rows[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0))
    return rows[met], ids[met] * many + ids[met + 1]


def _ids(words: pa.Array, kept: pa.Array) -> np.ndarray:
    """The places of ``words`` in ``kept``, -1 where they are not in it."""
    return pc.fill_null(pc.index_in(words, value_set=kept.cast(words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _vocabularies(df: DataFrame, texts: TextViews, min_df: float, max_df: float, most: int) -> list[list[str]]:
    """Per view the ``most`` frequent terms (ties: by name) of at least ``min_df`` and at most ``max_df`` rows, shares if below 1.

    Words are counted first.  A pair occurs at most as often, and in as many rows, as either of its words, so only pairs
    of words that occur as often as the last of the ``most`` words are counted then, as numbers.  No term of a text leaves
    a task twice.
    """
    rows = df.count() if min_df < 1.0 or max_df < 1.0 else 0
    floor = min_df if min_df >= 1.0 else min_df * rows
    ceiling = float(2 ** 63) if max_df >= 1.0 else max_df * rows
    columns, views = len(texts.columns), texts.views  # tasks get plain values

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _word_parts(batches, columns):
            known, coded = _coded(part, columns, views)
            for i, (codes, at) in enumerate(coded):
                n = np.bincount(codes, minlength=len(known))
                met = np.bincount(_per_row(at, codes, len(known) + 1)[1], minlength=len(known))
                code = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), i, np.int32)), known.take(pa.array(code)), pa.array(n[code]),
                     pa.array(met[code])], ["view", "term", "n", "df"])

    cut = texts.cut(df, [])
    sums = [F.sum("n").alias("n"), F.sum("df").alias("df")]
    counts = materialize(cut.mapInArrow(words, "view int, term string, n long, df long")
                         .groupBy("view", "term").agg(*sums).filter(F.col("df") >= floor), "word-counts")
    single, kept, least = [], [], []
    for i in range(len(views)):
        of = counts.filter(F.col("view") == i)
        top = of.filter(F.col("df") <= ceiling).orderBy(F.desc("n"), "term").limit(most).collect()
        least.append(top[-1]["n"] if len(top) == most else max(1, math.ceil(floor)))
        single.append([(-r["n"], r["term"]) for r in top])
        kept.append(pa.array(sorted(r["term"] for r in of.filter(F.col("n") >= least[i]).select("term").collect()), pa.string()))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[] for _ in views]

        def handed(i):
            keys, n, met = _summed(*map(np.concatenate, zip(*held[i])))
            held[i] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), *map(pa.array, (keys, n, met))],
                                              ["view", "pair", "n", "df"])

        for part in _word_parts(batches, columns):
            known, coded = _coded(part, columns, views)
            for i, (codes, at) in enumerate(coded):
                many = max(1, len(kept[i]))
                at, keys = _row_pairs(_ids(known, kept[i])[codes], at, many)
                _, keys, n = _per_row(at, keys, many * many)
                held[i].append((keys, n, np.ones(len(n), np.int64)))
                if sum(len(x) for x, _, _ in held[i]) > HELD_PAIRS:
                    yield handed(i)
        for i in range(len(views)):
            if held[i]:
                yield handed(i)

    often = F.element_at(F.array(*map(F.lit, least)), F.col("view") + 1)
    met = materialize(cut.mapInArrow(pairs, "view int, pair long, n long, df long").groupBy("view", "pair").agg(*sums)
                      .filter(F.col("df").between(floor, ceiling) & (F.col("n") >= often)), "pair-counts")
    found = []
    for i in range(len(views)):
        # a blank sorts before every character of a word, so pairs of places in sorted words sort as their terms do
        top = met.filter(F.col("view") == i).orderBy(F.desc("n"), "pair").limit(most).collect()
        names, many = kept[i].to_pylist(), len(kept[i])
        double = [(-r["n"], f"{names[r['pair'] // many]} {names[r['pair'] % many]}") for r in top]
        found.append([t for _, t in sorted([*single[i], *double])[:most]])
        if not found[-1]:
            raise ValueError(f"no term lies in {floor} to {ceiling} rows")
    return found


SPARSE = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"  # as VectorUDT is stored


def _stored_counts(df: DataFrame, texts: TextViews, vocabularies: list[list[str]], sublinear: bool,
                   keep: list[str]) -> DataFrame:
    """``keep`` and per view a vector ``_tf<i>`` of the (sublinear) counts of its terms, written once."""
    columns, views, looked_up = len(texts.columns), texts.views, []
    for vocabulary in vocabularies:
        split = [t.split(" ") for t in vocabulary]
        names = sorted({w for t in split for w in t})
        at = {w: i for i, w in enumerate(names)}
        alone = np.full(len(names), -1, np.int64)
        alone[[at[t[0]] for t in split if len(t) == 1]] = [i for i, t in enumerate(split) if len(t) == 1]
        both = sorted((at[t[0]] * len(names) + at[t[1]], i) for i, t in enumerate(split) if len(t) == 2)
        keys, places = np.array(both, np.int64).reshape(-1, 2).T
        looked_up.append((pa.array(names, pa.string()), alone, keys, places, len(vocabulary)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _word_parts(batches, columns):
            known, coded = _coded(part, columns, views)
            out = [part.column(c) for c in keep]
            for (codes, rows), (names, alone, keys, places, size) in zip(coded, looked_up):
                ids = _ids(known, names)[codes]
                at, pair = _row_pairs(ids, rows, len(names))
                spot = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
                hit = keys[spot] == pair if len(keys) else np.zeros(len(pair), bool)
                one = np.where(ids >= 0, alone[ids], -1)
                row, index, n = _per_row(np.concatenate([rows[one >= 0], at[hit]]),
                                         np.concatenate([one[one >= 0], places[spot[hit]] if len(keys) else spot[hit]]), size)
                ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                values = 1.0 + np.log(n) if sublinear else n.astype(float)
                out.append(pa.StructArray.from_arrays(
                    [pa.array(np.zeros(part.num_rows, np.int8)), pa.array(np.full(part.num_rows, size, np.int32)),
                     pa.ListArray.from_arrays(ends, pa.array(index.astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(values))], ["type", "size", "indices", "values"]))
            yield pa.RecordBatch.from_arrays(out, [*keep, *[f"_tf{i}" for i in range(len(coded))]])

    cut = texts.cut(df, keep)
    kinds = [f"`{c}` {t}" for c, t in cut.dtypes if c in keep]
    plain = cut.mapInArrow(count, ", ".join([*kinds, *[f"_tf{i} {SPARSE}" for i in range(len(vocabularies))]]))
    path = scratch_path(df.sparkSession, "term-counts")
    plain.write.parquet(path)
    # the same files, their structs read as vectors
    schema = T.StructType([f if f.name in keep else T.StructField(f.name, VectorUDT()) for f in plain.schema])
    return df.sparkSession.read.schema(schema).parquet(path)


def fit_text_views(df: DataFrame, texts: TextViews, keep: list[str], min_df: float = 2, max_df: float = 0.98,
                   vocabulary: int = 60_000, sublinear: bool = True) -> tuple[list[TextFeatures], list[list[str]]]:
    """Features of several texts of the same rows, whose columns are cut together; and their vocabularies."""
    vocabularies = _vocabularies(df, texts, min_df, max_df, vocabulary)
    stored = _stored_counts(df, texts, vocabularies, sublinear, keep)
    fitted = []
    for i, terms_ in enumerate(vocabularies):
        counter = CountVectorizerModel.from_vocabulary(terms_, inputCol="_grams", outputCol="_tf")
        trained = stored.select(*keep, F.col(f"_tf{i}").alias("_tf"))
        idf = IDF(inputCol="_tf", outputCol="_idf").fit(trained)
        scaling = ElementwiseProduct(scalingVec=DenseVector(idf.idf.toArray() + 1.0),
                                     inputCol="_tf", outputCol="_weighted")
        fitted.append(TextFeatures(counter, scaling, counter.vocabulary, sublinear, "text", trained))
    return fitted, vocabularies


def fit_text_features(df: DataFrame, text: str = "text", min_df: float = 2, max_df: float = 0.98,
                      vocabulary: int = 60_000, sublinear: bool = True) -> TextFeatures:
    """Vocabulary and inverse document frequencies from the training rows only.

    ``max_df`` is a share of the documents; 1.0 keeps every term.
    """
    texts = TextViews([text], [[0]])
    (fitted,), _ = fit_text_views(df, texts, [c for c in df.columns if c != text], min_df, max_df, vocabulary, sublinear)
    fitted.text = text
    return fitted


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n / (classes * class count): balanced weights from one aggregation.

    The counts come as one value, so no row moves to others of its class.  Rows without a label are left out.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("_c"))
    known = F.when(F.col(label).isNotNull(), F.struct(label, "_c"))
    total = counts.agg(F.struct(F.sum("_c").alias("n"), F.count("*").alias("k"), F.map_from_entries(
        F.collect_list(known)).alias("of")).alias("_t"))
    weight = F.col("_t.n") / (F.col("_t.k") * F.element_at("_t.of", F.col(label)))
    return (df.filter(F.col(label).isNotNull()).withColumn("_t", total.scalar())
            .withColumn("weight", weight).drop("_t"))


def fit_logistic(train: DataFrame, c: float, rows: int, label: str = "label",
                 max_iter: int = 100, tol: float = 1e-4) -> LogisticRegressionModel:
    """L2 logistic regression; inverse strength ``c`` becomes 1 / (c * rows)."""
    return LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight",
                              regParam=1.0 / (c * rows), elasticNetParam=0.0,
                              standardization=False, maxIter=max_iter, tol=tol).fit(train)


def gradient_norm(model: LogisticRegressionModel, ready: DataFrame, c: float, label: str = "label") -> float:
    """Length of the gradient of the stated loss at the model's weights: near 0 for the minimum, and only there.

    The loss is convex, so this certifies a fit whatever found it.  ``ready`` has label, weight and features
    of the training rows; every task sums its residuals into one vector.
    """
    residual = F.col("weight") * (F.element_at(vector_to_array("probability"), 2) - F.col(label))
    rows = model.transform(ready.select(label, "weight", "features")).select("features", "weight", residual.alias("_r"))
    # the summarizer takes no negative weights: positive and negative residuals apart
    total = lambda weight: Summarizer.metrics("sum").summary(F.col("features"), weight)
    summary = rows.select(
        total(F.greatest("_r", F.lit(0.0))).alias("up"), total(F.greatest(-F.col("_r"), F.lit(0.0))).alias("down"),
        F.sum("weight").alias("total"), F.sum("_r").alias("bias"), F.count("*").alias("n")).first()
    slope = (summary["up"]["sum"].toArray() - summary["down"]["sum"].toArray()) / summary["total"]
    slope = slope + model.coefficients.toArray() / (c * summary["n"])
    return float(np.sqrt((slope ** 2).sum() + (summary["bias"] / summary["total"]) ** 2))


@dataclass
class FittedClassifier:
    features: TextFeatures
    model: LogisticRegressionModel
    best_c: float
    candidates: list[tuple[float, float]]


def classifier_predictions(model: LogisticRegressionModel, featured: DataFrame,
                           label: str = "label", keep: list[str] = ("record_id",)) -> DataFrame:
    """Label, both probabilities and the margin."""
    scored = model.transform(featured).withColumn("_p", vector_to_array("probability"))
    return scored.select(
        *keep, F.col(label).cast("int").alias("is_hallucinated"),
        F.col("prediction").cast("int").alias("predicted_label"),
        F.element_at("_p", 1).alias("probability_supported"),
        F.element_at("_p", 2).alias("hallucination_probability")).withColumn(
        "confidence_margin",
        F.abs(F.col("hallucination_probability") - F.col("probability_supported")))


def tfidf_lr_classifier(train: DataFrame, validation: DataFrame, text: str = "text",
                        label: str = "label", candidates=CANDIDATE_C, **features) -> FittedClassifier:
    """Choose C by validation macro-F1 (first best wins); test data is untouched."""
    fitted = fit_text_features(train.select(text, label), text, **features)
    ready = class_weights(fitted.weigh(fitted.trained), label).select(label, "weight", "features")
    check = fitted.weigh(materialize(fitted.counted(validation.select(text, label)).select(label, "_tf"), "check"))
    rows = ready.count()
    best, scores = None, []
    for c in candidates:
        model = fit_logistic(ready, c, rows, label)
        predicted = classifier_predictions(model, check, label, keep=[])
        macro = multiclass_summary(predicted, [0, 1], label="is_hallucinated").first()["macro_f1"]
        scores.append((c, float(macro)))
        if best is None or macro > best[0]:
            best = (macro, c, model)
    return FittedClassifier(fitted, best[2], best[1], scores)


def top_features(classifier: FittedClassifier, spark, n: int = 50) -> DataFrame:
    """``n`` strongest terms per direction (the model itself is vocabulary-bounded)."""
    weights = zip(classifier.features.vocabulary, classifier.model.coefficients.toArray().tolist())
    table = spark.createDataFrame(list(weights), "feature string, coefficient double")
    top = table.orderBy(F.desc("coefficient"), "feature").limit(n).withColumn(
        "direction", F.lit("hallucinated"))
    bottom = table.orderBy("coefficient", "feature").limit(n).withColumn(
        "direction", F.lit("grounded"))
    return top.unionByName(bottom)


def embedding_lr_classifier(train: DataFrame, vector: str = "embedding", label: str = "label",
                            c: float = 1.0, tol: float = 1e-4) -> LogisticRegressionModel:
    ready = class_weights(vector_features(train, vector), label).select(label, "weight", "features")
    rows = train.count()
    return fit_logistic(ready, c, rows, label, tol=tol)


def vector_features(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


FEATURE_SETS = {
    "full_question_knowledge_answer": terms.FEATURE_TEXT,
    "answer_only": "{answer}",
    "question_knowledge_only": "Question: {question}\nKnowledge: {knowledge}",
}


def ablation_metrics(train: DataFrame, test: DataFrame, label: str = "label",
                     feature_sets=None, c: float = 1.0, **features) -> DataFrame:
    """The same classifier on three views of the text: does the answer alone give it away?

    The columns of the views are cut into words once for all of them.
    """
    sets = feature_sets or FEATURE_SETS
    texts = template_views(list(sets.values()))
    if texts is None:  # words may join where a slot ends: the filled texts are cut instead
        slots = lambda template: {s: F.col(s) for s in re.findall(r"\{(\w+)\}", template)}
        fill = lambda df: df.select(label, *[tx.fill_template(t, **slots(t)).alias(f"_t{i}")
                                             for i, t in enumerate(sets.values())])
        train, test = fill(train), fill(test)
        texts = TextViews([f"_t{i}" for i in range(len(sets))], [[i] for i in range(len(sets))])
    fitted, vocabularies = fit_text_views(train, texts, [label], **features)
    check = _stored_counts(test, texts, vocabularies, fitted[0].sublinear, [label])
    out = None
    for i, (name, found) in enumerate(zip(sets, fitted)):
        ready = class_weights(found.weigh(found.trained), label).select(label, "weight", "features")
        model = fit_logistic(ready, c, found.trained.count(), label)
        featured = found.weigh(check.select(label, F.col(f"_tf{i}").alias("_tf")))
        row = binary_metrics(classifier_predictions(model, featured, label, keep=[])).withColumn("feature_set", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
