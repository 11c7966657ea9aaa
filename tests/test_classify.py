import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import classify as cl, metrics as mt


@pytest.fixture(scope="module")
def texts(spark):
    """The answer gives the label away; question and knowledge do not."""
    return spark.range(240).select(
        F.col("id").cast("string").alias("record_id"), (F.col("id") % 2).cast("double").alias("label"),
        F.concat(F.lit("question number "), F.col("id") % 7).alias("question"),
        F.lit("shared knowledge text").alias("knowledge"),
        F.when(F.col("id") % 2 == 1, "absurd strange claim éclair").otherwise("safe plain reply").alias("answer"),
        (F.col("id") % 10).alias("slot")).withColumn("text", F.col("answer"))


def test_classifier_learns_and_reports(texts, spark):
    train, check, test = (texts.filter(c) for c in ("slot < 6", "slot in (6, 7)", "slot > 7"))
    fitted = cl.tfidf_lr_classifier(train, check, candidates=(0.3, 1.0))
    predicted = cl.classifier_predictions(fitted.model, fitted.features.transform(test))
    assert mt.binary_metrics(predicted).first()["accuracy"] == 1.0
    row = predicted.first()
    assert row["probability_supported"] + row["hallucination_probability"] == pytest.approx(1.0)
    assert fitted.best_c == 0.3                      # equal macro-F1: the first candidate stays
    top = cl.top_features(fitted, spark, n=3).collect()
    assert {r["feature"] for r in top if r["direction"] == "hallucinated"} <= {
        "absurd", "strange", "claim", "eclair", "absurd strange", "strange claim", "claim eclair"}


def test_features_are_unit_length_and_sublinear(texts):
    fitted = cl.fit_text_features(texts, max_df=1.0)
    v = fitted.transform(texts).first()["features"]
    assert sum(x * x for x in v.values) == pytest.approx(1.0)


def test_ablation_shows_the_shortcut(texts):
    rows = {r["feature_set"]: r["accuracy"] for r in cl.ablation_metrics(
        texts.filter("slot < 8"), texts.filter("slot >= 8"), max_df=1.0).collect()}
    assert rows["answer_only"] == 1.0 and rows["question_knowledge_only"] < 0.8


def test_class_weights_are_balanced(spark):
    df = spark.createDataFrame([(0.0,)] * 3 + [(1.0,)], "label double")
    got = {r["label"]: r["w"] for r in cl.class_weights(df).groupBy("label").agg(F.max("weight").alias("w")).collect()}
    assert got == {0.0: pytest.approx(4 / 6), 1.0: pytest.approx(2.0)}


def test_class_weights_move_no_row(spark):
    """Rows of a class never meet in one task; rows without a label are left out, but counted."""
    df = spark.createDataFrame([(0.0,)] * 3 + [(1.0,), (None,)], "label double")
    got = cl.class_weights(df)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted({(r["label"], round(r["weight"], 9)) for r in got.collect()}) == [(0.0, round(5 / 9, 9)), (1.0, round(5 / 3, 9))]


def test_vocabulary_by_definition_without_held_texts(spark, monkeypatch):
    """Limits as shares and as numbers of rows; the texts are cut once for the words and once for the counts."""
    lines = ["a1 bb cc", "bb cc cc", "Bb dd", None, "ee ee ee", "bb"]
    df = spark.createDataFrame([(x, float(i % 2)) for i, x in enumerate(lines)], "text string, label double")
    words = [(x or "").lower().split() for x in lines]
    grams = [w + [f"{a} {b}" for a, b in zip(w, w[1:])] for w in words]
    def want(low, high):
        rows = {g: sum(g in d for d in grams) for d in grams for g in d}
        return sorted((g for g in rows if low <= rows[g] <= high), key=lambda g: (-sum(d.count(g) for d in grams), g))
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = held()
    fitted = cl.fit_text_features(df, min_df=2, max_df=0.5)
    assert fitted.vocabulary == want(2, 3) and "bb" not in fitted.vocabulary
    assert cl.fit_text_features(df, min_df=0.3, max_df=1.0).vocabulary == want(1.8, 6)
    assert cl.fit_text_features(df, min_df=1, max_df=1.0, vocabulary=2).vocabulary == want(1, 6)[:2]
    assert fitted.trained.columns == ["label", "_tf"] and held() == before
    monkeypatch.setattr(cl, "_with_grams", None)
    assert fitted.weigh(fitted.trained).count() == len(lines)


def test_accents_and_words_of_any_script(spark):
    df = spark.createDataFrame([("e\u0301clair ni\u00f1o \u03ac\u03bb\u03c6\u03b1 \u0439 \ufb01n",)], "text string")
    assert df.select(cl.strip_accents("text")).first()[0] == "eclair nino \u03b1\u03bb\u03c6\u03b1 \u0438 \ufb01n"
    fitted = cl.fit_text_features(df.unionAll(df), max_df=1.0)
    assert "\u03b1\u03bb\u03c6\u03b1" in fitted.vocabulary and "nino" in fitted.vocabulary


def test_gradient_tells_the_minimum_from_other_weights(spark, texts):
    """Near 0 at the fit; as numpy has it elsewhere; large for another strength and for a model of other rows."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] + 0.5 * rng.normal(size=300) > 0.3).astype(float)
    frame = lambda x, y: cl.vector_features(spark.createDataFrame(
        [(float(b), a.tolist()) for a, b in zip(x, y)], "label double, embedding array<double>"))
    ready = cl.class_weights(frame(x, y)).select("label", "weight", "features")
    model = cl.fit_logistic(ready, 1.0, 300, tol=1e-10)
    assert cl.gradient_norm(model, ready, 1.0) < 1e-6
    loose = cl.fit_logistic(ready, 1.0, 300, max_iter=1)
    weight = np.where(y == 1, 150 / y.sum(), 150 / (300 - y.sum()))
    w, b = loose.coefficients.toArray(), loose.intercept
    residual = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
    plain = np.append(x.T @ residual / weight.sum() + w / 300, residual.sum() / weight.sum())
    assert cl.gradient_norm(loose, ready, 1.0) == pytest.approx(np.linalg.norm(plain), rel=1e-6)
    assert cl.gradient_norm(loose, ready, 1.0) > 1e-2
    assert cl.gradient_norm(model, ready, 0.01) > 1e-2
    other = cl.class_weights(frame(x, 1 - y)).select("label", "weight", "features")
    assert cl.gradient_norm(model, other, 1.0) > 0.1


@pytest.mark.parametrize("part,held", [(1 << 20, 1 << 22), (5, 3)])
def test_views_are_cut_by_column_and_count_as_their_filled_texts(spark, monkeypatch, part, held):
    """Each column is cut once for all views; words, limits, ties and counts are those of the filled texts."""
    rng = np.random.default_rng(1)
    words = ["aa", "b", "Café", "café", "ΑΣ", "dd_1", "ab", "a", "question", "ℂx", "z9"]
    line = lambda: None if rng.random() < 0.1 else " ".join(rng.choice(words, rng.integers(0, 9)))
    df = spark.createDataFrame([(float(i % 2), line(), line(), line()) for i in range(60)],
                               "label double, question string, knowledge string, answer string").repartition(3)
    df = cl.materialize(df, "rows")
    monkeypatch.setattr(cl, "PART_WORDS", part)
    monkeypatch.setattr(cl, "HELD_PAIRS", held)
    cut, grams = [], cl._grams
    monkeypatch.setattr(cl, "_grams", lambda c: (cut.append(c), grams(c))[1])
    sets = list(cl.FEATURE_SETS.values())
    for limits in (dict(min_df=2, max_df=0.5), dict(min_df=0.1, max_df=1.0, vocabulary=25)):
        cut.clear()
        fitted, vocabularies = cl.fit_text_views(df, cl.template_views(sets), ["label"], **limits)
        assert sorted(cut) == sorted(2 * ["question", "knowledge", "answer"])  # once for the terms, once for the counts
        for template, found, vocabulary in zip(sets, fitted, vocabularies):
            slots = {s: F.col(s) for s in ("question", "knowledge", "answer") if f"{{{s}}}" in template}
            filled = df.select("label", cl.tx.fill_template(template, **slots).alias("text"))
            every = [r["g"] for r in cl._with_grams(filled, "text").select(F.col("_grams").alias("g")).collect()]
            rows = {g: sum(g in d for d in every) for d in every for g in d}
            low = limits["min_df"] if limits["min_df"] >= 1 else limits["min_df"] * len(every)
            high = len(every) * limits["max_df"] if limits["max_df"] < 1 else len(every)
            want = sorted((g for g in rows if low <= rows[g] <= high), key=lambda g: (-sum(d.count(g) for d in every), g))
            assert vocabulary == want[:limits.get("vocabulary", 60_000)]
            as_is = lambda d: sorted((r["label"], r["_tf"].size, *map(tuple, (r["_tf"].indices, r["_tf"].values)))
                                     for r in d.select("label", "_tf").collect())
            assert as_is(found.trained) == as_is(found.counted(filled))


def test_views_where_words_could_join_are_cut_filled(texts):
    assert cl.template_views(["{answer}s of", "{answer}"]) is None and cl.template_views(["{question}{answer}"]) is None
    assert cl.template_views(["It is: {answer}\n{question}"]).views == [[("it", "is"), 0, (), 1, ()]]
    rows = cl.ablation_metrics(texts.filter("slot < 8"), texts.filter("slot >= 8"), max_df=1.0,
                               feature_sets={"joined": "{answer}s of {question}"}).collect()
    assert [(r["feature_set"], r["accuracy"]) for r in rows] == [("joined", 1.0)]
