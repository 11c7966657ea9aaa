"""MLlib classifiers trained on the labelled documents.

A model's figures have no SQL form; the queries return what SQL can decide about them.
"""

from pyspark.sql import functions as F

from assayer.operators import classify as cl
from assayer.operators.metrics import binary_metrics
from assayer.operators.splits import hash_percent
from assayer.plans import views as v
from assayer.plans.registry import SQL_VIEWS, query
from assayer.session import materialize

OPTIMAL = 0.1  # the gradient at the fit is at most this part of that at weights of 0
RATES = ["accuracy", "precision", "recall", "f1_score"]
SQL_VIEWS["slotted"] = """
SELECT record_id, is_hallucinated, CAST('0x' || substr(md5(record_id), 1, 8) AS BIGINT) % 100 AS slot FROM answers"""


def _rows(spark, sf_dir):
    return v.answers(spark, sf_dir, evidence=True).select(
        "record_id", "question", "knowledge", "answer", F.col("answer").alias("text"),
        F.col("is_hallucinated").cast("double").alias("label"),
        hash_percent("record_id").alias("_slot"))


def _parts(rows):
    slot = F.col("_slot")
    return rows.filter(slot < 60), rows.filter((slot >= 60) & (slot < 80)), rows.filter(slot >= 80)


def _fit(spark, sf_dir):
    # every pass reads the stored rows: the joins behind them run once
    rows = materialize(_rows(spark, sf_dir).select("record_id", "text", "label", "_slot"), "texts")
    train, validation, test = _parts(rows)
    return cl.tfidf_lr_classifier(train, validation), validation, test


def _checked(metrics, *keep):
    """Row and label counts, and whether all rates lie in [0, 1]."""
    inside = [F.col(c).between(0.0, 1.0) for c in RATES]
    sound = inside[0] & inside[1] & inside[2] & inside[3]
    return metrics.select(*keep, "rows", (F.col("true_positives") + F.col("false_negatives")).alias("positives"),
                          sound.alias("rates_in_range"))


@query("tfidf_lr_classifier", """
SELECT count(*) AS rows, count(*) FILTER (WHERE is_hallucinated = 1) AS positives, true AS rates_in_range,
       true AS candidate_selected, true AS optimal FROM slotted WHERE slot >= 80""")
def _(spark, sf_dir):
    fitted, _, test = _fit(spark, sf_dir)
    predicted = cl.classifier_predictions(fitted.model, fitted.features.transform(test))
    best = max(fitted.candidates, key=lambda found: found[1])  # the first of equals
    text = fitted.features
    ready = cl.class_weights(text.weigh(text.trained)).select("label", "weight", "features")
    start = cl.fit_logistic(ready, fitted.best_c, ready.count(), max_iter=0)
    slope, steepest = (cl.gradient_norm(m, ready, fitted.best_c) for m in (fitted.model, start))
    return _checked(binary_metrics(predicted)).withColumns({
        "candidate_selected": F.lit(fitted.best_c in cl.CANDIDATE_C and fitted.best_c == best[0]),
        "optimal": F.lit(slope <= OPTIMAL * steepest)})


@query("classifier_predictions", """
SELECT record_id, is_hallucinated, CASE WHEN slot < 80 THEN 'validation' ELSE 'test' END AS split,
       true AS probabilities_sum_to_one, true AS prediction_follows, true AS margin_is_gap
FROM slotted WHERE slot >= 60""")
def _(spark, sf_dir):
    fitted, validation, test = _fit(spark, sf_dir)
    part = lambda df, name: cl.classifier_predictions(
        fitted.model, fitted.features.transform(df)).withColumn("split", F.lit(name))
    p, q = F.col("hallucination_probability"), F.col("probability_supported")
    return part(validation, "validation").unionByName(part(test, "test")).select(
        "record_id", "is_hallucinated", "split",
        (p.between(0.0, 1.0) & q.between(0.0, 1.0) & (F.abs(p + q - 1) < 1e-9)).alias("probabilities_sum_to_one"),
        ((p >= 0.5) == (F.col("predicted_label") == 1)).alias("prediction_follows"),
        (F.abs(F.col("confidence_margin") - F.abs(p - q)) < 1e-9).alias("margin_is_gap"))


@query("top_features", """
SELECT direction, 50 AS features, true AS right_order FROM (VALUES ('hallucinated'), ('grounded')) t(direction)""")
def _(spark, sf_dir):
    fitted, _, _ = _fit(spark, sf_dir)
    top = cl.top_features(fitted, spark)
    weights = fitted.model.coefficients.toArray()
    edge = F.when(F.col("direction") == "hallucinated", F.max("coefficient") == float(weights.max())).otherwise(
        F.min("coefficient") == float(weights.min()))
    return top.groupBy("direction").agg(
        F.count_distinct("feature").cast("int").alias("features"), edge.alias("right_order"))


# the same loss minimised in SQL by accelerated gradient steps: one row per weight, the last one is the intercept
EMBEDDING_STEPS = 250
SQL_VIEWS["lr_rows"] = """
SELECT vec_id AS i, CAST(label >= 5 AS DOUBLE) AS label, list_append(CAST(embedding AS DOUBLE[]), 1.0) AS x,
       CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80 AS train FROM embeddings"""
SQL_VIEWS["lr_cells"] = """
SELECT i, label, 1 / (2.0::DOUBLE * of_class) AS share, 1.0::DOUBLE / n AS ridge, generate_subscripts(x, 1) AS d, unnest(x) AS v
FROM (SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY label) AS of_class FROM lr_rows WHERE train)"""
_LR_SQL = f"""
WITH RECURSIVE fitted(step, d, w, y) AS (
  SELECT 0, d, 0.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT d FROM lr_cells)
  UNION ALL
  SELECT f.step + 1, f.d, f.y - 1.9 * (g.g + g.ridge * f.y), 1.84 * (f.y - 1.9 * (g.g + g.ridge * f.y)) - 0.84 * f.w
  FROM fitted f JOIN (
    SELECT c.d, sum(r.r * c.v) AS g, CASE WHEN c.d <= 64 THEN max(c.ridge) ELSE 0 END AS ridge
    FROM lr_cells c JOIN (
      SELECT c.i, max(c.share) * (1 / (1 + exp(-sum(c.v * f.y))) - max(c.label)) AS r
      FROM lr_cells c JOIN fitted f USING (d) GROUP BY c.i) r USING (i) GROUP BY c.d) g USING (d)
  WHERE f.step < {EMBEDDING_STEPS}),
scored AS (
  SELECT label, 1 / (1 + exp(-list_dot_product(x, (SELECT list(w ORDER BY d) FROM fitted WHERE step = {EMBEDDING_STEPS})))) AS p
  FROM lr_rows WHERE NOT train)
SELECT count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives, avg(CAST((p >= 0.5) = (label = 1) AS INT)) AS accuracy,
       round(avg(p), 5) AS mean_probability, round(avg(p * p), 5) AS mean_square FROM scored"""


@query("embedding_lr_classifier", _LR_SQL, doubles="accuracy")
def _(spark, sf_dir):
    rows = v.vectors(spark, sf_dir).select(
        F.col("vec_id").cast("string").alias("record_id"), "embedding",
        (F.col("label") >= 5).cast("double").alias("label"), hash_percent("vec_id").alias("_slot"))
    train, test = rows.filter(F.col("_slot") < 80), rows.filter(F.col("_slot") >= 80)
    model = cl.embedding_lr_classifier(train, tol=1e-9)
    p = F.col("hallucination_probability")
    return cl.classifier_predictions(model, cl.vector_features(test)).agg(
        F.count("*").alias("rows"), F.count_if(F.col("is_hallucinated") == 1).alias("positives"),
        F.avg((F.col("predicted_label") == F.col("is_hallucinated")).cast("int")).alias("accuracy"),
        F.round(F.avg(p), 5).alias("mean_probability"), F.round(F.avg(p * p), 5).alias("mean_square"))


@query("ablation_metrics", """
SELECT feature_set, count(*) AS rows, count(*) FILTER (WHERE is_hallucinated = 1) AS positives,
       true AS rates_in_range
FROM slotted, (VALUES ('full_question_knowledge_answer'), ('answer_only'), ('question_knowledge_only')) f(feature_set)
WHERE slot >= 80 GROUP BY feature_set""")
def _(spark, sf_dir):
    rows = materialize(_rows(spark, sf_dir).drop("text"), "texts")
    return _checked(cl.ablation_metrics(rows.filter(F.col("_slot") < 80), rows.filter(F.col("_slot") >= 80)),
                    "feature_set")
