"""Threshold and agreement queries."""

from pyspark.sql import functions as F

from assayer.operators import calibration as cb
from assayer.operators.splits import hash_percent
from assayer.plans import views as v
from assayer.plans.q_grounding import reference_similarity
from assayer.plans.registry import SQL_VIEWS, query

# threshold by the definition: try every candidate margin
SQL_VIEWS["safe_validation"] = "SELECT * FROM scored3_safe WHERE l_orderkey % 2 = 0"
SQL_VIEWS["calibrated"] = """
SELECT min(confidence_margin) AS threshold FROM safe_validation
WHERE predicted_label = 'yes' AND confidence_margin > (
  SELECT coalesce(max(confidence_margin), -1e300) FROM safe_validation WHERE predicted_label = 'yes' AND true_label = 'no')"""


def _validation(df):
    return df.filter(F.col("l_orderkey") % 2 == 0)


@query("calibrate_threshold", """
SELECT 'safe' AS source, threshold FROM calibrated
UNION ALL
SELECT 'plain', min(confidence_margin) FROM scored3 WHERE predicted_label = 'yes' AND confidence_margin > (
  SELECT max(confidence_margin) FROM scored3 WHERE predicted_label = 'yes' AND true_label = 'no')""",
       doubles="threshold")
def _(spark, sf_dir):
    safe = cb.calibrate_threshold(_validation(v.scored3_safe(spark, sf_dir)))
    plain = cb.calibrate_threshold(v.scored3(spark, sf_dir))
    return safe.withColumn("source", F.lit("safe")).unionByName(plain.withColumn("source", F.lit("plain")))


@query("confidence_gate", """
SELECT split, count(*) AS rows, count(*) FILTER (WHERE accepted) AS accepted_rows,
       count(*) FILTER (WHERE NOT accepted) AS human_review_rows,
       count(*) FILTER (WHERE accepted AND true_label = 'no') AS unsafe_false_accepts,
       count(*) FILTER (WHERE accepted) / count(*) AS automated_coverage,
       count(*) FILTER (WHERE accepted AND true_label = predicted_label) / nullif(count(*) FILTER (WHERE accepted), 0) AS accepted_accuracy
FROM (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN 'validation' ELSE 'test' END AS split,
        coalesce(predicted_label = 'yes' AND confidence_margin >= (SELECT threshold FROM calibrated), false) AS accepted
      FROM scored3_safe) GROUP BY split""", doubles="automated_coverage accepted_accuracy")
def _(spark, sf_dir):
    rows = v.scored3_safe(spark, sf_dir).withColumn("split", F.when(
        F.col("l_orderkey") % 2 == 0, "validation").otherwise("test"))
    threshold = cb.calibrate_threshold(_validation(rows))
    return cb.gate_summary(cb.apply_gate(rows, threshold.scalar()), ["split"])


# two yes/no models over the documents: probability 1 - p(hallucinated) as confidence in "yes"
for _name, _source in (("model_a", "predictions"), ("model_b", "predictions_b")):
    SQL_VIEWS[_name] = f"""
SELECT record_id, doc_id, CASE WHEN is_hallucinated = 1 AND hallucination_probability > 0.2 THEN 'no' ELSE 'yes' END AS true_label,
       CASE predicted_label WHEN 1 THEN 'no' ELSE 'yes' END AS predicted_label,
       abs(1 - 2 * hallucination_probability) AS confidence_margin FROM {_source}"""


def _model(df, truth=None):
    unsafe = (F.col("is_hallucinated") == 1) & (F.col("hallucination_probability") > 0.2)
    return df.select(
        "record_id", "doc_id", F.when(unsafe, "no").otherwise("yes").alias("true_label"),
        F.when(F.col("predicted_label") == 1, "no").otherwise("yes").alias("predicted_label"),
        F.abs(1 - 2 * F.col("hallucination_probability")).alias("confidence_margin"))


def _models(spark, sf_dir):
    return _model(v.predictions(spark, sf_dir)), _model(v.predictions_b(spark, sf_dir))


@query("align_predictions", """
SELECT count(*) FILTER (WHERE a.record_id IS NOT NULL AND b.record_id IS NOT NULL) AS matched_keys,
       CAST(0 AS BIGINT) AS duplicated_keys, count(*) FILTER (WHERE b.record_id IS NULL) AS unmatched_a,
       count(*) FILTER (WHERE a.record_id IS NULL) AS unmatched_b,
       count(*) FILTER (WHERE a.true_label <> b.true_label) AS label_mismatches,
       count(*) FILTER (WHERE a.true_label <> b.true_label OR a.record_id IS NULL OR b.record_id IS NULL) = 0 AS passed
FROM (SELECT record_id, true_label FROM model_a
      UNION ALL SELECT 'a-' || record_id, true_label FROM model_a WHERE doc_id % 31 = 0) a
FULL JOIN (SELECT record_id, true_label FROM model_b
           UNION ALL SELECT 'b-' || record_id, true_label FROM model_b WHERE doc_id % 29 = 0) b ON a.record_id = b.record_id""")
def _(spark, sf_dir):
    a, b = _models(spark, sf_dir)
    # all rows of both, and some more that only one model has
    alone = lambda df, name, k: df.unionByName(df.filter(F.col("doc_id") % k == 0).withColumn(
        "record_id", F.concat(F.lit(f"{name}-"), "record_id")))
    return cb.alignment_checks(alone(a, "a", 31), alone(b, "b", 29))


SQL_VIEWS["aligned"] = """
SELECT a.record_id, a.doc_id % 2 AS half, a.true_label, a.predicted_label AS pa, b.predicted_label AS pb,
       a.confidence_margin AS margin FROM model_a a JOIN model_b b USING (record_id)"""
SQL_VIEWS["aligned_threshold"] = """
SELECT min(margin) AS t FROM aligned WHERE half = 0 AND pa = 'yes' AND pb = 'yes' AND margin > (
  SELECT coalesce(max(margin), -1e300) FROM aligned WHERE half = 0 AND pa = 'yes' AND pb = 'yes' AND true_label = 'no')"""


@query("agreement_gate", """
SELECT half, count(*) AS rows, count(*) FILTER (WHERE accepted) AS accepted_rows,
       count(*) FILTER (WHERE NOT accepted) AS human_review_rows,
       count(*) FILTER (WHERE accepted AND true_label = 'no') AS unsafe_false_accepts,
       count(*) FILTER (WHERE accepted) / count(*) AS automated_coverage,
       count(*) FILTER (WHERE accepted AND true_label = 'yes') / nullif(count(*) FILTER (WHERE accepted), 0) AS accepted_accuracy,
       count(*) FILTER (WHERE pa = pb) AS model_agreement_rows, count(*) FILTER (WHERE pa = pb) / count(*) AS model_agreement_rate
FROM (SELECT *, coalesce(pa = 'yes' AND pb = 'yes' AND margin >= (SELECT t FROM aligned_threshold), false) AS accepted FROM aligned)
GROUP BY half""", doubles="automated_coverage accepted_accuracy model_agreement_rate")
def _(spark, sf_dir):
    a, b = _models(spark, sf_dir)
    aligned = cb.align_predictions(a, b).withColumn(
        "half", F.col("record_id").cast("bigint") % 2)
    threshold = cb.agreement_threshold(aligned.filter(F.col("half") == 0))
    return cb.agreement_summary(cb.agreement_gate(aligned, threshold.scalar()), ["half"])


THRESHOLDS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]


def sql_rates(counts: str, keys: str = "") -> str:
    """Rates over a select with tp, tn, fp, fn columns."""
    return f"""
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1_score
FROM (SELECT *, coalesce((true_positives + true_negatives)
        / nullif(true_positives + true_negatives + false_positives + false_negatives, 0), 0.0) AS accuracy,
    coalesce(true_positives / nullif(true_positives + false_positives, 0), 0.0) AS precision,
    coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0.0) AS recall FROM ({counts}))"""


def sql_counts(truth: str = "is_hallucinated", positive: str = "predicted_label = 1") -> str:
    return f"""count(*) FILTER (WHERE {truth} = 1 AND {positive}) AS true_positives,
       count(*) FILTER (WHERE {truth} = 0 AND NOT ({positive})) AS true_negatives,
       count(*) FILTER (WHERE {truth} = 0 AND {positive}) AS false_positives,
       count(*) FILTER (WHERE {truth} = 1 AND NOT ({positive})) AS false_negatives"""


@query("threshold_sweep", sql_rates(
    f"SELECT threshold, {sql_counts(positive='hallucination_probability >= threshold')} "
    f"FROM predictions, (SELECT unnest(CAST({THRESHOLDS} AS DOUBLE[])) AS threshold) GROUP BY threshold"),
    doubles="accuracy precision recall f1_score")
def _(spark, sf_dir):
    return cb.threshold_sweep(v.predictions(spark, sf_dir), THRESHOLDS)


SQL_VIEWS["ref_split"] = f"""
SELECT *, round(similarity, 9) AS s, CASE WHEN {v.sql_bits("CAST(group_id AS VARCHAR)")} % 100 < 20 THEN 'test' ELSE 'train' END AS split
FROM ref_similar"""
SQL_VIEWS["ref_sweep"] = sql_rates(
    f"SELECT threshold, {sql_counts(positive='s < threshold')} FROM ref_split, "
    "(SELECT i / 100.0::DOUBLE AS threshold FROM range(-10, 96) t(i)) WHERE split = 'train' GROUP BY threshold")
SQL_VIEWS["ref_choice"] = """
SELECT threshold AS t FROM ref_sweep ORDER BY f1_score DESC, accuracy DESC, threshold LIMIT 1"""


@query("threshold_select_train_test", sql_rates(
    f"SELECT (SELECT t FROM ref_choice) AS threshold_selected_on_train, count(*) AS test_rows, "
    f"(SELECT count(*) FROM ref_split WHERE split = 'train') AS train_rows, "
    f"{sql_counts(positive='s < (SELECT t FROM ref_choice)')} FROM ref_split WHERE split = 'test'"),
    doubles="threshold_selected_on_train accuracy precision recall f1_score")
def _(spark, sf_dir):
    rows = reference_similarity(spark, sf_dir).select(
        "group_id", "is_hallucinated", F.round("semantic_similarity", 9).alias("s"))
    test = hash_percent("group_id") < 20
    return cb.threshold_select_train_test(
        rows.filter(~test), rows.filter(test), [i / 100.0 for i in range(-10, 96)], "s")
