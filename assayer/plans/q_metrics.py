"""Metrics, error analysis and model comparison queries."""

from pyspark.sql import functions as F

from assayer.functions import text as tx
from assayer.operators import grounding as gr, metrics as mt
from assayer.operators.normalize import label_map
from assayer.plans import views as v
from assayer.plans.q_calibration import sql_counts, sql_rates
from assayer.plans.registry import SQL_VIEWS, query

RATES = "accuracy precision recall f1_score"


@query("binary_metrics", sql_rates(f"SELECT count(*) AS rows, {sql_counts()} FROM predictions"),
       doubles=RATES)
def _(spark, sf_dir):
    return mt.binary_metrics(v.predictions(spark, sf_dir))


@query("binary_metrics_rounded", f"""
SELECT dataset_name, rows, true_positives, true_negatives, false_positives, false_negatives,
       round(accuracy, 3) AS accuracy, round(precision, 3) AS precision, round(recall, 3) AS recall,
       round(2 * round(precision, 3) * round(recall, 3) / greatest(round(precision, 3) + round(recall, 3), 1e-9), 3) AS f1_score
FROM ({sql_rates(f"SELECT dataset_name, count(*) AS rows, {sql_counts()} FROM predictions GROUP BY dataset_name")})""")
def _(spark, sf_dir):
    return mt.binary_metrics_rounded(v.predictions(spark, sf_dir), ["dataset_name"])


SQL_VIEWS["parsed_rows"] = """
SELECT dataset_name, is_hallucinated, CASE WHEN doc_id % 7 = 3 OR dataset_name = 'fr' THEN -1 ELSE predicted_label END AS predicted_label
FROM predictions"""


@query("parse_success_metrics", f"""
SELECT dataset_name, rows, parsed_rows, true_positives, true_negatives, false_positives, false_negatives,
       CASE WHEN parsed_rows > 0 THEN accuracy END AS accuracy, CASE WHEN parsed_rows > 0 THEN precision END AS precision,
       CASE WHEN parsed_rows > 0 THEN recall END AS recall, CASE WHEN parsed_rows > 0 THEN f1_score END AS f1_score,
       parsed_rows / rows AS parse_success
FROM ({sql_rates('''SELECT dataset_name, count(*) AS rows, count(*) FILTER (WHERE predicted_label IN (0, 1)) AS parsed_rows,
  count(*) FILTER (WHERE is_hallucinated = 1 AND predicted_label = 1) AS true_positives,
  count(*) FILTER (WHERE is_hallucinated = 0 AND predicted_label = 0) AS true_negatives,
  count(*) FILTER (WHERE is_hallucinated = 0 AND predicted_label = 1) AS false_positives,
  count(*) FILTER (WHERE is_hallucinated = 1 AND predicted_label = 0) AS false_negatives
  FROM parsed_rows GROUP BY dataset_name''')})""", doubles=RATES + " parse_success")
def _(spark, sf_dir):
    p = v.predictions(spark, sf_dir).withColumn("predicted_label", F.when(
        (F.col("doc_id") % 7 == 3) | (F.col("dataset_name") == "fr"), -1).otherwise(
        F.col("predicted_label")))
    return mt.parse_success_metrics(p, ["dataset_name"])


SQL_VIEWS["per_label"] = """
SELECT label, support, precision, recall,
       CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
FROM (SELECT label, count(*) FILTER (WHERE true_label = label) AS support,
        coalesce(count(*) FILTER (WHERE true_label = label AND predicted_label = label)
                 / nullif(count(*) FILTER (WHERE predicted_label = label), 0), 0.0) AS precision,
        coalesce(count(*) FILTER (WHERE true_label = label AND predicted_label = label)
                 / nullif(count(*) FILTER (WHERE true_label = label), 0), 0.0) AS recall
      FROM scored3, (SELECT unnest(['yes', 'no']) AS label) GROUP BY label)"""


@query("multiclass_metrics", """
SELECT label, CAST(support AS BIGINT) AS support, precision, recall, f1 FROM per_label""",
       doubles="precision recall f1")
def _(spark, sf_dir):
    return mt.multiclass_metrics(v.scored3(spark, sf_dir), ["yes", "no"])


@query("multiclass_summary", """
SELECT count(*) AS rows, avg(CAST(true_label = predicted_label AS INTEGER)) AS accuracy,
       count(*) FILTER (WHERE predicted_label NOT IN ('yes', 'no')) AS off_list_predictions,
       (SELECT avg(precision) FROM per_label) AS macro_precision, (SELECT avg(recall) FROM per_label) AS macro_recall,
       (SELECT avg(f1) FROM per_label) AS macro_f1 FROM scored3""",
       doubles="accuracy macro_precision macro_recall macro_f1")
def _(spark, sf_dir):
    return mt.multiclass_summary(v.scored3(spark, sf_dir), ["yes", "no"])


@query("confusion_matrix", """
SELECT t.true_label, count(*) FILTER (WHERE predicted_label = 'yes') AS predicted_yes,
       count(*) FILTER (WHERE predicted_label = 'no') AS predicted_no,
       count(*) FILTER (WHERE predicted_label = 'maybe') AS predicted_maybe,
       count(*) FILTER (WHERE predicted_label = 'unparsed') AS predicted_unparsed
FROM (SELECT unnest(['yes', 'no', 'maybe', 'unparsed']) AS true_label) t LEFT JOIN scored3 s ON s.true_label = t.true_label
GROUP BY t.true_label""")
def _(spark, sf_dir):
    return mt.confusion_matrix(v.scored3(spark, sf_dir), ["yes", "no", "maybe", "unparsed"])


# Mann-Whitney by midranks: an independent formulation of the same statistic
@query("roc_auc", """
SELECT CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives, (rank_sum - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n) AS roc_auc
FROM (SELECT sum(CASE WHEN is_hallucinated = 1 THEN midrank END) AS rank_sum, count(*) FILTER (WHERE is_hallucinated = 1) AS p,
             count(*) FILTER (WHERE is_hallucinated = 0) AS n
      FROM (SELECT is_hallucinated, rank() OVER (ORDER BY hallucination_probability)
                   + (count(*) OVER (PARTITION BY hallucination_probability) - 1) / 2.0 AS midrank FROM predictions))""",
       doubles="roc_auc")
def _(spark, sf_dir):
    return mt.roc_auc(v.predictions(spark, sf_dir))


@query("metrics_by_dataset_and_total", sql_rates(f"""
SELECT coalesce(dataset_name, 'combined') AS dataset_name, count(*) AS rows, {sql_counts()}
FROM predictions GROUP BY GROUPING SETS ((dataset_name), ())"""), doubles=RATES)
def _(spark, sf_dir):
    return mt.metrics_by_dataset_and_total(v.predictions(spark, sf_dir))


@query("probability_by_group", """
SELECT dataset_name, is_hallucinated, count(*) AS rows, avg(hallucination_probability) AS mean_hallucination_probability,
       median(hallucination_probability) AS median_hallucination_probability, min(hallucination_probability) AS minimum_probability,
       max(hallucination_probability) AS maximum_probability, avg(predicted_label) AS predicted_hallucination_rate,
       avg(CAST(predicted_label = is_hallucinated AS INTEGER)) AS accuracy
FROM predictions GROUP BY ALL""", doubles="mean_hallucination_probability median_hallucination_probability "
    "predicted_hallucination_rate accuracy")
def _(spark, sf_dir):
    return mt.probability_by_group(v.predictions(spark, sf_dir), ["dataset_name", "is_hallucinated"])


@query("accuracy_by_category", """
SELECT hallucination_category, count(*) AS rows, avg(CAST(predicted_label = is_hallucinated AS INTEGER)) AS accuracy
FROM predictions GROUP BY ALL""", doubles="accuracy")
def _(spark, sf_dir):
    return mt.accuracy_by_category(v.predictions(spark, sf_dir), "hallucination_category")


_ERRORS = {name: " ".join(
    f"WHEN is_hallucinated = {t} AND predicted_label = {p} THEN '{text}'"
    for (t, p), text in zip([(1, 1), (0, 0), (0, 1), (1, 0)], names))
    for name, names in mt.ERROR_NAMES.items()}


@query("error_type", " UNION ALL ".join(
    f"SELECT '{name}' AS vocabulary, CASE {case} END AS error_type, count(*) AS rows FROM predictions GROUP BY ALL"
    for name, case in _ERRORS.items()))
def _(spark, sf_dir):
    named = F.array(*[F.struct(F.lit(n).alias("vocabulary"), mt.error_type(n).alias("error_type"))
                      for n in mt.ERROR_NAMES])
    return (v.predictions(spark, sf_dir).select(F.explode(named).alias("e")).groupBy("e.vocabulary", "e.error_type")
            .agg(F.count("*").alias("rows")))


@query("error_type_by_case", """
SELECT case_type, error_type, count(*) AS rows FROM stress GROUP BY ALL""")
def _(spark, sf_dir):
    return mt.error_type_by_case(v.predictions(spark, sf_dir).withColumn("error_type", mt.error_type("stress")))


@query("error_cases_enriched", """
SELECT s.id, s.error_type, s.case_type, p.split, md5(s.question) AS question_md5, s.found AS source_found
FROM (SELECT record_id AS id, record_id, error_type, case_type, question, true AS found FROM stress
      UNION ALL SELECT 'lost-' || record_id, record_id, error_type, case_type, NULL, false FROM stress WHERE doc_id % 17 = 0) s
LEFT JOIN splits p USING (record_id) WHERE s.error_type <> 'correct'""")
def _(spark, sf_dir):
    def with_lost(rows):
        """All rows, and some more under ids whose source text is missing."""
        lost = rows.filter(F.col("doc_id") % 17 == 0).withColumn("id", F.concat(F.lit("lost-"), "id"))
        return rows.unionByName(lost).drop("doc_id")

    p = with_lost(v.predictions(spark, sf_dir).select(
        F.col("record_id").alias("id"), "doc_id", "is_hallucinated", "predicted_label")).withColumn(
        "error_type", mt.error_type("stress"))
    metadata = with_lost(v.splits(spark, sf_dir).select(
        F.col("record_id").alias("id"), "doc_id", "case_type", "split")).withColumn("source_record_id", F.col("id"))
    source = v.answers(spark, sf_dir, evidence=True).select("record_id", "question", "knowledge", "answer")
    return mt.error_cases_enriched(p, metadata, source).select(
        "id", "error_type", "case_type", "split", F.md5("question").alias("question_md5"), "source_found")


@query("error_shortlist", """
SELECT record_id, dataset_name, error_type, prediction_confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_name, error_type ORDER BY prediction_confidence DESC, record_id) AS rn
  FROM (SELECT *, greatest(hallucination_probability, 1 - hallucination_probability) AS prediction_confidence FROM stress)
  WHERE error_type <> 'correct') WHERE rn <= 5""")
def _(spark, sf_dir):
    p = v.predictions(spark, sf_dir).withColumn("error_type", mt.error_type("stress")).withColumn(
        "prediction_confidence", F.greatest("hallucination_probability",
                                            1 - F.col("hallucination_probability")))
    return mt.error_shortlist(p, ["dataset_name", "error_type"]).select(
        "record_id", "dataset_name", "error_type", "prediction_confidence")


@query("false_accept_shortlist", """
SELECT record_id, recommended_action, score AS clinical_trustworthiness_score,
       CASE WHEN is_hallucinated = 1 AND predicted_label = 1 THEN 'true_positive_detected_hallucination'
            WHEN is_hallucinated = 0 AND predicted_label = 0 THEN 'true_negative_accepted_supported'
            WHEN predicted_label = 1 THEN 'false_positive_flagged_supported' ELSE 'false_negative_missed_hallucination' END AS error_type
FROM trust WHERE (is_hallucinated = 1 AND (predicted_label = 0 OR recommended_action = 'accept'))
   OR (recommended_action = 'accept' AND coalesce(final_unsupported_claim_count, 0) > 0)""",
       doubles="clinical_trustworthiness_score")
def _(spark, sf_dir):
    t = v.trust(spark, sf_dir).select(
        "record_id", "recommended_action", "clinical_trustworthiness_score",
        F.col("final_unsupported_claim_count").alias("unsupported_claim_count"))
    return mt.false_accept_shortlist(v.trust_predictions(spark, sf_dir), t).select(
        "record_id", "recommended_action", "clinical_trustworthiness_score", "error_type")


@query("tp_tn_fp_fn_examples", f"""
WITH typed AS (SELECT record_id, hallucination_probability, CASE WHEN is_hallucinated = 1 AND predicted_label = 1 THEN 'true_positive'
      WHEN is_hallucinated = 0 AND predicted_label = 0 THEN 'true_negative'
      WHEN predicted_label = 1 THEN 'false_positive' ELSE 'false_negative' END AS case_type FROM predictions),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_type
    ORDER BY CASE WHEN case_type IN ('true_positive', 'false_positive') THEN -hallucination_probability ELSE hallucination_probability END, record_id) AS rn
  FROM typed) WHERE rn <= 5),
weak AS (SELECT record_id, claim_text, score FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score, claim_index) AS wn FROM claim_scored)
  WHERE wn = 1)
SELECT c.case_type, c.record_id, c.hallucination_probability, w.score AS weakest_claim_support_score,
       md5(CASE WHEN length(t) > 350 THEN substr(t, 1, 350) || '...' ELSE t END) AS weakest_claim_md5
FROM (SELECT c.*, w.score, {v.sql_strip("replace(w.claim_text, chr(10), ' ')")} AS t FROM chosen c LEFT JOIN weak w USING (record_id)) c
LEFT JOIN weak w USING (record_id)""", doubles="weakest_claim_support_score")
def _(spark, sf_dir):
    claims = gr.claim_scores(v.answers(spark, sf_dir, evidence=True), ["record_id"], v.LISTS)
    return mt.tp_tn_fp_fn_examples(v.predictions(spark, sf_dir), claims).select(
        "case_type", "record_id", "hallucination_probability", "weakest_claim_support_score",
        F.md5("weakest_claim_text").alias("weakest_claim_md5"))


SQL_VIEWS["two_models"] = """
SELECT a.record_id, a.is_hallucinated, a.predicted_label AS pa, b.predicted_label AS pb
FROM predictions a JOIN predictions_b b USING (record_id)"""


def _labelled(df):
    return df.withColumn("true_label", F.col("is_hallucinated"))


@query("model_outcome_compare", """
SELECT count(*) AS rows, count(*) FILTER (WHERE b) AS base_correct, count(*) FILTER (WHERE t) AS tuned_correct,
       count(*) FILTER (WHERE NOT b AND t) AS fixed, count(*) FILTER (WHERE b AND NOT t) AS lost,
       count(*) FILTER (WHERE b AND t) AS both_correct, count(*) FILTER (WHERE NOT b AND NOT t) AS both_wrong
FROM (SELECT pa = is_hallucinated AS b, pb = is_hallucinated AS t FROM two_models)""")
def _(spark, sf_dir):
    return mt.outcome_counts(mt.model_outcome_compare(
        _labelled(v.predictions(spark, sf_dir)), _labelled(v.predictions_b(spark, sf_dir))))


@query("model_disagreements", """
SELECT record_id, is_hallucinated, pa AS prediction_a, pb AS prediction_b FROM two_models WHERE pa <> pb""")
def _(spark, sf_dir):
    return mt.model_disagreements(v.predictions(spark, sf_dir), v.predictions_b(spark, sf_dir))


@query("same_false_negatives", """
SELECT count(*) FILTER (WHERE pa = 0 AND pb = 0) AS missed_by_both, count(*) FILTER (WHERE pa = 0 AND pb = 1) AS missed_by_a_only,
       count(*) FILTER (WHERE pa = 1 AND pb = 0) AS missed_by_b_only,
       CASE WHEN count(*) FILTER (WHERE pa <> pb) = 0 THEN 'yes' ELSE 'no' END AS same_false_negatives
FROM two_models WHERE is_hallucinated = 1""")
def _(spark, sf_dir):
    return mt.same_false_negatives(v.predictions(spark, sf_dir), v.predictions_b(spark, sf_dir))


@query("disagreement_review", """
SELECT disagreement_type, CASE WHEN disagreement_type LIKE '%missed%' THEN 'mandatory_human_review' ELSE 'human_review' END
         AS disagreement_recommended_action, count(*) AS rows
FROM (SELECT CASE WHEN pa = 0 AND is_hallucinated = 0 THEN 'model_b_over_flagged_supported_answer'
    WHEN pa = 0 THEN 'model_a_missed_hallucination' WHEN is_hallucinated = 0 THEN 'model_a_over_flagged_supported_answer'
    ELSE 'model_b_missed_hallucination' END AS disagreement_type FROM two_models WHERE pa <> pb) GROUP BY ALL""")
def _(spark, sf_dir):
    rows = mt.model_disagreements(v.predictions(spark, sf_dir), v.predictions_b(spark, sf_dir))
    return mt.disagreement_review(rows).groupBy(
        "disagreement_type", "disagreement_recommended_action").agg(F.count("*").alias("rows"))


@query("model_leaderboard", sql_rates(f"""
SELECT model, count(*) AS rows, {sql_counts()} FROM (
  SELECT 'a' AS model, is_hallucinated, predicted_label FROM predictions
  UNION ALL SELECT 'b', is_hallucinated, predicted_label FROM predictions_b) GROUP BY model"""), doubles=RATES)
def _(spark, sf_dir):
    a = v.predictions(spark, sf_dir).withColumn("model", F.lit("a"))
    return mt.model_leaderboard(a.unionByName(
        v.predictions_b(spark, sf_dir).withColumn("model", F.lit("b"))))


SQL_VIEWS["judge_rows"] = """
SELECT is_hallucinated, 'baseline' AS method, predicted_label FROM judged
UNION ALL
SELECT is_hallucinated, 'judge', CASE support_level WHEN 'supported' THEN 0 WHEN 'partial' THEN 1 WHEN 'unsupported' THEN 1 END
FROM judged"""


@query("judge_vs_baseline", sql_rates(f"""
SELECT method, count(*) AS rows, {sql_counts()} FROM judge_rows WHERE predicted_label IS NOT NULL GROUP BY method"""),
       doubles=RATES)
def _(spark, sf_dir):
    return mt.judge_vs_baseline(mt.judge_predictions(v.judge_raw(spark, sf_dir)))
