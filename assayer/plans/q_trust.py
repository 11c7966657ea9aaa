"""Trust, routing and disposition queries."""

from pyspark.sql import functions as F

from assayer.operators import metrics as mt, trust as tr
from assayer.plans import views as v
from assayer.plans.registry import SQL_VIEWS, query


@query("trust_score", """
SELECT record_id, final_grounding_score, final_unsupported_claim_count, conflict AS contradiction_risk,
       final_grounding_score IS NULL AS grounding_missing, score AS clinical_trustworthiness_score
FROM trust""", doubles="final_grounding_score clinical_trustworthiness_score")
def _(spark, sf_dir):
    return v.trust(spark, sf_dir).select(
        "record_id", "final_grounding_score", "final_unsupported_claim_count", "contradiction_risk",
        "grounding_missing", "clinical_trustworthiness_score")


@query("trust_action", """
SELECT recommended_action, count(*) AS row_count FROM trust GROUP BY ALL""")
def _(spark, sf_dir):
    return tr.trust_action_counts(v.trust(spark, sf_dir))


@query("trust_overall", """
SELECT count(*) AS rows_scored, 'semantic_plus_claim_grounding' AS grounding_source,
       avg(score) AS mean_clinical_trustworthiness_score, avg(hallucination_probability) AS mean_hallucination_risk,
       avg(final_grounding_score) AS mean_final_grounding_score,
       count(*) FILTER (WHERE high_impact > 0) AS unsupported_high_impact_claim_rows,
       count(*) FILTER (WHERE conflict = 1) AS contradiction_risk_rows,
       count(*) FILTER (WHERE recommended_action = 'mandatory_human_review') AS mandatory_human_review_rows
FROM trust""", doubles="mean_clinical_trustworthiness_score mean_hallucination_risk mean_final_grounding_score")
def _(spark, sf_dir):
    return tr.trust_overall(v.trust(spark, sf_dir), "semantic_plus_claim_grounding")


@query("trust_score_vec", """
SELECT t.is_hallucinated, count(*) AS rows, avg(hallucination_probability) AS mean_hallucination_risk,
       avg(semantic_grounding_score) AS mean_grounding_score, avg(score) AS mean_trustworthiness_score,
       count(*) FILTER (WHERE unsupported_claim_count > 0) AS unsupported_claim_rows,
       CASE t.is_hallucinated WHEN 0 THEN 'supported' ELSE 'hallucinated' END AS label_description,
       (SELECT avg(CASE WHEN a.r > b.r THEN 1.0 WHEN a.r = b.r THEN 0.5 ELSE 0.0 END)
        FROM (SELECT round(1 - score, 12) AS r FROM vec_trust WHERE is_hallucinated = 1) a,
             (SELECT round(1 - score, 12) AS r FROM vec_trust WHERE is_hallucinated = 0) b) AS roc_auc
FROM vec_trust t GROUP BY t.is_hallucinated""",
       doubles="mean_hallucination_risk mean_grounding_score mean_trustworthiness_score roc_auc")
def _(spark, sf_dir):
    scored = v.vector_trust(spark, sf_dir).withColumn(
        "_risk", F.round(1 - F.col("clinical_trustworthiness_score"), 12))
    auc = mt.roc_auc(scored, "_risk").select("roc_auc")
    return tr.trust_by_label(scored).withColumn("roc_auc", auc.scalar())


SQL_VIEWS["policy_rows"] = """
SELECT *, CASE WHEN hallucination_probability >= 0.70 OR score IS NULL OR score < 0.55
                 OR (final_unsupported_claim_count > 0 AND final_grounding_score < 0.55) THEN 'mandatory_human_review'
               WHEN score < 0.70 THEN 'human_review' WHEN score < 0.82 THEN 'revise' ELSE 'accept' END AS tuned,
       contains(lower(question), 'mente') OR contains(lower(question), 'ion the') AS tricky
FROM trust"""
SQL_VIEWS["policy_actions"] = """
SELECT *, CASE WHEN tricky AND (tuned = 'accept' OR (hallucination_probability < 0.20 AND final_grounding_score >= 0.50))
               THEN 'mandatory_human_review' ELSE tuned END AS logic_aware
FROM policy_rows"""
LOGIC_TERMS = ["mente", "ion the"]


def _policies(spark, sf_dir):
    scored = (v.trust(spark, sf_dir)
              .withColumn("semantic_grounding_score", F.col("final_grounding_score"))
              .withColumn("unsupported_claim_count", F.col("final_unsupported_claim_count"))
              .withColumn("tuned_recommended_action", tr.trust_action_tuned()))
    return scored.withColumn("logic_aware_recommended_action",
                             tr.logic_aware_action(term_list=LOGIC_TERMS))


@query("trust_action_tuned", """
SELECT recommended_action, tuned AS tuned_recommended_action, count(*) AS rows FROM policy_rows GROUP BY ALL""")
def _(spark, sf_dir):
    return _policies(spark, sf_dir).groupBy("recommended_action", "tuned_recommended_action").agg(
        F.count("*").alias("rows"))


@query("logic_aware_action", """
SELECT record_id, tuned AS tuned_recommended_action, logic_aware AS logic_aware_recommended_action FROM policy_actions""")
def _(spark, sf_dir):
    return _policies(spark, sf_dir).select(
        "record_id", "tuned_recommended_action", "logic_aware_recommended_action")


@query("policy_comparison", """
SELECT action_column, count(*) FILTER (WHERE action = 'accept') AS accepted_rows,
       count(*) FILTER (WHERE action = 'accept' AND is_hallucinated = 0) AS accepted_supported_rows,
       count(*) FILTER (WHERE action = 'accept' AND is_hallucinated = 1) AS accepted_hallucinated_rows,
       count(*) FILTER (WHERE action = 'mandatory_human_review') AS mandatory_human_review_rows,
       count(*) FILTER (WHERE action = 'human_review') AS human_review_rows,
       count(*) FILTER (WHERE action = 'revise') AS revise_rows
FROM (SELECT is_hallucinated, 'recommended_action' AS action_column, recommended_action AS action FROM policy_actions
      UNION ALL SELECT is_hallucinated, 'tuned_recommended_action', tuned FROM policy_actions
      UNION ALL SELECT is_hallucinated, 'logic_aware_recommended_action', logic_aware FROM policy_actions)
GROUP BY action_column""")
def _(spark, sf_dir):
    return tr.policy_comparison(_policies(spark, sf_dir), [
        "recommended_action", "tuned_recommended_action", "logic_aware_recommended_action"])


@query("label_argmax_margin", """
SELECT l_linestatus, true_label, predicted_label, count(*) AS rows, avg(confidence_margin) AS mean_margin,
       count(*) FILTER (WHERE confidence_margin = 0) AS ties FROM scored3 GROUP BY ALL""", doubles="mean_margin")
def _(spark, sf_dir):
    return v.scored3(spark, sf_dir).groupBy("l_linestatus", "true_label", "predicted_label").agg(
        F.count("*").alias("rows"), F.avg("confidence_margin").alias("mean_margin"),
        F.count_if(F.col("confidence_margin") == 0).alias("ties"))


@query("softmax_probability", """
SELECT predicted_label, count(*) AS rows, avg(p) AS mean_probability, avg(greatest(p, 1 - p)) AS mean_confidence,
       avg(abs(p - (1 - p))) AS mean_margin
FROM (SELECT p, CAST(p >= 0.5 AS INTEGER) AS predicted_label FROM (
  SELECT exp(score_hallucinated - greatest(score_supported, score_hallucinated))
         / (exp(score_supported - greatest(score_supported, score_hallucinated))
            + exp(score_hallucinated - greatest(score_supported, score_hallucinated))) AS p FROM cases))
GROUP BY ALL""", doubles="mean_probability mean_confidence mean_margin")
def _(spark, sf_dir):
    return tr.softmax_probability(v.cases(spark, sf_dir)).groupBy("predicted_label").agg(
        F.count("*").alias("rows"), F.avg("hallucination_probability").alias("mean_probability"),
        F.avg("prediction_confidence").alias("mean_confidence"),
        F.avg("decision_margin").alias("mean_margin"))


@query("consistency_check", """
SELECT evidence_label, candidate_stance, consistency_label, count(*) AS rows FROM evaluated GROUP BY ALL""")
def _(spark, sf_dir):
    return tr.evaluate_cases(v.cases(spark, sf_dir)).groupBy(
        "evidence_label", "candidate_stance", "consistency_label").agg(F.count("*").alias("rows"))


@query("route_case", """
SELECT routing_action, flagged, CAST(greatest(reason_count, 1) AS INTEGER) AS reasons, count(*) AS rows FROM routed GROUP BY ALL""")
def _(spark, sf_dir):
    routed = tr.evaluate_cases(v.cases(spark, sf_dir))
    return routed.groupBy(
        "routing_action", F.array_contains("routing_reasons", "answer_flagged_hallucinated").alias("flagged"),
        F.size("routing_reasons").alias("reasons")).agg(F.count("*").alias("rows"))


@query("manual_disposition", """
SELECT CASE routing_action WHEN 'Lower-priority human review' THEN 'Routine human review — no escalation'
       ELSE routing_action END AS label,
       CASE routing_action WHEN 'Lower-priority human review' THEN 'routine'
       WHEN 'Mandatory human review' THEN 'mandatory' ELSE 'review' END AS kind, count(*) AS rows
FROM routed GROUP BY ALL""")
def _(spark, sf_dir):
    routed = tr.evaluate_cases(v.cases(spark, sf_dir)).select(
        tr.manual_disposition()["label"].alias("label"), tr.manual_disposition()["kind"].alias("kind"))
    return routed.groupBy("label", "kind").agg(F.count("*").alias("rows"))


@query("automatic_disposition", """
SELECT disposition_label, routing_action, consistency_label, safety_label, count(*) AS rows FROM disposed GROUP BY ALL""")
def _(spark, sf_dir):
    return tr.evaluate_cases(v.cases(spark, sf_dir)).groupBy(
        F.col("disposition.label").alias("disposition_label"), "routing_action", "consistency_label",
        "safety_label").agg(F.count("*").alias("rows"))


SQL_VIEWS["stress"] = """
SELECT *, CASE is_hallucinated WHEN 1 THEN 'hallucinated' ELSE 'supported' END AS true_label,
       CASE predicted_label WHEN 1 THEN 'hallucinated' ELSE 'supported' END AS predicted_text,
       CASE WHEN is_hallucinated = 0 AND predicted_label = 1 THEN 'false_positive_supported_flagged'
            WHEN is_hallucinated = 1 AND predicted_label = 0 THEN 'false_negative_missed_hallucination'
            ELSE 'correct' END AS error_type
FROM predictions"""


@query("review_case_action", """
SELECT scenario, record_id, routing_action, routing_reason FROM (
  SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY doc_id) AS rn FROM (
    SELECT doc_id, record_id, CASE WHEN error_type = 'false_positive_supported_flagged' THEN 'safe_refusal_false_positive'
             WHEN error_type = 'correct' AND is_hallucinated = 1 THEN 'correct_hallucination'
             WHEN error_type = 'correct' THEN 'correct_supported' END AS scenario,
           CASE WHEN predicted_label = 1 THEN 'Human review required' ELSE 'Lower-priority human review' END AS routing_action,
           CASE WHEN error_type = 'false_positive_supported_flagged' THEN 'safe_refusal_flagged'
                WHEN predicted_label = 1 THEN 'flagged_hallucinated' ELSE 'supported_without_clearance' END AS routing_reason
    FROM stress) WHERE scenario IS NOT NULL) WHERE rn = 1""")
def _(spark, sf_dir):
    from assayer.operators.ranking import top_n_per_group
    p = v.predictions(spark, sf_dir).withColumn("error_type", mt.error_type("stress"))
    wording = F.when(F.col("predicted_label") == 1, "hallucinated").otherwise("supported")
    scenario = (F.when(F.col("error_type") == "false_positive_supported_flagged",
                       "safe_refusal_false_positive")
                .when((F.col("error_type") == "correct") & (F.col("is_hallucinated") == 1),
                      "correct_hallucination")
                .when(F.col("error_type") == "correct", "correct_supported"))
    cases = p.withColumn("scenario", scenario).filter(F.col("scenario").isNotNull())
    picked = top_n_per_group(cases.select("doc_id", "record_id", "scenario", "error_type",
                                          wording.alias("wording")), ["scenario"], ["doc_id"], 1)
    action = tr.review_case_action("wording")
    return picked.select("scenario", "record_id", action["routing_action"].alias("routing_action"),
                         action["routing_reason"].alias("routing_reason"))
