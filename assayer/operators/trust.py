"""Trust scores, routing and dispositions: pure rules on one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer import terms
from assayer.functions import text as tx
from assayer.terms import ACCEPT, MANDATORY, REVIEW, REVISE


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp01(c: Column) -> Column:
    """Null stays null (``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


# --- trust score ------------------------------------------------------------

def final_grounding(lexical: DataFrame, semantic: DataFrame | None = None,
                    row_id: str = "record_id") -> DataFrame:
    """Semantic grounding where present, lexical grounding otherwise.

    The combined columns may already be part of ``lexical``, come from a
    separate ``semantic`` table, or be absent altogether.
    """
    columns = ["combined_answer_grounding_score", "combined_unsupported_claim_count"]
    joined = lexical
    if semantic is not None:
        joined = lexical.join(semantic.select(row_id, *columns), row_id, "left")
    have = set(columns) <= set(joined.columns)
    pick = lambda preferred, fallback: (
        F.coalesce(preferred, fallback) if have else F.col(fallback))
    return (joined
            .withColumn("final_grounding_score", pick(columns[0], "answer_claim_grounding_score"))
            .withColumn("final_unsupported_claim_count", pick(columns[1], "unsupported_claim_count")))


def trust_score(predictions: DataFrame, grounding: DataFrame, row_id: str = "record_id",
                risk: str = "hallucination_probability") -> DataFrame:
    """1 - .45 risk - .35 (1 - grounding) - .15 unsupported share - .05 conflict.

    Fails closed: a record without grounding gets a null score, a flag and
    mandatory review.
    """
    ground = grounding.select(row_id, "final_grounding_score", "final_unsupported_claim_count",
                              "unsupported_high_impact_claim_count")
    joined = (predictions.join(ground, row_id, "left")
              .withColumn("grounding_missing", F.col("final_grounding_score").isNull())
              .withColumn("model_hallucination_risk", F.col(risk))
              .withColumn("grounding_risk", 1 - F.col("final_grounding_score"))
              .withColumn("contradiction_risk", (
                  (F.col("predicted_label") == 0)
                  & (F.coalesce("final_unsupported_claim_count", F.lit(0)) > 0)).cast("int")))
    return with_action(joined.withColumn("clinical_trustworthiness_score", _formula(
        "final_unsupported_claim_count", "contradiction_risk")))


def _formula(unsupported: str, conflict: str) -> Column:
    capped = F.when(F.col(unsupported).isNotNull(), F.least(F.col(unsupported), F.lit(3))) / 3
    return clamp01(1 - (0.45 * F.col("model_hallucination_risk")) - (0.35 * F.col("grounding_risk"))
                   - (0.15 * capped) - (0.05 * F.col(conflict)))


def trust_action(score: Column | str, high_impact: Column, conflict: Column) -> Column:
    score = _c(score)
    return (F.when(score.isNull() | high_impact | conflict | (score < 0.45), MANDATORY)
            .when(score < 0.65, REVIEW).when(score < 0.80, REVISE).otherwise(ACCEPT))


def with_action(df: DataFrame, conflict: str = "contradiction_risk") -> DataFrame:
    return df.withColumn("recommended_action", trust_action(
        "clinical_trustworthiness_score",
        F.coalesce(F.col("unsupported_high_impact_claim_count") > 0, F.lit(False)),
        F.coalesce(F.col(conflict) == 1, F.lit(False))))


def trust_action_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("recommended_action").agg(F.count("*").alias("row_count"))


def trust_overall(scored: DataFrame, source: str) -> DataFrame:
    return scored.agg(
        F.count("*").alias("rows_scored"),
        F.first(F.lit(source)).alias("grounding_source"),
        F.avg("clinical_trustworthiness_score").alias("mean_clinical_trustworthiness_score"),
        F.avg("model_hallucination_risk").alias("mean_hallucination_risk"),
        F.avg("final_grounding_score").alias("mean_final_grounding_score"),
        F.count_if(F.col("unsupported_high_impact_claim_count") > 0).alias(
            "unsupported_high_impact_claim_rows"),
        F.count_if(F.col("contradiction_risk") == 1).alias("contradiction_risk_rows"),
        F.count_if(F.col("recommended_action") == MANDATORY).alias("mandatory_human_review_rows"))


def trust_score_vec(predictions: DataFrame, grounding: DataFrame,
                    row_id: str = "record_id") -> DataFrame:
    """Variant on vector grounding: conflict = predicted supported, grounding < .35."""
    ground = grounding.select(row_id, "semantic_grounding_score", "unsupported_claim_count",
                              "unsupported_high_impact_claim_count")
    joined = (predictions.join(ground, row_id, "left")
              .withColumn("model_hallucination_risk", F.col("hallucination_probability"))
              .withColumn("grounding_risk", 1 - F.col("semantic_grounding_score"))
              .withColumn("evidence_conflict_risk", F.coalesce(
                  (F.col("predicted_label") == 0) & (F.col("semantic_grounding_score") < 0.35),
                  F.lit(False)).cast("int")))
    scored = joined.withColumn("clinical_trustworthiness_score", _formula(
        "unsupported_claim_count", "evidence_conflict_risk"))
    return with_action(scored, "evidence_conflict_risk")


def trust_by_label(scored: DataFrame, label: str = "is_hallucinated") -> DataFrame:
    return scored.groupBy(label).agg(
        F.count("*").alias("rows"),
        F.avg("model_hallucination_risk").alias("mean_hallucination_risk"),
        F.avg("semantic_grounding_score").alias("mean_grounding_score"),
        F.avg("clinical_trustworthiness_score").alias("mean_trustworthiness_score"),
        F.count_if(F.col("unsupported_claim_count") > 0).alias("unsupported_claim_rows"),
    ).withColumn("label_description",
                 F.when(F.col(label) == 0, "supported").otherwise("hallucinated"))


def _strict_rules(base: Column) -> Column:
    """Rules shared by the tuned and the logic-aware policy."""
    score, risk = F.col("clinical_trustworthiness_score"), F.col("hallucination_probability")
    weak = (F.col("unsupported_claim_count") > 0) & (F.col("semantic_grounding_score") < 0.55)
    return (F.when((risk >= 0.70) | score.isNull() | (score < 0.55) | weak, MANDATORY)
            .when(score < 0.70, REVIEW).when(score < 0.82, REVISE).otherwise(base))


def trust_action_tuned() -> Column:
    return _strict_rules(F.lit(ACCEPT))


def logic_aware_action(question: Column | str = "question",
                       base: Column | str = "tuned_recommended_action",
                       term_list=terms.LOGIC_RISK_TERMS) -> Column:
    """Negated, exam-style questions are escalated before the tuned rules apply."""
    base = _c(base)
    tricky = tx.contains_any_term(question, term_list)
    escalate = tricky & ((base == ACCEPT) | ((F.col("hallucination_probability") < 0.20)
                                             & (F.col("semantic_grounding_score") >= 0.50)))
    fallback = F.when(base == "", REVIEW).otherwise(F.coalesce(base, F.lit(REVIEW)))
    return F.when(escalate, MANDATORY).otherwise(_strict_rules(fallback))


def policy_comparison(df: DataFrame, policies: list[str],
                      label: str = "is_hallucinated") -> DataFrame:
    """One row per routing policy, from a single pass over the rows."""
    rows = F.array(*[F.struct(F.lit(p).alias("action_column"), F.col(p).alias("action"))
                     for p in policies])
    long = df.select(label, F.explode(rows).alias("_p")).select(label, "_p.*")
    accepted = F.col("action") == ACCEPT
    return long.groupBy("action_column").agg(
        F.count_if(accepted).alias("accepted_rows"),
        F.count_if(accepted & (F.col(label) == 0)).alias("accepted_supported_rows"),
        F.count_if(accepted & (F.col(label) == 1)).alias("accepted_hallucinated_rows"),
        F.count_if(F.col("action") == MANDATORY).alias("mandatory_human_review_rows"),
        F.count_if(F.col("action") == REVIEW).alias("human_review_rows"),
        F.count_if(F.col("action") == REVISE).alias("revise_rows"))


# --- model signals ----------------------------------------------------------

def label_argmax_margin(df: DataFrame, scores: dict[str, str], label: str = "predicted_label",
                        margin: str = "confidence_margin") -> DataFrame:
    """Arg-max label (ties: first listed) and top-1 minus top-2 score."""
    best = F.greatest(*[F.col(c) for c in scores.values()])
    chain, names = None, list(scores)
    for name in names[:-1]:
        hit = F.col(scores[name]) == best
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    ordered = F.array_sort(F.array(*[-F.col(c) for c in scores.values()]))
    return (df.withColumn(label, chain.otherwise(names[-1]))
            .withColumn(margin, F.element_at(ordered, 2) - F.element_at(ordered, 1)))


def softmax_probability(df: DataFrame, supported: str = "score_supported",
                        hallucinated: str = "score_hallucinated") -> DataFrame:
    """Two scores -> probability, label (>= .5), confidence and decision margin."""
    top = F.greatest(supported, hallucinated)
    s, h = F.exp(F.col(supported) - top), F.exp(F.col(hallucinated) - top)
    out = df.withColumn("hallucination_probability", h / (s + h)).withColumn(
        "supported_probability", s / (s + h))
    return (out.withColumn("predicted_label",
                           (F.col("hallucination_probability") >= 0.5).cast("int"))
            .withColumn("prediction_confidence",
                        F.greatest("hallucination_probability", "supported_probability"))
            .withColumn("decision_margin", F.abs(
                F.col("hallucination_probability") - F.col("supported_probability"))))


def consistency_check(evidence: Column | str, candidate: Column | str) -> Column:
    """Struct(label, reason) comparing two stances."""
    evidence, candidate = _c(evidence), _c(candidate)
    firm = evidence.isin("yes", "no") & candidate.isin("yes", "no")
    label = (F.when(firm & (evidence == candidate), "consistent")
             .when(firm, "contradiction").otherwise("uncertain"))
    reason = (F.when(firm & (evidence == candidate), "stances_match")
              .when(firm, "stances_conflict").when(evidence == "maybe", "evidence_inconclusive")
              .when(candidate == "maybe", "candidate_inconclusive")
              .otherwise("candidate_without_stance"))
    return F.struct(label.alias("label"), reason.alias("reason"))


ROUTE_REASONS = [
    "answer_flagged_hallucinated", "evidence_inconclusive", "stance_contradiction",
    "consistency_undetermined", "low_margin", "possible_safe_refusal",
]


def route_case(df: DataFrame, answer: str = "candidate_answer", safety: str = "safety_label",
               evidence: str = "evidence_label", safety_margin: str = "safety_margin",
               evidence_margin: str = "evidence_margin", consistency: str = "consistency_label",
               refusal_terms=terms.REFUSAL_TERMS) -> DataFrame:
    """Accumulate review reasons, then choose the route (unrounded margins)."""
    flagged = F.col(safety) == "hallucinated"
    conflict = F.col(consistency) == "contradiction"
    triggers = [
        flagged, F.col(evidence) == "maybe", conflict,
        (F.col(consistency) == "uncertain") & (F.col(evidence) != "maybe"),
        (F.col(safety_margin) < terms.LOW_MARGIN) | (F.col(evidence_margin) < terms.LOW_MARGIN),
        tx.contains_any_term(answer, refusal_terms),
    ]
    reasons = F.array_compact(F.array(*[
        F.when(hit, F.lit(name)) for hit, name in zip(triggers, ROUTE_REASONS)]))
    out = df.withColumn("_reasons", reasons)
    return (out.withColumn("routing_action", F.when(flagged | conflict, terms.ROUTE_MANDATORY)
                           .when(F.size("_reasons") > 0, terms.ROUTE_REVIEW)
                           .otherwise(terms.ROUTE_LOWER))
            .withColumn("routing_reasons", F.when(F.size("_reasons") > 0, F.col("_reasons"))
                        .otherwise(F.array(F.lit("no_trigger_fired")))).drop("_reasons"))


def manual_disposition(route: Column | str = "routing_action") -> Column:
    """Supplied evidence never passes on its own."""
    route = _c(route)
    return F.struct(
        F.when(route == terms.ROUTE_LOWER, terms.DISPOSITION_ROUTINE)
        .when(route == terms.ROUTE_MANDATORY, terms.ROUTE_MANDATORY)
        .otherwise(terms.ROUTE_REVIEW).alias("label"),
        F.when(route == terms.ROUTE_LOWER, "routine")
        .when(route == terms.ROUTE_MANDATORY, "mandatory").otherwise("review").alias("kind"))


def automatic_disposition(similarity: str = "best_similarity", route: str = "routing_action",
                          safety: str = "safety_label", evidence: str = "evidence_label",
                          candidate: str = "candidate_stance",
                          consistency: str = "consistency_label",
                          safety_margin: str = "safety_margin",
                          evidence_margin: str = "evidence_margin") -> Column:
    """Struct(label, kind, basis); rule order matters.

    Gates read values rounded to three digits: similarity before the .90 gate,
    margins before the .75 gate.
    """
    sim = F.round(F.col(similarity), 3)
    sm, em = F.round(F.col(safety_margin), 3), F.round(F.col(evidence_margin), 3)
    moderate = sim < terms.DECISION_SIMILARITY
    strong = sm >= terms.STRONG_MARGIN
    hallucinated = F.col(safety) == "hallucinated"
    aligned = ((F.col(route) == terms.ROUTE_LOWER) & (F.col(safety) == "supported")
               & F.col(evidence).isin("yes", "no") & F.col(candidate).isin("yes", "no")
               & (F.col(consistency) == "consistent") & strong & (em >= terms.STRONG_MARGIN))
    rules = [
        (sim.isNull(), terms.DISPOSITION_INSUFFICIENT, "review", "no_relevant_evidence"),
        (moderate & (F.col(route) == terms.ROUTE_MANDATORY), terms.ROUTE_MANDATORY, "mandatory",
         "moderate_similarity"),
        (moderate, terms.ROUTE_REVIEW, "review", "moderate_similarity"),
        (F.col(consistency) == "contradiction", terms.DISPOSITION_FAIL, "fail",
         "stance_contradiction"),
        (hallucinated & strong, terms.DISPOSITION_FAIL, "fail", "strong_hallucination_signal"),
        (hallucinated, terms.ROUTE_REVIEW, "review", "weak_hallucination_signal"),
        (aligned, terms.DISPOSITION_PASS, "pass", "all_signals_aligned"),
    ]
    def chain(position: int, default: str) -> Column:
        out = None
        for rule in rules:
            value = rule[position]
            out = F.when(rule[0], value) if out is None else out.when(rule[0], value)
        return out.otherwise(default)
    return F.struct(chain(1, terms.ROUTE_REVIEW).alias("label"), chain(2, "review").alias("kind"),
                    chain(3, "remaining_uncertainty").alias("basis"))


def evaluate_cases(cases: DataFrame) -> DataFrame:
    """Scores -> labels -> stance -> consistency -> route -> disposition.

    ``cases`` carries score_yes/no/maybe, score_supported/hallucinated,
    candidate_answer and best_similarity (null when nothing was retrieved).
    Works on batch and streaming frames alike.
    """
    out = label_argmax_margin(cases, {"yes": "score_yes", "no": "score_no", "maybe": "score_maybe"},
                              "evidence_label", "evidence_margin")
    out = label_argmax_margin(out, {"hallucinated": "score_hallucinated",
                                    "supported": "score_supported"},
                              "safety_label", "safety_margin")
    out = (out.withColumn("candidate_stance", tx.stance_parse("candidate_answer"))
           .withColumn("consistency_label",
                       consistency_check("evidence_label", "candidate_stance")["label"]))
    out = route_case(out)
    return out.withColumn("disposition", automatic_disposition())


def review_case_action(prediction: Column | str = "predicted_label",
                       error: Column | str = "error_type") -> Column:
    """Struct(routing_action, routing_reason) for the benchmark case browser."""
    prediction, error = _c(prediction), _c(error)
    false_alarm = error == "false_positive_supported_flagged"
    return F.struct(
        F.when(false_alarm | (prediction == "hallucinated"), terms.ROUTE_REVIEW)
        .otherwise(terms.ROUTE_LOWER).alias("routing_action"),
        F.when(false_alarm, "safe_refusal_flagged")
        .when(prediction == "hallucinated", "flagged_hallucinated")
        .otherwise("supported_without_clearance").alias("routing_reason"))
