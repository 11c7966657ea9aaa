"""Classification metrics, error analysis and model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions import text as tx
from assayer.operators.ranking import (
    exact_median, join_on, running_totals, top_n_per_group,
)


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(denominator == 0, 0.0).otherwise(numerator / denominator)


def binary_rates(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from four count columns."""
    tp, tn = F.col("true_positives"), F.col("true_negatives")
    fp, fn = F.col("false_positives"), F.col("false_negatives")
    return (df.withColumn("accuracy", ratio(tp + tn, tp + tn + fp + fn))
            .withColumn("precision", ratio(tp, tp + fp))
            .withColumn("recall", ratio(tp, tp + fn))
            .withColumn("f1_score", ratio(2 * F.col("precision") * F.col("recall"),
                                          F.col("precision") + F.col("recall"))))


def confusion_counts(label: str = "is_hallucinated", prediction: str = "predicted_label"):
    t, p = F.col(label), F.col(prediction)
    return [
        F.count_if((t == 1) & (p == 1)).alias("true_positives"),
        F.count_if((t == 0) & (p == 0)).alias("true_negatives"),
        F.count_if((t == 0) & (p == 1)).alias("false_positives"),
        F.count_if((t == 1) & (p == 0)).alias("false_negatives"),
    ]


def binary_metrics(df: DataFrame, by: list[str] = (), label: str = "is_hallucinated",
                   prediction: str = "predicted_label") -> DataFrame:
    """Rows without a 0/1 prediction are left out of every count."""
    valid = df.filter(F.col(prediction).isin(0, 1))
    return binary_rates(valid.groupBy(*by).agg(
        F.count("*").alias("rows"), *confusion_counts(label, prediction)))


def binary_metrics_rounded(df: DataFrame, by: list[str] = (), label: str = "is_hallucinated",
                           prediction: str = "predicted_label", digits: int = 3) -> DataFrame:
    """Variant: precision and recall are rounded before F1."""
    base = binary_metrics(df, by, label, prediction)
    p, r = F.round("precision", digits), F.round("recall", digits)
    return (base.withColumn("accuracy", F.round("accuracy", digits))
            .withColumn("f1_score", F.round(2 * p * r / F.greatest(p + r, F.lit(1e-9)), digits))
            .withColumn("precision", p).withColumn("recall", r))


def parse_success_metrics(df: DataFrame, by: list[str] = (), label: str = "is_hallucinated",
                          prediction: str = "predicted_label") -> DataFrame:
    """Metrics over parseable predictions plus the parse rate; no parse, no metrics."""
    counted = df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(prediction).isin(0, 1)).alias("parsed_rows"),
        *confusion_counts(label, prediction))
    out = binary_rates(counted).withColumn("parse_success", ratio(F.col("parsed_rows"), F.col("rows")))
    for name in ("accuracy", "precision", "recall", "f1_score"):
        out = out.withColumn(name, F.when(F.col("parsed_rows") > 0, F.col(name)))
    return out


def label_pairs(df: DataFrame, by: list[str] = (), label: str = "true_label",
                prediction: str = "predicted_label") -> DataFrame:
    """Counts per (true, predicted): the only pass over the rows."""
    return df.groupBy(*by, F.col(label).alias("_t"), F.col(prediction).alias("_p")).agg(
        F.count("*").alias("_n"))


def multiclass_metrics(df: DataFrame, labels: list[str], by: list[str] = (),
                       label: str = "true_label", prediction: str = "predicted_label") -> DataFrame:
    """Per-label precision / recall / F1 / support for a given label list."""
    by = list(by)
    pairs = label_pairs(df, by, label, prediction)
    spread = pairs.select(*by, "_t", "_p", "_n", F.explode(
        F.array(*[F.lit(v) for v in labels])).alias("label"))
    add = lambda hit: F.sum(F.when(hit, F.col("_n")).otherwise(0))
    counted = spread.groupBy(*by, "label").agg(
        add((F.col("_t") == F.col("label")) & (F.col("_p") == F.col("label"))).alias("_tp"),
        add(F.col("_p") == F.col("label")).alias("predicted"),
        add(F.col("_t") == F.col("label")).alias("support"))
    return (counted.withColumn("precision", ratio(F.col("_tp"), F.col("predicted")))
            .withColumn("recall", ratio(F.col("_tp"), F.col("support")))
            .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"),
                                    F.col("precision") + F.col("recall")))
            .drop("_tp", "predicted"))


def multiclass_summary(df: DataFrame, labels: list[str], by: list[str] = (),
                       label: str = "true_label", prediction: str = "predicted_label") -> DataFrame:
    """Macro averages over the list, accuracy over all rows, off-list predictions."""
    by = list(by)
    per_label = multiclass_metrics(df, labels, by, label, prediction)
    macro = per_label.groupBy(*by).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"))
    pairs = label_pairs(df, by, label, prediction)
    totals = pairs.groupBy(*by).agg(
        F.sum("_n").alias("rows"),
        (F.sum(F.when(F.col("_t") == F.col("_p"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias(
            "accuracy"),
        F.sum(F.when(~F.col("_p").isin(labels), F.col("_n")).otherwise(0)).alias(
            "off_list_predictions"))
    if by:
        return join_on(totals, macro, by, "inner")
    packed = macro.select(F.struct("*").alias("_m"))
    return totals.withColumn("_m", packed.scalar()).select("*", "_m.*").drop("_m")


def confusion_matrix(df: DataFrame, labels: list[str], label: str = "true_label",
                     prediction: str = "predicted_label") -> DataFrame:
    """Rows = true label, one column per predicted label, zeros included."""
    cells = [F.count_if((F.col(label) == t) & (F.col(prediction) == p)).alias(f"{i}_{j}")
             for i, t in enumerate(labels) for j, p in enumerate(labels)]
    rows = F.array(*[F.struct(F.lit(t).alias("true_label"), *[
        F.col(f"{i}_{j}").alias(f"predicted_{p}") for j, p in enumerate(labels)])
        for i, t in enumerate(labels)])
    return df.agg(*cells).select(F.explode(rows).alias("_r")).select("_r.*")


def roc_auc(df: DataFrame, score: str = "hallucination_probability",
            label: str = "is_hallucinated") -> DataFrame:
    """Rank AUC with half credit for ties; null when one class is missing.  Null scores are left out.

    Rows collapse to distinct scores first; the running count of negatives uses
    bucket offsets instead of one global window.
    """
    dist = df.filter(F.col(score).isNotNull()).groupBy(
        F.col(score).cast("double").alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    placed = running_totals(dist, "_score", ["neg"])
    totals = placed.agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("_u"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return totals.select("positives", "negatives", F.when(
        (F.col("positives") > 0) & (F.col("negatives") > 0),
        F.col("_u") / (F.col("positives").cast("double") * F.col("negatives"))).alias("roc_auc"))


def metrics_by_dataset_and_total(df: DataFrame, dataset: str = "dataset_name",
                                 total: str = "combined") -> DataFrame:
    """Per dataset plus a combined row.

    Counts are additive, so the total comes from the per-dataset counts.
    """
    counts = df.groupBy(dataset).agg(F.count("*").alias("rows"), *confusion_counts())
    names = [c for c in counts.columns if c != dataset]
    both = counts.rollup(dataset).agg(
        F.grouping(dataset).alias("_g"), *[F.sum(c).alias(c) for c in names])
    return binary_rates(both.withColumn(
        dataset, F.when(F.col("_g") == 1, total).otherwise(F.col(dataset))).drop("_g"))


def probability_by_group(df: DataFrame, by: list[str]) -> DataFrame:
    base = df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.avg("hallucination_probability").alias("mean_hallucination_probability"),
        F.min("hallucination_probability").alias("minimum_probability"),
        F.max("hallucination_probability").alias("maximum_probability"),
        F.avg("predicted_label").alias("predicted_hallucination_rate"),
        F.avg((F.col("predicted_label") == F.col("is_hallucinated")).cast("int")).alias("accuracy"))
    median = exact_median(df, by, "hallucination_probability",
                          name="median_hallucination_probability")
    return join_on(base, median, by)


def accuracy_by_category(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy(category).agg(
        F.count("*").alias("rows"),
        F.avg((F.col("predicted_label") == F.col("is_hallucinated")).cast("int")).alias("accuracy"),
    ).orderBy("accuracy", category)


ERROR_NAMES = {
    "case": ("true_positive", "true_negative", "false_positive", "false_negative"),
    "detailed": ("true_positive_detected_hallucination", "true_negative_accepted_supported",
                 "false_positive_flagged_supported", "false_negative_missed_hallucination"),
    "stress": ("correct", "correct", "false_positive_supported_flagged",
               "false_negative_missed_hallucination"),
    "short": ("correct", "correct", "false_positive", "false_negative"),
}


def error_type(vocabulary: str = "case", label: Column | str = "is_hallucinated",
               prediction: Column | str = "predicted_label") -> Column:
    tp, tn, fp, fn = ERROR_NAMES[vocabulary]
    label = F.col(label) if isinstance(label, str) else label
    prediction = F.col(prediction) if isinstance(prediction, str) else prediction
    return (F.when((label == 1) & (prediction == 1), tp).when((label == 0) & (prediction == 0), tn)
            .when((label == 0) & (prediction == 1), fp).when((label == 1) & (prediction == 0), fn)
            .otherwise("unknown"))


def error_type_by_case(df: DataFrame, case: str = "case_type") -> DataFrame:
    return df.groupBy(case, "error_type").agg(F.count("*").alias("rows"))


def error_cases_enriched(predictions: DataFrame, metadata: DataFrame, source: DataFrame,
                         key: str = "id", source_key: str = "source_record_id") -> DataFrame:
    """Errors joined to their split metadata and source text.

    ``source_found`` is the completeness expectation: a false value means the
    source text is missing.
    """
    errors = predictions.filter(F.col("error_type") != "correct")
    text = source.withColumnRenamed("record_id", source_key).withColumn("_found", F.lit(True))
    return (errors.join(metadata, key, "left").join(text, source_key, "left")
            .withColumn("source_found", F.coalesce("_found", F.lit(False))).drop("_found"))


def error_shortlist(df: DataFrame, by: list[str], n: int = 5, confidence: str = "prediction_confidence",
                    key: str = "record_id") -> DataFrame:
    wrong = df.filter(F.col("error_type") != "correct")
    return top_n_per_group(wrong, by, [F.desc(confidence), key], n)


def false_accept_shortlist(predictions: DataFrame, trust: DataFrame,
                           key: str = "record_id") -> DataFrame:
    """Missed hallucinations, or answers accepted although risky."""
    joined = predictions.join(trust, key, "left")
    accepted = F.coalesce(F.col("recommended_action") == "accept", F.lit(False))
    hallucinated = F.col("is_hallucinated") == 1
    missed = hallucinated & ((F.col("predicted_label") == 0) | accepted)
    unsupported = accepted & (F.coalesce("unsupported_claim_count", F.lit(0)) > 0)
    return (joined.filter(missed | unsupported)
            .withColumn("error_type", error_type("detailed"))
            .orderBy("recommended_action", F.desc("clinical_trustworthiness_score"),
                     "hallucination_probability", key))


def weakest_claims(scored: DataFrame, key: str = "record_id",
                   score: str = "claim_support_score") -> DataFrame:
    return (scored.groupBy(key).agg(F.min_by(
        F.struct(F.col("claim_text").alias("weakest_claim_text"),
                 F.col(score).alias("weakest_claim_support_score")),
        F.struct(score, "claim_index")).alias("_w")).select(key, "_w.*"))


def tp_tn_fp_fn_examples(df: DataFrame, claims: DataFrame, n: int = 5, key: str = "record_id",
                         probability: str = "hallucination_probability",
                         text_limit: int = 350) -> DataFrame:
    """``n`` most extreme rows per outcome with their weakest claim.

    Predicted positives sort by falling, predicted negatives by rising
    probability; only the chosen few rows meet the claim table.
    """
    typed = df.withColumn("case_type", error_type("case"))
    signed = F.when(F.col("case_type").isin("true_positive", "false_positive"),
                    -F.col(probability)).otherwise(F.col(probability))
    chosen = top_n_per_group(typed.withColumn("_s", signed), ["case_type"], ["_s", key], n).drop("_s")
    picked = claims.join(chosen.select(key), key, "left_semi")
    return (chosen.join(weakest_claims(picked, key), key, "left")
            .withColumn("weakest_claim_text", F.when(
                F.col("weakest_claim_text").isNotNull(),
                tx.truncate_flat("weakest_claim_text", text_limit))))


# --- comparing models -------------------------------------------------------

OUTCOMES = ("fixed", "lost", "both_correct", "both_wrong")


def model_outcome_compare(base: DataFrame, tuned: DataFrame, key: str = "record_id",
                          label: str = "true_label", prediction: str = "predicted_label",
                          how: str = "inner", names=OUTCOMES) -> DataFrame:
    """Per row: fixed / lost / both correct / both wrong."""
    left = base.select(key, label, F.col(prediction).alias("base_prediction"))
    right = tuned.select(key, F.col(prediction).alias("tuned_prediction"))
    joined = (left.join(right, key, how)
              .withColumn("base_correct", F.coalesce(
                  F.col(label) == F.col("base_prediction"), F.lit(False)))
              .withColumn("tuned_correct", F.coalesce(
                  F.col(label) == F.col("tuned_prediction"), F.lit(False))))
    b, t = F.col("base_correct"), F.col("tuned_correct")
    return joined.withColumn("comparison_outcome", F.when(~b & t, names[0]).when(b & ~t, names[1])
                             .when(b & t, names[2]).otherwise(names[3]))


def outcome_counts(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count("*").alias("rows"), F.count_if("base_correct").alias("base_correct"),
        F.count_if("tuned_correct").alias("tuned_correct"), *[
            F.count_if(F.col("comparison_outcome") == o).alias(o) for o in OUTCOMES])


def model_disagreements(a: DataFrame, b: DataFrame, key: str = "record_id",
                        label: str = "is_hallucinated",
                        prediction: str = "predicted_label") -> DataFrame:
    left = a.select(key, label, F.col(prediction).alias("prediction_a"))
    right = b.select(key, F.col(prediction).alias("prediction_b"))
    joined = left.join(right, key)
    return joined.filter(F.col("prediction_a") != F.col("prediction_b"))


def same_false_negatives(a: DataFrame, b: DataFrame, key: str = "record_id",
                         label: str = "is_hallucinated",
                         prediction: str = "predicted_label") -> DataFrame:
    """Do both models miss exactly the same rows?  Sets compared by aggregation."""
    missed = lambda df, side: df.filter((F.col(label) == 1) & (F.col(prediction) == 0)).select(
        key, F.lit(side).alias("_side"))
    sides = missed(a, "a").unionAll(missed(b, "b")).groupBy(key).agg(
        F.max((F.col("_side") == "a").cast("int")).alias("_a"),
        F.max((F.col("_side") == "b").cast("int")).alias("_b"))
    return sides.agg(
        F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("missed_by_both"),
        F.count_if((F.col("_a") == 1) & (F.col("_b") == 0)).alias("missed_by_a_only"),
        F.count_if((F.col("_a") == 0) & (F.col("_b") == 1)).alias("missed_by_b_only"),
    ).withColumn("same_false_negatives", F.when(
        (F.col("missed_by_a_only") == 0) & (F.col("missed_by_b_only") == 0), "yes").otherwise("no"))


def disagreement_review(df: DataFrame, a: str = "model_a", b: str = "model_b",
                        label: str = "is_hallucinated") -> DataFrame:
    """Name who missed or over-flagged, and the action that follows."""
    pa, pb, truth = F.col("prediction_a"), F.col("prediction_b"), F.col(label)
    kind = (F.when((pa == 0) & (pb == 1) & (truth == 0), f"{b}_over_flagged_supported_answer")
            .when((pa == 0) & (pb == 1), f"{a}_missed_hallucination")
            .when((pa == 1) & (pb == 0) & (truth == 0), f"{a}_over_flagged_supported_answer")
            .when((pa == 1) & (pb == 0), f"{b}_missed_hallucination")
            .otherwise("no_disagreement"))
    return (df.withColumn("disagreement_type", kind)
            .withColumn("disagreement_recommended_action",
                        F.when(F.col("disagreement_type").contains("missed_hallucination"),
                               "mandatory_human_review")
                        .when(F.col("disagreement_type").contains("over_flagged"), "human_review")
                        .otherwise("accept")))


def model_leaderboard(predictions: DataFrame, model: str = "model") -> DataFrame:
    """One computed row per model, best accuracy first."""
    return binary_metrics(predictions, [model]).orderBy(F.desc("accuracy"), model)


def judge_predictions(df: DataFrame, raw: str = "raw_output", synonyms=None) -> DataFrame:
    """Judge output text -> support level, safety label and reason."""
    parsed = df.withColumn("_j", tx.json_extract_judgment(raw))
    return (parsed.withColumn("support_level", tx.support_normalise("_j.support_level", synonyms))
            .withColumn("judge_predicted_label", tx.support_to_safety("support_level"))
            .withColumn("judge_reason", F.col("_j.reason")).drop("_j"))


def judge_vs_baseline(judged: DataFrame, baseline: str = "predicted_label",
                      judge: str = "judge_predicted_label") -> DataFrame:
    """Metrics of both methods over their valid rows, from one pass."""
    long = judged.select("is_hallucinated", F.explode(F.array(
        F.struct(F.lit("baseline").alias("method"), F.col(baseline).alias("_p")),
        F.struct(F.lit("judge").alias("method"), F.col(judge).alias("_p")))).alias("_m")).select(
        "is_hallucinated", "_m.*")
    return binary_metrics(long, ["method"], prediction="_p")
