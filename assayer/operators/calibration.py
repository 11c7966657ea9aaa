"""Thresholds chosen on validation rows and applied elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.operators.metrics import binary_rates


def calibrate_threshold(df: DataFrame, margin: str = "confidence_margin",
                        eligible: Column | None = None, unsafe: Column | None = None,
                        name: str = "threshold") -> DataFrame:
    """Widest coverage of predicted-yes rows with no true-no among them.

    Closed form: the lowest margin above the largest unsafe margin.  One pass:
    unsafe maximum and candidate margins are reduced per margin value first.
    """
    eligible = F.col("predicted_label") == "yes" if eligible is None else eligible
    unsafe = F.col("true_label") == "no" if unsafe is None else unsafe
    per_margin = (df.filter(eligible).groupBy(F.col(margin).alias("_m"))
                  .agg(F.max(unsafe).alias("_unsafe")))
    worst = per_margin.agg(F.max(F.when(F.col("_unsafe"), F.col("_m"))).alias("_w"))
    return per_margin.agg(F.min(F.when(
        F.col("_m") > F.coalesce(worst.scalar(), F.lit(float("-inf"))), F.col("_m"))).alias(name))


def apply_gate(df: DataFrame, threshold: Column, margin: str = "confidence_margin",
               eligible: Column | None = None) -> DataFrame:
    """provisional_accept at or above the threshold, human_review otherwise."""
    eligible = F.col("predicted_label") == "yes" if eligible is None else eligible
    accept = F.coalesce(eligible & (F.col(margin) >= threshold), F.lit(False))
    return df.withColumn("routing_decision", F.when(accept, "provisional_accept")
                         .otherwise("human_review"))


def gate_summary(routed: DataFrame, by: list[str] = (), correct: Column | None = None,
                 unsafe: Column | None = None) -> DataFrame:
    """Coverage, accuracy of accepted rows (null if none) and unsafe accepts."""
    correct = F.col("true_label") == F.col("predicted_label") if correct is None else correct
    unsafe = F.col("true_label") == "no" if unsafe is None else unsafe
    accepted = F.col("routing_decision") == "provisional_accept"
    out = routed.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(accepted).alias("accepted_rows"),
        F.count_if(accepted & correct).alias("_correct"),
        F.count_if(accepted & unsafe).alias("unsafe_false_accepts"))
    return (out.withColumn("human_review_rows", F.col("rows") - F.col("accepted_rows"))
            .withColumn("automated_coverage", F.col("accepted_rows") / F.col("rows"))
            .withColumn("accepted_accuracy", F.when(
                F.col("accepted_rows") > 0, F.col("_correct") / F.col("accepted_rows")))
            .drop("_correct"))


def align_predictions(a: DataFrame, b: DataFrame, key: str = "record_id",
                      label: str = "true_label", prediction: str = "predicted_label",
                      margin: str = "confidence_margin") -> DataFrame:
    """Join two models' predictions one to one."""
    left = a.select(key, F.col(label).alias("true_label"),
                    F.col(prediction).alias("prediction_a"), F.col(margin).alias("margin_a"))
    right = b.select(key, F.col(label).alias("true_label_b"), F.col(prediction).alias("prediction_b"))
    return left.join(right, key).withColumn(
        "models_agree", F.col("prediction_a") == F.col("prediction_b"))


def alignment_checks(a: DataFrame, b: DataFrame, key: str = "record_id",
                     label: str = "true_label") -> DataFrame:
    """Expectation row: unique keys, no unmatched rows, equal truth."""
    sides = (a.select(key, F.col(label).alias("_a"), F.lit(None).cast(a.schema[label].dataType).alias("_b"),
                      F.lit(1).alias("_na"), F.lit(0).alias("_nb"))
             .unionAll(b.select(key, F.lit(None).cast(b.schema[label].dataType).alias("_a"),
                                F.col(label).alias("_b"), F.lit(0).alias("_na"),
                                F.lit(1).alias("_nb"))))
    per_key = sides.groupBy(key).agg(
        F.max("_a").alias("_a"), F.max("_b").alias("_b"),
        F.sum("_na").alias("_na"), F.sum("_nb").alias("_nb"))
    both = (F.col("_na") > 0) & (F.col("_nb") > 0)
    return per_key.agg(
        F.count_if(both).alias("matched_keys"),
        F.count_if((F.col("_na") > 1) | (F.col("_nb") > 1)).alias("duplicated_keys"),
        F.count_if(F.col("_nb") == 0).alias("unmatched_a"),
        F.count_if(F.col("_na") == 0).alias("unmatched_b"),
        F.count_if(both & (F.col("_a") != F.col("_b"))).alias("label_mismatches"),
    ).withColumn("passed", (F.col("duplicated_keys") == 0) & (F.col("unmatched_a") == 0)
                 & (F.col("unmatched_b") == 0) & (F.col("label_mismatches") == 0))


def agreement_gate(aligned: DataFrame, threshold: Column) -> DataFrame:
    """Accept only where both models say yes and model a is confident enough."""
    both = (F.col("prediction_a") == "yes") & (F.col("prediction_b") == "yes")
    return apply_gate(aligned, threshold, "margin_a", both)


def agreement_threshold(aligned: DataFrame) -> DataFrame:
    both = (F.col("prediction_a") == "yes") & (F.col("prediction_b") == "yes")
    return calibrate_threshold(aligned, "margin_a", both)


def agreement_summary(routed: DataFrame, by: list[str] = ()) -> DataFrame:
    gate = gate_summary(routed, by, correct=F.col("true_label") == "yes")
    agree = routed.groupBy(*by).agg(
        F.count_if("models_agree").alias("model_agreement_rows"),
        F.avg(F.col("models_agree").cast("int")).alias("model_agreement_rate"))
    if not by:
        pick = agree.select(F.struct("*").alias("_a"))
        return gate.withColumn("_a", pick.scalar()).select("*", "_a.*").drop("_a")
    return gate.join(agree, list(by))


def threshold_sweep(df: DataFrame, thresholds: list[float], score: str = "hallucination_probability",
                    label: str = "is_hallucinated", below_is_positive: bool = False,
                    by: list[str] = ()) -> DataFrame:
    """Confusion counts and rates at every threshold, in one pass.

    A row only adds to one bin (how many thresholds it clears); the bins, not
    the rows, are accumulated per threshold.  ``below_is_positive`` flips the
    rule to "score < threshold predicts 1".
    """
    cuts = sorted(thresholds)
    edges = F.array(*[F.lit(float(t)) for t in cuts])
    by = list(by)
    binned = df.withColumn("_bin", F.size(F.filter(edges, lambda t: F.col(score) >= t)))
    bins = binned.groupBy(*by, "_bin").agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    table = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(i + 1).alias("_need"))
                      for i, t in enumerate(cuts)])
    spread = bins.select(*by, "_bin", "_p", "_n", F.explode(table).alias("_t")).select(
        *by, "_bin", "_p", "_n", "_t.*")
    cleared = F.col("_bin") >= F.col("_need")
    positive = ~cleared if below_is_positive else cleared
    add = lambda c, hit: F.sum(F.when(hit, F.col(c)).otherwise(0))
    counted = spread.groupBy(*by, "threshold").agg(
        add("_n", ~positive).alias("true_negatives"), add("_n", positive).alias("false_positives"),
        add("_p", ~positive).alias("false_negatives"), add("_p", positive).alias("true_positives"))
    return binary_rates(counted)


def threshold_select_train_test(train: DataFrame, test: DataFrame, thresholds: list[float],
                                score: str, label: str = "is_hallucinated",
                                below_is_positive: bool = True) -> DataFrame:
    """Best F1 then accuracy (then lowest threshold) on train, metrics on test."""
    sweep = threshold_sweep(train, thresholds, score, label, below_is_positive)
    best = sweep.agg(F.max_by("threshold", F.struct(
        F.col("f1_score"), F.col("accuracy"), -F.col("threshold"))).alias("_t"))
    chosen = test.withColumn("_t", best.scalar())
    positive = (F.col(score) < F.col("_t")) if below_is_positive else (F.col(score) >= F.col("_t"))
    counted = chosen.groupBy(F.col("_t").alias("threshold_selected_on_train")).agg(
        F.count("*").alias("test_rows"),
        F.count_if(~positive & (F.col(label) == 0)).alias("true_negatives"),
        F.count_if(positive & (F.col(label) == 0)).alias("false_positives"),
        F.count_if(~positive & (F.col(label) == 1)).alias("false_negatives"),
        F.count_if(positive & (F.col(label) == 1)).alias("true_positives"))
    return binary_rates(counted).withColumn(
        "train_rows", train.agg(F.count("*").alias("n")).scalar())
