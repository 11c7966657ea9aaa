import random

import pytest
from pyspark.sql import functions as F

from assayer import terms
from assayer.operators import calibration as cb, metrics as mt, trust as tr

PREDICTIONS = "record_id string, predicted_label int, hallucination_probability double"
GROUNDING = ("record_id string, final_grounding_score double, final_unsupported_claim_count bigint, "
             "unsupported_high_impact_claim_count bigint")


def test_trust_score_and_fail_closed(spark):
    p = spark.createDataFrame([("a", 0, 0.1), ("b", 0, 0.1), ("c", 1, 1.0), ("d", 0, 0.0)], PREDICTIONS)
    g = spark.createDataFrame([("a", 1.0, 0, 0), ("c", 0.0, 9, 0), ("d", 0.9, 1, 0)], GROUNDING)
    got = {r["record_id"]: r for r in tr.trust_score(p, g).collect()}
    assert got["a"]["clinical_trustworthiness_score"] == pytest.approx(0.955)
    assert got["a"]["recommended_action"] == "accept"
    # missing grounding: null score, flagged, mandatory review
    assert got["b"]["clinical_trustworthiness_score"] is None and got["b"]["grounding_missing"]
    assert got["b"]["recommended_action"] == "mandatory_human_review"
    # unsupported claims are capped at three; score clamps at zero
    assert got["c"]["clinical_trustworthiness_score"] == pytest.approx(1 - .45 - .35 - .15)
    # predicted supported with an unsupported claim is a conflict
    assert got["d"]["contradiction_risk"] == 1 and got["d"]["recommended_action"] == "mandatory_human_review"


def test_argmax_ties_take_the_first_label(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (0.0, 2.0, 2.0)], "y double, n double, m double")
    got = tr.label_argmax_margin(df, {"yes": "y", "no": "n", "maybe": "m"}).collect()
    assert [(r["predicted_label"], r["confidence_margin"]) for r in got] == [("yes", 0.0), ("no", 0.0)]


CASE = dict(best_similarity=0.95, routing_action=terms.ROUTE_LOWER, safety_label="supported",
            evidence_label="yes", candidate_stance="yes", consistency_label="consistent",
            safety_margin=0.9, evidence_margin=0.9)


@pytest.mark.parametrize("change, kind", [
    ({}, "pass"),
    ({"best_similarity": 0.8996}, "pass"),                      # rounds to 0.900
    ({"best_similarity": 0.8994}, "review"),
    ({"best_similarity": None}, "review"),
    ({"best_similarity": 0.85, "consistency_label": "contradiction",
      "routing_action": terms.ROUTE_MANDATORY}, "mandatory"),   # similarity gate comes first
    ({"consistency_label": "contradiction"}, "fail"),
    ({"safety_label": "hallucinated", "safety_margin": 0.7496}, "fail"),   # rounds to 0.750
    ({"safety_label": "hallucinated", "safety_margin": 0.7494}, "review"),
    ({"evidence_margin": 0.5}, "review"),
    ({"evidence_label": "maybe"}, "review"),
])
def test_automatic_disposition(spark, change, kind):
    row = {**CASE, **change}
    df = spark.createDataFrame([tuple(row.values())], (
        "best_similarity double, routing_action string, safety_label string, evidence_label string, "
        "candidate_stance string, consistency_label string, safety_margin double, evidence_margin double"))
    assert df.select(tr.automatic_disposition()["kind"].alias("k")).first()["k"] == kind


def test_low_margin_reads_unrounded_values(spark):
    df = spark.createDataFrame([("ok then", "supported", "yes", 0.1499, 0.9, "consistent"),
                                ("ok then", "supported", "yes", 0.15, 0.9, "consistent"),
                                ("please consult", "supported", "yes", 0.9, 0.9, "consistent")],
                               "candidate_answer string, safety_label string, evidence_label string, "
                               "safety_margin double, evidence_margin double, consistency_label string")
    got = [(r["routing_action"], r["routing_reasons"]) for r in tr.route_case(df).collect()]
    assert got[0] == (terms.ROUTE_REVIEW, ["low_margin"])
    assert got[1] == (terms.ROUTE_LOWER, ["no_trigger_fired"])
    assert got[2] == (terms.ROUTE_REVIEW, ["possible_safe_refusal"])


def _loop_threshold(rows):
    """The definition: try every candidate margin, keep the widest safe one."""
    yes = [(m, t) for m, t, p in rows if p == "yes"]
    best, covered = None, 0
    for threshold in sorted({m for m, _ in yes}):
        accepted = [t for m, t in yes if m >= threshold]
        if len(accepted) > covered and "no" not in accepted:
            best, covered = threshold, len(accepted)
    return best


def test_calibration_closed_form_equals_the_loop(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for case in range(60):
        drawn = [(round(rng.random(), 1), rng.choice(["yes", "yes", "no", "maybe"]),
                  rng.choice(["yes", "no", "maybe"])) for _ in range(rng.randint(0, 12))]
        want[case] = _loop_threshold(drawn)
        rows.append(drawn)
    for case, drawn in enumerate(rows[:25]):
        df = spark.createDataFrame(drawn, "confidence_margin double, true_label string, predicted_label string")
        assert cb.calibrate_threshold(df).first()["threshold"] == want[case]


def test_gate_without_threshold_accepts_nothing(spark):
    df = spark.createDataFrame([(0.5, "no", "yes"), (0.4, "yes", "yes")],
                               "confidence_margin double, true_label string, predicted_label string")
    t = cb.calibrate_threshold(df)
    row = cb.gate_summary(cb.apply_gate(df, t.scalar())).first()
    assert (t.first()["threshold"], row["accepted_rows"], row["accepted_accuracy"]) == (None, 0, None)


# fixed values: published confusion counts (tn, fp, fn, tp) and rates of a threshold sweep
SWEEP = [
    (0.30, 369, 1631, 21, 1979, 0.587, 0.5481994459833796, 0.9895, 0.7055258467023173),
    (0.35, 599, 1401, 55, 1945, 0.636, 0.5812910938433951, 0.9725, 0.7276468387579499),
    (0.40, 884, 1116, 118, 1882, 0.6915, 0.627751834556371, 0.941, 0.7531012404961985),
    (0.45, 1220, 780, 262, 1738, 0.7395, 0.6902303415409055, 0.869, 0.7693669765382912),
    (0.50, 1534, 466, 478, 1522, 0.764, 0.7655935613682092, 0.761, 0.7632898696088265),
    (0.55, 1769, 231, 791, 1209, 0.7445, 0.8395833333333333, 0.6045, 0.702906976744186),
    (0.60, 1896, 104, 1123, 877, 0.69325, 0.8939857288481141, 0.4385, 0.5883931566588393),
    (0.65, 1963, 37, 1474, 526, 0.62225, 0.9342806394316163, 0.263, 0.4104564962934062),
    (0.70, 1993, 7, 1717, 283, 0.569, 0.9758620689655172, 0.1415, 0.24716157205240175),
]


def test_published_sweep(spark):
    """Rows built from the published counts must sweep to the published rates."""
    rows, previous = [], None
    low, high = SWEEP[0], SWEEP[-1]
    rows += [(0.0, 0)] * low[1] + [(0.0, 1)] * low[3]
    for a, b in zip(SWEEP, SWEEP[1:]):
        rows += [(a[0], 0)] * (b[1] - a[1]) + [(a[0], 1)] * (b[3] - a[3])
    rows += [(high[0], 0)] * high[2] + [(high[0], 1)] * high[4]
    df = spark.createDataFrame(rows, "hallucination_probability double, is_hallucinated int")
    got = cb.threshold_sweep(df, [s[0] for s in SWEEP]).orderBy("threshold").collect()
    for r, s in zip(got, SWEEP):
        assert (r["true_negatives"], r["false_positives"], r["false_negatives"],
                r["true_positives"]) == s[1:5]
        assert (r["accuracy"], r["precision"], r["recall"], r["f1_score"]) == pytest.approx(s[5:])


def test_undefined_rates_are_zero_and_macro_skips_off_list(spark):
    df = spark.createDataFrame([(1, 0), (1, 0)], "is_hallucinated int, predicted_label int")
    row = mt.binary_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1_score"]) == (0.0, 0.0, 0.0)
    three = spark.createDataFrame([("yes", "maybe"), ("yes", "yes"), ("no", "no")],
                                  "true_label string, predicted_label string")
    s = mt.multiclass_summary(three, ["yes", "no"]).first()
    assert s["macro_recall"] == pytest.approx(0.75) and s["off_list_predictions"] == 1
    assert s["accuracy"] == pytest.approx(2 / 3)


def test_alignment_checks(spark):
    schema = "record_id string, true_label string"
    a = spark.createDataFrame([("1", "yes"), ("2", "no"), ("2", "no"), ("3", "yes")], schema)
    b = spark.createDataFrame([("1", "no"), ("2", "no"), ("4", "yes")], schema)
    row = cb.alignment_checks(a, b).first()
    assert (row["matched_keys"], row["duplicated_keys"], row["unmatched_a"], row["unmatched_b"],
            row["label_mismatches"], row["passed"]) == (2, 1, 1, 1, 1, False)


def test_logic_aware_action(spark):
    df = spark.createDataFrame(
        [("Which is not true?", "accept", 0.1, 0.9, 0.9, 0), ("Plain?", "accept", 0.1, 0.9, 0.9, 0),
         ("Plain?", "", 0.1, 0.9, 0.9, 0), ("Plain?", "accept", 0.8, 0.9, 0.9, 0)],
        "question string, tuned_recommended_action string, hallucination_probability double, "
        "clinical_trustworthiness_score double, semantic_grounding_score double, unsupported_claim_count int")
    got = [r["a"] for r in df.select(tr.logic_aware_action().alias("a")).collect()]
    assert got == ["mandatory_human_review", "accept", "human_review", "mandatory_human_review"]


def test_actions_form_a_closed_set(spark):
    p = spark.range(500).select(F.col("id").cast("string").alias("record_id"),
                                (F.col("id") % 2).cast("int").alias("predicted_label"),
                                (F.col("id") % 101 / 100).alias("hallucination_probability"))
    g = p.select("record_id", (F.col("hallucination_probability") * 1.3 - 0.1).alias("final_grounding_score"),
                 (F.col("record_id").cast("int") % 5).alias("final_unsupported_claim_count"),
                 F.lit(0).alias("unsupported_high_impact_claim_count"))
    scored = tr.trust_score(p, g)
    bad = scored.filter("clinical_trustworthiness_score < 0 or clinical_trustworthiness_score > 1 or "
                        "recommended_action not in ('accept','revise','human_review','mandatory_human_review')")
    assert bad.count() == 0
