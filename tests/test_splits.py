import pytest
from pyspark.sql import functions as F

from assayer.operators import expect as ex, normalize as nz, splits as sp


@pytest.fixture(scope="module")
def rows(spark):
    """Group g0 holds a third of the rows; g9 has one label only."""
    data = [(f"r{i:04d}", "g0" if i % 3 == 0 else ("g9" if i % 10 == 9 else f"g{i % 5 + 1}"),
             1 if i % 10 == 9 and i % 3 else i % 2, ["yes", "no", "maybe"][i % 3 if i % 4 else 0])
            for i in range(600)]
    return spark.createDataFrame(data, "record_id string, question_group_id string, "
                                       "is_hallucinated int, label string")


def test_balanced_pairs_drop_one_sided_groups(rows):
    pairs = sp.balanced_pairs_per_group(rows).collect()
    by_group = {}
    for r in pairs:
        by_group.setdefault(r["question_group_id"], []).append((r["is_hallucinated"], r["record_id"]))
    assert "g9" not in by_group
    assert all(sorted(l for l, _ in v) == [0, 1] for v in by_group.values())
    lowest = rows.filter("question_group_id = 'g0' and is_hallucinated = 0").agg(F.min("record_id")).first()[0]
    assert (0, lowest) in by_group["g0"]


def test_choose_groups_is_deterministic_and_strict(rows):
    groups = lambda df: sorted(r[0] for r in df.select("question_group_id").distinct().collect())
    first = groups(sp.choose_groups(rows.repartition(1), 3))
    assert first == groups(sp.choose_groups(rows.repartition(64), 3)) and len(first) == 3
    assert groups(sp.choose_groups(rows, 3, seed=7)) != first
    with pytest.raises(Exception, match="requested 99 groups, found"):
        sp.choose_groups(rows, 99).count()


def test_holdout_never_shares_a_group_with_training(rows):
    train = rows.filter("question_group_id in ('g1', 'g2')").limit(30)
    held = sp.unseen_holdout(rows, train, 2)
    assert held.join(train, "question_group_id", "left_semi").count() == 0
    assert held.count() == 4


def test_rank_splits_cover_and_are_disjoint(rows):
    quotas = {"test": {"yes": (1, 10), "no": (1, 10)}, "train": {"yes": (11, None), "no": (11, None)}}
    out = sp.rank_range_split(rows, quotas)
    assert out.count() == out.select("record_id").distinct().count() == rows.filter("label != 'maybe'").count()
    assert out.filter("split = 'test'").groupBy("label").count().filter("count = 10").count() == 2


def test_fraction_split_keeps_label_shares(rows):
    out = sp.stratified_fraction_split(rows, {"train": .6, "validation": .2, "test": .2})
    assert out.count() == 600
    for r in out.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("t")).collect():
        assert r["t"] == int(r["n"] * 0.6)


def test_quota_remainder_goes_to_the_first_labels(rows):
    got = {r["label"]: r["count"] for r in sp.stratified_quota_sample(rows, 50).groupBy("label").count().collect()}
    assert got == {"maybe": 17, "no": 17, "yes": 16}


def test_group_split_keeps_groups_together(rows):
    out = sp.group_shuffle_split(rows, "question_group_id")
    assert out.groupBy("question_group_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_strict_class_sample_fails_when_short(rows):
    assert sp.balanced_class_sample(rows, 5, ["label"]).count() == 15
    with pytest.raises(Exception, match="class smaller than"):
        sp.balanced_class_sample(rows, 900, ["label"], strict=True).collect()


def test_leakage_matrix(rows):
    clean = sp.group_shuffle_split(rows, "question_group_id")
    assert [r["passed"] for r in sp.split_leakage_matrix(clean, ["train", "test"]).collect()] == [True]
    dirty = clean.unionByName(clean.filter("split = 'train'").limit(1).withColumn("split", F.lit("test")))
    row = sp.split_leakage_matrix(dirty, ["train", "test"]).first()
    assert (row["shared_groups"], row["passed"]) == (1, False)


def test_sequential_ids(rows):
    out = sp.sequential_case_ids(rows.withColumn("split", F.lit("test")), ["question_group_id", "record_id"])
    ids = [r["id"] for r in out.orderBy("question_group_id", "record_id").select("id").collect()]
    assert ids == [f"test_{i:05d}" for i in range(1, 601)]


def test_category_sample_removes_duplicates(spark):
    tags = spark.createDataFrame([("a", "x", "p"), ("a", "x", "p"), ("b", "x", "q")],
                                 "record_id string, fairness_category string, prompt_a string")
    assert sp.category_review_sample(tags).count() == 2


def test_incremental_todo(rows):
    assert sp.incremental_todo(rows, rows.limit(100)).count() == 500


def test_unknown_label_fails(spark):
    df = spark.createDataFrame([(0,), (2,)], "v int")
    with pytest.raises(Exception, match="unexpected label"):
        df.select(nz.label_map("v")).collect()
    with pytest.raises(Exception, match="unexpected stance"):
        spark.createDataFrame([("maybe",)], "s string").select(nz.opposite_stance("s")).collect()


def test_repair_violations(spark):
    cases = spark.createDataFrame([(1, "hallucinated", "a"), (2, "supported", "b"), (3, "hallucinated", "c"),
                                   (3, "hallucinated", "d")], "case_id int, expected_label string, candidate_answer string")
    fixes = spark.createDataFrame([(1, "n1"), (2, "n2"), (3, "n3"), (9, "n9")], "case_id int, candidate_answer string")
    bad = {r["case_id"]: (r["matched_rows"], r["wrong_label_rows"]) for r in nz.repair_violations(cases, fixes).collect()}
    assert bad == {2: (1, 1), 3: (2, 0), 9: (0, 0)}
    fixed = {r["case_id"]: r for r in nz.repair_overlay(cases.filter("case_id < 3"), fixes).collect()}
    assert fixed[1]["candidate_answer"] == "n1" and fixed[2]["candidate_answer"] == "b"


def test_expectations(spark, rows):
    check = ex.label_balance_check(rows, ["question_group_id"], "is_hallucinated", [0, 1])
    assert check.filter("question_group_id = 'g9'").first()["passed"] is False
    contract = ex.schema_contract(rows, ["record_id", "nope"], "rows", min_rows=1000)
    failed = {r["check_name"] for r in contract.filter("not passed").collect()}
    assert failed == {"column:nope", "row_count"}
    assert ex.closed_vocabulary(rows, "label", ["yes", "no"]).first()["value"] == "maybe"
    assert ex.unique_key_check(rows.unionByName(rows.limit(1)), "record_id").first()[0] == 1
    meta = rows.filter("record_id != 'r0001'")
    assert ex.index_consistency(rows, meta, "record_id").first()["passed"] is False
