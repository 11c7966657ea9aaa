"""Writes that publish a table only if its expectations hold."""

import os
import re

import pytest
from pyspark.sql import functions as F

from assayer.operators import checked as ck, splits as sp
from assayer.sources import writers

CASES = [(1, "hallucinated", "no"), (2, "supported", "yes"), (3, "hallucinated", "no"), (4, "hallucinated", "no"), (4, "hallucinated", "no")]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(CASES, "case_id long, expected_label string, candidate_answer string")


def _repairs(spark, *ids):
    return spark.createDataFrame([(i, f"repaired {i}") for i in ids], "case_id long, candidate_answer string")


def test_good_overrides_are_published(spark, cases, tmp_path):
    path = str(tmp_path / "good")
    ck.write_repaired(cases, _repairs(spark, 1, 3), path)
    rows = spark.read.parquet(path)
    assert sorted(rows.columns) == ["candidate_answer", "case_id", "expected_label", "semantic_audit_status"]
    assert sorted((r["case_id"], r["candidate_answer"]) for r in rows.collect()) == [
        (1, "repaired 1"), (2, "yes"), (3, "repaired 3"), (4, "no"), (4, "no")]
    with pytest.raises(ValueError, match="exists"):
        ck.write_repaired(cases, _repairs(spark, 1), path)


@pytest.mark.parametrize("ids,bad", [((1, 2), {2: (1, 1)}), ((1, 9), {9: (0, 0)}), ((4,), {4: (2, 0)}),
                                     ((4, 9), {4: (2, 0), 9: (0, 0)})])
def test_a_bad_override_stops_the_write(spark, cases, tmp_path, ids, bad):
    """The wrong label, no row, two rows, and two mistakes at once: nothing appears, and the error names them."""
    with pytest.raises(ck.ExpectationFailed) as stopped:
        ck.write_repaired(cases, _repairs(spark, *ids), str(tmp_path / "bad"))
    # an override that hits two rows doubles neither of them: both are there, twice each with that id
    found = {r["case_id"]: (r["matched_rows"], r["wrong_label_rows"]) for r in stopped.value.found}
    assert found == bad
    assert os.listdir(tmp_path) == []


def test_any_measure_can_stop_a_write(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.when(F.col("id") % 10 > 0, F.col("id")))
    with pytest.raises(ck.ExpectationFailed, match="'nulls': 10"):
        ck.write_checked(df, str(tmp_path / "a"), {"nulls": F.count_if(F.col("x").isNull()), "negative": F.count_if(F.col("id") < 0)})
    assert os.listdir(tmp_path) == []
    ck.write_checked(df, str(tmp_path / "b"), {"negative": F.count_if(F.col("id") < 0)}, lambda rows: rows.filter("id > 99"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 100


def test_short_classes_and_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "c string, record_id int")
    assert [tuple(r) for r in ck.class_shortfalls(df, 2, ["c"]).collect()] == [("b", 1, 1)]
    assert [tuple(r) for r in ck.group_shortfall(df, 3, "c").collect()] == [(2, 1)]
    assert ck.group_shortfall(df, 2, "c").count() == 0
    with pytest.raises(Exception, match="class smaller than 2"):
        sp.balanced_class_sample(df, 2, ["c"], strict=True).collect()


def test_bucketed_history_is_not_shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = writers.write_bucketed(spark.range(0, 5000).withColumnRenamed("id", "record_id"), "record_id", buckets=4)
        todo = sp.incremental_todo(spark.range(4990, 5010).withColumnRenamed("id", "record_id"), done)
        assert sorted(r["record_id"] for r in todo.collect()) == list(range(5000, 5010))
        plan = todo._jdf.queryExecution().executedPlan().toString()
        history = plan[plan.rindex("FileScan parquet") - 400:]
        assert "SortMergeJoin" in plan and "Bucketed: true" in history
        between = plan[plan.index("SortMergeJoin"):]
        # one exchange: that of the new rows
        assert len(re.findall(r"Exchange hashpartitioning", between.split("== Initial Plan ==")[0])) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
