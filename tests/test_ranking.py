import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import metrics as mt, ranking as rk


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, one null group, many equal values."""
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"g{i % 5}"),
             round(rng.random(), 2), int(rng.random() < 0.4)) for i in range(3000)]
    return spark.createDataFrame(rows, "id int, g string, v double, y int").repartition(7), rows


def test_hash_rank_matches_definition(skewed):
    df, rows = skewed
    got = {r["id"]: (r["rank"], r["n"]) for r in rk.hash_rank(
        df, "id", by=["g"], hex_digits=2, total="n").collect()}
    digest = lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest()
    for group in {r[1] for r in rows}:
        ids = sorted((r[0] for r in rows if r[1] == group), key=digest)
        assert [got[i] for i in ids] == [(k + 1, len(ids)) for k in range(len(ids))]


def test_sorted_rank_matches_definition(skewed):
    df, rows = skewed
    got = {r["id"]: r["rank"] for r in rk.sorted_rank(df, ["v", "id"], by=["g"]).collect()}
    for group in {r[1] for r in rows}:
        ids = [r[0] for r in sorted((r for r in rows if r[1] == group), key=lambda r: (r[2], r[0]))]
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


@pytest.mark.parametrize("parts", [1, 64])
def test_ranks_do_not_depend_on_partitioning(skewed, parts):
    df, _ = skewed
    base = sorted(map(tuple, rk.hash_rank(df, "id", by=["g"]).select("id", "rank").collect()))
    again = rk.hash_rank(df.repartition(parts), "id", by=["g"]).select("id", "rank").collect()
    assert sorted(map(tuple, again)) == base


def test_exact_median(skewed):
    df, rows = skewed
    got = {r["g"]: r["median"] for r in rk.exact_median(df, ["g"], "v").collect()}
    for group, value in got.items():
        assert value == pytest.approx(np.median([r[2] for r in rows if r[1] == group]))


def test_exact_median_outside_the_expected_range(spark):
    df = spark.createDataFrame([(float(x),) for x in (-50, 3, 900, 901)], "v double")
    assert rk.exact_median(df, [], "v").first()["median"] == 451.5


def test_top_n_limits_before_the_exchange(skewed):
    df, rows = skewed
    top = rk.top_n_per_group(df, ["g"], [F.desc("v"), "id"], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert top.filter("g = 'hot'").count() == 3


def test_top_n_of_any_size(spark):
    df = spark.range(0, 24_000, numPartitions=7).selectExpr("id", "CAST(id % 2 AS string) AS g", "-id AS v")
    got = rk.top_n_per_group(df, ["g"], ["v"], 5000, rank="rank")
    assert sorted((r["g"], r["n"], r["lo"]) for r in got.groupBy("g").agg(
        F.count("*").alias("n"), F.min("id").alias("lo")).collect()) == [("0", 5000, 14000), ("1", 5000, 14001)]
    assert got.filter("g = '1' AND rank = 5000").first()["id"] == 14001


def test_values_in_a_narrow_range_spread_over_bins(spark):
    df = spark.range(20_000).select((F.lit(0.999) + F.col("id") * 1e-11).alias("v"))
    sizes = [r["count"] for r in rk.with_bins(df, "v", 64).groupBy("_b").count().collect()]
    assert len(sizes) > 48 and max(sizes) < 4 * 20_000 / 64
    assert rk.exact_median(df, [], "v").first()["median"] == pytest.approx(0.999 + 9999.5e-11, abs=1e-13)
    assert rk.exact_median(df.limit(0), [], "v").first()["median"] is None


def test_auc_leaves_null_scores_out(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 0), (None, 0)], "v double, y int")
    got = mt.roc_auc(df, "v", "y").first()
    assert (got["roc_auc"], got["negatives"]) == (1.0, 1)


def test_roc_auc_against_all_pairs(skewed, spark):
    df, rows = skewed
    got = mt.roc_auc(df, "v", "y").first()["roc_auc"]
    pos = np.array([r[2] for r in rows if r[3] == 1])
    neg = np.array([r[2] for r in rows if r[3] == 0])
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert got == pytest.approx(want)
    assert mt.roc_auc(df.withColumn("y", F.lit(1)), "v", "y").first()["roc_auc"] is None
