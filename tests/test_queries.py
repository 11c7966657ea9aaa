"""Every registered query against its SQL, and properties of the plans."""

import os
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", [k for k in QUERIES if k in ORACLE])
def test_query_equals_sql(spark, con, key):
    problem = compare(QUERIES[key](spark, SF), ORACLE[key], con)
    assert problem in (None, "both empty")


@pytest.mark.parametrize("key", [k for k in QUERIES if k not in ORACLE])
def test_query_has_rows(spark, key):
    assert QUERIES[key](spark, SF).count() > 0


def test_flagship(spark):
    actions = {r["recommended_action"] for r in entry.entry(spark).collect()}
    assert actions and actions <= {"accept", "revise", "human_review", "mandatory_human_review"}


@pytest.mark.parametrize("key", [
    "claim_grounding_rollup", "trust_action", "confidence_gate", "topk_retrieve", "roc_auc",
    "rank_range_split", "policy_comparison", "template_substitute", "split_leakage_matrix"])
def test_no_nested_loops(spark, key):
    plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoop", plan)


def test_claims_are_split_once(spark):
    plan = QUERIES["trust_action"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1


def test_text_scan_reads_needed_columns_only(spark):
    plan = QUERIES["split_claims"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schemas = [set(c.split(":")[0] for c in m.split(",")) for m in
               re.findall(r"ReadSchema: struct<([^>]*)>", plan)]
    assert {"doc_id", "text", "lang"} in schemas          # documents: no source, no n_chars
    assert all(s <= {"doc_id", "text", "lang", "item_id", ""} for s in schemas)


def test_cell_recall_of_given_rows(spark):
    from assayer.plans import views as v
    rows = sorted((r["vec_id"], list(r["embedding"])) for r in v.vectors(spark, SF).collect())
    m = np.array([x for _, x in rows], float)
    near = (m[[i for i, (k, _) in enumerate(rows) if k % 20 == 0]] @ m.T).round(12) >= 0.30
    got = QUERIES["topk_retrieve_cells"](spark, SF).first()
    assert got["expected"] == np.minimum(near.sum(1), 3).sum() > near.any(1).sum()
    assert got["recall"] >= 0.9 and round(got["found"] / got["expected"], 9) == got["recall"]


def test_logged_cases_are_never_broadcast(spark):
    plan = QUERIES["stream_case_disposition"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_unseen_holdout_takes_ten_groups(spark):
    rows = QUERIES["unseen_holdout"](spark, SF).collect()
    assert len({r["question_group_id"] for r in rows}) == 10 and len(rows) == 20
