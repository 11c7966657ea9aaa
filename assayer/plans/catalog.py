"""All registered queries in one place."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from assayer.plans.registry import REGISTRY, Query

MODULES = [
    "q_sources", "q_normalize", "q_text", "q_splits", "q_grounding", "q_retrieval", "q_trust",
    "q_calibration", "q_metrics", "q_classify", "q_review", "q_stream",
]


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"assayer.plans.{module}")
    return dict(REGISTRY)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_queries()["trust_action"].run(spark, sf_dir)
