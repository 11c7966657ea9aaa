"""Tables that appear only if their expectations hold.

Rows go to a folder beside the target first.  What was written is then measured, reading only the columns that
the measures need, and the folder takes the target's name if all is in order; otherwise it is removed.
The table is computed once, and the measures see what was written, however often a task ran.
(``Observation`` would count in the writing pass itself, but in Spark 4.1 it leaves an object in the session
that later ML models cannot send to their tasks.)
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from assayer.operators.normalize import repair_overlay, repair_violations
from assayer.sources.writers import write_table

SHOWN = 20


class ExpectationFailed(ValueError):
    """A table was not published; ``found`` has the measures, or rows, that break an expectation."""

    def __init__(self, path: str, found: dict | list):
        super().__init__(f"{path} not written: {found}")
        self.found = found


def write_checked(df: DataFrame, path: str, zero: dict[str, Column] | None = None,
                  none: Callable[[DataFrame], DataFrame] | None = None, partition_by: list[str] = ()) -> None:
    """Write Parquet and publish it if every aggregate in ``zero`` is 0 and ``none(written)`` has no rows."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    staging = jvm.org.apache.hadoop.fs.Path(f"{path}.staging-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise ValueError(f"{path} exists")
    try:
        write_table(df, staging.toString(), "parquet", list(partition_by))
        written = spark.read.schema(df.schema).parquet(staging.toString())
        if zero:
            measured = written.agg(*[c.alias(name) for name, c in zero.items()]).first().asDict()
            if wrong := {name: n for name, n in measured.items() if n}:
                raise ExpectationFailed(path, wrong)
        if none and (rows := [r.asDict() for r in none(written).take(SHOWN)]):
            raise ExpectationFailed(path, rows)
        if not fs.rename(staging, target):
            raise OSError(f"cannot publish {path}")
    finally:
        fs.delete(staging, True)


def write_repaired(df: DataFrame, repairs: DataFrame, path: str, key: str = "case_id",
                   answer: str = "candidate_answer", label: str = "expected_label",
                   only_label: str = "hallucinated", **options) -> None:
    """Write ``repair_overlay`` if every override hits exactly one row, of the right label.

    Ids and labels of the written rows are compared with the overrides; the error names those that fail.
    """
    write_checked(repair_overlay(df, repairs, key, answer, label, only_label), path,
                  none=lambda written: repair_violations(written.select(key, label), repairs, key, label, only_label),
                  **options)


def class_shortfalls(df: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Classes that cannot give ``n`` rows, and how many are missing."""
    return (df.groupBy(*by).agg(F.count("*").alias("rows")).filter(F.col("rows") < n)
            .withColumn("missing", F.lit(n) - F.col("rows")))


def group_shortfall(df: DataFrame, n: int, group: str = "question_group_id") -> DataFrame:
    """One row if there are fewer than ``n`` groups."""
    return df.agg(F.count_distinct(group).alias("groups")).filter(F.col("groups") < n).withColumn(
        "missing", F.lit(n) - F.col("groups"))
