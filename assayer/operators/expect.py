"""Expectations: checks that return rows instead of aborting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType


def label_balance_check(df: DataFrame, by: list[str], label: str, labels: list,
                        expected: int | None = None) -> DataFrame:
    """Per group: label counts, equal to each other (or to ``expected``)."""
    counts = [F.count_if(F.col(label) == v).alias(f"count_{v}") for v in labels]
    out = df.groupBy(*by).agg(F.count("*").alias("rows"), *counts)
    names = [F.col(f"count_{v}") for v in labels]
    wanted = F.lit(expected) if expected is not None else names[0]
    passed = names[0] == wanted
    for c in names[1:]:
        passed = passed & (c == wanted)
    return out.withColumn("passed", passed)


def schema_contract(df: DataFrame, required: StructType | list[str], table: str,
                    min_rows: int = 1) -> DataFrame:
    """One row per check: required columns, their types, null-free keys, row count."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    spark, checks = df.sparkSession, []
    fields = ([(f.name, f.dataType.simpleString()) for f in required.fields]
              if isinstance(required, StructType) else [(c, None) for c in required])
    for name, kind in fields:
        ok = name in have and (kind is None or have[name] == kind)
        checks.append((table, f"column:{name}", int(ok), 1, ok))
    schema = "table_name string, check_name string, observed bigint, expected bigint, passed boolean"
    static = spark.createDataFrame(checks, schema)
    present = [name for name, _ in fields if name in have]
    measured = df.agg(F.count("*").alias("_n"), *[
        F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(present)])
    rows = [F.struct(F.lit("row_count").alias("check_name"), F.col("_n").alias("observed"),
                     F.lit(min_rows).cast("bigint").alias("expected"),
                     (F.col("_n") >= min_rows).alias("passed"))]
    rows += [F.struct(F.lit(f"nulls:{c}").alias("check_name"), F.col(f"_{i}").alias("observed"),
                      F.lit(0).cast("bigint").alias("expected"), (F.col(f"_{i}") == 0).alias("passed"))
             for i, c in enumerate(present)]
    dynamic = measured.select(F.explode(F.array(*rows)).alias("_r")).select(
        F.lit(table).alias("table_name"), "_r.*")
    return static.unionByName(dynamic)


def closed_vocabulary(df: DataFrame, field: str, allowed: list[str]) -> DataFrame:
    """Values of ``field`` outside the vocabulary, with counts."""
    return (df.filter(F.col(field).isNull() | ~F.col(field).isin(allowed))
            .groupBy(F.col(field).alias("value")).agg(F.count("*").alias("rows")))


def unique_key_check(df: DataFrame, key: str) -> DataFrame:
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"))
    return per_key.agg(F.count_if(F.col("_n") > 1).alias("duplicated_keys"))


def index_consistency(vectors: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Vectors and metadata must describe the same ids."""
    sides = (vectors.select(F.col(key).alias("_k"), F.lit(1).alias("_v"), F.lit(0).alias("_m"))
             .unionAll(metadata.select(F.col(key).alias("_k"), F.lit(0).alias("_v"),
                                       F.lit(1).alias("_m"))))
    per_key = sides.groupBy("_k").agg(F.sum("_v").alias("_v"), F.sum("_m").alias("_m"))
    return per_key.agg(
        F.sum("_v").alias("vector_rows"), F.sum("_m").alias("metadata_rows"),
        F.count_if((F.col("_v") > 0) & (F.col("_m") == 0)).alias("vectors_without_metadata"),
        F.count_if((F.col("_v") == 0) & (F.col("_m") > 0)).alias("metadata_without_vectors"),
    ).withColumn("passed", (F.col("vectors_without_metadata") == 0)
                 & (F.col("metadata_without_vectors") == 0)
                 & (F.col("vector_rows") == F.col("metadata_rows")))
