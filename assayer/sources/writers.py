"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayer.session import scratch_path
from assayer.sources.schemas import CASE_LOG


def flatten_arrays(df: DataFrame, separator: str = "; ") -> DataFrame:
    """Join string arrays for text formats; arrays stay arrays until the sink."""
    out = df
    for f in df.schema.fields:
        if f.dataType.simpleString() == "array<string>":
            out = out.withColumn(f.name, F.array_join(f.name, separator))
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = (),
                mode: str = "errorifexists", separator: str = "; ") -> None:
    """Parquet, JSON lines or headered CSV, optionally partitioned (e.g. by split)."""
    if fmt == "csv":
        df = flatten_arrays(df, separator)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                                ignoreTrailingWhiteSpace=False)
    writer.format("json" if fmt == "jsonl" else fmt).save(path)


def write_bucketed(df: DataFrame, key: str, buckets: int = 200, table: str | None = None) -> DataFrame:
    """A table in buckets of ``key``, sorted in each: joins on the key leave it where it is.

    Lies in the shared folder, under a fresh name of the session's catalog unless ``table`` names one.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "bucketed")
    name = table or path.rsplit("/", 1)[1].replace("-", "_")
    # one file per bucket
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet")
     .option("path", path).saveAsTable(name))
    return spark.table(name)


def case_log_rows(evaluated: DataFrame, case_id: str = "case_id") -> DataFrame:
    """Audit rows of evaluated cases in the declared log schema."""
    columns = {
        "logged_at": F.current_timestamp(), "case_id": F.col(case_id).cast("string"),
        "disposition_label": F.col("disposition.label"),
        "disposition_kind": F.col("disposition.kind"),
    }
    return evaluated.select(*[
        (columns[f.name] if f.name in columns else F.col(f.name)).alias(f.name)
        for f in CASE_LOG.fields])


def append_case_log(evaluated: DataFrame, path: str, case_id: str = "case_id") -> None:
    case_log_rows(evaluated, case_id).write.mode("append").parquet(path)
