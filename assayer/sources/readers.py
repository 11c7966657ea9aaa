"""Readers for the file shapes evaluation data comes in."""

from __future__ import annotations

import csv
import io
import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from assayer.operators.normalize import pairs_of_cells
from assayer.sources.schemas import OBJECT_MAP
from assayer.sources.split_csv import csv_records
from assayer.sources.split_objects import object_entries


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Line-delimited JSON; blank lines are skipped, bad lines fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _cells(record: str) -> list[str]:
    return next(csv.reader(io.StringIO(record, newline="")), [])


def read_csv_typed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Headered CSV with quoted multi-line text, split like any other text.

    Columns are matched by header name (a file with another header fails the
    read), a byte order mark is ignored, and ids keep their declared type (``007`` stays text).
    """
    records = csv_records(spark, path)
    headers = [r[0] for r in records.filter("source_row_id = 0").select("record").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"files with different headers: {headers}")
    csv.field_size_limit(2**31 - 1)
    names = [name.lstrip("\ufeff").strip() for name in _cells(headers[0])] if headers else schema.fieldNames()
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    shape = ", ".join(f"c{i} string" for i in range(len(names)))
    row = records.filter("source_row_id > 0").select(
        F.from_csv("record", shape, {"quote": '"', "escape": '"'}).alias("r"))
    return row.select(*[F.col(f"r.c{names.index(f.name)}").cast(f.dataType).alias(f.name) for f in schema.fields])


def read_headerless_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Ragged CSV without header -> prompt_a / prompt_b per row.

    A row may have any number of cells, and a cell line breaks in quotes; a file of any size is read by as
    many tasks as it has splits.  ``source_row_id`` is the row's position in
    its file (from 0, blank lines left out), and ``record_id`` names the data set and
    the whole hash of path and position, so equal rows keep ids of their own.
    """
    def cells(batches):
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            yield batch.assign(cells=batch["record"].map(_cells)).drop(columns="record")

    raw = csv_records(spark, path).mapInPandas(cells, "source_path string, source_row_id long, cells array<string>")
    file = F.regexp_extract("source_path", r"([^/]+)$", 1)
    named = raw.withColumn("source_file", file).withColumn(
        "dataset_name", F.regexp_replace("source_file", r"\.csv$", ""))
    return pairs_of_cells(named, "cells").withColumn("record_id", F.concat_ws("_", "dataset_name", F.md5(
        F.concat_ws("|", "source_path", "source_row_id")))).drop("source_path")


def read_object_map_json(spark: SparkSession, path: str, value_type: str = OBJECT_MAP,
                         document_per_line: bool = False) -> DataFrame:
    """``{id: {...}}`` documents -> one row per id.

    By default a document may fill a file of any size: its entries are cut out by as many tasks as the file
    has splits.  With ``document_per_line`` files hold many documents, each parsed as a whole.
    """
    text = spark.read.text(path) if document_per_line else object_entries(spark, path).select(F.col("entry").alias("value"))
    return (text.select(F.explode(F.from_json("value", value_type)).alias("record_id", "_v"))
            .select("record_id", "_v.*"))


FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet"}


def read_any_format(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Choose the reader by suffix."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported suffix: {suffix or path}")
    if suffix == ".csv":
        return read_csv_typed(spark, path, schema)
    if suffix == ".jsonl":
        return read_jsonl(spark, path, schema)
    reader = spark.read.schema(schema)
    if suffix == ".json":
        reader = reader.option("multiLine", True)
    return reader.format(FORMATS[suffix]).load(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def optional_source(spark: SparkSession, path: str, schema: StructType,
                    fallback: DataFrame | None = None) -> DataFrame:
    """The table if it exists, else the fallback, else an empty frame."""
    if path_exists(spark, path):
        return read_any_format(spark, path, schema)
    return fallback if fallback is not None else spark.createDataFrame([], schema)
