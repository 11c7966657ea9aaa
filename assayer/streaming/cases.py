"""Streaming case disposition and incremental scoring.

Every arriving id gets exactly one result, however late or out of order it comes: nothing is dropped
by event time.  Of several rows of an id in a micro-batch the earliest counts (ties: by content), so a replay
chooses the same one.  Ids that have a result are found in an index of buckets (``done_index``), of which a
batch reads only those of its own ids, whatever the history.  A batch writes below its own checkpoint
and batch number, so a replayed batch overwrites itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from assayer.operators.trust import evaluate_cases
from assayer.sources.readers import path_exists
from assayer.sources.writers import case_log_rows
from assayer.streaming.done_index import BUCKET_ROWS, DoneIndex


def read_case_stream(spark: SparkSession, path: str, schema: StructType,
                     files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_case_disposition(cases: DataFrame, signals: DataFrame, key: str = "case_key") -> DataFrame:
    """Route each arriving case with the batch rules.

    ``signals`` is a static table (one row per key; store it if it is costly, every batch reads it); cases
    without a match take the insufficient-evidence branch.  ``append_log`` keeps one row per case.
    """
    return evaluate_cases(cases.join(signals, key, "left"))


def _first_of_each(batch: DataFrame, key: str, event_time: str) -> DataFrame:
    """The earliest row of each id; rows of one time are ordered by their content."""
    content = F.to_json(F.struct(*[F.col(c) for c in sorted(batch.columns)]))
    first = batch.groupBy(key).agg(F.min_by(F.struct("*"), F.struct(event_time, content)).alias("_row"))
    return first.select("_row.*")


def _write_new(stream: DataFrame, result_path: str, checkpoint: str, key: str, event_time: str,
               shape: Callable[[DataFrame], DataFrame], bucket_rows: int) -> StreamingQuery:
    """Shape and write the rows of each batch whose ``key`` has no result yet.

    A batch writes to ``run=<checkpoint hash>/batch_id=<n>`` and adds its ids to the index below
    ``<result_path>.done``.  On replay its own ids there are ignored and both are overwritten; a
    stream with another checkpoint never touches the results of this one.
    """
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    index: list[DoneIndex] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, source = batch.sparkSession, f"{run}-{batch_id}"
        todo = _first_of_each(batch, key, event_time)
        kind = dict(todo.dtypes)[key]
        if not index:
            index.append(DoneIndex(spark, f"{result_path}.done", key, kind, bucket_rows))
        # results that are older than the index
        old = (spark.read.schema(f"`{key}` {kind}").parquet(result_path)
               if not index[0].number and path_exists(spark, result_path) else None)
        index[0].grow(old)
        own = f"{result_path}/run={run}/batch_id={batch_id}"
        shape(index[0].without_done(todo, source)).write.mode("overwrite").parquet(own)
        index[0].add(spark.read.schema(f"`{key}` {kind}").parquet(own), source)

    return (stream.writeStream.foreachBatch(write).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def append_log(stream: DataFrame, path: str, checkpoint: str, case_id: str = "case_id",
               event_time: str = "ts", bucket_rows: int = BUCKET_ROWS) -> StreamingQuery:
    """Audit log with one row per case."""
    return _write_new(stream, path, checkpoint, case_id, event_time, lambda new: case_log_rows(new, case_id),
                      bucket_rows)


def stream_incremental_scoring(events: DataFrame, score: Callable[[DataFrame], DataFrame],
                               result_path: str, checkpoint: str, key: str = "record_id",
                               event_time: str = "ts", bucket_rows: int = BUCKET_ROWS) -> StreamingQuery:
    """Score only ids without a finished result; safe under replay and restart.  No row is dropped for being late."""
    return _write_new(events, result_path, checkpoint, key, event_time, score, bucket_rows)
