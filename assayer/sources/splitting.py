"""Records of files that several tasks read, where a record may begin in one split and end in another.

A splitter cuts the lines of each split into whole records and pieces: ``HEAD`` is what precedes the first
boundary of a split that begins inside a record, ``TAIL`` what follows the last one.  A piece holds at most a
split, and a record is put together by the split it begins in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

HEAD, RECORD, TAIL = 0, 1, 2
PARTS = "path string, block long, role int, number long, record string"


def runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, list[str]]]:
    """The lines of a task in order, in runs of one split each."""
    for batch in batches:
        if len(batch):
            turn = (batch["path"] != batch["path"].shift()) | (batch["block"] != batch["block"].shift())
            for _, part in batch.groupby(turn.cumsum(), sort=False):
                yield part["path"].iloc[0], int(part["block"].iloc[0]), part["value"].tolist()


def put_together(parts: DataFrame, separator: str) -> DataFrame:
    """``path``, ``block`` (split it begins in), ``place`` (in its file, from 0) and ``record`` of all records."""
    whole = parts.filter(F.col("role") == RECORD).select("path", "block", "number", "record")
    # at most two pieces per split: a record goes by the split its tail piece lies in
    order = W.partitionBy("path").orderBy("block", "role").rowsBetween(W.unboundedPreceding, 0)
    pieces = parts.filter(F.col("role") != RECORD).withColumn(
        "start", F.last(F.when(F.col("role") == TAIL, F.col("block")), ignorenulls=True).over(order))
    joined = pieces.groupBy("path", "start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("block", "role", "record"))), lambda p: p["record"]), separator).alias("record"))
    sizes = whole.groupBy("path", "block").agg(F.count("*").alias("n"))
    last = joined.join(sizes.withColumnRenamed("block", "start"), ["path", "start"], "left").select(
        "path", F.col("start").alias("block"), F.coalesce("n", F.lit(0)).alias("number"), "record")
    counts = sizes.unionAll(joined.select("path", F.col("start").alias("block"), F.lit(1).cast("long").alias("n"))).groupBy(
        "path", "block").agg(F.sum("n").alias("n"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # one number per split: the records stay where they are
    return whole.unionAll(last).join(F.broadcast(offsets), ["path", "block"]).select(
        "path", "block", (F.col("before") + F.col("number")).alias("place"), "record")
