"""Which ids have a result: a bucketed index that a batch reads only where its own ids fall.

Ids lie in buckets of their hash, one folder each.  A bucket holds about ``bucket_rows`` ids at most on
average: when the table outgrows that, all ids are written once more into a generation with twice the
buckets or more, which also puts the small files of many batches together.  So a batch of ``n`` ids reads
at most ``n`` buckets, however long the history is, and rewriting costs a constant share of all writes.

A batch adds its ids below its own name, so a replay overwrites what its first run left, and asks
for ids of others only.  A generation counts once its marker file exists.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKET_ROWS = 100_000
_NAME = re.compile(r"generation-(\d+)-buckets-(\d+)\.ready$")


class DoneIndex:
    """The index of one result table; ``kind`` is the type of its ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.key, self.kind, self.bucket_rows = spark, path, key, kind, bucket_rows
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        ready = sorted(m.groups() for m in map(_NAME.search, self._names(path)) if m)
        self.number, self.buckets, self.rows = 0, 0, 0
        if ready:
            self.number, self.buckets = map(int, ready[-1])
            self.rows = self._table().count()  # once per start

    def _names(self, path: str) -> list[str]:
        target = self._path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(target)] if self._fs.exists(target) else []

    @property
    def folder(self) -> str:
        return f"{self.path}/generation-{self.number:08d}-buckets-{self.buckets}"

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _table(self, buckets: list[int] | None = None) -> DataFrame:
        """Ids (with the batch they came with) of all or of the given buckets."""
        reader = self.spark.read.schema(f"`{self.key}` {self.kind}, bucket int, source string").option(
            "basePath", self.folder)
        there = [n for n in self._names(self.folder) if n.startswith("bucket=")]
        if buckets is not None:
            wanted = {f"bucket={b}" for b in buckets}
            there = [n for n in there if n in wanted]
        if not there:
            return self.spark.createDataFrame([], f"`{self.key}` {self.kind}, bucket int, source string")
        return reader.parquet(*[f"{self.folder}/{n}" for n in there])

    def _write(self, ids: DataFrame) -> None:
        (ids.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "source").parquet(self.folder))

    def grow(self, history: DataFrame | None = None) -> None:
        """Start a new generation if there is none (from ``history``) or its buckets are too full."""
        needed = 1 << max(0, math.ceil(math.log2(max(1, self.rows) / self.bucket_rows)))
        if self.number and needed <= self.buckets:
            return
        ids = self._table() if self.number else history
        self.number, self.buckets = self.number + 1, needed
        if ids is not None:
            merged = ids.select(self.key).distinct().withColumns(
                {"bucket": self._bucket(self.buckets), "source": F.lit("merged")})
            self._write(merged)
        marker = self._path(f"{self.folder}.ready")
        self._fs.mkdirs(self._path(self.folder))
        self._fs.createNewFile(marker)
        if ids is not None and not self.rows:
            self.rows = self._table().count()

    def without_done(self, batch: DataFrame, source: str) -> DataFrame:
        """Rows of ``batch`` whose id no other batch has finished; reads only the buckets of its ids."""
        touched = ([r[0] for r in batch.select(self._bucket(self.buckets)).distinct().collect()]
                   if self.buckets > 1 else [0])
        # ids lie packed in files and in memory take many times that: they are never broadcast
        return batch.join(self.done_among(touched, source).hint("merge"), self.key, "left_anti")

    def done_among(self, buckets: list[int], source: str) -> DataFrame:
        return self._table(buckets).filter(F.col("source") != source).select(self.key)

    def add(self, ids: DataFrame, source: str) -> None:
        """Mark ids as finished by ``source``."""
        named = ids.select(self.key).withColumns({"bucket": self._bucket(self.buckets), "source": F.lit(source)})
        self._write(named)
        self.rows += ids.count()
