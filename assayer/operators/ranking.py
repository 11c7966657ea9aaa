"""Exact ranks, medians and running totals without a hot or global window.

A plain ``row_number() over (partition by label order by ...)`` puts a whole
label into one task.  Here rows are first spread over even buckets (hash digits,
ranges of a sort, quantile bins), bucket sizes are summed map-side, and a rank
is *rows in earlier buckets + position inside the bucket*.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assayer.session import materialize


def seeded_hash(key: Column | str, seed: int = 42) -> Column:
    """Deterministic, partition-independent shuffle key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def hash_rank(df: DataFrame, key: str, by: list[str] = (), seed: int = 42,
              hex_digits: int = 4, rank: str = "rank", total: str | None = None) -> DataFrame:
    """Rank rows of each ``by`` group by ``md5(key|seed)`` (ties: key), from 1.

    md5 digits are uniform, so ``16 ** hex_digits`` buckets per group stay even
    no matter how large one group is.  Position inside the bucket and bucket
    offset use the same bucket key, hence one shuffle of the rows.
    """
    by = list(by)
    prefix = F.substring("_h", 1, hex_digits)
    # to_json leaves nulls out, so the key is never null and groups stay apart
    bucket = F.concat(F.to_json(F.struct(*by)), prefix) if by else prefix
    bucketed = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_b", bucket)
    counts = bucketed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    group = W.partitionBy(*by)
    before = group.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    # one row per bucket, so these windows are small whatever the data size
    offsets = counts.select(
        "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(group).alias("_total"))
    inside = W.partitionBy("_b").orderBy("_h", key)
    out = (bucketed.withColumn("_at", F.row_number().over(inside)).join(offsets, "_b")
           .withColumn(rank, F.col("_offset") + F.col("_at")))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_h", "_b", "_at", "_offset", "_total")


ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def sorted_rank(df: DataFrame, order: list[str], by: list[str] = (),
                rank: str = "rank") -> DataFrame:
    """Rank rows of each ``by`` group in ascending ``order``, from 1.

    ``order`` must end in a unique column.  One range sort spreads even a single
    huge group over all partitions; the sorted rows are written to the shared
    folder once with their (partition, position) number, so the positions can
    no longer change.  A rank is then position + rows of the group in earlier
    partitions: no window over data rows and no second shuffle.
    """
    by, order = list(by), list(order)
    placed = (df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
              .withColumn("_id", F.monotonically_increasing_id()))
    stored = materialize(placed, "rank")
    stored = (stored.withColumn("_part", F.shiftright("_id", ROW_BITS).cast("int"))
              .withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))))
    # one row per group and partition
    parts = stored.groupBy(*by, "_part").agg(
        F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*by, "_part", "_first",
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = join_on(stored, parts, by + ["_part"], "inner")
    return (joined.withColumn(rank, F.col("_offset") + F.col("_row") - F.col("_first") + 1)
            .drop("_id", "_part", "_row", "_first", "_offset"))


SALTS = 64


def top_n_per_group(df: DataFrame, by: list[str], order: list, n: int,
                    rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each group under a total order, for any ``n``.

    A group is first cut into ``SALTS`` parts that keep ``n`` rows each, so the
    task that orders the group sees at most ``SALTS * n`` of its rows however
    many it has.  Below the optimizer's threshold the same cut is a group limit
    *before* the exchange, and the salted step is left out of the plan.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    name = rank or "_rn"
    place = lambda rows, keys: (rows.withColumn(name, F.row_number().over(
        W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n))
    if n > limit:
        salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        df = place(salted, [*by, "_salt"]).drop("_salt", name)
    out = place(df, by)
    return out if rank else out.drop(name)


def collapse_values(df: DataFrame, by: list[str], value: str, sums: list[str] = ()) -> DataFrame:
    """Distinct ``value`` per group with its row count ``_n`` and sums ``_s_<name>``.  Nulls are left out.

    Combines map-side and is written to the shared folder once: everything
    below reads this narrow table, so the input is computed once whatever is
    asked of the distribution.
    """
    kept = df.filter(F.col(value).isNotNull())
    return materialize(kept.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums]), "values")


BINS = 1024


def with_bins(values: DataFrame, column: str, bins: int) -> DataFrame:
    """Add ``_b``: the bin of ``column``, in ascending order of its values.

    The edges are approximate quantiles of the rows themselves (``bins`` doubles,
    the only thing that reaches the driver), so bins stay even however narrow
    or shifted the range is.  They steer balance only.
    """
    edges = values.approxQuantile(column, [i / bins for i in range(1, bins)], 1 / (4 * bins))
    inner = sorted({e for e in edges if math.isfinite(e)}) or [0.0]
    cut = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol=column, outputCol="_b",
                     handleInvalid="keep")
    return cut.transform(values).withColumn("_b", F.col("_b").cast("int"))


def median_of(values: DataFrame, by: list[str], bins: int = BINS, name: str = "median") -> DataFrame:
    """Exact median per group of collapsed values.

    A histogram over quantiles of all distinct values finds the bin(s) that hold
    the middle; only those bins are ordered.
    """
    by = list(by)
    values = with_bins(values.select(*by, "_v", "_n"), "_v", bins)
    hist = values.groupBy(*by, "_b").agg(F.sum("_n").alias("_n"))
    # one row per bin, so these windows are small whatever the data size
    inside = W.partitionBy(*by)
    cumulative = (hist
                  .withColumn("_end", F.sum("_n").over(
                      inside.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)))
                  .withColumn("_total", F.sum("_n").over(inside))
                  .withColumn("_start", F.col("_end") - F.col("_n"))
                  .withColumn("_lo_rank", F.floor((F.col("_total") + 1) / 2))
                  .withColumn("_hi_rank", F.floor(F.col("_total") / 2) + 1))
    holds = lambda r: (F.col("_start") < F.col(r)) & (F.col("_end") >= F.col(r))
    middle = (cumulative.filter(holds("_lo_rank") | holds("_hi_rank"))
              .select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col("_b").alias("_mb"),
                      "_start", "_lo_rank", "_hi_rank"))
    on = [values[k].eqNullSafe(middle[f"_k_{k}"]) for k in by] + [values["_b"] == middle["_mb"]]
    order = W.partitionBy(*by, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    placed = (values.join(middle, on)
              .withColumn("_to", F.col("_start") + F.sum("_n").over(order))
              .withColumn("_from", F.col("_to") - F.col("_n")))
    at = lambda r: F.max(F.when((F.col("_from") < F.col(r)) & (F.col("_to") >= F.col(r)),
                                F.col("_v")))
    ends = placed.groupBy(*by).agg(at("_lo_rank").alias("_a"), at("_hi_rank").alias("_z"))
    return ends.select(*by, (F.col("_a") + (F.col("_z") - F.col("_a")) * 0.5).alias(name))


def exact_median(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    return median_of(collapse_values(df, by, value), by, name=name)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join that keeps the left key columns."""
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_k_{k}" for k in keys])


def running_totals(df: DataFrame, order: str, sums: list[str], bins: int = BINS) -> DataFrame:
    """Add ``<name>_before`` (sum over smaller ``order`` values) for each name.

    ``order`` must be a double, unique per row and never null.  Same bucket-offset
    scheme as above; the rows are written to the shared folder once.
    """
    placed = with_bins(materialize(df, "totals"), order, bins)
    hist = placed.groupBy("_b").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    # at most ``bins`` rows reach this ungrouped window
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = hist.select(F.col("_b").alias("_ob"), *[
        F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    joined = placed.join(offsets, F.col("_b") == F.col("_ob"))
    return joined.select(*df.columns, *[
        (F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before")
        for c in sums])
