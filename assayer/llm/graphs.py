"""Connected components of a link table, with every step a Spark join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayer.session import materialize


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for each node of links ``a``, ``b``.

    Alternates large-star and small-star steps until the edges stay the same.  Minima combine
    map-side and each join has one row per node on one side, so a hub is split by the adaptive
    skew join.  Each step is written to the shared folder.  Loops and repeated links are harmless;
    no links give no rows; links with a null end are ignored.
    """
    edges = materialize(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _stamp(edges)
    while seen[0]:
        both = edges.selectExpr("a AS u", "b AS v").unionAll(edges.selectExpr("b AS u", "a AS v"))
        large = (both.join(_least(both), "u").filter("v > u")
                 .selectExpr("v AS a", "least(m, u) AS b").filter("a <> b").distinct())
        down = materialize(large, "large").selectExpr("a AS u", "b AS v")
        small = down.join(_least(down), "u")
        small = small.selectExpr("v AS a", "m AS b").unionAll(small.selectExpr("u AS a", "m AS b"))
        edges = materialize(small.filter("a <> b").distinct(), "small")
        now = _stamp(edges)
        if now == seen:
            break
        seen = now
    # at the end every node points at its root
    return edges.selectExpr("a AS node", "b AS root").unionAll(
        edges.selectExpr("b AS node", "b AS root").distinct())
