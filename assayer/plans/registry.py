"""Registered queries and their SQL oracles."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

DISPLAY_DIGITS = 9


@dataclass(frozen=True)
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The query, with aggregated doubles shown to nine digits.

        Sums of doubles depend on row order in the last bits; both engines
        round the same columns the same way, at the very end.
        """
        out = self.build(spark, sf_dir)
        shown = {c: F.round(c, DISPLAY_DIGITS) for c in self.doubles}
        return out.withColumns(shown) if shown else out

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = with_views(self.sql)
        if not self.doubles:
            return body
        shown = ", ".join(f"round(CAST({c} AS DOUBLE), {DISPLAY_DIGITS}) AS {c}"
                          for c in self.doubles)
        return f"SELECT * REPLACE ({shown}) FROM ({body}) AS result"


REGISTRY: dict[str, Query] = {}
SQL_VIEWS: dict[str, str] = {}


def query(key: str, sql: str | None = None, doubles: str = ""):
    def register(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query {key}")
        REGISTRY[key] = Query(key, fn, sql, tuple(doubles.split()))
        return fn
    return register


def with_views(body: str) -> str:
    """Prefix the views a statement mentions (transitively) as CTEs."""
    wanted, text = [], body
    for name in reversed(SQL_VIEWS):
        if re.search(rf"\b{name}\b", text):
            wanted.insert(0, name)
            text += "\n" + SQL_VIEWS[name]
    if not wanted:
        return body
    ctes = ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in wanted)
    stripped = body.lstrip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if stripped.upper().startswith(opening):
            return f"{opening}{ctes},\n{stripped[len(opening):]}"
    return f"WITH {ctes}\n{stripped}"
