"""Run a registered query in Spark and its SQL in DuckDB and compare the results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _kind(name: str) -> str:
    name = name.lower()
    if "int" in name or name in ("long", "hugeint", "short", "byte"):
        return "int64" if name in ("bigint", "int64", "long") else "int32" if name in ("int", "integer") else name
    if name in ("varchar", "string"):
        return "text"
    if name in ("bool", "boolean"):
        return "bool"
    return name


def compare(spark_df, sql: str, con) -> str | None:
    """None when equal, else a short description of the first difference."""
    relation = con.sql(sql)
    want_kinds = {c: _kind(str(t)) for c, t in zip(relation.columns, relation.types)}
    have_kinds = {f.name: _kind(f.dataType.simpleString()) for f in spark_df.schema.fields}
    if set(want_kinds) != set(have_kinds):
        return f"columns {sorted(have_kinds)} vs {sorted(want_kinds)}"
    if want_kinds != have_kinds:
        return "types " + str({c: (have_kinds[c], want_kinds[c]) for c in want_kinds
                               if want_kinds[c] != have_kinds[c]})
    names = sorted(want_kinds)
    at = {c: i for i, c in enumerate(relation.columns)}
    key = lambda row: tuple((v is None, str(type(v)), str(v)) for v in row)
    want = sorted((tuple(_plain(r[at[c]]) for c in names) for r in relation.fetchall()), key=key)
    have = sorted((tuple(_plain(r[c]) for c in names) for r in spark_df.collect()), key=key)
    if len(want) != len(have):
        extra = [r for r in have if r not in set(want)][:2]
        return f"rows {len(have)} vs {len(want)}; columns {names}; only in spark {extra}"
    for a, b in zip(have, want):
        if a != b:
            return f"columns {names}: {a} vs {b}"
    if not have:
        return "both empty"
    return None


def main(argv: list[str]) -> int:
    root = Path(__file__).resolve().parent.parent
    sys.path.insert(0, str(root))
    import __spark_entry__ as entry
    from tests.conftest import session
    sf_dir = argv[0]
    wanted = argv[1:]
    spark, con = session(), duck(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for key, run in entry.queries().items():
        if wanted and not any(key == w or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if key in sqls:
                problem = compare(df, sqls[key], con)
            else:
                rows = df.count()
                problem = None if rows else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        status = "ok  " if problem is None else "FAIL"
        print(f"{status} {key} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} failing", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
