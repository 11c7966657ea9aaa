"""Winnowing against a plain implementation; native plan only."""

import hashlib
import re

import duckdb
import xxhash
from pyspark.sql import functions as F

from assayer.llm import queries, winnow as wn

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def kept(text, k=5, w=16):
    ws = [x for x in re.split(r"[ \t-\r]+", text) if x]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ws]
    grams = []
    for i in range(len(h) - k + 1):
        a = 42
        for x in h[i:i + k]:
            a = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), a)
        grams.append((a & (2**31 - 1), -i))
    if h and len(h) < k:
        a = 42
        for x in h:
            a = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
        grams = [(a & (2**31 - 1), 0)]
    best = [min(grams[i:i + w]) for i in range(max(1, len(grams) - w + 1))] if grams else []
    return list(dict.fromkeys((x, -i) for x, i in best))


def expected(rows):
    order = sorted(rows, reverse=True)
    out = {}
    like = lambda a, b: 1.0 if not (a or b) else len({x for x, _ in a} & {x for x, _ in b}) / len({x for x, _ in a} | {x for x, _ in b})
    text = lambda f: ",".join(f"{x:X}:{i}" for x, i in f)
    for at, (i, t) in enumerate(order):
        nxt = order[(at + 1) % len(order)][1] or ""
        t = t or ""
        take = len(t) // 3
        edited = t[:len(t) - take] + nxt[:take]
        a, b, c = kept(t), kept(edited), kept(nxt)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), like(a, b), like(a, c))
    return out


def test_whole_table(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op10_fingerprints(spark, SF).collect()}
    assert got == expected(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "a b c d"), (5, "a b c d e"), (6, "x " * 30000), (7, "é\U0001F600" * 9), (8, " \t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("clash"), "h": F.lit(0)})
    got = {r.doc_id: tuple(r)[1:] for r in wn.fingerprints(df).collect()}
    assert got == expected(rows)
    assert wn.fingerprints(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")
    assert wn.fingerprints(one).first().near_next == 1.0
    repeated = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c")], "doc_id long, text string")
    assert wn.fingerprints(repeated).count() == 4


def test_plan_is_native(spark):
    plan = queries.op10_fingerprints(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
