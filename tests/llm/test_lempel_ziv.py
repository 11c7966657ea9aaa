"""Relative Lempel-Ziv removal against a window dictionary."""

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from assayer.llm import lempel_ziv as lz, queries

SF = "/root/testdata/sf0.01"


def brute(rows):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(split):
        for j in range(len(split[i]) - 12):
            first.setdefault(tuple(split[i][j:j + 13]), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j:j + 13])] < i:
                gone[j:j + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1))
    got = {r.doc_id: tuple(r)[1:] for r in lz.digests(lz.duplicate_words(df)).collect()}
    assert got == brute(rows)
    return df, got


def test_whole_table(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op3_substring_dedup(spark, SF).collect()}
    assert got == brute(rows)
    assert sum(n for _, n, _ in got.values()) > 1000


def test_random_overlaps(spark):
    r = random.Random(2)
    pool = [f"w{i}" for i in range(400)]
    source = [[r.choice(pool) for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(r.randrange(4)):
            s = r.choice(source)
            a = r.randrange(40)
            w += s[a:a + r.randrange(5, 30)] + [r.choice(pool) for _ in range(r.randrange(4))]
        rows.append((r.randrange(10**6), r.choice([" ", "\n", " \t "]).join(w)))
    rows = list(dict(rows).items())
    rows += [(-1, "c " * 400), (-2, "c " * 12), (2_000_000, "c " * 13), (2_000_001, None), (2_000_002, " "),
             (2_000_003, "c " * 150_000 + "é d"), (2_000_004, "a b " * 100_000)]
    df, got = check(spark, rows)
    kept = {x.doc_id: x.text for x in lz.without_repeats(df).collect()}
    assert lz.without_repeats(df).columns == df.columns
    for i, text in rows:
        n, gone, digest = got[i]
        assert (i in kept) == (gone == 0 or gone < n)
        if i in kept:
            assert hashlib.sha256(" ".join((kept[i] or "").split()).encode()).hexdigest() == digest


def test_nulls_empty_and_repeats(spark):
    schema = "doc_id long, text string"
    assert lz.duplicate_words(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(None, text), (1, text), (1, text), (2, "x " + text)]
    got = lz.digests(lz.duplicate_words(spark.createDataFrame(rows, schema))).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 20)]
