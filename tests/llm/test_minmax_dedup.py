"""Min-max near-dedup against all-pairs Jaccard."""

import random

import duckdb
from pyspark.sql import functions as F

from assayer.llm import minmax_dedup as md, queries

SF = "/root/testdata/sf0.001"


def brute(rows, percent=75):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        s = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets[i] = s
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def test_whole_table_equals_all_pairs(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    out = {tuple(r) for r in queries.op1_minhash_near_dedup(spark, SF).collect()}
    assert out == brute(rows)


def test_chains_and_edges(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # a drifting chain: neighbours are alike, the ends are not
        rows.append((i, " ".join(base)))
        base[r.randrange(120)] = f"x{i}"
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "one two"), (104, "ONE  two"), (105, "a b c d e"),
             (106, "w x y"), (107, "c " * 30000), (108, "C " * 30001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash"))
    out = {tuple(x) for x in md.near_duplicates(df).collect()}
    assert out == brute(rows)
    kept = md.keep_one(df)
    assert kept.columns == df.columns
    assert {x.doc_id for x in kept.collect()} == {i for i, _, _, k in out if k}


def test_empty_nulls_and_repeats(spark):
    schema = "doc_id long, text string"
    assert md.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c"), (3, "a b c"), (3, "a b c"), (2, "A b c")]
    out = md.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((x.doc_id, x.component_id) for x in out if x.doc_id) == [(2, 2), (3, 2), (3, 2)]
    assert len(out) == 4
    assert md.keep_one(spark.createDataFrame(rows, schema)).count() == 2


def test_rows_that_share_an_id(spark):
    """A near copy under an id takes only itself away; equal rows leave one; any column names."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = lambda t: t + " more"
    rows = [(1, a, "x"), (5, near(a), "y"), (5, c, "z"), (7, b, "p"), (7, b, "p"), (9, near(b), "q"), (9, near(a), "r"),
            (None, a, "n"), (8, None, "e"), (8, "", "f")]
    names = ["doc_id", "text", "row"]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumns(
        {"doc": F.lit("clash"), "least": F.lit(1), "key": F.lit(2), "a.b": F.lit(3)})
    kept = md.keep_one(df.repartition(3))
    assert kept.columns == df.columns
    got = sorted((r["row"] for r in kept.collect()))
    assert got == ["e", "f", "n", "p", "x", "z"]
    found = sorted((r.doc_id, r.component_id, r.kept) for r in md.near_duplicates(df).collect() if r.doc_id)
    assert found == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 7, True), (7, 7, True), (8, 8, True), (8, 8, True),
                     (9, 1, False), (9, 7, False)]
    assert names == df.columns[:3]
    # two texts under one id do not join their groups
    two = spark.createDataFrame([(5, a), (5, b), (7, near(a)), (9, near(b)), (2, near(near(b)))], "doc_id long, text string")
    out = sorted((r.doc_id, r.component_id) for r in md.near_duplicates(two).collect())
    assert out == [(2, 2), (5, 2), (5, 5), (7, 5), (9, 2)]
