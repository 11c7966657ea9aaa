"""Every stage on what its predecessor kept."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if k + 1 < len(cp.STAGES):
            assert docs.columns == columns
    assert counts[0] > counts[1] >= counts[2] >= counts[3] == counts[4] > 0.7 * counts[0]
    assert sorted(map(tuple, cp.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted(
        map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("score", "doc", "row", "key", "least", "id", "_score", "_text", "shard", "start")


def _tables(spark, folder, rows):
    """Tables of a folder; the documents have columns whose names the operators use themselves."""
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    return docs


def _words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n))


def test_stages_on_nulls_repeats_and_any_columns(spark, tmp_path):
    text = lambda i: ("you stupid idiot fool " * 6 if i % 9 == 0 else "") + _words(i, 60)
    rows = [(i, text(i), "en", "s", 7) for i in range(80)]
    shared = _words(1000, 40)
    rows += [(200, _words(5, 60), "en", None, None), (201, shared + " " + _words(201, 50), None, "s", 1),
             (202, _words(202, 50) + " " + shared, "en", "s", 1), (203, None, "en", "s", 0), (204, "", None, None, 0),
             (205, _words(205, 30) + " password=hunter2hunter2 end", "en", "s", 1),
             (3, _words(777, 60), "en", "s", 1),  # another text under an id that is taken
             (206, _words(206, 60), "en", "s", 1), (206, _words(206, 60), "en", "s", 1), (None, _words(300, 30), "en", "s", 1)]
    docs = _tables(spark, tmp_path / "in", rows)
    folder, kept = str(tmp_path / "in"), {}
    for name, stage in cp.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns[:5] == [c.split()[0] for c in SCHEMA.split(", ")] and set(CLASHES) < set(docs.columns)
        kept[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        assert all(r[f"{c}"] == f"clash {c}" for r in docs.collect() for c in CLASHES)
    ids = lambda name: [i for i, _ in kept[name]]
    assert not [i for i in ids("toxicity") if i in range(0, 80, 9)] and len(ids("toxicity")) == len(rows) - 9
    # 200 repeats document 5; one of the equal rows of 206 stays; both texts of id 3 stay
    assert 200 not in ids("near_dedup") and ids("near_dedup").count(206) == 1 and ids("near_dedup").count(3) == 2
    assert {203, 204, None} <= set(ids("near_dedup"))
    texts = dict(kept["substring_dedup"])
    assert shared in texts[201] and shared not in texts[202] and len(texts[202].split()) == 50
    assert "[secret]" in dict(kept["secret_scan"])[205] and "hunter2" not in dict(kept["secret_scan"])[205]
    assert ids("secret_scan") == ids("substring_dedup")
    packed = cp.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted((r.doc_id for r in packed if r.piece == 0), key=str) == sorted(ids("secret_scan"), key=str)


def test_run_on_an_empty_table(spark, tmp_path):
    _tables(spark, tmp_path / "in", [])
    assert cp.run(spark, str(tmp_path / "in")).count() == 0
