import datetime as dt

from pyspark.sql import functions as F

from assayer.sources.schemas import CASE_LOG
from assayer.streaming import cases as st
from assayer.streaming.done_index import DoneIndex

T0 = dt.datetime(2024, 1, 1)
CASES = "case_id string, ts timestamp, case_key int"


def _put(spark, path, rows, name):
    spark.createDataFrame(rows, CASES).coalesce(1).write.mode("append").parquet(str(path))


def _signals(spark):
    return spark.createDataFrame(
        [(1, -0.1, -1.0, -2.0, -0.1, -1.0, "Yes. It does.", 0.95)],
        "case_key int, score_yes double, score_no double, score_maybe double, score_supported double, "
        "score_hallucinated double, candidate_answer string, best_similarity double")


def test_each_case_is_logged_once(spark, tmp_path):
    src, log, state = (str(tmp_path / n) for n in ("src", "log", "state"))
    hour = dt.timedelta(hours=1)
    _put(spark, src, [("a", T0, 1), ("a", T0 + hour, 1), ("b", T0, 9)], "one")
    schema = spark.read.parquet(src).schema

    def run():
        stream = st.stream_case_disposition(st.read_case_stream(spark, src, schema), _signals(spark))
        st.append_log(stream, log, state).awaitTermination()
        return sorted((r["case_id"], r["disposition_kind"]) for r in
                      spark.read.schema(CASE_LOG).parquet(log).collect())

    assert run() == [("a", "pass"), ("b", "review")]
    _put(spark, src, [("a", T0 + 2 * hour, 1), ("c", T0 + 3 * hour, 1)], "two")   # replayed and new
    assert run() == [("a", "pass"), ("b", "review"), ("c", "pass")]


def test_incremental_scoring_skips_finished_and_late_rows(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _put(spark, src, [("a", T0, 1), ("b", T0, 2)], "one")
    schema = spark.read.parquet(src).schema
    score = lambda df: df.select("case_id", (F.col("case_key") * 10).alias("score"))

    def run(state):
        st.stream_incremental_scoring(st.read_case_stream(spark, src, schema), score, out,
                                      str(tmp_path / state), key="case_id").awaitTermination()
        return sorted((r["case_id"], r["score"]) for r in spark.read.schema(
            "case_id string, score int").parquet(out).collect())

    assert run("s1") == [("a", 10), ("b", 20)]
    _put(spark, src, [("a", T0 + dt.timedelta(days=3), 5), ("c", T0 + dt.timedelta(days=3), 3)], "two")
    # "a" returns after the watermark dropped its state: the result table still stops it
    assert run("s1") == [("a", 10), ("b", 20), ("c", 30)]
    # a new checkpoint re-reads everything and must neither rescore nor lose anything
    assert run("s2") == [("a", 10), ("b", 20), ("c", 30)]
    _put(spark, src, [("d", T0 + dt.timedelta(days=4), 4)], "three")
    assert run("s3") == [("a", 10), ("b", 20), ("c", 30), ("d", 40)]


def test_late_files_lose_nothing(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for day in range(6, -1, -1):  # the latest file first, one file per batch
        _put(spark, src, [(f"c{day}", T0 + dt.timedelta(days=day), day), ("again", T0, 1)], str(day))
    stream = st.read_case_stream(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
    st.stream_incremental_scoring(stream, lambda df: df.select("case_id"), out, str(tmp_path / "state"),
                                  key="case_id").awaitTermination()
    done = sorted(r["case_id"] for r in spark.read.schema("case_id string").parquet(out).collect())
    assert done == ["again", *(f"c{day}" for day in range(7))]


def test_repeats_of_an_id_choose_the_earliest_row(spark, tmp_path):
    for parts in (1, 5):
        src, out = str(tmp_path / f"src{parts}"), str(tmp_path / f"out{parts}")
        rows = [("a", T0 + dt.timedelta(hours=h), k) for h, k in ((5, 1), (2, 9), (2, 7), (8, 0))]
        spark.createDataFrame(rows, CASES).repartition(parts).write.parquet(src)
        st.stream_incremental_scoring(st.read_case_stream(spark, src, spark.read.parquet(src).schema), lambda df: df, out,
                                      str(tmp_path / f"state{parts}"), key="case_id").awaitTermination()
        assert [r["case_key"] for r in spark.read.schema(CASES).parquet(out).collect()] == [7]


def test_a_batch_reads_its_buckets_whatever_the_history(spark, tmp_path):
    """Twenty batches of 40 new ids and 5 known ones: what a batch reads does not grow."""
    index = DoneIndex(spark, str(tmp_path / "done"), "id", "bigint", bucket_rows=50)
    ids = lambda a, b: spark.range(a, b).select("id")
    read, seen = [], 0
    for batch in range(20):
        index.grow()
        arriving = ids(max(0, seen - 5), seen + 40)
        new = index.without_done(arriving, f"b{batch}")
        assert sorted(r["id"] for r in new.collect()) == list(range(seen, seen + 40))
        one = arriving.filter(f"id = {seen}")
        touched = [r[0] for r in one.select(index._bucket(index.buckets)).collect()]
        read.append(index.done_among(touched, "x").count())
        index.add(new, f"b{batch}")
        index.add(new, f"b{batch}")  # a replay overwrites its own ids
        seen += 40
    assert index.buckets in (16, 32) and index._table().select("id").distinct().count() == seen
    assert max(read[10:]) <= 110 and seen == 800
    again = DoneIndex(spark, str(tmp_path / "done"), "id", "bigint", bucket_rows=50)
    assert (again.number, again.buckets) == (index.number, index.buckets)
    assert again.without_done(ids(790, 810), "later").count() == 10
    assert again.without_done(ids(760, 810), "b19").count() == 50  # its own ids do not count for a batch


def test_results_older_than_the_index_count(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _put(spark, src, [("a", T0, 1), ("b", T0, 2)], "one")
    spark.createDataFrame([("a", 1)], "case_id string, score int").write.parquet(f"{out}/run=old/batch_id=0")
    st.stream_incremental_scoring(st.read_case_stream(spark, src, spark.read.parquet(src).schema),
                                  lambda df: df.select("case_id", F.lit(2).alias("score")), out,
                                  str(tmp_path / "state"), key="case_id").awaitTermination()
    done = spark.read.schema("case_id string, score int").parquet(out).select("case_id", "score")
    assert sorted(map(tuple, done.collect())) == [("a", 1), ("b", 2)]


def test_finished_ids_are_never_broadcast(spark, tmp_path):
    """Ids packed in a few MB of files take many times that in the driver's memory."""
    ids = lambda n: spark.range(n).select(F.col("id").cast("string"))
    index = DoneIndex(spark, str(tmp_path / "done"), "id", "string")
    index.grow()
    index.add(ids(100), "first")
    left = index.without_done(ids(150), "second")
    assert left.count() == 50
    assert "Broadcast" not in left._jdf.queryExecution().executedPlan().toString()
