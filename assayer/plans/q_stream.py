"""Streaming queries driven to completion over the events table."""

from pyspark.sql import functions as F

from assayer.operators import trust as tr
from assayer.plans import views as v
from assayer.plans.registry import SQL_VIEWS, query
from assayer.session import materialize, scratch_path
from assayer.sources.schemas import CASE_LOG
from assayer.streaming import cases as st

# one signal row per key: the lowest of all its lines
SQL_VIEWS["signals"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_group ORDER BY score_yes, score_no, score_supported, score_hallucinated, candidate_answer, best_similarity NULLS FIRST) AS rn
               FROM cases) WHERE rn = 1"""
for _name, _source in (("evaluated", "signals"), ("routed", "evaluated_signals"), ("disposed", "routed_signals")):
    _inner = {"evaluated": "FROM cases", "routed": "FROM evaluated", "disposed": "FROM routed"}[_name]
    SQL_VIEWS[f"{_name}_signals"] = SQL_VIEWS[_name].replace(_inner, f"FROM {_source}")
SIGNALS = ["score_yes", "score_no", "score_maybe", "score_supported", "score_hallucinated",
           "candidate_answer", "best_similarity"]


def signals(spark, sf_dir):
    order = F.struct("score_yes", "score_no", "score_supported", "score_hallucinated",
                     "candidate_answer", "best_similarity")
    return (v.cases(spark, sf_dir).groupBy(F.col("case_group").alias("case_key"))
            .agg(F.min_by(F.struct(*SIGNALS), order).alias("s")).select("case_key", "s.*"))


def _events(spark, sf_dir):
    """Events copied as several files, so the stream sees more than one batch."""
    source = v.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "events")
    # latest rows in the first file: arrival is out of order
    source.repartitionByRange(8, F.desc("ts")).write.parquet(path)
    return path, source.schema


def _keyed(df):
    return df.withColumn("case_key", F.get_json_object("props", "$.k").cast("bigint")).withColumn(
        "case_id", F.col("event_id").cast("string"))


SQL_VIEWS["event_keys"] = """
SELECT event_id, ts, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS case_key FROM events"""


@query("stream_case_disposition", """
SELECT e.event_type, coalesce(d.disposition_label, 'Insufficient local evidence — human review required') AS disposition_label, count(*) AS rows
FROM event_keys e LEFT JOIN (SELECT d.case_group, d.disposition_label FROM disposed_signals d) d ON d.case_group = e.case_key GROUP BY ALL""")
def _(spark, sf_dir):
    path, schema = _events(spark, sf_dir)
    log, checkpoint = scratch_path(spark, "stream-log"), scratch_path(spark, "stream-state")
    arriving = _keyed(st.read_case_stream(spark, path, schema, files_per_trigger=1))
    # every batch joins the signals: they are aggregated once and stored
    routed = st.stream_case_disposition(arriving, materialize(signals(spark, sf_dir), "signals"))
    query = st.append_log(routed, log, checkpoint)
    query.awaitTermination()
    logged = spark.read.schema(CASE_LOG).parquet(log).select(
        F.col("case_id").cast("bigint").alias("event_id"), "disposition_label")
    kinds = v.table(spark, sf_dir, "events").select("event_id", "event_type")
    # as many rows on both sides as there are events: neither passes the driver
    return logged.join(kinds.hint("merge"), "event_id").groupBy("event_type", "disposition_label").agg(
        F.count("*").alias("rows"))


@query("batch_case_disposition", """
SELECT e.event_type, coalesce(d.disposition_label, 'Insufficient local evidence — human review required') AS disposition_label, count(*) AS rows
FROM event_keys e LEFT JOIN (SELECT d.case_group, d.disposition_label FROM disposed_signals d) d ON d.case_group = e.case_key GROUP BY ALL""")
def _(spark, sf_dir):
    cases = _keyed(v.table(spark, sf_dir, "events")).join(signals(spark, sf_dir), "case_key", "left")
    return tr.evaluate_cases(cases).groupBy(
        "event_type", F.col("disposition.label").alias("disposition_label")).agg(F.count("*").alias("rows"))


@query("stream_incremental_scoring", """
SELECT event_type, count(*) AS rows, round(sum(value), 6) AS scored_value FROM events GROUP BY ALL""",
       doubles="scored_value")
def _(spark, sf_dir):
    """Two passes over the same events: the second must score nothing again."""
    path, schema = _events(spark, sf_dir)
    result = scratch_path(spark, "scores")
    score = lambda df: df.select("event_id", "event_type", F.round("value", 2).alias("scored_value"))
    for name in ("first", "second"):
        arriving = st.read_case_stream(spark, path, schema, files_per_trigger=1)
        st.stream_incremental_scoring(arriving, score, result, scratch_path(spark, f"state-{name}"),
                                      key="event_id").awaitTermination()
    done = spark.read.schema("event_id bigint, event_type string, scored_value double").parquet(result)
    return done.groupBy("event_type").agg(
        F.count("*").alias("rows"), F.round(F.sum("scored_value"), 6).alias("scored_value"))
