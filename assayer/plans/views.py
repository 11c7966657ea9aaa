"""Evaluation-shaped views over the driver tables, in Spark and in SQL.

The two sides are written independently; the oracle compares them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.operators.grounding import TermLists
from assayer.plans.registry import SQL_VIEWS

# Term lists for the synthetic prose (the default medical lists never occur).
LISTS = TermLists(
    stopwords=["the", "and", "for", "with"], negation=["than", "thes"],
    uncertainty=["from", "are"], direction=["that", "was", "que"],
    high_impact=["tion", "ment", "der"])
STOP = ["the", "and", "for", "with"]
DIRECTION = ["that", "was", "que"]
SPLITS = ["train", "validation", "test"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def answers(spark, sf_dir, evidence: bool = False) -> DataFrame:
    """One answer per document: its text.  A document without a label counts as a correct answer.

    ``evidence`` adds ``knowledge``: the question and the whole text of the next document, if there is one.
    """
    d, l = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    items = b.agg(F.count("*").alias("n"))
    joined = (d.join(l, "doc_id", "left").withColumn("item_id", F.col("doc_id") % items.scalar())
              .join(b, "item_id", "left"))
    if evidence:
        after = documents(spark, sf_dir).select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("_next"))
        # the corpus meets itself: whole texts are shuffled, never broadcast
        joined = joined.join(after.hint("merge"), "doc_id", "left").withColumn(
            "knowledge", F.concat("question", F.lit(" "), F.coalesce("_next", F.lit(""))))
    wrong = F.coalesce(F.greatest(F.col("toxic"), 1 - F.col("quality")), F.lit(0))
    at = lambda k, values: F.element_at(F.array(*[F.lit(v) for v in values]),
                                        (F.col("doc_id") % k + 1).cast("int"))
    return joined.select(
        F.col("doc_id").cast("string").alias("record_id"), "doc_id",
        F.col("lang").alias("dataset_name"), F.col("source").alias("question_group_id"),
        "question", *(["knowledge"] if evidence else []),
        F.col("text").alias("answer"), wrong.alias("is_hallucinated"),
        F.when(wrong == 1, "student_answer").otherwise("correct_answer").alias("case_type"),
        F.when(F.col("doc_id") % 10 < 8, "dev").otherwise("eval").alias("source_split"),
        at(3, ["easy", "medium", "hard"]).alias("difficulty_level"),
        at(4, ["omission", "fabrication", "misread", "unclear"]).alias("hallucination_category"))


SQL_VIEWS["answers"] = """
SELECT CAST(d.doc_id AS VARCHAR) AS record_id, d.doc_id, d.lang AS dataset_name,
       d.source AS question_group_id, b.text AS question,
       b.text || ' ' || coalesce(n.text, '') AS knowledge, d.text AS answer,
       coalesce(greatest(l.toxic, 1 - l.quality), 0) AS is_hallucinated,
       CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 'student_answer' ELSE 'correct_answer' END AS case_type,
       CASE WHEN d.doc_id % 10 < 8 THEN 'dev' ELSE 'eval' END AS source_split,
       CASE d.doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty_level,
       CASE d.doc_id % 4 WHEN 0 THEN 'omission' WHEN 1 THEN 'fabrication'
            WHEN 2 THEN 'misread' ELSE 'unclear' END AS hallucination_category
FROM documents d LEFT JOIN labels l USING (doc_id)
LEFT JOIN documents n ON n.doc_id = d.doc_id + 1
LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)"""


def _scored(spark, sf_dir, multiplier: int) -> DataFrame:
    p = ((F.col("doc_id") * multiplier) % 101).cast("double") / 101.0
    return (answers(spark, sf_dir).withColumn("hallucination_probability", p)
            .withColumn("predicted_label", (F.col("hallucination_probability") >= 0.5).cast("int")))


def predictions(spark, sf_dir) -> DataFrame:
    return _scored(spark, sf_dir, 37)


def predictions_b(spark, sf_dir) -> DataFrame:
    return _scored(spark, sf_dir, 53)


for _name, _k in (("predictions", 37), ("predictions_b", 53)):
    SQL_VIEWS[_name] = f"""
SELECT *, CAST((doc_id * {_k}) % 101 AS DOUBLE) / 101.0 AS hallucination_probability,
       CAST(CAST((doc_id * {_k}) % 101 AS DOUBLE) / 101.0 >= 0.5 AS INTEGER) AS predicted_label
FROM answers"""


def _score(expr) -> "F.Column":
    return -(expr.cast("double")) / 40.0


def scores3(spark, sf_dir) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_linestatus", "l_shipdate",
        F.when(c("l_returnflag") == "A", "yes").when(c("l_returnflag") == "R", "no")
        .otherwise("maybe").alias("true_label"),
        _score((c("l_partkey") * 7) % 97).alias("score_yes"),
        _score((c("l_suppkey") * 11 + c("l_partkey")) % 89).alias("score_no"),
        _score((c("l_orderkey") * 13) % 83).alias("score_maybe"))


SQL_VIEWS["scores3"] = """
SELECT l_orderkey, l_linenumber, l_linestatus, l_shipdate,
       CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' ELSE 'maybe' END AS true_label,
       -CAST((l_partkey * 7) % 97 AS DOUBLE) / 40.0 AS score_yes,
       -CAST((l_suppkey * 11 + l_partkey) % 89 AS DOUBLE) / 40.0 AS score_no,
       -CAST((l_orderkey * 13) % 83 AS DOUBLE) / 40.0 AS score_maybe
FROM lineitem"""

# arg-max with first-listed tie break and top-1 minus top-2
SQL_VIEWS["scored3"] = """
SELECT *, CASE WHEN score_yes >= score_no AND score_yes >= score_maybe THEN 'yes'
               WHEN score_no >= score_maybe THEN 'no' ELSE 'maybe' END AS predicted_label,
       list_sort([score_yes, score_no, score_maybe], 'DESC')[1]
         - list_sort([score_yes, score_no, score_maybe], 'DESC')[2] AS confidence_margin
FROM scores3"""


def scored3(spark, sf_dir) -> DataFrame:
    from assayer.operators.trust import label_argmax_margin
    return label_argmax_margin(scores3(spark, sf_dir), {
        "yes": "score_yes", "no": "score_no", "maybe": "score_maybe"})


def scored3_safe(spark, sf_dir) -> DataFrame:
    """Confident predicted-yes rows made true, so a safe threshold exists."""
    return scored3(spark, sf_dir).withColumn("true_label", F.when(
        (F.col("predicted_label") == "yes") & (F.col("confidence_margin") > 1.5), "yes")
        .otherwise(F.col("true_label")))


SQL_VIEWS["scored3_safe"] = """
SELECT * REPLACE (CASE WHEN predicted_label = 'yes' AND confidence_margin > 1.5 THEN 'yes'
                       ELSE true_label END AS true_label)
FROM scored3"""


def pairs(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    ask = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    reply = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return ask.join(reply, ["conv_id", "turn"])


SQL_VIEWS["qa_pairs"] = """
SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role = 'assistant'"""


def grounded_pairs(spark, sf_dir) -> DataFrame:
    """Each answer, and the text two documents on as its hallucinated twin, on the same evidence."""
    a = answers(spark, sf_dir, evidence=True)
    other = documents(spark, sf_dir).select((F.col("doc_id") - 2).alias("doc_id"), F.col("text").alias("_other"))
    first = a.select(F.concat("record_id", F.lit("_ground_truth")).alias("record_id"),
                     "dataset_name", "knowledge", "answer", F.lit(0).alias("is_hallucinated"))
    second = a.join(other, "doc_id").select(
        F.concat("record_id", F.lit("_hallucinated")).alias("record_id"), "dataset_name",
        "knowledge", F.col("_other").alias("answer"), F.lit(1).alias("is_hallucinated"))
    return first.unionByName(second)


SQL_VIEWS["grounded_pairs"] = """
SELECT record_id || '_ground_truth' AS record_id, dataset_name, knowledge, answer, 0 AS is_hallucinated
FROM answers
UNION ALL
SELECT a.record_id || '_hallucinated', a.dataset_name, a.knowledge, d.text, 1
FROM answers a JOIN documents d ON d.doc_id = a.doc_id + 2"""


def bits(text: str) -> "F.Column":
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def sql_bits(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def splits(spark, sf_dir, evidence: bool = False) -> DataFrame:
    """Answers split by hash of a (source, language) group: some groups one-sided."""
    a = answers(spark, sf_dir, evidence).withColumn(
        "question_group_id", F.concat("question_group_id", F.lit("|"), "dataset_name"))
    slot = bits(F.concat("question_group_id", F.lit("|42"))) % 10
    return a.withColumn("split", F.when(slot < 6, "train").when(slot < 8, "validation")
                        .otherwise("test"))


SQL_VIEWS["splits"] = f"""
SELECT *, CASE WHEN slot < 6 THEN 'train' WHEN slot < 8 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, {sql_bits("question_group_id || '|42'")} % 10 AS slot
      FROM (SELECT * REPLACE (question_group_id || '|' || dataset_name AS question_group_id)
            FROM answers))"""


def splits_dirty(spark, sf_dir) -> DataFrame:
    s = splits(spark, sf_dir)
    copied = s.filter((F.col("split") == "train") & (F.col("doc_id") % 50 == 0))
    return s.unionByName(copied.withColumn("split", F.lit("test")))


SQL_VIEWS["splits_dirty"] = """
SELECT * FROM splits
UNION ALL
SELECT * REPLACE ('test' AS split) FROM splits WHERE split = 'train' AND doc_id % 50 = 0"""


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def evidence_table(spark, sf_dir) -> DataFrame:
    """Every vector with a text id and, where a document has its number, that document as evidence."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "source", F.col("text").alias("evidence"))
    return vectors(spark, sf_dir).join(d, "vec_id", "left").select(
        F.concat(F.lit("e"), "vec_id").alias("evidence_id"), "vec_id", "embedding",
        F.when(F.col("vec_id") % 5 == 0, "validation").otherwise("train").alias("split"),
        F.concat(F.lit("topic "), "label").alias("question"), "source", "evidence")


def query_vectors(spark, sf_dir) -> DataFrame:
    """Every vector is searched for among all of them."""
    return vectors(spark, sf_dir).select(F.concat(F.lit("q"), "vec_id").alias("query_id"), "embedding")


def near_queries(spark, sf_dir) -> DataFrame:
    """One query near each vector: it and a smaller part of the next one."""
    e = vectors(spark, sf_dir).select("vec_id", F.col("embedding").cast("array<double>").alias("_own"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("_own").alias("_next"))
    mixed = F.coalesce(F.zip_with("_own", "_next", lambda x, y: x + 0.6 * y), "_own")
    norm = F.sqrt(F.aggregate("_m", F.lit(0.0), lambda a, x: a + x * x))
    return (e.join(after, "vec_id", "left").withColumn("_m", mixed)
            .select("vec_id", F.transform("_m", lambda x: x / norm).alias("embedding")))


def clustered_vectors(spark, sf_dir) -> DataFrame:
    """Every vector moved towards one of the first sixteen: it counts for a seventh of the sum."""
    e = vectors(spark, sf_dir).select("vec_id", F.col("embedding").cast("array<double>").alias("_own"))
    centre = e.select(F.col("vec_id").alias("_at"), F.col("_own").alias("_centre"))
    joined = e.withColumn("_at", F.col("vec_id") % 16).join(centre, "_at").withColumn(
        "_m", F.zip_with("_centre", "_own", lambda x, y: x + 0.15 * y))
    norm = F.sqrt(F.aggregate("_m", F.lit(0.0), lambda a, x: a + x * x))
    return joined.select("vec_id", F.transform("_m", lambda x: x / norm).alias("embedding"))


SQL_VIEWS["corpus_vecs"] = """
SELECT 'e' || e.vec_id AS record_id, CAST(embedding AS DOUBLE[]) AS embedding,
       CASE WHEN e.vec_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split,
       'topic ' || label AS question, d.source, d.text AS evidence
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id"""
SQL_VIEWS["query_vecs"] = """
SELECT 'q' || vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings"""
# exact top 3 with the fixture guard
SQL_VIEWS["topk_hits"] = """
SELECT query_id, rank, record_id, round(score, 3) AS similarity_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM (
    SELECT q.query_id, c.record_id, round(list_dot_product(q.embedding, c.embedding), 12) AS score
    FROM query_vecs q, corpus_vecs c) WHERE score >= 0.30) WHERE rank <= 3"""
SQL_VIEWS["near_vecs"] = """
SELECT vec_id, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS embedding FROM (
  SELECT e.vec_id, CASE WHEN n.vec_id IS NULL THEN CAST(e.embedding AS DOUBLE[]) ELSE list_transform(
      list_zip(CAST(e.embedding AS DOUBLE[]), CAST(n.embedding AS DOUBLE[])), lambda p: p[1] + 0.6 * p[2]) END AS m
  FROM embeddings e LEFT JOIN embeddings n ON n.vec_id = e.vec_id + 1)"""


def claim_vectors(spark, sf_dir) -> DataFrame:
    """Every vector is a claim of one of 25 records."""
    return vectors(spark, sf_dir).select(
        (F.col("vec_id") % 25).alias("record_id"), F.col("vec_id").alias("claim_id"),
        (F.col("vec_id") % 6 == 0).alias("high_impact"), "embedding")


def evidence_vectors(spark, sf_dir) -> DataFrame:
    """Every vector is evidence of one of 23 of those records; the first two have none."""
    return vectors(spark, sf_dir).select(
        (F.col("vec_id") % 23 + 2).alias("record_id"), F.col("vec_id").alias("evidence_id"), "embedding")


SQL_VIEWS["claim_vecs"] = """
SELECT vec_id % 25 AS record_id, vec_id AS claim_id, vec_id % 6 = 0 AS high_impact,
       CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings"""
SQL_VIEWS["evidence_vecs"] = """
SELECT vec_id % 23 + 2 AS record_id, vec_id AS evidence_id, CAST(embedding AS DOUBLE[]) AS embedding
FROM embeddings"""
SQL_VIEWS["vec_best"] = """
SELECT record_id, claim_id, max(score) AS similarity FROM (
  SELECT c.record_id, c.claim_id, list_dot_product(c.embedding, e.embedding) AS score
  FROM claim_vecs c JOIN evidence_vecs e USING (record_id)) GROUP BY ALL"""
SQL_VIEWS["vec_claims"] = """
SELECT c.record_id, c.claim_id, c.high_impact,
       greatest(0.0, least(1.0, coalesce(b.similarity, 0.0))) AS claim_similarity,
       b.similarity IS NULL OR greatest(0.0, least(1.0, b.similarity)) < 0.30 AS unsupported
FROM claim_vecs c LEFT JOIN vec_best b USING (record_id, claim_id)"""
# one row per record of the vector fixture, with records that have no claims
SQL_VIEWS["vec_records"] = "SELECT DISTINCT vec_id % 26 AS record_id FROM embeddings"
SQL_VIEWS["vec_grounding"] = """
SELECT r.record_id, count(c.claim_id) AS claim_count,
       count(*) FILTER (WHERE NOT c.unsupported) AS grounded_claim_count,
       count(*) FILTER (WHERE c.unsupported) AS unsupported_claim_count,
       count(*) FILTER (WHERE c.unsupported AND c.high_impact) AS unsupported_high_impact_claim_count,
       coalesce(avg(c.claim_similarity), 0.0) AS semantic_grounding_score,
       coalesce(min(c.claim_similarity), 0.0) AS minimum_claim_grounding_score
FROM vec_records r LEFT JOIN vec_claims c USING (record_id) GROUP BY r.record_id"""


def vector_records(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).select((F.col("vec_id") % 26).alias("record_id")).distinct()


JUDGE_LEVELS = ["supported", "Fully Supported", "partial", "partly-supported", "no support",
                "garbage"]


def judge_raw(spark, sf_dir) -> DataFrame:
    """Predictions with free judge text: seven shapes, one of them broken JSON."""
    slot = F.col("doc_id") % 7
    level = F.element_at(F.array(*[F.lit(v) for v in JUDGE_LEVELS]), (slot + 1).cast("int"))
    raw = (F.when(slot < 6, F.concat(F.lit('noise {"support_level":"'), F.try_element_at(
        F.array(*[F.lit(v) for v in JUDGE_LEVELS]), (slot + 1).cast("int")),
        F.lit('","reason":"r'), F.col("record_id"), F.lit('"} tail')))
        .when(F.col("doc_id") % 2 == 0, F.concat(F.lit('noise {"support_level": oops} '),
                                                 F.col("question")))
        .otherwise(F.concat(F.lit("no object here "), F.col("question"))))
    return predictions(spark, sf_dir).withColumn("raw_output", raw)


SQL_VIEWS["judge_raw"] = """
SELECT *, CASE WHEN doc_id % 7 < 6 THEN 'noise {"support_level":"' ||
    ['supported', 'Fully Supported', 'partial', 'partly-supported', 'no support', 'garbage'][doc_id % 7 + 1]
    || '","reason":"r' || record_id || '"} tail'
  WHEN doc_id % 2 = 0 THEN 'noise {"support_level": oops} ' || question
  ELSE 'no object here ' || question END AS raw_output
FROM predictions"""
SQL_VIEWS["judged"] = """
SELECT *, CASE WHEN flat IN ('supported', 'fully_supported', 'directly_supported') THEN 'supported'
    WHEN flat IN ('partial', 'partially_supported', 'partly_supported') THEN 'partial'
    WHEN flat IN ('unsupported', 'not_supported', 'not_directly_supported', 'no_support') THEN 'unsupported'
    ELSE 'unknown' END AS support_level
FROM (SELECT *, replace(replace(lower(trim(coalesce(json_extract_string(
        CASE WHEN json_valid(body) THEN body END, '$.support_level'), 'unknown'))), '-', '_'), ' ', '_') AS flat,
    CASE WHEN body <> '' AND json_valid(body) THEN coalesce(json_extract_string(body, '$.reason'), '')
         ELSE substr(raw_output, 1, 250) END AS judge_reason
  FROM (SELECT *, regexp_extract(raw_output, '(?s)\\{.*?\\}') AS body FROM judge_raw))"""


def stances(spark, sf_dir) -> DataFrame:
    """Documents prefixed with an explicit (or no) stance."""
    prefix = F.element_at(F.array(*[F.lit(v) for v in (
        "Yes. ", "No. ", "Maybe ", "It is  unclear ", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return documents(spark, sf_dir).select(
        "doc_id", "lang", F.concat(prefix, "text", F.when(
            F.col("doc_id") % 11 == 4, " The evidence is mixed.").otherwise("")).alias("candidate_answer"))


SQL_VIEWS["stances"] = """
SELECT doc_id, lang, CASE doc_id % 5 WHEN 0 THEN 'Yes. ' WHEN 1 THEN 'No. ' WHEN 2 THEN 'Maybe '
       WHEN 3 THEN 'It is  unclear ' ELSE '' END || text ||
       CASE WHEN doc_id % 11 = 4 THEN ' The evidence is mixed.' ELSE '' END AS candidate_answer
FROM documents"""

REVIEW_VOCABULARY = {
    "manual_clinical_safety": (7, ["safe", "concern", "unsafe"]),
    "manual_fairness": (11, ["fair", "concern", "unfair"]),
    "manual_stereotype": (13, ["absent", "unclear", "present"]),
    "manual_paired_consistency": (17, ["consistent", "materially_inconsistent", "not_comparable"]),
    "manual_care_guidance": (19, ["appropriate", "not_required", "missing"]),
    "manual_response_completeness": (23, ["complete", "truncated"]),
    "manual_overall_risk": (29, ["low", "medium", "high"]),
    "manual_review_outcome": (31, ["pass", "needs_revision", "fail"]),
    "clinical_validation_required": (37, ["no", "yes"]),
}


def reviews(spark, sf_dir) -> DataFrame:
    """Answers with nine manual labels; every 43rd overall risk is missing."""
    out = answers(spark, sf_dir).select(
        F.col("record_id").alias("review_id"), "doc_id", "dataset_name",
        F.when(F.col("doc_id") % 2 == 0, "single_prompt_fairness")
        .otherwise("paired_prompt_comparison").alias("evaluation_type"),
        F.col("hallucination_category").alias("fairness_category"))
    for name, (prime, values) in REVIEW_VOCABULARY.items():
        slot = F.floor((F.col("doc_id") * prime) % 101 / F.lit(7)) % len(values)
        out = out.withColumn(name, F.element_at(
            F.array(*[F.lit(v) for v in values]), (slot + 1).cast("int")))
    return out.withColumn("manual_overall_risk", F.when(
        F.col("doc_id") % 43 != 0, F.col("manual_overall_risk")))


def _review_column(name: str) -> str:
    prime, values = REVIEW_VOCABULARY[name]
    listed = "[" + ", ".join(f"'{v}'" for v in values) + "]"
    expr = f"{listed}[((doc_id * {prime}) % 101 // 7) % {len(values)} + 1]"
    if name == "manual_overall_risk":
        expr = f"CASE WHEN doc_id % 43 <> 0 THEN {expr} END"
    return f"{expr} AS {name}"


SQL_VIEWS["reviews"] = f"""
SELECT record_id AS review_id, doc_id, dataset_name,
       CASE WHEN doc_id % 2 = 0 THEN 'single_prompt_fairness' ELSE 'paired_prompt_comparison' END AS evaluation_type,
       hallucination_category AS fairness_category,
       {", ".join(_review_column(n) for n in REVIEW_VOCABULARY)}
FROM answers"""


def responses(spark, sf_dir) -> DataFrame:
    """Single and paired responses; single rows have no second side."""
    paired = F.col("doc_id") % 2 == 1
    return answers(spark, sf_dir, evidence=True).select(
        "record_id", "doc_id", "dataset_name",
        F.when(paired, "paired_prompt_comparison").otherwise("single_prompt_fairness").alias(
            "evaluation_type"),
        F.when(~paired, F.col("hallucination_category")).alias("fairness_category"),
        F.col("question").alias("prompt_a"), F.when(paired, F.col("knowledge")).alias("prompt_b"),
        F.col("answer").alias("model_response_a"),
        F.when(paired, F.col("question")).alias("model_response_b"))


SQL_VIEWS["responses"] = """
SELECT record_id, doc_id, dataset_name,
       CASE WHEN doc_id % 2 = 1 THEN 'paired_prompt_comparison' ELSE 'single_prompt_fairness' END AS evaluation_type,
       CASE WHEN doc_id % 2 = 0 THEN hallucination_category END AS fairness_category,
       question AS prompt_a, CASE WHEN doc_id % 2 = 1 THEN knowledge END AS prompt_b,
       answer AS model_response_a, CASE WHEN doc_id % 2 = 1 THEN question END AS model_response_b
FROM answers"""

CASE_STANCES = ["Yes. It does.", "No. It does not.", "Maybe so.", "We cannot say.",
                "Plain text.", "Yes, consult someone.", "The answer is no."]


def cases(spark, sf_dir) -> DataFrame:
    """One evaluation case per line item; every 13th found no evidence."""
    c = F.col
    li = table(spark, sf_dir, "lineitem")
    similarity = F.when(c("l_suppkey") % 13 != 0,
                        (50 + (c("l_suppkey") * 17 + c("l_partkey") * 3) % 51).cast("double") / 100.0)
    return li.select(
        c("l_orderkey").alias("case_group"), "l_linenumber", "l_shipdate",
        F.element_at(F.array(*[F.lit(s) for s in CASE_STANCES]),
                     ((c("l_partkey") + c("l_linenumber")) % 7 + 1).cast("int")).alias("candidate_answer"),
        _score((c("l_partkey") * 7) % 97).alias("score_yes"),
        _score((c("l_suppkey") * 11 + c("l_partkey")) % 89).alias("score_no"),
        _score((c("l_orderkey") * 13) % 83).alias("score_maybe"),
        _score((c("l_orderkey") * 5 + c("l_linenumber")) % 71).alias("score_supported"),
        _score((c("l_partkey") * 3 + c("l_suppkey")) % 73).alias("score_hallucinated"),
        similarity.alias("best_similarity"))


SQL_VIEWS["cases"] = f"""
SELECT l_orderkey AS case_group, l_linenumber, l_shipdate,
       {"[" + ", ".join(f"'{s}'" for s in CASE_STANCES) + "]"}[(l_partkey + l_linenumber) % 7 + 1] AS candidate_answer,
       -CAST((l_partkey * 7) % 97 AS DOUBLE) / 40.0 AS score_yes,
       -CAST((l_suppkey * 11 + l_partkey) % 89 AS DOUBLE) / 40.0 AS score_no,
       -CAST((l_orderkey * 13) % 83 AS DOUBLE) / 40.0 AS score_maybe,
       -CAST((l_orderkey * 5 + l_linenumber) % 71 AS DOUBLE) / 40.0 AS score_supported,
       -CAST((l_partkey * 3 + l_suppkey) % 73 AS DOUBLE) / 40.0 AS score_hallucinated,
       CASE WHEN l_suppkey % 13 <> 0
            THEN CAST(50 + (l_suppkey * 17 + l_partkey * 3) % 51 AS DOUBLE) / 100.0 END AS best_similarity
FROM lineitem"""
SQL_VIEWS["evaluated"] = """
SELECT *, CASE WHEN evidence_label IN ('yes', 'no') AND candidate_stance IN ('yes', 'no')
               THEN CASE WHEN evidence_label = candidate_stance THEN 'consistent' ELSE 'contradiction' END
               ELSE 'uncertain' END AS consistency_label
FROM (SELECT *,
    CASE WHEN score_yes >= score_no AND score_yes >= score_maybe THEN 'yes'
         WHEN score_no >= score_maybe THEN 'no' ELSE 'maybe' END AS evidence_label,
    list_sort([score_yes, score_no, score_maybe], 'DESC')[1]
      - list_sort([score_yes, score_no, score_maybe], 'DESC')[2] AS evidence_margin,
    CASE WHEN score_hallucinated >= score_supported THEN 'hallucinated' ELSE 'supported' END AS safety_label,
    abs(score_supported - score_hallucinated) AS safety_margin,
    CASE WHEN candidate_answer LIKE 'Yes%' THEN 'yes'
         WHEN candidate_answer LIKE 'No%' OR candidate_answer LIKE 'The answer is no%' THEN 'no'
         WHEN candidate_answer LIKE 'Maybe%' THEN 'maybe' ELSE 'uncertain' END AS candidate_stance
  FROM cases)"""
SQL_VIEWS["routed"] = """
SELECT *, CASE WHEN flagged OR conflict THEN 'Mandatory human review'
               WHEN reason_count > 0 THEN 'Human review required'
               ELSE 'Lower-priority human review' END AS routing_action
FROM (SELECT *, CAST(flagged AS INT) + CAST(inconclusive AS INT) + CAST(conflict AS INT)
             + CAST(undetermined AS INT) + CAST(low_margin AS INT) + CAST(refusal AS INT) AS reason_count
  FROM (SELECT *, safety_label = 'hallucinated' AS flagged, evidence_label = 'maybe' AS inconclusive,
      consistency_label = 'contradiction' AS conflict,
      consistency_label = 'uncertain' AND evidence_label <> 'maybe' AS undetermined,
      safety_margin < 0.15 OR evidence_margin < 0.15 AS low_margin,
      contains(lower(candidate_answer), 'cannot') OR contains(lower(candidate_answer), 'consult') AS refusal
    FROM evaluated))"""
SQL_VIEWS["disposed"] = """
SELECT *, CASE WHEN best_similarity IS NULL THEN 'Insufficient local evidence — human review required'
    WHEN round(best_similarity, 3) < 0.90 THEN
      CASE WHEN routing_action = 'Mandatory human review' THEN routing_action ELSE 'Human review required' END
    WHEN consistency_label = 'contradiction' THEN 'Benchmark fail — evidence conflict'
    WHEN safety_label = 'hallucinated' THEN
      CASE WHEN round(safety_margin, 3) >= 0.75 THEN 'Benchmark fail — evidence conflict'
           ELSE 'Human review required' END
    WHEN routing_action = 'Lower-priority human review' AND evidence_label IN ('yes', 'no')
      AND candidate_stance IN ('yes', 'no') AND consistency_label = 'consistent'
      AND round(safety_margin, 3) >= 0.75 AND round(evidence_margin, 3) >= 0.75
      THEN 'Benchmark pass — evidence aligned'
    ELSE 'Human review required' END AS disposition_label
FROM routed"""

# --- SQL building blocks ----------------------------------------------------

WS = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def sql_words(x: str) -> str:
    return (f"(CASE WHEN {sql_clean(x)} = '' THEN 0 "
            f"ELSE len(string_split({sql_clean(x)}, ' ')) END)")


def sql_alpha(x: str, stop=STOP) -> str:
    listed = ", ".join(f"'{s}'" for s in stop)
    return (f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z]+'), "
            f"lambda t: length(t) > 2 AND t NOT IN ({listed})))")


def sql_claim_tokens(x: str, stop=STOP) -> str:
    listed = ", ".join(f"'{s}'" for s in stop)
    return (f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z]+|\\d+(?:\\.\\d+)?'), "
            f"lambda t: (length(t) > 2 OR regexp_full_match(t, '\\d+')) AND t NOT IN ({listed})))")


def sql_numbers(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '\\d+(?:\\.\\d+)?'))"


def sql_pieces(x: str, min_length: int) -> str:
    marked = (f"regexp_replace(regexp_replace(regexp_replace({sql_strip(x)}, '([.!?])\\s+', "
              f"'\\1' || chr(1), 'g'), ';\\s+', chr(1), 'g'), '\\n+', chr(1), 'g')")
    return (f"list_filter(list_transform(string_split({marked}, chr(1)), lambda p: {sql_strip('p')}), "
            f"lambda p: length(p) >= {min_length})")


def sql_align(claim: str, evidence: str) -> str:
    return (f"CASE WHEN len({claim}) = 0 THEN 1.0 WHEN len({evidence}) = 0 THEN 0.0 "
            f"ELSE CAST(len(list_intersect({claim}, {evidence})) AS DOUBLE) / len({claim}) END")


def sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sql_jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return (f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 "
            f"ELSE CAST({both} AS DOUBLE) / (len({a}) + len({b}) - {both}) END")


SQL_VIEWS["claim_tokens"] = f"""
SELECT record_id, dataset_name, is_hallucinated, et, en, claim_index, claim_text,
       {sql_claim_tokens("claim_text")} AS ct, {sql_numbers("claim_text")} AS cn
FROM (SELECT record_id, dataset_name, is_hallucinated, et, en, unnest(claims) AS claim_text,
             generate_subscripts(claims, 1) AS claim_index
      FROM (SELECT record_id, dataset_name, is_hallucinated, {sql_pieces("answer", 12)} AS claims,
                   {sql_claim_tokens("knowledge")} AS et, {sql_numbers("knowledge")} AS en
            FROM answers))"""
SQL_VIEWS["claim_parts"] = f"""
SELECT record_id, dataset_name, is_hallucinated, claim_index, claim_text,
       CASE WHEN len(ct) = 0 THEN 0.0
            ELSE CAST(len(list_intersect(ct, et)) AS DOUBLE) / len(ct) END AS token_support,
       {sql_align("list_intersect(ct, " + sql_list(DIRECTION) + ")", "list_intersect(et, " + sql_list(DIRECTION) + ")")} AS direction_support,
       {sql_align("list_intersect(ct, ['than', 'thes'])", "list_intersect(et, ['than', 'thes'])")} AS negation_support,
       {sql_align("cn", "en")} AS numeric_support,
       {sql_align("list_intersect(ct, ['from', 'are'])", "list_intersect(et, ['from', 'are'])")} AS uncertainty_support,
       list_has_any(ct, ['tion', 'ment', 'der']) AS high_impact
FROM claim_tokens"""
SQL_VIEWS["claim_scored"] = """
SELECT *, CASE WHEN score >= 0.70 THEN 'supported' WHEN score >= 0.40 THEN 'partial'
               ELSE 'unsupported' END AS support_label,
       high_impact AND score < 0.40 AS unsupported_high_impact,
       direction_support < 0.5 OR negation_support < 0.5 OR numeric_support < 0.5 AS contradiction
FROM (SELECT *, 0.55::DOUBLE * token_support + 0.20::DOUBLE * direction_support
             + 0.10::DOUBLE * negation_support + 0.10::DOUBLE * numeric_support
             + 0.05::DOUBLE * uncertainty_support AS score
      FROM claim_parts)"""
SQL_VIEWS["claim_rollup"] = """
SELECT a.record_id, a.dataset_name, a.is_hallucinated, count(c.claim_index) AS claim_count,
       count(*) FILTER (WHERE support_label = 'supported') AS supported_claim_count,
       count(*) FILTER (WHERE support_label = 'partial') AS partial_claim_count,
       count(*) FILTER (WHERE support_label = 'unsupported') AS unsupported_claim_count,
       count(*) FILTER (WHERE unsupported_high_impact) AS unsupported_high_impact_claim_count,
       count(*) FILTER (WHERE contradiction) AS contradiction_risk_count,
       coalesce(avg(score), 0.0) AS answer_claim_grounding_score
FROM answers a LEFT JOIN claim_scored c USING (record_id)
GROUP BY a.record_id, a.dataset_name, a.is_hallucinated"""
# semantic stand-in for even documents: token overlap blended with the lexical score
SQL_VIEWS["semantic_scored"] = """
SELECT *, 0.70::DOUBLE * semantic + 0.30::DOUBLE * score AS combined
FROM (SELECT record_id, claim_index, score, token_support AS semantic FROM claim_scored
      WHERE CAST(record_id AS BIGINT) % 2 = 0)"""
SQL_VIEWS["grounding"] = """
SELECT l.*, coalesce(s.combined_grounding, l.answer_claim_grounding_score) AS final_grounding_score,
       coalesce(s.combined_unsupported, l.unsupported_claim_count) AS final_unsupported_claim_count
FROM claim_rollup l LEFT JOIN (
  SELECT record_id, avg(combined) AS combined_grounding,
         count(*) FILTER (WHERE combined < 0.35) AS combined_unsupported
  FROM semantic_scored GROUP BY record_id) s USING (record_id)"""
# every prediction, and some more under ids that no answer has: their grounding is missing
SQL_VIEWS["trust_predictions"] = """
SELECT * FROM predictions
UNION ALL
SELECT * REPLACE ('unseen-' || record_id AS record_id) FROM predictions WHERE doc_id % 11 = 3"""
SQL_VIEWS["trust"] = """
SELECT *, CASE WHEN score IS NULL OR coalesce(high_impact > 0, false) OR conflict = 1 OR score < 0.45
               THEN 'mandatory_human_review'
               WHEN score < 0.65 THEN 'human_review' WHEN score < 0.80 THEN 'revise'
               ELSE 'accept' END AS recommended_action
FROM (SELECT *, CASE WHEN final_grounding_score IS NULL THEN NULL ELSE greatest(0.0, least(1.0,
        1 - 0.45::DOUBLE * hallucination_probability - 0.35::DOUBLE * (1 - final_grounding_score)
          - 0.15::DOUBLE * (least(final_unsupported_claim_count, 3) / 3.0::DOUBLE) - 0.05::DOUBLE * conflict)) END AS score
  FROM (SELECT p.*, g.final_grounding_score, g.final_unsupported_claim_count,
          g.unsupported_high_impact_claim_count AS high_impact,
          CAST(p.predicted_label = 0 AND coalesce(g.final_unsupported_claim_count, 0) > 0 AS INT) AS conflict
        FROM trust_predictions p LEFT JOIN grounding g USING (record_id)))"""


def lexical_rollup(spark, sf_dir) -> DataFrame:
    from assayer.operators.grounding import claim_grounding_rollup
    return claim_grounding_rollup(answers(spark, sf_dir, evidence=True),
                                  ["record_id", "dataset_name", "is_hallucinated"], LISTS)


def grounding(spark, sf_dir) -> DataFrame:
    """Lexical grounding, semantic for even documents.

    Both come from the same claim rows, so the text is split and scored once.
    """
    from assayer.operators.grounding import claim_grounding_with_semantics
    from assayer.operators.trust import final_grounding
    even = F.col("record_id").cast("bigint") % 2 == 0
    both = claim_grounding_with_semantics(
        answers(spark, sf_dir, evidence=True), ["record_id"],
        F.when(even, F.col("claim_token_support")), LISTS)
    return final_grounding(both)


def trust_predictions(spark, sf_dir) -> DataFrame:
    """Every prediction, and some more under ids that no answer has: their grounding is missing."""
    p = predictions(spark, sf_dir)
    return p.unionByName(p.filter(F.col("doc_id") % 11 == 3).withColumn(
        "record_id", F.concat(F.lit("unseen-"), "record_id")))


def trust(spark, sf_dir) -> DataFrame:
    from assayer.operators.trust import trust_score
    return trust_score(trust_predictions(spark, sf_dir), grounding(spark, sf_dir))


# model table for the vector variant: one prediction per record of the vector fixture
SQL_VIEWS["vec_predictions"] = """
SELECT record_id, CAST(record_id % 3 = 0 AS INTEGER) AS is_hallucinated,
       CAST((record_id * 37) % 101 AS DOUBLE) / 101.0 AS hallucination_probability,
       CAST(CAST((record_id * 37) % 101 AS DOUBLE) / 101.0 >= 0.5 AS INTEGER) AS predicted_label
FROM vec_records"""
SQL_VIEWS["vec_trust"] = """
SELECT *, CASE WHEN unsupported_high_impact_claim_count > 0 OR conflict = 1 OR score < 0.45
               THEN 'mandatory_human_review' WHEN score < 0.65 THEN 'human_review'
               WHEN score < 0.80 THEN 'revise' ELSE 'accept' END AS recommended_action
FROM (SELECT *, greatest(0.0, least(1.0, 1 - 0.45::DOUBLE * hallucination_probability
        - 0.35::DOUBLE * (1 - semantic_grounding_score)
        - 0.15::DOUBLE * (least(unsupported_claim_count, 3) / 3.0::DOUBLE) - 0.05::DOUBLE * conflict)) AS score
  FROM (SELECT p.*, g.* EXCLUDE (record_id),
          CAST(p.predicted_label = 0 AND g.semantic_grounding_score < 0.35 AS INT) AS conflict
        FROM vec_predictions p JOIN vec_grounding g USING (record_id)))"""


def vector_grounding(spark, sf_dir) -> DataFrame:
    from assayer.operators.grounding import evidence_grounding_vec
    return evidence_grounding_vec(vector_records(spark, sf_dir), claim_vectors(spark, sf_dir),
                                  evidence_vectors(spark, sf_dir), threshold=0.30)


def vector_predictions(spark, sf_dir) -> DataFrame:
    p = ((F.col("record_id") * 37) % 101).cast("double") / 101.0
    return (vector_records(spark, sf_dir)
            .withColumn("is_hallucinated", (F.col("record_id") % 3 == 0).cast("int"))
            .withColumn("hallucination_probability", p)
            .withColumn("predicted_label", (F.col("hallucination_probability") >= 0.5).cast("int")))


def vector_trust(spark, sf_dir) -> DataFrame:
    from assayer.operators.trust import trust_score_vec
    return trust_score_vec(vector_predictions(spark, sf_dir), vector_grounding(spark, sf_dir))
