"""Sampling, splits and leakage control."""

from pyspark.sql import functions as F

from assayer.operators import checked as ck, expect as ex, splits as sp
from assayer.plans import views as v
from assayer.plans.registry import SQL_VIEWS, query
from assayer.sources import writers

SQL_VIEWS["paired"] = """
SELECT question_group_id, record_id, is_hallucinated FROM (
  SELECT *, row_number() OVER (PARTITION BY question_group_id, is_hallucinated ORDER BY record_id) AS rn,
         min(is_hallucinated) OVER (PARTITION BY question_group_id) AS lo,
         max(is_hallucinated) OVER (PARTITION BY question_group_id) AS hi
  FROM splits) WHERE rn = 1 AND lo = 0 AND hi = 1"""


def _small(spark, sf_dir):
    return v.splits(spark, sf_dir).select(
        "record_id", "doc_id", "question_group_id", "is_hallucinated", "dataset_name", "split",
        "source_split")


@query("balanced_pairs_per_group", "SELECT * FROM paired")
def _(spark, sf_dir):
    return sp.balanced_pairs_per_group(_small(spark, sf_dir)).select(
        "question_group_id", "record_id", "is_hallucinated")


@query("choose_groups", """
SELECT record_id, question_group_id FROM splits WHERE question_group_id IN (
  SELECT question_group_id FROM (SELECT DISTINCT question_group_id FROM splits)
  ORDER BY md5(question_group_id || '|42'), question_group_id LIMIT 12)""")
def _(spark, sf_dir):
    return sp.choose_groups(_small(spark, sf_dir), 12).select("record_id", "question_group_id")


@query("exclude_groups", """
SELECT record_id, question_group_id, split FROM splits WHERE question_group_id NOT IN (
  SELECT question_group_id FROM splits_dirty WHERE split = 'test')""")
def _(spark, sf_dir):
    protected = v.splits_dirty(spark, sf_dir).filter(F.col("split") == "test")
    return sp.exclude_groups(_small(spark, sf_dir), protected).select(
        "record_id", "question_group_id", "split")


@query("unseen_holdout", """
WITH fresh AS (SELECT * FROM paired WHERE question_group_id NOT IN (
    SELECT question_group_id FROM splits WHERE split = 'train' AND doc_id % 2 = 0))
SELECT question_group_id, record_id, is_hallucinated FROM fresh WHERE question_group_id IN (
  SELECT question_group_id FROM (SELECT DISTINCT question_group_id FROM fresh)
  ORDER BY md5(question_group_id || '|42'), question_group_id LIMIT 10)""")
def _(spark, sf_dir):
    s = _small(spark, sf_dir)
    train = s.filter((F.col("split") == "train") & (F.col("doc_id") % 2 == 0))
    return sp.unseen_holdout(s, train, 10, strict=False).select(
        "question_group_id", "record_id", "is_hallucinated")


@query("split_leakage_matrix", """
WITH g AS (SELECT DISTINCT question_group_id, split, source FROM (
  SELECT question_group_id, split, 'clean' AS source FROM splits
  UNION ALL SELECT question_group_id, split, 'dirty' FROM splits_dirty)),
p AS (SELECT s.source, a.split_a, a.split_b FROM (SELECT unnest(['clean', 'dirty']) AS source) s,
  (SELECT unnest(['train', 'train', 'validation']) AS split_a, unnest(['validation', 'test', 'test']) AS split_b) a)
SELECT p.source, p.split_a, p.split_b, count(y.question_group_id) AS shared_groups,
       count(y.question_group_id) = 0 AS passed
FROM p LEFT JOIN g x ON x.source = p.source AND x.split = p.split_a
LEFT JOIN g y ON y.source = p.source AND y.split = p.split_b AND y.question_group_id = x.question_group_id
GROUP BY ALL""")
def _(spark, sf_dir):
    clean = sp.split_leakage_matrix(v.splits(spark, sf_dir), v.SPLITS).withColumn("source", F.lit("clean"))
    dirty = sp.split_leakage_matrix(v.splits_dirty(spark, sf_dir), v.SPLITS).withColumn(
        "source", F.lit("dirty"))
    return clean.unionByName(dirty)


@query("label_balance_check", """
SELECT split, count(*) AS rows, count(*) FILTER (WHERE is_hallucinated = 0) AS count_0,
       count(*) FILTER (WHERE is_hallucinated = 1) AS count_1,
       count(*) FILTER (WHERE is_hallucinated = 0) = count(*) FILTER (WHERE is_hallucinated = 1) AS passed
FROM (SELECT split, is_hallucinated FROM splits
      UNION ALL SELECT 'paired', is_hallucinated FROM paired) GROUP BY ALL""")
def _(spark, sf_dir):
    s = _small(spark, sf_dir)
    pairs = sp.balanced_pairs_per_group(s).withColumn("split", F.lit("paired"))
    both = s.select("split", "is_hallucinated").unionByName(pairs.select("split", "is_hallucinated"))
    return ex.label_balance_check(both, ["split"], "is_hallucinated", [0, 1])


QUOTAS = {"test": {"en": (1, 40), "de": (1, 10)}, "validation": {"en": (41, 60), "de": (11, 15)},
          "train": {"en": (61, None), "de": (16, None), "fr": (1, 30)}}


@query("rank_range_split", """
SELECT record_id, label, label_rank, split FROM (
  SELECT *, CASE WHEN (label = 'en' AND label_rank <= 40) OR (label = 'de' AND label_rank <= 10) THEN 'test'
      WHEN (label = 'en' AND label_rank <= 60) OR (label = 'de' AND label_rank <= 15) THEN 'validation'
      WHEN label IN ('en', 'de') OR (label = 'fr' AND label_rank <= 30) THEN 'train' END AS split
  FROM (SELECT CAST(doc_id AS VARCHAR) AS record_id, lang AS label,
          row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), CAST(doc_id AS VARCHAR)) AS label_rank
        FROM documents)) WHERE split IS NOT NULL""")
def _(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("record_id"), F.col("lang").alias("label"))
    return sp.rank_range_split(d, QUOTAS).select("record_id", "label", "label_rank", "split")


@query("stratified_quota_sample", """
WITH ranked AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, lang AS label,
    row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), CAST(doc_id AS VARCHAR)) AS label_rank,
    dense_rank() OVER (ORDER BY lang) AS position FROM documents),
k AS (SELECT count(DISTINCT lang) AS n FROM documents)
SELECT record_id, label, label_rank FROM ranked, k
WHERE label_rank <= 50 // n + CASE WHEN position <= 50 % n THEN 1 ELSE 0 END""")
def _(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("record_id"), F.col("lang").alias("label"))
    return sp.stratified_quota_sample(d, 50).select("record_id", "label", "label_rank")


@query("stratified_fraction_split", """
SELECT doc_id, lang, CASE WHEN rn <= n * 0.6::DOUBLE THEN 'train' WHEN rn <= n * 0.8::DOUBLE THEN 'validation'
                          ELSE 'test' END AS split
FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) AS rn,
             count(*) OVER (PARTITION BY lang) AS n FROM documents)""")
def _(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sp.stratified_fraction_split(d, {"train": 0.6, "validation": 0.2, "test": 0.2},
                                        key="doc_id", label="lang").select("doc_id", "lang", "split")


@query("group_shuffle_split", f"""
SELECT source, lang, CASE WHEN {v.sql_bits("source")} % 100 < 20 THEN 'test' ELSE 'train' END AS split,
       count(*) AS rows FROM documents GROUP BY ALL""")
def _(spark, sf_dir):
    return (sp.group_shuffle_split(v.table(spark, sf_dir, "documents"), "source")
            .groupBy("source", "lang", "split").agg(F.count("*").alias("rows")))


@query("balanced_class_sample", """
SELECT record_id, dataset_name, is_hallucinated FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_name, is_hallucinated
                               ORDER BY md5(record_id || '|42'), record_id) AS rn FROM splits) WHERE rn <= 7""")
def _(spark, sf_dir):
    return sp.balanced_class_sample(_small(spark, sf_dir), 7, ["dataset_name", "is_hallucinated"]).select(
        "record_id", "dataset_name", "is_hallucinated")


@query("class_shortfalls", """
SELECT dataset_name, is_hallucinated, count(*) AS rows, 400 - count(*) AS missing FROM splits GROUP BY ALL HAVING count(*) < 400""")
def _(spark, sf_dir):
    return ck.class_shortfalls(_small(spark, sf_dir), 400, ["dataset_name", "is_hallucinated"])


@query("strict_class_sample", """
SELECT record_id, dataset_name FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY md5(record_id || '|42'), record_id) AS rn FROM splits) WHERE rn <= 3""")
def _(spark, sf_dir):
    """Fails where a class is too small; every language has three answers."""
    return sp.balanced_class_sample(_small(spark, sf_dir), 3, ["dataset_name"], strict=True).select(
        "record_id", "dataset_name")


@query("head_per_group", """
SELECT record_id, question_group_id FROM (
  SELECT *, row_number() OVER (PARTITION BY question_group_id ORDER BY doc_id) AS rn FROM splits) WHERE rn <= 2""")
def _(spark, sf_dir):
    return sp.head_per_group(_small(spark, sf_dir), ["question_group_id"], ["doc_id"], 2).select(
        "record_id", "question_group_id")


SQL_VIEWS["tag_rows"] = """
SELECT record_id, dataset_name, hallucination_category AS fairness_category, question AS prompt_a, knowledge AS prompt_b,
       CAST(doc_id % 2 AS INTEGER) AS has_pair FROM answers
UNION ALL
SELECT record_id, dataset_name, hallucination_category, question, knowledge, CAST(doc_id % 2 AS INTEGER) FROM answers
WHERE doc_id % 3 = 0"""


def _tags(spark, sf_dir):
    """Tagged prompts in which every third row occurs twice."""
    a = v.answers(spark, sf_dir, evidence=True).select(
        "record_id", "dataset_name", F.col("hallucination_category").alias("fairness_category"),
        F.col("question").alias("prompt_a"), F.col("knowledge").alias("prompt_b"),
        (F.col("doc_id") % 2).cast("int").alias("has_pair"), "doc_id")
    return a.unionByName(a.filter(F.col("doc_id") % 3 == 0)).drop("doc_id")


SQL_VIEWS["category_sample"] = """
SELECT record_id, dataset_name, fairness_category, prompt_a FROM (
  SELECT *, row_number() OVER (PARTITION BY fairness_category ORDER BY md5(record_id || '|42'), record_id) AS rn
  FROM (SELECT DISTINCT * FROM tag_rows)) WHERE rn <= 5"""
SQL_VIEWS["paired_sample"] = """
SELECT record_id, dataset_name, prompt_a, prompt_b FROM (SELECT DISTINCT * FROM tag_rows) WHERE has_pair = 1
ORDER BY md5(record_id || '|42'), record_id LIMIT 20"""


@query("category_review_sample", """
SELECT record_id, fairness_category, 'category' AS sample FROM category_sample
UNION ALL SELECT record_id, NULL, 'paired' FROM paired_sample""")
def _(spark, sf_dir):
    tags = _tags(spark, sf_dir)
    first = sp.category_review_sample(tags).select(
        "record_id", "fairness_category", F.lit("category").alias("sample"))
    inventory = tags.dropDuplicates(["record_id", "fairness_category"])
    second = sp.paired_review_sample(inventory).select(
        "record_id", F.lit(None).cast("string").alias("fairness_category"), F.lit("paired").alias("sample"))
    return first.unionByName(second)


@query("error_review_sample", """
SELECT record_id, error_type, hallucination_probability FROM (
  SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY md5(record_id || '|42'), record_id) AS rn
  FROM (SELECT *, CASE WHEN is_hallucinated = 0 AND predicted_label = 1 THEN 'false_positive'
                       WHEN is_hallucinated = 1 AND predicted_label = 0 THEN 'false_negative' END AS error_type
        FROM predictions) WHERE error_type IS NOT NULL) WHERE rn <= 20""")
def _(spark, sf_dir):
    return sp.error_review_sample(v.predictions(spark, sf_dir)).select(
        "record_id", "error_type", "hallucination_probability")


@query("review_template", """
SELECT 'single_prompt_fairness' AS evaluation_type, dataset_name, record_id, fairness_category, md5(prompt_a) AS prompt_a_md5,
       md5('') AS prompt_b_md5, '' AS notes FROM category_sample
UNION ALL
SELECT 'paired_prompt_comparison', dataset_name, record_id, '', md5(prompt_a), md5(prompt_b), '' FROM paired_sample""")
def _(spark, sf_dir):
    tags = _tags(spark, sf_dir)
    sheet = sp.review_template(
        sp.category_review_sample(tags),
        sp.paired_review_sample(tags.dropDuplicates(["record_id", "fairness_category"])))
    return sheet.select("evaluation_type", "dataset_name", "record_id", "fairness_category",
                        F.md5("prompt_a").alias("prompt_a_md5"), F.md5("prompt_b").alias("prompt_b_md5"),
                        "notes")


@query("sequential_case_ids", """
SELECT record_id, split || '_' || lpad(CAST(row_number() OVER (PARTITION BY split ORDER BY question_group_id, record_id) AS VARCHAR), 5, '0') AS id
FROM splits""")
def _(spark, sf_dir):
    return sp.sequential_case_ids(_small(spark, sf_dir), ["question_group_id", "record_id"]).select(
        "record_id", "id")


@query("incremental_todo", """
SELECT record_id FROM answers WHERE record_id NOT IN (SELECT record_id FROM paired)""")
def _(spark, sf_dir):
    s = _small(spark, sf_dir)
    # the history lies in buckets of its key: only the new rows are shuffled
    done = writers.write_bucketed(sp.balanced_pairs_per_group(s).select("record_id"), "record_id", buckets=8)
    return sp.incremental_todo(s, done).select("record_id")
