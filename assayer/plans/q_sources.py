"""Sources and sinks: tables are written in a file shape and read back."""

import pandas as pd
from pyspark.sql import functions as F

from assayer.functions import text as tx
from assayer.operators import splits as sp, trust as tr
from assayer.operators.normalize import label_map
from assayer.plans import views as v
from assayer.plans.registry import query
from assayer.session import scratch_path
from assayer.sources import readers, schemas, writers

QA_COLUMNS = [f.name for f in schemas.QA_COMMON.fields]


def _qa_common(spark, sf_dir):
    return v.answers(spark, sf_dir, evidence=True).withColumn("source_file", F.lit("documents")).select(*QA_COLUMNS)


def _digest(df):
    return df.groupBy("dataset_name", "is_hallucinated").agg(
        F.count("*").alias("rows"), F.sum(F.length("answer")).alias("answer_chars"),
        F.sum(F.length("knowledge")).alias("knowledge_chars"), F.max("record_id").alias("max_id"),
        F.min(F.md5("answer")).alias("min_answer_md5"))


DIGEST_SQL = """
SELECT dataset_name, is_hallucinated, count(*) AS rows, CAST(sum(length(answer)) AS BIGINT) AS answer_chars,
       CAST(sum(length(knowledge)) AS BIGINT) AS knowledge_chars, max(record_id) AS max_id,
       min(md5(answer)) AS min_answer_md5
FROM answers GROUP BY ALL"""


@query("read_jsonl", DIGEST_SQL)
def _(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    writers.write_table(_qa_common(spark, sf_dir), path, "jsonl")
    return _digest(readers.read_jsonl(spark, path, schemas.QA_COMMON))


@query("read_csv_typed", DIGEST_SQL)
def _(spark, sf_dir):
    path = scratch_path(spark, "csv")
    writers.write_table(_qa_common(spark, sf_dir), path, "csv")
    return _digest(readers.read_csv_typed(spark, path, schemas.QA_COMMON))


@query("read_headerless_pairs", f"""
SELECT prompt_type, has_pair, count(*) AS rows, CAST(sum(length(prompt_a)) AS BIGINT) AS chars_a,
       CAST(sum(length(prompt_b)) AS BIGINT) AS chars_b
FROM (SELECT a AS prompt_a, b AS prompt_b, CASE WHEN b <> '' THEN 'paired_prompt' ELSE 'single_prompt' END AS prompt_type,
             CAST(b <> '' AS INTEGER) AS has_pair
      FROM (SELECT {v.sql_clean("question")} AS a,
                   CASE WHEN turn % 3 = 0 THEN '' ELSE {v.sql_clean("answer")} END AS b FROM qa_pairs))
WHERE prompt_a <> '' GROUP BY ALL""")
def _(spark, sf_dir):
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    line = (F.when(F.col("turn") % 3 == 0, quoted("question"))
            .when(F.col("turn") % 3 == 1, F.concat_ws(",", F.lit(""), quoted("question"), quoted("answer")))
            .otherwise(F.concat_ws(",", quoted("question"), F.lit(" "), quoted("answer"))))
    path = scratch_path(spark, "pairs") + ".csv"
    v.pairs(spark, sf_dir).select(line.alias("value")).write.text(path)
    pairs = readers.read_headerless_pairs(spark, path)
    return pairs.groupBy("prompt_type", "has_pair").agg(
        F.count("*").alias("rows"), F.sum(F.length("prompt_a")).alias("chars_a"),
        F.sum(F.length("prompt_b")).alias("chars_b"))


def _documents(entries, brackets):
    """One document per task: the opening bracket, entries with commas between them, the closing bracket."""
    def document(batches):
        before = brackets[0]
        for batch in batches:
            for value in batch["value"]:
                yield pd.DataFrame({"value": [before + value]})
                before = ", "
        yield pd.DataFrame({"value": [brackets[1] if before == ", " else brackets]})

    return entries.mapInPandas(document, "value string")


@query("read_object_map_json", """
SELECT record_id, md5(question) AS question_md5, 2 AS contexts, length(answer) AS context_chars,
       CASE is_hallucinated WHEN 1 THEN 'no' ELSE 'yes' END AS decision FROM answers""")
def _(spark, sf_dir):
    half = F.floor(F.length("answer") / 2).cast("int")
    item = F.struct(F.col("question").alias("QUESTION"), F.array(
        F.substr("answer", F.lit(1), half), F.substr("answer", half + 1)).alias("CONTEXTS"),
        F.when(F.col("is_hallucinated") == 1, "no").otherwise("yes").alias("final_decision"))
    entries = v.answers(spark, sf_dir).select(F.regexp_replace(
        F.to_json(F.create_map("record_id", item)), r"^\{|\}$", "").alias("value"))

    path = scratch_path(spark, "objects")
    _documents(entries, "{}").write.text(path)
    return readers.read_object_map_json(spark, path).select(
        "record_id", F.md5("QUESTION").alias("question_md5"), F.size("CONTEXTS").alias("contexts"),
        F.aggregate("CONTEXTS", F.lit(0), lambda a, c: a + F.length(c)).cast("bigint").alias("context_chars"),
        F.col("final_decision").alias("decision"))


@query("read_any_format", """
SELECT f.format, lang, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars
FROM documents, (SELECT unnest(['csv', 'json', 'jsonl', 'parquet']) AS format) f GROUP BY ALL""")
def _(spark, sf_dir):
    d = v.documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = None
    for fmt in ("csv", "json", "jsonl", "parquet"):
        path = scratch_path(spark, "any") + f".{fmt}"
        if fmt == "json":  # documents that hold a list of rows each
            _documents(d.select(F.to_json(F.struct("*")).alias("value")), "[]").write.text(path)
        else:
            writers.write_table(d, path, fmt)
        part = readers.read_any_format(spark, path, d.schema).groupBy("lang").agg(
            F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).withColumn(
            "format", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out


@query("normalise_nested_text", """
SELECT doc_id, unnest(['list', 'object', 'values', 'missing']) AS shape, unnest([
    md5(lang || chr(10) || source || chr(10) || text),
    md5('{"lang": ' || CAST(to_json(lang) AS VARCHAR) || ', "text": ' || CAST(to_json(text) AS VARCHAR) || '}'),
    md5(lang || ' ' || text), md5('')]) AS text_md5
FROM documents""")
def _(spark, sf_dir):
    d = v.documents(spark, sf_dir)
    nested = F.create_map(F.lit("lang"), F.col("lang"), F.lit("text"), F.col("text"))
    shapes = {"list": tx.normalise_nested_list(F.array("lang", "source", "text")),
              "object": tx.normalise_nested_map(nested), "values": tx.normalise_nested_map(nested, as_json=False),
              "missing": tx.normalise_nested_list(F.lit(None).cast("array<string>"))}
    rows = F.array(*[F.struct(F.lit(k).alias("shape"), F.md5(c).alias("text_md5")) for k, c in shapes.items()])
    return d.select("doc_id", F.inline(rows))


@query("optional_source", """
SELECT 'present' AS source, count(*) AS rows, avg(final_grounding_score) AS mean_grounding FROM grounding
UNION ALL
SELECT 'absent', count(*), avg(answer_claim_grounding_score) FROM claim_rollup""",
       doubles="mean_grounding")
def _(spark, sf_dir):
    merged = v.grounding(spark, sf_dir).select("record_id", "final_grounding_score")
    lexical = v.lexical_rollup(spark, sf_dir).select(
        "record_id", F.col("answer_claim_grounding_score").alias("final_grounding_score"))
    path = scratch_path(spark, "grounding") + ".parquet"
    merged.write.parquet(path)
    present = readers.optional_source(spark, path, merged.schema, lexical)
    absent = readers.optional_source(spark, path + ".missing.parquet", merged.schema, lexical)
    digest = lambda df, name: df.agg(F.count("*").alias("rows"), F.avg("final_grounding_score").alias(
        "mean_grounding")).withColumn("source", F.lit(name))
    return digest(present, "present").unionByName(digest(absent, "absent"))


@query("write_table", """
SELECT split, count(*) AS rows, count(DISTINCT question_group_id) AS question_groups,
       max(record_id) AS max_id FROM splits GROUP BY split""")
def _(spark, sf_dir):
    path = scratch_path(spark, "splits")
    s = v.splits(spark, sf_dir).select("record_id", "question_group_id", "is_hallucinated", "split")
    writers.write_table(s, path, "parquet", ["split"])
    back = spark.read.schema(s.schema).parquet(path)
    return back.groupBy("split").agg(
        F.count("*").alias("rows"), F.count_distinct("question_group_id").alias("question_groups"),
        F.max("record_id").alias("max_id"))


@query("split_manifest", """
SELECT split, 'labels' AS section, CASE is_hallucinated WHEN 1 THEN 'hallucinated' ELSE 'supported' END AS item,
       count(*) AS value FROM splits GROUP BY ALL
UNION ALL SELECT split, 'dataset_rows', dataset_name, count(*) FROM splits GROUP BY ALL
UNION ALL SELECT split, 'original_source_splits', source_split, count(*) FROM splits GROUP BY ALL
UNION ALL SELECT split, 'totals', 'rows', count(*) FROM splits GROUP BY ALL
UNION ALL SELECT split, 'totals', 'question_groups', count(DISTINCT question_group_id) FROM splits GROUP BY ALL
UNION ALL SELECT DISTINCT split, 'totals', 'seed', CAST(42 AS BIGINT) FROM splits""")
def _(spark, sf_dir):
    return sp.split_manifest(v.splits(spark, sf_dir).withColumn("label", label_map("is_hallucinated")))


@query("append_case_log", """
SELECT disposition_label, routing_action, 2 * count(*) AS rows FROM disposed GROUP BY ALL""")
def _(spark, sf_dir):
    evaluated = tr.evaluate_cases(v.cases(spark, sf_dir)).withColumn(
        "case_id", F.concat_ws("-", "case_group", "l_linenumber"))
    path = scratch_path(spark, "case-log")
    for _ in range(2):
        writers.append_case_log(evaluated, path)
    return spark.read.schema(schemas.CASE_LOG).parquet(path).groupBy(
        "disposition_label", "routing_action").agg(F.count("*").alias("rows"))
