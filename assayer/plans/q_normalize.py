"""Normalisation, projection and predicate queries."""

from pyspark.sql import functions as F

from assayer import terms
from assayer.functions import text as tx
from assayer.operators import checked as ck, normalize as nz, splits as sp
from assayer.plans import views as v
from assayer.plans.registry import SQL_VIEWS, query
from assayer.session import scratch_path


def _sql_fill(template: str, **slots: str) -> str:
    out = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, expr in slots.items():
        out = out.replace("{" + name + "}", f"' || {expr} || '")
    return out


SQL_VIEWS["prompts"] = f"""
SELECT *, {_sql_fill(terms.SAFETY_PROMPT, question="question", knowledge="knowledge", answer="answer")} AS prompt
FROM answers"""
SQL_VIEWS["evidence_prompts"] = f"""
SELECT doc_id, record_id, question, knowledge,
       CASE WHEN doc_id % 9 = 0 THEN question || knowledge
            ELSE {_sql_fill(terms.EVIDENCE_PROMPT, question="question", knowledge="knowledge")} END AS prompt
FROM answers"""


@query("binary_pair_expand", """
SELECT dataset_name || '_' || record_id || '_ground_truth' AS record_id, dataset_name AS source_dataset,
       md5(question) AS answer_md5, 0 AS is_hallucinated, 'No Hallucination' AS hallucination_category FROM answers
UNION ALL
SELECT dataset_name || '_' || record_id || '_hallucinated', dataset_name, md5(answer), 1,
       hallucination_category FROM answers""")
def _(spark, sf_dir):
    raw = v.answers(spark, sf_dir).select(
        F.col("dataset_name").alias("source_dataset"), F.col("doc_id").alias("row_id"),
        F.col("question").alias("ground_truth"), F.col("answer").alias("hallucinated_answer"),
        F.col("hallucination_category").alias("category"))
    return nz.binary_pair_expand(raw).select(
        "record_id", "source_dataset", F.md5("answer").alias("answer_md5"), "is_hallucinated",
        "hallucination_category")


@query("mcq_pair_convert", """
WITH q AS (SELECT conv_id || '_' || turn AS row_id, question, answer FROM qa_pairs)
SELECT row_id || '_correct' AS record_id, md5(answer) AS answer_md5, 0 AS is_hallucinated,
       'correct_answer' AS case_type FROM q
UNION ALL SELECT row_id || '_student', md5(question), 1, 'student_answer' FROM q
UNION ALL SELECT item_id || '_fake_option', md5(text), 1, 'fake_option' FROM benchmark
UNION ALL SELECT item_id || '_refusal', md5('I do not know'), 0, 'safe_refusal' FROM benchmark""")
def _(spark, sf_dir):
    items = v.pairs(spark, sf_dir).select(
        F.concat_ws("_", "conv_id", "turn").alias("row_id"), F.col("answer").alias("correct_answer"),
        F.col("question").alias("student_answer"))
    fakes = v.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("row_id"), F.col("text").alias("option"))
    columns = ["record_id", F.md5("answer").alias("answer_md5"), "is_hallucinated", "case_type"]
    return nz.mcq_pair_convert(items).select(*columns).unionByName(
        nz.fake_item_convert(fakes).select(*columns))


@query("label_map", """
SELECT CASE is_hallucinated WHEN 0 THEN 'supported' WHEN 1 THEN 'hallucinated' END AS label,
       count(*) AS rows, CAST(sum(is_hallucinated) AS BIGINT) AS positives FROM answers GROUP BY ALL""")
def _(spark, sf_dir):
    mapped = v.answers(spark, sf_dir).select(nz.label_map("is_hallucinated").alias("label"))
    return mapped.groupBy("label").agg(F.count("*").alias("rows"),
                                       F.sum(nz.label_unmap("label")).alias("positives"))


@query("prompt_inventory", f"""
SELECT role AS dataset_name, CASE WHEN {v.sql_clean("second")} <> '' THEN 'paired_prompt' ELSE 'single_prompt' END AS prompt_type,
       count(*) AS rows
FROM (SELECT role, text, CASE WHEN turn % 2 = 0 THEN text ELSE ' ' END AS second FROM conversations)
WHERE {v.sql_clean("text")} <> '' GROUP BY ALL""")
def _(spark, sf_dir):
    raw = v.table(spark, sf_dir, "conversations").select(
        F.col("role").alias("dataset_name"), F.col("text").alias("c0"), F.lit(" ").alias("c1"),
        F.when(F.col("turn") % 2 == 0, F.col("text")).alias("c2"))
    return nz.prompt_inventory(nz.headerless_pairs(raw, ["c0", "c1", "c2"]))


@query("question_group_key", f"""
SELECT group_key, plain_key, count(*) AS rows FROM (
  SELECT substr(sha256(lang || '::' || q), 1, 20) AS group_key, 'group_' || substr(sha256(q), 1, 16) AS plain_key
  FROM (SELECT lang, lower({v.sql_clean("text")}) AS q FROM documents)) GROUP BY ALL""")
def _(spark, sf_dir):
    return v.documents(spark, sf_dir).groupBy(
        tx.question_group_key("text", "lang").alias("group_key"),
        tx.question_group_key("text", prefix="group_", digits=16).alias("plain_key")).agg(
        F.count("*").alias("rows"))


@query("whitespace_clean", f"""
SELECT doc_id, md5({v.sql_clean("text")}) AS clean_md5, length({v.sql_clean("text")}) AS clean_chars FROM documents""")
def _(spark, sf_dir):
    return v.documents(spark, sf_dir).select(
        "doc_id", F.md5(tx.whitespace_clean("text")).alias("clean_md5"),
        F.length(tx.whitespace_clean("text")).cast("bigint").alias("clean_chars"))


@query("prompt_assemble", f"""
SELECT record_id, md5(prompt) AS prompt_md5,
       md5({_sql_fill(terms.FEATURE_TEXT, question="question", knowledge="knowledge", answer="answer")}) AS feature_md5
FROM prompts""")
def _(spark, sf_dir):
    slots = {s: F.col(s) for s in ("question", "knowledge", "answer")}
    return v.answers(spark, sf_dir, evidence=True).select(
        "record_id", F.md5(nz.safety_prompt()).alias("prompt_md5"),
        F.md5(tx.fill_template(terms.FEATURE_TEXT, **slots)).alias("feature_md5"))


@query("prompt_parse", f"""
SELECT record_id, doc_id % 9 <> 0 AS matched,
       CASE WHEN doc_id % 9 <> 0 THEN md5({v.sql_strip("question")}) ELSE md5('') END AS question_md5,
       CASE WHEN doc_id % 9 <> 0 THEN md5({v.sql_strip("knowledge")}) ELSE md5('') END AS evidence_md5
FROM answers""")
def _(spark, sf_dir):
    prompts = v.answers(spark, sf_dir, evidence=True).withColumn("prompt", F.when(
        F.col("doc_id") % 9 == 0, F.concat("question", "knowledge")).otherwise(nz.evidence_prompt()))
    return prompts.withColumn("p", tx.prompt_parse("prompt")).select(
        "record_id", "p.matched", F.md5("p.question").alias("question_md5"),
        F.md5("p.evidence").alias("evidence_md5"))


def _sql_first(text: str, old: str, new: str) -> str:
    return (f"CASE WHEN position({old} IN {text}) > 0 THEN substr({text}, 1, position({old} IN {text}) - 1) "
            f"|| {new} || substr({text}, position({old} IN {text}) + length({old})) END")


@query("template_substitute", f"""
SELECT record_id, md5({_sql_first("s2", "ta", "answer")}) AS prompt_md5,
       {_sql_first("s2", "ta", "answer")} IS NOT NULL AS template_ok
FROM (SELECT *, {_sql_first("s1", "tk", "knowledge")} AS s2
  FROM (SELECT *, {_sql_first("tp", "tq", "question")} AS s1
    FROM answers, (SELECT question AS tq, knowledge AS tk, answer AS ta, prompt AS tp
                   FROM prompts WHERE doc_id = (SELECT min(doc_id) FROM prompts))))""")
def _(spark, sf_dir):
    a = v.answers(spark, sf_dir, evidence=True)
    example = a.withColumn("prompt", nz.safety_prompt()).agg(F.min_by(
        F.struct("prompt", "question", "knowledge", "answer"), "doc_id").alias("t")).select("t.*")
    return nz.template_substitute(a, example).select(
        "record_id", F.md5("prompt").alias("prompt_md5"), "template_ok")


def _stance_pairs(spark, sf_dir):
    d = v.documents(spark, sf_dir).select(
        F.col("doc_id").alias("sample_id"),
        F.when(F.col("doc_id") % 3 == 0, " Yes").otherwise("no").alias("ground_truth_label"))
    return nz.counterfactual_pairs(d)


SQL_VIEWS["stance_pairs"] = f"""
SELECT sample_id, truth, expected_label, case_type,
       CASE WHEN expected_label = 'supported' THEN truth WHEN truth = 'yes' THEN 'no' ELSE 'yes' END AS candidate_conclusion,
       CASE WHEN (expected_label = 'supported') = (truth = 'yes') THEN '{terms.STANCE_CANDIDATES["yes"]}'
            ELSE '{terms.STANCE_CANDIDATES["no"]}' END AS candidate_answer
FROM (SELECT doc_id AS sample_id, CASE WHEN doc_id % 3 = 0 THEN 'yes' ELSE 'no' END AS truth FROM documents),
     (SELECT unnest(['supported', 'hallucinated']) AS expected_label,
             unnest(['aligned_candidate', 'contradictory_candidate']) AS case_type)"""


@query("counterfactual_pairs", """
SELECT sample_id, candidate_conclusion, expected_label, case_type, md5(candidate_answer) AS answer_md5
FROM stance_pairs""")
def _(spark, sf_dir):
    return _stance_pairs(spark, sf_dir).select(
        "sample_id", "candidate_conclusion", "expected_label", "case_type",
        F.md5("candidate_answer").alias("answer_md5"))


@query("candidate_quality_flags", """
SELECT lang, candidate_conclusion, count(*) AS rows,
       count(*) FILTER (WHERE NOT starts_with(candidate_answer, prefix)) AS prefix_failures,
       count(*) FILTER (WHERE right(rtrim(candidate_answer, ' ' || chr(10) || chr(9) || chr(13)), 1) NOT IN ('.', '!', '?')) AS incomplete_endings
FROM (SELECT lang, candidate_answer, CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END AS candidate_conclusion,
             CASE WHEN doc_id % 2 = 0 THEN 'Yes.' ELSE 'No.' END AS prefix FROM stances) GROUP BY ALL""")
def _(spark, sf_dir):
    s = v.stances(spark, sf_dir).withColumn("candidate_conclusion", F.when(
        F.col("doc_id") % 2 == 0, "yes").otherwise("no"))
    return nz.quality_summary(nz.candidate_quality_flags(s), ["lang", "candidate_conclusion"])


def _overlay_cases(spark, sf_dir):
    cases = _stance_pairs(spark, sf_dir).withColumn("case_id", F.col("sample_id") * 2 + F.when(
        F.col("expected_label") == "hallucinated", 1).otherwise(0))
    repairs = v.table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") * 6 + 1).alias("case_id"), F.col("text").alias("candidate_answer"))
    return cases, repairs


SQL_VIEWS["overlay_cases"] = """
SELECT sample_id * 2 + CAST(expected_label = 'hallucinated' AS BIGINT) AS case_id, expected_label, candidate_answer FROM stance_pairs"""


@query("repair_violations", """
SELECT r.case_id, count(c.case_id) AS matched_rows, count(*) FILTER (WHERE c.expected_label <> 'hallucinated') AS wrong_label_rows
FROM (SELECT item_id * 6 + 1 AS case_id FROM benchmark UNION ALL SELECT item_id * 6 FROM benchmark WHERE item_id % 5 = 0
      UNION ALL SELECT -1 - item_id FROM benchmark WHERE item_id % 7 = 0) r LEFT JOIN overlay_cases c USING (case_id)
GROUP BY r.case_id HAVING count(c.case_id) <> 1 OR count(*) FILTER (WHERE c.expected_label <> 'hallucinated') > 0""")
def _(spark, sf_dir):
    """All overrides, and some more for cases of the wrong label and for cases that do not exist."""
    cases, repairs = _overlay_cases(spark, sf_dir)
    items = v.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("candidate_answer"))
    wrong = items.filter("item_id % 5 = 0").select((F.col("item_id") * 6).alias("case_id"), "candidate_answer")
    absent = items.filter("item_id % 7 = 0").select((-1 - F.col("item_id")).alias("case_id"), "candidate_answer")
    return nz.repair_violations(cases, repairs.unionByName(wrong).unionByName(absent))


@query("write_repaired", """
SELECT semantic_audit_status, count(*) AS rows, CAST(sum(length(answer)) AS BIGINT) AS answer_chars
FROM (SELECT CASE WHEN b.text IS NOT NULL THEN 'human_audited_counterfactual_repair'
                  ELSE 'generated_not_manually_repaired' END AS semantic_audit_status, coalesce(b.text, c.candidate_answer) AS answer
      FROM overlay_cases c LEFT JOIN (SELECT DISTINCT ON (case_id) case_id, text FROM (
        SELECT item_id * 6 + 1 AS case_id, text FROM benchmark)) b USING (case_id)) GROUP BY ALL""")
def _(spark, sf_dir):
    """The overlay written with its checks, by the overrides that have a case."""
    cases, repairs = _overlay_cases(spark, sf_dir)
    path = scratch_path(spark, "repaired")
    ck.write_repaired(cases, repairs.join(cases.select("case_id"), "case_id", "left_semi"), path)
    return spark.read.parquet(path).groupBy("semantic_audit_status").agg(
        F.count("*").alias("rows"), F.sum(F.length("candidate_answer")).alias("answer_chars"))


@query("repair_overlay", """
SELECT expected_label, semantic_audit_status, count(*) AS rows, CAST(sum(length(answer)) AS BIGINT) AS answer_chars
FROM (SELECT p.expected_label, CASE WHEN b.item_id IS NOT NULL THEN 'human_audited_counterfactual_repair'
             ELSE 'generated_not_manually_repaired' END AS semantic_audit_status,
             coalesce(b.text, p.candidate_answer) AS answer
      FROM stance_pairs p LEFT JOIN benchmark b
        ON p.expected_label = 'hallucinated' AND p.sample_id = b.item_id * 3) GROUP BY ALL""")
def _(spark, sf_dir):
    return nz.repair_overlay(*_overlay_cases(spark, sf_dir)).groupBy("expected_label", "semantic_audit_status").agg(
        F.count("*").alias("rows"), F.sum(F.length("candidate_answer")).alias("answer_chars"))


@query("truncate_text", f"""
SELECT doc_id, md5(CASE WHEN length(s) > 350 THEN substr(s, 1, 350) || '...' ELSE s END) AS ellipsis_md5,
       md5(CASE WHEN length(s) > 600 THEN regexp_replace(substr(s, 1, 600), ' [^ ]*$', '') || ' [truncated for model context]' ELSE s END) AS clipped_md5,
       md5(CASE WHEN length(f) > 350 THEN substr(f, 1, 350) || '...' ELSE f END) AS flat_md5
FROM (SELECT doc_id, {v.sql_strip("text")} AS s, {v.sql_strip("replace(text, chr(10), ' ')")} AS f FROM documents)""")
def _(spark, sf_dir):
    return v.documents(spark, sf_dir).select(
        "doc_id", F.md5(tx.truncate_ellipsis("text", 350)).alias("ellipsis_md5"),
        F.md5(tx.truncate_at_space("text", 600)).alias("clipped_md5"),
        F.md5(tx.truncate_flat("text", 350)).alias("flat_md5"))


@query("token_budget_audit", f"""
SELECT dataset_name, count(*) AS rows, count(*) FILTER (WHERE n > 400) AS truncated_rows,
       count(*) FILTER (WHERE NOT candidate) AS candidate_missing,
       count(*) FILTER (WHERE NOT judge) AS judge_question_missing,
       count(*) FILTER (WHERE NOT marker) AS label_marker_missing,
       count(*) FILTER (WHERE candidate AND judge AND marker AND header AND reply) AS fully_usable_rows,
       CAST(max(greatest(0, n - 400)) AS INTEGER) AS max_tokens_over_budget
FROM (SELECT dataset_name, n, contains(kept, {v.sql_clean("answer")}) AS candidate,
        contains(kept, 'Is the candidate answer hallucinated?') AS judge, contains(kept, 'Label:') AS marker,
        contains(kept, 'Candidate answer:') AS header, contains(kept, 'Reply with exactly one label:') AS reply
      FROM (SELECT dataset_name, answer, len(t) AS n, array_to_string(t[1:400], ' ') AS kept
            FROM (SELECT dataset_name, answer, string_split({v.sql_clean("prompt")}, ' ') AS t FROM prompts)))
GROUP BY ALL""")
def _(spark, sf_dir):
    prompts = v.answers(spark, sf_dir, evidence=True).withColumn("prompt", nz.safety_prompt())
    return nz.token_budget_summary(nz.token_budget_audit(prompts, budget=400), ["dataset_name"])


@query("minority_oversample", """
SELECT label, copy_number, count(*) AS rows FROM (
  SELECT true_label AS label, unnest(range(1, CASE WHEN true_label = 'maybe' THEN 4 ELSE 2 END)) AS copy_number
  FROM scores3) GROUP BY ALL""")
def _(spark, sf_dir):
    rows = v.scores3(spark, sf_dir).select(F.col("true_label").alias("label"))
    return nz.minority_oversample(rows).groupBy("label", F.col("copy_number").cast("bigint").alias(
        "copy_number")).agg(F.count("*").alias("rows"))


@query("chat_records", """
SELECT record_id, 3 AS messages,
       md5('Research question:' || chr(10) || question || chr(10) || chr(10) || 'PubMed abstract evidence:'
           || chr(10) || substr(knowledge, 1, 3500)) AS user_md5,
       md5('Decision: ' || CASE is_hallucinated WHEN 1 THEN 'no' ELSE 'yes' END || chr(10) || 'Rationale: '
           || substr(answer, 1, 700)) AS assistant_md5
FROM answers""")
def _(spark, sf_dir):
    a = v.answers(spark, sf_dir, evidence=True).withColumn("decision", F.when(
        F.col("is_hallucinated") == 1, "No").otherwise("Yes"))
    return nz.chat_records(a).select(
        "record_id", F.size("messages").alias("messages"),
        F.md5(F.col("messages")[1]["content"]).alias("user_md5"),
        F.md5(F.col("messages")[2]["content"]).alias("assistant_md5"))
