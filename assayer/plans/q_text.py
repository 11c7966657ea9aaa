"""Text functions as whole-table jobs."""

from pyspark.sql import functions as F

from assayer import terms
from assayer.functions import text as tx
from assayer.plans import views as v
from assayer.plans.registry import query


def _frequency(df, tokens):
    return (df.select("is_hallucinated", F.explode(tokens).alias("token"))
            .groupBy("token", "is_hallucinated").agg(F.count("*").alias("documents")))


def _frequency_sql(tokens):
    return (f"SELECT token, is_hallucinated, count(*) AS documents FROM (SELECT is_hallucinated, "
            f"unnest({tokens}) AS token FROM answers) GROUP BY ALL")


@query("tokens_alpha", _frequency_sql(v.sql_alpha("answer")))
def _(spark, sf_dir):
    return _frequency(v.answers(spark, sf_dir), tx.tokens_alpha("answer", v.STOP))


@query("tokens_claim", _frequency_sql(v.sql_claim_tokens("answer")))
def _(spark, sf_dir):
    return _frequency(v.answers(spark, sf_dir), v.LISTS.tokens("answer"))


@query("numbers_set", _frequency_sql(v.sql_numbers("answer")))
def _(spark, sf_dir):
    return _frequency(v.answers(spark, sf_dir), tx.numbers_set("answer"))


def _pieces(df, column, pieces):
    return (df.select(column, F.explode(pieces).alias("p")).groupBy(column).agg(
        F.count("*").alias("pieces"), F.avg(F.length("p")).alias("mean_chars"),
        F.max(F.length("p")).cast("bigint").alias("max_chars")))


def _pieces_sql(table, column, pieces):
    return (f"SELECT {column}, count(*) AS pieces, avg(length(p)) AS mean_chars, max(length(p)) AS max_chars "
            f"FROM (SELECT {column}, unnest({pieces}) AS p FROM {table}) GROUP BY ALL")


@query("split_claims", _pieces_sql("answers", "dataset_name", v.sql_pieces("answer", 12)),
       doubles="mean_chars")
def _(spark, sf_dir):
    return _pieces(v.answers(spark, sf_dir), "dataset_name", tx.split_claims("answer"))


NUMBERED = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(
    s, '(\d+\.\s)', chr(1) || '\1', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)),
    lambda p: regexp_replace(regexp_replace(p, '^\s*[-*•\d.)]+\s*', ''), '^\s+|\s+$', '', 'g')),
    lambda p: p <> '' AND len(regexp_split_to_array(p, '\s+')) >= 3)"""


@query("split_claims_numbered", _pieces_sql(
    f"(SELECT lang, CASE WHEN len({NUMBERED}) > 0 THEN {NUMBERED} WHEN s = '' THEN [] ELSE [s] END AS x "
    f"FROM (SELECT lang, {v.sql_strip('text')} AS s FROM documents))", "lang", "x"),
    doubles="mean_chars")
def _(spark, sf_dir):
    return _pieces(v.documents(spark, sf_dir), "lang", tx.split_claims_numbered("text"))


@query("split_sentences", _pieces_sql(
    f"(SELECT lang, CASE WHEN len({v.sql_pieces('text', 20)}) > 0 THEN {v.sql_pieces('text', 20)} "
    f"WHEN {v.sql_strip('text')} = '' THEN [] ELSE [{v.sql_strip('text')}] END AS x FROM documents)",
    "lang", "x"), doubles="mean_chars")
def _(spark, sf_dir):
    return _pieces(v.documents(spark, sf_dir), "lang", tx.split_sentences("text"))


TERM_LISTS = {"short": ["tion", "ment", "der"], "phrase": ["in the", "de la", "of the"],
              "rare": ["zzz", "que la que"]}


@query("contains_any_term", " UNION ALL ".join(
    f"SELECT lang, '{name}' AS term_list, count(*) FILTER (WHERE " + " OR ".join(
        f"contains(lower(text), '{t}')" for t in words) + ") AS hits FROM documents GROUP BY lang"
    for name, words in TERM_LISTS.items()))
def _(spark, sf_dir):
    d = v.documents(spark, sf_dir)
    hits = F.array(*[F.struct(F.lit(n).alias("term_list"), tx.contains_any_term("text", w).alias("hit"))
                     for n, w in TERM_LISTS.items()])
    return (d.select("lang", F.explode(hits).alias("h")).groupBy("lang", "h.term_list")
            .agg(F.count_if("h.hit").alias("hits")))


@query("stance_parse", """
SELECT lang, stance, count(*) AS rows FROM (SELECT lang, CASE doc_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no'
    WHEN 2 THEN 'maybe' WHEN 3 THEN 'maybe' ELSE CASE WHEN doc_id % 11 = 4 THEN 'maybe' ELSE 'uncertain' END END AS stance
  FROM stances) GROUP BY ALL""")
def _(spark, sf_dir):
    return (v.stances(spark, sf_dir).groupBy("lang", tx.stance_parse("candidate_answer").alias("stance"))
            .agg(F.count("*").alias("rows")))


@query("support_normalise", """
SELECT level AS raw_level, support_level, count(*) AS rows FROM (
  SELECT coalesce(json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.support_level'), 'unknown') AS level,
         support_level FROM judged) GROUP BY ALL""")
def _(spark, sf_dir):
    return (v.judge_raw(spark, sf_dir)
            .select(tx.json_extract_judgment("raw_output")["support_level"].alias("raw_level"))
            .groupBy("raw_level", tx.support_normalise("raw_level").alias("support_level"))
            .agg(F.count("*").alias("rows")))


@query("support_to_safety", """
SELECT support_level, CASE support_level WHEN 'supported' THEN 0 WHEN 'partial' THEN 1
       WHEN 'unsupported' THEN 1 END AS safety_label, count(*) AS rows FROM judged GROUP BY ALL""")
def _(spark, sf_dir):
    level = tx.support_normalise(tx.json_extract_judgment("raw_output")["support_level"])
    leveled = v.judge_raw(spark, sf_dir).select(level.alias("support_level"))
    return leveled.groupBy("support_level", tx.support_to_safety("support_level").alias(
        "safety_label")).agg(F.count("*").alias("rows"))


@query("json_extract_judgment", """
SELECT record_id, coalesce(json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.support_level'), 'unknown') AS support_level,
       md5(judge_reason) AS reason_md5 FROM judged""")
def _(spark, sf_dir):
    j = v.judge_raw(spark, sf_dir).withColumn("j", tx.json_extract_judgment("raw_output"))
    return j.select("record_id", "j.support_level", F.md5("j.reason").alias("reason_md5"))


LABEL_TEXTS = ["0 because", " 1.", "It is Supported.", "HALLUCINATED", "not hallucinated, supported", ""]


def _label_text():
    return F.concat(F.element_at(F.array(*[F.lit(t) for t in LABEL_TEXTS]),
                                 (F.col("doc_id") % 6 + 1).cast("int")), "text")


@query("label_extract_binary", f"""
SELECT lang, label, count(*) AS rows FROM (SELECT lang, CASE WHEN starts_with(c, '0') THEN 0 WHEN starts_with(c, '1') THEN 1
    WHEN contains(c, 'supported') AND NOT contains(c, 'hallucinated') THEN 0
    WHEN contains(c, 'hallucinated') THEN 1 ELSE -1 END AS label
  FROM (SELECT lang, lower({v.sql_strip(v.sql_list(LABEL_TEXTS) + "[doc_id % 6 + 1] || text")}) AS c FROM documents))
GROUP BY ALL""")
def _(spark, sf_dir):
    return (v.documents(spark, sf_dir).groupBy(
        "lang", tx.label_extract_binary(_label_text()).alias("label")).agg(F.count("*").alias("rows")))


DECISION_TEXTS = ["Decision: yes. ", "  maybe, ", "I think decision :  NO ", "no - ", "yesterday ", ""]


@query("decision_extract", f"""
SELECT lang, decision, count(*) AS rows FROM (SELECT lang, coalesce(
    nullif(regexp_extract(c, 'decision\\s*:\\s*(yes|no|maybe)\\b', 1), ''),
    nullif(regexp_extract(c, '^\\s*(yes|no|maybe)\\b', 1), ''), 'unparsed') AS decision
  FROM (SELECT lang, lower({v.sql_list(DECISION_TEXTS)}[doc_id % 6 + 1] || text) AS c FROM documents)) GROUP BY ALL""")
def _(spark, sf_dir):
    text = F.concat(F.element_at(F.array(*[F.lit(t) for t in DECISION_TEXTS]),
                                 (F.col("doc_id") % 6 + 1).cast("int")), "text")
    return (v.documents(spark, sf_dir).groupBy("lang", tx.decision_extract(text).alias("decision"))
            .agg(F.count("*").alias("rows")))


@query("base_id", """
SELECT replace(replace(record_id, '_ground_truth', ''), '_hallucinated', '') AS pair_id, count(*) AS variants
FROM grounded_pairs GROUP BY ALL""")
def _(spark, sf_dir):
    return v.grounded_pairs(spark, sf_dir).groupBy(
        tx.base_id("record_id", ("_ground_truth", "_hallucinated")).alias("pair_id")).agg(
        F.count("*").alias("variants"))


@query("length_ratio", f"""
SELECT evaluation_type, count(*) AS rows, avg(least(a1, b1) / greatest(a1, b1)) AS mean_ratio,
       count(*) FILTER (WHERE least(a1, b1) / greatest(a1, b1) < 0.70) AS different_rows,
       avg(CASE WHEN a > 0 AND b > 0 THEN greatest(a, b) / least(a, b) END) AS mean_inverse_ratio
FROM (SELECT evaluation_type, a, b, greatest(a, 1)::DOUBLE AS a1, greatest(b, 1)::DOUBLE AS b1
  FROM (SELECT evaluation_type, {v.sql_words("model_response_a")} AS a, {v.sql_words("model_response_b")} AS b
        FROM responses)) GROUP BY ALL""", doubles="mean_ratio mean_inverse_ratio")
def _(spark, sf_dir):
    r = v.responses(spark, sf_dir).select(
        "evaluation_type", tx.length_ratio("model_response_a", "model_response_b").alias("r"),
        tx.length_ratio_inverse("model_response_a", "model_response_b").alias("i"))
    return r.groupBy("evaluation_type").agg(
        F.count("*").alias("rows"), F.avg("r").alias("mean_ratio"),
        F.count_if(F.col("r") < 0.70).alias("different_rows"), F.avg("i").alias("mean_inverse_ratio"))
