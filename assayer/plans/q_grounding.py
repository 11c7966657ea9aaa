"""Claim / evidence grounding queries."""

from pyspark.sql import functions as F

from assayer.functions import text as tx
from assayer.operators import grounding as gr
from assayer.plans import views as v
from assayer.plans.registry import SQL_VIEWS, query

SQL_VIEWS["overlap_rows"] = f"""
SELECT record_id, is_hallucinated, CASE WHEN len(a) = 0 THEN 0.0
       ELSE CAST(len(list_intersect(a, k)) AS DOUBLE) / len(a) END AS overlap
FROM (SELECT record_id, is_hallucinated, {v.sql_alpha("answer")} AS a, {v.sql_alpha("knowledge")} AS k FROM answers)"""


@query("overlap_score", """
SELECT is_hallucinated, CASE is_hallucinated WHEN 0 THEN 'Not Hallucinated' ELSE 'Hallucinated' END AS label,
       count(*) AS count, avg(overlap) AS mean, median(overlap) AS median, min(overlap) AS min, max(overlap) AS max
FROM overlap_rows GROUP BY ALL""", doubles="mean median")
def _(spark, sf_dir):
    return gr.overlap_summary(v.answers(spark, sf_dir, evidence=True), stopwords=v.STOP)


SQL_VIEWS["pair_tokens"] = f"""
SELECT replace(replace(record_id, '_ground_truth', ''), '_hallucinated', '') AS pair_id, is_hallucinated,
       {v.sql_alpha("answer")} AS t, {v.sql_alpha("knowledge")} AS k FROM grounded_pairs"""
_DIR = v.sql_list(v.DIRECTION)
SQL_VIEWS["pair_scores"] = f"""
SELECT g.pair_id, {v.sql_jaccard("g.t", "h.t")} AS answer_similarity,
       {v.sql_jaccard("g.k", "g.t")} AS knowledge_grounded_similarity,
       {v.sql_jaccard("g.k", "h.t")} AS knowledge_hallucinated_similarity,
       {v.sql_jaccard(f"list_intersect(g.t, {_DIR})", f"list_intersect(h.t, {_DIR})")} AS clinical_direction_similarity
FROM pair_tokens g JOIN pair_tokens h ON g.pair_id = h.pair_id
WHERE g.is_hallucinated = 0 AND h.is_hallucinated = 1"""


def _pair_scores(spark, sf_dir):
    return gr.paired_answer_comparison(v.grounded_pairs(spark, sf_dir), stopwords=v.STOP,
                                       direction=v.DIRECTION)


@query("jaccard_similarity", """
SELECT pair_id, answer_similarity, knowledge_grounded_similarity FROM pair_scores""")
def _(spark, sf_dir):
    return _pair_scores(spark, sf_dir).select(
        "pair_id", "answer_similarity", "knowledge_grounded_similarity")


@query("direction_overlap", """
SELECT clinical_direction_similarity, count(*) AS pairs FROM pair_scores GROUP BY ALL""")
def _(spark, sf_dir):
    return _pair_scores(spark, sf_dir).groupBy("clinical_direction_similarity").agg(
        F.count("*").alias("pairs"))


@query("paired_answer_comparison", """
SELECT count(*) AS paired_examples, avg(answer_similarity) AS mean_answer_similarity,
       median(answer_similarity) AS median_answer_similarity,
       avg(knowledge_grounded_similarity) AS mean_grounded_answer_knowledge_similarity,
       avg(knowledge_hallucinated_similarity) AS mean_hallucinated_answer_knowledge_similarity,
       avg(knowledge_grounded_similarity - knowledge_hallucinated_similarity) AS mean_grounding_similarity_delta,
       avg(clinical_direction_similarity) AS mean_clinical_direction_similarity
FROM pair_scores""", doubles="mean_answer_similarity median_answer_similarity "
    "mean_grounded_answer_knowledge_similarity mean_hallucinated_answer_knowledge_similarity "
    "mean_grounding_similarity_delta mean_clinical_direction_similarity")
def _(spark, sf_dir):
    return gr.paired_summary(_pair_scores(spark, sf_dir))


def _claims(spark, sf_dir, keep=("record_id",)):
    return gr.claim_scores(v.answers(spark, sf_dir, evidence=True), list(keep), v.LISTS)


@query("term_alignment", """
SELECT dataset_name, count(*) AS claims, avg(direction_support) AS mean_direction, avg(negation_support) AS mean_negation,
       avg(uncertainty_support) AS mean_uncertainty, count(*) FILTER (WHERE direction_support < 0.5) AS weak_direction
FROM claim_parts GROUP BY ALL""", doubles="mean_direction mean_negation mean_uncertainty")
def _(spark, sf_dir):
    return _claims(spark, sf_dir, ["record_id", "dataset_name"]).groupBy("dataset_name").agg(
        F.count("*").alias("claims"), F.avg("clinical_direction_support").alias("mean_direction"),
        F.avg("negation_support").alias("mean_negation"),
        F.avg("uncertainty_support").alias("mean_uncertainty"),
        F.count_if(F.col("clinical_direction_support") < 0.5).alias("weak_direction"))


@query("numeric_alignment", """
SELECT record_id, claim_index, numeric_support FROM claim_parts
JOIN (SELECT record_id, claim_index FROM claim_tokens WHERE len(cn) > 0) USING (record_id, claim_index)""")
def _(spark, sf_dir):
    scored = _claims(spark, sf_dir)
    return scored.filter(F.size(tx.numbers_set("claim_text")) > 0).select(
        "record_id", F.col("claim_index").cast("bigint").alias("claim_index"), "numeric_support")


@query("claim_support_score", """
SELECT record_id, claim_index, md5(claim_text) AS claim_md5, token_support AS claim_token_support,
       score AS claim_support_score, support_label AS claim_support_label, high_impact AS high_impact_claim,
       unsupported_high_impact AS unsupported_high_impact_claim, contradiction AS contradiction_risk
FROM claim_scored""", doubles="claim_support_score")
def _(spark, sf_dir):
    return _claims(spark, sf_dir).select(
        "record_id", F.col("claim_index").cast("bigint").alias("claim_index"),
        F.md5("claim_text").alias("claim_md5"), "claim_token_support", "claim_support_score",
        "claim_support_label", "high_impact_claim", "unsupported_high_impact_claim",
        "contradiction_risk")


@query("claim_grounding_rollup", "SELECT * FROM claim_rollup", doubles="answer_claim_grounding_score")
def _(spark, sf_dir):
    return v.lexical_rollup(spark, sf_dir)


@query("claim_grounding_summary", """
SELECT is_hallucinated, support_label AS claim_support_label, count(*) AS claim_count FROM claim_scored GROUP BY ALL
""")
def _(spark, sf_dir):
    return gr.claim_grounding_summary(_claims(spark, sf_dir, ["record_id", "is_hallucinated"]))


@query("claim_grounding_overall", """
SELECT count(*) AS rows_scored, CAST(sum(claim_count) AS BIGINT) AS claims_scored,
       avg(answer_claim_grounding_score) AS mean_answer_claim_grounding_score,
       avg(unsupported_claim_count) AS mean_unsupported_claim_count,
       avg(unsupported_high_impact_claim_count) AS mean_unsupported_high_impact_claim_count,
       count(*) FILTER (WHERE contradiction_risk_count > 0) AS rows_with_contradiction_risk
FROM claim_rollup""", doubles="mean_answer_claim_grounding_score mean_unsupported_claim_count "
    "mean_unsupported_high_impact_claim_count")
def _(spark, sf_dir):
    return gr.claim_grounding_overall(v.lexical_rollup(spark, sf_dir))


# --- TF-IDF best sentence ---------------------------------------------------

TFIDF_STOP = ["the", "and", "in", "de", "la", "que", "der", "die"]


_WHOLE = f"CASE WHEN {v.sql_strip('knowledge')} = '' THEN [] ELSE [{v.sql_strip('knowledge')}] END"
SQL_VIEWS["tf_claims"] = f"""
SELECT record_id, unnest(cl) AS claim_text, generate_subscripts(cl, 1) AS claim_index
FROM (SELECT record_id, {v.sql_pieces("answer", 12)} AS cl FROM answers)"""
SQL_VIEWS["tf_sentences"] = f"""
SELECT record_id, unnest(se) AS sentence, generate_subscripts(se, 1) AS sent_no FROM (
  SELECT record_id, CASE WHEN len(se) > 0 THEN se ELSE whole END AS se FROM (
    SELECT record_id, {v.sql_pieces("knowledge", 20)} AS se, {_WHOLE} AS whole FROM answers))"""


def _sql_gram_rows(key: str, text: str, table: str) -> str:
    """(record, piece, term, tf) rows: words first, then bigrams from their positions."""
    kept = ", ".join(f"'{w}'" for w in TFIDF_STOP)
    return f"""
SELECT record_id, {key}, term, count(*) AS tf FROM (
  SELECT record_id, {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
  FROM (SELECT record_id, {key}, list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
               lambda t: t NOT IN ({kept})) AS w FROM {table})) GROUP BY ALL"""


SQL_VIEWS["tf_claim_grams"] = _sql_gram_rows("claim_index", "claim_text", "tf_claims")
SQL_VIEWS["tf_sentence_grams"] = _sql_gram_rows("sent_no", "sentence", "tf_sentences")
SQL_VIEWS["tf_df"] = "SELECT record_id, term, count(*) AS sdf FROM tf_sentence_grams GROUP BY ALL"
SQL_VIEWS["tf_n"] = "SELECT record_id, count(*) + 1 AS n FROM tf_sentences GROUP BY ALL"
# claim weights: idf with the claim counted in; sentence norms: base plus a correction on shared terms
SQL_VIEWS["tf_claim_weights"] = """
SELECT c.record_id, c.claim_index, c.term, c.tf, ln((1.0 + n.n) / (1.0 + 1 + coalesce(d.sdf, 0))) + 1 AS w,
       ln((1.0 + n.n) / (1.0 + d.sdf)) + 1 AS w0
FROM tf_claim_grams c JOIN tf_n n USING (record_id) LEFT JOIN tf_df d USING (record_id, term)"""
SQL_VIEWS["tf_base"] = """
SELECT s.record_id, s.sent_no, sum((s.tf * (ln((1.0 + n.n) / (1.0 + d.sdf)) + 1)) ** 2) AS base
FROM tf_sentence_grams s JOIN tf_df d USING (record_id, term) JOIN tf_n n USING (record_id) GROUP BY ALL"""
SQL_VIEWS["tf_shared"] = """
SELECT c.record_id, c.claim_index, s.sent_no, sum(c.tf * c.w * s.tf * c.w) AS product,
       sum(s.tf * s.tf * (c.w * c.w - c.w0 * c.w0)) AS correction
FROM tf_claim_weights c JOIN tf_sentence_grams s USING (record_id, term) GROUP BY ALL"""
SQL_VIEWS["tf_own"] = """
SELECT record_id, claim_index, sum((tf * w) ** 2) AS own FROM tf_claim_weights GROUP BY ALL"""
SQL_VIEWS["tf_best"] = """
SELECT c.record_id, c.claim_index, coalesce(max(x.product / (sqrt(o.own) * sqrt(b.base + x.correction))), 0.0) AS semantic
FROM tf_claims c LEFT JOIN tf_shared x USING (record_id, claim_index)
LEFT JOIN tf_own o USING (record_id, claim_index)
LEFT JOIN tf_base b ON b.record_id = x.record_id AND b.sent_no = x.sent_no GROUP BY ALL"""


def _tfidf(spark, sf_dir):
    return gr.claim_best_sentence_tfidf(v.answers(spark, sf_dir, evidence=True), ["record_id"], stopwords=TFIDF_STOP)


@query("claim_best_sentence_tfidf", """
SELECT record_id, claim_index, semantic AS semantic_claim_support_score FROM tf_best""",
       doubles="semantic_claim_support_score")
def _(spark, sf_dir):
    return _tfidf(spark, sf_dir).select(
        "record_id", F.col("claim_index").cast("bigint").alias("claim_index"),
        "semantic_claim_support_score")


SQL_VIEWS["tf_combined"] = """
SELECT *, CASE WHEN round(combined, 9) >= 0.60 THEN 'supported' WHEN round(combined, 9) >= 0.35 THEN 'partial'
               ELSE 'unsupported' END AS combined_label
FROM (SELECT t.record_id, t.claim_index, t.semantic, 0.70::DOUBLE * t.semantic + 0.30::DOUBLE * c.score AS combined
      FROM tf_best t JOIN claim_scored c USING (record_id, claim_index))"""


def _combined(spark, sf_dir):
    return gr.semantic_claim_scores(v.answers(spark, sf_dir, evidence=True), ["record_id"], v.LISTS, TFIDF_STOP)


@query("claim_support_combined", """
SELECT combined_label AS combined_claim_support_label, count(*) AS claim_count,
       avg(combined) AS mean_combined, avg(semantic) AS mean_semantic FROM tf_combined GROUP BY ALL""",
       doubles="mean_combined mean_semantic")
def _(spark, sf_dir):
    return _combined(spark, sf_dir).groupBy("combined_claim_support_label").agg(
        F.count("*").alias("claim_count"), F.avg("combined_claim_support_score").alias("mean_combined"),
        F.avg("semantic_claim_support_score").alias("mean_semantic"))


@query("semantic_rollup", """
SELECT record_id, avg(semantic) AS semantic_answer_grounding_score, avg(combined) AS combined_answer_grounding_score,
       count(*) FILTER (WHERE round(semantic, 9) < 0.35) AS semantic_unsupported_claim_count,
       count(*) FILTER (WHERE combined_label = 'unsupported') AS combined_unsupported_claim_count,
       count(*) AS claim_count
FROM tf_combined GROUP BY record_id""",
       doubles="semantic_answer_grounding_score combined_answer_grounding_score")
def _(spark, sf_dir):
    return gr.semantic_rollup(_combined(spark, sf_dir))


@query("semantic_overall", """
SELECT count(DISTINCT record_id) AS rows_scored, count(*) AS claims_scored,
       avg(semantic) AS mean_semantic_claim_support_score, avg(combined) AS mean_combined_claim_support_score,
       count(*) FILTER (WHERE combined_label = 'unsupported') AS combined_unsupported_claims
FROM tf_combined""", doubles="mean_semantic_claim_support_score mean_combined_claim_support_score")
def _(spark, sf_dir):
    return gr.semantic_overall(_combined(spark, sf_dir))


# --- vectors ----------------------------------------------------------------

@query("claim_best_sentence_vec", """
SELECT record_id, claim_id, similarity FROM vec_best""", doubles="similarity")
def _(spark, sf_dir):
    return gr.best_vector_match(v.claim_vectors(spark, sf_dir), v.evidence_vectors(spark, sf_dir)).select(
        "record_id", "claim_id", "similarity")


@query("evidence_grounding_vec", "SELECT * FROM vec_grounding",
       doubles="semantic_grounding_score minimum_claim_grounding_score")
def _(spark, sf_dir):
    return v.vector_grounding(spark, sf_dir)


@query("unsupported_claims_vec", """
SELECT record_id, claim_id, claim_similarity, high_impact FROM vec_claims WHERE unsupported""",
       doubles="claim_similarity")
def _(spark, sf_dir):
    scored = gr.vector_claim_scores(v.claim_vectors(spark, sf_dir), v.evidence_vectors(spark, sf_dir),
                                    threshold=0.30)
    return scored.filter("unsupported").select("record_id", "claim_id", "claim_similarity", "high_impact")


def reference_rows(spark, sf_dir):
    """Vectors as answers: groups of 20 consecutive ids, multiples of 4 are correct answers."""
    wrong = (F.col("vec_id") % 4 != 0).cast("int")
    return v.vectors(spark, sf_dir).select(
        F.col("vec_id").alias("record_id"), F.floor(F.col("vec_id") / 20).alias("group_id"),
        wrong.alias("is_hallucinated"), "embedding",
        F.when(F.col("vec_id") % 40 == 0, "missing").when(F.col("vec_id") % 4 == 0, "correct_answer")
        .otherwise("student_answer").alias("case_type"))


SQL_VIEWS["ref_rows"] = """
SELECT vec_id AS record_id, vec_id // 20 AS group_id, CAST(vec_id % 4 <> 0 AS INTEGER) AS is_hallucinated,
       CAST(embedding AS DOUBLE[]) AS embedding,
       CASE WHEN vec_id % 40 = 0 THEN 'missing' WHEN vec_id % 4 = 0 THEN 'correct_answer'
            ELSE 'student_answer' END AS case_type FROM embeddings"""
SQL_VIEWS["ref_similar"] = """
SELECT r.record_id, r.group_id, r.is_hallucinated, list_dot_product(r.embedding, f.embedding) AS similarity
FROM ref_rows r JOIN (SELECT group_id, arg_min(embedding, record_id) AS embedding FROM ref_rows
                      WHERE case_type = 'correct_answer' GROUP BY group_id) f USING (group_id)"""


def reference_similarity(spark, sf_dir):
    return gr.reference_answer_similarity(reference_rows(spark, sf_dir))


@query("reference_answer_similarity", """
SELECT record_id, group_id, is_hallucinated, similarity AS semantic_similarity,
       CASE WHEN round(similarity, 9) < 0.5 THEN 1 ELSE 0 END AS semantic_predicted_label FROM ref_similar""",
       doubles="semantic_similarity")
def _(spark, sf_dir):
    scored = reference_similarity(spark, sf_dir)
    return scored.select("record_id", "group_id", "is_hallucinated", "semantic_similarity",
                         gr.similarity_label(F.round("semantic_similarity", 9), 0.5).alias(
                             "semantic_predicted_label"))
