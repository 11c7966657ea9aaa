"""How well the evidence supports an answer, claim by claim."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, functions as F

from assayer import terms
from assayer.functions import arrays as ar, text as tx
from assayer.operators.claims import _score_batch, claim_rows  # noqa: F401 (the Arrow step)
from assayer.operators.ranking import collapse_values, join_on, median_of
from assayer.operators.tiles import tiled


@dataclass(frozen=True)
class TermLists:
    """Word lists of the lexical scorer; all are parameters."""

    stopwords: list[str] = field(default_factory=lambda: terms.CLAIM_STOPWORDS)
    negation: list[str] = field(default_factory=lambda: terms.NEGATION_TERMS)
    uncertainty: list[str] = field(default_factory=lambda: terms.UNCERTAINTY_TERMS)
    direction: list[str] = field(default_factory=lambda: terms.DIRECTION_TERMS)
    high_impact: list[str] = field(default_factory=lambda: terms.HIGH_IMPACT_TERMS)
    strict_terms: bool = True

    def tokens(self, c) -> Column:
        return tx.tokens_claim(c, self.stopwords, self.negation, self.strict_terms)


def support_label(score: Column | str, cuts=terms.LEXICAL_SUPPORT_CUTS) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return (F.when(score >= cuts[0], "supported").when(score >= cuts[1], "partial")
            .otherwise("unsupported"))


# --- overlap and paired comparison ------------------------------------------

def with_overlap(df: DataFrame, answer: str = "answer", knowledge: str = "knowledge",
                 stopwords=terms.OVERLAP_STOPWORDS) -> DataFrame:
    return df.withColumn("answer_knowledge_overlap", ar.overlap_score(
        tx.tokens_alpha(answer, stopwords), tx.tokens_alpha(knowledge, stopwords)))


def distribution(df: DataFrame, by: list[str], value: str, prefix: str = "") -> DataFrame:
    """count / mean / exact median / min / max per group, from one collapsed exchange."""
    values = collapse_values(df, by, value)
    base = values.groupBy(*by).agg(
        F.sum("_n").alias(f"{prefix}count"),
        (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias(f"{prefix}mean"),
        F.min("_v").alias(f"{prefix}min"), F.max("_v").alias(f"{prefix}max"))
    return join_on(base, median_of(values, by, name=f"{prefix}median"), by)


def overlap_summary(df: DataFrame, label: str = "is_hallucinated", **kw) -> DataFrame:
    scored = with_overlap(df, **kw).select(label, "answer_knowledge_overlap")
    return distribution(scored, [label], "answer_knowledge_overlap").withColumn(
        "label", F.when(F.col(label) == 0, "Not Hallucinated").otherwise("Hallucinated"))


def paired_answer_comparison(df: DataFrame, suffixes=("_ground_truth", "_hallucinated"),
                             stopwords=terms.PAIRED_STOPWORDS,
                             direction=terms.PAIRED_DIRECTION_TERMS) -> DataFrame:
    """Grounded vs hallucinated answer of every pair id: four similarities, one delta.

    Token sets are projected before the join, so only sets are shuffled.
    """
    tokens = lambda c: tx.tokens_alpha(c, stopwords)
    directed = lambda c: F.array_intersect(F.col(c), tx.literal_array(direction))
    keyed = df.withColumn("pair_id", tx.base_id("record_id", suffixes))
    grounded = keyed.filter(F.col("is_hallucinated") == 0).select(
        "pair_id", F.col("record_id").alias("grounded_record_id"),
        tokens("answer").alias("_g"), tokens("knowledge").alias("_k")).withColumn(
        "_gd", directed("_g"))
    hallucinated = keyed.filter(F.col("is_hallucinated") == 1).select(
        "pair_id", F.col("record_id").alias("hallucinated_record_id"),
        tokens("answer").alias("_h")).withColumn("_hd", directed("_h"))
    common = lambda x, y: F.size(F.array_intersect(x, y))
    sized = grounded.join(hallucinated, "pair_id").select(
        "pair_id", "grounded_record_id", "hallucinated_record_id",
        *[F.size(c).alias(c) for c in ("_g", "_h", "_k", "_gd", "_hd")],
        common("_g", "_h").alias("_gh"), common("_k", "_g").alias("_kg"),
        common("_k", "_h").alias("_kh"), common("_gd", "_hd").alias("_dd"))
    scored = sized.select(
        "pair_id", "grounded_record_id", "hallucinated_record_id",
        ar.jaccard_sizes("_g", "_h", "_gh").alias("answer_similarity"),
        ar.jaccard_sizes("_k", "_g", "_kg").alias("knowledge_grounded_similarity"),
        ar.jaccard_sizes("_k", "_h", "_kh").alias("knowledge_hallucinated_similarity"),
        ar.jaccard_sizes("_gd", "_hd", "_dd").alias("clinical_direction_similarity"))
    return scored.withColumn("grounding_similarity_delta", F.col("knowledge_grounded_similarity")
                             - F.col("knowledge_hallucinated_similarity"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """Means of the similarities and the median answer similarity.

    Both read the collapsed values, so the texts are scored once.
    """
    others = ["knowledge_grounded_similarity", "knowledge_hallucinated_similarity",
              "grounding_similarity_delta", "clinical_direction_similarity"]
    values = collapse_values(pairs, [], "answer_similarity", others)
    mean = lambda c: (F.sum(f"_s_{c}") / F.sum("_n"))
    means = values.agg(
        F.sum("_n").alias("paired_examples"),
        (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean_answer_similarity"),
        mean(others[0]).alias("mean_grounded_answer_knowledge_similarity"),
        mean(others[1]).alias("mean_hallucinated_answer_knowledge_similarity"),
        mean(others[2]).alias("mean_grounding_similarity_delta"),
        mean(others[3]).alias("mean_clinical_direction_similarity"))
    median = median_of(values, [], name="median_answer_similarity")
    return means.withColumn("median_answer_similarity", median.scalar())


# --- lexical claim scoring --------------------------------------------------

def score_claims(parts: DataFrame, weights: dict[str, float] = terms.CLAIM_WEIGHTS) -> DataFrame:
    """Weighted support of claim rows plus the risk flags."""
    scored = parts.withColumn(
        "claim_support_score",
        weights["token"] * F.col("claim_token_support")
        + weights["direction"] * F.col("clinical_direction_support")
        + weights["negation"] * F.col("negation_support")
        + weights["number"] * F.col("numeric_support")
        + weights["uncertainty"] * F.col("uncertainty_support"))
    return (scored
            .withColumn("claim_support_label", support_label("claim_support_score"))
            .withColumn("unsupported_high_impact_claim",
                        F.col("high_impact_claim") & (F.col("claim_support_score") < 0.40))
            .withColumn("contradiction_risk",
                        (F.col("clinical_direction_support") < 0.50)
                        | (F.col("negation_support") < 0.50) | (F.col("numeric_support") < 0.50)))


def claim_scores(df: DataFrame, keep: list[str], lists: TermLists = TermLists()) -> DataFrame:
    """Scored claims; records without claims have no row here."""
    return score_claims(claim_rows(df, keep, lists=lists)).filter(F.col("claim_index").isNotNull())


ROLLUP_COUNTS = [
    "claim_count", "supported_claim_count", "partial_claim_count", "unsupported_claim_count",
    "unsupported_high_impact_claim_count", "contradiction_risk_count",
]


def _lexical_aggregates() -> list[Column]:
    real = F.col("claim_index").isNotNull()
    labelled = lambda label: F.count_if(real & (F.col("claim_support_label") == label))
    return [
        F.count("claim_index").alias("claim_count"),
        labelled("supported").alias("supported_claim_count"),
        labelled("partial").alias("partial_claim_count"),
        labelled("unsupported").alias("unsupported_claim_count"),
        F.count_if(real & F.col("unsupported_high_impact_claim")).alias(
            "unsupported_high_impact_claim_count"),
        F.count_if(real & F.col("contradiction_risk")).alias("contradiction_risk_count"),
        F.coalesce(F.avg(F.when(real, F.col("claim_support_score"))), F.lit(0.0)).alias(
            "answer_claim_grounding_score"),
    ]


def claim_grounding_rollup(df: DataFrame, keep: list[str],
                           lists: TermLists = TermLists()) -> DataFrame:
    """Per answer: mean score and counts; answers without claims stay with score 0.

    ``keep`` starts with the record id.  All claims of a record leave one input
    row, so the partial aggregation reduces them to one row before the exchange.
    """
    scored = score_claims(claim_rows(df, keep, lists=lists))
    return scored.groupBy(*keep).agg(*_lexical_aggregates())


def claim_grounding_with_semantics(df: DataFrame, keep: list[str], semantic: Column,
                                   lists: TermLists = TermLists()) -> DataFrame:
    """Lexical and combined grounding from the same claim rows in one aggregation.

    ``semantic`` is the claim's semantic score (null where none was computed);
    the combined columns are null for records without one.
    """
    scored = claim_support_combined(
        score_claims(claim_rows(df, keep, lists=lists)).withColumn(
            "semantic_claim_support_score", F.when(F.col("claim_index").isNotNull(), semantic)))
    known = F.col("semantic_claim_support_score").isNotNull()
    unsupported = F.col("combined_claim_support_label") == "unsupported"
    return scored.groupBy(*keep).agg(
        *_lexical_aggregates(),
        F.avg("combined_claim_support_score").alias("combined_answer_grounding_score"),
        F.when(F.count_if(known) > 0, F.count_if(known & unsupported)).alias(
            "combined_unsupported_claim_count"))


def claim_grounding_summary(scored: DataFrame, label: str = "is_hallucinated") -> DataFrame:
    return scored.groupBy(label, "claim_support_label").agg(F.count("*").alias("claim_count"))


def claim_grounding_overall(rollup: DataFrame) -> DataFrame:
    return rollup.agg(
        F.count("*").alias("rows_scored"), F.sum("claim_count").alias("claims_scored"),
        F.avg("answer_claim_grounding_score").alias("mean_answer_claim_grounding_score"),
        F.avg("unsupported_claim_count").alias("mean_unsupported_claim_count"),
        F.avg("unsupported_high_impact_claim_count").alias(
            "mean_unsupported_high_impact_claim_count"),
        F.count_if(F.col("contradiction_risk_count") > 0).alias("rows_with_contradiction_risk"))


# --- best evidence sentence by TF-IDF ---------------------------------------

def english_stopwords() -> list[str]:
    """The published English list: the ML library's, without contractions, and the changes stated in ``terms``."""
    loaded = [w for w in StopWordsRemover.loadDefaultStopWords("english") if w.isalpha()]
    return sorted({*loaded, *terms.STOPWORDS_ADDED} - set(terms.STOPWORDS_LEFT_OUT))


def claim_best_sentence_tfidf(df: DataFrame, keep: list[str], answer: str = "answer",
                              knowledge: str = "knowledge",
                              stopwords: list[str] | None = None) -> DataFrame:
    """Per claim the most similar evidence sentence (1-2-gram TF-IDF cosine).

    Claims and sentences of a record come from the same input row, so this is a
    map-only job and no claim x sentence pair leaves a task.
    """
    stopwords = english_stopwords() if stopwords is None else stopwords
    return claim_rows(df, keep, answer, knowledge, stopwords=stopwords).filter(F.col("claim_index").isNotNull())


def semantic_claim_scores(df: DataFrame, keep: list[str], lists: TermLists = TermLists(),
                          stopwords: list[str] | None = None) -> DataFrame:
    """TF-IDF, lexical and combined support of every claim, from one Arrow step."""
    stopwords = english_stopwords() if stopwords is None else stopwords
    rows = claim_rows(df, keep, lists=lists, stopwords=stopwords).filter(F.col("claim_index").isNotNull())
    return claim_support_combined(score_claims(rows))


def claim_support_combined(df: DataFrame, semantic: str = "semantic_claim_support_score",
                           lexical: str = "claim_support_score") -> DataFrame:
    """0.7 semantic + 0.3 lexical, both labelled with the semantic cuts."""
    cuts = terms.SEMANTIC_SUPPORT_CUTS
    return (df.withColumn("semantic_claim_support_label", support_label(semantic, cuts))
            .withColumn("combined_claim_support_score",
                        0.70 * F.col(semantic) + 0.30 * F.col(lexical))
            .withColumn("combined_claim_support_label",
                        support_label("combined_claim_support_score", cuts)))


def semantic_rollup(combined: DataFrame, row_id: str = "record_id") -> DataFrame:
    unsupported = lambda c: F.count_if(F.col(c) == "unsupported")
    return combined.groupBy(row_id).agg(
        F.avg("semantic_claim_support_score").alias("semantic_answer_grounding_score"),
        F.avg("combined_claim_support_score").alias("combined_answer_grounding_score"),
        unsupported("semantic_claim_support_label").alias("semantic_unsupported_claim_count"),
        unsupported("combined_claim_support_label").alias("combined_unsupported_claim_count"),
        F.count("*").alias("claim_count"))


def semantic_overall(combined: DataFrame, row_id: str = "record_id") -> DataFrame:
    per_record = combined.groupBy(row_id).agg(
        F.count("*").alias("_n"), F.sum("semantic_claim_support_score").alias("_s"),
        F.sum("combined_claim_support_score").alias("_c"),
        F.count_if(F.col("combined_claim_support_label") == "unsupported").alias("_u"))
    return per_record.agg(
        F.count("*").alias("rows_scored"), F.sum("_n").alias("claims_scored"),
        (F.sum("_s") / F.sum("_n")).alias("mean_semantic_claim_support_score"),
        (F.sum("_c") / F.sum("_n")).alias("mean_combined_claim_support_score"),
        F.sum("_u").alias("combined_unsupported_claims"))


# --- best evidence vector ---------------------------------------------------

def best_vector_match(claims: DataFrame, evidence: DataFrame, record: str = "record_id",
                      claim_id: str = "claim_id", evidence_id: str = "evidence_id",
                      vector: str = "embedding", block: int = 2048) -> DataFrame:
    """Max inner product (and its evidence id) per claim within a record.

    A tile is one matrix product and emits one row per claim; the final maximum
    over tiles combines map-side.
    """
    left = claims.select(record, claim_id, F.col(vector).alias("_cv"))
    right = evidence.select(record, evidence_id, F.col(vector).alias("_ev"))
    kind = dict(left.dtypes) | dict(right.dtypes)

    def score(c: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(e):
            return pd.DataFrame({record: [], claim_id: [], evidence_id: [], "similarity": []})
        e = e.sort_values(evidence_id)
        products = (np.stack(c["_cv"].to_numpy()).astype(float)
                    @ np.stack(e["_ev"].to_numpy()).astype(float).T)
        at = np.round(products, 12).argmax(axis=1)
        return pd.DataFrame({record: c[record].to_numpy(), claim_id: c[claim_id].to_numpy(),
                             evidence_id: e[evidence_id].to_numpy()[at],
                             "similarity": products[np.arange(len(at)), at]})

    tiles = tiled(left, right, [record], claim_id, evidence_id, score,
                  f"`{record}` {kind[record]}, `{claim_id}` {kind[claim_id]}, "
                  f"`{evidence_id}` {kind[evidence_id]}, similarity double", block)
    best = tiles.groupBy(record, claim_id).agg(F.min_by(
        F.struct("similarity", evidence_id),
        F.struct(-F.round("similarity", 12), evidence_id)).alias("_b"))
    return best.select(record, claim_id, F.col("_b.similarity").alias("similarity"),
                       F.col(f"_b.{evidence_id}").alias(evidence_id))


def vector_claim_scores(claims: DataFrame, evidence: DataFrame, record: str = "record_id",
                        claim_id: str = "claim_id", high_impact: str = "high_impact",
                        threshold: float = terms.UNSUPPORTED_SIMILARITY) -> DataFrame:
    """Per claim: clamped similarity and the unsupported flags.

    Claims of a record without evidence score 0 and count as unsupported.
    """
    best = best_vector_match(claims, evidence, record, claim_id).select(
        record, claim_id, "similarity")
    joined = claims.select(record, claim_id, high_impact).join(best, [record, claim_id], "left")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("similarity", F.lit(0.0))))
    return (joined.withColumn("claim_similarity", clamped)
            .withColumn("unsupported", F.col("similarity").isNull()
                        | (F.col("claim_similarity") < threshold))
            .withColumn("unsupported_high_impact", F.col("unsupported") & F.col(high_impact)))


def evidence_grounding_vec(records: DataFrame, claims: DataFrame, evidence: DataFrame,
                           record: str = "record_id", claim_id: str = "claim_id",
                           high_impact: str = "high_impact",
                           threshold: float = terms.UNSUPPORTED_SIMILARITY) -> DataFrame:
    """Per answer: counts, mean and minimum grounding; records without claims score 0.

    The unsupported claims themselves are the rows of ``vector_claim_scores``;
    they are not folded into one string, whose size nothing would bound.
    """
    scored = vector_claim_scores(claims, evidence, record, claim_id, high_impact, threshold)
    rolled = scored.groupBy(record).agg(
        F.count("*").alias("claim_count"),
        F.count_if(~F.col("unsupported")).alias("grounded_claim_count"),
        F.count_if("unsupported").alias("unsupported_claim_count"),
        F.count_if("unsupported_high_impact").alias("unsupported_high_impact_claim_count"),
        F.avg("claim_similarity").alias("semantic_grounding_score"),
        F.min("claim_similarity").alias("minimum_claim_grounding_score"))
    numbers = {c: (0.0 if c.endswith("score") else 0) for c in rolled.columns if c != record}
    return records.select(record).join(rolled, record, "left").fillna(numbers, list(numbers))


def reference_answer_similarity(df: DataFrame, group: str = "group_id", row_id: str = "record_id",
                                case: str = "case_type", vector: str = "embedding",
                                reference_case: str = "correct_answer") -> DataFrame:
    """Attach the group's reference answer (lowest id) and its cosine.

    Rows of groups without a reference are dropped.  The reference side has one
    row per group, so a hot group is split by the adaptive skew join.
    """
    references = (df.filter(F.col(case) == reference_case).groupBy(group)
                  .agg(F.min_by(vector, row_id).alias("_reference")))
    return (df.join(references, group)
            .filter(F.col(vector).isNotNull())
            .withColumn("semantic_similarity", ar.dot(vector, "_reference")).drop("_reference"))


def similarity_label(score: Column | str, threshold: float) -> Column:
    """Low similarity to the reference answer means hallucinated."""
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score < threshold, 1).otherwise(0)
