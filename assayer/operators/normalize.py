"""Turn raw question / evidence / answer tables into labelled evaluation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer import terms
from assayer.functions import text as tx


def binary_pair_expand(df: DataFrame, source: str = "source_dataset", row_id: str = "row_id",
                       truth: str = "ground_truth", fake: str = "hallucinated_answer",
                       category: str = "category") -> DataFrame:
    """One source row -> a grounded (0) and a hallucinated (1) row with derived ids."""
    stem = F.concat_ws("_", F.col(source), F.col(row_id).cast("string"))
    variants = F.array(
        F.struct(F.concat(stem, F.lit("_ground_truth")).alias("record_id"),
                 F.col(truth).alias("answer"), F.lit(0).alias("is_hallucinated"),
                 F.lit("No Hallucination").alias("hallucination_category")),
        F.struct(F.concat(stem, F.lit("_hallucinated")).alias("record_id"),
                 F.col(fake).alias("answer"), F.lit(1).alias("is_hallucinated"),
                 F.col(category).alias("hallucination_category")))
    rest = [c for c in df.columns if c not in (truth, fake, category, row_id)]
    return df.select(*rest, F.explode(variants).alias("_v")).select(*rest, "_v.*")


def mcq_pair_convert(df: DataFrame, row_id: str = "row_id", correct: str = "correct_answer",
                     student: str = "student_answer") -> DataFrame:
    """Multiple-choice item -> correct answer (0) and student answer (1)."""
    return _variants(df, row_id, [
        ("_correct", correct, 0, "correct_answer"), ("_student", student, 1, "student_answer")])


def fake_item_convert(df: DataFrame, row_id: str = "row_id", option: str = "option",
                      refusal: str = "I do not know") -> DataFrame:
    """Nonsense item -> fake option (1) and a safe refusal (0)."""
    return _variants(df.withColumn("_refusal", F.lit(refusal)), row_id, [
        ("_fake_option", option, 1, "fake_option"), ("_refusal", "_refusal", 0, "safe_refusal")])


def _variants(df: DataFrame, row_id: str, rows) -> DataFrame:
    structs = F.array(*[
        F.struct(F.concat(F.col(row_id).cast("string"), F.lit(suffix)).alias("record_id"),
                 F.col(answer).alias("answer"), F.lit(label).alias("is_hallucinated"),
                 F.lit(case).alias("case_type"))
        for suffix, answer, label, case in rows])
    used = {answer for _, answer, _, _ in rows}
    rest = [c for c in df.columns if c not in used]
    return df.select(*rest, F.explode(structs).alias("_v")).select(*rest, "_v.*")


def label_map(c: Column | str) -> Column:
    """0 / 1 -> supported / hallucinated; any other value fails the job."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.when(c == 0, "supported").when(c == 1, "hallucinated")
            .otherwise(F.raise_error(F.concat(F.lit("unexpected label: "),
                                              F.coalesce(c.cast("string"), F.lit("null"))))))


def label_unmap(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.when(c == "supported", 0).when(c == "hallucinated", 1)
            .otherwise(F.raise_error(F.concat(F.lit("unexpected label: "),
                                              F.coalesce(c, F.lit("null"))))))


def headerless_pairs(df: DataFrame, cells: list[str]) -> DataFrame:
    """``pairs_of_cells`` of a row's columns ``cells``."""
    rest = [c for c in df.columns if c not in cells]
    return pairs_of_cells(df.select(*rest, F.array(*cells).alias("_row")), "_row")


def pairs_of_cells(df: DataFrame, cells: str) -> DataFrame:
    """First two non-empty cells of a ragged row; rows without one are dropped."""
    cleaned = F.filter(F.transform(cells, tx.whitespace_clean), lambda x: x != "")
    rest = [c for c in df.columns if c != cells]
    return (df.select(*rest, cleaned.alias("_cells")).filter(F.size("_cells") > 0)
            .select(*rest, F.element_at("_cells", 1).alias("prompt_a"),
                    F.coalesce(F.try_element_at("_cells", F.lit(2)), F.lit("")).alias("prompt_b"))
            .withColumn("has_pair", (F.col("prompt_b") != "").cast("int"))
            .withColumn("prompt_type", F.when(F.col("has_pair") == 1, "paired_prompt")
                        .otherwise("single_prompt")))


def prompt_inventory(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset_name", "prompt_type").agg(F.count("*").alias("rows"))


def safety_prompt(question="question", knowledge="knowledge", answer="answer",
                  template: str = terms.SAFETY_PROMPT) -> Column:
    return tx.fill_template(template, question=question, knowledge=knowledge, answer=answer)


def evidence_prompt(question="question", knowledge="knowledge",
                    template: str = terms.EVIDENCE_PROMPT) -> Column:
    return tx.fill_template(template, question=question, knowledge=knowledge)


def template_substitute(df: DataFrame, template_row: DataFrame,
                        fields: tuple[str, ...] = ("question", "knowledge", "answer"),
                        prompt: str = "prompt") -> DataFrame:
    """Rewrite one example row's prompt for every row of ``df``.

    ``template_row`` holds exactly one row (prompt and the field values inside
    it); a scalar subquery enforces that.  Each field replaces its first
    occurrence; ``template_ok`` is false where a value could not be found.
    """
    example = template_row.select(F.struct(prompt, *fields).alias("_t")).scalar()
    out = df.withColumn("_t", example)
    text = F.col(f"_t.{prompt}")
    for field in fields:
        step = f"_p_{field}"
        out = out.withColumn(step, tx.replace_first(text, F.col(f"_t.{field}"), F.col(field)))
        text = F.col(step)
    return (out.withColumn(prompt, text).withColumn("template_ok", F.col(prompt).isNotNull())
            .drop("_t", *[f"_p_{f}" for f in fields]))


def opposite_stance(label: Column | str) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return (F.when(label == "yes", "no").when(label == "no", "yes")
            .otherwise(F.raise_error(F.concat(F.lit("unexpected stance: "), label))))


def counterfactual_pairs(df: DataFrame, row_id: str = "sample_id",
                         truth: str = "ground_truth_label",
                         candidates: dict[str, str] | None = None) -> DataFrame:
    """Per yes/no question an aligned (supported) and an opposite candidate."""
    candidates = candidates or terms.STANCE_CANDIDATES
    label = F.lower(tx.strip(F.col(truth)))
    flipped = opposite_stance(label)
    answer = lambda stance: F.when(stance == "yes", candidates["yes"]).otherwise(candidates["no"])
    variant = lambda stance, expected, case: F.struct(
        answer(stance).alias("candidate_answer"), stance.alias("candidate_conclusion"),
        F.lit(expected).alias("expected_label"), F.lit(case).alias("case_type"))
    both = F.array(variant(label, "supported", "aligned_candidate"),
                   variant(flipped, "hallucinated", "contradictory_candidate"))
    return df.select("*", F.explode(both).alias("_v")).select(*df.columns, "_v.*")


def candidate_quality_flags(df: DataFrame, answer: str = "candidate_answer",
                            stance: str = "candidate_conclusion") -> DataFrame:
    """``prefix_ok`` and ``ends_complete`` for generated candidates."""
    prefix = F.when(F.col(stance) == "yes", "Yes.").when(F.col(stance) == "no", "No.")
    return (df.withColumn("expected_prefix", prefix)
            .withColumn("prefix_ok", F.coalesce(
                F.startswith(tx.text_of(answer), F.col("expected_prefix")), F.lit(False)))
            .withColumn("ends_complete",
                        tx.strip(tx.text_of(answer)).rlike(r"[.!?]\z")))


def quality_summary(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(~F.col("prefix_ok")).alias("prefix_failures"),
        F.count_if(~F.col("ends_complete")).alias("incomplete_endings"))


def repair_overlay(df: DataFrame, repairs: DataFrame, key: str = "case_id",
                   answer: str = "candidate_answer", label: str = "expected_label",
                   only_label: str = "hallucinated") -> DataFrame:
    """Apply audited overrides by id and record the audit status.

    ``checked.write_repaired`` writes the result only if every override hits one row of the right label.
    """
    fix = repairs.select(F.col(key).alias("_k"), F.col(answer).alias("_new"))
    joined = df.join(fix, (F.col(key) == F.col("_k")) & (F.col(label) == only_label), "left")
    return (joined
            .withColumn("semantic_audit_status",
                        F.when(F.col("_k").isNotNull(), "human_audited_counterfactual_repair")
                        .otherwise("generated_not_manually_repaired"))
            .withColumn(answer, F.coalesce("_new", answer)).drop("_k", "_new"))


def repair_violations(df: DataFrame, repairs: DataFrame, key: str = "case_id",
                      label: str = "expected_label",
                      only_label: str = "hallucinated") -> DataFrame:
    """Overrides that do not hit exactly one row, or hit the wrong label."""
    hits = df.groupBy(key).agg(F.count("*").alias("_n"),
                               F.count_if(F.col(label) != only_label).alias("_wrong"))
    return (repairs.select(key).join(hits, key, "left")
            .select(key, F.coalesce("_n", F.lit(0)).alias("matched_rows"),
                    F.coalesce("_wrong", F.lit(0)).alias("wrong_label_rows"))
            .filter((F.col("matched_rows") != 1) | (F.col("wrong_label_rows") > 0)))


def token_budget_audit(df: DataFrame, prompt: str = "prompt", answer: str = "answer",
                       budget: int = 512, markers: dict[str, str] | None = None) -> DataFrame:
    """Which parts of a prompt survive a cut at ``budget`` whitespace tokens."""
    markers = markers or terms.PROMPT_MARKERS
    tokens = F.split(tx.whitespace_clean(prompt), " ")
    out = df.withColumn("_tokens", tokens).withColumn("full_prompt_tokens", F.size("_tokens"))
    out = out.withColumn("_kept", F.array_join(F.slice("_tokens", 1, budget), " "))
    out = (out.withColumn("tokens_over_budget",
                          F.greatest(F.lit(0), F.col("full_prompt_tokens") - budget))
           .withColumn("was_truncated", F.col("full_prompt_tokens") > budget)
           .withColumn("candidate_text_visible",
                       F.contains(F.col("_kept"), tx.whitespace_clean(answer))))
    for name, marker in markers.items():
        out = out.withColumn(name, F.contains(F.col("_kept"), F.lit(marker)))
    usable = F.col("candidate_text_visible")
    for name in markers:
        usable = usable & F.col(name)
    return out.withColumn("fully_usable", usable).drop("_tokens", "_kept")


def token_budget_summary(audit: DataFrame, by: list[str]) -> DataFrame:
    return audit.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if("was_truncated").alias("truncated_rows"),
        F.count_if(~F.col("candidate_text_visible")).alias("candidate_missing"),
        F.count_if(~F.col("judge_question_visible")).alias("judge_question_missing"),
        F.count_if(~F.col("final_label_marker_visible")).alias("label_marker_missing"),
        F.count_if("fully_usable").alias("fully_usable_rows"),
        F.max("tokens_over_budget").alias("max_tokens_over_budget"))


def minority_oversample(df: DataFrame, label: str = "label", minority: str = "maybe",
                        copies: int = 3) -> DataFrame:
    """Repeat minority rows so that each appears ``copies`` times."""
    times = F.when(F.col(label) == minority, copies).otherwise(1)
    return df.select("*", F.explode(F.sequence(F.lit(1), times)).alias("copy_number"))


def chat_records(df: DataFrame, question: str = "question", knowledge: str = "knowledge",
                 decision: str = "decision", rationale: str = "answer",
                 context_chars: int = 3500, answer_chars: int = 700,
                 system: str = terms.CHAT_SYSTEM) -> DataFrame:
    """system / user / assistant message array with length caps on the texts."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    user = F.concat(F.lit("Research question:\n"), tx.text_of(question),
                    F.lit("\n\nPubMed abstract evidence:\n"),
                    F.substring(tx.text_of(knowledge), 1, context_chars))
    reply = F.concat(F.lit("Decision: "), F.lower(tx.text_of(decision)), F.lit("\nRationale: "),
                     F.substring(tx.text_of(rationale), 1, answer_chars))
    return df.withColumn("messages", F.array(
        message("system", F.lit(system)), message("user", user), message("assistant", reply)))
