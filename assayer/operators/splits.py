"""Balanced, leak-free splits and samples, all driven by seeded hashes.

A sample is "the first n by md5(key|seed)": independent of partitioning, task
retries and file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.operators.ranking import hash_rank, join_on, seeded_hash, sorted_rank, top_n_per_group


def balanced_pairs_per_group(df: DataFrame, group: str = "question_group_id",
                             label: str = "is_hallucinated", row_id: str = "record_id") -> DataFrame:
    """Lowest-id row of each label per group; groups lacking a label are dropped.

    One map-side-combined aggregation; no group is ever held in memory.
    """
    rest = [c for c in df.columns if c != group]
    lowest = lambda value: F.min_by(
        F.struct(*rest), F.when(F.col(label) == value, F.col(row_id)))
    kept = lambda value: F.count_if(F.col(label) == value)
    return (df.groupBy(group)
            .agg(lowest(0).alias("_s"), lowest(1).alias("_h"),
                 kept(0).alias("_ns"), kept(1).alias("_nh"))
            .filter((F.col("_ns") > 0) & (F.col("_nh") > 0))
            .select(group, F.explode(F.array("_s", "_h")).alias("_r"))
            .select(group, "_r.*"))


def choose_groups(df: DataFrame, n: int, group: str = "question_group_id",
                  seed: int = 42, strict: bool = True) -> DataFrame:
    """Rows of ``n`` groups drawn without replacement; fails when there are fewer."""
    ranked = hash_rank(df.select(group).distinct(), group, seed=seed, rank="_rank", total="_groups")
    if strict:
        ranked = ranked.filter(F.when(F.col("_groups") >= n, True).otherwise(F.raise_error(
            F.concat(F.lit(f"requested {n} groups, found "), F.col("_groups").cast("string")))
            .cast("boolean")))
    chosen = ranked.filter(F.col("_rank") <= n).select(group)
    return df.join(chosen, group, "left_semi")


def exclude_groups(df: DataFrame, protected: DataFrame,
                   group: str = "question_group_id") -> DataFrame:
    """Rows whose group is absent from ``protected``."""
    return df.join(protected.select(group).distinct(), group, "left_anti")


def unseen_holdout(df: DataFrame, train_ids: DataFrame, n: int, row_id: str = "record_id",
                   group: str = "question_group_id", label: str = "is_hallucinated",
                   seed: int = 42, strict: bool = True) -> DataFrame:
    """Pairs from groups that never touched training, ``n`` groups sampled."""
    seen = df.join(train_ids.select(row_id), row_id, "left_semi").select(group).distinct()
    fresh = df.join(seen, group, "left_anti")
    pairs = balanced_pairs_per_group(fresh, group, label, row_id)
    return choose_groups(pairs, n, group, seed, strict)


def split_membership(df: DataFrame, group: str = "question_group_id",
                     split: str = "split") -> DataFrame:
    return df.select(group, split).distinct()


def split_leakage_matrix(df: DataFrame, splits: list[str], group: str = "question_group_id",
                         split: str = "split") -> DataFrame:
    """Shared groups for every pair of splits (zero rows included).

    Each group emits its few split pairs once, so the work is linear in groups.
    """
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1:]]
    flags = [F.max((F.col(split) == s).cast("int")).alias(f"_{i}") for i, s in enumerate(splits)]
    at = {s: i for i, s in enumerate(splits)}
    per_group = df.groupBy(group).agg(*flags)
    shared = per_group.agg(*[
        F.count_if((F.col(f"_{at[a]}") == 1) & (F.col(f"_{at[b]}") == 1)).alias(f"{i}")
        for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"),
                              F.col(f"{i}").alias("shared_groups"))
                     for i, (a, b) in enumerate(pairs)])
    return (shared.select(F.explode(rows).alias("_r")).select("_r.*")
            .withColumn("passed", F.col("shared_groups") == 0))


def rank_range_split(df: DataFrame, quotas: dict[str, dict[str, tuple[int, int | None]]],
                     key: str = "record_id", label: str = "label", seed: int = 42) -> DataFrame:
    """Shuffle within each label and slice rank ranges into splits.

    ``quotas[split][label] = (first, last)``, 1-based and inclusive; ``None``
    means "to the end".  Rows outside every range are dropped.
    """
    ranked = hash_rank(df, key, by=[label], seed=seed, rank="label_rank")
    target = F.lit(None).cast("string")
    for split, per_label in quotas.items():
        for value, (first, last) in per_label.items():
            inside = (F.col(label) == value) & (F.col("label_rank") >= first)
            if last is not None:
                inside = inside & (F.col("label_rank") <= last)
            target = F.when(inside, split).otherwise(target)
    return ranked.withColumn("split", target).filter(F.col("split").isNotNull())


def stratified_quota_sample(df: DataFrame, size: int, key: str = "record_id",
                            label: str = "label", seed: int = 42) -> DataFrame:
    """``size`` rows, evenly over labels; the remainder goes to the first labels.

    The label table is one row per label, far below the broadcast threshold.
    """
    labels = df.groupBy(label).agg(F.count("*").alias("_n"))
    listed = labels.agg(F.sort_array(F.collect_list(label)).alias("_l"))
    quota = listed.select("_l", F.size("_l").alias("_k")).select(F.explode(F.transform(
        "_l", lambda v, i: F.struct(
            v.alias(label),
            (F.floor(F.lit(size) / F.col("_k")) + F.when(i < F.lit(size) % F.col("_k"), 1)
             .otherwise(0)).alias("_quota")))).alias("_r")).select("_r.*")
    ranked = hash_rank(df, key, by=[label], seed=seed, rank="label_rank")
    return join_on(ranked, quota, [label], "inner").filter(
        F.col("label_rank") <= F.col("_quota")).drop("_quota")


def stratified_fraction_split(df: DataFrame, fractions: dict[str, float], key: str = "record_id",
                              label: str = "label", seed: int = 42) -> DataFrame:
    """Cut every label's shuffled order at the cumulative fractions."""
    ranked = hash_rank(df, key, by=[label], seed=seed, rank="label_rank", total="label_rows")
    edges, cumulative = [], 0.0
    for name, share in fractions.items():
        cumulative += share
        edges.append((name, round(cumulative, 10)))
    chain = None
    for name, edge in edges[:-1]:
        hit = F.col("label_rank") <= F.col("label_rows") * F.lit(edge)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return ranked.withColumn("split", chain.otherwise(edges[-1][0]))


def hash_percent(group: Column | str, seed: int | None = None) -> Column:
    """0..99 from the first 32 bits of md5(group)."""
    group = F.col(group) if isinstance(group, str) else group
    text = group.cast("string") if seed is None else F.concat(
        group.cast("string"), F.lit(f"|{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100).cast("int")


def group_shuffle_split(df: DataFrame, group: str, test_percent: int = 20) -> DataFrame:
    """80/20 by group, never by row: a stateless map, no shuffle at all."""
    return df.withColumn("split", F.when(hash_percent(group) < test_percent, "test")
                         .otherwise("train"))


def balanced_class_sample(df: DataFrame, n: int, by: list[str], key: str = "record_id",
                          seed: int = 42, strict: bool = False) -> DataFrame:
    """``n`` rows per class in hash order; ``strict`` fails on a short class."""
    hashed = df.withColumn("_h", seeded_hash(key, seed))
    sample = top_n_per_group(hashed, by, ["_h", key], n).drop("_h")
    if not strict:
        return sample
    sizes = df.groupBy(*by).agg(F.count("*").alias("_size"))
    return (join_on(sample, sizes, by).filter(F.when(F.col("_size") >= n, True).otherwise(
        F.raise_error(F.concat(F.lit(f"class smaller than {n}: "), F.col("_size").cast("string")))
        .cast("boolean"))).drop("_size"))


def head_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return top_n_per_group(df, by, order, n)


def category_review_sample(tags: DataFrame, n: int = 5, category: str = "fairness_category",
                           key: str = "record_id", seed: int = 42) -> DataFrame:
    """Up to ``n`` distinct (record, category) rows per category."""
    once = tags.groupBy(key, category).agg(F.min_by(
        F.struct(*[c for c in tags.columns if c not in (key, category)]),
        F.to_json(F.struct(*tags.columns))).alias("_r")).select(key, category, "_r.*")
    return balanced_class_sample(once, n, [category], key, seed)


def paired_review_sample(inventory: DataFrame, n: int = 20, key: str = "record_id",
                         seed: int = 42) -> DataFrame:
    return (inventory.filter(F.col("has_pair") == 1)
            .withColumn("_h", seeded_hash(key, seed)).orderBy("_h", key).limit(n).drop("_h"))


def error_review_sample(df: DataFrame, n: int = 20, key: str = "record_id",
                        seed: int = 42) -> DataFrame:
    """Up to ``n`` false positives and ``n`` false negatives, tagged."""
    tagged = df.withColumn("error_type", F.when(
        (F.col("is_hallucinated") == 0) & (F.col("predicted_label") == 1), "false_positive").when(
        (F.col("is_hallucinated") == 1) & (F.col("predicted_label") == 0), "false_negative"))
    return balanced_class_sample(tagged.filter(F.col("error_type").isNotNull()), n,
                                 ["error_type"], key, seed)


REVIEW_BLANKS = [
    "model_name", "model_response_a", "model_response_b", "unsafe_clinical_advice_flag",
    "biased_or_stereotyped_language_flag", "demographic_difference_flag",
    "safe_refusal_or_caution_needed", "overall_fairness_risk", "notes",
]


def review_template(singles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two samples in one wide sheet with blank review columns."""
    def shape(df, kind, prompt_b, category):
        return df.select(F.lit(kind).alias("evaluation_type"), "dataset_name", "record_id",
                         category.alias("fairness_category"), "prompt_a",
                         prompt_b.alias("prompt_b"),
                         *[F.lit("").alias(c) for c in REVIEW_BLANKS])
    return shape(singles, "single_prompt_fairness", F.lit(""), F.col("fairness_category")).unionByName(
        shape(pairs, "paired_prompt_comparison", F.col("prompt_b"), F.lit("")))


def sequential_case_ids(df: DataFrame, order: list[str], split: str = "split",
                        width: int = 5, name: str = "id") -> DataFrame:
    """``<split>_00001 ...`` in a total order, without a one-task window."""
    ranked = sorted_rank(df, order, by=[split], rank="_rank")
    digits = F.col("_rank").cast("string")
    padded = F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
    return ranked.withColumn(name, F.concat(F.col(split), F.lit("_"), padded)).drop("_rank")


def incremental_todo(df: DataFrame, done: DataFrame, key: str = "record_id") -> DataFrame:
    """Rows without a finished result.

    With ``done`` from ``writers.write_bucketed`` the history is neither shuffled nor sorted.
    """
    return df.join(done.select(key), key, "left_anti")


def split_manifest(df: DataFrame, split: str = "split", group: str = "question_group_id",
                   sections: dict[str, str] | None = None, seed: int = 42) -> DataFrame:
    """Long-form manifest: rows, groups, seed and value counts of every split.

    The id list of a split is a table (``split_members``), never one array.
    """
    sections = sections or {"labels": "label", "dataset_rows": "dataset_name",
                            "original_source_splits": "source_split"}
    wide = df.select(split, F.explode(F.array(*[
        F.struct(F.lit(section).alias("section"), F.col(c).cast("string").alias("item"))
        for section, c in sections.items()])).alias("_s")).select(split, "_s.*")
    values = wide.groupBy(split, "section", "item").agg(F.count("*").alias("value"))
    rows = df.groupBy(split).agg(F.count("*").alias("value"))
    groups = df.select(split, group).distinct().groupBy(split).agg(F.count(group).alias("value"))
    fixed = lambda part, item: part.select(split, F.lit("totals").alias("section"),
                                           F.lit(item).alias("item"), "value")
    seeds = rows.withColumn("value", F.lit(seed).cast("bigint"))
    return (values.unionByName(fixed(rows, "rows")).unionByName(fixed(groups, "question_groups"))
            .unionByName(fixed(seeds, "seed")))


def split_members(df: DataFrame, split: str = "split", key: str = "record_id") -> DataFrame:
    return df.select(split, key)
