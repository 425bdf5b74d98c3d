"""Cross-model feature consensus over ranking tables, one row per (model, feature)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panel_engine.functions.scalars import (
    consensus_label, count_in_pool, dead_zone_sign, safe_double, split_list,
)
from panel_engine.operators.ordered import dense_rank_desc
from panel_engine.operators.reduce import keep_first
from panel_engine.sources.scratch import materialize

PERM_ALIASES = {
    "feature": ["feature"],
    "perm_score": ["perm_importance_norm", "perm_norm", "perm_importance_mean", "perm_mean"],
    "interaction_partners": ["top_interaction_partners", "interaction_partners"],
}
SHAP_ALIASES = {
    "feature": ["feature"],
    "mean_abs_shap": ["mean_abs_shap", "shap_mean_abs", "mean_abs"],
    "spearman": ["spearman_feature_vs_shap", "spearman", "spearman_corr"],
}


def check_thresholds(
    n_models: int, core_top_k: int, support_top_k: int, min_interactions: int, min_core: int,
    min_support: int, monotonicity: float,
) -> None:
    checks = {
        "at least one model": n_models > 0,
        "core_top_k > 0": core_top_k > 0,
        "0 < support_top_k <= core_top_k": 0 < support_top_k <= core_top_k,
        "min_interactions > 0": min_interactions > 0,
        "1 <= min_core <= models": 1 <= min_core <= n_models,
        "1 <= min_support <= models": 1 <= min_support <= n_models,
        "min_core <= min_support": min_core <= min_support,
        "0 <= monotonicity <= 1": 0.0 <= monotonicity <= 1.0,
    }
    broken = [name for name, ok in checks.items() if not ok]
    if broken:
        raise ValueError(f"thresholds break: {', '.join(broken)}")


def top_k(df: DataFrame, rank: str, k: int, model: str = "model") -> DataFrame:
    """Exactly k rows per model, ties by feature name."""
    w = Window.partitionBy(model).orderBy(rank, "feature")
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def rank_permutation(df: DataFrame) -> DataFrame:
    """(model, feature, perm_score, interaction_partners as text) -> cleaned and ranked.

    Ranking reads the cleaned table several times, so it is stored first; so are the ranks.
    """
    df = df.select(
        "model", F.trim("feature").alias("feature"),
        F.coalesce(safe_double("perm_score"), F.lit(0.0)).alias("perm_score"),
        split_list("interaction_partners").alias("interaction_partners"))
    df = keep_first(df, ["model", "feature"], [F.desc("perm_score"), F.col("interaction_partners")])
    return materialize(dense_rank_desc(materialize(df, "scores"), "perm_score", "rank_perm", ["model"]), "ranks")


def rank_shap(df: DataFrame, monotonicity: float) -> DataFrame:
    df = df.select(
        "model", F.trim("feature").alias("feature"),
        F.coalesce(safe_double("mean_abs_shap"), F.lit(0.0)).alias("mean_abs_shap"),
        F.coalesce(safe_double("spearman"), F.lit(0.0)).alias("spearman"))
    df = keep_first(df, ["model", "feature"], [F.desc("mean_abs_shap"), F.col("spearman")])
    ranked = dense_rank_desc(materialize(df, "scores"), "mean_abs_shap", "rank_shap", ["model"])
    return materialize(ranked, "ranks").withColumns({
        "spearman_abs": F.abs("spearman"), "spearman_sign": dead_zone_sign("spearman", monotonicity)})


def top_pool(perm: DataFrame, shap: DataFrame, k: int) -> DataFrame:
    """Per model, the union of both top-k feature sets as one array."""
    both = (
        top_k(perm, "rank_perm", k).select("model", "feature")
        .unionByName(top_k(shap, "rank_shap", k).select("model", "feature"))
    )
    return both.groupBy("model").agg(F.collect_set("feature").alias("pool"))


def model_matrix(
    perm: DataFrame, shap: DataFrame, core_top_k: int = 10, support_top_k: int = 3,
    min_interactions: int = 2, monotonicity: float = 0.5,
) -> DataFrame:
    """Per (model, feature): both ranks, interaction support, label and its reason."""
    perm, shap = rank_permutation(perm), rank_shap(shap, monotonicity)
    counted = perm.join(top_pool(perm, shap, support_top_k), "model", "left").select(
        "model", "feature", "rank_perm",
        count_in_pool("interaction_partners", "pool", support_top_k).alias("n_interactions_with_top"))
    views = counted.join(
        shap.select("model", "feature", "rank_shap", "spearman_sign", "spearman_abs"), ["model", "feature"], "full")
    worst = perm.groupBy("model").agg((F.max("rank_perm") + 1).alias("__wp")).join(
        shap.groupBy("model").agg((F.max("rank_shap") + 1).alias("__ws")), "model", "full")
    one = F.lit(1)
    filled = views.join(worst, "model").withColumns({
        "__wp": F.coalesce("__wp", one), "__ws": F.coalesce("__ws", one)}).select(
        "feature", "model",
        F.coalesce("rank_perm", "__wp").alias("rank_perm"), F.coalesce("rank_shap", "__ws").alias("rank_shap"),
        F.coalesce("spearman_sign", F.lit("zero")).alias("spearman_sign"),
        F.coalesce("spearman_abs", F.lit(0.0)).alias("spearman_abs"),
        F.coalesce("n_interactions_with_top", F.lit(0)).alias("n_interactions_with_top"))
    verdict = consensus_label(
        F.col("rank_perm"), F.col("rank_shap"), F.col("n_interactions_with_top"), F.col("spearman_sign"),
        core_top_k, support_top_k, min_interactions)
    return filled.withColumn("__v", verdict).select(
        *filled.columns, F.col("__v.label").alias("model_label"), F.col("__v.reason").alias("label_reason"))


def vote(matrix: DataFrame, models: Sequence[str], min_core: int = 2, min_support: int = 2) -> DataFrame:
    """Final label per feature; a model that lacks the feature votes peripheral."""
    core, support = F.col("core_votes"), F.col("supportive_votes")
    label = (
        F.when(core >= min_core, "core").when(core + support >= min_support, "support").otherwise("peripheral"))
    return (
        matrix.where(F.col("model").isin(list(models))).groupBy("feature").agg(
            F.count_if(F.col("model_label") == "core").alias("core_votes"),
            F.count_if(F.col("model_label") == "supportive").alias("supportive_votes"))
        .withColumn("peripheral_votes", F.lit(len(models)) - core - support)
        .withColumn("label", label)
        .withColumn("to_select", F.when(F.col("label") == "peripheral", "no").otherwise("yes"))
        .select("feature", "to_select", "label", "core_votes", "supportive_votes", "peripheral_votes")
    )


def matrix_order(df: DataFrame) -> DataFrame:
    return df.orderBy("model", "model_label", "rank_perm", "rank_shap", "feature")


def vote_order(df: DataFrame) -> DataFrame:
    """Selected first, core before support before peripheral, then by name."""
    rank = F.when(F.col("label") == "core", 0).when(F.col("label") == "support", 1).otherwise(2)
    return df.orderBy(F.when(F.col("to_select") == "yes", 0).otherwise(1), rank, "feature")
