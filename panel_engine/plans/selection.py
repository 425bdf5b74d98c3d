"""Feature subset voted from several models' ranking reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panel_engine.operators import consensus
from panel_engine.sources.readers import select_aliased


def read_reports(spark: SparkSession, paths: Mapping[str, str], aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """All models' CSV reports as one long table with a ``model`` column."""
    parts = [
        select_aliased(spark.read.option("header", True).csv(path), aliases).withColumn("model", F.lit(model))
        for model, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def select_features(
    perm: DataFrame, shap: DataFrame, models: Sequence[str], core_top_k: int = 10, support_top_k: int = 3,
    min_interactions: int = 2, min_core: int = 2, min_support: int = 2, monotonicity: float = 0.5,
) -> tuple[DataFrame, DataFrame]:
    """(votes, per-model matrix)."""
    consensus.check_thresholds(
        len(models), core_top_k, support_top_k, min_interactions, min_core, min_support, monotonicity)
    matrix = consensus.model_matrix(perm, shap, core_top_k, support_top_k, min_interactions, monotonicity)
    return consensus.vote(matrix, models, min_core, min_support), matrix


def select_features_from_csv(
    spark: SparkSession, perm_csvs: Sequence[str], shap_csvs: Sequence[str],
    models: Sequence[str] | None = None, **thresholds,
) -> tuple[DataFrame, DataFrame]:
    if len(perm_csvs) != len(shap_csvs):
        raise ValueError("need one permutation and one SHAP report per model")
    models = list(models) if models else [f"model_{i + 1}" for i in range(len(perm_csvs))]
    if len(models) != len(perm_csvs):
        raise ValueError("need one name per report")
    perm = read_reports(spark, dict(zip(models, perm_csvs)), consensus.PERM_ALIASES)
    shap = read_reports(spark, dict(zip(models, shap_csvs)), consensus.SHAP_ALIASES)
    return select_features(perm, shap, models, **thresholds)
