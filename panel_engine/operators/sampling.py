"""Exact-ratio stratified sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panel_engine.operators.timeline import lag_name


def check_pattern(pattern: Sequence[int]) -> list[int]:
    values = [int(v) for v in pattern]
    if not values or any(v not in (0, 1) for v in values):
        raise ValueError(f"a pattern is a non-empty list of 0/1, not {pattern}")
    return values


def check_ratio(ratio: tuple[int, int] | str) -> tuple[int, int]:
    parts = ratio.split(":") if isinstance(ratio, str) else ratio
    if len(parts) != 2:
        raise ValueError(f"ratio must look like 1:5, not {ratio!r}")
    p, q = int(parts[0]), int(parts[1])
    if p <= 0 or q < p:
        raise ValueError(f"ratio units must be positive, negatives at least positives: {ratio!r}")
    return p, q


def pattern_match(target: str, pattern: Sequence[int], healthy: str, healthy_value: int) -> Column:
    """Target now and at each lag equal the pattern, and the health flag fits."""
    names = [target, *[lag_name(target, k) for k in range(1, len(pattern))]]
    hits = [F.col(f"`{n}`") == v for n, v in zip(names, pattern)]
    return reduce(lambda a, b: a & b, hits, F.col(healthy) == healthy_value)


def candidate_classes(
    df: DataFrame, target: str, healthy: str, positive: Sequence[int], negative: Sequence[int],
) -> DataFrame:
    """Rows that match either pattern, with ``__class`` 1 or 0."""
    positive, negative = check_pattern(positive), check_pattern(negative)
    if len(positive) != len(negative):
        raise ValueError("both patterns need the same length")
    cls = (
        F.when(pattern_match(target, positive, healthy, 0), 1)
        .when(pattern_match(target, negative, healthy, 1), 0)
    )
    return df.withColumn("__class", cls).where(F.col("__class").isNotNull())


def stratum_counts(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    return df.groupBy(*strata).agg(
        F.count_if(F.col("__class") == 1).alias("positives"), F.count_if(F.col("__class") == 0).alias("negatives"))


def stratum_report(df: DataFrame, strata: Sequence[str], ratio: tuple[int, int] | str) -> DataFrame:
    """One row: strata per side, shared, one-sided, and shared but too small for one block."""
    p, q = check_ratio(ratio)
    pos, neg = F.col("positives") > 0, F.col("negatives") > 0
    blocks = F.least(F.floor(F.col("positives") / p), F.floor(F.col("negatives") / q))
    return stratum_counts(df, strata).agg(
        F.count_if(pos).alias("positive_strata"), F.count_if(neg).alias("negative_strata"),
        F.count_if(pos & neg).alias("overlap_strata"),
        F.count_if(pos & ~neg).alias("dropped_positive_only_strata"),
        F.count_if(neg & ~pos).alias("dropped_negative_only_strata"),
        F.count_if(pos & neg & (blocks <= 0)).alias("dropped_insufficient_overlap_strata"),
    )


def sample_exact_ratio(
    df: DataFrame, strata: Sequence[str], ratio: tuple[int, int] | str, keys: Sequence[str], seed: int = 42,
) -> DataFrame:
    """Per shared stratum, the largest sample with exactly p positives per q negatives.

    Order inside a stratum is the MD5 of (keys, seed), so the choice repeats. A stratum may
    hold most of the table, so it is cut by the first hash digits: counts per hash bucket
    tell how many rows each bucket gives, and rows are ranked inside buckets only.
    """
    p, q = check_ratio(ratio)
    cells = [*strata, "__class", "__bucket"]
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    rows = df.withColumn("__hash", F.md5(text)).withColumn("__bucket", F.substring("__hash", 1, 4))

    buckets = rows.groupBy(*cells).agg(F.count(F.lit(1)).alias("__n"))
    quotas = (
        stratum_counts(df, strata)
        .withColumn("__blocks", F.least(F.floor(F.col("positives") / p), F.floor(F.col("negatives") / q)))
        .where(F.col("__blocks") > 0)
        .select(*strata, (F.col("__blocks") * p).alias("__pos"), (F.col("__blocks") * q).alias("__neg"))
    )
    if not strata:
        buckets = buckets.crossJoin(F.broadcast(quotas))  # one row
    else:
        buckets = buckets.join(quotas, list(strata))
    before = Window.partitionBy(*strata, "__class").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    take = (
        F.when(F.col("__class") == 1, F.col("__pos")).otherwise(F.col("__neg"))
        - F.coalesce(F.sum("__n").over(before), F.lit(0))
    )
    plan = buckets.withColumn("__take", take).where("__take > 0").select(*cells, "__take")

    inside = Window.partitionBy("__bucket", "__class", *strata).orderBy("__hash", *[F.col(k) for k in keys])
    return (
        rows.join(plan, cells).withColumn("__rn", F.row_number().over(inside))
        .where("__rn <= __take").select(*df.columns)
    )
