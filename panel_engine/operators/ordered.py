"""Ranks and running totals over ordered values without gathering a group in one task, on one path at every size.

Rows are counted per (group, distinct value), combined before the shuffle. The distinct values are then
dealt by ranges of (group, value), in the values' own type, and stored with their range's number: a
group with many values spreads over ranges, and a narrow set of values is split as well as a wide one.
Totals per (group, range), a few small rows, carry running sums from range to range. Quantiles, of which a few
ranks are wanted only, need no such order: they are narrowed down to (``narrowing``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panel_engine.functions.scalars import safe_double
from panel_engine.operators.narrowing import level_quantiles, null_safe_join, total_quantiles
from panel_engine.sources.scratch import materialize


def grouped_quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles: groups, ``n``, ``q_0`` .. ``q_{k-1}``; nulls are left out.

    Found by narrowing, in a few passes over the values, which are stored first if there are groups.
    """
    groups = list(groups)
    if not groups:
        n, found = total_quantiles(df, safe_double(value), probs)
        one = df.sparkSession.range(1 if n else 0)
        return one.select(F.lit(n).cast("long").alias("n"), *[F.lit(q).cast("double").alias(f"q_{i}") for i, q in enumerate(found)])
    cells = df.select(*groups, safe_double(value).alias("__v")).where(F.col("__v").isNotNull())
    return level_quantiles(materialize(cells, "values"), ["__v"], probs, [groups]).drop("level", "feature")


def cumulative(hist: DataFrame, value: str, weights: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Running totals of ``weights`` up to each distinct value, and the next value.

    ``hist`` has one row per (groups, value). Adds ``upto_<w>``, ``all_<w>`` and
    ``next_value``. Values keep their type and Spark's order: null first, NaN last.
    """
    groups = list(groups)
    key = F.struct(*[F.col(g) for g in groups]) if groups else F.struct(F.lit(0).alias("__one"))
    dealt = hist.select(key.alias("__k"), F.col(value).alias("__v"), *weights).repartitionByRange("__k", "__v")
    dealt = materialize(dealt.withColumn("__p", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__k", "__p").agg(
        F.min_by(F.struct("__v"), F.struct("__v")).alias("__first"), *[F.sum(w).alias(f"__t_{w}") for w in weights])
    by_range = Window.partitionBy("__k").orderBy("__p")
    running = by_range.rowsBetween(Window.unboundedPreceding, 0)
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "__k", "__p", F.lead("__first").over(by_range).alias("__next"),
        *[(F.sum(f"__t_{w}").over(running) - F.col(f"__t_{w}")).alias(f"__off_{w}") for w in weights],
        *[F.sum(f"__t_{w}").over(whole).alias(f"all_{w}") for w in weights],
    )
    by_value = Window.partitionBy("__p", "__k").orderBy("__v")
    inside = by_value.rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(offsets.hint("shuffle_hash"), ["__k", "__p"])
    following = F.coalesce(F.lead(F.struct("__v")).over(by_value), F.col("__next"))
    return out.select(
        *[F.col("__k")[g].alias(g) for g in groups], F.col("__v").alias(value), *weights, *[F.col(f"all_{w}") for w in weights],
        *[(F.col(f"__off_{w}") + F.sum(w).over(inside)).alias(f"upto_{w}") for w in weights],
        following["__v"].alias("next_value"),
    )


def dense_rank_desc(df: DataFrame, score: str, name: str, groups: Sequence[str] = ()) -> DataFrame:
    """Dense rank per group, highest score first, null last: the distinct scores are ranked and looked up."""
    groups = list(groups)
    scores = df.select(*groups, F.col(score).alias("__v")).distinct().withColumn("__one", F.lit(1))
    ranks = cumulative(scores, "__v", ["__one"], groups).select(
        *groups, "__v", (F.col("all___one") - F.col("upto___one") + 1).cast("int").alias(name))
    src = df.withColumn("__v", F.col(score))
    return null_safe_join(src, ranks, [*groups, "__v"]).select(*df.columns, name)
