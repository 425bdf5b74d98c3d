"""Per-key reductions. All combine map-side, so a hot key costs one small buffer per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panel_engine.functions.scalars import safe_date


def _order_key(order: Sequence[str]) -> Column:
    """Sort key for ``min_by``: ascending, nulls last."""
    return F.struct(*[x for o in order for x in (
        F.col(o).isNull().alias(f"__n_{o}"), F.col(o))])


def first_non_null(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str] = (),
) -> DataFrame:
    """First non-null of each column per key, by ``order`` then the value itself."""
    def pick(c: str) -> Column:
        if not order:
            return F.min(c)
        key = _order_key([*order, c])
        return F.min_by(c, F.when(F.col(c).isNotNull(), key))

    return df.groupBy(*keys).agg(*[pick(c).alias(c) for c in columns])


def majority(df: DataFrame, entity: str, label: str) -> DataFrame:
    """Most frequent label per entity; nulls do not vote, ties go to the smallest label."""
    votes = df.where(F.col(label).isNotNull()).groupBy(entity, label).agg(F.count(F.lit(1)).alias("__n"))
    return votes.groupBy(entity).agg(F.min_by(label, F.struct(-F.col("__n"), F.col(label))).alias(label))


def earliest(df: DataFrame, entity: str, date: str) -> DataFrame:
    return df.groupBy(entity).agg(F.min(date).alias(date))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key. The rank filter is pushed below the shuffle as a group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def collapse_events(df: DataFrame, keys: Sequence[str], counters: Sequence[str], rows_as: str, total: str | None = None) -> DataFrame:
    """Sum counters (null counts as 0) and rows per key; keys with nothing counted drop out, or all stay with their ``total``."""
    present = [c for c in counters if c in df.columns]
    counted = F.lit(0.0)
    for c in present:
        counted = counted + F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows_as), counted.alias(total or "__total"))
    return out if total else out.where("__total > 0").drop("__total")


def earliest_per_period(df: DataFrame, period: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return keep_first(df, period, order)


def with_event_date(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, safe_date("year", "month", "day"))


# ---- accounting ---------------------------------------------------------------------

def count_distribution(df: DataFrame, entity: str) -> DataFrame:
    """Events per entity: rows, n_ids, min, median, max (a median of counts: few values)."""
    return distribution_of(df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("n")))


def distribution_of(counts: DataFrame) -> DataFrame:
    """``count_distribution`` from events per entity, ``n``."""
    zero = F.lit(0)
    return counts.agg(
        F.coalesce(F.sum("n"), zero).alias("rows"), F.count("n").alias("n_ids"),
        F.coalesce(F.min("n"), zero).alias("min"), F.coalesce(F.median("n"), F.lit(0.0)).alias("median"),
        F.coalesce(F.max("n"), zero).alias("max"),
    )


def reconcile(
    before: DataFrame, after: DataFrame, entity: str, causes: dict[str, Column] | None = None,
) -> DataFrame:
    """Entities whose event count changed, and those that lost every event.

    ``causes`` are conditions on ``before`` rows; each adds ``by_<cause>``, the number of
    changed entities with such a row.
    """
    causes = causes or {}
    b = before.groupBy(entity).agg(
        F.count(F.lit(1)).alias("__b"),
        *[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(f"__c_{k}") for k, c in causes.items()])
    a = after.groupBy(entity).agg(F.count(F.lit(1)).alias("__a"))
    return reconcile_counts(b.join(a, entity, "full"), "__b", "__a", list(causes))


def reconcile_counts(both: DataFrame, before: str, after: str, causes: Sequence[str] = ()) -> DataFrame:
    """``reconcile`` from a row per entity with its two counts; null is none."""
    n_before, n_after = (F.coalesce(F.col(c), F.lit(0)) for c in (before, after))
    changed = n_before != n_after
    return both.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(changed).alias("changed"),
        F.count_if((n_before > 0) & (n_after == 0)).alias("lost_entirely"),
        F.coalesce(F.sum(n_before - n_after), F.lit(0)).alias("events_removed"),
        *[F.count_if(changed & (F.col(f"__c_{k}") == 1)).alias(f"by_{k}") for k in causes],
    )


def rule_counters(df: DataFrame, entity: str, rules: dict[str, Column]) -> DataFrame:
    """Per rule: rows that hit it and distinct entities concerned, in one row."""
    def hit(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    per_entity = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(hit(c)).alias(f"__k_{k}") for k, c in rules.items()])
    return per_entity.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
        *[a for k in rules for a in (
            F.coalesce(F.sum(f"__k_{k}"), F.lit(0)).alias(f"{k}_rows"),
            F.count_if(F.col(f"__k_{k}") > 0).alias(f"{k}_ids"))],
    )


def duplicate_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in duplicated keys, such keys, and rows kept when one row per key stays."""
    n = F.col("__n")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("duplicate_rows_detected"),
        F.count_if(n > 1).alias("duplicate_keys_detected"),
        F.count(F.lit(1)).alias("deduplicated_rows_kept"),
    )


def class_summary(df: DataFrame, entity: str, target: str) -> DataFrame:
    """Rows, positives, negatives and distinct entities (counted per entity first)."""
    per = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("__n"),
        F.count_if(F.col(target) == 1).alias("__p"), F.count_if(F.col(target) == 0).alias("__q"))
    zero = F.lit(0)
    return per.agg(
        F.coalesce(F.sum("__n"), zero).alias("rows"), F.coalesce(F.sum("__p"), zero).alias("positives"),
        F.coalesce(F.sum("__q"), zero).alias("negatives"), F.count(entity).alias("unique_ids"))
