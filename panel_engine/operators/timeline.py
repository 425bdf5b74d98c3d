"""Time-aware operators per entity.

No window here runs over raw rows of an entity: rows collapse to (entity, period) first,
map-side, so a window partition holds at most one row per calendar period however many
rows one entity owns. Results return to the rows by an equi-join on (entity, period),
which adaptive execution splits when a key is hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panel_engine.functions.scalars import month_index
from panel_engine.operators.ordered import null_safe_join
from panel_engine.operators.reduce import keep_first

MONTH_IDX = "__month_idx"


def _periods(entity: str, period: Sequence[str]):
    return Window.partitionBy(entity).orderBy(*[F.col(p).asc_nulls_last() for p in period])


def entity_context(
    df: DataFrame, entity: str, period: Sequence[str],
    last: Mapping[str, str] | None = None, ever: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Forward-fills and ever-flags in one pass.

    ``last`` maps an output name to the event-date column whose last known value is carried
    forward; rows of one period are ordered by that date, nulls last. ``ever`` maps an output
    name to a condition; the flag is 1 on all rows of an entity that meets it once.
    """
    last, ever = dict(last or {}), dict(ever or {})
    per_period = df.groupBy(entity, *period).agg(
        *[F.max(c).alias(f"__l_{o}") for o, c in last.items()],
        *[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(f"__e_{o}") for o, c in ever.items()])
    w = _periods(entity, period)
    context = per_period.select(
        entity, *period,
        *[F.last(f"__l_{o}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"__l_{o}")
          for o in last],
        *[F.max(f"__e_{o}").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(o)
          for o in ever])
    out = null_safe_join(df, context, [entity, *period], "left")
    return out.withColumns({o: F.coalesce(F.col(c), F.col(f"__l_{o}")) for o, c in last.items()}).drop(
        *[f"__l_{o}" for o in last])


def forward_fill(df: DataFrame, entity: str, period: Sequence[str], column: str, name: str) -> DataFrame:
    return entity_context(df, entity, period, last={name: column})


def ever_flag(df: DataFrame, entity: str, condition: Column, name: str) -> DataFrame:
    """1 on every row of an entity that meets the condition on any row."""
    flags = df.groupBy(entity).agg(F.max(F.coalesce(condition, F.lit(False)).cast("int")).alias(name))
    return df.join(flags, entity, "left")


def event_within(
    df: DataFrame, events: DataFrame, entity: str, check: str, event: str,
    min_days: int, max_days: int, name: str,
) -> DataFrame:
    """1 when the entity has an event ``min_days`` to ``max_days`` after the row's check date.

    Existence over a day range, not a range join: distinct days per entity, one range frame,
    so many events per entity never multiply rows.
    """
    def days(frame: DataFrame, column: str, is_event: int) -> DataFrame:
        return frame.where(F.col(column).isNotNull()).select(
            entity, F.unix_date(F.col(column).cast("date")).alias("__day"), F.lit(is_event).alias("__event"))

    marks = days(df, check, 0).unionByName(days(events, event, 1))
    per_day = marks.groupBy(entity, "__day").agg(
        F.max("__event").alias("__event"), F.min("__event").alias("__only_event"))
    ahead = Window.partitionBy(entity).orderBy("__day").rangeBetween(min_days, max_days)
    labels = (
        per_day.withColumn(name, F.max("__event").over(ahead))
        .where("__only_event = 0").select(entity, "__day", name)
    )
    out = df.withColumn("__day", F.unix_date(F.col(check).cast("date"))).join(labels, [entity, "__day"], "left")
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0))).select(*df.columns, name)


# ---- lags and anchors ---------------------------------------------------------------

def lag_name(column: str, k: int) -> str:
    return f"{column}_t-{k}"


def with_month_index(df: DataFrame, year: str = "year", month: str = "month") -> DataFrame:
    return df.withColumn(MONTH_IDX, month_index(year, month))


def unique_periods(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """First row per entity-period by ``order``, then by the remaining columns."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return keep_first(df, keys, [F.col(f"`{c}`").asc_nulls_last() for c in [*order, *rest]])


def add_lags(df: DataFrame, entity: str, columns: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """Row-based lags of columns and of the month index. ``df`` has one row per period."""
    w = Window.partitionBy(entity).orderBy(MONTH_IDX)
    return df.withColumns({
        lag_name(c, k): F.lag(c, k).over(w) for k in lags for c in [MONTH_IDX, *columns]})


def consecutive(lags: Sequence[int]) -> Column:
    """Every lagged month exists and lies exactly k months back."""
    hits = [F.col(MONTH_IDX) - F.col(f"`{lag_name(MONTH_IDX, k)}`") == k for k in lags]
    return F.coalesce(reduce(lambda a, b: a & b, hits), F.lit(False))


def _reachable_rows(df: DataFrame, entity: str, lags: Sequence[int], order: Sequence[str]) -> DataFrame:
    """The rows per month that decide row-based lags: the first min(lags) and last max(lags).

    A row further into its month has its shortest lag inside the same month, so it is no
    anchor, and no lag looks further back into a month than max(lags) rows. Both cuts are
    rank filters, applied before the shuffle.
    """
    head, tail = min(lags), max(lags)
    keys = [entity, MONTH_IDX]
    up = Window.partitionBy(*keys).orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in order])
    down = Window.partitionBy(*keys).orderBy(*[F.col(f"`{c}`").desc_nulls_first() for c in order])
    heads = df.withColumn("__pos", F.row_number().over(up)).where(F.col("__pos") <= head)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    tails = (
        df.withColumn("__rev", F.row_number().over(down)).where(F.col("__rev") <= tail)
        .join(counts, keys).withColumn("__pos", (F.col("__n") - F.col("__rev") + 1).cast("int"))
        .where(F.col("__pos") > head).select(*heads.columns)
    )
    return heads.unionByName(tails)


def _month_summaries(
    df: DataFrame, entity: str, columns: Sequence[str], lags: Sequence[int], order: Sequence[str],
) -> DataFrame:
    """Lags 1..K: the first row of each month, with lags read off monthly summaries.

    Lag k of a month's first row is the last row k months back, provided the months between
    hold one row each; with a second row in between, the lag does not reach that month.
    """
    def ranked(names: Sequence[str]) -> Column:
        return F.struct(*[x for c in names for x in (F.col(f"`{c}`").isNull().alias(f"__n_{c}"), F.col(f"`{c}`"))])

    months = df.groupBy(entity, MONTH_IDX).agg(
        F.count(F.lit(1)).alias("__rows"), F.min(ranked(order)).alias("__first"), F.max(ranked(order)).alias("__last"))
    w = Window.partitionBy(entity).orderBy(MONTH_IDX)
    lagged, reached = {}, F.lit(True)
    for k in range(1, max(lags) + 1):
        lagged[lag_name(MONTH_IDX, k)] = F.when(reached, F.lag(MONTH_IDX, k).over(w))
        for c in columns:
            lagged[lag_name(c, k)] = F.when(reached, F.lag(F.col("__last")[c], k).over(w))
        reached = reached & (F.lag("__rows", k).over(w) == 1)
    rows = months.withColumns(lagged)
    return rows.select(
        entity, MONTH_IDX, *[F.col("__first")[c].alias(c) for c in order], *[F.col(f"`{c}`") for c in lagged])


def row_history(
    df: DataFrame, entity: str, columns: Sequence[str], lags: Sequence[int], order: Sequence[str] = (),
) -> DataFrame:
    """Row-based lags over a panel that may hold several rows per month.

    Returns the rows that can be anchors, with lags; a month with two rows breaks the
    consecutiveness of the months after it.
    """
    rest = [c for c in df.columns if c not in (entity, MONTH_IDX) and c not in order]
    if sorted(lags) == list(range(1, len(lags) + 1)):
        return _month_summaries(df, entity, columns, lags, [*order, *rest])
    rows = _reachable_rows(df, entity, lags, [*order, *rest])
    w = Window.partitionBy(entity).orderBy(MONTH_IDX, "__pos")
    return rows.withColumns({
        lag_name(c, k): F.lag(c, k).over(w) for k in lags for c in [MONTH_IDX, *columns]}).drop("__pos")


def sequences(df: DataFrame, entity: str, features: Sequence[str], length: int, name: str = "steps") -> DataFrame:
    """Steps oldest first and how many of them exist. ``df`` has one row per period."""
    frame = Window.partitionBy(entity).orderBy(MONTH_IDX).rangeBetween(-(length - 1), 0)
    step = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    return df.withColumns({
        name: F.collect_list(step).over(frame), "__n_steps": F.count(F.lit(1)).over(frame)})


def periods_with(condition: Column, entity: str, length: int) -> Column:
    """How many of the last ``length`` periods exist and meet the condition."""
    frame = Window.partitionBy(entity).orderBy(MONTH_IDX).rangeBetween(-(length - 1), 0)
    return F.sum(F.coalesce(condition, F.lit(False)).cast("int")).over(frame)
