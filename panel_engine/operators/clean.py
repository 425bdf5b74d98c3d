"""Row filters, fills and robust outlier removal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panel_engine.functions.scalars import safe_double
from panel_engine.operators.narrowing import total_quantiles


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "input") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns in {what}: {missing}")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise when the frame is empty; stops at the first row found."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def ensure_columns(df: DataFrame, defaults: Mapping[str, tuple[object, str]]) -> DataFrame:
    """Create absent columns as (default, type)."""
    absent = {c: F.lit(v).cast(t) for c, (v, t) in defaults.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def year_after(df: DataFrame, year: str, bound: int | None) -> DataFrame:
    return df if bound is None else df.where(F.col(year) > bound)


def fill_from(df: DataFrame, column: str, fallback: str) -> DataFrame:
    """Fill nulls from a second column, if the frame has it."""
    if fallback not in df.columns:
        return df
    return df.withColumn(column, F.coalesce(safe_double(column), safe_double(fallback)))


def keep_positive(df: DataFrame, column: str) -> DataFrame:
    """Non-null, non-NaN and above zero (Spark ranks NaN above every number)."""
    return df.where(safe_double(column) > 0)


def keep_allowed(df: DataFrame, column: str, allowed: Sequence[object]) -> DataFrame:
    return df.where(F.col(column).isin(list(allowed)))


def complete(columns: Sequence[str]) -> Column:
    """All columns non-null."""
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns], F.lit(True))


def drop_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(complete(columns))


def ordered_projection(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wanted columns in order, once each, skipping the absent ones."""
    return df.select([F.col(f"`{c}`") for c in dict.fromkeys(columns) if c in df.columns])


def iqr_fences(df: DataFrame, column: str, k: float = 1.5) -> tuple[float, float] | None:
    """The two fences as numbers, none without values. ``df`` is read a few times, one column of it."""
    n, (q1, q3) = total_quantiles(df, safe_double(column), [0.25, 0.75])
    return (q1 - (q3 - q1) * k, q3 + (q3 - q1) * k) if n else None


def iqr_filter(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Tukey filter. The fences are numbers, so the filter reaches the scan."""
    fences = iqr_fences(df, column, k)
    if fences is None:
        return df.where(F.lit(False))
    return df.where(F.col(column).between(*fences))


def quality_cascade(df: DataFrame, steps: Sequence[tuple[str, bool]], k: float = 1.5) -> DataFrame:
    """(column, must be positive) in order; each fence is taken over the survivors.

    Earlier fences are plain literals, so step n scans ``df`` under n range predicates and
    the plan never nests. Pass a stored table, not an expensive plan.
    """
    for column, positive in steps:
        if positive:
            df = keep_positive(df, column)
        df = iqr_filter(df, column, k)
    return df
