"""Column expressions. Everything stays inside whole-stage codegen; no Python functions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from panel_engine.config import SEASON_MONTHS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- tolerant casts -----------------------------------------------------------------

def safe_double(c: Column | str) -> Column:
    """Numeric cast that yields null for anything unparsable, NaN included."""
    return F.nanvl(_col(c).try_cast("double"), F.lit(None).cast("double"))


def binary_flag(c: Column | str) -> Column:
    """Integer flag; null and unparsable become 0."""
    return F.coalesce(safe_double(c).cast("int"), F.lit(0))


def safe_date(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """Date from its parts, null when the parts name no day (30 February).

    ``make_date`` raises under ANSI mode, the ``try_`` timestamp constructor does not.
    """
    y, m, d = (_col(p).cast("int") for p in (year, month, day))
    zero = F.lit(0)
    return F.to_date(F.try_make_timestamp(y, m, d, zero, zero, zero.cast("decimal(16,6)")))


def parse_date(c: Column | str, formats: Sequence[str]) -> Column:
    """First format that parses wins; null when none does."""
    c = _col(c)
    return F.to_date(F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]))


def as_date(c: Column | str, dtype: str, formats: Sequence[str] = ("yyyy-MM-dd",)) -> Column:
    """Coerce a column of any type to date: strings are parsed, the rest is cast."""
    return parse_date(c, formats) if dtype == "string" else _col(c).try_cast("date")


# ---- calendar -----------------------------------------------------------------------

def month_index(year: Column | str = "year", month: Column | str = "month") -> Column:
    return _col(year).cast("int") * 12 + _col(month).cast("int")


def year_month_key(year: Column | str, month: Column | str) -> Column:
    return F.format_string("%d-%02d", _col(year).cast("int"), _col(month).cast("int"))


def season(month: Column | str = "month") -> Column:
    m = _col(month).cast("int")
    return reduce(
        lambda acc, kv: acc.when(m.isin(kv[1]), kv[0]),
        list(SEASON_MONTHS.items())[1:],
        F.when(m.isin(SEASON_MONTHS["winter"]), "winter"),
    )


def month_angle(month: Column | str = "month") -> Column:
    return (_col(month).cast("double") - 1.0) * (2.0 * math.pi / 12.0)


def months_since(year: Column | str, month: Column | str, last: Column | str) -> Column:
    """Calendar months from the event to the record; null when the event lies ahead."""
    gap = month_index(year, month) - month_index(F.year(_col(last)), F.month(_col(last)))
    return F.when(gap >= 0, gap)


def lactation_phase(months: Column | str) -> Column:
    m = _col(months)
    return (
        F.when(m == 0, "peripartum")
        .when(m == 1, "early_lactation")
        .when(m.isin(2, 3), "peak")
        .when(m.isin(4, 5, 6), "mid_lactation")
        .when(m >= 7, "late_lactation")
    )


def age_years(reference: Column | str, birth: Column | str) -> Column:
    return F.floor(F.datediff(_col(reference), _col(birth)) / F.lit(365.25).cast("double")).cast("int")


def reference_date(candidates: Sequence[Column | str]) -> Column:
    return F.coalesce(*[_col(c) for c in candidates])


# ---- categories ---------------------------------------------------------------------

def bin_right_closed(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(edge[i], edge[i+1]]`` holding the value, else null."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need exactly one more edge than labels")
    v = safe_double(c)
    out = None
    for low, high, label in zip(edges, edges[1:], labels):
        hit = (v > low) & (v <= high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def map_codes(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Literal dictionary lookup; an unmapped code is null."""
    entries = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*entries)[_col(c).cast("string")]


def clip_where(c: Column | str, where: Column, low: float, high: float) -> Column:
    c = _col(c)
    return F.when(where, F.greatest(F.lit(low), F.least(F.lit(high), c))).otherwise(c)


# ---- lists and consensus labels -----------------------------------------------------

def split_list(c: Column | str) -> Column:
    """Comma list to trimmed, non-empty items; null becomes an empty array."""
    items = F.transform(F.split(_col(c), ","), lambda x: F.trim(x))
    return F.coalesce(F.filter(items, lambda x: x != ""), F.array().cast("array<string>"))


def count_in_pool(items: Column | str, pool: Column | str, first_k: int) -> Column:
    """How many of the first k items are in the pool; repeats count."""
    pool = _col(pool)
    return F.size(F.filter(F.slice(_col(items), 1, first_k), lambda x: F.array_contains(pool, x)))


def dead_zone_sign(c: Column | str, threshold: float) -> Column:
    c = _col(c)
    return F.when(c.isNull() | (F.abs(c) <= threshold), "zero").when(c > 0, "pos").otherwise("neg")


def consensus_label(
    rank_a: Column, rank_b: Column, n_interactions: Column, sign: Column,
    core_k: int, support_k: int, min_interactions: int,
) -> Column:
    """Struct (label, reason): first rule that holds."""
    def verdict(label: str, reason: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"))

    return (
        F.when((rank_a <= core_k) & (rank_b <= core_k), verdict("core", "two_view_rank_agreement"))
        .when((rank_a <= support_k) | (rank_b <= support_k), verdict("supportive", "single_view_rank"))
        .when(n_interactions >= min_interactions, verdict("supportive", "interaction_support"))
        .when(((rank_a <= core_k) | (rank_b <= core_k)) & (sign != "zero"),
              verdict("supportive", "monotonic_direction_support"))
        .otherwise(verdict("peripheral", "weak_support"))
    )
