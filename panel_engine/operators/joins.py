"""Semi joins, N-way merges, key harmonisation and entity look-ups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panel_engine.operators.clean import require_columns, require_rows
from panel_engine.operators.ordered import null_safe_join
from panel_engine.operators.reduce import first_non_null
from panel_engine.sources.scratch import materialize

JOIN_TYPES = {"left", "right", "inner", "outer"}
_INTEGERS = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
#: Longs and decimals meet floating numbers in this type, in which both are exact as far as it reaches.
EXACT = T.DecimalType(38, 9)


def in_universe(df: DataFrame, ids: DataFrame, key: str = "id", ids_key: str = "id") -> DataFrame:
    """Rows whose entity is in the id table. Spark broadcasts the ids when they are small."""
    return df.join(ids.select(F.col(ids_key).alias(key)), key, "left_semi")


def harmonize_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Cast each key to one type on both sides: string if either is, else a number that holds both.

    Integers take the wider one, smaller integers and floating numbers double. A long or a decimal is
    compared with a floating number as a decimal, as neighbouring longs beyond 2**53 are one double;
    what does not fit that decimal matches nothing.
    """
    require_columns(left, keys, "left side")
    require_columns(right, keys, "right side")
    casts: dict[str, T.DataType] = {}
    for k in keys:
        lt, rt = left.schema[k].dataType, right.schema[k].dataType
        if isinstance(lt, T.StringType) or isinstance(rt, T.StringType):
            casts[k] = T.StringType()
        elif lt == rt:
            casts[k] = lt
        elif isinstance(lt, T.NumericType) and isinstance(rt, T.NumericType):
            casts[k] = common_number(lt, rt)
        else:
            raise TypeError(f"incompatible types for key {k!r}: {lt} and {rt}")

    def apply(df: DataFrame) -> DataFrame:
        return df.withColumns({k: F.col(k).try_cast(t) for k, t in casts.items() if df.schema[k].dataType != t})

    return apply(left), apply(right)


def common_number(a: T.DataType, b: T.DataType) -> T.DataType:
    """Narrowest numeric type in which values of both compare exactly."""
    sides = (a, b)
    floating = [t for t in sides if isinstance(t, (T.FloatType, T.DoubleType))]
    decimals = [t for t in sides if isinstance(t, T.DecimalType)]
    if floating and (decimals or any(isinstance(t, T.LongType) for t in sides)):
        return EXACT
    if floating:
        return T.DoubleType()
    if decimals:
        scale = max(t.scale for t in decimals)
        whole = max(t.precision - t.scale if isinstance(t, T.DecimalType) else 19 for t in sides)
        return T.DecimalType(min(38, whole + scale), scale)
    return _INTEGERS[max(i for t in sides for i, kind in enumerate(_INTEGERS) if isinstance(t, kind))]()


def split_clashes(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    clash = [c for c in left.columns if c in right.columns and c not in keys]
    taken = {f"{c}{s}" for c in clash for s in ("_x", "_y")} & {*left.columns, *right.columns}
    if taken:
        raise ValueError(f"suffixed columns already exist: {sorted(taken)}")
    return (left.withColumnsRenamed({c: f"{c}_x" for c in clash}),
            right.withColumnsRenamed({c: f"{c}_y" for c in clash}))


def merge(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_safe: bool = False,
) -> DataFrame:
    """Equi-join with harmonised keys; clashing columns get ``_x`` / ``_y``.

    An outer join is a left join plus the right rows that meet no left key. A full outer
    sort-merge join cannot be split when one key is hot, the left join can.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"join type must be one of {sorted(JOIN_TYPES)}, not {how!r}")
    keys = list(keys)
    left, right = harmonize_keys(left, right, keys)
    left, right = split_clashes(left, right, keys)

    def join(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
        return null_safe_join(a, b, keys, kind) if null_safe else a.join(b, keys, kind)

    if how == "right":
        swapped = join(right, left, "left")
        return swapped.select(*keys, *[c for c in left.columns if c not in keys],
                              *[c for c in right.columns if c not in keys])
    out = join(left, right, "left" if how == "outer" else how)
    if how == "outer":
        unmatched = join(right, left.select(*keys).distinct(), "left_anti")
        out = out.unionByName(unmatched, allowMissingColumns=True)
    return out


@dataclass
class Join:
    """One input of a multi-source merge."""

    table: DataFrame
    keys: list[str]
    how: str
    name: str = field(default="join")


def merge_all(
    base: DataFrame, joins: Sequence[Join], drop_columns: Sequence[str] = (), dedupe: bool = True,
    null_safe: bool = False, fail_if_empty: bool = False, store: bool = False,
) -> DataFrame:
    """Fold the joins in order, drop technical columns, remove duplicate rows.

    An outer join reads its left side twice; ``store`` writes that side first, so a chain of
    outer joins does not repeat the joins before it.
    """
    out = base
    for j in joins:
        if store and j.how == "outer":
            out = materialize(out, "merge")
        out = merge(out, j.table, j.keys, j.how, null_safe)
        if fail_if_empty:
            require_rows(out, f"join {j.name!r} is empty: check its keys and type")
    out = out.drop(*drop_columns)
    return out.dropDuplicates() if dedupe else out


def reduce_join(tables: Sequence[DataFrame], keys: Sequence[str], how: str) -> DataFrame:
    """Join a list of tables on one key set."""
    return reduce(lambda a, b: merge(a, b, keys, how), tables)


def fill_from_entity(df: DataFrame, entity: str, column: str, order: Sequence[str] = ()) -> DataFrame:
    """Fill nulls with the entity's first non-null value.

    Only the rows that lack a value meet the look-up; the rest never shuffle. ``df`` is read
    three times under complementary filters: pass a stored table.
    """
    lookup = (
        first_non_null(df.where(F.col(column).isNotNull()), [entity], [column], order)
        .withColumnRenamed(column, "__fill")
    )
    have = df.where(F.col(column).isNotNull())
    lack = df.where(F.col(column).isNull()).join(lookup, entity, "left")
    lack = lack.withColumn(column, F.col("__fill")).select(*df.columns)
    return have.unionByName(lack)


def replace_from_lookup(df: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """Attach the looked-up value under ``column`` (null when the key is unknown)."""
    return df.drop(column).join(lookup.select(key, column), key, "left")


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Raise when a key occurs twice; counts per key combine map-side."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"keys {list(keys)} are not unique in {what}")
    return df


def attach_one_to_one(keys_df: DataFrame, rows: DataFrame, keys: Sequence[str], validate: bool = True) -> DataFrame:
    """Left join of unique keys to rows that are unique on them."""
    if validate:
        assert_unique(keys_df, keys, "left side")
        assert_unique(rows, keys, "right side")
    return keys_df.join(rows, list(keys), "left")


def intersect_keys(candidates: DataFrame, sets: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Distinct candidate keys present in every set."""
    out = candidates.select(*keys).distinct()
    for s in sets:
        out = out.join(s.select(*keys), list(keys), "left_semi")
    return out
