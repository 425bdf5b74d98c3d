"""Equi-joins whose hot keys are found beforehand by a frequent-items sketch.

Adaptive execution splits a hot partition after it has been written, and not for every plan. Here the
hot keys of a side are known before anything is shuffled: a sketch of bounded size names every key with
more than a small share of the rows. The rows of such a key are dealt to several salts, and the
other side's rows of that key are repeated once for each salt. Every pair of rows meets in exactly one place, so results are
those of the plain join. All other keys have one salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panel_engine.operators.joins import harmonize_keys, split_clashes
from panel_engine.sources.scratch import materialize

#: Keys that a sketch follows: one with more than about 1/1000 of the rows is found for certain.
TRACKED = 1 << 13
#: Hot keys named, at most: more could not each hold that share.
NAMED = 1 << 10


def key_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    """64-bit hash of the keys; equal keys, -0.0 and 0.0 among them, hash alike, and null is a key."""
    def plain(k: str) -> Column:
        return F.col(k) + F.lit(0).cast(df.schema[k].dataType) if isinstance(df.schema[k].dataType, (T.FloatType, T.DoubleType)) else F.col(k)

    return F.xxhash64(*[F.struct(plain(k), F.col(k).isNull()) for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str], block: int, tracked: int = TRACKED, named: int = NAMED) -> DataFrame:
    """``h`` (key hash) and ``salts`` of the keys with more than ``block`` rows: at most ``named`` rows.

    The sketch combines before the shuffle and is bounded by ``tracked``. Its counts are estimates, which only
    decide how finely a key is split, never which rows meet.
    """
    top = df.select(key_hash(df, keys).alias("h")).agg(F.expr(f"approx_top_k(h, {named}, {tracked})").alias("t"))
    found = top.select(F.explode("t").alias("t")).select(F.col("t.item").alias("h"), F.col("t.count").alias("n"))
    return found.where(F.col("n") > block).select("h", F.ceil(F.col("n") / block).cast("int").alias("salts"))


def salted_merge(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = False, blocks: int | None = None,
    store: bool = True, tracked: int = TRACKED, named: int = NAMED,
) -> DataFrame:
    """``joins.merge`` for ``inner``, ``left`` and ``right``, with hot keys split before the shuffle.

    Keys are harmonised and clashing columns get ``_x`` / ``_y``, as there. A key is split into blocks of
    rows / ``blocks`` (four blocks for each shuffle partition). In an inner join hot keys of either side are split, in a left or
    right join those of the side whose rows are all kept; null keys of that side are split like any other.
    Sides are read twice, once for the sketch, and rows are dealt to salts by their place in the table, so
    that a retried task deals alike: ``store`` writes both first; switch it off for tables that are stored already.
    """
    if how not in {"inner", "left", "right"}:
        raise ValueError(f"join type must be inner, left or right, not {how!r}")
    keys = list(keys)
    left, right = split_clashes(*harmonize_keys(left, right, keys), keys)
    columns = [*keys, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys]]
    if how == "right":
        left, right = right, left
    if store:
        left, right = materialize(left, "left"), materialize(right, "right")
    spark = left.sparkSession
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def salts(df: DataFrame, name: str) -> DataFrame:
        hot = hot_keys(df, keys, max(1, -(-df.count() // blocks)), tracked, named)
        return spark.createDataFrame([tuple(r) for r in hot.collect()], f"h long, {name} int")  # at most ``named`` rows

    none = spark.createDataFrame([], "h long, sr int")
    by_left, by_right = salts(left, "sl"), salts(right, "sr") if how == "inner" else none

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Rows with a place on their own side's salts, repeated over the other side's."""
        out = df.withColumn("__h", key_hash(df, keys))
        for hot in (by_left, by_right):
            hot = F.broadcast(hot.withColumnRenamed("h", "__h"))
            out = out.join(hot, "__h", "left")
        # hashed, as a key's places may follow a pattern
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(own, F.lit(1))).cast("int")
        return out.withColumn(f"__{own}", place).withColumn(
            f"__{other}", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("__h", "sl", "sr")

    a, b = dealt(left, "sl", "sr"), dealt(right, "sr", "sl")
    if null_safe:
        b = b.withColumnsRenamed({c: f"__right_{c}" for c in [*keys, "__sl", "__sr"]})
        on = (F.col("__sl") == F.col("__right___sl")) & (F.col("__sr") == F.col("__right___sr"))
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
        out = a.join(b, on, "left" if how != "inner" else "inner")
    else:
        out = a.join(b, [*keys, "__sl", "__sr"], "left" if how != "inner" else "inner")
    return out.select(*columns)
