"""How imputation changed the data: missingness, correlation shift, distribution shift.

Reports by stratum come from cubes: rows are counted once per combination of all strata, and the small tables of
counts, moments and distinct values are rolled up to each stratum's levels and the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panel_engine.functions.scalars import safe_double
from panel_engine.operators.narrowing import interpolate
from panel_engine.operators.ordered import cumulative
from panel_engine.sources.scratch import materialize

#: Counted values that one range holds, about.
RANGE = 1 << 18
ALL = "__all__"
GROUP = ["stratum", "level"]


def pair_correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson of two columns that are null together; null when either is constant.

    The built-in ``corr`` divides by zero under ANSI mode on a constant column.
    """
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def marks(strata: Sequence[str]) -> Column:
    """What a row counts for: (number of the stratum, level), the whole table first; a null level reads "NA"."""
    every = F.struct(F.lit(0).alias("mark"), F.lit(ALL).alias("level"))
    return F.array(every, *[
        F.struct(F.lit(i).alias("mark"), F.coalesce(F.col(s).cast("string"), F.lit("NA")).alias("level")) for i, s in enumerate(strata, 1)])


def rolled_up(cube: DataFrame, strata: Sequence[str], *columns: str) -> DataFrame:
    """Each row of a cube once per mark: ``mark``, ``level`` and ``columns``."""
    return cube.select(F.explode(marks(strata)).alias("__g"), *columns).select("__g.mark", "__g.level", *columns)


def named(df: DataFrame, strata: Sequence[str], *columns: Column | str) -> DataFrame:
    """``stratum`` and ``level`` in place of the mark."""
    return df.select(F.get(F.array(*map(F.lit, [ALL, *strata])), F.col("mark")).alias("stratum"), "level", *columns)


def feature_name(columns: Sequence[str]) -> Column:
    return F.get(F.array(*map(F.lit, columns)), F.col("feature")).alias("feature")


def correlation_pairs(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Long form (groups, feature_a, feature_b, corr), all pairs from one aggregation.

    One narrow row per pair keeps the aggregate at three buffers; a column per pair would
    need three per pair and outgrow the code generator.
    """
    pairs = list(combinations(columns, 2))
    cells = df.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(i).alias("p"), F.when(F.col(b).isNotNull(), F.col(a)).alias("a"),
                 F.when(F.col(a).isNotNull(), F.col(b)).alias("b"))
        for i, (a, b) in enumerate(pairs)])).alias("c")).select(*groups, "c.*")
    names = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b")) for a, b in pairs])
    return (
        cells.groupBy(*groups, "p").agg(pair_correlation("a", "b").alias("corr"))
        .select(*groups, names[F.col("p")].alias("n"), "corr").select(*groups, "n.*", "corr")
    )


def correlation_shift(pre: DataFrame, post: DataFrame, columns: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """(groups, feature_a, feature_b, delta): absolute change of each pair's correlation."""
    a = correlation_pairs(pre, columns, groups).withColumnRenamed("corr", "__pre")
    b = correlation_pairs(post, columns, groups).withColumnRenamed("corr", "__post")
    return a.join(b, [*groups, "feature_a", "feature_b"]).select(
        *groups, "feature_a", "feature_b", F.abs(F.col("__post") - F.col("__pre")).alias("delta"))


def stratified_correlations(df: DataFrame, columns: Sequence[str], strata: Sequence[str]) -> DataFrame:
    """(stratum, level, feature_a, feature_b, corr) of each stratum's levels and the whole table.

    Counts, means and centred sums of the pairs are taken once per combination of strata and merged; between
    combinations, deviations are from the pair's overall mean, so that large means cancel nothing.
    """
    pairs = list(combinations(columns, 2))
    cells = df.select(*strata, F.explode(F.array(*[
        F.struct(F.lit(i).alias("p"), F.col(a).alias("a"), F.col(b).alias("b")) for i, (a, b) in enumerate(pairs)])).alias("c")).select(*strata, "c.*")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    ends = [(f, side, f"{name}{side}") for f, name in ((F.min, "l"), (F.max, "h")) for side in "ab"]  # a constant has no correlation
    cube = materialize(cells.groupBy(*strata, "p").agg(
        *[f(F.when(both, F.col(side))).alias(name) for f, side, name in ends], F.regr_count("a", "b").alias("n"), F.regr_avgy("a", "b").alias("ma"), F.regr_avgx("a", "b").alias("mb"),
        F.regr_syy("a", "b").alias("saa"), F.regr_sxx("a", "b").alias("sbb"), F.regr_sxy("a", "b").alias("sab")), "moments")
    middle = cube.groupBy("p").agg(*[F.try_divide(F.sum(F.col("n") * F.col(m)), F.sum("n")).alias(f"g{m}") for m in ("ma", "mb")])
    centred = cube.where("n > 0").join(middle, "p").select(
        *strata, "p", "n", "saa", "sbb", "sab", *[name for _, _, name in ends], (F.col("ma") - F.col("gma")).alias("a"), (F.col("mb") - F.col("gmb")).alias("b"))
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    sums = rolled_up(centred, strata, *[c for c in centred.columns if c not in strata]).groupBy("mark", "level", "p").agg(
        *[f(name).alias(name) for f, _, name in ends], F.sum("n").alias("n"), F.sum(n * a).alias("a"), F.sum(n * b).alias("b"), F.sum(F.col("saa") + n * a * a).alias("saa"),
        F.sum(F.col("sbb") + n * b * b).alias("sbb"), F.sum(F.col("sab") + n * a * b).alias("sab"))
    saa, sbb, sab = F.col("saa") - a * a / n, F.col("sbb") - b * b / n, F.col("sab") - a * b / n

    varies = (F.col("la") < F.col("ha")) & (F.col("lb") < F.col("hb"))
    corr = F.when(varies, F.try_divide(sab, F.sqrt(saa * sbb)))
    levels = rolled_up(cube, strata, "p").distinct()  # pairs that are never complete together have no correlation
    names = F.array(*[F.struct(F.lit(x).alias("feature_a"), F.lit(y).alias("feature_b")) for x, y in pairs])
    out = levels.join(sums.select("mark", "level", "p", corr.alias("corr")), ["mark", "level", "p"], "left")
    return named(out, strata, names[F.col("p")].alias("n"), "corr").select(*GROUP, "n.*", "corr")


def stratified_shift(pre: DataFrame, post: DataFrame, columns: Sequence[str], strata: Sequence[str]) -> DataFrame:
    """(stratum, level, feature_a, feature_b, delta): absolute change of each pair's correlation."""
    a = stratified_correlations(pre, columns, strata).withColumnRenamed("corr", "__pre")
    b = stratified_correlations(post, columns, strata).withColumnRenamed("corr", "__post")
    keys = [*GROUP, "feature_a", "feature_b"]
    return a.join(b, keys).select(*keys, F.abs(F.col("__post") - F.col("__pre")).alias("delta"))


def shift_by_feature(shift: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean change over the pairs a feature takes part in."""
    ends = shift.select(*groups, "delta", F.explode(F.array("feature_a", "feature_b")).alias("feature"))
    return ends.groupBy(*groups, "feature").agg(F.avg("delta").alias("mean_abs_delta_corr"))


def to_cells(df: DataFrame, columns: Sequence[str], groups: Sequence[str]) -> DataFrame:
    return df.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])).alias("c")).select(
        *groups, "c.*")


def wasserstein(pre: DataFrame, post: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    """Per group: exact 1-D ``distance`` and ``normalized_wasserstein``, its share of the IQR.

    The distance is the integral of the gap between the two step functions. The quartiles of
    ``pre`` come from the same running counts, so one pass serves both. Without spread the
    share is 0 for equal samples, else null.
    """
    groups = list(groups)
    both = (
        pre.select(*groups, value, F.lit(1).alias("__x"), F.lit(0).alias("__y"))
        .unionByName(post.select(*groups, value, F.lit(0).alias("__x"), F.lit(1).alias("__y")))
        .where(F.col(value).isNotNull())
    )
    hist = both.groupBy(*groups, value).agg(F.sum("__x").alias("x"), F.sum("__y").alias("y"))
    cdf = cumulative(hist, value, ["x", "y"], groups)
    gap = F.abs(F.try_divide(F.col("upto_x"), F.col("all_x")) - F.try_divide(F.col("upto_y"), F.col("all_y")))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto_x") > rank, F.col(value)))

    q1, q3 = ((F.col("all_x") - 1) * F.lit(p) for p in (0.25, 0.75))
    sums = cdf.groupBy(*groups).agg(
        F.max("all_x").alias("all_x"), F.max("all_y").alias("all_y"),
        F.coalesce(F.sum(gap * (F.col("next_value") - F.col(value))), F.lit(0.0)).alias("__d"),
        at(F.floor(q1)).alias("__l1"), at(F.ceil(q1)).alias("__h1"), at(F.floor(q3)).alias("__l3"), at(F.ceil(q3)).alias("__h3"))
    iqr = interpolate(F.col("__l3"), F.col("__h3"), q3) - interpolate(F.col("__l1"), F.col("__h1"), q1)
    distance = F.when((F.col("all_x") > 0) & (F.col("all_y") > 0), F.col("__d"))
    return sums.select(*groups, distance.alias("distance"), iqr.alias("__iqr")).select(
        *groups, "distance",
        F.when(F.col("__iqr") > 0, F.col("distance") / F.col("__iqr"))
        .when(F.col("distance") == 0, 0.0).alias("normalized_wasserstein"))


def stratified_wasserstein(pre: DataFrame, post: DataFrame, columns: Sequence[str], strata: Sequence[str]) -> DataFrame:
    """(stratum, level, feature, normalized_wasserstein) of each stratum's levels and the whole table.

    Both sides' cells are counted once per (strata, feature, value), and these counts dealt by ranges of (feature,
    value). A range carries the running counts of every level on from the ranges before it, so one order of the values
    serves all strata; a row meets its levels only where it lies.
    """
    def cells(df: DataFrame, x: int) -> DataFrame:
        return df.select(*strata, F.posexplode(F.array(*columns)).alias("feature", "value")).where("value is not null").withColumns(
            {"x": F.lit(x), "y": F.lit(1 - x)})

    cube = cells(pre, 1).unionByName(cells(post, 0)).groupBy(*strata, "feature", "value").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    cube = materialize(cube, "values")
    parts = 1 + cube.count() // RANGE  # a range, and so a task's sort, does not grow with the table
    dealt = materialize(cube.repartitionByRange(parts, "feature", "value").withColumn("__p", F.spark_partition_id()), "ranges")
    keys = ["mark", "level", "feature"]
    ranges = dealt.groupBy(*strata, "feature", "__p").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.min("value").alias("least"))
    ranges = rolled_up(ranges, strata, "feature", "__p", "x", "y", "least").groupBy(*keys, "__p").agg(
        F.sum("x").alias("tx"), F.sum("y").alias("ty"), F.min("least").alias("least"))
    by_range = Window.partitionBy(*keys).orderBy("__p")
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    every = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = materialize(ranges.select(
        *keys, "__p", F.lead("least").over(by_range).alias("following"),
        *[F.coalesce(F.sum(f"t{s}").over(before), F.lit(0)).alias(f"off_{s}") for s in "xy"],
        *[F.sum(f"t{s}").over(every).alias(f"all_{s}") for s in "xy"]), "offsets")
    # by range, then by level within it: the second needs no shuffle
    rows = rolled_up(dealt.repartitionByRange(parts, "__p"), strata, "feature", "value", "x", "y", "__p")
    by_value = Window.partitionBy("__p", *keys).orderBy("value")
    upto = by_value.rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select(*keys, "__p", "value", F.lead("value").over(by_value).alias("next"), *[F.sum(s).over(upto).alias(f"in_{s}") for s in "xy"])
    run = run.join(offsets, [*keys, "__p"])
    upto_x, upto_y = (F.col(f"off_{s}") + F.col(f"in_{s}") for s in "xy")
    gap = F.abs(F.try_divide(upto_x, F.col("all_x")) - F.try_divide(upto_y, F.col("all_y")))
    width = F.coalesce("next", "following") - F.col("value")  # values that tie lie next to each other, without width

    def at(rank: Column) -> Column:
        return F.min(F.when(upto_x > rank, F.col("value")))

    q1, q3 = ((F.col("all_x") - 1) * F.lit(p) for p in (0.25, 0.75))
    sums = run.groupBy(*keys).agg(
        F.max("all_x").alias("all_x"), F.max("all_y").alias("all_y"), F.coalesce(F.sum(gap * width), F.lit(0.0)).alias("__d"),
        at(F.floor(q1)).alias("__l1"), at(F.ceil(q1)).alias("__h1"), at(F.floor(q3)).alias("__l3"), at(F.ceil(q3)).alias("__h3"))
    iqr = interpolate(F.col("__l3"), F.col("__h3"), q3) - interpolate(F.col("__l1"), F.col("__h1"), q1)
    distance = F.when((F.col("all_x") > 0) & (F.col("all_y") > 0), F.col("__d"))
    share = F.when(iqr > 0, distance / iqr).when(distance == 0, 0.0)
    return named(sums, strata, feature_name(columns), share.alias("normalized_wasserstein"))


def missing_and_imputed(pre: DataFrame, post: DataFrame, columns: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """(groups, feature, n_rows, pct_missing_pre, pct_imputed)."""
    def nulls(df: DataFrame, side: str) -> DataFrame:
        wide = df.groupBy(*groups).agg(
            F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        return wide.select(*groups, "n_rows", F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).alias(side)) for c in columns])).alias("c")).select(
            *groups, "n_rows", "c.*")

    both = nulls(pre, "__pre").join(nulls(post, "__post").drop("n_rows"), [*groups, "feature"])
    share = F.lit(100.0) / F.col("n_rows")
    return both.select(
        *groups, "feature", "n_rows", (F.col("__pre") * share).alias("pct_missing_pre"),
        ((F.col("__pre") - F.col("__post")) * share).alias("pct_imputed"))


def stratified_missing(pre: DataFrame, post: DataFrame, columns: Sequence[str], strata: Sequence[str]) -> DataFrame:
    """(stratum, level, feature, n_rows, pct_missing_pre, pct_imputed) of each stratum's levels and the whole table."""
    def nulls(df: DataFrame, side: str) -> DataFrame:
        cube = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"__{i}") for i, c in enumerate(columns)])
        names = [f"__{i}" for i in range(len(columns))]
        wide = rolled_up(cube, strata, "n_rows", *names).groupBy("mark", "level").agg(*[F.sum(c).alias(c) for c in ("n_rows", *names)])
        return wide.select("mark", "level", "n_rows", F.posexplode(F.array(*names)).alias("feature", side))

    both = nulls(pre, "__pre").join(nulls(post, "__post").drop("n_rows"), ["mark", "level", "feature"])
    share = F.lit(100.0) / F.col("n_rows")
    return named(both, strata, feature_name(columns), "n_rows", (F.col("__pre") * share).alias("pct_missing_pre"),
                 ((F.col("__pre") - F.col("__post")) * share).alias("pct_imputed"))


def report(pre: DataFrame, post: DataFrame, columns: Sequence[str], strata: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The feature report and the level report, from one count of pairs and one order of values."""
    pre, post = as_doubles(pre, columns, strata), as_doubles(post, columns, strata)
    shift, nwd = stratified_shift(pre, post, columns, strata), stratified_wasserstein(pre, post, columns, strata)
    return _by_feature(pre, post, columns, strata, shift, nwd), _by_level(post, strata, shift, nwd)


def feature_report(pre: DataFrame, post: DataFrame, columns: Sequence[str], strata: Sequence[str]) -> DataFrame:
    """Per (stratum, level, feature); the whole table is stratum and level ``__all__``."""
    return report(pre, post, columns, strata)[0]


def level_report(pre: DataFrame, post: DataFrame, columns: Sequence[str], strata: Sequence[str]) -> DataFrame:
    """Per (stratum, level): mean correlation change over all pairs, mean normalised distance."""
    return report(pre, post, columns, strata)[1]


def _by_feature(pre: DataFrame, post: DataFrame, columns: Sequence[str], strata: Sequence[str], shift: DataFrame, nwd: DataFrame) -> DataFrame:
    keys = [*GROUP, "feature"]
    return (
        stratified_missing(pre, post, columns, strata).join(shift_by_feature(shift, GROUP), keys, "left").join(nwd, keys, "left")
        .select(*keys, "n_rows", F.round("pct_missing_pre", 2).alias("pct_missing_pre"),
                F.round("pct_imputed", 2).alias("pct_imputed"),
                F.round("mean_abs_delta_corr", 4).alias("mean_abs_delta_corr"),
                F.round("normalized_wasserstein", 4).alias("normalized_wasserstein"))
    )


def _by_level(post: DataFrame, strata: Sequence[str], shift: DataFrame, nwd: DataFrame) -> DataFrame:
    shift = shift.groupBy(*GROUP).agg(F.avg("delta").alias("__dc"))
    nwd = nwd.groupBy(*GROUP).agg(F.avg("normalized_wasserstein").alias("__nwd"))
    counts = post.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_rows"))
    rows = named(rolled_up(counts, strata, "n_rows").groupBy("mark", "level").agg(F.sum("n_rows").alias("n_rows")), strata, "n_rows")
    return rows.join(shift, GROUP, "left").join(nwd, GROUP, "left").select(
        *GROUP, "n_rows", F.round("__dc", 4).alias("mean_abs_delta_corr"), F.round("__nwd", 4).alias("mean_nwd"))


def as_doubles(df: DataFrame, columns: Sequence[str], strata: Sequence[str]) -> DataFrame:
    return df.select(*strata, *[safe_double(c).alias(c) for c in columns])


def report_order(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Strata in name order, worst level first."""
    return df.orderBy("stratum", *[F.desc_nulls_last(m) for m in metrics])
