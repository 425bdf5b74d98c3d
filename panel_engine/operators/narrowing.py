"""Exact order statistics by narrowing: no sort of a group, no sort of the table, one path at every size.

A group is counted with its least and greatest value. While the interval that holds a wanted rank has more than
``LIMIT`` values, its values are counted into buckets of equal width, and the bucket with the rank, cut to the values
it really has, becomes the interval. Intervals of ``LIMIT`` values or fewer are gathered and sorted in one row. A
small group is its own first interval, so it is gathered at once; a narrow set of values ends when least and greatest
meet. Every round reads the rows once and shuffles counts only, as counts combine before the shuffle; each splits off
at least one value of an interval, and evenly spread values shrink it a thousandfold.

Key sets that contain each other are walked from the coarsest on: a group of few rows is gathered once, with all finer
groups in it; only rows of larger groups are looked at by the next finer set.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panel_engine.sources.scratch import materialize

#: Values of one group or interval that one row may hold, and buckets an interval is split into at most.
LIMIT, BUCKETS = 1 << 13, 1024
#: Rows of a group that are gathered with all finer groups in it.
PACK = 1 << 10


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key meets a null key; the right key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        hit = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = hit if cond is None else cond & hit
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def interpolate(low: Column, high: Column, position: Column) -> Column:
    part = position - F.floor(position)
    return F.when(low == high, low).otherwise(low * (1.0 - part) + high * part)


def chains(levels: Sequence[Sequence[str]]) -> list[list[int]]:
    """Indices of key sets, dealt so that each contains the next one of its chain; larger sets first."""
    found: list[list[int]] = []
    for i in sorted(range(len(levels)), key=lambda i: (-len(levels[i]), i)):
        # of the chains it fits, the one with the fewest keys so far has the fewest groups
        fitting = [c for c in found if set(levels[i]) < set(levels[c[-1]])]
        (min(fitting, key=lambda c: (len(levels[c[-1]]), -c[0])) if fitting else found.append([]) or found[-1]).append(i)
    return found


def level_quantiles(
    df: DataFrame, measures: Sequence[str], probs: Sequence[float], levels: Sequence[Sequence[str]], limit: int | None = None,
    null_keys: bool = True,
) -> DataFrame:
    """``level`` (index of a key set), the keys of all sets (null where a set lacks them), ``feature`` (index into
    ``measures``), ``n``, ``q_0`` .. ``q_{k-1}``.

    ``measures`` are doubles without NaN, nulls are left out; quantiles interpolate linearly. Null keys form groups, or
    their rows take no part. ``df`` is read several times: pass a stored table or a cheap scan.
    """
    return long_form(level_groups(df, measures, probs, levels, limit, null_keys), levels)


def long_form(tables: dict[int, DataFrame], levels: Sequence[Sequence[str]]) -> DataFrame:
    """The rows of ``level_quantiles`` from the tables of ``level_groups``."""
    every = list(dict.fromkeys(k for level in levels for k in level))
    found = reduce(DataFrame.unionByName, [t.select(F.explode("found").alias("f")) for t in tables.values()])
    return found.select("f.level", *[F.col("f")[k].alias(k) for k in every], F.posexplode("f.cells").alias("feature", "c")).where(
        "c is not null").select("level", *every, "feature", "c.*")


def level_groups(
    df: DataFrame, measures: Sequence[str], probs: Sequence[float], levels: Sequence[Sequence[str]], limit: int | None = None,
    null_keys: bool = True, least: int = 1,
) -> dict[int, DataFrame]:
    """Index of a key set -> stored table of its keys and ``found``, an array of (``level``, keys of all sets, ``cells``),
    with (``n``, ``q_0`` ..) or null for each measure in ``cells``. Each group of every set is in ``found`` of one row.

    A chain of key sets is walked from the coarsest on. Rows of a group with up to ``PACK`` rows are shuffled once, by
    its keys; the quantiles of the finer groups in it are taken there and stored in its row. Larger groups are
    narrowed down, and only their rows go on to the next finer set. Cells of fewer than ``least`` values are left out
    unless the set has no keys.
    """
    limit = LIMIT if limit is None else limit
    pack = min(limit, PACK)
    every = list(dict.fromkeys(k for level in levels for k in level))
    kinds = {f.name: f.dataType for f in df.select(*every).schema}

    def with_level(i: int) -> list[Column]:
        return [F.lit(i).alias("level"), *[F.col(k) if k in levels[i] else F.lit(None).cast(kinds[k]).alias(k) for k in every]]

    def entry(i: int, cells: Sequence[Column]) -> Column:
        known = reduce(lambda a, b: a | b, [c.isNotNull() for c in cells]) & (F.lit(True) if null_keys else _known(levels[i]))
        return F.array_compact(F.array(F.when(known, F.struct(*with_level(i), F.array(*cells).alias("cells")))))

    def cell(i: int, n: Column, quantiles: Sequence[Column]) -> Column:
        return F.when(n >= (least if levels[i] else 1), F.struct(n.alias("n"), *quantiles))

    def packed(rows: DataFrame, chain: Sequence[int]) -> DataFrame:
        base = list(levels[chain[-1]])
        out = rows.repartition(*base) if base else rows
        for step, i in enumerate(chain):
            below = [F.flatten(F.collect_list("found")).alias("found")] if step else []
            out = out.groupBy(*levels[i]).agg(*below, *[
                F.sort_array(F.flatten(F.collect_list(m)) if step else F.collect_list(m)).alias(m) for m in measures])
            cells = []
            for m in measures:
                n = F.size(m).cast("long")
                cells.append(cell(i, n, _at(probs, lambda rank, m=m: F.get(m, rank.cast("int")), n)))
            found = entry(i, cells)
            out = out.select(*levels[i], *measures, (F.concat("found", found) if step else found).alias("found"))
        return out.select(*base, "found").where(F.size("found") > 0)

    tables: dict[int, list[DataFrame]] = {}
    sizes = []
    for chain in chains(levels):
        source = df if null_keys else df.where(_known(levels[chain[-1]]))
        rows = source
        for at in reversed(range(len(chain))):
            i, keys = chain[at], list(levels[chain[at]])
            if not null_keys:
                rows = rows.where(_known(keys))
            counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
            crowded = materialize(counts.where(F.col("__n") > pack), "crowded")
            if crowded.isEmpty():
                tables[i] = [packed(rows, chain[:at + 1])]
                break
            if keys:
                tables[i] = [packed(null_safe_join(rows, crowded.drop("__n"), keys, "left_anti"), chain[:at + 1])]
                rows = null_safe_join(source, crowded.drop("__n"), keys, "left_semi")
            sizes.append(_sizes(rows, measures, keys).select(*with_level(i), *_numbers(measures)))
    if sizes:
        hot = materialize(reduce(DataFrame.unionByName, sizes).withColumn("__g", F.monotonically_increasing_id()), "groups")
        met = {r.level: list(levels[r.level]) for r in hot.select("level").distinct().collect()}
        quantiles = [f"q_{j}" for j in range(len(probs))]
        wide = _narrow(df, measures, probs, met, hot, limit).groupBy("__g").agg(*[
            F.max(F.when(F.col("feature") == j, F.struct("n", *quantiles))).alias(f"__c_{j}") for j in range(len(measures))])
        wide = materialize(hot.select("__g", "level", *every).join(wide, "__g"), "narrowed")
        for i, keys in met.items():
            cells = [cell(i, F.col(f"__c_{j}.n"), [F.col(f"__c_{j}")[q].alias(q) for q in quantiles]) for j in range(len(measures))]
            own = wide.where(F.col("level") == i).select(*keys, entry(i, cells).alias("found")).where(F.size("found") > 0)
            tables.setdefault(i, []).append(own)
    return {i: materialize(reduce(DataFrame.unionByName, parts), "quantiles") for i, parts in tables.items()}


def _known(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))


def _numbers(measures: Sequence[str]) -> list[str]:
    return [f"__{x}_{j}" for j in range(len(measures)) for x in ("n", "lo", "hi")]


def _sizes(df: DataFrame, measures: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Keys, and for measure j its count ``__n_j``, least ``__lo_j`` and greatest value ``__hi_j``."""
    found = [f(m) for m in measures for f in (F.count, F.min, F.max)]
    return df.groupBy(*keys).agg(*[c.alias(name) for c, name in zip(found, _numbers(measures))])


def _at(probs: Sequence[float], value, n: Column) -> list[Column]:
    """The quantiles of ``n`` ordered values, ``value(rank)`` giving the value of a rank from 0."""
    out = []
    for j, p in enumerate(probs):
        at = (n - 1).cast("double") * F.lit(float(p))
        out.append(interpolate(value(F.floor(at)), value(F.ceil(at)), at).alias(f"q_{j}"))
    return out


def _bucket(v: Column, lo: Column, hi: Column, buckets: Column) -> Column:
    """Bucket of ``v`` in [lo, hi], never falling as v grows; the ends lie in different buckets."""
    most = F.lit(1.7976931348623157e308)
    a, b, x = (F.greatest(-most, F.least(most, c)) for c in (lo, hi, v))
    wide = b / 2 - a / 2 > most / 4  # their difference may be beyond a double
    share = F.when(wide, F.try_divide(x / 2 - a / 2, b / 2 - a / 2)).otherwise(F.try_divide(x - a, b - a))
    inside = F.least(buckets - 1, F.greatest(F.lit(0), F.floor(share * buckets).cast("int")))
    return F.when(v == lo, 0).when(v == hi, buckets - 1).otherwise(inside)


def total_quantiles(df: DataFrame, value: Column, probs: Sequence[float], limit: int | None = None) -> tuple[int, list[float | None]]:
    """The count and the quantiles of one column of a whole table; nulls are left out.

    The same narrowing as for groups. With a single group its intervals are a few numbers, so they, at most ``BUCKETS``
    counts of each and the last ``limit`` values come to the driver, and the next filter is a literal.
    """
    limit = LIMIT if limit is None else limit
    cells = df.select(value.alias("v")).where("v is not null")
    n, lo, hi = cells.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return 0, [None] * len(probs)
    wanted = {r for p in probs for r in (math.floor((n - 1) * float(p)), math.ceil((n - 1) * float(p)))}
    found: dict[int, float] = {}
    # (least, greatest, values, rank of the least): disjoint, each with a wanted rank
    spans = [(lo, hi, n, 0)]

    def inside(chosen: Sequence[tuple]) -> Column:
        return reduce(lambda so_far, k: F.when(F.col("v").between(chosen[k][0], chosen[k][1]), k).otherwise(so_far), range(len(chosen)), F.lit(None).cast("int"))

    while spans:
        large = [s for s in spans if s[0] < s[1] and s[2] > limit]
        small = [s for s in spans if s[0] < s[1] and s[2] <= limit]
        for lo, hi, many, base in spans:
            if not lo < hi:
                found |= {r: lo for r in wanted if base <= r < base + many}
        if small:
            rows = cells.withColumn("k", inside(small)).where("k is not null").groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("a")).collect()
            for row in rows:
                base = small[row.k][3]
                found |= {r: row.a[r - base] for r in wanted if base <= r < base + small[row.k][2]}
        spans = []
        if large:
            ends = [F.get(F.array(*[F.lit(s[e]) for s in large]), F.col("k")) for e in (0, 1)]
            counts = cells.withColumn("k", inside(large)).where("k is not null").groupBy(
                "k", _bucket(F.col("v"), *ends, F.lit(BUCKETS)).alias("b")).agg(F.count("v").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
            at = [s[3] for s in large]
            for row in sorted(counts, key=lambda row: (row.k, row.b)):
                if any(at[row.k] <= r < at[row.k] + row.c for r in wanted):
                    spans.append((row.lo, row.hi, row.c, at[row.k]))
                at[row.k] += row.c
    out = []
    for p in probs:
        at = (n - 1) * float(p)
        low, high, part = found[math.floor(at)], found[math.ceil(at)], at - math.floor(at)
        out.append(low if low == high else low * (1.0 - part) + high * part)
    return n, out


def _narrow(df: DataFrame, measures, probs, levels: dict[int, list[str]], hot: DataFrame, limit: int) -> DataFrame:
    """``__g``, ``feature``, ``n`` and the quantiles of the large groups."""
    span = ["__g", "feature", "lo", "hi"]

    def hits(spans: DataFrame) -> DataFrame:
        """The values that lie in an interval of their group: ``spans`` and ``v``."""
        parts = []
        met = materialize(hot.drop(*_numbers(measures)).join(spans, "__g"), "intervals")  # stored, so that its size is known
        for i, keys in levels.items():
            here = met.where(F.col("level") == i).select(*spans.columns, *keys)
            # without keys there is one group and so a few intervals: two for each wanted quantile at most, and measure
            rows = null_safe_join(df, here, keys) if keys else df.crossJoin(F.broadcast(here))
            value = F.get(F.array(*measures), F.col("feature"))
            parts.append(rows.select(*spans.columns, value.alias("v")).where(F.col("v").between(F.col("lo"), F.col("hi"))))
        return reduce(DataFrame.unionByName, parts)

    position = [(F.col("n") - 1).cast("double") * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(at) for at in position for f in (F.floor, F.ceil)]))
    cells = hot.select("__g", F.explode(F.array(*[
        F.struct(F.lit(j).alias("feature"), F.col(f"__n_{j}").alias("n"), F.col(f"__lo_{j}").alias("lo"), F.col(f"__hi_{j}").alias("hi"))
        for j in range(len(measures))])).alias("s")).select("__g", "s.*").where("n > 0")
    wanted = cells.select(
        "__g", "feature", "n", F.explode(ranks).alias("rank"), "lo", "hi", F.col("n").alias("inside"), F.lit(0).cast("long").alias("base"))
    large = (F.col("lo") < F.col("hi")) & (F.col("inside") > limit)
    settled = [wanted.where(~large)]
    left = wanted.where(large)
    while not left.isEmpty():
        buckets = F.least(F.lit(BUCKETS), F.greatest(F.lit(64), (32 * F.col("inside") / limit).cast("int")))
        spans = left.select(*span, buckets.alias("buckets")).distinct()
        counts = hits(spans).groupBy(*span, _bucket(F.col("v"), F.col("lo"), F.col("hi"), F.col("buckets")).alias("k")).agg(
            F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = Window.partitionBy(*span).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0).cast("long")))
        from_ = F.col("base") + F.col("before")
        nearer = left.join(counts, span).where((F.col("rank") >= from_) & (F.col("rank") < from_ + F.col("c"))).select(
            "__g", "feature", "n", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("c").alias("inside"), from_.alias("base"))
        nearer = materialize(nearer, "wanted")
        settled.append(nearer.where(~large))
        left = nearer.where(large)
    targets = reduce(DataFrame.unionByName, settled)
    known = targets.where("lo = hi").select("__g", "feature", "n", "rank", F.col("lo").alias("v"))
    open_ = targets.where("lo < hi")
    gathered = hits(open_.select(*span).distinct()).groupBy(*span).agg(F.sort_array(F.collect_list("v")).alias("a"))
    known = known.unionByName(open_.join(gathered, span).select(
        "__g", "feature", "n", "rank", F.get("a", (F.col("rank") - F.col("base")).cast("int")).alias("v")))
    by_rank = known.groupBy("__g", "feature", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))
    return by_rank.select("__g", "feature", "n", *_at(probs, lambda rank: F.col("m")[rank], F.col("n")))
