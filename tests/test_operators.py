from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panel_engine.operators import clean, joins, reduce, timeline
from panel_engine.operators.ordered import cumulative, dense_rank_desc, grouped_quantiles
from tests.conftest import plan_of

D = dt.date


# ---- order statistics -----------------------------------------------------------------


@pytest.mark.parametrize("probs", [[0.5], [0.25, 0.75], [0.0, 0.1, 1.0]])
def test_quantiles_equal_numpy(spark, probs):
    rng = random.Random(7)
    data = {"a": [rng.gauss(0, 1) for _ in range(101)], "b": [float(rng.randint(0, 3)) for _ in range(40)],
            "c": [4.25], None: [-1.0, -1.0, 1e9, 1e-9], "d": [1.7e9 + i for i in range(50)]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None), ("e", None)], "g string, v double")
    got = {r.g: [r[f"q_{i}"] for i in range(len(probs))] for r in grouped_quantiles(df, "v", probs, ["g"]).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        np.testing.assert_allclose(got[g], np.quantile(vs, probs), rtol=1e-12, atol=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert grouped_quantiles(df, "v", [0.5]).collect() == []


def test_cumulative_and_rank_match_plain_windows(spark, rows):
    rng = random.Random(3)
    data = [(g, float(rng.randint(-5, 40)) / 4, rng.randint(1, 3)) for g in ("x", None) for _ in range(60)]
    hist = spark.createDataFrame(data, "g string, v double, w int").groupBy("g", "v").agg(F.sum("w").alias("w"))
    got = {(r.g, r.v): (r.upto_w, r.all_w, r.next_value) for r in cumulative(hist, "v", ["w"], ["g"]).collect()}
    for g in ("x", None):
        seen = sorted((r.v, r.w) for r in hist.collect() if r.g == g)
        total = 0
        for i, (v, w) in enumerate(seen):
            total += w
            assert got[g, v] == (total, sum(x[1] for x in seen), seen[i + 1][0] if i + 1 < len(seen) else None)
    scored = spark.createDataFrame([("m", 2.0), ("m", 2.0), ("m", 1.0), ("n", 5.0)], "m string, s double")
    assert rows(dense_rank_desc(scored, "s", "r", ["m"])) == [("m", 1.0, 2), ("m", 2.0, 1), ("m", 2.0, 1), ("n", 5.0, 1)]
    assert {r.r for r in dense_rank_desc(scored, "s", "r").collect()} == {1, 2, 3}


def test_rank_and_quantiles_keep_nulls_nan_and_large_numbers(spark, rows):
    from pyspark.sql import Window

    longs = spark.createDataFrame([("m", v) for v in (2 ** 53, 2 ** 53 + 1, None, 5, 5)], "m string, s long")
    doubles = spark.createDataFrame([("m", v) for v in (float("nan"), float("inf"), float("-inf"), None, 0.0, -0.0, 1.5)], "m string, s double")
    for df in (longs, doubles):
        plain = df.withColumn("r", F.dense_rank().over(Window.partitionBy("m").orderBy(F.desc("s"))))
        assert [*map(repr, rows(dense_rank_desc(df, "s", "r", ["m"])))] == [*map(repr, rows(plain))]
    ends = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),), (float("inf"),)], "v double")
    assert tuple(grouped_quantiles(ends, "v", [0.0, 0.1, 0.5, 0.75]).first())[1:] == (float("-inf"), float("-inf"), 2.0, float("inf"))


def test_a_narrow_range_of_values_is_split(spark):
    n = 200_000
    df = spark.range(n).select((F.col("id") + 1.6e9).cast("double").alias("v"), F.lit(1).alias("w"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = cumulative(df, "v", ["w"], []).cache()
        assert got.where(F.col("upto_w") != F.col("v") - 1.6e9 + 1).count() == 0 and got.count() == n
        assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ---- cleaning ---------------------------------------------------------------------------


def test_iqr_and_positive(spark, rows):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)] + [(1000.0,), (None,)], "v double")
    assert max(r.v for r in clean.iqr_filter(df, "v").collect()) == 10.0
    assert clean.iqr_filter(df, "v").count() == 10
    df = spark.createDataFrame([(0.0,), (-1.0,), (float("nan"),), (None,), (2.0,)], "v double")
    assert rows(clean.keep_positive(df, "v")) == [(2.0,)]
    assert clean.iqr_filter(df.where("v > 100 and v < 1000"), "v").count() == 0


def test_cascade_order_matters(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 6.0), (3.0, 7.0), (900.0, 5.5), (2.5, -1.0)], "a double, b double")
    out = clean.quality_cascade(df, [("a", True), ("b", True)])
    assert sorted(r.a for r in out.collect()) == [1.0, 2.0, 3.0]


def test_schema_tolerance(spark):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    out = clean.ensure_columns(df, {"a": (9, "int"), "c": (0, "int")})
    assert out.first().asDict() == {"a": 1, "b": None, "c": 0}
    assert clean.ordered_projection(out, ["c", "a", "c", "z"]).columns == ["c", "a"]
    with pytest.raises(KeyError):
        clean.require_columns(df, ["z"])
    with pytest.raises(ValueError):
        clean.require_rows(df.where("a = 2"), "empty")
    assert clean.fill_from(df, "b", "absent") is df


# ---- reductions ---------------------------------------------------------------------------


def test_first_non_null_per_column(spark, rows):
    df = spark.createDataFrame([(1, 1, None, "b"), (1, 2, 5.0, "a"), (1, 3, 4.0, None), (2, None, 7.0, None)], "id int, o int, v double, s string")
    assert rows(reduce.first_non_null(df, ["id"], ["v", "s"], ["o"])) == [(1, 5.0, "b"), (2, 7.0, None)]


def test_majority_tie_goes_to_smallest(spark, rows):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (2, "z"), (2, "z"), (2, "a"), (3, None)], "id int, l string")
    assert rows(reduce.majority(df, "id", "l")) == [(1, "a"), (2, "z")]


def test_collapse_events(spark, rows):
    df = spark.createDataFrame([(1, 1.0, None), (1, None, None), (2, None, None), (3, 0.0, 0.0)], "id int, a double, b double")
    assert rows(reduce.collapse_events(df, ["id"], ["a", "b"], "n")) == [(1, 2)]


def test_reconcile_reports_entities_lost_entirely(spark):
    before = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0)], "id int, bad int")
    got = reduce.reconcile(before, before.where("bad = 0"), "id", {"bad": F.col("bad") == 1}).first().asDict()
    assert got == {"entities": 3, "changed": 2, "lost_entirely": 1, "events_removed": 2, "by_bad": 2}


def test_distribution_of_nothing(spark):
    got = reduce.count_distribution(spark.createDataFrame([], "id int"), "id").first().asDict()
    assert got == {"rows": 0, "n_ids": 0, "min": 0, "median": 0.0, "max": 0}


def test_duplicates(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, v int")
    assert tuple(reduce.duplicate_report(df, ["k"]).first()) == (2, 1, 2)
    first = reduce.keep_first(df, ["k"], [F.desc("v")])
    assert sorted(map(tuple, first.collect())) == [(1, 2), (2, 1)]
    assert plan_of(first).count("WindowGroupLimit") >= 2  # cut before the shuffle


# ---- joins ----------------------------------------------------------------------------------


def test_merge_types_and_suffixes(spark, rows):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, day string")
    b = spark.createDataFrame([(2, "p"), (3, "q")], "id bigint, day string")
    out = joins.merge(a, b, ["id"], "outer")
    assert out.columns == ["id", "day_x", "day_y"]
    assert rows(out) == [(1, "x", None), (2, "y", "p"), (3, None, "q")]
    assert rows(joins.merge(a, b, ["id"], "right")) == [(2, "y", "p"), (3, None, "q")]
    assert rows(joins.merge(a, b.withColumn("id", F.col("id").cast("string")), ["id"], "left")) == [("1", "x", None), ("2", "y", "p")]
    with pytest.raises(TypeError):
        joins.harmonize_keys(a, spark.createDataFrame([(D(2020, 1, 1),)], "id date"), ["id"])
    with pytest.raises(ValueError):
        joins.merge(a, b, ["id"], "cross")
    third = joins.merge(out, spark.createDataFrame([(1, "z")], "id bigint, day string"), ["id"], "left")
    assert third.columns == ["id", "day_x", "day_y", "day"]  # no clash any more


def test_keys_of_different_numbers_meet_exactly(spark):
    def met(a, kind_a, b, kind_b):
        left, right = joins.harmonize_keys(
            spark.createDataFrame([(x,) for x in a], f"id {kind_a}"), spark.createDataFrame([(x,) for x in b], f"id {kind_b}"), ["id"])
        return left.join(right, "id").count()

    assert met([16777216, 16777217], "long", [16777216.0], "float") == 1
    assert met([16777216, 16777217], "int", [16777216.0], "float") == 1
    assert met([2 ** 53, 2 ** 53 + 1], "long", [float(2 ** 53)], "double") == 1
    assert met([1, 2], "long", [1.5, 2.0, float("nan")], "double") == 1
    import decimal

    assert met([decimal.Decimal("2.50"), decimal.Decimal("9007199254740993.00")], "decimal(20,2)", [9007199254740993, 2], "long") == 1



def test_merge_null_keys(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k int, a int")
    b = spark.createDataFrame([(None, 8), (1, 9)], "k int, b int")
    assert joins.merge(a, b, ["k"], "inner").count() == 1
    assert joins.merge(a, b, ["k"], "inner", null_safe=True).count() == 2
    assert joins.merge(a, b, ["k"], "outer").count() == 3
    assert joins.merge(a, b, ["k"], "outer", null_safe=True).count() == 2


def test_outer_merge_is_splittable(spark):
    a, b = spark.range(10).withColumn("x", F.lit(1)), spark.range(5, 15).withColumn("y", F.lit(1))
    out = joins.merge(a, b, ["id"], "outer")
    assert out.count() == 15 and "FullOuter" not in plan_of(out)


def test_merge_all(spark):
    a = spark.createDataFrame([(1, 1), (1, 1)], "id int, t int")
    out = joins.merge_all(a, [joins.Join(spark.createDataFrame([(1, 2)], "id int, u int"), ["id"], "left")], ["t", "absent"])
    assert sorted(map(tuple, out.collect())) == [(1, 2)]
    with pytest.raises(ValueError):
        joins.merge_all(a, [joins.Join(spark.createDataFrame([(7, 2)], "id int, u int"), ["id"], "inner")], fail_if_empty=True)


def test_entity_fill_and_one_to_one(spark, rows):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, None), (1, 3, "a"), (2, 1, None)], "id int, o int, v string")
    assert rows(joins.fill_from_entity(df, "id", "v", ["o"])) == [(1, 1, "b"), (1, 2, "b"), (1, 3, "a"), (2, 1, None)]
    with pytest.raises(ValueError):
        joins.attach_one_to_one(df.select("id"), df.select("id"), ["id"])


# ---- timeline ---------------------------------------------------------------------------------


def test_forward_fill_in_period_order(spark):
    data = [(1, 1, None, None), (1, 2, None, D(2020, 2, 5)), (1, 2, None, None), (1, 3, D(2020, 3, 1), None), (2, 1, None, None)]
    df = spark.createDataFrame(data, "id int, month int, cf date, ev date")
    got = {(r.id, r.month, r.ev): r.last for r in timeline.forward_fill(df, "id", ["month", "cf"], "ev", "last").collect()}
    day = D(2020, 2, 5)
    assert got == {(1, 1, None): None, (1, 2, day): day, (1, 2, None): day, (1, 3, None): day, (2, 1, None): None}


def test_event_within_bounds(spark):
    checks = spark.createDataFrame([(i, D(2020, 1, 31)) for i in range(5)] + [(9, None)], "id int, cf date")
    events = spark.createDataFrame(
        [(i, D(2020, 1, 31) + dt.timedelta(n)) for i, n in enumerate([0, 1, 29, 30, -1])] + [(9, D(2020, 2, 1))], "id int, t date")
    got = {r.id: r.y for r in timeline.event_within(checks, events, "id", "cf", "t", 1, 29, "y").collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0, 9: 0}


def test_event_within_keeps_rows(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 1), D(2020, 1, 5))] * 3, "id int, cf date, t date")
    out = timeline.event_within(df, df, "id", "cf", "t", 1, 29, "y")
    assert out.count() == 3 and out.where("y = 1").count() == 3


def test_ever_flag(spark, rows):
    df = spark.createDataFrame([(1, 4.9), (1, 5.0), (2, None), (2, 1.0)], "id int, scs double")
    assert rows(timeline.ever_flag(df, "id", F.col("scs") >= 5, "bad").select("id", "bad").distinct()) == [(1, 1), (2, 0)]


def brute_anchors(rows, lags):
    """Row-based lags per entity in (month, order) order."""
    found = set()
    for entity in {r[0] for r in rows}:
        seq = sorted((r[1], r[2]) for r in rows if r[0] == entity)
        for i, (month, order) in enumerate(seq):
            if all(i - k >= 0 and month - seq[i - k][0] == k for k in lags):
                found.add((entity, month, order, tuple(seq[i - k][1] for k in lags)))
    return found


@pytest.mark.parametrize("lags", [[1], [1, 2], [1, 2, 3], [2], [2, 3], [1, 3], [3]])
def test_row_history_equals_brute_force(spark, lags):
    rng = random.Random(len(lags) * 10 + lags[0])
    data, order = [], 0
    for entity in range(40):
        for month in range(12):
            for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3])):
                order += 1
                data.append((entity, month, order))
    df = spark.createDataFrame(data, f"id int, {timeline.MONTH_IDX} int, v int")
    out = timeline.row_history(df, "id", ["v"], lags, ["v"]).where(timeline.consecutive(lags))
    got = {(r.id, r[timeline.MONTH_IDX], r.v, tuple(r[f"v_t-{k}"] for k in lags)) for r in out.collect()}
    want = brute_anchors(data, lags)
    assert want and got == want


def test_sequences_oldest_first(spark):
    df = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0), (1, 13, 3.0)], f"id int, {timeline.MONTH_IDX} int, v double")
    got = {r[timeline.MONTH_IDX]: (r.steps, r["__n_steps"]) for r in timeline.sequences(df, "id", ["v"], 2).collect()}
    assert got == {10: ([[1.0]], 1), 11: ([[1.0], [2.0]], 2), 13: ([[3.0]], 1)}


def test_windows_run_on_period_summaries(spark):
    """The raw rows are aggregated per (entity, period) before any window over the entity."""
    df = spark.createDataFrame([(1, 1, D(2020, 1, 1), 1.0)], "id int, month int, ev date, v double")
    plan = plan_of(timeline.forward_fill(df, "id", ["month"], "ev", "last"))
    tree = plan[:plan.index("\n\n\n")]
    assert "Window" in tree and tree.index("Window") < tree.index("HashAggregate")
    assert "EvalPython" not in plan and "CartesianProduct" not in plan


def test_fences_reach_the_scan(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id").cast("double")).write.parquet(str(tmp_path / "t"))
    kept = clean.quality_cascade(spark.read.parquet(str(tmp_path / "t")), [("v", True)]).select("v")
    plan = plan_of(kept)
    assert "GreaterThanOrEqual(v," in plan and "ReadSchema: struct<v:double>" in plan and "Exchange" not in plan


def test_hot_entity_reaches_windows_as_one_row_per_period(spark):
    """A third of all rows on one entity: window input stays at distinct periods."""
    hot = spark.range(20000).select(F.lit(0).alias("id"), (F.col("id") % 5).cast("int").alias("m"), F.col("id").alias("v"))
    cold = spark.range(40000).select(F.col("id").cast("int").alias("id"), F.lit(1).alias("m"), F.col("id").alias("v"))
    df = hot.unionByName(cold).withColumnRenamed("m", timeline.MONTH_IDX)
    out = timeline.row_history(df, "id", ["v"], [1], ["v"])
    assert out.where("id = 0").count() == 5
    ff = timeline.ever_flag(df, "id", F.col("v") == 19999, "e")
    assert ff.where("e = 1 and id = 0").count() == 20001
