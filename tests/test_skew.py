from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from panel_engine.operators import joins, skew


def sides(spark, hot_right=False):
    rng = random.Random(5)
    left = [(7 if i % 3 == 0 else rng.randint(0, 400), i % 11, f"l{i}") for i in range(6000)]
    left += [(None, 1, f"n{i}") for i in range(2000)] + [(7, 7, "same")] * 50
    right = [(k, k % 11, k * 2) for k in range(0, 300)] + [(None, 5, -1), (7, 3, 14), (7, 3, 14)]
    if hot_right:
        right += [(8, 1, i) for i in range(900)]
    return spark.createDataFrame(left, "k long, v int, a string"), spark.createDataFrame(right, "k long, v int, b long")


def counted(df):
    out = {}
    for r in df.collect():
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


@pytest.mark.parametrize("how", ["inner", "left", "right"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_equals_the_plain_join(spark, how, null_safe):
    left, right = sides(spark, hot_right=True)
    got = skew.salted_merge(left, right, ["k"], how, null_safe, blocks=64)
    want = joins.merge(left, right, ["k"], how, null_safe)
    assert got.columns == want.columns == ["k", "v_x", "a", "v_y", "b"]
    assert counted(got) == counted(want)


def test_several_keys_types_and_empty_sides(spark):
    left = spark.createDataFrame([(0.0, "x", 1)] * 400 + [(-0.0, "x", 2), (float("nan"), "x", 3), (None, None, 4), (1.5, "y", 5)], "d double, s string, a int")
    right = spark.createDataFrame([(-0.0, "x", 9), (float("nan"), "x", 8), (None, None, 7), (1.5, None, 6)], "d double, s string, b int")
    for how in ("inner", "left", "right"):
        for null_safe in (False, True):
            got = skew.salted_merge(left, right, ["d", "s"], how, null_safe, blocks=40).select("a", "b")
            want = joins.merge(left, right, ["d", "s"], how, null_safe).select("a", "b")
            assert counted(got) == counted(want), (how, null_safe)
    assert skew.salted_merge(left.limit(0), right, ["d", "s"], "left").count() == 0
    assert skew.salted_merge(left, right.limit(0), ["d", "s"], "left").count() == left.count()
    with pytest.raises(ValueError):
        skew.salted_merge(left, right, ["d", "s"], "outer")


def test_the_sketch_names_hot_keys_only(spark):
    left, _ = sides(spark)
    hot = {r.h: r.salts for r in skew.hot_keys(left, ["k"], 500).collect()}
    names = {k: left.sparkSession.createDataFrame([(k,)], "k long") for k in (7, None)}
    want = {d.select(skew.key_hash(d, ["k"])).first()[0]: n for (k, d), n in zip(names.items(), (5, 4))}
    assert hot == want


def test_a_key_with_a_third_of_all_rows_is_dealt_evenly(spark):
    left, right = sides(spark)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(kept, ("false", "-1", "8")):
            spark.conf.set(c, v)
        for null_safe in (False, True):
            for how in ("inner", "left"):
                got = skew.salted_merge(left, right, ["k"], how, null_safe)
                rows = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
                assert len(rows) == 8 and max(rows) <= 3 * statistics.median(rows), (how, null_safe, rows)
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
