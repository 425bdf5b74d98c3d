from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panel_engine import config
from panel_engine.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_safe_casts(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "v string")
    assert [r[0] for r in df.select(S.safe_double("v")).collect()] == [1.5, None, None, None]
    assert [r[0] for r in df.select(S.binary_flag("v")).collect()] == [1, 0, 0, 0]


@pytest.mark.parametrize("parts, want", [((2020, 2, 29), dt.date(2020, 2, 29)), ((2019, 2, 30), None), ((2020, 13, 1), None)])
def test_safe_date(spark, parts, want):
    assert one(spark, S.safe_date(*[F.lit(p) for p in parts])) == want


def test_parse_date_first_format_wins(spark):
    df = spark.createDataFrame([("05/03/2020",), ("2020-03-05",), ("31/02/2020",), ("?",), (None,)], "v string")
    got = [r[0] for r in df.select(S.parse_date("v", ["d/M/yyyy", "yyyy-MM-dd"])).collect()]
    assert got == [dt.date(2020, 3, 5), dt.date(2020, 3, 5), None, None, None]


def test_season_phase_and_bins(spark):
    months = spark.range(1, 13).select(S.season(F.col("id").cast("int")).alias("s"))
    assert [r.s for r in months.collect()] == ["winter"] * 2 + ["spring"] * 3 + ["summer"] * 3 + ["autumn"] * 3 + ["winter"]
    phases = spark.range(-1, 9).select(S.lactation_phase("id").alias("p"))
    assert [r.p for r in phases.collect()] == [
        None, "peripartum", "early_lactation", "peak", "peak", "mid_lactation", "mid_lactation", "mid_lactation",
        "late_lactation", "late_lactation"]
    ages = spark.createDataFrame([(1.5,), (1.6,), (3.5,), (3.6,), (7.5,), (7.6,), (None,)], "a double")
    got = [r[0] for r in ages.select(S.bin_right_closed("a", config.AGE_EDGES, config.AGE_LABELS)).collect()]
    assert got == [None, "2_3", "2_3", "4_5", "6_7", None, None]
    with pytest.raises(ValueError):
        S.bin_right_closed("a", [1, 2], ["x", "y"])


def test_age_and_months(spark):
    d = lambda x: F.lit(x).cast("date")
    assert one(spark, S.age_years(d("2020-01-01"), d("2018-01-01"))) == 1  # 730 days are short of two years
    assert one(spark, S.age_years(d("2020-01-02"), d("2018-01-01"))) == 2
    assert one(spark, S.months_since(F.lit(2020), F.lit(1), d("2019-12-31"))) == 1
    assert one(spark, S.months_since(F.lit(2020), F.lit(1), d("2020-02-01"))) is None


def test_codes_and_lists(spark):
    df = spark.createDataFrame([("02",), ("2",), ("2.0",), ("99",), (None,)], "c string")
    assert [r[0] for r in df.select(S.map_codes("c", config.BREED_BY_CODE)).collect()] == ["frisona"] * 3 + [None, None]
    df = spark.createDataFrame([(" a, b,,c ",), (None,), ("",), ("a,a,z",)], "s string")
    assert [r[0] for r in df.select(S.split_list("s")).collect()] == [["a", "b", "c"], [], [], ["a", "a", "z"]]
    pool = F.array(F.lit("a"), F.lit("c"))
    assert [r[0] for r in df.select(S.count_in_pool(S.split_list("s"), pool, 2)).collect()] == [1, 0, 0, 2]
    assert [r[0] for r in df.select(S.count_in_pool(S.split_list("s"), pool, 3)).collect()] == [2, 0, 0, 2]


def test_dead_zone_includes_threshold(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (-0.5,), (-0.9,), (None,)], "v double")
    assert [r[0] for r in df.select(S.dead_zone_sign("v", 0.5)).collect()] == ["zero", "pos", "zero", "neg", "zero"]


@pytest.mark.parametrize("args, want", [
    ((10, 10, 0, "zero"), ("core", "two_view_rank_agreement")),
    ((3, 40, 0, "zero"), ("supportive", "single_view_rank")),
    ((20, 20, 2, "zero"), ("supportive", "interaction_support")),
    ((10, 20, 0, "pos"), ("supportive", "monotonic_direction_support")),
    ((10, 20, 1, "zero"), ("peripheral", "weak_support")),
])
def test_consensus_rule_chain(spark, args, want):
    assert tuple(one(spark, S.consensus_label(*[F.lit(a) for a in args], 10, 3, 2))) == want
