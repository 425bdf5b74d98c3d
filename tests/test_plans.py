from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panel_engine import config
from panel_engine.operators import sampling
from panel_engine.plans import construction, modelling, preparation
from tests.conftest import plan_of

D = dt.date
CONTROL = "idAnimale long, anno int, mese int, giorno int, codiceRazzaAIA string, LinearScore double, LatteAlle24Ore double, ProteineAlle24Ore double, GrassoAlle24Ore double"


@pytest.fixture(scope="module")
def control(spark):
    base = [(1, 2020, m, 10, "02", 3.0, 30.0 + m, 3.0, 4.0) for m in range(1, 9)]
    base += [(2, 2020, m, 11, "2.0" if m % 2 else "04", 3.5, 28.0 + m, 3.1, 4.1) for m in range(1, 9)]
    extra = [
        base[0],  # exact duplicate
        (1, 2018, 1, 1, "01", 3.0, 30.0, 3.0, 4.0),  # too old, does not vote
        (1, 2020, 9, 10, None, 3.0, None, 3.0, 4.0), (1, 2020, 9, 10, "99", 3.0, 33.0, 3.0, 4.0),  # two rows, first value null
        (1, 2020, 10, 10, "02", 3.0, 900.0, 3.0, 4.0), (1, 2020, 11, 10, "02", 3.0, 0.0, 3.0, 4.0),  # outlier, zero
        (2, 2020, 2, 30, "04", 3.5, 30.0, 3.1, 4.1),  # no such day; breed 5:4 before, now 4:5
        (3, 2020, 5, 1, "99", 3.0, 30.0, 3.0, 4.0),  # no known breed
    ]
    return spark.createDataFrame(base + extra, CONTROL)


def test_control_records(control):
    out = construction.control_records(control)
    got = {(r.id, r.month, r.day): r for r in out.collect()}
    assert {r.breed for r in got.values() if r.id == 1} == {"frisona"}
    assert {r.breed for r in got.values() if r.id == 2} == {"pezzata"}
    assert not any(r.id == 3 for r in got.values()) and not any(r.year == 2018 for r in got.values())
    assert got[1, 9, 10].milk == 33.0 and (1, 10, 10) not in got and (1, 11, 10) not in got
    assert got[2, 2, 30].cf_date is None and got[1, 1, 10].cf_date == D(2020, 1, 10)
    assert {r.id for r in construction.control_ids(out).collect()} == {1, 2}
    assert set(out.columns) == {"id", "year", "month", "day", "scs", "milk", "protein", "fat", "breed", "cf_date"}


def test_daily_measure(spark, rows):
    ids = spark.createDataFrame([(1,)], "id long")
    raw = spark.createDataFrame(
        [(1, 2020, 1, 1, None, 4.8), (1, 2020, 1, 2, 4.9, 1.0), (1, 2020, 1, 3, None, None), (1, 2020, 1, 4, -4.0, 4.8),
         (9, 2020, 1, 1, 4.8, None), (1, 2017, 1, 1, 4.8, None), (1, 2020, 1, 1, None, 4.8)],
        "idAnimale long, anno int, mese int, giorno int, Lattosio double, valoreMisura double")
    out = construction.daily_measure(raw, ids, config.LACTOSE, "lactose")
    assert rows(out, "id", "day", "lactose") == [(1, 1, 4.8), (1, 2, 4.9)]
    without = construction.daily_measure(raw.drop("valoreMisura"), ids, config.LACTOSE, "lactose")
    assert rows(without, "id", "day", "lactose") == [(1, 2, 4.9)]


def test_calving(spark, rows):
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    schema = "idAnimale long, giorno int, mese int, anno int, " + ", ".join(f"{c} double" for c in config.BIRTH_COUNTERS)
    raw = spark.createDataFrame(
        [(1, 9, 3, 2020, 1.0, None, None, None), (1, 9, 3, 2020, 0.0, 0.0, None, 1.0), (1, 9, 3, 2020, 0.0, 0.0, 0.0, 0.0),
         (1, 4, 3, 2020, None, None, 1.0, None), (1, 5, 5, 2020, 0.0, 0.0, 0.0, 0.0), (2, 1, 1, 2020, None, None, None, None),
         (7, 1, 1, 2020, 1.0, None, None, None)], schema)
    assert rows(construction.calving_events(raw, ids), "id", "calving_date", "same_day_records", "calving") == [(1, D(2020, 3, 4), 1, 1)]
    report = construction.calving_report(raw, ids)
    assert report["same_day"].first()[0] == 1
    assert report["reconciliation"].first().asDict() == {"entities": 2, "changed": 2, "lost_entirely": 1, "events_removed": 5}


def test_registry(spark, rows):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    raw = spark.createDataFrame(
        [(1, "2019-05-01"), (1, "2018-06-01"), (1, "2017-01-01"), (2, "soon"), (2, "2022-12-31"), (3, "2023-01-01"), (9, "2020-01-01")],
        "idAnimale long, DataNascita string")
    assert rows(construction.birth_registry(raw, ids)) == [(1, D(2018, 6, 1)), (2, D(2022, 12, 31))]


def test_treatments(spark, rows):
    raw = spark.createDataFrame(
        [("A", "MAS", "05/03/2020"), ("A", "MAS", "02/03/2020"), ("A", "MAS", "31/02/2020"), ("A", "OTH", "01/01/2020"),
         ("B", "MAS", "01/06/2019"), ("C", "MAS", "01/07/2021"), ("D", "MAS", None), ("E", "MAS", "03/03/2021")],
        "CAPO_IDENTIFICATIVO string, TIPODIAGNOSI_CODICE string, TRAT_DT_INIZIO string")
    tags = spark.createDataFrame([(1, "A"), (2, "B"), (99, "C"), (4, None)], "idAnimale long, Marca string")
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    out = construction.treatment_events(raw, tags, ids, "MAS")
    assert rows(out, "id", "t_date", "month") == [(1, D(2020, 3, 2), 3)]
    every = construction.treatment_events(raw, tags, ids, "MAS", keep_all_years=True)
    assert rows(every, "id", "t_date") == [(1, D(2020, 3, 2)), (2, D(2019, 6, 1))]
    empty = construction.treatment_events(raw, tags, ids, "NONE")
    assert empty.columns == out.columns and empty.count() == 0  # one schema, empty or not
    report = construction.treatment_report(raw, "MAS")
    assert report["reconciliation"].first().asDict() == {
        "entities": 4, "changed": 2, "lost_entirely": 1, "events_removed": 2, "by_bad_date": 1, "by_old_year": 1}


def merged(spark):
    schema = ("id long, year int, month int, scs double, breed string, cf_date date, calving_date date, calving int, "
              "diagnosis string, t_date date, birth_date date, milk double")
    b = D(2016, 1, 15)
    return spark.createDataFrame([
        (1, 2020, 1, 3.0, "k", D(2020, 1, 5), D(2020, 1, 2), 1, None, None, None, 20.0),
        (1, 2020, 2, 3.0, None, D(2020, 2, 5), None, None, None, None, b, 21.0),
        (1, 2020, 3, 3.0, "k", None, None, None, "MAS", D(2020, 3, 1), None, None),
        (1, 2020, 5, 3.0, "k", D(2020, 5, 5), None, None, None, None, None, 22.0),
        (2, 2020, 2, 5.0, "z", D(2020, 2, 5), None, None, None, None, b, 23.0),  # never calved
        (3, 2020, 2, 4.9, "z", D(2020, 2, 5), D(2019, 12, 5), 1, None, None, D(2019, 1, 1), 24.0),  # too young
        (4, 2020, 2, 4.9, "z", D(2020, 2, 5), None, None, None, None, None, 25.0),  # no birth date
        (5, 2020, 8, 4.9, "z", D(2020, 8, 5), D(2020, 1, 3), 1, None, None, b, 26.0),
    ], schema)


def test_pre_process_and_features(spark):
    pre = preparation.pre_process(merged(spark))
    got = {(r.id, r.month): r for r in pre.collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (1, 5), (2, 2), (5, 8)}
    assert got[1, 1].age == 3 and got[1, 5].age == 4 and got[1, 2].breed == "k" and got[1, 2].calving == 0
    out = {(r.id, r.month): r for r in preparation.add_features(pre).collect()}
    assert set(out) == {(1, 2), (1, 5), (5, 8)}  # calving month, event-only row and the never-calved entity are gone
    r = out[1, 2]
    assert (r.months_since_calving, r.lactation_phase, r.disease, r.healthy, r.season) == (1, "early_lactation", 1, 0, "winter")
    assert (out[1, 5].disease, out[1, 5].lactation_phase) == (0, "mid_lactation")
    assert (out[5, 8].healthy, out[5, 8].lactation_phase, out[5, 8].season) == (1, "late_lactation", "summer")
    assert out[1, 2].month_sin == pytest.approx(0.5)


@pytest.mark.parametrize("season, lactation, absent", [
    ("cat", "phase", {"month_sin", "month_cos"}), ("cyclic", "months", {"season", "lactation_phase"}), ("both", "both", set())])
def test_feature_modes(spark, season, lactation, absent):
    out = preparation.add_features(preparation.pre_process(merged(spark)), season, lactation)
    assert {"season", "month_sin", "month_cos", "lactation_phase"} - set(out.columns) == absent
    assert out.count() == 3


def test_features_without_optional_columns(spark):
    df = spark.createDataFrame([(1, 2020, 3)], "id long, year int, month int")
    assert preparation.add_features(df).count() == 0
    with pytest.raises(ValueError):
        preparation.add_features(df, season_mode="none")
    with pytest.raises(KeyError):
        preparation.pre_process(df)


# ---- anchors ------------------------------------------------------------------------------


def panel(spark, months, **columns):
    data = [(i, 2020 + (m - 1) // 12, (m - 1) % 12 + 1, int(m % 2), 0, 4, float(m)) for i, ms in months.items() for m in ms]
    return spark.createDataFrame(data, "id long, year int, month int, disease int, healthy int, age int, milk double")


def test_validated_anchors(spark):
    df = panel(spark, {1: [11, 12, 13, 14], 2: [1, 2, 4, 5], 3: [1, 2], 4: [1, 2, 2, 3, 4, 5]})
    out = modelling.validated_anchors(df)
    assert {(r.id, r.year * 12 + r.month - 2020 * 12) for r in out.collect()} == {(1, 13), (1, 14), (4, 4), (4, 5)}
    r = out.where("id = 1 and month = 1").first()
    assert (r.disease, r["disease_t-1"], r["disease_t-2"], r.age_class) == (1, 0, 1, "4_5")
    assert out.columns == ["id", "year", "month", "__month_idx", "disease", "disease_t-1", "disease_t-2", "healthy", "age", "age_class"]
    deduped = modelling.validated_anchors(df, duplicates="dedupe_first", keep_index=False)
    assert {(r.id, r.month) for r in deduped.where("id = 4").collect()} == {(4, 3), (4, 4), (4, 5)}
    assert modelling.validated_anchors(df, min_year=2021).count() == 0
    with pytest.raises(ValueError):
        modelling.validated_anchors(df, min_year=2022, fail_if_empty=True)
    with pytest.raises(ValueError):
        modelling.validated_anchors(df, lags=[0, 1])
    schema = modelling.anchor_schema(out, [1, 2], "disease", config.SUPPORT_COLUMNS).first()
    assert schema.target_history_columns == ["disease_t-1", "disease_t-2"] and schema.support_columns[0] == "disease"
    assert modelling.anchor_meta(out, [1, 2], "disease").first().validated_anchors == 4


def anchors(spark, n=600, seed=2):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        sick = rng.random() < 0.3
        data.append((i, 2020, rng.randint(1, 12), int(sick), 0, 0, int(not sick), rng.choice([3, 4]), rng.choice(["peak", "late", None]),
                     rng.choice(["winter", "only_sick" if sick else "only_well"])))
    return spark.createDataFrame(data, "id int, year int, month int, disease int, `disease_t-1` int, `disease_t-2` int, healthy int, age int, lactation_phase string, season string")


@pytest.mark.parametrize("ratio", ["1:1", "1:5", (2, 3)])
def test_sample_is_exact_per_stratum(spark, ratio):
    src = anchors(spark)
    out = modelling.balanced_sample(src, ratio)
    p, q = sampling.check_ratio(ratio)
    assert out.exceptAll(src).count() == 0 and out.columns == src.columns

    def counts(df):
        return Counter((r.age, r.lactation_phase, r.season, r.disease) for r in df.collect())

    got, have = counts(out), counts(src.where("lactation_phase is not null"))
    strata = {k[:3] for k in have}
    assert got
    for s in strata:
        blocks = min(have[*s, 1] // p, have[*s, 0] // q)
        assert (got[*s, 1], got[*s, 0]) == (blocks * p, blocks * q)
    again = modelling.balanced_sample(src.repartition(7), ratio)
    assert again.exceptAll(out).count() == 0
    if ratio == "1:5":
        other = modelling.balanced_sample(src, ratio, seed=43)
        assert other.count() == out.count() and other.exceptAll(out).count() > 0
    report = modelling.sampling_report(src, out, ratio).first()
    assert report.sampled_rows == out.count() and report.overlap_strata == 4
    assert report.dropped_positive_only_strata == report.dropped_negative_only_strata == 4


def test_sample_without_strata_and_errors(spark):
    src = anchors(spark)
    out = modelling.balanced_sample(src, "1:1", strata=[])
    assert out.where("disease = 1").count() == out.where("disease = 0").count() > 100
    with pytest.raises(ValueError):
        modelling.balanced_sample(src.where("disease = 1"), fail_if_empty=True)
    for bad in ("1", "0:1", "5:1"):
        with pytest.raises(ValueError):
            sampling.check_ratio(bad)
    for bad in ([], [2]):
        with pytest.raises(ValueError):
            sampling.check_pattern(bad)
    with pytest.raises(KeyError):
        modelling.balanced_sample(src, strata=["absent"])


def test_shared_anchors(spark):
    df = panel(spark, {1: [1, 2, 3, 4], 2: [1, 3, 4], 3: [1, 2, 3]})
    df = df.withColumn("milk", F.when(~((F.col("id") == 3) & (F.col("month") == 1)), F.col("milk")))
    chosen = spark.createDataFrame(
        [(1, 2020, 3, 1, "a"), (1, 2020, 4, 0, "b"), (2, 2020, 4, 0, "c"), (3, 2020, 3, 1, "d"), (9, 2020, 3, 1, "e")],
        "id long, year int, month int, disease int, season string")
    args = dict(lags=[1, 2], lag_variables=["milk"], keep_variables=["age"], support=["season"])
    out = modelling.shared_anchors(df, chosen, fail_on_null=False, **args)
    assert sorted(map(tuple, out.collect())) == [(1, 2020, 3, 1, "a"), (1, 2020, 4, 0, "b")]
    report = modelling.shared_report(df, chosen, out, [1, 2], ["milk"], ["age"]).first()
    assert (report.input_anchor_rows, report.ml_eligible_rows, report.dl_eligible_rows, report.shared_final_rows) == (5, 2, 2, 2)
    with pytest.raises(ValueError, match="null features"):
        modelling.shared_anchors(df, chosen, **args)
    with pytest.raises(ValueError, match="not unique"):
        modelling.shared_anchors(df, chosen.unionByName(chosen.limit(1)), fail_on_null=False, **args)
    wide = modelling.lagged_wide(df, chosen.where("id = 1"), [1, 2], ["milk"], ["age"])
    assert wide.columns == ["id", "year", "month", "milk", "age", "milk_t-1", "milk_t-2", "disease"]
    assert tuple(wide.where("month = 4").first()) == (1, 2020, 4, 4.0, 4.0, 3.0, 2.0, 0)
    steps = modelling.sequence_table(df, chosen, ["milk", "age"])
    assert {(r.id, r.month): r.steps for r in steps.collect()} == {
        (1, 3): [[1.0, 4.0], [2.0, 4.0], [3.0, 4.0]], (1, 4): [[2.0, 4.0], [3.0, 4.0], [4.0, 4.0]]}


def test_one_hot(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    out, names = modelling.one_hot(df, ["c", "absent"], {"c": ["a", "b"]})
    assert names == {"c": ["c_a", "c_b"]} and [tuple(r) for r in out.collect()] == [("a", 1, 0), ("b", 0, 1), (None, 0, 0)]
    with pytest.raises(ValueError, match="levels"):
        modelling.one_hot(df, ["c"])
    assert modelling.wide_feature_columns(["m", "c", "c_a", "c_b", "c_class", "m_t-1"], [1], ["m"], ["c"], names) == ["m", "c_a", "c_b", "m_t-1"]
    long = modelling.level_pairs(df.withColumn("i", F.lit(1)), ["i"], ["c"])
    assert sorted(tuple(r) for r in long.collect()) == [(1, "c", "a"), (1, "c", "b")]


def test_large_and_text_ids_stay_apart(spark):
    big = 2 ** 53
    rows = [(i, 2021, m, 1.0 * m, 0) for i in (big, big + 1) for m in (1, 2, 3)]
    df = spark.createDataFrame(rows, "id long, year int, month int, milk double, disease int")
    assert modelling.anchor_keys(df).count() == 6
    wide = modelling.lagged_wide(df, df.where("month = 3"), [1, 2], ["milk"], [])
    assert sorted(r.id for r in wide.collect()) == [big, big + 1]
    text = df.withColumn("id", F.col("id").cast("string"))
    assert {r.id for r in modelling.anchor_keys(text).collect()} == {big, big + 1}
    with pytest.raises(Exception, match="not a number"):
        modelling.anchor_keys(text.withColumn("id", F.concat(F.lit("IT"), "id"))).collect()


def test_whole_chain(spark, control):
    """Raw records to sequences; every entity-month of the chain survives or drops by rule."""
    cf = construction.control_records(control)
    ids = construction.control_ids(cf)
    calving = spark.createDataFrame([(1, 1, 1, 2020, 1.0)], "idAnimale long, giorno int, mese int, anno int, NumeroFemmineNateVive double")
    events = construction.calving_events(calving, ids)
    raw = spark.createDataFrame([], "CAPO_IDENTIFICATIVO string, TIPODIAGNOSI_CODICE string, TRAT_DT_INIZIO string")
    tags = spark.createDataFrame([(1, "A")], "idAnimale long, Marca string")
    treatments = construction.treatment_events(raw, tags, ids, "MAS")
    births = spark.createDataFrame([(1, D(2018, 1, 1)), (2, D(2018, 1, 1))], "id long, birth_date date")
    empty = spark.createDataFrame([], "id long, year int, month int, day int, lactose double")
    panel_ = construction.merged_panel(cf, empty, empty.withColumnRenamed("lactose", "ec"), events, treatments, births)
    assert "day" not in panel_.columns and "Marca" not in panel_.columns and panel_.count() == cf.count()
    full = preparation.add_features(preparation.pre_process(panel_))
    filled, _ = preparation.impute(full, min_group_n=2)
    found = modelling.validated_anchors(filled)
    assert {(r.id, r.month) for r in found.collect()} == {(1, m) for m in range(4, 10)}
    seq = modelling.sequence_table(filled, found, ["milk", "fat"])
    assert seq.count() == 6


def test_first_follows_the_source_file(spark):
    rows = [(1, 2021, 3, 4, "01", 5.0, 20.0, 3.0, 4.0, "b.csv"), (1, 2021, 3, 4, "01", 2.0, 30.0, 3.5, 4.5, "a.csv")] * 2
    raw = spark.createDataFrame(rows, "idAnimale long, anno int, mese int, giorno int, codiceRazzaAIA string, LinearScore double, "
                                "LatteAlle24Ore double, ProteineAlle24Ore double, GrassoAlle24Ore double, _source_file string")
    got = construction.control_records(raw, iqr_k=1e9).first()
    assert (got.scs, got.milk, got.protein, got.fat) == (2.0, 30.0, 3.5, 4.5)
    got = construction.control_records(raw.drop("_source_file"), iqr_k=1e9).first()
    assert (got.scs, got.milk) == (2.0, 20.0)


def test_joins_and_groups_of_raw_rows_lie_in_stages_of_their_own(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    raw = spark.createDataFrame(
        [(1, 3, 5, 2020, 1.0), (1, 3, 5, 2020, 2.0), (1, 3, 5, 2020, 2.0), (1, 9, 5, 2020, 1.0), (2, 1, 1, 2021, None), (3, 1, 1, 2021, 1.0)],
        "idAnimale long, giorno int, mese int, anno int, NumeroFemmineNateVive double")
    events = construction.calving_events(raw, ids)
    assert "Join" not in plan_of(events) and "Aggregate" not in plan_of(events)  # the days are stored
    assert [(r.id, r.day, r.same_day_records) for r in events.collect()] == [(1, 3, 2)]
    report = construction.calving_report(raw, ids)
    assert all("Join" not in plan_of(r) for r in report.values())
    assert tuple(report["reconciliation"].first()) == (2, 2, 1, 3)
    assert (tuple(report["raw"].first()), tuple(report["final"].first())) == ((4, 2, 1, 2.0, 3), (1, 1, 1, 1.0, 1))
    assert report["same_day"].first()[0] == 0
