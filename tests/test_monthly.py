from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panel_engine import config
from panel_engine.plans import construction
from panel_engine.plans.monthly import MonthlyCalvings, MonthlyControl, MonthlyMeasure
from panel_engine.sources.readers import SOURCE_FILE
from panel_engine.sources.state import PeriodState

CONTROL = ("idAnimale long, anno int, mese int, giorno int, codiceRazzaAIA string, LinearScore double, LatteAlle24Ore double, "
           "ProteineAlle24Ore double, GrassoAlle24Ore double, Lattosio double, NumeroFemmineNateVive double")


def months(spark, n=4, seed=3):
    """Files of one month each, the last one reaching back into the first; days and rows repeat."""
    rnd, files = random.Random(seed), {}
    for m in range(1, n + 1):
        rows = []
        for _ in range(60):
            month = 1 if m == n and rnd.random() < 0.4 else m
            rows.append((rnd.randint(1, 9), 2019 if month < n else 2020, month, rnd.randint(1, 4), rnd.choice(["01", "02", "04", None]),
                         *[rnd.choice([None, float(rnd.randint(1, 30))]) for _ in range(5)], float(rnd.randint(-1, 2))))
        files[f"AC-{m:02}"] = spark.createDataFrame(rows + rows[:5], CONTROL)
    return files


def together(files):
    out = None
    for name, df in sorted(files.items()):
        df = df.withColumn(SOURCE_FILE, F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    names = sorted(a.columns)
    key = lambda df: sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    assert key(a) == key(b)


def test_every_prefix_a_replaced_and_a_withdrawn_file(spark, tmp_path):
    files, held = months(spark), {}
    ids = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    control = MonthlyControl(spark, f"{tmp_path}/control")
    measure = MonthlyMeasure(spark, f"{tmp_path}/measure", config.LACTOSE, "lactose")
    calvings = MonthlyCalvings(spark, f"{tmp_path}/calvings")

    def check():
        raw = together(held)
        same(control.records(), construction.control_records(raw))
        same(measure.records(ids), construction.daily_measure(raw, ids, config.LACTOSE, "lactose"))
        same(calvings.records(ids), construction.calving_events(raw, ids))

    for name, df in files.items():
        held[name] = df
        touched = [s.update({name: df}) for s in (control, measure, calvings)]
        # the month itself, and the first one, into which the last file reaches
        assert touched[0] == ([(2019, 1), (2020, 4)] if name == "AC-04" else [(2019, int(name[-2:]))])
        check()
    held["AC-02"] = months(spark, seed=9)["AC-02"]
    for s in (control, measure, calvings):
        s.update({"AC-02": held["AC-02"]})
    check()
    del held["AC-04"]
    for s in (control, measure, calvings):
        s.update(withdrawn=["AC-04"])
    check()


def counting(spark, root):
    return PeriodState(spark, root, ["m"], lambda rows: rows.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n")),
                       lambda parts: parts.groupBy("m", "k").agg(F.sum("n").alias("n")))


def test_a_failed_update_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "m int, k string")
    state = counting(spark, f"{tmp_path}/s")
    with pytest.raises(ValueError):
        state.merged()
    assert state.update({"x": df}) == [(None,), (1,)]
    before = sorted(map(tuple, state.merged().collect()), key=repr)

    def broken(parts):
        return parts.groupBy("m", "k").agg(F.sum("n").alias("n")).withColumn("n", F.raise_error(F.lit("lost")).cast("long"))

    bad = counting(spark, f"{tmp_path}/s")
    bad.merge = broken
    with pytest.raises(Exception, match="lost"):
        bad.update({"y": df, "x": df.limit(1)})
    assert sorted(map(tuple, state.merged().collect()), key=repr) == before and set(state.manifest()["files"]) == {"x"}
    # a second writer with the same number fails as well
    doc = state.manifest()
    with pytest.raises(Exception, match="(?i)exists"):
        state.versions.commit(doc)
    with pytest.raises(ValueError):
        state.update(withdrawn=["z"])
    state.update({"y": df})
    assert {tuple(r) for r in state.merged().select("k", "n").collect()} == {("a", 4), ("b", 2)}
    state.update(withdrawn=["x", "y"])
    assert state.merged().collect() == []
    state.update({"w": df.where("false")})  # a file without rows
    assert state.merged().collect() == [] and state.partials().collect() == []
