from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panel_engine.operators import impute, narrowing, quality
from panel_engine.operators.impute import HierarchicalImputer, HierarchicalImputerModel
from panel_engine.plans import preparation
from tests.conftest import plan_of

LEVELS = dict(entity_levels=[["id", "p"]], population_levels=[["b", "p"]])


def frame(spark, n=300, seed=5):
    rng = random.Random(seed)
    data = [(i, rng.randint(1, 12), rng.choice(["x", "y", None]), rng.choice(["k", "l"]), rng.randint(1, 8),
             None if rng.random() < 0.4 else rng.uniform(0, 40), None if rng.random() < 0.3 else float(rng.randint(0, 5)))
            for i in range(n)]
    return spark.createDataFrame(data, "row int, id int, p string, b string, age int, milk double, scs double")


def pandas_fill(pdf, column, min_n):
    """Straight restatement of the hierarchy on a small frame."""
    out = []
    known = pdf[pdf[column].notna()]
    for _, r in pdf.iterrows():
        if pd.notna(r[column]):
            out.append(r[column])
            continue
        value = np.nan
        for keys in (["id", "p"], ["b", "p"]):
            if any(pd.isna(r[k]) for k in keys):
                continue
            group = known[(known[keys] == r[keys]).all(axis=1)][column]
            if len(group) >= min_n:
                value = group.median()
                break
        out.append(value if pd.notna(value) else known[column].median())
    return out


def test_fill_equals_restatement(spark):
    df = frame(spark)
    imputer = HierarchicalImputer(columns=["milk", "scs"], min_group_n=3, clip_imputed=False, **LEVELS)
    got = imputer.fit_transform(df).orderBy("row").toPandas()
    pdf = df.orderBy("row").toPandas()
    for c in ("milk", "scs"):
        np.testing.assert_allclose(got[c].to_numpy(), pandas_fill(pdf, c, 3), rtol=1e-12)


def test_observed_cells_stay_and_state_survives_storage(spark, tmp_path):
    df = frame(spark)
    model = HierarchicalImputer(columns=["milk", "scs"], min_group_n=3, **LEVELS).fit(df)
    again = HierarchicalImputerModel.load(spark, model.save(str(tmp_path / "model")))
    a, b = (m.transform(df).orderBy("row").toPandas() for m in (model, again))
    pd.testing.assert_frame_equal(a, b)
    before = df.orderBy("row").toPandas()
    known = before["milk"].notna()
    assert (a["milk"][known] == before["milk"][known]).all() and a["milk"].notna().all()
    assert list(a.columns) == df.columns


def test_support_clip_and_fallback(spark):
    df = spark.createDataFrame([(1, "a", 900.0)] * 3 + [(1, "a", None), (2, None, None)], "id int, p string, milk double")
    kw = dict(columns=["milk"], entity_levels=[["id", "p"]], population_levels=[])
    meta = HierarchicalImputer(min_group_n=3, **kw).fit_transform(df, metadata=True)
    filled = meta.where("__level_milk is not null").orderBy("id").collect()
    assert [(r.milk, r["__level_milk"], r["__clipped_milk"]) for r in filled] == [(700.0, "id -> p", True), (700.0, "GLOBAL", True)]
    assert df.where("milk > 700").count() == meta.where("milk > 700").count() == 3  # observed outliers stay
    none = HierarchicalImputer(min_group_n=4, global_fallback=False, **kw).fit_transform(df)
    assert none.where("milk is null").count() == 2
    usage = {(r.feature, r.level): (r.filled, r.clipped) for r in impute.level_usage(meta, ["milk"]).collect()}
    assert usage == {("milk", "id -> p"): (1, 1), ("milk", "GLOBAL"): (1, 1)}


def test_usage_is_counted_while_the_result_is_stored(spark):
    df = frame(spark).withColumnRenamed("id", "cow").withColumn("breed", F.col("b")).withColumn("lactation_phase", F.col("p"))
    filled, model, usage = preparation.impute_counted(df, min_group_n=3)
    want = impute.level_usage(model.transform(df, metadata=True), ["milk", "scs"])
    key = lambda d: sorted(map(tuple, d.select("feature", "level", "filled", "clipped").collect()))
    assert key(usage) == key(want) and usage.count() > 2
    assert sorted(filled.columns) == sorted(df.columns) and filled.count() == df.count()
    nothing, _, none = preparation.impute_counted(df.where("false"), model)
    assert nothing.count() == none.count() == 0


def test_missing_key_columns_shrink_levels():
    imputer = HierarchicalImputer(
        entity_levels=[["id", "p", "age_class"], ["id", "p"]], population_levels=[["breed", "p"], ["p"], ["breed"]])
    assert imputer.levels(["id", "p"]) == [["id", "p"], ["p"]]


def test_transform_unseen_and_empty_state(spark):
    train = spark.createDataFrame([(1, "a", None)], "id int, p string, milk double")
    model = HierarchicalImputer(columns=["milk"], min_group_n=1, entity_levels=[["id", "p"]], population_levels=[]).fit(train)
    assert model.transform(train).first().milk is None
    with pytest.raises(ValueError):
        HierarchicalImputer(columns=["nope"]).fit(train)


def pandas_wasserstein(x, y):
    points = np.sort(np.concatenate([x, y]))
    fx = np.searchsorted(np.sort(x), points[:-1], side="right") / len(x)
    fy = np.searchsorted(np.sort(y), points[:-1], side="right") / len(y)
    return float(np.sum(np.abs(fx - fy) * np.diff(points)))


def test_wasserstein(spark):
    rng = np.random.default_rng(1)
    samples = {"a": (rng.normal(size=70), rng.normal(1, 2, size=50)), "b": (np.array([3.0, 3.0]), np.array([3.0])),
               "c": (np.array([3.0, 3.0]), np.array([4.0]))}

    def cells(i):
        return spark.createDataFrame([(g, float(v)) for g, s in samples.items() for v in s[i]], "g string, value double")

    got = {r.g: r for r in quality.wasserstein(cells(0), cells(1), ["g"]).collect()}
    x, y = samples["a"]
    assert got["a"].distance == pytest.approx(pandas_wasserstein(x, y))
    q1, q3 = np.quantile(x, [0.25, 0.75])
    assert got["a"].normalized_wasserstein == pytest.approx(pandas_wasserstein(x, y) / (q3 - q1))
    assert (got["b"].distance, got["b"].normalized_wasserstein) == (0.0, 0.0)
    assert (got["c"].distance, got["c"].normalized_wasserstein) == (1.0, None)
    same = quality.wasserstein(cells(0), cells(0), ["g"]).collect()
    assert all(r.distance == 0.0 for r in same)
    back = {r.g: r.distance for r in quality.wasserstein(cells(1), cells(0), ["g"]).collect()}
    assert back["a"] == pytest.approx(got["a"].distance)


def test_correlation_is_pairwise_and_tolerates_constants(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0), (None, 9.0, 5.0), (4.0, 7.0, 5.0)], "a double, b double, c double")
    got = {(r.feature_a, r.feature_b): r["corr"] for r in quality.correlation_pairs(df, ["a", "b", "c"]).collect()}
    want = df.toPandas().corr().loc["a", "b"]
    assert got["a", "b"] == pytest.approx(want) and got["a", "c"] is None and got["b", "c"] is None


def test_report_against_pandas(spark):
    pre = frame(spark).select("row", "milk", "scs", F.col("p").alias("season"))
    post = pre.withColumn("milk", F.coalesce("milk", F.lit(20.0))).withColumn("scs", F.coalesce("scs", F.lit(2.0)))
    report = preparation.imputation_report(pre, post, ["milk", "scs"], ["season"])
    levels = {(r.stratum, r.level): r for r in report["levels"].collect()}
    assert set(levels) == {("__all__", "__all__"), ("season", "x"), ("season", "y"), ("season", "NA")}
    a, b = pre.orderBy("row").toPandas(), post.orderBy("row").toPandas()
    for key, mask in {("__all__", "__all__"): a.row >= 0, ("season", "NA"): a.season.isna(), ("season", "x"): a.season == "x"}.items():
        x, y = a[mask], b[mask]
        delta = abs(x[["milk", "scs"]].corr().iloc[0, 1] - y[["milk", "scs"]].corr().iloc[0, 1])
        assert levels[key].n_rows == mask.sum()
        assert levels[key].mean_abs_delta_corr == pytest.approx(delta, abs=1e-4)
    feature = {(r.stratum, r.level, r.feature): r for r in report["features"].collect()}
    r = feature["__all__", "__all__", "milk"]
    assert r.pct_missing_pre == pytest.approx(100 * a.milk.isna().mean(), abs=0.01) == r.pct_imputed
    iqr = np.subtract(*np.quantile(a.milk.dropna(), [0.75, 0.25]))
    assert r.normalized_wasserstein == pytest.approx(pandas_wasserstein(a.milk.dropna(), b.milk) / iqr, abs=1e-4)


def test_lacking_rows_meet_each_chain_of_levels_once(spark):
    df = frame(spark).withColumn("q", F.col("row") % 2)
    levels = dict(entity_levels=[["id", "p", "q"], ["id", "p"], ["id"]], population_levels=[["b", "p"], ["b"]])
    model = HierarchicalImputer(columns=["milk", "scs"], min_group_n=3, clip_imputed=False, **levels).fit(df)
    plan = plan_of(model.transform(df))
    assert "Generate" not in plan  # no row per level
    assert sorted(model.tables) == [2, 5]  # finer groups lie in the rows of the coarsest
    groups = model.stats.groupBy("feature", "level").count().count()
    assert groups == 12 and {r.n >= 3 for r in model.stats.collect()} == {True}


def test_groups_beyond_a_row_are_narrowed_and_filled_alike(spark, monkeypatch):
    df = frame(spark).withColumn("q", F.col("row") % 2)
    imputer = HierarchicalImputer(columns=["milk", "scs"], min_group_n=3, entity_levels=[["id", "p", "q"], ["id"]], population_levels=[["b", "p"]])
    want = imputer.fit_transform(df).orderBy("row").toPandas()
    monkeypatch.setattr(narrowing, "PACK", 10)
    model = imputer.fit(df)
    assert sorted(model.tables) == [0, 1, 2, 3]
    pd.testing.assert_frame_equal(model.transform(df).orderBy("row").toPandas(), want)


def test_both_reports_share_their_counts_and_their_order(spark, monkeypatch):
    labels, store = [], quality.materialize
    monkeypatch.setattr(quality, "materialize", lambda df, label="table": labels.append(label) or store(df, label))
    pre = frame(spark).select("milk", "scs", F.col("p").alias("season"))
    preparation.imputation_report(pre, pre.fillna(3.0, ["milk"]), ["milk", "scs"], ["season"])
    assert labels.count("moments") == 2 and labels.count("ranges") == labels.count("offsets") == 1


def test_ranges_stay_small_and_give_the_same_distances(spark, monkeypatch):
    stored, store = {}, quality.materialize
    monkeypatch.setattr(quality, "materialize", lambda df, label="table": stored.setdefault(label, store(df, label)))
    pre = frame(spark, 600).select("milk", "scs", F.col("p").alias("season"))
    post = pre.fillna(20.0, ["milk"])
    run = lambda: sorted(map(tuple, quality.stratified_wasserstein(pre, post, ["milk", "scs"], ["season"]).collect()))
    want = run()
    stored.clear()
    monkeypatch.setattr(quality, "RANGE", 20, raising=False)
    for a, b in zip(run(), want, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9)
    sizes = [r["count"] for r in stored["ranges"].groupBy("__p").count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 60
