"""Quantiles by narrowing against numpy, with intervals so small that every round is taken."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panel_engine.operators import narrowing
from panel_engine.operators.narrowing import chains, level_quantiles, total_quantiles

INF = float("inf")
PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def expected(values, probs=PROBS):
    return len(values), [pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-300) for p in probs]


COLUMNS = {
    "spread": lambda r: r.uniform(-5, 5), "narrow": lambda r: float(r.randint(0, 2)), "one": lambda r: 7.0,
    "tailed": lambda r: math.exp(r.gauss(0, 8)), "tiny": lambda r: r.choice([0.0, -0.0, 5e-324, 1e-323]),
    "wide": lambda r: r.choice([-1.7e308, 1.7e308, 0.0, 1.0, r.uniform(-1e308, 1e308)]),
}


@pytest.mark.parametrize("kind", COLUMNS)
def test_whole_tables(spark, monkeypatch, kind):
    monkeypatch.setattr(narrowing, "BUCKETS", 8)
    rnd = random.Random(kind)
    values = [COLUMNS[kind](rnd) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    n, got = total_quantiles(df, F.col("v"), PROBS, limit=5)
    if kind != "wide":
        assert (n, got) == expected(values)
    else:  # numpy's own interpolation overflows here
        values.sort()
        assert n == 400 and (got[0], got[-1]) == (values[0], values[-1]) and values[199] <= got[3] <= values[200]
    assert total_quantiles(df.where("v is null"), F.col("v"), PROBS) == (0, [None] * len(PROBS))


def test_infinite_ends(spark):
    df = spark.createDataFrame([(v,) for v in [-INF] * 3 + [1.0, 2.0, 3.0] + [INF] * 3], "v double")
    for limit in (1, 100):
        assert total_quantiles(df, F.col("v"), [0.0, 0.5, 1.0], limit) == (9, [-INF, 2.0, INF])


def frame(spark, n=900):
    """One hot entity, null keys, missing cells, a measure that is always missing."""
    rnd = random.Random(2)
    rows = [(0 if rnd.random() < 0.35 else rnd.randint(1, 60), rnd.choice(["x", "y", None]), rnd.choice(["k", None, "m"]),
             rnd.uniform(0, 9) if rnd.random() < 0.8 else None, float(rnd.randint(0, 3)), None) for _ in range(n)]
    return spark.createDataFrame(rows, "id int, p string, b string, u double, w double, none double").repartition(4), rows


@pytest.mark.parametrize("null_keys", [True, False])
@pytest.mark.parametrize("limit", [3, 40, 10**6])
def test_levels(spark, limit, null_keys):
    df, rows = frame(spark)
    levels = [["id", "p", "b"], ["id", "p"], ["b", "p"], ["p"], []]
    got = {}
    for r in level_quantiles(df, ["u", "w", "none"], [0.25, 0.5], levels, limit, null_keys).collect():
        key = (r.level, tuple(r[k] for k in levels[r.level]), r.feature)
        assert key not in got and all(r[k] is None for k in ("id", "p", "b") if k not in levels[r.level])
        got[key] = (r.n, [r.q_0, r.q_1])
    want = {}
    place = {"id": 0, "p": 1, "b": 2}
    for i, level in enumerate(levels):
        groups = {}
        for row in rows:
            key = tuple(row[place[k]] for k in level)
            if null_keys or None not in key:
                for f in (0, 1):
                    if row[3 + f] is not None:
                        groups.setdefault((i, key, f), []).append(row[3 + f])
        want |= {k: expected(v, [0.25, 0.5]) for k, v in groups.items()}
    assert got == want


def test_nothing_to_find(spark):
    df, _ = frame(spark)
    assert level_quantiles(df.where("false"), ["u"], [0.5], [["id"], []]).collect() == []
    assert level_quantiles(df.where("false"), ["u"], [0.5], [["id"]]).columns == ["level", "id", "feature", "n", "q_0"]
    assert level_quantiles(df, ["none"], [0.5], [["id"], []], limit=2).collect() == []


def test_chains():
    assert chains([["a", "b"], ["a"], ["c", "d"], ["c"], []]) == [[0, 1], [2, 3, 4]]
    assert chains([[]]) == [[0]]
