"""Exact quantiles against NumPy, under skew."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from jamscope.operators import quantiles
from jamscope.operators.quantiles import quantile_table, scalar_quantile

PROBS = {"low": 0.0, "q25": 0.25, "third": 1 / 3, "mid": 0.5, "high": 1.0}


@pytest.fixture(scope="module")
def skewed():
    """One group holds most rows, one value repeats a lot, magnitudes span many decades."""
    rng = np.random.default_rng(7)
    n = 30_000
    spread = rng.lognormal(0, 4, n) * rng.choice([-1, 1], n)
    ties = rng.integers(-3, 4, n).astype(float)
    narrow = 1000 + rng.random(n) * 1e-6
    kind = rng.choice(3, n, p=[0.4, 0.3, 0.3])
    return pd.DataFrame(
        {
            "g": rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05]),
            "x": np.choose(kind, [spread, ties, narrow]),
        }
    ).assign(g=lambda d: d["g"].where(d["g"] != "c", None))


@pytest.fixture(scope="module")
def frame(spark, skewed):
    return spark.createDataFrame(skewed, "g string, x double").cache()


def expected(values, prob, method):
    values = np.sort(values)
    if method == "nearest":
        return values[int(np.floor((len(values) - 1) * prob + 0.5))]
    return np.quantile(values, prob)


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_groups(frame, skewed, staging, method):
    table = quantile_table(frame, "x", PROBS, ["g"], method, staging)
    found = {row["g"]: row for row in table.collect()}
    assert set(found) == {"a", "b", None}
    for g, row in found.items():
        values = skewed["x"][skewed["g"].isna() if g is None else skewed["g"] == g].to_numpy()
        assert row["n"] == len(values)
        assert row["mean"] == pytest.approx(values.mean(), rel=1e-9)
        for name, prob in PROBS.items():
            assert row[name] == pytest.approx(expected(values, prob, method), rel=1e-12)


def test_whole_column(frame, skewed):
    table = quantile_table(frame, "x", PROBS)
    row = table.first()
    for name, prob in PROBS.items():
        assert row[name] == pytest.approx(np.quantile(skewed["x"], prob), rel=1e-12)


def test_small_values(spark):
    df = spark.createDataFrame([(v,) for v in (10.0, 1.0, 3.0, 2.0, None, float("nan"))], "x double")
    probs = {"a": 0.25, "b": 1 / 3, "c": 0.75, "d": 0.5}
    linear = quantile_table(df, "x", probs).first()
    assert (linear["a"], linear["b"], linear["c"]) == (1.75, 2.0, 4.75)
    # half-way ranks round up
    nearest = quantile_table(df, "x", {"d": 0.5}, method="nearest").first()
    assert nearest["d"] == 3.0


def test_infinities_and_zeros(spark):
    values = [float("-inf"), -0.0, 0.0, 5e-324, float("inf"), 1.7976931348623157e308]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = quantile_table(
        df,
        "x",
        {f"r{i}": i / 5 for i in range(6)},
        method="nearest",
    ).first()
    assert [row[f"r{i}"] for i in range(6)] == sorted(values)


def test_one_value_everywhere(spark):
    df = spark.range(5000).select(F.lit(2.8).alias("x"))
    assert scalar_quantile(df, "x", 1 / 3) == 2.8


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert scalar_quantile(df, "x", 0.5) is None


def test_no_exchange_of_single_values(frame):
    """Sketches and counts are added up before they are shuffled; only brackets' values are counted."""
    data = quantiles.known_values(frame, "x", ["g"])
    sketched = quantiles.sketches(data, ["g"])
    state = quantiles.brackets(sketched, ["g"], {"m": 0.5}, "linear", 1)
    plan = quantiles.counted(data, state, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_kll_sketch_agg_double" in plan and "partial_count" in plan
    inside = quantiles.counted(data, state, ["g"]).where("_x IS NOT NULL").agg(F.sum("_n")).first()[0]
    assert 0 < inside < frame.count() / 2


def test_brackets_are_narrowed_until_they_can_be_counted(frame, skewed, staging, monkeypatch):
    monkeypatch.setattr(quantiles, "COUNTED_ROWS", 20)
    test_groups(frame, skewed, staging, "linear")
    test_whole_column(frame, skewed)


def test_ranks_that_a_sketch_misses_are_found(frame, skewed, staging, monkeypatch):
    """A coarse sketch with a margin that is too small misses ranks; the result stays exact."""
    monkeypatch.setattr(quantiles, "SKETCH_K", 8)
    monkeypatch.setattr(quantiles, "MARGIN", 0)
    test_groups(frame, skewed, staging, "nearest")
    test_whole_column(frame, skewed)


def test_heavy_ties_between_ranks(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "COUNTED_ROWS", 10)
    for low in (1, 499, 500, 501, 999):
        df = spark.range(1000).select(F.when(F.col("id") < low, 1.0).otherwise(2.0).alias("x"))
        row = quantile_table(df, "x", {"m": 0.5, "q": 0.75}).first()
        values = np.array([1.0] * low + [2.0] * (1000 - low))
        assert (row["m"], row["q"]) == (np.quantile(values, 0.5), np.quantile(values, 0.75))
