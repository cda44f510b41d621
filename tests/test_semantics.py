"""Null, sentinel, division and ordering rules on tiny frames."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jamscope.config import ColumnMap, StudyConfig
from jamscope.functions.nulls import is_true, nan_to_null, not_within
from jamscope.functions.student_t import two_sided_p
from jamscope.functions.trips import add_speed, add_time_features, weekday_name
from jamscope.operators import aggregates, quality, stats
from jamscope.operators.cleaning import clean_audit, clean_trips, cleaning_rules

TRIP_SCHEMA = (
    "tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, PULocationID int, "
    "DOLocationID int, VendorID int, RatecodeID int, trip_distance double, passenger_count int, "
    "fare_amount double, tip_amount double, total_amount double"
)
START = dt.datetime(2026, 5, 4, 8)


def trip(minutes=10.0, start=START, pu=1, do=2, distance=2.0, passengers=1, fare=9.0, rate=1):
    end = None if start is None else start + dt.timedelta(minutes=minutes)
    return (start, end, pu, do, 1, rate, float(distance), passengers, fare, 1.0, 12.0)


def trips_of(spark, rows):
    return spark.createDataFrame(rows, TRIP_SCHEMA)


def test_time_features_keep_fractions_and_start_weeks_on_monday(spark):
    rows = [
        trip(minutes=1.5 + 0.25 / 60),
        trip(start=dt.datetime(2026, 5, 10, 23, 59)),
        trip(start=None),
    ]
    found = add_time_features(trips_of(spark, rows)).collect()
    assert found[0]["duration_min"] == pytest.approx(1.5 + 0.25 / 60, abs=1e-12)
    assert (found[0]["hour"], found[0]["dow"], found[0]["is_weekend"]) == (8, 0, 0)
    assert (found[1]["hour"], found[1]["dow"], found[1]["is_weekend"]) == (23, 6, 1)
    assert (found[2]["duration_min"], found[2]["hour"], found[2]["dow"]) == (None, None, None)
    assert found[2]["is_weekend"] == 0


def test_missing_columns_raise(spark):
    with pytest.raises(KeyError):
        add_time_features(spark.range(1))
    with pytest.raises(KeyError):
        stats.top_correlations(spark.range(1), ["a"], "b")


def test_speed_of_no_time(spark):
    df = add_time_features(trips_of(spark, [trip(minutes=0), trip(minutes=30)]))
    assert [r["speed_mph"] for r in add_speed(df).collect()] == [None, 4.0]
    with pytest.raises(Exception, match="zero or less"):
        add_speed(df, strict=True).collect()


def test_conditions_are_never_null(spark):
    df = spark.createDataFrame([(None,), (0.5,), (1.0,), (2.0,)], "x double")
    found = df.select(
        not_within(F.col("x"), 1, 2).alias("out"), is_true(F.col("x") <= 0.5).alias("low")
    ).collect()
    assert [r["out"] for r in found] == [True, True, False, False]
    assert [r["low"] for r in found] == [False, True, False, False]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"), 1), (1.0, None)], "x double, k int")
    assert nan_to_null(df).where("x IS NULL").count() == 1


def test_weekday_names(spark):
    df = spark.range(7).select(weekday_name(F.col("id").cast("int")).alias("d"))
    assert [r["d"] for r in df.collect()] == ["월", "화", "수", "목", "금", "토", "일"]


def test_unknown_values_in_rules(spark):
    """Unknown time, duration and speed remove a row; unknown fare and distance do not."""
    rows = [(None,) * 11]
    df = trips_of(spark, rows)
    by_name = {r.name: r.removes for r in cleaning_rules()}
    verdicts = df.select(
        *[c.alias(n.replace(" ", "_")) for n, c in by_name.items() if c is not None]
    ).first()
    assert verdicts["outside_observation_period"]
    assert verdicts["duration_out_of_range"]
    assert verdicts["speed_out_of_range"]
    assert not verdicts["fare_not_positive"]
    assert not verdicts["distance_too_long"]
    assert not verdicts["unknown_zone"]
    assert not verdicts["same_zone_but_far"]


def test_audit_counts_each_row_once(spark):
    good = trip()
    rows = [
        good,
        good,
        good,
        trip(passengers=None),
        trip(passengers=None),
        trip(start=dt.datetime(2009, 1, 1)),
        trip(start=dt.datetime(2026, 6, 1)),
        trip(minutes=0.5),
        trip(minutes=-5),
        trip(minutes=181, distance=60),
        trip(minutes=180, distance=60),
        trip(minutes=60, distance=0.9),
        trip(fare=0.0),
        trip(fare=0.0),
        trip(minutes=60, distance=51),
        trip(do=265),
        trip(minutes=60, distance=10.5, pu=7, do=7),
        trip(minutes=60, distance=10.0, pu=7, do=7),
    ]
    df = trips_of(spark, rows)
    audit = {r["rule"]: (r["removed"], r["remaining"]) for r in clean_audit(df).collect()}
    assert audit == {
        "start": (0, 18),
        "required column missing": (2, 16),
        "duplicate rows": (3, 13),
        "outside observation period": (2, 11),
        "duration out of range": (3, 8),
        "speed out of range": (1, 7),
        "fare not positive": (1, 6),
        "distance too long": (2, 4),
        "unknown zone": (1, 3),
        "same zone but far": (1, 2),
    }
    assert clean_trips(df).count() == 2


def test_audit_of_nothing(spark):
    audit = clean_audit(trips_of(spark, [])).collect()
    assert len(audit) == 10
    assert all(r["removed"] == 0 and r["remaining"] == 0 for r in audit)


def test_sentinel_share_counts_null_rows(spark):
    rows = [trip(rate=99), trip(rate=None), trip(rate=1), trip(pu=264)]
    found = {r["item"]: r for r in quality.sentinel_profile(trips_of(spark, rows)).collect()}
    assert (found["unknown_ratecode"]["n_rows"], found["unknown_ratecode"]["pct"]) == (1, 25.0)
    assert (found["unknown_zone"]["n_rows"], found["unknown_zone"]["pct"]) == (1, 25.0)


def frame_of_masks(spark, masks):
    width = len(masks[0])
    names = "abcdef"[:width]
    rows = [tuple(None if bit == "1" else 1 for bit in mask) for mask in masks]
    return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))


@pytest.mark.parametrize(
    ("masks", "verdict"),
    [
        (["000", "000"], (False, "", 0, 0.0)),
        (["011", "000", "011", "000"], (True, "b,c", 2, 0.5)),
        # the first column with NULLs is alone, so a later pair is not reported
        (["1011", "0011", "0000", "0000"], (False, "a,c,d", 0, 0.0)),
        (["0110", "0110", "0001", "0000"], (True, "b,c", 2, 0.5)),
        (["100", "000"], (False, "a", 0, 0.0)),
    ],
)
def test_missing_block(spark, masks, verdict):
    row = quality.missing_block(frame_of_masks(spark, masks)).first()
    assert tuple(row) == verdict


def test_missing_patterns(spark):
    found = quality.missing_patterns(frame_of_masks(spark, ["01", "01", "10", "00"])).collect()
    assert {(r["pattern"], r["n_rows"]) for r in found} == {("01", 2), ("10", 1), ("00", 1)}


def test_null_profile_with_and_without_patterns(spark):
    df = frame_of_masks(spark, ["011", "011", "001", "000"])
    expected = {("b", 2, 50.0, 5), ("c", 3, 75.0, 5)}
    patterns = quality.missing_patterns(df)
    assert {tuple(r) for r in quality.null_profile(df).collect()} == expected
    assert {tuple(r) for r in quality.null_profile(df, patterns).collect()} == expected


def test_null_counts_of_tables_that_differ(spark):
    a = spark.createDataFrame([(None, 1), (2, None)], "a int, b int")
    b = spark.createDataFrame([(None,), (None,)], "a int")
    found = {r["column"]: r for r in quality.null_count_reconcile(a, b).collect()}
    assert (found["a"]["n_null_left"], found["a"]["n_null_right"], found["a"]["match"]) == (1, 2, False)
    assert (found["b"]["n_null_right"], found["b"]["match"]) == (None, False)
    assert found["a"]["all_match"] is False
    assert found["a"]["total_null_left"] == 2


def test_duplicates_treat_nulls_and_zeros_alike(spark):
    rows = [(None, 0.0), (None, -0.0), (1, 2.0), (1, 2.0), (1, 3.0)]
    df = spark.createDataFrame(rows, "a int, b double")
    assert tuple(quality.duplicate_count(df).first()) == (5, 2)
    assert quality.dedup_rows(df).count() == 3


def test_copies_are_told_by_whole_rows(spark, staging):
    """NULLs in different columns, signs of zero and NaN; copies of one row in many partitions."""
    nan = float("nan")
    rows = [(None, 1.0), (1, None), (1, None), (None, None), (1, 1.0), (2, 0.0), (2, -0.0)]
    rows += [(3, nan)] * 3 + [(7, 7.0)] * 500
    df = spark.createDataFrame(rows, "a int, b double").repartition(5)
    found = {(r["a"], str(r["b"]).lstrip("-")): r[quality.COPIES] for r in quality.count_copies(df, staging).collect()}
    assert found == {
        (None, "1.0"): 1, (1, "None"): 2, (None, "None"): 1, (1, "1.0"): 1,
        (2, "0.0"): 2, (3, "nan"): 3, (7, "7.0"): 500,
    }


def test_rows_without_copies_are_not_shuffled(spark, staging):
    df = spark.range(1000).select("id", F.col("id").cast("string").alias("text"))
    counted = quality.count_copies(df, staging)
    assert counted.where(F.col(quality.COPIES) != 1).count() == 0 and counted.count() == 1000
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_colliding_digests_do_not_merge_rows(spark, staging, monkeypatch):
    monkeypatch.setattr(quality.F, "xxhash64", lambda *columns: F.lit(5).cast("bigint"))
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, None)], "a int, b string")
    found = {r["a"]: r[quality.COPIES] for r in quality.count_copies(df, staging).collect()}
    assert found == {1: 2, 2: 1, 3: 1}


def test_many_repeated_digests_do_not_move_whole_tables(spark, staging):
    """However large the list of repeated digests is said to be, rows without a copy stay put."""
    ids = spark.range(3000).unionByName(spark.range(300)).unionByName(spark.range(20))
    df = ids.select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("even"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        counted = quality.count_copies(df, staging)
        plan = counted._jdf.queryExecution().executedPlan().toString()
        found = {r["id"]: r[quality.COPIES] for r in counted.collect()}
    finally:
        spark.conf.set(key, before)
    assert "SortMergeJoin" not in plan
    assert found == {i: 1 + (i < 300) + (i < 20) for i in range(3000)}


def test_a_full_filter_flags_more_rows_and_gives_the_same_counts(spark, staging, monkeypatch):
    monkeypatch.setattr(quality, "MOST_FILTER_BITS", 7)
    df = spark.range(500).unionByName(spark.range(200)).select("id", F.lit("x").alias("text"))
    counted = quality.count_copies(df, staging).collect()
    assert {r["id"]: r[quality.COPIES] for r in counted} == {i: 1 + (i < 200) for i in range(500)}
    assert len(counted) == 500


def test_quantiles_of_two_tables(spark, staging):
    left = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "x double")
    right = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 10.0, 10.0, None)], "x double")
    rows = {r["prob"]: r for r in quality.quantile_reconcile(left, right, "x", staging=staging).collect()}
    assert tuple(rows[0.5])[1:] == (2.5, 3.0, 3.0, 3.0, True, True)
    assert tuple(rows[0.25])[1:] == (1.75, 2.0, 2.0, 2.0, True, True)
    same = quality.quantile_reconcile(left, left, "x", [0.0], staging).first()
    assert tuple(same) == (0.0, 1.0, 1.0, 1.0, 1.0, False, False)
    none = quality.quantile_reconcile(left, left.limit(0), "x", [0.5], staging).first()
    assert tuple(none) == (0.5, 2.5, 3.0, None, None, True, True)


def test_reconcile_matches_null_keys(spark):
    a = spark.createDataFrame([(1, 5), (None, 2)], "k int, n int")
    b = spark.createDataFrame([(None, 3), (2, 4)], "k int, n int")
    found = {tuple(r) for r in quality.aggregate_reconcile(a, b, "k", ["n"]).collect()}
    assert found == {(1, 5, None), (None, 2, 3), (2, None, 4)}
    summary = quality.aggregate_reconcile_summary(a, b, "k", "n").first()
    assert tuple(summary) == (2, 2, 3)


def test_passenger_groups_keep_or_drop_null(spark, staging):
    rows = [trip(), trip(minutes=20), trip(passengers=None), trip(distance=0.0), trip(minutes=0)]
    df = trips_of(spark, rows)
    kept = aggregates.speed_by_passengers(df, staging=staging).collect()
    assert [(r["passenger_count"], r["trips"]) for r in kept] == [(None, 1), (1, 2)]
    assert kept[1]["median_speed"] == 9.0
    dropped = aggregates.speed_by_passengers(df, keep_null_group=False, staging=staging).collect()
    assert [(r["passenger_count"], r["trips"]) for r in dropped] == [(1, 2)]


@pytest.mark.parametrize("complete", [True, False])
def test_correlation_of_a_constant(spark, complete):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (1.0, 4.0, 3.0), (1.0, 5.0, 2.0)], "x double, y double, z double")
    found = {
        (r["row_var"], r["col_var"]): r["r"]
        for r in stats.correlation_matrix(df, ["x", "y", "z", "absent"], complete).collect()
    }
    assert len(found) == 9
    assert found["x", "x"] is None
    assert found["x", "y"] is None
    assert found["y", "y"] == 1.0
    assert found["y", "z"] == pytest.approx(found["z", "y"])


def test_correlation_uses_pairs_of_known_values(spark):
    rows = [(1.0, 2.0, None), (2.0, 3.0, 1.0), (3.0, None, 2.0), (4.0, 9.0, 7.0), (5.0, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    expected = df.toPandas().corr()
    for r in stats.correlation_matrix(df, ["x", "y", "z"]).collect():
        assert r["r"] == pytest.approx(expected.loc[r["row_var"], r["col_var"]], abs=1e-12)


def test_top_correlations_put_unknown_last(spark):
    rows = [("s", "s", 1.0), ("s", "b", None), ("s", "a", -0.9), ("s", "d", 0.9), ("s", "c", 0.1)]
    matrix = spark.createDataFrame(rows, "row_var string, col_var string, r double")
    found = stats.top_correlations(matrix, ["s", "a", "b", "c", "d"], "s", 3).collect()
    assert [r["variable"] for r in found] == ["a", "d", "c"]


def test_extremes_prefer_the_earlier_hour(spark):
    rows = [(5, 9.0), (3, 9.0), (7, 2.0), (6, 2.0), (1, None)]
    df = spark.createDataFrame(rows, "hour int, mean_speed double")
    assert tuple(aggregates.hourly_extremes(df).first()) == (6, 2.0, 3, 9.0, 4.5)


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(v), v % 2) for v in range(101)], "v double, jam_abs int")
    found = aggregates.distance_histogram(
        df, ColumnMap(distance="v"), max_distance=100.0, bins=10
    ).collect()
    per_bin = {}
    for r in found:
        per_bin[r["bin"]] = per_bin.get(r["bin"], 0) + r["n"]
    assert per_bin == {**{b: 10 for b in range(9)}, 9: 11}
    for label in (0, 1):
        assert sum(r["density"] * 10 for r in found if r["label"] == label) == pytest.approx(1.0)


def test_zone_ranking_has_a_floor_and_a_tie_rule(spark):
    rows = [(z, j, 10.0) for z, n, k in ((1, 4, 2), (2, 4, 3), (3, 4, 2), (4, 1, 1)) for j in [1] * k + [0] * (n - k)]
    df = spark.createDataFrame(rows, "PULocationID int, jam_abs int, speed_mph double")
    found = aggregates.zone_jam_topk(df, min_trips=2, k=2).collect()
    assert [(r["PULocationID"], r["jam_pct"]) for r in found] == [(2, 75.0), (1, 50.0)]


def test_welch(spark):
    rows = [(0, 1.0), (0, 2.0), (0, 4.0), (1, 3.0), (1, 5.0), (1, 9.0), (1, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    test = stats.WelchTest("k", F.col("k") == 0, F.col("v"))
    row = stats.welch_tests(df, [test]).first()
    assert (row["n_a"], row["n_b"]) == (3, 3)
    assert row["t"] == pytest.approx(-1.6903085094570334)
    assert row["dof"] == pytest.approx(2.9411764705882355)
    # the density of Student's t, summed up between -t and t
    u = np.linspace(-abs(row["t"]), abs(row["t"]), 200_001)
    dof = row["dof"]
    scale = math.gamma((dof + 1) / 2) / math.gamma(dof / 2) / math.sqrt(dof * math.pi)
    inside = np.trapezoid(scale * (1 + u * u / dof) ** (-(dof + 1) / 2), u)
    assert row["p"] == pytest.approx(1 - inside, abs=1e-8)
    assert row["verdict"] == "not significant"
    with pytest.raises(Exception, match="fewer than two values"):
        stats.welch_tests(df.where("k = 0"), [test]).collect()


@pytest.mark.parametrize(
    ("t", "dof", "p"),
    [
        # closed forms: dof 1 is the Cauchy distribution, dof 2 is algebraic
        (1.0, 1.0, 0.5),
        (-3.0, 1.0, 1 - 2 / math.pi * math.atan(3.0)),
        (2.0, 2.0, 1 - 2 / math.sqrt(6.0)),
        (0.0, 7.0, 1.0),
        # critical values of printed tables
        (2.228138851964939, 10.0, 0.05),
        (2.0422724563012373, 30.0, 0.05),
        # normal limit
        (1.959963984540054, 1e13, 0.05),
        (-721.3026, 1.6e6, 0.0),
    ],
)
def test_student_t(spark, t, dof, p):
    df = spark.createDataFrame([(t, dof)], "t double, dof double")
    assert df.select(two_sided_p("t", "dof")).first()[0] == pytest.approx(p, abs=1e-10)


def test_config_defaults():
    config = StudyConfig()
    assert config.columns.features == config.columns.numeric_features + config.columns.nominal_features
    after_the_trip = {"duration_min", "speed_mph", "fare_amount", "tip_amount", "total_amount"}
    assert not after_the_trip & set(config.columns.features)
    assert after_the_trip < set(config.columns.statistics)
