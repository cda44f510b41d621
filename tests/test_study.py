"""Sources, sinks, staging and whole studies."""

from __future__ import annotations

import os
import subprocess
import sys
from dataclasses import replace

import pytest
from conftest import TESTDATA
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from jamscope.config import StudyConfig
from jamscope.functions.trips import add_time_features
from jamscope.operators import (
    aggregates,
    cells,
    cleaning,
    forest,
    labels,
    metrics,
    quality,
    stats,
)
from jamscope.operators.quantiles import known_values, sketches
from jamscope.plans.order_trips import order_trip_config, order_trips
from jamscope.plans.study import TripStudy
from jamscope.sources.tables import (
    available_columns,
    first_existing,
    read_table,
    shape_reconcile,
    write_tables,
)
from jamscope.staging import StagingArea, checkpoint_root


def plan_of(df) -> str:
    utils = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    return utils.explainString(df._jdf.queryExecution(), "formatted")


def test_read_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b")], "x double, s string")
    df.write.parquet(path)
    assert read_table(spark, path).where("x IS NULL").count() == 1
    assert read_table(spark, [path, path], ["s"]).count() == 4
    with pytest.raises(RuntimeError, match="cannot read"):
        read_table(spark, str(tmp_path / "absent"))


def test_first_existing(spark, tmp_path):
    there = str(tmp_path / "there")
    spark.range(1).write.parquet(there)
    assert first_existing(spark, [str(tmp_path / "absent"), there]) == there
    with pytest.raises(FileNotFoundError, match="absent"):
        first_existing(spark, [str(tmp_path / "absent")])


def test_available_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert available_columns(df, ["b", "c", "a"]) == ["b", "a"]


def test_shapes(spark):
    a = spark.range(3)
    assert shape_reconcile(a, a).first()["shape_match"]
    assert not shape_reconcile(a, spark.range(4)).first()["shape_match"]
    assert not shape_reconcile(a, a.withColumn("x", F.lit(1))).first()["shape_match"]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_write_tables(spark, tmp_path, fmt):
    tables = {"a": spark.range(3), "b": spark.createDataFrame([("x", 1.5)], "s string, v double")}
    paths = write_tables(tables, str(tmp_path), fmt)
    reader = spark.read.option("header", True)
    assert getattr(reader, fmt)(paths["a"]).count() == 3
    assert getattr(reader, fmt)(paths["b"]).columns == ["s", "v"]
    with pytest.raises(ValueError, match="format"):
        write_tables(tables, str(tmp_path), "xml")


def test_staging_goes_where_the_session_says(spark, small_study):
    assert small_study.clean.path.startswith(checkpoint_root(spark))
    assert small_study.clean.frame.count() == small_study.clean.rows


def test_period_reaches_the_scan(small_study):
    from jamscope.operators.cleaning import clean_trips

    config = small_study.config
    plan = plan_of(clean_trips(small_study.raw, config.columns, config.cleaning))
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(pickup_ts" in pushed
    assert "LessThan(pickup_ts" in pushed


def test_speed_aggregate_reads_few_columns(small_study):
    c = small_study.config.columns
    scan = small_study.raw.where(F.col(c.distance) > 0)
    data = known_values(scan, F.col(c.distance) / F.col(c.passengers))
    plan = plan_of(sketches(data, ["_all"]))
    schemas = [line for line in plan.split("\n") if "ReadSchema" in line]
    assert schemas and all("fare_amount" not in line for line in schemas)
    assert "GreaterThan(trip_distance,0.0)" in plan


def test_labelled_trips_are_staged_once(small_study):
    plan = plan_of(small_study.labelled)
    assert "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize(
    ("scale", "least", "remaining", "rows"),
    [
        ("sf0.001", 10, [6000, 4032, 4032, 3062, 2771, 2308, 2275, 2225, 1875, 1864], 1138),
        (
            "sf0.01",
            30,
            [60000, 39954, 39954, 30485, 27447, 22895, 22643, 22145, 19516, 19454],
            15667,
        ),
    ],
)
def test_audit_and_labels(spark, scale, least, remaining, rows):
    study = TripStudy.of_view(order_trips(spark, f"{TESTDATA}/{scale}"), order_trip_config(least))
    audit = study.audit().orderBy("step").collect()
    assert [r["remaining"] for r in audit] == remaining
    assert study.clean.rows == remaining[-1]
    assert study.labelled_rows == study.labelled.count() == rows
    assert study.labels.abs_threshold == pytest.approx(2.8)


@pytest.mark.parametrize("zone", ["America/New_York", "UTC", "Asia/Tokyo"])
def test_period_does_not_move_with_the_drivers_time_zone(zone):
    """In a process of its own, as the zone of a driver is fixed when it starts."""
    program = """
import datetime as dt
from check_oracle import session
from jamscope.operators.cleaning import within_period
from jamscope.config import CleaningRules, ColumnMap
spark = session("1")
times = ["2026-04-30 23:59:59", "2026-05-01 00:00:00", "2026-05-31 23:59:59", "2026-06-01 00:00:00"]
df = spark.createDataFrame([(t,) for t in times], "t string")
df = df.selectExpr("t", "to_timestamp_ntz(t) AS tpep_pickup_datetime")
print("KEPT", [r.t for r in df.where(within_period(ColumnMap(), CleaningRules())).collect()])
"""
    done = subprocess.run(
        [sys.executable, "-c", program],
        env=os.environ | {"TZ": zone},
        cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
        capture_output=True,
        text=True,
        timeout=180,
        check=True,
    )
    assert "KEPT ['2026-05-01 00:00:00', '2026-05-31 23:59:59']" in done.stdout


def test_counted_copies_give_the_same_results(small_study):
    """From the staged copies as from the raw trips, with some trips twice."""
    twice = small_study.raw.unionByName(small_study.raw.where("l_partkey % 7 = 0"))
    study = TripStudy(twice, small_study.config, small_study.staging)
    c, rules = study.config.columns, study.config.cleaning
    assert study.duplicates().collect() == quality.duplicate_count(twice).collect()
    direct = cleaning.clean_audit(twice, c, rules)
    assert sorted(study.audit().collect()) == sorted(direct.collect())
    assert study.clean.rows == cleaning.clean_trips(twice, c, rules).count()


def test_no_copy_of_all_trips_is_written(small_study, tmp_path):
    """Only clean trips are written, before and after the route join, for the labels and the audit."""
    staging = StagingArea(small_study.raw.sparkSession, str(tmp_path))
    study = TripStudy(small_study.raw, small_study.config, staging)
    assert study.labelled.count() == study.labelled_rows and study.audit().count() == 10
    whole = set()
    for path in (tmp_path / staging.path.split("/")[-1]).iterdir():
        if "l_partkey" in staging.spark.read.parquet(str(path)).columns:
            whole.add(path.name.rsplit("-", 1)[0])
    assert whole == {"clean", "ratios"}


def test_lines_are_moved_for_their_orders_only(spark):
    """Where nothing is small enough to be broadcast, customers meet orders, not lines."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        trips = order_trips(spark, f"{TESTDATA}/sf0.001")
        plan = trips._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set(key, before)
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    at = next(i for i, line in enumerate(plan) if "SortMergeJoin [o_custkey" in line)
    below = []
    for line, d in zip(plan[at + 1 :], depth[at + 1 :], strict=True):
        if d <= depth[at]:
            break
        below.append(line)
    assert below and not any("l_partkey" in line for line in below)


def test_one_label_is_evaluated_without_the_others(small_study, monkeypatch):
    asked = []

    def evaluated(sample, names, *_):
        asked.append(list(names))
        return {n: f"model of {n}" for n in names}

    monkeypatch.setattr(forest, "evaluate_all", evaluated)
    study = TripStudy(small_study.raw, small_study.config, small_study.staging)
    study.sample = None
    assert study.evaluate("jam_abs") == study.evaluate("jam_abs") == "model of jam_abs"
    assert list(study._evaluations) == ["jam_abs", "jam_rel"]
    assert asked == [["jam_abs"], ["jam_rel"]]
    with pytest.raises(KeyError):
        study.evaluate("jam_none")


def test_block_follows_the_data(small_study):
    config, staging = small_study.config, small_study.staging
    assert small_study.missing_block_by_vendor().count() > 0
    full = small_study.raw.na.fill(0).na.fill("x")
    none = TripStudy(full, config, staging)
    assert not none.missing_block().first()["has_block"]
    assert none.missing_block_by_vendor().count() == 0
    one = TripStudy(full.withColumn("store_flag", F.lit(None).cast("string")), config, staging)
    assert one.missing_block_by_vendor().count() == 0  # a single column is no block


def test_two_copies_of_the_trips(small_study):
    with pytest.raises(ValueError, match="other copy"):
        small_study.shape()
    with pytest.raises(ValueError, match="other copy"):
        small_study.null_counts()
    twice = TripStudy(small_study.raw, small_study.config, small_study.staging, small_study.raw)
    assert twice.shape().first()["shape_match"]
    assert twice.null_counts().first()["all_match"]


def test_staged_tables_can_be_removed(spark, small_study):
    with TripStudy(small_study.raw, small_study.config) as study:
        path = study.clean.path
        assert spark.read.parquet(path).count() == study.clean.rows
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)


def test_labels_without_reliable_routes(small_study):
    none = small_study.with_config(min_route_trips=10**6)
    assert none.labelled.count() == 0
    assert none.label_meta().first()["rel_threshold"] is None


def test_whole_study(small_study, spark, tmp_path):
    model = replace(small_study.config.model, trees=5, max_depth=6, min_category_rows=20)
    config = replace(small_study.config, model=model)
    study = TripStudy(small_study.raw, config, small_study.staging, small_study.raw)
    paths = study.run(str(tmp_path))
    expected = {"scan_shape", "null_count_reconcile", "missing_patterns", "route_medians"}
    expected |= {f"{kind}_{label}" for label in study.label_names for kind in (
        "class_distribution", "classification_report", "confusion_matrix", "baseline_metrics", "model"
    )}
    assert expected | {"agg_reconcile_summary", "model_comparison"} <= set(paths)
    for name, path in paths.items():
        # no zone of the smallest scale has enough trips for the ranking
        if name != "zone_jam_topk" and not name.startswith("model_jam"):
            assert spark.read.parquet(path).count() > 0, name
    again = forest.load_model(paths["model_jam_abs"])
    assert forest.predict(again, study.labelled).count() == study.labelled_rows


def test_time_features_of_a_plain_frame(small_study):
    c = small_study.config.columns
    assert add_time_features(small_study.raw, c).columns[-4:] == [
        "duration_min",
        "hour",
        "dow",
        "is_weekend",
    ]


def test_cells_give_the_same_tables(spark):
    """What is summed over cells equals what is read from the trips, NULLs included."""
    config = StudyConfig()
    distance = config.columns.distance
    i = F.col("id")
    trips = spark.range(5000).select(
        (i % 7).cast("int").alias("dow"),
        (i % 23).cast("int").alias("hour"),
        (i % 7 > 4).cast("int").alias("is_weekend"),
        F.when(i % 11 > 0, (i % 3 == 0).cast("int")).alias("jam_abs"),
        (i % 5 == 0).cast("int").alias("jam_rel"),
        F.when(i % 13 > 0, 1e3 + (i * 37 % 101) / 7).alias("speed_mph"),
        F.when(i % 17 > 0, (i * 53 % 211) / 9).alias(distance),
    )
    table = cells.cell_table(
        trips, ["jam_abs", "jam_rel"], ["speed_mph", distance], (distance, 15.0)
    ).persist()
    assert table.count() <= 7 * 23 * 6

    class Routes:
        rows = 12

    meta = labels.LabelledTrips(trips, Routes, 5000, 1.5, 0.5)
    tests = stats.standard_tests(config)
    pairs = [
        (cells.hourly_summary(table), aggregates.hourly_summary(trips)),
        (cells.speed_hour_dow_pivot(table), aggregates.speed_hour_dow_pivot(trips)),
        (cells.class_distribution(table, "jam_abs"), metrics.class_distribution(trips, "jam_abs")),
        (cells.label_meta(table, meta), labels.label_meta(meta)),
        (cells.welch_tests(table, tests), stats.welch_tests(trips, tests)),
        (
            aggregates.distance_histogram(trips, bounds=cells.near_bounds(table)),
            aggregates.distance_histogram(trips),
        ),
    ]
    for found, expected in pairs:
        assert found.dtypes == expected.dtypes
        for x, y in zip(
            sorted(found.collect(), key=repr), sorted(expected.collect(), key=repr), strict=True
        ):
            for a, b in zip(x, y, strict=True):
                assert a == (pytest.approx(b, rel=1e-8) if isinstance(b, float) else b)
    none = cells.cell_table(trips.limit(0), ["jam_abs", "jam_rel"], ["speed_mph", distance])
    assert cells.label_meta(none, meta).first()["n_rows"] == 0
    table.unpersist()
