"""Samples, splits, feature preparation and the forest."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from jamscope.operators import features, forest, metrics, sampling


@pytest.fixture(scope="module")
def numbered(spark):
    return spark.range(20_000).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))


@pytest.mark.parametrize("n", [1, 37, 5_000, 19_999, 20_000, 30_000])
def test_sample_size_is_exact(numbered, n):
    sample = sampling.sample_exact(numbered, n, 20_000)
    assert sample.distinct().count() == min(n, 20_000)


def test_sample_does_not_depend_on_partitions(numbered):
    one = sampling.sample_exact(numbered.repartition(1), 500, 20_000)
    many = sampling.sample_exact(numbered.repartition(13), 500, 20_000)
    other = sampling.sample_exact(numbered, 500, 20_000, seed=43)
    ids = [{r["id"] for r in s.collect()} for s in (one, many, other)]
    assert ids[0] == ids[1]
    assert ids[0] != ids[2]


def test_identical_rows_come_in_as_far_as_needed(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("x"), F.lit(1).alias("label"))
    assert sampling.sample_exact(df, 10, 100).count() == 10
    train, test = sampling.stratified_split(df, "label", 0.33)
    assert (train.count(), test.count()) == (67, 33)
    both = [r["x"] for part in (train, test) for r in part.collect()]
    assert sorted(both) == [0] * 50 + [1] * 50


def test_tied_rows_are_split_without_loss(numbered):
    tied = F.lit(7).cast("bigint")
    train, test = sampling.stratified_split(numbered, "label", 0.2, order=tied)
    assert test.count() == 4000
    ids = {r["id"] for part in (train, test) for r in part.collect()}
    assert len(ids) == 20_000


def test_split_of_many_classes(spark):
    """Each class gives its first rows; all classes are cut in the same few jobs."""
    df = spark.range(30_000).select(
        "id", F.concat(F.lit("c"), F.col("id") % 997 % 300).alias("label"), F.lit(1).alias("last")
    )
    order = F.shiftrightunsigned(F.xxhash64("id"), 4)
    train, test = sampling.stratified_split(df, "label", 0.2, order=order)
    assert train.columns == test.columns == df.columns
    members = {}
    for r in df.withColumn("o", order).collect():
        members.setdefault(r["label"], []).append((r["o"], r["id"]))
    found = {}
    for r in test.collect():
        found.setdefault(r["label"], set()).add(r["id"])
    given = sampling.allocate({c: len(m) for c, m in members.items()}, 24_000)
    for c, rows in members.items():
        assert found.get(c, set()) == {i for _, i in sorted(rows)[: len(rows) - given[c]]}
    assert train.count() == 24_000 and train.join(test, "id").count() == 0
    wanted = {c: len(members[c]) // 3 for c in ("c0", "c7", "c299")}
    for c, cut in sampling.find_cuts(df, "label", order, wanted).items():
        assert cut == sampling.find_cut(df.where(F.col("label") == c), order, wanted[c])
    with pytest.raises(ValueError):
        sampling.find_cuts(df, "label", order, {"c0": 10_000})


def test_split_of_odd_classes(spark):
    """No rows, rows without a label, classes of one row, and ties in some classes only."""
    empty = spark.range(0).select("id", F.lit(1).alias("label"))
    assert [p.count() for p in sampling.stratified_split(empty, "label")] == [0, 0]
    df = spark.range(1000).select(
        "id", F.when(F.col("id") < 900, F.least(F.col("id") % 7, F.lit(2))).alias("label")
    ).unionByName(spark.range(5000, 5001).select("id", F.lit(77).cast("long").alias("label")))
    order = F.when(F.col("label") == 2, F.lit(5).cast("bigint")).otherwise(F.col("id"))
    train, test = sampling.stratified_split(df, "label", 0.25, order=order)
    parts = [{r["id"] for r in p.collect()} for p in (train, test)]
    assert len(parts[1]) == math.ceil(0.25 * 901) and not parts[0] & parts[1]
    assert parts[0] | parts[1] == {*range(900), 5000}


@pytest.mark.parametrize("fraction", [0.2, 0.33])
def test_split_keeps_proportions(numbered, fraction):
    train, test = sampling.stratified_split(numbered, "label", fraction)
    n_test = math.ceil(fraction * 20_000)
    assert test.count() == n_test
    assert train.count() == 20_000 - n_test
    assert train.join(test, "id").count() == 0
    positive = numbered.where("label = 1").count()
    expected = sampling.allocate({0: 20_000 - positive, 1: positive}, 20_000 - n_test)
    assert train.where("label = 1").count() == expected[1]


def test_allocation_by_largest_remainder():
    assert sampling.allocate({0: 7, 1: 3}, 8) == {0: 6, 1: 2}
    assert sampling.allocate({0: 5, 1: 5}, 5) == {0: 3, 1: 2}
    assert sum(sampling.allocate({0: 11, 1: 13, 2: 17}, 33).values()) == 33


def test_numeric_statistics_after_imputation(spark):
    rows = [(1.0, 5.0), (None, 5.0), (4.0, 5.0), (None, 5.0), (10.0, 5.0)]
    df = spark.createDataFrame(rows, "x double, k double")
    fitted = features.fit_scalings(df, ["x", "k"])
    filled = np.array([1, 4, 4, 4, 10.0])
    assert fitted["x"].median == 4.0
    assert fitted["x"].mean == pytest.approx(filled.mean())
    assert fitted["x"].std == pytest.approx(filled.std())
    assert fitted["k"].std == 1.0  # constant
    scaled = features.standardize(df, fitted).toPandas()
    assert scaled["x"].to_numpy() == pytest.approx((filled - filled.mean()) / filled.std())


def test_mode_prefers_the_smallest_code(spark):
    df = spark.createDataFrame([(c,) for c in (9, 9, 3, 3, 7, None)], "a int")
    assert features.impute_mode(df, ["a"]).first()["mode"] == 3
    counts = {r["code"]: r["n"] for r in features.category_counts(df, ["a"]).collect()}
    assert counts == {3: 3, 9: 2, 7: 1}  # the NULL counts for 3


@pytest.fixture(scope="module")
def coded(spark):
    """``a`` has a rare code, ``b`` has none."""
    train = [(1, 5, 0.0)] * 4 + [(2, 6, 1.0)] * 3 + [(3, 6, 2.0)]
    test = [(1, 5, 0.0), (3, 6, 1.0), (8, 8, None), (None, None, 2.0)]
    schema = "a int, b int, x double"
    return spark.createDataFrame(train, schema), spark.createDataFrame(test, schema)


def test_rare_and_new_codes(coded):
    train, test = coded
    encodings = features.fit_encodings(train, ["a", "b"], 2)
    assert encodings["a"] == features.Encoding(1, (1, 2), True)
    assert encodings["b"] == features.Encoding(5, (5, 6), False)
    mapping = features.infrequent_mapping(test, train, ["a", "b"], 2)
    found = {(r["feature"], r["slot"], r["n"]) for r in mapping.collect()}
    assert found == {
        ("a", "1", 2),
        ("a", "infrequent", 2),
        ("b", "5", 2),
        ("b", "6", 1),
        ("b", None, 1),
    }


def test_feature_vectors(coded, staging):
    train, test = coded
    model = features.TripPreprocessor(["x"], ["a", "b"], 2, staging=staging).fit(train)
    vectors = [r["features"].toArray() for r in model.transform(test).collect()]
    # x, then a: 1, 2, rare, then b: 5, 6
    assert [list(v[1:]) for v in vectors] == [
        [1, 0, 0, 1, 0],
        [0, 0, 1, 0, 1],
        [0, 0, 1, 0, 0],
        [1, 0, 0, 1, 0],
    ]
    x = np.array([0.0] * 4 + [1.0] * 3 + [2.0])
    assert vectors[0][0] == pytest.approx((0 - x.mean()) / x.std())
    assert vectors[2][0] == pytest.approx((np.median(x) - x.mean()) / x.std())


def test_encoded_features_are_the_elements_of_the_vectors(coded, staging):
    train, test = coded
    keyed = test.withColumn("id", F.monotonically_increasing_id())
    model = features.TripPreprocessor(["x"], ["a", "b"], 2, staging=staging).fit(train)
    vectors = {r["id"]: r["features"].toArray() for r in model.transform(keyed).collect()}
    place = {s: i for i, s in enumerate(["x", "a=1", "a=2", "a=infrequent", "b=5", "b=6"])}
    found = {i: np.zeros(len(place)) for i in vectors}
    long = features.encoded_features(keyed, train, ["id"], ["x"], ["a", "b"], 2, staging)
    for r in long.collect():
        found[r["id"]][place[r["slot"]]] = r["value"]
    for i, vector in vectors.items():
        assert found[i] == pytest.approx(vector)


def test_codes_are_no_literals_of_the_plan(coded, staging):
    train, test = coded
    plans = [
        features.infrequent_mapping(test, train, ["a", "b"], 2),
        features.encoded_features(test, train, ["x"], ["x"], ["a", "b"], 2, staging),
    ]
    for df in plans:
        assert " IN (" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_coded_columns_are_nominal_attributes(coded, staging):
    train, test = coded
    fitted = features.TripPreprocessor(["x"], ["a", "b"], 2, staging, one_hot=False).fit(train)
    assert features.slot_counts(fitted) == [3, 2]
    rows = fitted.transform(test)
    attributes = rows.schema["features"].metadata["ml_attr"]["attrs"]
    assert [len(x["vals"]) for x in attributes["nominal"]] == [4, 3]
    # x, then the slots of a (1, 2, rare) and b (5, 6, any other)
    assert [list(r["features"].toArray()[1:]) for r in rows.collect()] == [
        [0, 0],
        [2, 1],
        [2, 2],
        [0, 0],
    ]


def test_undefined_scores(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    scores = metrics.classification_metrics(df, "label", "prediction").first()
    assert scores["macro_precision"] == pytest.approx(1 / 3)
    assert scores["macro_recall"] == pytest.approx(0.5)
    report = {r["class"]: r for r in metrics.classification_report(df, "label", "prediction").collect()}
    assert report["1"]["precision"] is None
    assert report["1"]["recall"] == 0.0
    assert report["macro avg"]["precision"] == pytest.approx(2 / 3)
    assert report["weighted avg"]["support"] == 3


@pytest.fixture(scope="module")
def evaluation(small_study):
    settings = replace(small_study.config.model, trees=10, max_depth=8, min_category_rows=20)
    sample = small_study.sample
    result = forest.train_and_evaluate(
        sample, "jam_abs", small_study.config.columns, settings, small_study.staging
    )
    return sample, result


def test_forest_beats_the_majority_class(evaluation):
    sample, result = evaluation
    assert result.scores["macro_f1"] > result.baseline_scores["macro_f1"]
    assert result.predictions.count() == math.ceil(0.2 * sample.rows)
    assert result.confusion.agg(F.sum("n")).first()[0] == math.ceil(0.2 * sample.rows)
    assert result.n_rows == sample.rows


def test_model_survives_storage(evaluation, tmp_path):
    sample, result = evaluation
    path = forest.save_model(result.model, str(tmp_path / "model"))
    again = forest.load_model(path)
    key = ["row_hash_1", "row_hash_2"]
    before = forest.predict(result.model, sample.frame, "jam_abs").orderBy(*key).collect()
    after = forest.predict(again, sample.frame, "jam_abs").orderBy(*key).collect()
    assert before == after


def test_rows_alike_are_predicted_together(evaluation):
    """A local sort, without a shuffle, and the same predictions."""
    sample, result = evaluation
    plain = forest.predict(result.model, sample.frame, "jam_abs")
    together = forest.predict(
        result.model, sample.frame, "jam_abs", alike=["trip_distance", "hour"]
    )
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert "Sort [trip_distance" in plan and "Exchange" not in plan
    assert sorted(together.collect()) == sorted(plain.collect())


def test_model_needs_its_columns(small_study):
    with pytest.raises(KeyError):
        features.feature_table(small_study.labelled, ["absent"], ["jam_abs"])
