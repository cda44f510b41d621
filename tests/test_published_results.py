"""Relations between published result values; no raw trips needed.

Fixed values: hourly trips and mean speed, confusion counts and correlations.
"""

from __future__ import annotations

import pytest

from jamscope.operators import aggregates, metrics, stats

HOURLY = [
    (0, 71827, 13.040),
    (1, 46236, 12.811),
    (2, 29790, 12.820),
    (3, 19352, 13.617),
    (4, 12507, 16.603),
    (5, 14966, 19.208),
    (6, 32913, 15.453),
    (7, 70824, 11.923),
    (8, 99752, 10.100),
    (9, 117449, 9.635),
    (10, 131442, 9.116),
    (11, 144437, 8.692),
    (12, 155238, 8.423),
    (13, 161876, 8.461),
    (14, 178086, 8.343),
    (15, 185082, 8.162),
    (16, 186327, 8.306),
    (17, 203561, 8.383),
    (18, 207568, 8.842),
    (19, 181098, 9.902),
    (20, 161576, 10.699),
    (21, 170116, 11.080),
    (22, 150222, 11.418),
    (23, 109308, 12.525),
]
SPEED_CORRELATIONS = [
    ("trip_distance", 0.674),
    ("duration_min", 0.206),
    ("speed_mph", 1.0),
    ("fare_amount", 0.532),
    ("tip_amount", 0.350),
    ("total_amount", 0.535),
    ("passenger_count", 0.019),
]


def test_hourly_extremes(spark):
    hourly = spark.createDataFrame(HOURLY, "hour int, trips bigint, mean_speed double")
    row = aggregates.hourly_extremes(hourly).first()
    assert (row["slowest_hour"], row["fastest_hour"]) == (15, 5)
    assert row["speed_ratio"] == pytest.approx(2.35, abs=0.005)
    assert sum(n for _, n, _ in HOURLY) == 2_841_553
    assert sum(n * v for _, n, v in HOURLY) / 2_841_553 == pytest.approx(9.8079, abs=0.001)
    assert sum(n for h, n, _ in HOURLY if h in (7, 8, 9, 16, 17, 18, 19)) == 1_066_579


def test_top_correlations(spark):
    matrix = spark.createDataFrame(
        [("speed_mph", v, r) for v, r in SPEED_CORRELATIONS],
        "row_var string, col_var string, r double",
    )
    names = [v for v, _ in SPEED_CORRELATIONS]
    found = stats.top_correlations(matrix, names, "speed_mph", 5).collect()
    assert [r["variable"] for r in found] == [
        "trip_distance",
        "total_amount",
        "fare_amount",
        "tip_amount",
        "duration_min",
    ]


@pytest.mark.parametrize(
    ("cells", "accuracy", "macro_f1", "baseline_f1"),
    [
        ((23223, 3067, 5079, 8631), 0.7964, 0.7651, 0.3966),
        ((24122, 2566, 8079, 5233), 0.7339, 0.6575, 0.4002),
    ],
)
def test_scores(spark, cells, accuracy, macro_f1, baseline_f1):
    pairs = [(0, 0), (0, 1), (1, 0), (1, 1)]
    rows = spark.createDataFrame(
        [(a, b, n) for (a, b), n in zip(pairs, cells, strict=True)],
        "label int, prediction int, n int",
    ).selectExpr("label", "prediction", "explode(sequence(1, n)) AS i")
    scores = metrics.classification_metrics(rows, "label", "prediction").first()
    assert round(scores["accuracy"], 4) == accuracy
    assert round(scores["macro_f1"], 4) == macro_f1
    confusion = metrics.confusion_matrix(rows, "label", "prediction").collect()
    assert tuple(r["n"] for r in sorted(confusion)) == cells
    baseline = metrics.baseline_metrics(rows, rows, "label").first()
    assert round(baseline["macro_f1"], 4) == baseline_f1
