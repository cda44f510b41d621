"""Small results that share one scan of the labelled trips.

Weekday, hour and labels have few values.  The trips of each combination, a
cell, are counted once, with the mean and the squared deviations of some values;
tables by hour, weekday or class and comparisons of such groups are sums over
cells, of which there are a few thousand at most whatever the number of trips.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jamscope.functions.nulls import is_true
from jamscope.functions.trips import weekday_name
from jamscope.operators.labels import LabelledTrips
from jamscope.operators.stats import WelchTest, score_welch


def cell_table(
    labelled: DataFrame,
    labels: Sequence[str],
    values: Sequence[str],
    near: tuple[str, float] | None = None,
) -> DataFrame:
    """Trips, and count, mean and squared deviations of each value, per cell.

    ``near`` names a column and a limit; the extremes of its values up to the
    limit are added.
    """
    measures = [F.count(F.lit(1)).alias("trips")]
    for name in values:
        x = F.col(f"`{name}`").cast("double")
        measures += [
            F.count(x).alias(f"n_{name}"),
            F.avg(x).alias(f"mean_{name}"),
            (F.var_pop(x) * F.count(x)).alias(f"dev_{name}"),
        ]
    if near:
        x = F.col(f"`{near[0]}`")
        x = F.when(is_true(x <= near[1]), x)
        measures += [F.min(x).alias("near_low"), F.max(x).alias("near_high")]
    return labelled.groupBy("dow", "hour", "is_weekend", *labels).agg(*measures)


def _mean(name: str) -> Column:
    n = F.col(f"n_{name}")
    return F.try_divide(F.sum(n * F.col(f"mean_{name}")), F.sum(n))


def _share(condition: Column) -> Column:
    """The share of trips for which a condition on the cell holds, of those where it is known."""
    known = F.when(condition.isNotNull(), F.col("trips"))
    return F.try_divide(F.sum(condition.cast("int") * F.col("trips")), F.sum(known))


def hourly_summary(cells: DataFrame, label: str = "jam_abs") -> DataFrame:
    """As :func:`jamscope.operators.aggregates.hourly_summary`."""
    return (
        cells.groupBy("hour")
        .agg(
            F.sum("trips").alias("trips"),
            _mean("speed_mph").alias("mean_speed"),
            (_share(F.col(label) == 1) * 100).alias("jam_pct"),
        )
        .orderBy("hour")
    )


def speed_hour_dow_pivot(cells: DataFrame) -> DataFrame:
    """As :func:`jamscope.operators.aggregates.speed_hour_dow_pivot`."""
    means = cells.groupBy("dow", "hour").agg(_mean("speed_mph").alias("mean_speed"))
    pivot = means.groupBy("dow").pivot("hour", list(range(24))).agg(F.first("mean_speed"))
    return pivot.select(
        "dow",
        weekday_name(F.col("dow")).alias("weekday"),
        *[F.col(f"`{h}`").alias(f"h{h:02d}") for h in range(24)],
    ).orderBy("dow")


def class_distribution(cells: DataFrame, label: str) -> DataFrame:
    """As :func:`jamscope.operators.metrics.class_distribution`."""
    counts = cells.groupBy(label).agg(F.sum("trips").alias("n"))
    total = cells.agg(F.sum("trips").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(  # one row
        label, "n", (F.col("n") / F.col("_total")).alias("share")
    )


def label_meta(cells: DataFrame, labels: LabelledTrips) -> DataFrame:
    """As :func:`jamscope.operators.labels.label_meta`."""
    return cells.agg(
        F.lit(labels.abs_threshold).cast("double").alias("abs_threshold"),
        F.lit(labels.rel_threshold).cast("double").alias("rel_threshold"),
        _share(F.col("jam_abs") == 1).alias("abs_rate"),
        _share(F.col("jam_rel") == 1).alias("rel_rate"),
        _share(F.col("jam_abs") == F.col("jam_rel")).alias("agreement"),
        F.lit(labels.routes.rows).cast("bigint").alias("reliable_routes"),
        F.coalesce(F.sum("trips"), F.lit(0)).cast("bigint").alias("n_rows"),
    )


def near_bounds(cells: DataFrame) -> DataFrame:
    """The extremes of the near values, as one row."""
    return cells.agg(F.min("near_low").alias("low"), F.max("near_high").alias("high"))


def welch_tests(cells: DataFrame, tests: Sequence[WelchTest], alpha: float = 0.05) -> DataFrame:
    """As :func:`jamscope.operators.stats.welch_tests`, for flags that depend on the cell and
    values that the cells have."""
    sides = [
        (f"{side}{i}", member, test.value)
        for i, test in enumerate(tests)
        for side, member in (("a", is_true(test.flag)), ("b", ~is_true(test.flag)))
    ]
    means = cells.agg(
        *[
            F.try_divide(
                F.sum(F.when(member, F.col(f"n_{v}") * F.col(f"mean_{v}"))),
                F.sum(F.when(member, F.col(f"n_{v}"))),
            ).alias(f"_m{side}")
            for side, member, v in sides
        ]
    )
    moments = []
    for side, member, v in sides:
        n, off = F.col(f"n_{v}"), F.col(f"mean_{v}") - F.col(f"_m{side}")
        count = F.coalesce(F.sum(F.when(member, n)), F.lit(0)).cast("bigint")
        spread = F.sum(F.when(member, F.col(f"dev_{v}") + n * off * off))
        moments += [
            count.alias(f"_n{side}"),
            F.first(f"_m{side}").alias(f"_m{side}"),
            F.when(count > 1, spread / (count - 1)).alias(f"_v{side}"),
        ]
    wide = cells.crossJoin(F.broadcast(means)).agg(*moments)  # one row
    return score_welch(wide, [t.name for t in tests], alpha)
