"""Speed and congestion by passenger count, hour, weekday, zone and distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jamscope.config import ColumnMap
from jamscope.functions.nulls import is_true
from jamscope.functions.trips import duration_minutes, speed_mph, weekday_name
from jamscope.operators.quantiles import quantile_table
from jamscope.staging import StagingArea


def speed_by_passengers(
    trips: DataFrame,
    columns: ColumnMap | None = None,
    keep_null_group: bool = True,
    staging: StagingArea | None = None,
) -> DataFrame:
    """Trips, mean and median speed per passenger count, straight from raw trips.

    Reads only the scan columns; trips without a positive duration and distance
    are left out.  The group of unknown passenger count is kept or dropped.
    """
    c = columns or ColumnMap()
    moving = (
        trips.select(*c.lazy_scan)
        .withColumn("duration_min", duration_minutes(F.col(c.pickup), F.col(c.dropoff)))
        .where((F.col("duration_min") > 0) & (F.col(c.distance) > 0))
    )
    if not keep_null_group:
        moving = moving.where(F.col(c.passengers).isNotNull())
    speeds = quantile_table(
        moving,
        speed_mph(F.col(c.distance), F.col("duration_min")),
        {"median_speed": 0.5},
        by=[c.passengers],
        staging=staging,
    )
    return speeds.select(
        c.passengers,
        F.col("n").alias("trips"),
        F.col("mean").alias("mean_speed"),
        "median_speed",
    ).orderBy(F.asc_nulls_first(c.passengers))


def speed_hour_dow_pivot(labelled: DataFrame) -> DataFrame:
    """Mean speed, a row per weekday (Monday first) and a column per hour."""
    pivot = labelled.groupBy("dow").pivot("hour", list(range(24))).agg(F.avg("speed_mph"))
    return pivot.select(
        "dow",
        weekday_name(F.col("dow")).alias("weekday"),
        *[F.col(f"`{h}`").alias(f"h{h:02d}") for h in range(24)],
    ).orderBy("dow")


def hourly_summary(labelled: DataFrame, label: str = "jam_abs") -> DataFrame:
    """Trips, mean speed and percentage of congested trips per pickup hour."""
    return (
        labelled.groupBy("hour")
        .agg(
            F.count(F.lit(1)).alias("trips"),
            F.avg("speed_mph").alias("mean_speed"),
            (F.avg(label) * 100).alias("jam_pct"),
        )
        .orderBy("hour")
    )


def hourly_extremes(hourly: DataFrame) -> DataFrame:
    """Slowest and fastest hour of an hourly summary (the earlier one on ties) and their ratio."""
    speed, hour = F.col("mean_speed"), F.col("hour")
    found = hourly.where(speed.isNotNull()).agg(
        F.min(F.struct(speed.alias("s"), hour.alias("h"))).alias("low"),
        F.max(F.struct(speed.alias("s"), (-hour).alias("h"))).alias("high"),
    )
    return found.select(
        F.col("low.h").alias("slowest_hour"),
        F.col("low.s").alias("slowest_speed"),
        (-F.col("high.h")).alias("fastest_hour"),
        F.col("high.s").alias("fastest_speed"),
        F.try_divide(F.col("high.s"), F.col("low.s")).alias("speed_ratio"),
    )


def zone_jam_topk(
    labelled: DataFrame,
    columns: ColumnMap | None = None,
    label: str = "jam_abs",
    min_trips: int = 500,
    k: int = 20,
) -> DataFrame:
    """The ``k`` pickup zones with the highest congestion rate among zones with enough trips."""
    zone = (columns or ColumnMap()).pu_zone
    return (
        labelled.where(F.col(zone).isNotNull())
        .groupBy(zone)
        .agg(
            F.count(F.lit(1)).alias("trips"),
            (F.avg(label) * 100).alias("jam_pct"),
            F.avg("speed_mph").alias("mean_speed"),
        )
        .where(F.col("trips") >= min_trips)
        .orderBy(F.desc_nulls_last("jam_pct"), zone)
        .limit(k)
    )


def distance_histogram(
    labelled: DataFrame,
    columns: ColumnMap | None = None,
    label: str = "jam_abs",
    max_distance: float = 15.0,
    bins: int = 60,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Histogram of the distance with bins shared by the labels, density per label.

    Bins run from the smallest to the largest distance; the last is closed.
    Bins without trips give no row.  ``bounds`` is one row with these extremes as ``low`` and
    ``high``, if they are known.
    """
    distance = F.col((columns or ColumnMap()).distance)
    near = labelled.where(is_true(distance <= max_distance)).select(
        F.col(label).alias("label"), distance.alias("x")
    )
    if bounds is None:
        bounds = near.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    bounds = bounds.withColumn("width", (F.col("high") - F.col("low")) / F.lit(float(bins)))
    placed = near.crossJoin(F.broadcast(bounds))  # one row
    guess = F.coalesce(F.try_divide(F.col("x") - F.col("low"), F.col("width")), F.lit(0.0))
    guess = F.least(F.floor(guess), F.lit(bins - 1)).cast("int")

    def edge(i):
        return F.col("low") + i * F.col("width")

    # Division may land one bin off at an edge; the edges themselves decide.
    settled = (
        F.when(F.col("x") < edge(F.col("guess")), F.col("guess") - 1)
        .when(
            (F.col("x") >= edge(F.col("guess") + 1)) & (F.col("guess") < bins - 1),
            F.col("guess") + 1,
        )
        .otherwise(F.col("guess"))
    )
    counts = (
        placed.withColumn("guess", guess)
        .groupBy("label", settled.alias("bin"), "low", "width")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_label = Window.partitionBy("label")  # at most one row per bin
    return counts.select(
        "label",
        "bin",
        edge(F.col("bin")).alias("bin_start"),
        "n",
        F.try_divide(F.col("n"), F.sum("n").over(per_label) * F.col("width")).alias("density"),
    ).orderBy("label", "bin")
