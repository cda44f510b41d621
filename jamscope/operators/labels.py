"""Congestion labels: slow in absolute terms, and slow for the route."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jamscope.config import ColumnMap
from jamscope.functions.nulls import is_true
from jamscope.operators.quantiles import quantile_table, scalar_quantile
from jamscope.staging import Staged, StagingArea


@dataclass(frozen=True)
class LabelledTrips:
    """Trips of reliable routes with both labels, and what the labels rest on."""

    frame: DataFrame
    routes: Staged
    rows_in: int
    abs_threshold: float | None
    rel_threshold: float | None


def route_medians(
    trips: DataFrame,
    columns: ColumnMap | None = None,
    min_trips: int = 30,
    staging: StagingArea | None = None,
) -> DataFrame:
    """Median speed and trips of every route with at least ``min_trips`` trips."""
    c = columns or ColumnMap()
    medians = quantile_table(
        trips.where(F.col(c.pu_zone).isNotNull() & F.col(c.do_zone).isNotNull()),
        "speed_mph",
        {"route_median_mph": 0.5},
        by=[c.pu_zone, c.do_zone],
        staging=staging,
    )
    return medians.where(F.col("n") >= min_trips).select(
        c.pu_zone, c.do_zone, "route_median_mph", F.col("n").alias("route_trips")
    )


def add_threshold_label(
    df: DataFrame, value: str, threshold: float | None, label: str
) -> DataFrame:
    """Add a 0/1 label: the value is strictly below the threshold."""
    below = is_true(F.col(value) < F.lit(threshold).cast("double"))
    return df.withColumn(label, below.cast("int"))


def add_speed_ratio(trips: DataFrame, routes: DataFrame, columns: ColumnMap) -> DataFrame:
    """Join the route medians and add ``speed_ratio``; trips of other routes drop out.

    No broadcast hint: ``routes`` is read from a staged table, so the planner
    knows its size and broadcasts it below its threshold, and otherwise runs a
    shuffled join whose hot routes are split at run time.
    """
    keys = [columns.pu_zone, columns.do_zone]
    return trips.join(routes.drop("route_trips"), keys, "inner").withColumn(
        "speed_ratio", F.try_divide(F.col("speed_mph"), F.col("route_median_mph"))
    )


def build_labels(
    clean: Staged,
    staging: StagingArea,
    columns: ColumnMap | None = None,
    quantile: float = 1 / 3,
    min_route_trips: int = 30,
) -> LabelledTrips:
    """Both labels for the cleaned trips.

    The absolute threshold is taken over all cleaned trips, the relative one
    over the trips left after the route join, in this order.
    """
    c = columns or ColumnMap()
    trips = clean.frame
    abs_threshold = scalar_quantile(trips, "speed_mph", quantile)
    routes = staging.stage(route_medians(trips, c, min_route_trips, staging), "route_medians")
    # Everything that reads labelled trips reads this copy; the labels are projections on it.
    ratios = staging.stage(add_speed_ratio(trips, routes.frame, c), "ratios").frame
    rel_threshold = scalar_quantile(ratios, "speed_ratio", quantile)
    labelled = add_threshold_label(ratios, "speed_mph", abs_threshold, "jam_abs")
    labelled = add_threshold_label(labelled, "speed_ratio", rel_threshold, "jam_rel")
    return LabelledTrips(labelled, routes, clean.rows, abs_threshold, rel_threshold)


def label_meta(labels: LabelledTrips) -> DataFrame:
    """Thresholds, positive rates, agreement of the labels and sizes, as one row."""
    same = (F.col("jam_abs") == F.col("jam_rel")).cast("int")
    return labels.frame.agg(
        F.lit(labels.abs_threshold).cast("double").alias("abs_threshold"),
        F.lit(labels.rel_threshold).cast("double").alias("rel_threshold"),
        F.avg("jam_abs").alias("abs_rate"),
        F.avg("jam_rel").alias("rel_rate"),
        F.avg(same).alias("agreement"),
        F.lit(labels.routes.rows).cast("bigint").alias("reliable_routes"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def label_profile(
    labelled: DataFrame,
    labels: list[str],
    columns: ColumnMap | None = None,
    short_miles: float = 1.0,
    staging: StagingArea | None = None,
) -> DataFrame:
    """What each label calls congested: medians, and the share of short trips."""
    c = columns or ColumnMap()
    measures = {
        "median_distance": c.distance,
        "median_minutes": "duration_min",
        "median_speed": "speed_mph",
    }
    positives = labelled.select(
        *measures.values(),
        F.explode(
            F.filter(
                F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in labels]),
                lambda n: n.isNotNull(),
            )
        ).alias("label"),
    )
    long = positives.select(
        "label",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(out).alias("measure"), F.col(src).cast("double").alias("value")
                    )
                    for out, src in measures.items()
                ],
                # the mean of this 0/100 measure is the percentage of short trips
                F.struct(
                    F.lit("pct_short").alias("measure"),
                    F.when(F.col(c.distance) < short_miles, 100.0).otherwise(0.0).alias("value"),
                ),
            )
        ),
    )
    medians = quantile_table(
        long, "value", {"median": 0.5}, by=["label", "measure"], staging=staging
    )
    pick = F.when(F.col("measure") == "pct_short", F.col("mean")).otherwise(F.col("median"))
    return medians.groupBy("label").pivot("measure", [*measures, "pct_short"]).agg(F.first(pick))
