"""A whole study: raw trips in, result tables and models out."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jamscope.config import StudyConfig
from jamscope.functions.trips import add_time_features
from jamscope.operators import (
    aggregates,
    cells,
    cleaning,
    forest,
    labels,
    quality,
    stats,
)
from jamscope.sources.tables import shape_reconcile, write_tables
from jamscope.staging import Staged, StagingArea


class TripStudy:
    """The stages of one study, each run at most once.

    What several results read is staged: the cleaned trips, the route medians,
    the model sample, and small tables that others are derived from.  Every
    result is a DataFrame over these (or over the raw scan) and runs when it is
    used.  ``other`` is a second copy of the trips, from another source, to be
    compared with the first.  ``close`` deletes what was staged.
    """

    def __init__(
        self,
        trips: DataFrame,
        config: StudyConfig | None = None,
        staging: StagingArea | None = None,
        other: DataFrame | None = None,
    ) -> None:
        self.raw = trips
        self.other = other
        self.config = config or StudyConfig()
        self.staging = staging or StagingArea(trips.sparkSession)
        self._evaluated: dict[str, forest.Evaluation] = {}

    @classmethod
    def of_view(
        cls,
        view: DataFrame,
        config: StudyConfig | None = None,
        staging: StagingArea | None = None,
        other: DataFrame | None = None,
    ) -> TripStudy:
        """A study of trips that are themselves the result of a query, which runs only once."""
        staging = staging or StagingArea(view.sparkSession)
        return cls(staging.stage(view, "trips").frame, config, staging, other)

    def close(self) -> None:
        """Delete the staged tables; results not yet computed are lost."""
        self.staging.remove()

    def __enter__(self) -> TripStudy:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def trips(self) -> DataFrame:
        """Raw trips with the time features."""
        return add_time_features(self.raw, self.config.columns)

    @cached_property
    def copies(self) -> DataFrame:
        """The distinct raw trips and their copies; only trips that may have copies are moved."""
        return quality.count_copies(self.raw, self.staging)

    @cached_property
    def clean(self) -> Staged:
        config = self.config
        # Copies are looked for among the trips that the rules leave, which are far fewer.
        trips = cleaning.clean_trips(
            self.raw, config.columns, config.cleaning, staging=self.staging
        )
        return self.staging.stage(trips, "clean")

    @cached_property
    def labels(self) -> labels.LabelledTrips:
        return labels.build_labels(
            self.clean,
            self.staging,
            self.config.columns,
            self.config.jam_quantile,
            self.config.min_route_trips,
        )

    @property
    def labelled(self) -> DataFrame:
        """Clean trips of reliable routes with ``jam_abs`` and ``jam_rel``."""
        return self.labels.frame

    @property
    def label_names(self) -> list[str]:
        return [name for name, _ in self.config.labels]

    @cached_property
    def labelled_rows(self) -> int:
        """Rows of the labelled table: trips per reliable route, summed."""
        row = self.labels.routes.frame.selectExpr("coalesce(sum(route_trips), 0) AS n").first()
        return int(row["n"])

    # Raw data -------------------------------------------------------------

    def shape(self) -> DataFrame:
        """Rows and columns of both copies of the trips."""
        return shape_reconcile(self.raw, self._second)

    @property
    def _second(self) -> DataFrame:
        if self.other is None:
            raise ValueError("the study has no other copy of its trips")
        return self.other

    @cached_property
    def patterns(self) -> Staged:
        """Which columns are missing together: one pass over the raw trips for three results."""
        return self.staging.stage(quality.missing_patterns(self.trips), "patterns")

    def null_profile(self) -> DataFrame:
        return quality.null_profile(self.trips, self.patterns.frame)

    def null_counts(self) -> DataFrame:
        """NULL counts of both copies of the trips."""
        return quality.null_count_reconcile(self.raw, self._second)

    def sentinels(self) -> DataFrame:
        return quality.sentinel_profile(self.raw, self.config.columns, self.config.cleaning)

    def missing_patterns(self) -> DataFrame:
        return self.patterns.frame

    def missing_block(self) -> DataFrame:
        return quality.missing_block(self.trips, self.patterns.frame)

    def missing_block_by_vendor(self) -> DataFrame:
        base = quality.block_base(self.trips.columns, self.patterns.frame)
        return quality.missing_block_by_group(self.trips, base, self.config.columns.vendor)

    def duplicates(self) -> DataFrame:
        return quality.duplicate_count(self.raw, self.copies)

    def distance_quantiles(self) -> DataFrame:
        return quality.quantile_interpolation(self.raw, self.config.columns.distance)

    def quantile_reconcile(self, column: str | None = None) -> DataFrame:
        """Quantiles of a column (trip distance) in both copies of the trips."""
        return quality.quantile_reconcile(
            self.raw, self._second, column or self.config.columns.distance, staging=self.staging
        ).orderBy("prob")

    @cached_property
    def _passenger_speeds(self) -> Staged:
        speeds = aggregates.speed_by_passengers(
            self.raw, self.config.columns, True, self.staging
        )
        return self.staging.stage(speeds, "passengers")

    def speed_by_passengers(self, keep_null_group: bool = True) -> DataFrame:
        key = F.col(self.config.columns.passengers)
        groups = self._passenger_speeds.frame
        if not keep_null_group:
            groups = groups.where(key.isNotNull())
        return groups.orderBy(key.asc_nulls_first())

    @cached_property
    def _passenger_sides(self) -> tuple[DataFrame, DataFrame]:
        """The passenger aggregate without and with its NULL group, for comparison."""
        return self.speed_by_passengers(False), self.speed_by_passengers(True)

    def passenger_reconcile(self) -> DataFrame:
        return quality.aggregate_reconcile(
            *self._passenger_sides,
            self.config.columns.passengers,
            ["trips", "mean_speed", "median_speed"],
        ).orderBy(F.asc_nulls_last(self.config.columns.passengers))

    def passenger_reconcile_summary(self) -> DataFrame:
        return quality.aggregate_reconcile_summary(
            *self._passenger_sides, self.config.columns.passengers, "trips"
        )

    def audit(self) -> DataFrame:
        return cleaning.clean_audit(
            self.raw, self.config.columns, self.config.cleaning, self.copies
        )

    # Labelled data ----------------------------------------------------------

    @cached_property
    def _cells(self) -> Staged:
        """One scan of the labelled trips for all tables by hour, weekday and class."""
        c = self.config.columns
        table = cells.cell_table(
            self.labelled,
            self.label_names,
            ["speed_mph", c.distance],
            (c.distance, self.config.histogram_max_distance),
        )
        return self.staging.stage(table, "cells")

    def label_meta(self) -> DataFrame:
        return cells.label_meta(self._cells.frame, self.labels)

    def class_distribution(self, label: str) -> DataFrame:
        return cells.class_distribution(self._cells.frame, label)

    def label_profile(self) -> DataFrame:
        return labels.label_profile(
            self.labelled,
            self.label_names,
            self.config.columns,
            self.config.short_trip_miles,
            self.staging,
        )

    def describe(self) -> DataFrame:
        return stats.describe_numeric(
            self.labelled, self.config.columns.statistics, self.staging
        )

    @cached_property
    def _correlations(self) -> Staged:
        # Cleaning left no NULL in these columns.
        matrix = stats.correlation_matrix(
            self.labelled, self.config.columns.statistics, complete=True
        )
        return self.staging.stage(matrix, "correlations")

    def correlations(self) -> DataFrame:
        return self._correlations.frame

    def top_correlations(self, target: str = "speed_mph", n: int = 5) -> DataFrame:
        return stats.top_correlations(
            self.correlations(), self.config.columns.statistics, target, n
        )

    def speed_pivot(self) -> DataFrame:
        return cells.speed_hour_dow_pivot(self._cells.frame)

    def hourly(self) -> DataFrame:
        return cells.hourly_summary(self._cells.frame)

    def hourly_extremes(self) -> DataFrame:
        return aggregates.hourly_extremes(self.hourly())

    def zones(self) -> DataFrame:
        return aggregates.zone_jam_topk(
            self.labelled,
            self.config.columns,
            "jam_abs",
            self.config.min_zone_trips,
            self.config.top_zones,
        )

    def distance_histogram(self) -> DataFrame:
        return aggregates.distance_histogram(
            self.labelled,
            self.config.columns,
            "jam_abs",
            self.config.histogram_max_distance,
            self.config.histogram_bins,
            cells.near_bounds(self._cells.frame),
        )

    def tests(self) -> DataFrame:
        return cells.welch_tests(
            self._cells.frame, stats.standard_tests(self.config), self.config.alpha
        )

    # Models -------------------------------------------------------------------

    @cached_property
    def sample(self) -> Staged:
        return forest.draw_sample(
            self.labelled,
            self.labelled_rows,
            self.config.columns,
            self.label_names,
            self.config.model,
            self.staging,
        )

    def evaluate(self, label: str) -> forest.Evaluation:
        """The evaluation of one label; forests of other labels are not fitted for it."""
        return self._fitted([label])[label]

    @property
    def _evaluations(self) -> dict[str, forest.Evaluation]:
        return self._fitted(self.label_names)

    def _fitted(self, names: list[str]) -> dict[str, forest.Evaluation]:
        """Evaluations by label; those not there yet are fitted side by side."""
        unknown = [n for n in names if n not in self.label_names]
        if unknown:
            raise KeyError(unknown[0])
        missing = [n for n in names if n not in self._evaluated]
        if missing:
            self._evaluated |= forest.evaluate_all(
                self.sample, missing, self.config.columns, self.config.model, self.staging
            )
        return {n: self._evaluated[n] for n in names}

    def model_comparison(self) -> DataFrame:
        """One row per label: scores, baseline, gain and fit time."""
        descriptions = dict(self.config.labels)
        rows = [
            {**row, "description": descriptions[row["label"]]}
            for row in forest.model_scores(list(self._evaluations.values()))
        ]
        return self.raw.sparkSession.createDataFrame(rows, COMPARISON_SCHEMA)

    # Everything ---------------------------------------------------------------

    def _stage_shared(self, parallel: int) -> None:
        """Stage what several tables share; steps that do not need each other run side by side."""
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            steps = [
                pool.submit(lambda: self.patterns),
                pool.submit(lambda: self._passenger_sides),
            ]
            steps.append(pool.submit(lambda: self.labels))
            steps[-1].result()
            steps.append(pool.submit(lambda: self._correlations))
            steps.append(pool.submit(lambda: self._cells))
            for step in steps:
                step.result()

    def tables(self, with_models: bool = True, parallel: int = 4) -> dict[str, DataFrame]:
        """All result tables by name."""
        self._stage_shared(parallel)
        results = {
            "quantile_interpolation": self.distance_quantiles(),
            "agg_reconcile": self.passenger_reconcile(),
            "agg_reconcile_summary": self.passenger_reconcile_summary(),
            "null_profile": self.null_profile(),
            "missing_patterns": self.missing_patterns(),
            "missing_block": self.missing_block(),
            "missing_block_by_group": self.missing_block_by_vendor(),
            "sentinel_profile": self.sentinels(),
            "duplicate_count": self.duplicates(),
            "clean_audit": self.audit(),
            "route_medians": self.labels.routes.frame,
            "label_meta": self.label_meta(),
            "label_profile": self.label_profile(),
            "describe_numeric": self.describe(),
            "correlation_matrix": self.correlations(),
            "top_correlations": self.top_correlations(),
            "speed_hour_dow_pivot": self.speed_pivot(),
            "hourly_summary": self.hourly(),
            "hourly_extremes": self.hourly_extremes(),
            "zone_jam_topk": self.zones(),
            "distance_histogram": self.distance_histogram(),
            "ttest_summary": self.tests(),
        }
        for name in self.label_names:
            results[f"class_distribution_{name}"] = self.class_distribution(name)
        if self.other is not None:
            results["scan_shape"] = self.shape()
            results["null_count_reconcile"] = self.null_counts()
            results["quantile_reconcile"] = self.quantile_reconcile()
        if with_models:
            results["model_comparison"] = self.model_comparison()
            for name, evaluation in self._evaluations.items():
                results[f"classification_report_{name}"] = evaluation.report
                results[f"confusion_matrix_{name}"] = evaluation.confusion
                results[f"baseline_metrics_{name}"] = evaluation.baseline
        return results

    def run(
        self, directory: str, fmt: str = "parquet", with_models: bool = True, parallel: int = 4
    ) -> dict[str, str]:
        """Compute and write all tables, and the fitted models below ``models/``."""
        paths = write_tables(self.tables(with_models, parallel), directory, fmt, parallel)
        if with_models:
            for name, evaluation in self._evaluations.items():
                paths[f"model_{name}"] = forest.save_model(
                    evaluation.model, f"{directory.rstrip('/')}/models/{name}"
                )
        return paths

    def with_config(self, **changes) -> TripStudy:
        """A new study of the same trips with some settings changed."""
        return TripStudy(self.raw, replace(self.config, **changes), self.staging, self.other)


COMPARISON_SCHEMA = (
    "label string, description string, accuracy double, macro_f1 double, "
    "macro_precision double, macro_recall double, baseline_f1 double, f1_gain double, "
    "fit_seconds double, n_features int, n_rows bigint, class_ratio double"
)
