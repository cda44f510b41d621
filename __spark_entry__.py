"""Registered queries over the order-derived trip table, and their DuckDB twins."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_queries
from jamscope import TripStudy
from jamscope.functions.trips import add_speed, add_time_features
from jamscope.operators import features, forest, labels, metrics, quality, sampling, stats
from jamscope.operators.cleaning import clean_audit
from jamscope.plans.order_trips import ORDER_TRIP_COLUMNS, order_trip_config, order_trips
from jamscope.sources.tables import double_columns
from oracle_queries import KEYS, MIN_ROWS, MODEL_MIN_ROWS, TRIP_COLUMNS

COLUMNS = ORDER_TRIP_COLUMNS
KEY_COLUMNS = KEYS.split(", ")
PREDICTION_ORDER = [COLUMNS.distance, "hour", "dow", COLUMNS.do_zone, COLUMNS.pu_zone, COLUMNS.ratecode]
_studies: dict[tuple[str, str], TripStudy] = {}

# The corpus operators are optional: without them the rest works alone.
try:
    import corpus_pipeline
    from jamscope.llm import queries as corpus_queries
except ModuleNotFoundError as error:
    if error.name not in ("corpus_pipeline", "jamscope.llm"):
        raise
    corpus_pipeline = corpus_queries = None


def study_of(spark: SparkSession, sf_dir: str) -> TripStudy:
    """The study of a folder; its staged tables serve all queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _studies:
        trips = order_trips(spark, sf_dir)
        _studies[key] = TripStudy.of_view(
            trips, order_trip_config(), other=doubled(marked(trips))
        )
    return _studies[key]


def marked(trips: DataFrame) -> DataFrame:
    """The trips with NULL for the unknown rate code."""
    rate = F.col(COLUMNS.ratecode)
    return trips.withColumn(COLUMNS.ratecode, F.when(rate != 99, rate))


def other_block(trips: DataFrame) -> DataFrame:
    """The trips with their block of missing values in other columns and other rows."""
    first = F.col("l_linenumber") == 1
    filled = {
        COLUMNS.passengers: F.coalesce(COLUMNS.passengers, F.lit(0)),
        COLUMNS.ratecode: F.coalesce(COLUMNS.ratecode, F.lit(1)),
        "store_flag": F.coalesce("store_flag", F.lit("O")),
    }
    emptied = {c: F.when(~first, F.col(c)) for c in (COLUMNS.tip, COLUMNS.total)}
    return trips.withColumns(filled | emptied)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, without negative zeros, for comparison between engines."""
    doubles = set(double_columns(df))
    return df.select(
        *[
            (F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) if c in doubles else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def printable_trips(df: DataFrame, *more: str) -> DataFrame:
    """Trip rows with timestamps as text."""
    text = {
        c: F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss") for c in (COLUMNS.pickup, COLUMNS.dropoff)
    }
    return rounded(
        df.select(*[text[c].alias(c) if c in text else F.col(c) for c in (*TRIP_COLUMNS, *more)])
    )


def doubled(trips: DataFrame) -> DataFrame:
    """The trips with some of them twice."""
    return trips.unionByName(trips.where(F.col("l_partkey") % 50 == 0))


def arithmetic_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A split both engines can express."""
    in_test = F.col("l_partkey") % 5 == 0
    return df.where(~in_test), df.where(in_test)


def entry(spark: SparkSession) -> DataFrame:
    """Trips, mean speed and congestion by hour, from raw trips to labels, at the smallest scale."""
    trips = order_trips(spark, "/root/testdata/sf0.001")
    return TripStudy.of_view(trips, order_trip_config()).hourly()


def _other_block(s: TripStudy) -> DataFrame:
    return TripStudy(other_block(s.raw), s.config, s.staging).missing_block_by_vendor()


def _speed_feature(s: TripStudy) -> DataFrame:
    moving = s.trips.where(F.col("duration_min") > 0)
    return add_speed(moving, COLUMNS, strict=True).select(*KEY_COLUMNS, "speed_mph")


def _absolute_label(s: TripStudy) -> DataFrame:
    labelled = labels.add_threshold_label(
        s.clean.frame, "speed_mph", s.labels.abs_threshold, "jam_abs"
    )
    return labelled.select(*KEY_COLUMNS, "speed_mph", "jam_abs")


def _impute_median(s: TripStudy) -> DataFrame:
    train, test = arithmetic_split(s.trips)
    numeric = COLUMNS.numeric_features
    fitted = features.fit_scalings(train, numeric, s.staging)
    filled = features.impute_median(test, {n: x.median for n, x in fitted.items()})
    return filled.select(*KEY_COLUMNS, *numeric)


def _standardize(s: TripStudy) -> DataFrame:
    train, test = arithmetic_split(s.trips)
    numeric = COLUMNS.numeric_features
    fitted = features.fit_scalings(train, numeric, s.staging)
    return features.standardize(test, fitted).select(*KEY_COLUMNS, *numeric)


def _infrequent_mapping(s: TripStudy) -> DataFrame:
    train, test = arithmetic_split(s.trips)
    return features.infrequent_mapping(test, train, COLUMNS.nominal_features, MIN_ROWS)


def _encoded_features(s: TripStudy) -> DataFrame:
    train, test = arithmetic_split(s.trips)
    numeric, nominal = COLUMNS.numeric_features, COLUMNS.nominal_features
    return features.encoded_features(
        test, train, KEY_COLUMNS, numeric, nominal, MIN_ROWS, s.staging
    )


def _feature_width(s: TripStudy) -> DataFrame:
    train, _ = arithmetic_split(s.labelled)
    preprocessor = features.TripPreprocessor(
        COLUMNS.numeric_features,
        COLUMNS.nominal_features,
        MODEL_MIN_ROWS,
        staging=s.staging,
    )
    width = features.feature_width(preprocessor.fit(train).transform(s.labelled))
    return s.raw.sparkSession.range(1).select(F.lit(width).alias("n_features"))


def _supplied(s: TripStudy) -> DataFrame:
    return s.labelled.select(
        "jam_abs", F.col("hour").between(8, 18).cast("int").alias("prediction")
    )


def _sample_exact(s: TripStudy) -> DataFrame:
    sample = sampling.sample_exact(s.labelled, 5000, s.labelled_rows, s.config.model.seed)
    all_rows = s.labelled.agg(F.count(F.lit(1)).alias("n_rows"))
    copies = sample.groupBy(*sample.columns).agg(F.count(F.lit(1)).alias("c"))
    drawn = copies.agg(
        F.sum("c").alias("sample_rows"), F.count(F.lit(1)).alias("distinct_rows")
    )
    return all_rows.crossJoin(F.broadcast(drawn))  # one row each


def _split_counts(s: TripStudy) -> DataFrame:
    parts = sampling.stratified_split(
        s.labelled, "jam_abs", s.config.model.test_fraction, s.config.model.seed
    )
    counted = [
        part.groupBy("jam_abs")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("part"), "jam_abs", "n")
        for name, part in zip(("train", "test"), parts, strict=True)
    ]
    return counted[0].unionByName(counted[1])


def _sample_rows(s: TripStudy) -> DataFrame:
    order = sampling.portable_order(KEY_COLUMNS, s.config.model.seed)
    sample = sampling.sample_exact(s.labelled, 5000, s.labelled_rows, order=order)
    return sample.select(*KEY_COLUMNS)


def _split_rows(s: TripStudy) -> DataFrame:
    order = sampling.portable_order(KEY_COLUMNS, s.config.model.seed)
    train, test = sampling.stratified_split(
        s.labelled, "jam_abs", s.config.model.test_fraction, order=order
    )
    named = [
        part.select(*KEY_COLUMNS, "jam_abs", F.lit(name).alias("part"))
        for name, part in (("train", train), ("test", test))
    ]
    return named[0].unionByName(named[1])


def _model_predictions(s: TripStudy) -> DataFrame:
    """Predictions for all labelled trips, of the forest after a round trip through storage."""
    path = forest.save_model(s.evaluate("jam_abs").model, f"{s.staging.path}/models/jam_abs")
    return forest.predict(
        forest.load_model(path), s.labelled, "jam_abs", KEY_COLUMNS, PREDICTION_ORDER
    )


def _model_coverage(s: TripStudy) -> DataFrame:
    """Scored rows, and rows without a prediction, per label."""
    return _model_predictions(s).groupBy("jam_abs").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("prediction").isNull()).alias("n_null")
    )


def _model_scores(s: TripStudy) -> DataFrame:
    return s.model_comparison().select(
        "label", "accuracy", "macro_f1", "macro_precision", "macro_recall", "n_features", "n_rows"
    )


def _one_test(s: TripStudy, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    chosen = [t for t in stats.standard_tests(s.config) if t.name == name]
    return stats.welch_tests(s.labelled, chosen, s.config.alpha, by)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    nominal = COLUMNS.nominal_features
    table: dict[str, Callable[[TripStudy], DataFrame]] = {
        "scan_shape": lambda s: s.shape(),
        "time_features": lambda s: add_time_features(s.raw, COLUMNS).select(
            *KEY_COLUMNS, "duration_min", "hour", "dow", "is_weekend"
        ),
        "speed_feature": _speed_feature,
        "speed_by_passenger_nulls_kept": lambda s: s.speed_by_passengers(True),
        "speed_by_passenger_nulls_dropped": lambda s: s.speed_by_passengers(False),
        "agg_reconcile": lambda s: s.passenger_reconcile(),
        "agg_reconcile_summary": lambda s: s.passenger_reconcile_summary(),
        "null_count_reconcile": lambda s: s.null_counts(),
        "null_profile": lambda s: s.null_profile(),
        "sentinel_profile": lambda s: s.sentinels(),
        "missing_patterns": lambda s: s.missing_patterns(),
        "missing_block": lambda s: s.missing_block(),
        "missing_block_by_group": lambda s: s.missing_block_by_vendor(),
        "missing_block_by_group_other": _other_block,
        "duplicate_count": lambda s: quality.duplicate_count(doubled(s.raw)),
        "dedup_rows": lambda s: printable_trips(quality.dedup_rows(doubled(s.raw))),
        "quantile_interpolation": lambda s: s.distance_quantiles(),
        "quantile_reconcile": lambda s: s.quantile_reconcile(COLUMNS.total),
        "clean_audit": lambda s: s.audit(),
        "clean_audit_duplicates": lambda s: clean_audit(
            doubled(s.raw), COLUMNS, s.config.cleaning
        ),
        "clean_trips": lambda s: printable_trips(
            s.clean.frame, "duration_min", "hour", "dow", "is_weekend", "speed_mph"
        ),
        "absolute_label": _absolute_label,
        "route_medians": lambda s: s.labels.routes.frame,
        "relative_label": lambda s: s.labelled.select(
            *KEY_COLUMNS, "route_median_mph", "speed_ratio", "jam_rel"
        ),
        "label_meta": lambda s: s.label_meta(),
        "label_profile": lambda s: s.label_profile(),
        "describe_numeric": lambda s: s.describe(),
        "correlation_matrix": lambda s: s.correlations(),
        "top_correlations": lambda s: s.top_correlations(),
        "speed_hour_dow_pivot": lambda s: s.speed_pivot(),
        "hourly_summary": lambda s: s.hourly(),
        "hourly_extremes": lambda s: s.hourly_extremes(),
        "zone_jam_topk": lambda s: s.zones(),
        "distance_histogram": lambda s: s.distance_histogram(),
        "welch_ttest": lambda s: _one_test(s, "jam_distance", (COLUMNS.vendor,)),
        "welch_jam_distance": lambda s: _one_test(s, "jam_distance"),
        "welch_weekend_speed": lambda s: _one_test(s, "weekend_speed"),
        "welch_rush_hour": lambda s: _one_test(s, "rush_speed"),
        "ttest_summary": lambda s: s.tests(),
        "class_distribution": lambda s: s.class_distribution("jam_abs"),
        "feature_table": lambda s: features.feature_table(
            s.labelled, COLUMNS.features, s.label_names
        ),
        "impute_median": _impute_median,
        "standardize": _standardize,
        "impute_mode": lambda s: features.impute_mode(arithmetic_split(s.trips)[0], nominal),
        "category_frequencies": lambda s: features.category_frequencies(
            arithmetic_split(s.trips)[0], nominal, MIN_ROWS
        ),
        "infrequent_mapping": _infrequent_mapping,
        "encoded_features": _encoded_features,
        "feature_width": _feature_width,
        "baseline_metrics": lambda s: metrics.baseline_metrics(
            *arithmetic_split(s.labelled), "jam_abs"
        ),
        "confusion_matrix": lambda s: metrics.confusion_matrix(
            _supplied(s), "jam_abs", "prediction"
        ),
        "classification_metrics": lambda s: metrics.classification_metrics(
            _supplied(s), "jam_abs", "prediction"
        ),
        "classification_report": lambda s: metrics.classification_report(
            _supplied(s), "jam_abs", "prediction"
        ),
        "sample_exact": _sample_exact,
        "split_counts": _split_counts,
        "sample_rows": _sample_rows,
        "split_rows": _split_rows,
        "model_predictions": _model_predictions,
        "model_coverage": _model_coverage,
        "model_scores": _model_scores,
        "model_comparison": lambda s: s.model_comparison(),
    }

    def registered(build: Callable[[TripStudy], DataFrame]):
        return lambda spark, sf_dir: rounded(build(study_of(spark, sf_dir)))

    own = {name: registered(build) for name, build in table.items()}
    if corpus_queries is None:
        return own
    return own | corpus_queries.queries() | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = oracle_queries.oracle_sql()
    if corpus_queries is None:
        return own
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return own | corpus_queries.oracle_sql() | pipeline
