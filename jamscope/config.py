"""Column names and thresholds of a study, all overridable."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ColumnMap:
    """Physical names of the trip columns (defaults: the public TLC yellow-cab schema)."""

    pickup: str = "tpep_pickup_datetime"
    dropoff: str = "tpep_dropoff_datetime"
    pu_zone: str = "PULocationID"
    do_zone: str = "DOLocationID"
    vendor: str = "VendorID"
    ratecode: str = "RatecodeID"
    distance: str = "trip_distance"
    passengers: str = "passenger_count"
    fare: str = "fare_amount"
    tip: str = "tip_amount"
    total: str = "total_amount"

    @property
    def required(self) -> list[str]:
        """Columns without which a trip cannot be analysed."""
        return [
            self.pickup,
            self.dropoff,
            self.pu_zone,
            self.do_zone,
            self.vendor,
            self.ratecode,
            self.distance,
            self.passengers,
            self.fare,
            self.tip,
            self.total,
        ]

    @property
    def lazy_scan(self) -> list[str]:
        """The only columns the raw speed aggregate reads."""
        return [
            self.pickup,
            self.dropoff,
            self.distance,
            self.pu_zone,
            self.do_zone,
            self.passengers,
        ]

    @property
    def statistics(self) -> list[str]:
        """Measures described and correlated; may hold post-trip information."""
        return [
            self.distance,
            "duration_min",
            "speed_mph",
            self.fare,
            self.tip,
            self.total,
            self.passengers,
        ]

    @property
    def numeric_features(self) -> list[str]:
        """Numeric model inputs known at pickup time."""
        return ["hour", "dow", "is_weekend", self.distance, self.passengers]

    @property
    def nominal_features(self) -> list[str]:
        """Coded model inputs known at pickup time; their magnitude means nothing."""
        return [self.pu_zone, self.do_zone, self.vendor, self.ratecode]

    @property
    def features(self) -> list[str]:
        return self.numeric_features + self.nominal_features


@dataclass(frozen=True)
class CleaningRules:
    """Bounds of the ordered cleaning rules (fixed values of the study, with its column names)."""

    period_start: dt.datetime = dt.datetime(2026, 5, 1)
    period_end: dt.datetime = dt.datetime(2026, 6, 1)  # exclusive
    min_duration: float = 1.0
    max_duration: float = 180.0
    min_speed: float = 1.0
    max_speed: float = 70.0
    max_distance: float = 50.0
    max_same_zone_distance: float = 10.0
    unknown_zones: tuple[int, ...] = (264, 265)
    unknown_ratecode: int = 99


@dataclass(frozen=True)
class ModelSettings:
    """Sampling, split and forest settings."""

    seed: int = 42
    sample_size: int | None = 200_000  # None trains on every row
    test_fraction: float = 0.2
    min_category_rows: int = 50
    trees: int = 100
    min_leaf_rows: int = 5
    max_depth: int = 15  # up to 30; each level is a pass over the sample
    max_bins: int = 32  # of numeric columns; a coded column gets a bin per slot
    histogram_mb: int = 256  # per task, for the histograms of the nodes of one pass


@dataclass(frozen=True)
class StudyConfig:
    """Everything a :class:`jamscope.TripStudy` needs to know besides the data."""

    columns: ColumnMap = field(default_factory=ColumnMap)
    cleaning: CleaningRules = field(default_factory=CleaningRules)
    model: ModelSettings = field(default_factory=ModelSettings)
    jam_quantile: float = 1 / 3
    min_route_trips: int = 30
    alpha: float = 0.05
    rush_hours: tuple[int, ...] = (7, 8, 9, 16, 17, 18, 19)
    min_zone_trips: int = 500
    top_zones: int = 20
    short_trip_miles: float = 1.0
    histogram_max_distance: float = 15.0
    histogram_bins: int = 60
    labels: tuple[tuple[str, str], ...] = (
        ("jam_abs", "slowest third of all trips"),
        ("jam_rel", "slowest third relative to the usual speed of the route"),
    )
