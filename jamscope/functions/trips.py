"""Expressions and derived columns of a single trip."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jamscope.config import ColumnMap
from jamscope.functions.nulls import is_true
from jamscope.sources.tables import require_columns

# Short weekday names, Monday first.
WEEKDAY_NAMES = ["월", "화", "수", "목", "금", "토", "일"]


def duration_minutes(start: Column, end: Column) -> Column:
    """Minutes between two timestamps, fractions of a second kept.

    A difference of microseconds, read as seconds: no calendar or time zone comes in.
    """
    seconds = (end - start).cast("interval second").cast("decimal(18,6)")
    return seconds.cast("double") / F.lit(60.0)


def speed_mph(distance: Column, minutes: Column) -> Column:
    """Miles per hour; NULL where no time passed."""
    return F.try_divide(distance, minutes / F.lit(60.0))


def in_hours(hour: Column, hours: Iterable[int]) -> Column:
    return hour.isin(*hours)


def weekday_name(dow: Column) -> Column:
    """Name of a weekday counted from Monday = 0."""
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), dow + F.lit(1))


def add_time_features(df: DataFrame, columns: ColumnMap | None = None) -> DataFrame:
    """Add ``duration_min``, ``hour``, ``dow`` (Monday = 0) and ``is_weekend``."""
    c = columns or ColumnMap()
    require_columns(df, [c.pickup, c.dropoff])
    pickup = F.col(c.pickup)
    return df.withColumns(
        {
            "duration_min": duration_minutes(pickup, F.col(c.dropoff)),
            "hour": F.hour(pickup),
            "dow": F.weekday(pickup),
            "is_weekend": is_true(F.weekday(pickup) >= 5).cast("int"),
        }
    )


def add_speed(df: DataFrame, columns: ColumnMap | None = None, strict: bool = False) -> DataFrame:
    """Add ``speed_mph``.

    ``strict`` fails the job on a duration of zero or less; otherwise such a
    row gets NULL (zero) or a negative speed, for a later rule to drop.
    """
    c = columns or ColumnMap()
    require_columns(df, ["duration_min", c.distance])
    speed = speed_mph(F.col(c.distance), F.col("duration_min"))
    if strict:
        speed = F.when(
            F.col("duration_min") <= 0,
            F.raise_error(F.lit("duration_min holds values of zero or less")).cast("double"),
        ).otherwise(speed)
    return df.withColumn("speed_mph", speed)
