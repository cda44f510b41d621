"""NULL and NaN handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating-point column; other columns pass through."""
    return df.select(
        *[
            F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def is_true(condition: Column) -> Column:
    """A condition that is never NULL: unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def not_within(value: Column, low: float, high: float) -> Column:
    """True outside the closed interval, and for NULL."""
    return ~is_true(value.between(low, high))
