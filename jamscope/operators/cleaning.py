"""The ordered cleaning rules: the cleaned table, and how many rows each rule removed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jamscope.config import CleaningRules, ColumnMap
from jamscope.functions import rows as sql
from jamscope.functions.nulls import is_true, not_within
from jamscope.functions.trips import (
    add_speed,
    add_time_features,
    duration_minutes,
    speed_mph,
)
from jamscope.operators.quality import COPIES, count_copies, dedup_rows, touches_zone
from jamscope.sources.tables import require_columns
from jamscope.staging import StagingArea

DUPLICATES = "duplicate rows"


@dataclass(frozen=True)
class Rule:
    """A named removal condition that is never NULL; without one it stands for duplicates."""

    name: str
    removes: Column | None


def within_period(c: ColumnMap, r: CleaningRules) -> Column:
    """The pickup lies in the observation period.  The bounds are wall-clock literals, which no
    time zone, of the session or of the driver, moves."""
    start, end = (
        F.expr(f"TIMESTAMP_NTZ '{t:%Y-%m-%d %H:%M:%S.%f}'") for t in (r.period_start, r.period_end)
    )
    return (F.col(c.pickup) >= start) & (F.col(c.pickup) < end)


def cleaning_rules(
    columns: ColumnMap | None = None, rules: CleaningRules | None = None
) -> list[Rule]:
    """The rules in order.  A row counts under the first rule that removes it.

    Each condition says what an unknown value does: an unknown time, duration
    or speed is removed, an unknown fare or distance is not.
    """
    c, r = columns or ColumnMap(), rules or CleaningRules()
    missing = F.lit(False)
    for name in c.required:
        missing = missing | F.col(name).isNull()
    duration = duration_minutes(F.col(c.pickup), F.col(c.dropoff))
    in_period = is_true(within_period(c, r))
    speed = speed_mph(F.col(c.distance), duration)
    distance = F.col(c.distance)
    return [
        Rule("required column missing", missing),
        Rule(DUPLICATES, None),
        Rule("outside observation period", ~in_period),
        Rule("duration out of range", not_within(duration, r.min_duration, r.max_duration)),
        Rule("speed out of range", not_within(speed, r.min_speed, r.max_speed)),
        Rule("fare not positive", is_true(F.col(c.fare) <= 0)),
        Rule("distance too long", is_true(distance > r.max_distance)),
        Rule("unknown zone", touches_zone(c, r.unknown_zones)),
        Rule(
            "same zone but far",
            is_true((F.col(c.pu_zone) == F.col(c.do_zone)) & (distance > r.max_same_zone_distance)),
        ),
    ]


def clean_trips(
    trips: DataFrame,
    columns: ColumnMap | None = None,
    rules: CleaningRules | None = None,
    copies: DataFrame | None = None,
    staging: StagingArea | None = None,
) -> DataFrame:
    """Raw trips that pass every rule, one copy each, with time features and ``speed_mph``.

    Copies of a row share the fate of the row, so the row-wise rules go first
    and duplicates are looked for among survivors, without derived columns.
    Given the distinct rows (see :func:`count_copies`), nothing is shuffled.
    """
    c, r = columns or ColumnMap(), rules or CleaningRules()
    require_columns(trips, c.required)
    # The raw range comes first on its own: in this form it reaches the Parquet scan.
    rows = trips if copies is None else copies.drop(COPIES)
    kept = rows.where(within_period(c, r)).na.drop(how="any", subset=c.required)
    for rule in cleaning_rules(c, r):
        if rule.removes is not None:
            kept = kept.where(~rule.removes)
    if copies is None:
        kept = dedup_rows(kept, staging)
    return add_speed(add_time_features(kept, c), c)


def clean_audit(
    trips: DataFrame,
    columns: ColumnMap | None = None,
    rules: CleaningRules | None = None,
    copies: DataFrame | None = None,
) -> DataFrame:
    """Raw rows removed and left after each rule (step 0 is the start), in one pass.

    Each row is labelled with the first rule that removes it.  Only rows whose
    digest repeats are shuffled whole, to bring copies together; rows without a
    required value end before the duplicate rule, so they collapse to a few.
    Given the distinct rows (see :func:`count_copies`), there is no such shuffle.
    """
    c = columns or ColumnMap()
    require_columns(trips, c.required)
    ordered = cleaning_rules(c, rules)
    first, second, later = ordered[0], ordered[1], ordered[2:]
    if second.name != DUPLICATES or first.removes is None:
        raise ValueError("the duplicate rule comes second")

    dropped = first.removes
    verdict = F.when(dropped, F.lit(1))
    for i, rule in enumerate(later, start=3):
        verdict = verdict.when(rule.removes, F.lit(i))
    verdict = verdict.otherwise(F.lit(0)).alias("_rule")
    if copies is None:
        known = [F.when(~dropped, F.col(n)).alias(n) for n in trips.columns]
        labelled = count_copies(trips.select(verdict, *known))
    else:
        labelled = copies.select(verdict, COPIES)
    per_rule = labelled.groupBy("_rule").agg(
        F.sum(COPIES).alias("_rows"), F.count(F.lit(1)).alias("_distinct")
    )
    # One row per rule from here on.
    totals = per_rule.selectExpr(
        "coalesce(sum(_rows), 0) AS _start",
        "coalesce(sum(_rows) FILTER (WHERE _rule = 1), 0) AS _r1",
        "coalesce(sum(_rows - _distinct) FILTER (WHERE _rule <> 1), 0) AS _r2",
        *[
            f"coalesce(sum(_distinct) FILTER (WHERE _rule = {i}), 0) AS _r{i}"
            for i in range(3, len(ordered) + 1)
        ],
    )
    entries = [["0", "'start'", "0L"]]
    entries += [[str(i), sql.text(rule.name), f"_r{i}"] for i, rule in enumerate(ordered, start=1)]
    so_far = (
        Window.partitionBy(F.lit(0))
        .orderBy("step")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return totals.selectExpr(
        "_start", sql.stack(["step", "rule", "removed"], entries)
    ).select(
        "step",
        "rule",
        "removed",
        (F.col("_start") - F.sum("removed").over(so_far)).alias("remaining"),
    )
