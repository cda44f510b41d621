"""Exact quantiles, global or per group, in two scans and without a task that holds a group.

The first scan builds a mergeable sketch per group (KLL, added up map-side), whose
quantiles bracket the wanted ranks.  The second one counts what lies below each
bracket and each value inside it; the running count over these values, a small part of
a group, ends at the wanted ranks.  Values outside the brackets are never shuffled or
sorted.  Where even a bracket would hold more than ``COUNTED_ROWS`` values, it is
narrowed by a sketch of its inside first, as often as it takes.

The sketch is random and may miss, the result may not: a rank that is not inside its
bracket shows in the counts, and the brackets are widened and counted again.  Input of
any size takes the same steps.

The brackets are one row per group and quantile.  For a whole column they come to the
driver; for groups they are staged, so that the planner knows their size and broadcasts
them if it is small.  With more groups than that, the second scan is a shuffled join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jamscope.staging import StagingArea

#: Size of the sketch: its ranks are off by about 0.13 percent of the rows (99 percent sure).
SKETCH_K = 4096
#: Quantiles read from a sketch, and how many of these steps a bracket goes beyond a rank.
GRID = 256
MARGIN = 1
#: Values of a bracket that are counted one by one.
COUNTED_ROWS = 1 << 22


def quantile_table(
    df: DataFrame,
    value: str | Column,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    method: str = "linear",
    staging: StagingArea | None = None,
) -> DataFrame:
    """Exact quantiles of a numeric column: one row per group, NULL keys kept.

    Columns: the ``by`` columns, ``n`` (non-NULL values), ``mean``, and one
    column per entry of ``probs`` (name -> probability).  ``method`` is
    ``"linear"`` (interpolate) or ``"nearest"`` (round half up to a rank), or
    ``"both"``, which adds a column ``<name>_nearest`` to each linear one.
    The scans run here; the result reads a row per group.
    """
    if method not in ("linear", "nearest", "both"):
        raise ValueError(f"unknown quantile method: {method}")
    staging = staging or StagingArea(df.sparkSession)
    keys, data = _keys(by), known_values(df, value, by)
    sketched = sketches(data, keys)
    margin = MARGIN
    while True:
        state = _kept(brackets(sketched, keys, probs, method, margin), by, staging)
        state = _narrowed(data, state, keys, by, staging, margin)
        found = _kept(_assemble(counted(data, state, keys), probs, by, method), by, staging)
        # A rank outside its bracket leaves a NULL; with a margin of the whole grid none can.
        missed = " OR ".join([f"`{c}` IS NULL" for c in probs] or ["false"])
        if margin > GRID or found.where(missed).isEmpty():
            return found
        margin = 8 * margin + 1


def _keys(by: Sequence[str]) -> list[str]:
    return list(by) or ["_all"]


def _kept(rows: DataFrame, by: Sequence[str], staging: StagingArea) -> DataFrame:
    """The rows computed once: on the driver for a whole column (a few rows), else staged."""
    if by:
        return staging.stage(rows, "quantiles").frame
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def known_values(df: DataFrame, value: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """The keys and ``_x``, the value as a double; rows without a value are left out."""
    expr = F.col(value) if isinstance(value, str) else value
    known = df.select(*by, expr.cast("double").alias("_x")).where(
        F.col("_x").isNotNull() & ~F.isnan("_x")
    )
    return known if by else known.withColumn("_all", F.lit(0))


def _sketch() -> Column:
    return F.kll_sketch_agg_double("_x", F.lit(SKETCH_K))


def _grid(sketch: str) -> Column:
    """Evenly spaced quantiles of a sketch, from its least to its largest value."""
    ranks = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    return F.kll_sketch_get_quantile_double(sketch, ranks)


def sketches(data: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``_total``, ``_mean`` and the ``_grid`` of quantiles of every group, in one scan."""
    found = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_total"), F.avg("_x").alias("_mean"), _sketch().alias("_s")
    )
    return found.select(*keys, "_total", "_mean", _grid("_s").alias("_grid"))


def _bracket(grid: Column, first: Column, last: Column, n: Column, margin: int) -> list[Column]:
    """Values that enclose the ranks ``first`` to ``last`` of n, by a sketch's grid."""
    low = F.floor(first * F.lit(float(GRID)) / n).cast("int") - F.lit(margin)
    high = F.ceil((last + 1) * F.lit(float(GRID)) / n).cast("int") + F.lit(margin)
    return [
        F.get(grid, F.greatest(low, F.lit(0))).alias("_low"),
        F.get(grid, F.least(high, F.lit(GRID))).alias("_high"),
    ]


def brackets(
    sketched: DataFrame, keys: Sequence[str], probs: Mapping[str, float], method: str, margin: int
) -> DataFrame:
    """A row per group and quantile: the two ranks that it is made of, and values around them.

    ``_inside`` is how many values the bracket has, about.
    """
    slots = []
    for i, p in enumerate(probs.values()):
        pos = (F.col("_total") - F.lit(1)) * F.lit(float(p))
        first = F.floor(pos + F.lit(0.5)) if method == "nearest" else F.floor(pos)
        last = first if method == "nearest" else F.ceil(pos)
        ranks = [x.cast("bigint").alias(name) for x, name in ((first, "_first"), (last, "_last"))]
        slots.append(F.struct(F.lit(i).alias("_slot"), *ranks))
    rows = sketched.select("*", F.inline(F.array(*slots)))
    share = F.lit(min(1.0, (2 * margin + 2) / GRID))
    return rows.select(
        *keys, "_total", "_mean", "_slot", "_first", "_last",
        *_bracket(F.col("_grid"), F.col("_first"), F.col("_last"), F.col("_total"), margin),
        F.ceil(F.col("_total") * share).alias("_inside"),
    )


STATE = ["_total", "_mean", "_slot", "_first", "_last"]


def _matched(data: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every value with the brackets of its group, but for those that it lies above."""
    condition = F.col("v._x") <= F.col("s._high")
    for k in keys:
        condition = condition & F.col(f"v.{k}").eqNullSafe(F.col(f"s.{k}"))
    columns = [F.col(f"s.{c}").alias(c) for c in state.columns]
    return data.alias("v").join(state.alias("s"), condition).select(*columns, F.col("v._x"))


def _narrowed(
    data: DataFrame,
    state: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    staging: StagingArea,
    margin: int,
) -> DataFrame:
    """Brackets with at most ``COUNTED_ROWS`` values inside, unless these are all alike."""
    while True:
        wide = (F.col("_inside") > COUNTED_ROWS) & (F.col("_low") < F.col("_high"))
        if state.where(wide).isEmpty():
            return state
        # Equal values at the ends are left out: what is inside always shrinks.
        between = (F.col("_x") > F.col("_low")) & (F.col("_x") < F.col("_high"))
        inner = F.when(between, F.col("_x"))
        carried = [*keys, *STATE, "_low", "_high"]
        rows = _matched(data, state.where(wide).drop("_inside"), keys)
        found = rows.groupBy(*carried).agg(
            F.count_if(F.col("_x") < F.col("_low")).alias("_below"),
            F.count_if(F.col("_x") == F.col("_low")).alias("_at_low"),
            F.count(inner).alias("_n"),
            F.kll_sketch_agg_double(inner, F.lit(SKETCH_K)).alias("_s"),
        )
        first = F.col("_first") - F.col("_below") - F.col("_at_low")
        last = F.col("_last") - F.col("_below") - F.col("_at_low")
        n = F.col("_n")
        ends = _bracket(F.col("_grid"), first, last, n, margin)
        # Ranks at the ends of the old bracket, or beyond, keep that end.
        low = F.when(first < 0, F.col("_low")).otherwise(ends[0])
        high = F.when(last >= n, F.col("_high")).otherwise(ends[1])
        high = F.when(last < 0, F.col("_low")).otherwise(high)
        low = F.when(first >= n, F.col("_high")).otherwise(low)
        share = F.lit(min(1.0, (2 * margin + 2) / GRID))
        found = found.withColumn("_grid", F.when(n > 0, _grid("_s"))).select(
            *keys, *STATE, low.alias("_low"), high.alias("_high"), F.ceil(n * share).alias("_inside")
        )
        state = _kept(found.unionByName(state.where(~wide)), by, staging)


def counted(data: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often each value inside a bracket stands in the data; NULL for all that lies below."""
    carried = [*keys, *STATE]
    rows = _matched(data, state.drop("_inside"), keys)
    value = F.when(F.col("_x") >= F.col("_low"), F.col("_x")).alias("_x")
    return rows.select(*carried, value).groupBy(*carried, "_x").agg(F.count(F.lit(1)).alias("_n"))


def _assemble(
    counts: DataFrame,
    probs: Mapping[str, float],
    by: Sequence[str],
    method: str,
) -> DataFrame:
    """Quantile columns from the values that the running counts reach at the wanted ranks."""
    keys = _keys(by)
    order = Window.partitionBy(*keys, "_slot").orderBy(F.asc_nulls_first("_x"))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("_upto", F.sum("_n").over(running))
    before = F.col("_upto") - F.col("_n")

    def value_at(rank: str, slot: int) -> Column:
        here = (F.col(rank) >= before) & (F.col(rank) < F.col("_upto")) & (F.col("_slot") == slot)
        return F.max(F.when(here, F.col("_x")))

    found = upto.groupBy(*keys).agg(
        F.max("_total").alias("n"),
        F.max("_mean").alias("mean"),
        *[
            value_at(rank, i).alias(f"{rank}{i}")
            for i in range(len(probs))
            for rank in ("_first", "_last")
        ],
    )
    outputs = []
    for i, (name, p) in enumerate(probs.items()):
        low, high = F.col(f"_first{i}"), F.col(f"_last{i}")
        if method == "nearest":
            outputs.append(low.alias(name))
            continue
        pos = (F.col("n") - F.lit(1)) * F.lit(float(p))
        between = low * (F.ceil(pos) - pos) + high * (pos - F.floor(pos))
        outputs.append(F.when(low == high, low).otherwise(between).alias(name))
        if method == "both":
            rounded_up = F.floor(pos + F.lit(0.5)) > F.floor(pos)
            outputs.append(F.when(rounded_up, high).otherwise(low).alias(f"{name}_nearest"))
    return found.select(*by, "n", "mean", *outputs)


def scalar_quantile(df: DataFrame, value: str | Column, prob: float) -> float | None:
    """One exact linear quantile of a whole column, on the driver; None without values."""
    row = quantile_table(df, value, {"q": prob}).select("q").first()
    return None if row is None or row["q"] is None else float(row["q"])
