"""Descriptive statistics, correlations and Welch tests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jamscope.config import ColumnMap, StudyConfig
from jamscope.functions import rows as sql
from jamscope.functions.nulls import is_true
from jamscope.functions.student_t import two_sided_p
from jamscope.functions.trips import in_hours
from jamscope.operators.quantiles import quantile_table
from jamscope.sources.tables import available_columns
from jamscope.staging import StagingArea


def _long(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns turned into (variable, value) rows, as doubles."""
    entries = [[sql.text(n), f"CAST({sql.name(n)} AS DOUBLE)"] for n in names]
    return df.selectExpr(*map(sql.name, keep), sql.stack(["variable", "value"], entries))


def describe_numeric(
    df: DataFrame,
    names: Sequence[str],
    staging: StagingArea | None = None,
) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, a row per column.

    Columns that do not exist are left out.
    """
    names = available_columns(df, names)
    measures = {
        "count": "count({0})",
        "mean": "avg({0})",
        "std": "stddev_samp({0})",
        "min": "min(CAST({0} AS DOUBLE))",
        "max": "max(CAST({0} AS DOUBLE))",
    }
    moments = df.selectExpr(
        *[
            f"{expr.format(sql.name(n))} AS _{k}{i}"
            for i, n in enumerate(names)
            for k, expr in measures.items()
        ]
    ).selectExpr(
        sql.stack(
            ["variable", *measures],
            [[sql.text(n), *[f"_{k}{i}" for k in measures]] for i, n in enumerate(names)],
        )
    )
    quartiles = quantile_table(
        _long(df, names),
        "value",
        {"p25": 0.25, "median": 0.5, "p75": 0.75},
        by=["variable"],
        staging=staging,
    ).drop("n", "mean")
    # One row per column of the table on either side.
    return moments.join(F.broadcast(quartiles), "variable", "left").select(
        "variable", "count", "mean", "std", "min", "p25", "median", "p75", "max"
    )


def correlation_matrix(
    df: DataFrame, names: Sequence[str], complete: bool = False
) -> DataFrame:
    """Pearson correlation of every pair, in long form (row_var, col_var, r), in one pass.

    Each pair uses the rows where both values are known; a constant column
    gives NULL.  ``complete`` states that no value is NULL: then one variance
    per column serves all its pairs.
    """
    names = available_columns(df, names)
    known = {n: f"CAST({sql.name(n)} AS DOUBLE)" for n in names}
    spreads = [f"var_pop({known[n]}) AS v{i}" for i, n in enumerate(names)]
    for i, a in enumerate(names):
        for j, b in enumerate(names[i + 1 :], start=i + 1):
            spreads.append(f"covar_pop({known[a]}, {known[b]}) AS c{i}_{j}")
            if not complete:
                both = f"FILTER (WHERE {known[a]} IS NOT NULL AND {known[b]} IS NOT NULL)"
                spreads.append(f"var_pop({known[a]}) {both} AS v{i}_{j}")
                spreads.append(f"var_pop({known[b]}) {both} AS v{j}_{i}")

    def cell(i: int, j: int) -> str:
        if i == j:
            return f"if(v{i} > 0, 1D, NULL)"
        a, b = (f"v{i}", f"v{j}") if complete else (f"v{i}_{j}", f"v{j}_{i}")
        return f"try_divide(c{min(i, j)}_{max(i, j)}, sqrt({a}) * sqrt({b}))"

    cells = [
        [sql.text(a), sql.text(b), cell(i, j)]
        for i, a in enumerate(names)
        for j, b in enumerate(names)
    ]
    return df.selectExpr(*spreads).selectExpr(sql.stack(["row_var", "col_var", "r"], cells))


def top_correlations(
    matrix: DataFrame, names: Sequence[str], target: str, n: int = 5
) -> DataFrame:
    """The variables most correlated with ``target`` by absolute value, itself excluded."""
    if target not in names:
        raise KeyError(f"no correlations for {target!r}")
    return (
        matrix.where((F.col("row_var") == target) & (F.col("col_var") != target))
        .select(F.col("col_var").alias("variable"), "r", F.abs("r").alias("abs_r"))
        .orderBy(F.desc_nulls_last("abs_r"), "variable")
        .limit(n)
    )


@dataclass(frozen=True)
class WelchTest:
    """A two-sample comparison of a column: rows with ``flag`` true against rows with it false."""

    name: str
    flag: Column
    value: str | Column


def standard_tests(config: StudyConfig) -> list[WelchTest]:
    """The three tests of a study."""
    c: ColumnMap = config.columns
    return [
        WelchTest("jam_distance", F.col("jam_abs") == 1, c.distance),
        WelchTest("weekend_speed", F.col("is_weekend") == 1, "speed_mph"),
        WelchTest("rush_speed", in_hours(F.col("hour"), config.rush_hours), "speed_mph"),
    ]


def welch_tests(
    df: DataFrame,
    tests: Sequence[WelchTest],
    alpha: float = 0.05,
    by: Sequence[str] = (),
) -> DataFrame:
    """Welch's t-test for each comparison, a row each (and per ``by`` group), in one pass.

    The distributed part is one aggregate of counts, means and variances; the
    job fails if a side of a test has fewer than two values.
    """
    moments = []
    for i, test in enumerate(tests):
        flag = is_true(test.flag)
        value = F.col(f"`{test.value}`") if isinstance(test.value, str) else test.value
        for side, member in (("a", flag), ("b", ~flag)):
            v = F.when(member, value.cast("double"))
            moments += [
                F.count(v).alias(f"_n{side}{i}"),
                F.avg(v).alias(f"_m{side}{i}"),
                F.var_samp(v).alias(f"_v{side}{i}"),
            ]
    return score_welch(df.groupBy(*by).agg(*moments), [t.name for t in tests], alpha, by)


def score_welch(
    wide: DataFrame, names: Sequence[str], alpha: float = 0.05, by: Sequence[str] = ()
) -> DataFrame:
    """Test results from counts, means and variances of both sides (``_na0``, ``_ma0``, ``_va0``,
    ``_nb0`` ... for the first test) in one row per group."""
    picked = ["n_a", "n_b", "mean_a", "mean_b", "var_a", "var_b"]
    long = wide.selectExpr(
        *map(sql.name, by),
        sql.stack(
            ["test", *picked],
            [
                [sql.text(test), *[f"_{k}{s}{i}" for k in "nmv" for s in "ab"]]
                for i, test in enumerate(names)
            ],
        ),
    )
    too_few = (F.col("n_a") < 2) | (F.col("n_b") < 2)
    checked = long.withColumn(
        "n_a",
        F.when(
            too_few,
            F.raise_error(
                F.concat(F.lit("a side has fewer than two values: "), F.col("test"))
            ).cast("bigint"),
        ).otherwise(F.col("n_a")),
    )
    sa, sb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    dof = F.try_divide(
        (sa + sb) * (sa + sb), sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1)
    )
    scored = checked.select(
        *by,
        "test",
        "n_a",
        "n_b",
        "mean_a",
        "mean_b",
        (F.col("mean_a") - F.col("mean_b")).alias("diff"),
        F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(sa + sb)).alias("t"),
        dof.alias("dof"),
    )
    return scored.withColumn("p", two_sided_p("t", "dof")).withColumn(
        "verdict", interpret_p(F.col("p"), alpha)
    )


def interpret_p(p: Column, alpha: float = 0.05) -> Column:
    """Whether equal means are rejected at level ``alpha``."""
    return F.when(p < alpha, F.lit("significant")).otherwise(F.lit("not significant"))
