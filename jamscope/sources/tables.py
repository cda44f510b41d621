"""Parquet scans, column checks and table sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jamscope.functions.nulls import nan_to_null


def read_table(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Scan Parquet files, NaN turned into NULL.

    ``columns`` only narrows the result: the scan itself is pruned to whatever
    the later plan uses.  Every failure to open the files is a ``RuntimeError``.
    """
    path_list = [paths] if isinstance(paths, str) else list(paths)
    try:
        df = spark.read.parquet(*path_list)
        if columns is not None:
            df = df.select(*columns)
        return nan_to_null(df)
    except AnalysisException as exc:
        raise RuntimeError(f"cannot read {path_list}: {exc}") from exc


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    """The first of several candidate Parquet paths that exists."""
    for path in candidates:
        try:
            spark.read.parquet(path)
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" in str(exc):
                continue
            raise
        return path
    raise FileNotFoundError("none of these paths exists: " + ", ".join(candidates))


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raise ``KeyError`` if a column is absent."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise KeyError(f"columns not found: {missing}")


def available_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The requested columns that exist, in the requested order."""
    present = set(df.columns)
    return [n for n in names if n in present]


def shape_reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows and columns of two tables side by side, and whether they agree."""
    n_left, n_right = len(left.columns), len(right.columns)
    rows = left.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(
        F.broadcast(right.agg(F.count(F.lit(1)).alias("n_rows_right")))  # one row
    )
    return rows.select(
        "n_rows",
        F.lit(n_left).alias("n_cols"),
        "n_rows_right",
        F.lit(n_right).alias("n_cols_right"),
        ((F.col("n_rows") == F.col("n_rows_right")) & F.lit(n_left == n_right)).alias(
            "shape_match"
        ),
    )


def write_tables(
    tables: Mapping[str, DataFrame],
    directory: str,
    fmt: str = "parquet",
    parallel: int = 4,
) -> dict[str, str]:
    """Write each table as its own Parquet or CSV dataset below ``directory``.

    Result tables are many and small, so several write jobs run side by side;
    each failure surfaces when all have ended.
    """
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown table format: {fmt}")

    def write(item: tuple[str, DataFrame]) -> tuple[str, str]:
        name, df = item
        path = f"{directory.rstrip('/')}/{name}"
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).csv(path)
        else:
            writer.parquet(path)
        return name, path

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return dict(pool.map(write, tables.items()))


def double_columns(df: DataFrame) -> list[str]:
    """Names of the floating-point columns."""
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
