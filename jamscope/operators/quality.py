"""Profiles of missing data, duplicates and differences between two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jamscope.config import CleaningRules, ColumnMap
from jamscope.functions import rows as sql
from jamscope.functions.nulls import is_true
from jamscope.operators.quantiles import quantile_table
from jamscope.staging import StagingArea


def _null_counts(df: DataFrame) -> DataFrame:
    """One row per column: position, name, NULLs, rows.  One pass, one row, then unpivoted."""
    counts = df.selectExpr(
        "count(*) AS _rows",
        *[f"count_if({sql.name(c)} IS NULL) AS _n{i}" for i, c in enumerate(df.columns)],
    )
    entries = [[str(i), sql.text(c), f"_n{i}"] for i, c in enumerate(df.columns)]
    return counts.selectExpr("_rows", sql.stack(["position", "column", "n_null"], entries))


def null_profile(df: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Columns that hold NULLs: count, percent of rows, and the NULL cells of the whole table.

    With the table's ``patterns`` (see :func:`missing_patterns`) at hand the
    table itself is not read.
    """
    counts = _null_counts(df) if patterns is None else _pattern_counts(df.columns, patterns)
    everywhere = Window.partitionBy(F.lit(0))  # as many rows as the table has columns
    return (
        counts.withColumn("total_null", F.sum("n_null").over(everywhere))
        .where(F.col("n_null") > 0)
        .select(
            "column",
            "n_null",
            (F.col("n_null") / F.col("_rows") * 100).alias("pct_null"),
            "total_null",
        )
    )


def _pattern_counts(columns: Sequence[str], patterns: DataFrame) -> DataFrame:
    """What :func:`_null_counts` gives, from the NULL patterns."""
    counts = patterns.selectExpr(
        "coalesce(sum(n_rows), 0) AS _rows",
        *[
            f"coalesce(sum(n_rows) FILTER (WHERE substr(pattern, {i + 1}, 1) = '1'), 0) AS _n{i}"
            for i in range(len(columns))
        ],
    )
    entries = [[str(i), sql.text(c), f"_n{i}"] for i, c in enumerate(columns)]
    return counts.selectExpr("_rows", sql.stack(["position", "column", "n_null"], entries))


def null_count_reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """NULLs per column of two tables, matched by column name.

    A column the right table lacks shows NULL there and does not match.
    """
    a = _null_counts(left).select("position", "column", F.col("n_null").alias("n_null_left"))
    b = _null_counts(right).select("column", F.col("n_null").alias("n_null_right"))
    everywhere = Window.partitionBy(F.lit(0))
    return (
        a.join(b, "column", "left")
        .withColumn("match", F.col("n_null_left").eqNullSafe(F.col("n_null_right")))
        .select(
            "column",
            "n_null_left",
            "n_null_right",
            "match",
            F.every("match").over(everywhere).alias("all_match"),
            F.sum("n_null_left").over(everywhere).alias("total_null_left"),
        )
    )


def sentinel_profile(
    df: DataFrame, columns: ColumnMap | None = None, rules: CleaningRules | None = None
) -> DataFrame:
    """Rows whose codes mean "unknown", which no NULL count sees, and what is done with them."""
    c, r = columns or ColumnMap(), rules or CleaningRules()
    unknown_rate = is_true(F.col(c.ratecode) == r.unknown_ratecode)
    unknown_zone = touches_zone(c, r.unknown_zones)
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(unknown_rate).alias("_rate"),
        F.count_if(unknown_zone).alias("_zone"),
    )
    entries = sql.stack(
        ["item", "n_rows", "policy"],
        [
            ["'unknown_ratecode'", "_rate", "'keep as a category'"],
            ["'unknown_zone'", "_zone", "'drop'"],
        ],
    )
    return counts.selectExpr("_rows", entries).select(
        "item", "n_rows", F.try_divide(F.col("n_rows") * 100, F.col("_rows")).alias("pct"), "policy"
    )


def touches_zone(c: ColumnMap, zones: Sequence[int]) -> Column:
    """True where the trip starts or ends in one of the zones."""
    return is_true(F.col(c.pu_zone).isin(*zones)) | is_true(F.col(c.do_zone).isin(*zones))


def missing_patterns(df: DataFrame) -> DataFrame:
    """Which columns are NULL together: one row per distinct NULL mask.

    ``pattern`` has one character per column, in column order, 1 = NULL.
    """
    bits = ", ".join(f"if({sql.name(c)} IS NULL, '1', '0')" for c in df.columns)
    return (
        df.selectExpr(f"concat({bits}) AS pattern")
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def missing_block(df: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Do several columns share one and the same NULL mask?  One row with the verdict.

    As a base serves the first column that holds a NULL; ``columns`` names the
    columns whose mask equals the base mask (all NULL-bearing columns if there
    is no such block).
    """
    names = df.columns
    patterns = missing_patterns(df) if patterns is None else patterns
    base = patterns.agg(
        F.min(F.when(F.instr("pattern", "1") > 0, F.instr("pattern", "1"))).alias("_base")
    )
    with_base = patterns.crossJoin(F.broadcast(base))  # one row
    base_bit = "substr(pattern, _base, 1)"
    bits = [f"substr(pattern, {i + 1}, 1)" for i in range(len(names))]
    counts = with_base.selectExpr(
        "coalesce(sum(n_rows), 0) AS total",
        f"coalesce(sum(n_rows) FILTER (WHERE {base_bit} = '1'), 0) AS base_rows",
        *[
            f"coalesce(sum(n_rows) FILTER (WHERE {b} = '1'), 0) AS _n{i}"
            for i, b in enumerate(bits)
        ],
        *[
            f"coalesce(sum(n_rows) FILTER (WHERE {b} <> {base_bit}), 0) AS _d{i}"
            for i, b in enumerate(bits)
        ],
    )

    def names_where(condition: str) -> str:
        flagged = ", ".join(
            f"if({condition.format(i=i)}, {sql.text(c)}, NULL)" for i, c in enumerate(names)
        )
        return f"array_compact(array({flagged}))"

    picked = counts.selectExpr(
        "total",
        "base_rows",
        names_where("_n{i} > 0 AND _d{i} = 0") + " AS identical",
        names_where("_n{i} > 0") + " AS bearing",
    )
    return picked.selectExpr(
        "size(identical) > 1 AS has_block",
        "array_join(if(size(identical) > 1, identical, bearing), ',') AS columns",
        "if(size(identical) > 1, base_rows, 0) AS block_rows",
        "coalesce(try_divide(if(size(identical) > 1, base_rows, 0), total), 0D) AS block_ratio",
    )


def block_base(columns: Sequence[str], patterns: DataFrame) -> str | None:
    """The first column that holds a NULL, if other columns are NULL in the very same rows."""
    base = patterns.agg(
        F.min(F.when(F.instr("pattern", "1") > 0, F.instr("pattern", "1"))).alias("_base")
    )
    same = [
        f"count_if(substr(pattern, {i + 1}, 1) <> substr(pattern, _base, 1)) = 0"
        for i in range(len(columns))
    ]
    row = patterns.crossJoin(F.broadcast(base)).selectExpr(  # one row
        "max(_base) AS base", f"array({', '.join(same)}) AS same"
    ).first()
    if row["base"] is None or sum(row["same"]) < 2:
        return None
    return columns[row["base"] - 1]


def missing_block_by_group(df: DataFrame, block_column: str | None, group: str) -> DataFrame:
    """Rows of each group inside and outside the block where ``block_column`` is NULL.

    ``presence`` tells groups found only inside or only outside.  Without a
    block column there is no block, and no row.
    """
    inside = F.lit(False) if block_column is None else F.col(block_column).isNull()
    return (
        df.where(F.col(group).isNotNull() & F.lit(block_column is not None))
        .groupBy(group)
        .agg(F.count_if(inside).alias("n_block"), F.count_if(~inside).alias("n_rest"))
        .withColumn(
            "presence",
            F.when(F.col("n_rest") == 0, "block_only")
            .when(F.col("n_block") == 0, "rest_only")
            .otherwise("both"),
        )
    )


COPIES = "n_copies"
#: Bits of the filter per digest that several rows have, and the most bits (as a power of two).
BITS_PER_DIGEST = 16
MOST_FILTER_BITS = 26


def _digest(df: DataFrame) -> Column:
    """A 64-bit digest of a row; equal rows have equal ones, the converse is not relied on.

    A NULL leaves a hash as it is, so the digest also sees which columns are NULL.
    """
    columns = [F.col(sql.name(c)) for c in df.columns]
    return F.xxhash64(F.lit(1), *[c.isNull() for c in columns], *columns)


def _may_repeat(df: DataFrame, staging: StagingArea) -> DataFrame:
    """``df`` with ``_again``: whether the digest of a row may be one that several rows have.

    Only digests are shuffled, counted map-side.  The repeated ones set bits of a filter, whose
    64-bit words are a small table that is broadcast: a million words at most, so with very many
    repeated digests more rows are flagged, never fewer.
    """
    marked = df.withColumn("_digest", _digest(df))
    counts = marked.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"))
    several = staging.stage(counts.where("_n > 1").select("_digest"), "repeated_digests")
    wanted = max(128, several.rows * BITS_PER_DIGEST)
    bits = min(MOST_FILTER_BITS, (wanted - 1).bit_length())
    word = F.shiftrightunsigned("_digest", 70 - bits)  # leading bits; the last six name a bit
    bit = "shiftleft(1L, CAST(_digest & 63 AS INT))"
    words = several.frame.groupBy(word.alias("_word")).agg(F.expr(f"bit_or({bit})").alias("_bits"))
    words = staging.stage(words, "repeated_filter").frame
    again = F.expr(f"coalesce(_bits & {bit}, 0L) <> 0").alias("_again")
    return (
        marked.withColumn("_word", word)
        .join(F.broadcast(words), "_word", "left")  # 2 ** (MOST_FILTER_BITS - 6) rows at most
        .select(*[F.col(sql.name(c)) for c in df.columns], again)
    )


def count_copies(df: DataFrame, staging: StagingArea | None = None) -> DataFrame:
    """The distinct rows (NULL equals NULL) with the number of their copies.

    Rows whose digest is their own pass as they are; the others, and the few that the filter
    does not tell from them, are grouped by all columns.  No other row is shuffled, whatever
    the size of the table.
    """
    flagged = _may_repeat(df, staging or StagingArea(df.sparkSession))
    columns = [F.col(sql.name(c)) for c in df.columns]
    alone = flagged.where("NOT _again").select(*columns, F.lit(1).cast("bigint").alias(COPIES))
    again = flagged.where("_again").groupBy(*columns).agg(F.count(F.lit(1)).alias(COPIES))
    return alone.unionByName(again)


def duplicate_count(df: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """Rows that repeat an earlier row in every column; ``copies`` if they are counted already."""
    copies = count_copies(df) if copies is None else copies
    return copies.agg(
        F.coalesce(F.sum(COPIES), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).alias("n_duplicates"),
    )


def dedup_rows(df: DataFrame, staging: StagingArea | None = None) -> DataFrame:
    """One copy of every distinct row."""
    return count_copies(df, staging).drop(COPIES)


def aggregate_reconcile(
    left: DataFrame, right: DataFrame, key: str, measures: Sequence[str]
) -> DataFrame:
    """Two aggregate tables side by side on a nullable key; NULL keys match each other."""
    a = left.select(F.col(key).alias("_ka"), *[F.col(m).alias(f"{m}_left") for m in measures])
    b = right.select(F.col(key).alias("_kb"), *[F.col(m).alias(f"{m}_right") for m in measures])
    return a.join(b, F.col("_ka").eqNullSafe(F.col("_kb")), "full_outer").select(
        F.coalesce("_ka", "_kb").alias(key),
        *[f"{m}_left" for m in measures],
        *[f"{m}_right" for m in measures],
    )


def aggregate_reconcile_summary(
    left: DataFrame, right: DataFrame, key: str, count: str
) -> DataFrame:
    """Groups on either side, and the rows in the right side's NULL group (0 without one)."""
    a = left.agg(F.count(F.lit(1)).alias("groups_left"))
    b = right.agg(
        F.count(F.lit(1)).alias("groups_right"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col(count))), F.lit(0)).alias(
            "null_group_trips"
        ),
    )
    return a.crossJoin(F.broadcast(b))  # one row each


def quantile_interpolation(
    df: DataFrame, column: str, probs: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Quantiles with linear and nearest-rank interpolation, and whether the two differ."""
    named = {f"q{i}": p for i, p in enumerate(probs)}
    entries = [[f"{float(p)!r}D", k, f"{k}_nearest"] for k, p in named.items()]
    return (
        quantile_table(df, column, named, method="both")
        .selectExpr(sql.stack(["prob", "linear", "nearest"], entries))
        .withColumn("differs", F.col("linear") != F.col("nearest"))
    )


def quantile_reconcile(
    left: DataFrame,
    right: DataFrame,
    column: str,
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    staging: StagingArea | None = None,
) -> DataFrame:
    """Quantiles of a column in two tables, under both interpolation rules.

    Both tables are ranked in the same two scans, told apart by a tag.
    ``sides_differ`` compares the linear quantiles of the tables, ``rules_differ``
    the linear one of the left with the nearest-rank one of the right, which is
    what two libraries with different defaults would report.  A table without
    values has NULLs, which differ from any value.
    """
    named = {f"q{i}": p for i, p in enumerate(probs)}
    sides = [
        df.select(F.lit(side).alias("side"), F.col(sql.name(column)).cast("double").alias("value"))
        for side, df in (("left", left), ("right", right))
    ]
    found = quantile_table(
        sides[0].unionByName(sides[1]), "value", named, ["side"], "both", staging
    )
    entries = [[f"{float(p)!r}D", k, f"{k}_nearest"] for k, p in named.items()]
    long = found.selectExpr("side", sql.stack(["prob", "linear", "nearest"], entries))
    wanted = left.sparkSession.createDataFrame([(float(p),) for p in probs], "prob double")
    of_side = [
        F.max(F.when(F.col("side") == side, F.col(rule))).alias(f"{rule}_{side}")
        for side in ("left", "right")
        for rule in ("linear", "nearest")
    ]
    return (
        wanted.join(long, "prob", "left")
        .groupBy("prob")
        .agg(*of_side)
        .withColumns(
            {
                "sides_differ": ~F.col("linear_left").eqNullSafe(F.col("linear_right")),
                "rules_differ": ~F.col("linear_left").eqNullSafe(F.col("nearest_right")),
            }
        )
    )
