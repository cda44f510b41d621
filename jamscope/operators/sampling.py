"""Samples and splits of exact size that depend on the rows alone.

Every row has a place in a pseudorandom order: a seeded 60-bit hash, of all its
columns unless the caller names another.  A sample of k rows is the k first.
The k-th place is narrowed down without sorting: counts per leading bits of the
hash, one aggregate with a fixed number of groups, say which range holds it,
until the range has few rows.  The sample is then a filter, with no shuffle of
rows.  Rows tied at the cut come in as far as they are needed.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_BITS = 60
#: Bits of the hash that one round of counting looks at.
ROUND_BITS = 15
#: Hashes that are fetched to be put in order.
FEW_ROWS = 1000
#: Classes of a split come to the driver one row each; more than this is an error.
MOST_CLASSES = 100_000


def row_order(columns: Sequence[str], seed: int) -> Column:
    """The place of a row: a 60-bit hash of its columns."""
    cols = [F.col(f"`{c}`") for c in columns]
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 64 - HASH_BITS)


def portable_order(columns: Sequence[str], seed: int) -> Column:
    """A place that other engines can compute as well, from the text of some columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(f"`{c}`").cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


@dataclass(frozen=True)
class Cut:
    """The k-th smallest place, the rows before it, and the rows at it."""

    place: int
    before: int
    tied: int


def find_cut(df: DataFrame, order: Column, k: int) -> Cut:
    """Where the first k rows of a table of at least k rows end (k > 0)."""
    places = df.select(order.alias("o"))
    before, low, shift = 0, 0, HASH_BITS
    while True:
        shift -= ROUND_BITS
        bucket = F.shiftright("o", shift).alias("b")
        counts = places.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).collect()
        for row in sorted(counts, key=lambda r: r["b"]):
            if before + row["n"] >= k:
                break
            before += row["n"]
        else:
            raise ValueError(f"fewer than {k} rows to choose from")
        low, size = row["b"] << shift, row["n"]
        places = places.where((F.col("o") >= low) & (F.col("o") < low + (1 << shift)))
        if not shift:
            return Cut(low, before, size)
        if size <= FEW_ROWS:
            found = sorted(r["o"] for r in places.collect())
            place = found[k - before - 1]
            return Cut(place, before + found.index(place), found.count(place))


def find_cuts(
    df: DataFrame, label: str, order: Column, wanted: Mapping[Any, int]
) -> dict[Any, Cut]:
    """Where the first ``wanted[c]`` rows (more than 0) of each class c end, for all classes at once.

    A round counts rows per class and leading bits of the place, and running
    sums per class, over ``2 ** ROUND_BITS`` rows at most, say which range holds
    the cut.  The driver gets one row per class and round.
    """
    places = df.select(F.col(f"`{label}`").alias("c"), order.alias("o"))
    schema = T.StructType(
        [
            T.StructField("c", df.schema[label].dataType),
            T.StructField("k", T.LongType()),
            T.StructField("low", T.LongType()),
        ]
    )
    before, low, last = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 0), HASH_BITS
    tied: dict[Any, int] = {}
    few = False
    while last and wanted:
        shift = 0 if few else last - ROUND_BITS
        rows = [(c, k - before[c], low[c]) for c, k in wanted.items()]
        ranges = df.sparkSession.createDataFrame(rows, schema)
        near = places.join(F.broadcast(ranges), "c").where(  # one row per class
            (F.col("o") >= F.col("low")) & (F.col("o") - F.col("low") < (1 << last))
        )
        counts = near.groupBy("c", "k", F.shiftright("o", shift).alias("b")).agg(
            F.count(F.lit(1)).alias("n")
        )
        upto = F.sum("n").over(Window.partitionBy("c").orderBy("b"))
        found = counts.withColumn("upto", upto).where("upto >= k AND upto - n < k").collect()
        if len(found) < len(wanted):
            raise ValueError("a class has fewer rows than are wanted of it")
        for r in found:
            before[r["c"]] += r["upto"] - r["n"]
            low[r["c"]], tied[r["c"]] = r["b"] << shift, r["n"]
        last, few = shift, max(tied.values()) <= 1 << ROUND_BITS
    return {c: Cut(low[c], before[c], tied[c]) for c in wanted}


def _first(df: DataFrame, order: Column, cut: Cut, k: int) -> tuple[DataFrame, DataFrame]:
    """The first k rows, and the others."""
    needed = k - cut.before
    if needed == cut.tied:
        return df.where(order <= cut.place), df.where(order > cut.place)
    # Tied rows in the order of their columns; equal ones are interchangeable.
    tied = df.where(order == cut.place)
    up = [F.asc(f"`{c}`") for c in df.columns]
    down = [F.desc(f"`{c}`") for c in df.columns]
    return (
        df.where(order < cut.place).unionByName(tied.orderBy(*up).limit(needed)),
        df.where(order > cut.place).unionByName(tied.orderBy(*down).limit(cut.tied - needed)),
    )


def sample_exact(
    df: DataFrame, n: int, rows: int, seed: int = 42, order: Column | None = None
) -> DataFrame:
    """Exactly ``min(n, rows)`` of the ``rows`` rows, the same ones for the same seed."""
    if n >= rows:
        return df
    if n <= 0:
        return df.limit(0)
    order = row_order(df.columns, seed) if order is None else order
    return _first(df, order, find_cut(df, order, n), n)[0]


def allocate(class_rows: Mapping[int, int], total: int) -> dict[int, int]:
    """Split ``total`` over classes in proportion, by largest remainder (then smaller class)."""
    everything = sum(class_rows.values())
    exact = {c: total * r / everything for c, r in class_rows.items()}
    given = {c: math.floor(x) for c, x in exact.items()}
    rest = total - sum(given.values())
    by_remainder = sorted(class_rows, key=lambda c: (given[c] - exact[c], c))
    for c in by_remainder[:rest]:
        given[c] += 1
    return given


def stratified_split(
    df: DataFrame,
    label: str,
    test_fraction: float = 0.2,
    seed: int = 42,
    order: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(train, test): the test part has ``ceil(fraction * rows)`` rows, classes in proportion.

    Each class contributes its first rows; rows without a label are left out.  All classes are
    cut in the same few jobs, and each part is one filter.
    """
    found = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    counts = {r[label]: int(r["n"]) for r in found.limit(MOST_CLASSES + 1).collect()}
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    if not counts:
        return df.limit(0), df.limit(0)
    rows = sum(counts.values())
    train_rows = allocate(counts, rows - math.ceil(test_fraction * rows))
    order = row_order(df.columns, seed) if order is None else order
    wanted = {c: n - train_rows[c] for c, n in counts.items()}
    cuts = find_cuts(df, label, order, {c: k for c, k in wanted.items() if 0 < k < counts[c]})

    # Up to ``last`` a class's rows are in the test part; those at ``tie`` belong to both parts.
    limits = []
    for c, k in wanted.items():
        if c not in cuts:
            limits.append((c, 1 << HASH_BITS if k > 0 else -1, None))
        elif k - cuts[c].before == cuts[c].tied:
            limits.append((c, cuts[c].place, None))
        else:
            limits.append((c, cuts[c].place - 1, cuts[c].place))
    names = []
    for stem in ("class", "last", "tie"):
        while stem.lower() in (x.lower() for x in (*df.columns, *names)):
            stem = f"_{stem}"
        names.append(stem)
    own, last, tie = names
    schema = T.StructType(
        [
            T.StructField(own, df.schema[label].dataType),
            T.StructField(last, T.LongType()),
            T.StructField(tie, T.LongType()),
        ]
    )
    ends = F.broadcast(df.sparkSession.createDataFrame(limits, schema))  # one row per class
    known = df.join(ends, F.col(f"`{label}`") == F.col(own))
    after = (order > F.col(last)) & (F.col(tie).isNull() | (order > F.col(tie)))
    columns = [F.col(f"`{c}`") for c in df.columns]
    train, test = known.where(after).select(*columns), known.where(order <= F.col(last)).select(*columns)
    for c, _, at in limits:
        if at is not None:
            mine = df.where((F.col(f"`{label}`") == c) & (order == at))
            cut = Cut(at, 0, cuts[c].tied)
            first, others = _first(mine, order, cut, wanted[c] - cuts[c].before)
            train, test = train.unionByName(others), test.unionByName(first)
    return train, test
