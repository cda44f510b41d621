"""Model inputs: imputation, scaling and category encoding, fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jamscope.functions import rows as sql
from jamscope.operators.quantiles import quantile_table
from jamscope.operators.stats import _long
from jamscope.sources.tables import require_columns
from jamscope.staging import StagingArea

INFREQUENT = "infrequent"


def feature_table(df: DataFrame, features: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """The model inputs and labels; raises if one is missing."""
    require_columns(df, [*features, *labels])
    return df.select(*features, *labels)


def numeric_statistics(
    train: DataFrame,
    numeric: Sequence[str],
    staging: StagingArea | None = None,
) -> DataFrame:
    """Per numeric column: median, and mean and population deviation once NULLs hold the median.

    The moments after imputation follow from those of the known values, so the
    table is read once for moments and once for medians.
    """
    medians = quantile_table(
        _long(train, numeric),
        "value",
        {"median": 0.5},
        by=["variable"],
        staging=staging,
    ).select("variable", "median")
    measures = {
        "known": "count({0})",
        "n_null": "count_if({0} IS NULL)",
        "m": "avg({0})",
        "v": "coalesce(var_pop({0}), 0D)",
    }
    moments = train.selectExpr(
        *[
            f"{expr.format(sql.name(n))} AS _{k}{i}"
            for i, n in enumerate(numeric)
            for k, expr in measures.items()
        ]
    ).selectExpr(
        sql.stack(
            ["variable", *measures],
            [[sql.text(n), *[f"_{k}{i}" for k in measures]] for i, n in enumerate(numeric)],
        )
    )
    known, holes = F.col("known"), F.col("n_null")
    mean = (known * F.col("m") + holes * F.col("median")) / (known + holes)
    apart, moved = F.col("m") - F.col("mean"), F.col("median") - F.col("mean")
    variance = (known * (F.col("v") + apart * apart) + holes * moved * moved) / (known + holes)
    return (
        moments.join(F.broadcast(medians), "variable")  # one row per feature
        .withColumn("mean", mean)
        .select("variable", "n_null", "median", "mean", F.sqrt(variance).alias("std"))
    )


def impute_median(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Fill NULLs of numeric columns with given medians."""
    return df.withColumns({n: F.expr(_imputed_sql(n, m)) for n, m in medians.items()})


def category_counts(train: DataFrame, nominal: Sequence[str]) -> DataFrame:
    """Training rows per category of each coded column; NULLs count for the most frequent code.

    The smallest code wins among equally frequent ones.  Columns: ``feature``,
    ``code``, ``n`` (NULLs included), ``mode`` (the column's most frequent code).
    """
    entries = [[sql.text(n), f"CAST({sql.name(n)} AS BIGINT)"] for n in nominal]
    long = train.selectExpr(sql.stack(["feature", "code"], entries))
    counts = long.groupBy("feature", "code").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("code").isNotNull()
    modes = counts.groupBy("feature").agg(
        F.max(F.when(known, F.struct(F.col("n"), (-F.col("code")).alias("neg")))).alias("_top"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("_nulls"),
    )
    return (
        counts.where(known)
        .join(F.broadcast(modes), "feature")  # one row per feature
        .select(
            "feature",
            "code",
            (
                F.col("n") + F.when(F.col("code") == -F.col("_top.neg"), F.col("_nulls")).otherwise(0)
            ).alias("n"),
            (-F.col("_top.neg")).alias("mode"),
        )
    )


def impute_mode(train: DataFrame, nominal: Sequence[str]) -> DataFrame:
    """The most frequent code of each coded column (the smallest one on ties)."""
    return category_counts(train, nominal).groupBy("feature").agg(F.max("mode").alias("mode"))


def category_frequencies(
    train: DataFrame, nominal: Sequence[str], min_rows: int = 50
) -> DataFrame:
    """Category counts and whether the category is frequent enough for a slot of its own."""
    return category_counts(train, nominal).select(
        "feature", "code", "n", (F.col("n") >= min_rows).alias("frequent")
    )


@dataclass(frozen=True)
class Encoding:
    """What is known of one coded column: its mode, its frequent codes, and if there are others."""

    mode: int
    codes: tuple[int, ...]
    has_infrequent: bool

    @property
    def slots(self) -> list[str]:
        return [str(c) for c in self.codes] + ([INFREQUENT] if self.has_infrequent else [])


def fit_encodings(
    train: DataFrame, nominal: Sequence[str], min_rows: int = 50
) -> dict[str, Encoding]:
    """Encodings of the coded columns.

    Only frequent codes come to the driver: each becomes an element of the
    feature vector there.  Rare ones are counted, not listed.
    """
    rows = (
        category_counts(train, nominal)
        .groupBy("feature", "mode", F.when(F.col("n") >= min_rows, F.col("code")).alias("code"))
        .agg(F.count(F.lit(1)).alias("k"))
        .collect()
    )
    found = {}
    for name in nominal:
        mine = [r for r in rows if r["feature"] == name]
        if not mine:
            raise ValueError(f"no known value of {name} in the training rows")
        codes = sorted(r["code"] for r in mine if r["code"] is not None)
        found[name] = Encoding(
            mode=mine[0]["mode"],
            codes=tuple(codes),
            has_infrequent=any(r["code"] is None for r in mine),
        )
    return found


def _slots(
    df: DataFrame, train: DataFrame, nominal: Sequence[str], min_rows: int, keep: Sequence[str] = ()
) -> DataFrame:
    """``keep``, ``feature`` and ``slot`` of every coded value; NULL for a value without a slot.

    The codes of the training rows are a table that is joined by (feature, code): however many
    there are, they are neither collected nor written into the plan.
    """
    counts = category_counts(train, nominal).withColumn("_frequent", F.col("n") >= min_rows)
    per_feature = counts.groupBy("feature").agg(
        F.max("mode").alias("_mode"), F.bool_or(~F.col("_frequent")).alias("_has_rare")
    )
    entries = [[sql.text(n), f"CAST({sql.name(n)} AS BIGINT)"] for n in nominal]
    long = df.selectExpr(*map(sql.name, keep), sql.stack(["feature", "code"], entries))
    frequent = counts.where("_frequent").select("feature", "code", F.lit(True).alias("_known"))
    filled = long.join(F.broadcast(per_feature), "feature").withColumn(  # one row per feature
        "code", F.coalesce("code", "_mode")
    )
    slot = F.when(F.col("_known"), F.col("code").cast("string")).when(
        F.col("_has_rare"), F.lit(INFREQUENT)
    )
    return filled.join(frequent, ["feature", "code"], "left").select(
        *keep, "feature", slot.alias("slot")
    )


def infrequent_mapping(
    df: DataFrame, train: DataFrame, nominal: Sequence[str], min_rows: int = 50
) -> DataFrame:
    """Rows per slot of each coded column; NULL stands for values that get no slot at all."""
    slots = _slots(df, train, nominal, min_rows)
    return slots.groupBy("feature", "slot").agg(F.count(F.lit(1)).alias("n"))


def encoded_features(
    df: DataFrame,
    train: DataFrame,
    keys: Sequence[str],
    numeric: Sequence[str],
    nominal: Sequence[str],
    min_rows: int = 50,
    staging: StagingArea | None = None,
) -> DataFrame:
    """The non-zero elements of the one-hot feature vectors of ``df``, fitted on ``train``.

    Long form: the ``keys`` of a row, ``slot`` and ``value``.  A numeric column is a slot of its
    name with the imputed and scaled value (a zero is listed too); a coded one has the slot
    ``<column>=<code>`` or ``<column>=infrequent`` with value 1, or none.
    """
    require_columns(df, [*keys, *numeric, *nominal])
    fitted = numeric_statistics(train, numeric, staging).select(
        "variable", "median", "mean", F.expr("coalesce(nullif(std, 0D), 1D)").alias("std")
    )
    scaled = (
        _long(df, numeric, keys)
        .join(F.broadcast(fitted), "variable")  # one row per feature
        .select(
            *keys,
            F.col("variable").alias("slot"),
            ((F.coalesce("value", "median") - F.col("mean")) / F.col("std")).alias("value"),
        )
    )
    coded = _slots(df, train, nominal, min_rows, keys).where("slot IS NOT NULL")
    coded = coded.select(
        *keys, F.concat_ws("=", "feature", "slot").alias("slot"), F.lit(1.0).alias("value")
    )
    return scaled.unionByName(coded)


@dataclass(frozen=True)
class Scaling:
    """Median, mean and deviation of one numeric column."""

    median: float
    mean: float
    std: float


def fit_scalings(
    train: DataFrame,
    numeric: Sequence[str],
    staging: StagingArea | None = None,
) -> dict[str, Scaling]:
    """Scalings of the numeric columns; a constant column keeps deviation 1."""
    table = numeric_statistics(train, numeric, staging).collect()  # one row per feature
    return {r["variable"]: Scaling(r["median"], r["mean"], r["std"] or 1.0) for r in table}


def standardize(df: DataFrame, scalings: dict[str, Scaling]) -> DataFrame:
    """Impute and scale numeric columns in place."""
    return df.withColumns({n: F.expr(_scaled_sql(n, s)) for n, s in scalings.items()})


class TripPreprocessor(Estimator):
    """Fits the scalings and encodings; the fitted model is made of built-in stages only.

    The model adds ``features``.  One-hot: scaled numeric columns, then a 0/1 slot
    per frequent code and one for the rare codes of each coded column.  Indexed: the
    scaled columns, then one nominal attribute per coded column, for trees, which
    split the set of its slots at once.  A new code goes to the rare slot, or, if
    there is none, leaves all slots 0 (one-hot) or has an index of its own.
    """

    def __init__(
        self,
        numeric: Sequence[str],
        nominal: Sequence[str],
        min_category_rows: int = 50,
        staging: StagingArea | None = None,
        one_hot: bool = True,
    ) -> None:
        super().__init__()
        self.numeric = list(numeric)
        self.nominal = list(nominal)
        self.min_category_rows = min_category_rows
        self.staging = staging
        self.one_hot = one_hot

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        require_columns(dataset, [*self.numeric, *self.nominal])
        scalings = fit_scalings(dataset, self.numeric, self.staging)
        encodings = fit_encodings(dataset, self.nominal, self.min_category_rows)
        scaled = [f"_num_{n}" for n in self.numeric]
        named = [f"_cat_{n}" for n in self.nominal]
        indexed = [f"_idx_{n}" for n in self.nominal]
        coded = [f"_vec_{n}" for n in self.nominal]

        columns = SQLTransformer(
            statement="SELECT *, "
            + ", ".join(
                [
                    _scaled_sql(n, scalings[n]) + f" AS `{out}`"
                    for n, out in zip(self.numeric, scaled, strict=True)
                ]
                + [
                    _slot_sql(n, encodings[n]) + f" AS `{out}`"
                    for n, out in zip(self.nominal, named, strict=True)
                ]
            )
            + " FROM __THIS__"
        )
        # "keep" gives a value without slot one index more, which dropLast turns into zeros.
        index = [
            StringIndexerModel.from_labels(encodings[n].slots, src, out, handleInvalid="keep")
            for n, src, out in zip(self.nominal, named, indexed, strict=True)
        ]
        if not self.one_hot:
            assemble = VectorAssembler(inputCols=[*scaled, *indexed], outputCol="features")
            return PipelineModel([columns, *index, assemble])
        lookup = PipelineModel([columns, *index])
        # Slot numbers come from column metadata; no rows are read to fit this stage.
        encode = OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True).fit(
            lookup.transform(dataset)
        )
        assemble = VectorAssembler(inputCols=[*scaled, *coded], outputCol="features")
        return PipelineModel([columns, *index, encode, assemble])


def slot_counts(fitted: PipelineModel) -> list[int]:
    """Slots of each coded column of a fitted preprocessor."""
    return [len(s.labels) for s in fitted.stages if isinstance(s, StringIndexerModel)]


def feature_width(vectors: DataFrame) -> int:
    """Length of the feature vector, from the metadata of the ``features`` column."""
    return vectors.schema["features"].metadata["ml_attr"]["num_attrs"]


# The expressions of the fitted model; the functions above apply the same ones.
def _imputed_sql(name: str, median: float) -> str:
    return f"coalesce(CAST(`{name}` AS DOUBLE), {float(median)!r}D)"


def _scaled_sql(name: str, s: Scaling) -> str:
    return f"({_imputed_sql(name, s.median)} - ({s.mean!r}D)) / ({s.std!r}D)"


def _slot_sql(name: str, e: Encoding) -> str:
    code = f"coalesce(CAST(`{name}` AS BIGINT), {e.mode})"
    if not e.codes:
        return f"'{INFREQUENT}'"
    listed = ", ".join(str(c) for c in e.codes)
    return f"CASE WHEN {code} IN ({listed}) THEN CAST({code} AS STRING) ELSE '{INFREQUENT}' END"
