"""Quality of 0/1 predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = [(0, 0), (0, 1), (1, 0), (1, 1)]


def _cells(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """The four counts c<label><prediction> as one row; one pass, nothing to shuffle but counts."""
    return df.agg(
        *[
            F.count_if((F.col(label) == a) & (F.col(prediction) == b)).alias(f"c{a}{b}")
            for a, b in CELLS
        ]
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows per (label, prediction), empty cells included."""
    return _cells(df, label, prediction).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("label"),
                        F.lit(b).alias("prediction"),
                        F.col(f"c{a}{b}").alias("n"),
                    )
                    for a, b in CELLS
                ]
            )
        )
    )


def _class_measures(k: int) -> tuple[Column, Column, Column, Column]:
    """Precision, recall, F1 (NULL on an empty denominator) and support of class k."""
    hit = F.col(f"c{k}{k}")
    false_alarm, miss = F.col(f"c{1 - k}{k}"), F.col(f"c{k}{1 - k}")
    return (
        F.try_divide(hit, hit + false_alarm),
        F.try_divide(hit, hit + miss),
        F.try_divide(2 * hit, 2 * hit + false_alarm + miss),
        hit + miss,
    )


def _accuracy() -> Column:
    total = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    return F.try_divide(F.col("c00") + F.col("c11"), total)


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and unweighted class means; an empty denominator counts as 0."""

    def macro(position: int) -> Column:
        a, b = (F.coalesce(_class_measures(k)[position], F.lit(0.0)) for k in (0, 1))
        return (a + b) / 2

    return _cells(df, label, prediction).select(
        _accuracy().alias("accuracy"),
        macro(2).alias("macro_f1"),
        macro(0).alias("macro_precision"),
        macro(1).alias("macro_recall"),
    )


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per class, then accuracy, plain and support-weighted means; undefined values are NULL.

    Means leave undefined values out.
    """
    measures = {k: _class_measures(k) for k in (0, 1)}
    support = [measures[k][3] for k in (0, 1)]

    def mean(position: int, weights: list[Column]) -> Column:
        values = [measures[k][position] for k in (0, 1)]
        total = sum(
            (F.coalesce(v * w, F.lit(0.0)) for v, w in zip(values, weights, strict=True)),
            F.lit(0.0),
        )
        weight = sum(
            (
                F.when(v.isNotNull(), w).otherwise(F.lit(0)).cast("double")
                for v, w in zip(values, weights, strict=True)
            ),
            F.lit(0.0),
        )
        return F.try_divide(total, weight)

    def line(name: str, precision: Column, recall: Column, f1: Column, n: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            n.alias("support"),
        )

    none = F.lit(None).cast("double")
    plain = [F.lit(1.0), F.lit(1.0)]
    lines = [line(str(k), *measures[k]) for k in (0, 1)]
    lines.append(line("accuracy", none, none, _accuracy(), support[0] + support[1]))
    for name, weights in (("macro avg", plain), ("weighted avg", support)):
        lines.append(
            line(name, *(mean(p, weights) for p in range(3)), support[0] + support[1])
        )
    return _cells(df, label, prediction).select(F.inline(F.array(*lines)))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of each class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(  # one row
        label, "n", (F.col("n") / F.col("_total")).alias("share")
    )


def majority_class(train: DataFrame, label: str) -> DataFrame:
    """The most frequent class (the smaller one on ties) as a one-row table."""
    counts = train.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return counts.agg(
        F.max(F.struct(F.col("_n").alias("n"), (-F.col(label)).alias("neg"))).alias("_top")
    ).select((-F.col("_top.neg")).alias("baseline"))


def baseline_metrics(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Metrics of always predicting the majority class of the training rows."""
    predicted = test.select(label).crossJoin(F.broadcast(majority_class(train, label)))  # one row
    return classification_metrics(predicted, label, "baseline")
