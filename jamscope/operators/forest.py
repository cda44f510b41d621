"""Train a random forest on a label and compare it with the majority class."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jamscope.config import ColumnMap, ModelSettings
from jamscope.operators.features import TripPreprocessor, feature_table, slot_counts
from jamscope.operators.metrics import (
    baseline_metrics,
    classification_metrics,
    classification_report,
    confusion_matrix,
)
from jamscope.operators.sampling import sample_exact, stratified_split
from jamscope.staging import Staged, StagingArea


#: Rows of a partition of the model sample.
PARTITION_ROWS = 25_000
ROW_HASHES = ["row_hash_1", "row_hash_2"]


@dataclass(frozen=True)
class Evaluation:
    """A fitted pipeline and its results on the held-out rows."""

    label: str
    model: PipelineModel
    predictions: DataFrame
    scores: dict[str, float]
    baseline_scores: dict[str, float]
    fit_seconds: float
    n_features: int
    n_rows: int
    class_ratio: float
    report: DataFrame
    confusion: DataFrame
    baseline: DataFrame


class TripForest(Estimator):
    """Preprocessing and forest fitted together, so that all statistics come from training rows.

    Coded columns are nominal attributes of the trees: a split sorts the slots of a
    column by their share of congestion and cuts that order, so a level looks at one
    feature per column instead of one per slot.  A histogram needs a bin per slot.
    """

    def __init__(
        self,
        label: str,
        columns: ColumnMap,
        settings: ModelSettings,
        staging: StagingArea | None = None,
    ) -> None:
        super().__init__()
        self.label, self.columns, self.settings, self.staging = label, columns, settings, staging

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        settings = self.settings
        prepared = TripPreprocessor(
            self.columns.numeric_features,
            self.columns.nominal_features,
            settings.min_category_rows,
            self.staging,
            one_hot=False,
        ).fit(dataset)
        forest = RandomForestClassifier(
            featuresCol="features",
            labelCol=self.label,
            numTrees=settings.trees,
            minInstancesPerNode=settings.min_leaf_rows,
            maxDepth=settings.max_depth,
            maxBins=max([settings.max_bins, *(n + 1 for n in slot_counts(prepared))]),
            seed=settings.seed,
            maxMemoryInMB=settings.histogram_mb,
            cacheNodeIds=True,
        )
        return PipelineModel([*prepared.stages, forest.fit(prepared.transform(dataset))])


def draw_sample(
    labelled: DataFrame,
    rows: int,
    columns: ColumnMap,
    labels: list[str],
    settings: ModelSettings,
    staging: StagingArea,
) -> Staged:
    """The model sample, drawn from whole distinct trips and staged for all labels."""
    n = rows if settings.sample_size is None else min(settings.sample_size, rows)
    sample = sample_exact(labelled, n, rows, settings.seed)
    # Feature rows may repeat; hashes of the whole trip keep them apart in the split.
    whole = [F.col(f"`{c}`") for c in labelled.columns]
    keyed = sample.withColumns(
        {
            f"row_hash_{i}": F.xxhash64(F.lit(settings.seed), F.lit(f"row {i}"), *whole)
            for i in (1, 2)
        }
    )
    keyed = feature_table(keyed, [*columns.features, *ROW_HASHES], labels)
    # The forest reads the sample once per tree level: spread it evenly.
    parts = max(1, math.ceil(n / PARTITION_ROWS))
    return staging.stage(keyed.repartition(parts, ROW_HASHES[0]), "model_sample")


def evaluate_all(
    sample: Staged,
    labels: Sequence[str],
    columns: ColumnMap,
    settings: ModelSettings,
    staging: StagingArea,
) -> dict[str, Evaluation]:
    """The evaluations of several labels, fitted side by side: while one forest waits for the
    driver between two levels, the others have the executors."""
    with ThreadPoolExecutor(max_workers=max(1, len(labels))) as pool:
        found = {
            label: pool.submit(train_and_evaluate, sample, label, columns, settings, staging)
            for label in labels
        }
        return {label: result.result() for label, result in found.items()}


def train_and_evaluate(
    sample: Staged,
    label: str,
    columns: ColumnMap,
    settings: ModelSettings,
    staging: StagingArea,
) -> Evaluation:
    """Split the sample, fit the pipeline on one part and score it on the other."""
    frame = sample.frame
    train, test = stratified_split(frame, label, settings.test_fraction, settings.seed)
    started = time.perf_counter()
    model = TripForest(label, columns, settings, staging).fit(train)
    fit_seconds = time.perf_counter() - started

    scored = predict(model, test, label)
    # The forest walks each row through every tree: do it once for all the scores.
    predictions = staging.stage(scored, f"predictions_{label}").frame
    scores = classification_metrics(predictions, label, "prediction").first().asDict()
    majority = baseline_metrics(train, test, label)
    baseline = majority.first().asDict()
    return Evaluation(
        label=label,
        model=model,
        predictions=predictions,
        scores=scores,
        baseline_scores=baseline,
        fit_seconds=fit_seconds,
        n_features=len(columns.numeric_features) + sum(slot_counts(model)),
        n_rows=sample.rows,
        class_ratio=frame.agg(F.avg(label)).first()[0],
        report=classification_report(predictions, label, "prediction"),
        confusion=confusion_matrix(predictions, label, "prediction"),
        baseline=majority,
    )


def predict(
    model: PipelineModel,
    rows: DataFrame,
    label: str | None = None,
    keys: Sequence[str] = ROW_HASHES,
    alike: Sequence[str] = (),
) -> DataFrame:
    """Predicted class and probability of congestion for rows with the model's input columns.

    With a ``label``, only it and the ``keys`` stay beside the predictions.  With the columns
    ``alike``, a task sorts its rows by them first: rows that are alike take the same ways
    through the trees, which are in the processor's cache then.
    """
    scored = model.transform(rows.sortWithinPartitions(*alike) if alike else rows)
    keep = [c for c in rows.columns if label is None or c in (label, *keys)]
    return scored.select(
        *keep,
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("probability"),
    )


def save_model(model: PipelineModel, path: str) -> str:
    """Write the fitted pipeline, preprocessing included, replacing an earlier one."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_scores(evaluations: list[Evaluation]) -> list[dict]:
    """Comparison rows: scores of each label's model, the baseline's F1 and the gain over it."""
    return [
        {
            "label": e.label,
            "accuracy": e.scores["accuracy"],
            "macro_f1": e.scores["macro_f1"],
            "macro_precision": e.scores["macro_precision"],
            "macro_recall": e.scores["macro_recall"],
            "baseline_f1": e.baseline_scores["macro_f1"],
            "f1_gain": e.scores["macro_f1"] - e.baseline_scores["macro_f1"],
            "fit_seconds": e.fit_seconds,
            "n_features": e.n_features,
            "n_rows": e.n_rows,
            "class_ratio": e.class_ratio,
        }
        for e in evaluations
    ]
