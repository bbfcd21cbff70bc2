"""Train, score unlabeled rows, conform them to the labeled schema, write.

Every property is lazy and computed once. The pair of tables, the label, the evaluator and the
grid are data; ``functools.partial(Recipe, ...)`` is the template (L6a).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import Evaluator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators.project import conform
from keelson.plans.tuning import RECIPE_SEED, ParallelCrossValidator
from keelson.sources.sinks import result_name, write_csv


@dataclass(eq=False)
class Recipe:
    labeled: DataFrame
    unlabeled: DataFrame
    label_col: str
    prediction_col: str
    evaluator: Evaluator
    name: str
    param_maps: Sequence[dict]
    stages: Sequence
    num_folds: int = 3
    seed: int = RECIPE_SEED
    parallelism: int = 4
    fold_keys: Sequence[str] | None = None
    placeholder_label: float = 0.0
    _cached: list = field(default_factory=list, repr=False)

    @property
    def pipeline(self) -> Pipeline:
        return Pipeline(stages=list(self.stages))

    @cached_property
    def transformed_data(self) -> DataFrame:
        """L1: the labeled table after every stage, as fed to the model."""
        df = self.pipeline.fit(self.labeled).transform(self.labeled).cache()
        self._cached.append(df)
        return df

    @cached_property
    def trained_model(self):
        """L4 over the labeled table, refit on all rows with the best parameter set."""
        cv = ParallelCrossValidator(estimator=self.pipeline, evaluator=self.evaluator, estimatorParamMaps=self.param_maps,
                                    numFolds=self.num_folds, seed=self.seed, parallelism=self.parallelism,
                                    foldKeys=self.fold_keys)
        return cv.fit(self.labeled)

    @cached_property
    def cv_metric(self) -> float:
        """Cross-validated metric of the chosen parameter set."""
        return self.trained_model.avgMetrics[self.trained_model.bestIndex]

    @cached_property
    def training_metric(self) -> float:
        """The metric on the training rows themselves (what the reference called accuracy)."""
        return float(self.evaluator.evaluate(self.trained_model.transform(self.labeled)))

    @cached_property
    def unlabeled_predictions(self) -> DataFrame:
        """L8 + P11: placeholder label, score, drop it, prediction -> label, labeled columns only."""
        scored = self.trained_model.transform(
            self.unlabeled.withColumn(self.label_col, F.lit(self.placeholder_label)))
        out = conform(scored, self.labeled.columns, self.label_col, self.prediction_col).cache()
        self._cached.append(out)
        return out

    def file_name(self, now: _dt.datetime | None = None) -> str:
        return result_name(self.name, self.training_metric, now)

    def write_csv(self, prefix: str | None = None, select_exprs: Sequence[str] | None = None,
                  single_file: bool = False, now: _dt.datetime | None = None) -> str:
        """``<prefix>/<name>_<metric>_<date>``, header CSV; one file per task unless
        ``single_file`` (the reference always wrote one file through one task)."""
        name = self.file_name(now)
        path = f"{prefix.rstrip('/')}/{name}" if prefix else name
        return write_csv(self.unlabeled_predictions, path, select_exprs, single_file=single_file)

    def release(self) -> None:
        for df in self._cached:
            df.unpersist()
        self._cached.clear()
