"""A1 over many models: all fitted models of a grid score a row in one scan of the validation rows.

The stages that models share run once. Each model leaves the few columns its metric needs as a
struct, and one aggregation over all structs returns every metric. Evaluators that cannot be written
as an aggregation are asked model by model.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.evaluation import Evaluator, RegressionEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.plans.grid import Node

#: Models of one scan, which bounds the size of its plan.
MODELS_PER_SCAN = 32


class _Regression:
    """RMSE, MSE and MAE of Spark's evaluator as an aggregation."""

    def __init__(self, evaluator: RegressionEvaluator):
        self.kind = evaluator.getMetricName()
        self.names = [evaluator.getLabelCol(), evaluator.getPredictionCol()]

    def columns(self) -> list[str]:
        return self.names

    def aggregates(self, label: Column, prediction: Column) -> list[Column]:
        error = prediction.cast("double") - label.cast("double")
        return [F.avg(F.abs(error) if self.kind == "mae" else error * error)]

    def metric(self, values) -> float:
        value = math.nan if values[0] is None else float(values[0])
        return math.sqrt(value) if self.kind == "rmse" else value


def _aggregator(evaluator: Evaluator):
    if all(hasattr(evaluator, m) for m in ("columns", "aggregates", "metric")):
        return evaluator
    if type(evaluator) is RegressionEvaluator and evaluator.getMetricName() in ("rmse", "mse", "mae") and not evaluator.isDefined("weightCol"):
        return _Regression(evaluator)
    return None


def _scored(node: Node, df: DataFrame, sets: set[int], columns: Sequence[str]) -> DataFrame:
    """``df`` with a struct ``_kl_m<set>`` for every set of ``sets`` below ``node``."""
    out = node.model.transform(df)
    if not node.children:
        out = out.withColumns({f"_kl_m{i}": F.struct(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(columns)])
                               for i in node.sets if i in sets})
    for child in node.children:
        if sets & set(child.sets):
            out = _scored(child, out, sets, columns)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[c for c in out.columns if c.startswith("_kl_m") and c not in df.columns])


def score_trie(trie: Sequence[Node], valid: DataFrame, evaluator: Evaluator, sets: int, models: Sequence | None = None) -> list[float]:
    """The metric of every parameter set of a fitted trie on ``valid``."""
    by_sum = _aggregator(evaluator)
    if by_sum is None:
        return [float(evaluator.evaluate(m.transform(valid))) for m in models]
    columns, out = by_sum.columns(), []
    for start in range(0, sets, MODELS_PER_SCAN):
        wanted = set(range(start, min(start + MODELS_PER_SCAN, sets)))
        frame = valid
        for node in trie:
            if wanted & set(node.sets):
                frame = _scored(node, frame, wanted, columns)
        asked = [(i, a) for i in sorted(wanted) for a in by_sum.aggregates(*[F.col(f"_kl_m{i}.c{n}") for n in range(len(columns))])]
        row = frame.agg(*[a.alias(f"a{k}") for k, (_, a) in enumerate(asked)]).first()
        for i in sorted(wanted):
            out.append(by_sum.metric([row[k] for k, (j, _) in enumerate(asked) if j == i]))
    return out
