"""Evaluation metrics as single-pass aggregations.

Each metric is a one-row DataFrame (``*_frame``) so it composes with other plans, and the
``Evaluator`` wrappers collect that single row.
"""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param.shared import HasLabelCol, HasProbabilityCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the epsilon added (not clipped) inside the logarithm.
LOG_LOSS_EPSILON = 1e-16


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _neg_ln(x: Column) -> Column:
    """-ln(x) with the JVM's edge values: +Infinity at 0 and NaN below 0 (Spark's ``ln`` gives
    null there, which ``avg`` would silently skip)."""
    return (F.when(x.isNull(), F.lit(None).cast("double"))
            .when(x < 0, F.lit(float("nan")))
            .when(x == 0, F.lit(float("inf")))
            .otherwise(-F.ln(x)))


def log_loss_terms(label, probability, eps: float = LOG_LOSS_EPSILON) -> Column:
    """Per-row binary log loss: ``-ln(p + eps)`` when label = 1, else ``-ln(1 - p + eps)``."""
    y = _c(label).cast("double")
    p = _c(probability).cast("double")
    return F.when(y == 1.0, _neg_ln(p + F.lit(eps))).otherwise(_neg_ln(F.lit(1.0) - p + F.lit(eps)))


def log_loss_frame(df: DataFrame, label: str, probability: str, eps: float = LOG_LOSS_EPSILON) -> DataFrame:
    """A1 as a one-row frame: ``log_loss`` (NaN for no rows), ``n`` and ``n_null`` (rows with a
    null label or probability)."""
    y, p = F.col(label), F.col(probability)
    agg = df.agg(
        F.sum(log_loss_terms(y, p, eps)).alias("_s"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(y.isNull() | p.isNull()).alias("n_null"),
    )
    return agg.select(
        F.when(F.col("n") == 0, F.lit(float("nan"))).otherwise(F.col("_s") / F.col("n")).alias("log_loss"),
        "n", "n_null")


def share_correct_frame(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """A2: share of rows whose prediction equals the label; a null comparison counts as wrong.
    One pass (the reference counted twice)."""
    hit = F.coalesce((F.col(label) == F.col(prediction)).cast("double"), F.lit(0.0))
    return df.agg(F.avg(hit).alias("share_correct"), F.count(F.lit(1)).alias("n"))


def row_count_frame(df: DataFrame) -> DataFrame:
    """Row count as a frame."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def best_or_worst(df: DataFrame, n: int, by, ascending: bool = True, tiebreak=None) -> DataFrame:
    """O1: the ``n`` rows with the smallest (or largest) ``by``; ``orderBy().limit()`` plans as
    a top-k (TakeOrderedAndProject), not a full sort."""
    keys = [_c(by).asc() if ascending else _c(by).desc()]
    if tiebreak is not None:
        keys += [_c(t) for t in ([tiebreak] if isinstance(tiebreak, str) else tiebreak)]
    return df.orderBy(*keys).limit(n)


class LogLossEvaluator(Evaluator, HasLabelCol, HasProbabilityCol, DefaultParamsReadable,
                       DefaultParamsWritable):
    """A1 as an ML evaluator (smaller is better).

    ``probabilityCol`` must hold the positive-class probability as a number (use
    ``keelson.functions.scalar.vector_element`` on a probability vector first). A null label or
    probability raises; no rows gives NaN.
    """

    @keyword_only
    def __init__(self, *, labelCol: str = "label", probabilityCol: str = "probability"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        row = log_loss_frame(dataset, self.getLabelCol(), self.getProbabilityCol()).first()
        return self.metric([row["log_loss"] * row["n"] if row["n"] and not row["n_null"] else None, row["n_null"], row["n"]])

    def columns(self) -> list[str]:
        return [self.getLabelCol(), self.getProbabilityCol()]

    def aggregates(self, label: Column, probability: Column) -> list[Column]:
        """What :meth:`metric` needs, so that one aggregation can serve many models."""
        return [F.sum(log_loss_terms(label, probability)), F.count_if(label.isNull() | probability.isNull()), F.count(F.lit(1))]

    def metric(self, values) -> float:
        total, nulls, n = values
        if nulls:
            raise ValueError(f"{nulls} rows have a null label or probability")
        return float(total) / n if n else math.nan

    def isLargerBetter(self) -> bool:
        return False


class ShareCorrectEvaluator(Evaluator, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """A2 as an ML evaluator (larger is better)."""

    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column",
                          typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        row = share_correct_frame(dataset, self.getLabelCol(),
                                  self.getOrDefault(self.predictionCol)).first()
        return float(row["share_correct"]) if row["n"] else math.nan

    def columns(self) -> list[str]:
        return [self.getLabelCol(), self.getOrDefault(self.predictionCol)]

    def aggregates(self, label: Column, prediction: Column) -> list[Column]:
        return [F.avg(F.coalesce((label == prediction).cast("double"), F.lit(0.0)))]

    def metric(self, values) -> float:
        return float(values[0]) if values[0] is not None else math.nan

    def isLargerBetter(self) -> bool:
        return True
