"""A1, A2, O1: edge values."""

import math

import pytest

from keelson.operators.metrics import LogLossEvaluator, best_or_worst, log_loss_frame, share_correct_frame


def _ll(spark, rows):
    df = spark.createDataFrame(rows, "label double, p double")
    return LogLossEvaluator(labelCol="label", probabilityCol="p").evaluate(df)


def test_log_loss_values(spark):
    eps = 1e-16
    assert _ll(spark, [(1.0, 0.5), (0.0, 0.5)]) == pytest.approx(-math.log(0.5 + eps))
    assert _ll(spark, [(1.0, 0.0)]) == pytest.approx(-math.log(eps))
    assert _ll(spark, [(0.0, 1.0)]) == pytest.approx(-math.log(eps))
    assert _ll(spark, [(1.0, 1.0)]) == pytest.approx(0.0, abs=1e-12)


def test_log_loss_edges(spark):
    # 1 - p + eps < 0 for p = 1 + 2^-52: the JVM's log gives NaN there
    assert math.isnan(_ll(spark, [(0.0, 1.0 + 2 ** -52)]))
    assert math.isnan(_ll(spark, [(1.0, -0.5)]))
    assert math.isnan(LogLossEvaluator(labelCol="label", probabilityCol="p").evaluate(
        spark.createDataFrame([], "label double, p double")))
    with pytest.raises(ValueError):
        _ll(spark, [(None, 0.5)])
    assert not LogLossEvaluator().isLargerBetter()


def test_share_correct_and_topk(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (None, 1.0), (1.0, 1.0)], "label double, pred double")
    assert share_correct_frame(df, "label", "pred").first()["share_correct"] == 0.5
    top = best_or_worst(df.where("label is not null"), 1, "label")
    assert top.count() == 1 and top.first()["label"] == 0.0
    frame = log_loss_frame(spark.createDataFrame([(1.0, 0.5)], "label double, p double"), "label", "p").first()
    assert frame["n"] == 1 and frame["n_null"] == 0
