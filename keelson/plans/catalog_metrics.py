"""Checks for the metrics A1-A6 (one pass each) and distinct feature names (A5)."""

from __future__ import annotations

from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from keelson.operators.metrics import LogLossEvaluator, log_loss_frame, row_count_frame, share_correct_frame
from keelson.plans.registry import query
from keelson.sources.tables import table

_SCORED_SQL = """
WITH s AS (
  SELECT d.doc_id, CAST(l.quality AS DOUBLE) AS label,
         LEAST(CAST(d.n_chars AS DOUBLE) / 5000, 1.0) AS p,
         CASE WHEN d.n_chars > 1000 THEN 1.0 ELSE 0.0 END AS prediction
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


def _scored(spark, sf):
    """Labeled documents with a rule score: p = min(n_chars / 5000, 1), prediction = n_chars > 1000."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        F.col("quality").cast("double").alias("label"),
        F.least(F.col("n_chars").cast("double") / 5000, F.lit(1.0)).alias("p"),
        F.when(F.col("n_chars") > 1000, 1.0).otherwise(0.0).alias("prediction"),
    )


def _metric_frame(spark, **values):
    """A metric computed by a Spark evaluator job, as a one-row frame."""
    names = list(values)
    return spark.createDataFrame([tuple(float(values[n]) for n in names)], ", ".join(f"{n} double" for n in names))


@query("a1_log_loss", _SCORED_SQL + """
SELECT round(avg(CASE WHEN label = 1 THEN -ln(p + 1e-16) ELSE -ln(1 - p + 1e-16) END), 9) AS log_loss,
       count(*) AS n
FROM s
""")
def a1_log_loss(spark, sf):
    """Binary log loss of the rule score against the quality label, one aggregation."""
    df = _scored(spark, sf)
    # the evaluator path is the same frame collected; both agree by construction
    frame = log_loss_frame(df, "label", "p")
    return frame.select(F.round("log_loss", 9).alias("log_loss"), "n")


@query("a1_log_loss_evaluator", _SCORED_SQL + """
SELECT round(avg(CASE WHEN label = 1 THEN -ln(p + 1e-16) ELSE -ln(1 - p + 1e-16) END), 9) AS log_loss FROM s
""")
def a1_log_loss_evaluator(spark, sf):
    """The same metric through the ML ``Evaluator`` interface."""
    v = LogLossEvaluator(labelCol="label", probabilityCol="p").evaluate(_scored(spark, sf))
    return _metric_frame(spark, log_loss=round(v, 9))


@query("a2_share_correct", _SCORED_SQL + """
SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 9) AS share_correct, count(*) AS n FROM s
""")
def a2_share_correct(spark, sf):
    f = share_correct_frame(_scored(spark, sf), "label", "prediction")
    return f.select(F.round("share_correct", 9).alias("share_correct"), "n")


@query("a3_rmse", _SCORED_SQL + """
SELECT round(sqrt(avg((p - label) * (p - label))), 9) AS rmse FROM s
""")
def a3_rmse(spark, sf):
    ev = RegressionEvaluator(labelCol="label", predictionCol="p", metricName="rmse")
    return _metric_frame(spark, rmse=round(ev.evaluate(_scored(spark, sf)), 9))


@query("a4_accuracy", _SCORED_SQL + """
SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
       round(1 - avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 9) AS test_error
FROM s
""")
def a4_accuracy(spark, sf):
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="accuracy")
    acc = ev.evaluate(_scored(spark, sf))
    return _metric_frame(spark, accuracy=round(acc, 9), test_error=round(1 - acc, 9))


@query("a6_row_count", """
SELECT count(*) AS n FROM lineitem
""")
def a6_row_count(spark, sf):
    return row_count_frame(table(spark, sf, "lineitem"))
