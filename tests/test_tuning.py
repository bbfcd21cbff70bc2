"""Folds, splits, CV choice, recipe round trip through CSV."""

import datetime as dt
import math

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from keelson.plans.recipe import Recipe
from keelson.plans.tuning import (ParallelCrossValidator, choose_best, fit_many, hash_split, modulus_split,
                                  with_folds)
from keelson.sources.sinks import metric_text, result_name, stamp_text


def test_folds_stable_under_repartition(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = {r.k: r.fold for r in with_folds(df, 3, keys="k").collect()}
    b = {r.k: r.fold for r in with_folds(df.repartition(7), 3, keys="k").collect()}
    assert a == b and set(a.values()) == {0, 1, 2}


def test_splits_partition_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    parts = hash_split(df, [0.7, 0.3], keys="k")
    assert sum(p.count() for p in parts) == 1000
    assert parts[0].intersect(parts[1]).count() == 0
    m = modulus_split(df, "k", [8, 2])
    assert m[0].count() == 800 and m[1].count() == 200


def test_choose_best():
    assert choose_best([0.3, 0.1, 0.1], larger_is_better=False) == 1
    assert choose_best([float("nan"), 0.5], larger_is_better=True) == 1
    with pytest.raises(ValueError):
        choose_best([float("nan")], larger_is_better=False)


def _data(spark):
    rows = [(i, float(i % 10), float((i * 7) % 13), 1.0 if (i % 10) > 4 else 0.0) for i in range(300)]
    return spark.createDataFrame(rows, "id int, x1 double, x2 double, label double")


def _pipe():
    lr = LogisticRegression(maxIter=20)
    return Pipeline(stages=[VectorAssembler(inputCols=["x1", "x2"], outputCol="features"), lr]), lr


def test_parallel_cv_and_fit_many(spark):
    df = _data(spark)
    pipe, lr = _pipe()
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 10.0]).build()
    ev = BinaryClassificationEvaluator()
    model = ParallelCrossValidator(estimator=pipe, evaluator=ev, estimatorParamMaps=grid, numFolds=3, foldKeys=["id"]).fit(df)
    assert len(model.avgMetrics) == 2 and not any(math.isnan(m) for m in model.avgMetrics)
    assert model.bestIndex == max(range(2), key=lambda i: model.avgMetrics[i])
    assert len(fit_many(pipe, df, grid, parallelism=2)) == 2
    with pytest.raises(ValueError):
        ParallelCrossValidator(estimator=pipe, evaluator=ev, estimatorParamMaps=grid, numFolds=3).fit(df.limit(2))


def test_recipe_round_trip(spark, tmp_path):
    df = _data(spark)
    labeled, unlabeled = df, df.drop("label").where("id < 50")
    pipe, lr = _pipe()
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1]).build()
    r = Recipe(labeled=labeled, unlabeled=unlabeled, label_col="label", prediction_col="prediction",
               evaluator=BinaryClassificationEvaluator(), name="demo", param_maps=grid, stages=pipe.getStages(),
               num_folds=2, fold_keys=["id"])
    out = r.unlabeled_predictions
    assert out.columns == ["id", "x1", "x2", "label"] and out.count() == 50
    now = dt.datetime(2024, 1, 5, 15, 7)
    path = r.write_csv(prefix=str(tmp_path), now=now)
    assert path.endswith(f"demo_{metric_text(r.training_metric)}_2024-Jan5-307PM")
    back = spark.read.csv(path, header=True)
    assert back.count() == 50 and back.columns == out.columns
    path2 = r.write_csv(prefix=str(tmp_path / "sel"), select_exprs=["id", "label as yhat"], now=now)
    assert spark.read.csv(path2, header=True).columns == ["id", "yhat"]
    r.release()


def test_name_parts():
    assert stamp_text(dt.datetime(2016, 10, 16, 0, 5)) == "2016-Oct16-1205AM"
    assert metric_text(0.123456789) == "0.12346"
    assert result_name("x", 1.5, dt.datetime(2016, 1, 1, 12, 0)) == "x_1.50000_2016-Jan1-1200PM"


def test_recipe_template_partial(spark):
    import functools

    df = _data(spark)
    pipe, lr = _pipe()
    template = functools.partial(Recipe, labeled=df, unlabeled=df.drop("label"), label_col="label",
                                 prediction_col="prediction", evaluator=BinaryClassificationEvaluator(),
                                 num_folds=2, fold_keys=["id"])
    r = template(name="t", param_maps=ParamGridBuilder().addGrid(lr.maxIter, [5]).build(), stages=pipe.getStages())
    assert r.unlabeled_predictions.count() == 300
    assert r.transformed_data.count() == 300
    assert 0.0 <= r.cv_metric <= 1.0
    r.release()


def test_cv_mean_equals_independent_fold_metrics(spark):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import LinearRegression

    rows = [(i, float(i % 17), float((i * 5) % 11), float(i % 17) * 2.0 + float((i * 5) % 11)) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, x1 double, x2 double, label double")
    lr = LinearRegression(maxIter=10)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x1", "x2"], outputCol="features"), lr])
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 5.0]).build()
    ev = RegressionEvaluator(metricName="rmse")
    model = ParallelCrossValidator(estimator=pipe, evaluator=ev, estimatorParamMaps=grid, numFolds=3, foldKeys=["id"], parallelism=3).fit(df)
    folded = with_folds(df, 3, keys=["id"], name="f")
    for j, pm in enumerate(grid):
        per_fold = []
        for i in range(3):
            m = pipe.fit(folded.where(F.col("f") != i).drop("f"), pm)
            per_fold.append(ev.evaluate(m.transform(folded.where(F.col("f") == i).drop("f"))))
        assert model.avgMetrics[j] == pytest.approx(sum(per_fold) / 3, rel=1e-9)
    assert model.bestIndex == 0  # no regularisation fits this exact linear label better


def _weighted_lr(nested):
    from pyspark.ml.classification import LogisticRegression

    lr = LogisticRegression(maxIter=5)
    assembler = VectorAssembler(inputCols=["x"], outputCol="features")
    return lr, Pipeline(stages=[assembler, Pipeline(stages=[lr])] if nested else [assembler, lr])


def test_grid_on_a_nested_pipeline_counts(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    df = spark.createDataFrame([(i, float(i % 10), float(i % 10 > 3)) for i in range(200)], "id int, x double, label double")
    scores = []
    for nested in (False, True):
        lr, pipe = _weighted_lr(nested)
        grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 5.0]).build()
        cv = ParallelCrossValidator(estimator=pipe, evaluator=MulticlassClassificationEvaluator(metricName="logLoss"),
                                    estimatorParamMaps=grid, numFolds=3, foldKeys=["id"])
        scores.append(cv.fit(df).avgMetrics)
    assert scores[0] == pytest.approx(scores[1]) and scores[0][0] != pytest.approx(scores[0][1])


def test_cross_validator_is_an_estimator(spark, tmp_path):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    lr, pipe = _weighted_lr(False)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.5]).build()
    cv = ParallelCrossValidator(estimator=pipe, evaluator=BinaryClassificationEvaluator(), estimatorParamMaps=grid, numFolds=2,
                                foldKeys=["id"], parallelism=2)
    other = cv.copy({cv.numFolds: 4})
    assert isinstance(other, ParallelCrossValidator) and other.getNumFolds() == 4 and cv.getNumFolds() == 2
    cv.write().overwrite().save(str(tmp_path / "cv"))
    back = ParallelCrossValidator.load(str(tmp_path / "cv"))
    assert (back.getNumFolds(), back.getFoldKeys(), back.getParallelism(), len(back.getEstimatorParamMaps())) == (2, ["id"], 2, 2)
    df = spark.createDataFrame([(i, float(i % 10), float(i % 10 > 3)) for i in range(120)], "id int, x double, label double")
    as_stage = Pipeline(stages=[cv]).fit(df)
    assert as_stage.stages[0].avgMetrics == pytest.approx(back.fit(df).avgMetrics)
    assert "prediction" in as_stage.transform(df).columns


def test_no_more_fits_at_once_than_asked(spark):
    import threading
    import time

    from pyspark.ml import Estimator
    from pyspark.ml.evaluation import Evaluator
    from pyspark.ml.feature import SQLTransformer
    from pyspark.ml.param import Param, Params

    lock, now, most = threading.Lock(), [0], [0]

    class Slow(Estimator):
        knob = Param(Params._dummy(), "knob", "unused")

        def _fit(self, dataset):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.2)
            with lock:
                now[0] -= 1
            return SQLTransformer(statement="SELECT * FROM __THIS__")

    class Zero(Evaluator):
        def _evaluate(self, dataset):
            return 0.0

    slow = Slow()
    grid = [{slow.knob: i} for i in range(4)]
    ParallelCrossValidator(estimator=slow, evaluator=Zero(), estimatorParamMaps=grid, numFolds=3, parallelism=3).fit(spark.range(60))
    assert 1 < most[0] <= 3
