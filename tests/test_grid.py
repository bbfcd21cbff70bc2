"""L2, L4, A1: shared prefixes, many models in one scan, the journal."""

import pytest
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.param import Param, Params
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from keelson.operators.metrics import LogLossEvaluator, ShareCorrectEvaluator
from keelson.plans.grid import fit_tries, flat_stages, models_of
from keelson.plans.forests import bin_bounds, levels_in_one_pass
from keelson.plans.scoring import score_trie
from keelson.plans.stages import VectorElement
from keelson.plans.tuning import ParallelCrossValidator, _pool, fit_many

FITS = []


class Shift(Estimator):
    """Adds ``by`` plus the mean of a column; counts its fits."""

    by = Param(Params._dummy(), "by", "added")
    name = Param(Params._dummy(), "name", "column")

    def __init__(self, name, by=0.0):
        super().__init__()
        self._set(name=name, by=by)

    def _fit(self, dataset):
        name, by = self.getOrDefault(self.name), self.getOrDefault(self.by)
        FITS.append((name, by))
        mean = dataset.agg(F.avg("x")).first()[0]
        return SQLTransformer(statement=f"SELECT *, x + {mean} + {by} AS {name} FROM __THIS__")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, float(i % 10), float((i * 7) % 13 > 5 + i % 3)) for i in range(240)], "id int, x double, label double").cache()


def test_each_prefix_is_fitted_once(spark, rows):
    a, b, c = Shift("a"), Shift("b"), Shift("c")
    pipe = Pipeline(stages=[a, Pipeline(stages=[b, Pipeline(stages=[c])])])
    assert flat_stages(pipe) == [a, b, c]
    grid = [{a.by: x, b.by: y, c.by: z} for x in (0.0, 1.0) for y in (0.0, 2.0) for z in (0.0, 3.0, 4.0)]
    FITS.clear()
    models = fit_many(pipe, rows, grid, parallelism=4)
    assert len(FITS) == 2 + 4 + 12 and len(models) == 12
    assert not any(d.isEmpty() for d in [rows]) and spark.sparkContext._jsc.getPersistentRDDs().size() == 1  # only the input's own
    for model, params in zip(models, grid):
        same = pipe.fit(rows, params)
        cols = ["a", "b", "c"]
        assert model.transform(rows).select(*cols).first() == same.transform(rows).select(*cols).first()
        assert len(model.stages) == 2 and len(model.stages[1].stages) == 2
    FITS.clear()
    assert len(fit_many(pipe, rows, [{}, {}, {c.by: 1.0}])) == 3 and len(FITS) == 4
    assert fit_many(a, rows, [{a.by: 5.0}])[0].transform(rows).first().a == pytest.approx(rows.first().x + 4.5 + 5.0)
    assert fit_many(pipe, rows, []) == []


def test_all_models_of_a_fold_in_one_job(spark, rows):
    lr = LogisticRegression(maxIter=5)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), lr, VectorElement(inputCol="probability", outputCol="prob", index=1)])
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1, 1.0]).addGrid(lr.maxIter, [2, 5]).build()
    with _pool(3) as pool:
        trie = fit_tries(pipe, [rows], [grid], pool)[0]
    models = models_of(pipe, trie, len(grid))
    for n, evaluator in enumerate([LogLossEvaluator(labelCol="label", probabilityCol="prob"), ShareCorrectEvaluator(labelCol="label"),
                      RegressionEvaluator(metricName="rmse"), RegressionEvaluator(metricName="mae")]):
        spark.sparkContext.setJobGroup(f"one-scan-{n}", "scores")
        got = score_trie(trie, rows, evaluator, len(grid))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"one-scan-{n}")
        spark.sparkContext.setJobGroup("other", "")
        stages = sum(len(spark.sparkContext.statusTracker().getJobInfo(j).stageIds) for j in jobs)
        assert len(jobs) <= 2 and stages <= 3  # one aggregation over one scan
        assert got == pytest.approx([evaluator.evaluate(m.transform(rows)) for m in models], rel=1e-9)
    area = BinaryClassificationEvaluator()
    assert score_trie(trie, rows, area, len(grid), models) == [area.evaluate(m.transform(rows)) for m in models]


def test_a_stopped_run_goes_on_from_its_journal(spark, rows, tmp_path):
    shift, lr = Shift("s"), LinearRegression(maxIter=3)
    pipe = Pipeline(stages=[shift, VectorAssembler(inputCols=["s"], outputCol="features"), lr])
    grid = [{shift.by: b, lr.regParam: r} for b in (0.0, 1.0) for r in (0.0, 1.0)]

    class Stops(RegressionEvaluator):
        """Fails when asked for the second time."""

        left = 99

        def evaluate(self, dataset, params=None):
            Stops.left -= 1
            if Stops.left < 0:
                raise RuntimeError("driver lost")
            return super().evaluate(dataset, params)

    def cv(folder):
        return ParallelCrossValidator(estimator=pipe, evaluator=Stops(metricName="rmse"), estimatorParamMaps=grid, numFolds=3, foldKeys=["id"],
                                      parallelism=2, journal=folder)

    Stops.left = 99
    want = cv("").fold_metrics(rows)
    Stops.left = 6  # the first fold's four sets and half of the second's
    with pytest.raises(RuntimeError):
        cv(str(tmp_path)).fold_metrics(rows)
    Stops.left = 99
    FITS.clear()
    assert cv(str(tmp_path)).fold_metrics(rows) == want
    assert len(FITS) == 2 * 2  # two folds lacked, each with two values of the first stage
    FITS.clear()
    assert cv(str(tmp_path)).fold_metrics(rows) == want and not FITS
    cv(str(tmp_path)).fold_metrics(rows.where("id > 5"))
    assert len(FITS) == 3 * 2  # other data, other journal


@pytest.fixture
def forest_fits(monkeypatch):
    """The depths of the forests that are fitted."""
    depths, fit = [], RandomForestRegressor._fit

    def counted(self, dataset):
        depths.append(self.getMaxDepth())
        return fit(self, dataset)

    monkeypatch.setattr(RandomForestRegressor, "_fit", counted)
    return depths


def _vectors(spark):
    cols = [F.pmod(F.hash("id", F.lit(i)), F.lit(2 if i else 40)).cast("double").alias(f"f{i}") for i in range(12)]
    df = spark.range(600).select("id", *cols, (F.pmod(F.hash("id"), F.lit(3)) == 0).cast("double").alias("label"))
    return VectorAssembler(inputCols=[f"f{i}" for i in range(12)], outputCol="features").transform(df).coalesce(2).cache()


def test_forests_of_other_depths_are_one_fit(spark, forest_fits):
    data, rf = _vectors(spark), RandomForestRegressor(seed=5, maxBins=20)
    grid = (ParamGridBuilder().addGrid(rf.numTrees, [3, 4]).addGrid(rf.featureSubsetStrategy, ["onethird", "log2"])
            .addGrid(rf.maxDepth, [4, 0, 7, 2]).build())
    models = fit_many(Pipeline(stages=[rf]), data, grid, parallelism=3)
    assert forest_fits == [7] * 4
    for model, params in zip(models, grid):
        own, got = rf.fit(data, params), model.stages[0]
        assert got.toDebugString == own.toDebugString and got.getMaxDepth() == params[rf.maxDepth] and got.getNumTrees == params[rf.numTrees]
        assert [r.prediction for r in got.transform(data).orderBy("id").collect()] == [r.prediction for r in own.transform(data).orderBy("id").collect()]


def test_forests_whose_levels_take_several_passes_are_fitted_one_by_one(spark, forest_fits):
    data, rf = _vectors(spark), RandomForestRegressor(seed=5, numTrees=40, maxBins=30, maxMemoryInMB=1)
    bins = bin_bounds(data, rf)
    assert bins == [30] + [2] * 11  # 40 values in at most 30 bins; binary features
    assert levels_in_one_pass(rf, 3, bins) and not levels_in_one_pass(rf, 8, bins)
    fit_many(Pipeline(stages=[rf]), data, [{rf.maxDepth: d} for d in (8, 9)])
    assert sorted(forest_fits) == [8, 9]


TEXTS = []


class Doubled(Transformer):
    """Learns nothing; counts its uses."""

    def _transform(self, dataset):
        TEXTS.append(dataset.columns)
        return dataset.withColumn("twice", F.col("x") * 2)


def test_leading_transformers_run_once_for_all_folds(spark, rows):
    lr = LinearRegression(maxIter=3)
    pipe = Pipeline(stages=[Pipeline(stages=[Doubled()]), VectorAssembler(inputCols=["twice"], outputCol="features"), lr])
    cv = ParallelCrossValidator(estimator=pipe, evaluator=RegressionEvaluator(), estimatorParamMaps=[{lr.regParam: r} for r in (0.0, 0.5)],
                                numFolds=3, foldKeys=["id"])
    TEXTS.clear()
    model = cv.fit(rows)
    assert len(TEXTS) == 1
    _, rest, prepared = cv._prepared(cv._folded(rows))
    assert flat_stages(rest) == [lr] and set(prepared.columns) == {"label", "features", "_kl_fold"}
    prepared.unpersist()
    want = pipe.fit(rows, {lr.regParam: [0.0, 0.5][model.bestIndex]})
    assert [type(s) for s in model.bestModel.stages] == [type(s) for s in want.stages]
    assert [r.prediction for r in model.transform(rows).collect()] == pytest.approx([r.prediction for r in want.transform(rows).collect()])
