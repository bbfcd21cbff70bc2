"""Checks for models, pipelines, tuning and the recipe (M1-M4, L1, L2, L4-L8). Results depend
on trained models, so most are rows-only; the splits (L7) have SQL oracles."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (IndexToString, StringIndexer, UnivariateFeatureSelector, VectorAssembler,
                                VectorIndexer)
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from keelson.operators.metrics import LogLossEvaluator
from keelson.plans.recipe import Recipe
from keelson.plans.registry import query
from keelson.plans.stages import VectorElement
from keelson.plans.tuning import (SCRIPT_SEED, ParallelCrossValidator, fit_many, hash_split, modulus_split,
                                  serial_cross_validator, with_folds)
from keelson.sources.tables import table

NUMERIC = ["n_chars", "n_words", "lang_idx", "source_idx"]


def _docs(spark, sf):
    """Labeled and unlabeled documents with a few whole-text features. Sizes are binned by powers of
    two, since the chi-square selector takes categorical features."""
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", "source",
        F.floor(F.log2(F.col("n_chars") + 1)).cast("double").alias("n_chars"),
        F.floor(F.log2(F.size(F.split(F.col("text"), r"\s+")) + F.lit(1))).cast("double").alias("n_words"))
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id"), docs.join(labels, "doc_id", "left_anti")


def _text_indexer():
    """Both string columns indexed by one stage (one pass over the data to fit)."""
    return StringIndexer(inputCols=["lang", "source"], outputCols=["lang_idx", "source_idx"], handleInvalid="keep")


def _assembled(df):
    stages = [_text_indexer(), VectorAssembler(inputCols=NUMERIC, outputCol="features")]
    return Pipeline(stages=stages).fit(df).transform(df)


def _classifier_stages(labeled):
    """The credit script's seven-stage chain on document features."""
    label_indexer = StringIndexer(inputCol="quality", outputCol="indexedLabel", handleInvalid="keep").fit(labeled)
    rf = RandomForestClassifier(seed=SCRIPT_SEED, featuresCol="selectedFeatures",
                                labelCol="indexedLabel", predictionCol="prediction")
    stages = [
        _text_indexer(),
        VectorAssembler(inputCols=NUMERIC, outputCol="features"),
        VectorIndexer(inputCol="features", outputCol="indexedFeatures", maxCategories=4, handleInvalid="keep"),
        label_indexer,
        UnivariateFeatureSelector(featuresCol="indexedFeatures", labelCol="indexedLabel",
                                  outputCol="selectedFeatures", selectionMode="numTopFeatures")
        .setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(3),
        rf,
        IndexToString(inputCol="prediction", outputCol="predictedLabel", labels=label_indexer.labels),
        VectorElement(inputCol="probability", outputCol="prob", index=1),
    ]
    return stages, rf


@query("m1_random_forest_classifier")
def m1_random_forest_classifier(spark, sf):
    labeled, _ = _docs(spark, sf)
    data = _assembled(labeled).withColumn("label", F.col("quality").cast("double"))
    model = RandomForestClassifier(seed=SCRIPT_SEED).fit(data)
    return model.transform(data).select("doc_id", "prediction")


@query("m2_random_forest_regressor")
def m2_random_forest_regressor(spark, sf):
    labeled, _ = _docs(spark, sf)
    data = _assembled(labeled).withColumn("label", F.col("quality").cast("double"))
    model = RandomForestRegressor(seed=SCRIPT_SEED, maxBins=100).fit(data)
    return model.transform(data).select("doc_id", "prediction")


@query("m3_decision_tree_regressor")
def m3_decision_tree_regressor(spark, sf):
    labeled, _ = _docs(spark, sf)
    data = _assembled(labeled).withColumn("label", F.col("quality").cast("double"))
    model = DecisionTreeRegressor().fit(data)
    return model.transform(data).select("doc_id", "prediction")


@query("m4_logistic_regression")
def m4_logistic_regression(spark, sf):
    """Reg 0, elastic net 0, 100 iterations, tol 1e-6, intercept; 0.8/0.2 split, RMSE kept."""
    labeled, _ = _docs(spark, sf)
    data = _assembled(labeled).withColumn("label", F.col("quality").cast("double"))
    train, test = hash_split(data, [0.8, 0.2], keys="doc_id", seed=SCRIPT_SEED)
    lr = LogisticRegression(regParam=0.0, elasticNetParam=0.0, maxIter=100, tol=1e-6, fitIntercept=True)
    pred = lr.fit(train).transform(test)
    rmse = RegressionEvaluator(metricName="rmse").evaluate(pred)
    return pred.select("doc_id", "prediction", F.abs(F.col("prediction") - F.col("label")).alias("abs_err"),
                       F.lit(rmse).alias("rmse")).orderBy("abs_err", "doc_id")


def _by_language(spark, sf, label):
    """Documents with one categorical feature, the indexed language, and a label made of it."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.expr(label).alias("label"))
    docs = StringIndexer(inputCol="lang", outputCol="lang_idx").fit(docs).transform(docs)
    return VectorAssembler(inputCols=["lang_idx"], outputCol="features").transform(docs)


_IS_GERMAN = "CASE WHEN lang = 'de' THEN 1.0D ELSE 0.0D END"
_LEVEL = "CASE lang WHEN 'de' THEN 3.5D WHEN 'en' THEN -1.25D WHEN 'fr' THEN 8.0D ELSE 0.5D END"


@query("m1_forest_learns_a_rule", "SELECT doc_id, CASE WHEN lang = 'de' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM documents")
def m1_forest_learns_a_rule(spark, sf):
    """A forest on a label that the feature determines predicts it exactly."""
    data = _by_language(spark, sf, _IS_GERMAN)
    return RandomForestClassifier(seed=SCRIPT_SEED).fit(data).transform(data).select("doc_id", "prediction")


@query("m2_forest_regresses_a_rule", """
SELECT doc_id, round(CASE lang WHEN 'de' THEN 3.5 WHEN 'en' THEN -1.25 WHEN 'fr' THEN 8.0 ELSE 0.5 END::DOUBLE, 6) AS prediction
FROM documents
""")
def m2_forest_regresses_a_rule(spark, sf):
    data = _by_language(spark, sf, _LEVEL)
    out = RandomForestRegressor(seed=SCRIPT_SEED, maxBins=100).fit(data).transform(data)
    return out.select("doc_id", F.round("prediction", 6).alias("prediction"))


@query("m3_tree_predicts_group_means", """
SELECT doc_id, round(avg(n_chars::DOUBLE) OVER (PARTITION BY lang), 6) AS prediction FROM documents
""")
def m3_tree_predicts_group_means(spark, sf):
    """A regression tree of default depth on one categorical feature predicts each group's mean."""
    data = _by_language(spark, sf, "CAST(n_chars AS DOUBLE)")
    out = DecisionTreeRegressor().fit(data).transform(data)
    return out.select("doc_id", F.round("prediction", 6).alias("prediction"))


@query("m4_logistic_log_odds", """
WITH p AS (SELECT lang = 'de' AS x, avg((n_chars > 1500)::INTEGER::DOUBLE) AS p FROM documents GROUP BY 1)
SELECT round(ln(a.p / (1 - a.p)), 3) AS intercept, round(ln(b.p / (1 - b.p)) - ln(a.p / (1 - a.p)), 3) AS coefficient
FROM p a, p b WHERE NOT a.x AND b.x
""")
def m4_logistic_log_odds(spark, sf):
    """Logistic regression on one binary feature: its parameters are the groups' log odds."""
    docs = table(spark, sf, "documents").select(
        F.expr(_IS_GERMAN).alias("x"), (F.col("n_chars") > 1500).cast("double").alias("label"))
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(docs)
    model = LogisticRegression(regParam=0.0, maxIter=100, tol=1e-9, standardization=False).fit(data)
    # the parameters of a fitted model are a driver-side property
    return spark.createDataFrame([(round(model.intercept, 3), round(float(model.coefficients[0]), 3))],
                                 "intercept double, coefficient double")


@query("l1_stages_fit_transform")
def l1_stages_fit_transform(spark, sf):
    labeled, _ = _docs(spark, sf)
    stages, _ = _classifier_stages(labeled)
    out = Pipeline(stages=stages).fit(labeled).transform(labeled)
    return out.select("doc_id", "predictedLabel", "prob")


def _grid(rf):
    return ParamGridBuilder().addGrid(rf.impurity, ["gini", "entropy"]).build()


@query("l2_fit_many")
def l2_fit_many(spark, sf):
    """One pipeline fitted for two parameter sets at once; log loss of each on a held-out part."""
    labeled, _ = _docs(spark, sf)
    stages, rf = _classifier_stages(labeled)
    train, test = hash_split(labeled, [0.7, 0.3], keys="doc_id")
    grid = _grid(rf)
    models = fit_many(Pipeline(stages=stages), train, grid, parallelism=2)
    ev = LogLossEvaluator(labelCol="indexedLabel", probabilityCol="prob")
    rows = [(i, float(ev.evaluate(m.transform(test)))) for i, m in enumerate(models)]
    return spark.createDataFrame(rows, "param_index int, log_loss double")


@query("l4_parallel_cv")
def l4_parallel_cv(spark, sf):
    """Three folds x two parameter sets, concurrent; mean log loss per set, best marked."""
    labeled, _ = _docs(spark, sf)
    stages, rf = _classifier_stages(labeled)
    cv = ParallelCrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=_grid(rf),
                                evaluator=LogLossEvaluator(labelCol="indexedLabel", probabilityCol="prob"),
                                numFolds=3, parallelism=6, foldKeys=["doc_id"])
    model = cv.fit(labeled)
    rows = [(i, float(m), i == model.bestIndex) for i, m in enumerate(model.avgMetrics)]
    return spark.createDataFrame(rows, "param_index int, avg_log_loss double, is_best boolean")


@query("l5_serial_cv")
def l5_serial_cv(spark, sf):
    """Spark's serial CrossValidator over the same hash folds."""
    labeled, _ = _docs(spark, sf)
    stages, rf = _classifier_stages(labeled)
    folded = with_folds(labeled, 3, keys=["doc_id"], name="fold")
    cv = serial_cross_validator(Pipeline(stages=stages), LogLossEvaluator(labelCol="indexedLabel",
                                                                          probabilityCol="prob"),
                                _grid(rf), num_folds=3, fold_col="fold")
    model = cv.fit(folded)
    return spark.createDataFrame([(i, float(m)) for i, m in enumerate(model.avgMetrics)],
                                 "param_index int, avg_log_loss double")


@query("l6_recipe")
def l6_recipe(spark, sf):
    """Recipe: cross-validate, refit, score the unlabeled documents and conform them."""
    labeled, unlabeled = _docs(spark, sf)
    stages, rf = _classifier_stages(labeled)
    r = Recipe(labeled=labeled, unlabeled=unlabeled, label_col="quality", prediction_col="predictedLabel",
               evaluator=LogLossEvaluator(labelCol="indexedLabel", probabilityCol="prob"),
               name="docs_rfc", param_maps=_grid(rf), stages=stages, num_folds=3, fold_keys=["doc_id"])
    return r.unlabeled_predictions


# The text recipe's grid.
TEXT_GRID = {"numTrees": [15, 30, 45], "featureSubsetStrategy": ["onethird", "sqrt", "log2"], "maxDepth": [3, 6, 9]}


@query("l6_text_recipe")
def l6_text_recipe(spark, sf):
    """The text recipe end to end: tokenized and hashed text columns (F8a), indexers fitted on
    labeled and unlabeled rows together (F1b), assembler (F4), forest regressor with 100 bins (M2),
    the full three-parameter grid over three folds (L4), and CSV after select expressions (S6),
    read back."""
    from keelson.plans.catalog_sources import _folder
    from keelson.plans.stages import text_stages
    from keelson.sources.tables import csv

    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"),
        F.concat_ws(" ", "lang", "source").alias("tags"), "text")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    labeled, unlabeled = docs.join(labels, "doc_id"), docs.join(labels, "doc_id", "left_anti")
    indexer = StringIndexer(inputCols=["lang", "source"], outputCols=["idx_lang", "idx_source"],
                            handleInvalid="keep").fit(labeled.drop("quality").unionByName(unlabeled))
    rf = RandomForestRegressor(seed=SCRIPT_SEED, featuresCol="selectedFeatures", labelCol="quality", predictionCol="prediction", maxBins=100)
    stages = [*text_stages(["text", "tags"]), indexer,
              VectorAssembler(inputCols=["n_chars", "idx_lang", "idx_source", "tf_text", "tf_tags"], outputCol="selectedFeatures"), rf]
    grid = ParamGridBuilder()
    for name, values in TEXT_GRID.items():
        grid = grid.addGrid(getattr(rf, name), values)
    recipe = Recipe(labeled=labeled, unlabeled=unlabeled, label_col="quality", prediction_col="prediction",
                    evaluator=RegressionEvaluator(labelCol="quality", metricName="rmse"), name="docs_rfr", param_maps=grid.build(),
                    stages=stages, num_folds=3, parallelism=8, fold_keys=["doc_id"])
    path = recipe.write_csv(prefix=_folder(spark, "recipe"), select_exprs=["doc_id", "quality as quality_yhat"])
    recipe.release()
    return csv(spark, path, "doc_id bigint, quality_yhat double")


@query("l7_modulus_split", """
SELECT doc_id, lang FROM documents WHERE (doc_id * 37 + 11) % 10 < 8
""")
def l7_modulus_split(spark, sf):
    """The 0.8 part of a reproducible 0.8/0.2 split on the integer key."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    train, _ = modulus_split(docs, "doc_id", [8, 2])
    return train


@query("l7_hash_split")
def l7_hash_split(spark, sf):
    """0.7/0.3 split by a seeded hash of the key; both parts returned with their side."""
    docs = table(spark, sf, "documents").select("doc_id")
    a, b = hash_split(docs, [0.7, 0.3], keys="doc_id")
    return a.withColumn("part", F.lit(0)).unionByName(b.withColumn("part", F.lit(1)))


@query("l7_hash_split_parts", "SELECT doc_id, 1::BIGINT AS parts FROM documents")
def l7_hash_split_parts(spark, sf):
    """Every row is in exactly one part of a hash split."""
    docs = table(spark, sf, "documents").select("doc_id")
    a, b, c = hash_split(docs, [0.5, 0.3, 0.2], keys="doc_id")
    return a.unionByName(b).unionByName(c).groupBy("doc_id").agg(F.count("*").alias("parts"))


@query("flow_event_state_model")
def flow_event_state_model(spark, sf):
    """The event-state training flow end to end: actions joined to their latest earlier state
    (J1), packed (P13), state features learned (F10) and featurized (F9), assembled through
    dotted names (F4), label and feature indexing (F1, F5), a 10-tree forest on a 0.7 split
    (M1, L7), labels mapped back (F2) and accuracy on the rest (A4)."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    from keelson.operators.asof import asof_join
    from keelson.operators.featurize import FeaturizerEstimator
    from keelson.operators.project import pack_pair

    ev = table(spark, sf, "events")
    actions = ev.where(F.col("event_type") == "click").select(
        "event_id", "user_id", "ts", F.ceil(F.col("value") / 100).cast("bigint").alias("spellId"))
    states = ev.where(F.col("event_type") == "view").select("event_id", "user_id", "ts", "value", "props")
    pairs = asof_join(actions, states, "ts", "ts", by="user_id", bucket_ms=86_400_000,
                      action_tiebreak="event_id", state_tiebreak="event_id")
    data = pack_pair(pairs, "actionEvent", "gameState", key="spellId").withColumn(
        "stateFeatures", F.array(
            F.struct(F.lit("view_value").alias("name"), F.col("gameState.value").alias("value")),
            F.struct(F.lit("props_k").alias("name"),
                     F.get_json_object("gameState.props", "$.k").try_cast("double").alias("value"))))
    featurizer = FeaturizerEstimator(inputCol="stateFeatures", outputCol="gameStateFeatures").fit(data)
    assembler = VectorAssembler(inputCols=featurizer.field_names(), outputCol="features", handleInvalid="keep")
    label_indexer = StringIndexer(inputCol="spellId", outputCol="indexedLabel").fit(data)
    feature_indexer = VectorIndexer(inputCol="features", outputCol="indexedFeatures", maxCategories=4,
                                    handleInvalid="keep")
    rf = RandomForestClassifier(labelCol="indexedLabel", featuresCol="indexedFeatures", numTrees=10,
                                seed=SCRIPT_SEED)
    converter = IndexToString(inputCol="prediction", outputCol="predictedLabel", labels=label_indexer.labels)
    train, test = hash_split(data, [0.7, 0.3], keys=F.col("actionEvent.event_id"))
    model = Pipeline(stages=[featurizer, assembler, label_indexer, feature_indexer, rf, converter]).fit(train)
    pred = model.transform(test)
    acc = MulticlassClassificationEvaluator(labelCol="indexedLabel", predictionCol="prediction",
                                            metricName="accuracy").evaluate(pred)
    return pred.select(F.col("actionEvent.event_id").alias("event_id"), "spellId", "predictedLabel",
                       F.lit(1 - acc).alias("test_error"))
