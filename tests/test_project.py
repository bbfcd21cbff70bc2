"""P7, P9, P11, P18 and the featurizer."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from keelson.operators.featurize import Featurizer, FeaturizerEstimator
from keelson.operators.project import ConstantColumn, conform, db_compatible, fill_nulls_by_type


def test_constant_column_fixture(spark, tmp_path):
    df = spark.createDataFrame([("asdf", 768), ("bcd", 54), ("zzsdfd", 45), ("4asdfs", 467)],
                               "randomText string, randomNumbers int")
    out = ConstantColumn().transform(df)
    assert len(out.columns) == len(df.columns) + 1
    assert {r.extraField for r in out.collect()} == {"hello, world!"}
    model = Pipeline(stages=[ConstantColumn(outputCol="x", value="v")]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(df).select("x").distinct().first()[0] == "v"


def test_db_compatible_keeps_order(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a")], "id int, v array<double>, s string")
    out = db_compatible(df.select("id", array_to_vector("v").alias("v"), "s"))
    assert out.columns == ["id", "v", "s"]
    assert out.schema["v"].dataType.simpleString() == "array<double>"


def test_conform(spark):
    scored = spark.createDataFrame([(1, "x", 0.7, 9)], "id int, f string, prediction double, Extra int")
    out = conform(scored, ["id", "f", "label", "extra"], "label", "prediction")
    assert out.columns == ["id", "f", "label"]
    with pytest.raises(ValueError):
        conform(scored.drop("prediction"), ["id"], "label", "prediction")


def test_fill_nulls(spark):
    df = spark.createDataFrame([(None, None, 1.5)], "a int, s string, d double")
    r = fill_nulls_by_type(df).first()
    assert (r.a, r.s, r.d) == (0, "", 1.5)


def test_featurizer_first_match_and_absent(spark):
    df = spark.createDataFrame([([("hp", 1.0), ("mana", 2.0), ("hp", 9.0)],), ([("mana", 3.0)],)],
                               "features array<struct<name:string, value:double>>")
    model = FeaturizerEstimator(inputCol="features", outputCol="fs").fit(df)
    assert model.getFeatures() == ["hp", "mana"]
    rows = [(r.fs.hp, r.fs.mana) for r in model.transform(df).collect()]
    assert rows == [(1.0, 2.0), (None, 3.0)]
    assert Featurizer(inputCol="features", outputCol="o", features=["zz"]).transform(df).first().o.zz is None


def test_feature_name_cap(spark):
    from keelson.operators.featurize import collect_names, distinct_feature_names

    df = spark.createDataFrame([([(f"f{i}", 1.0) for i in range(20)],)],
                               "features array<struct<name:string, value:double>>")
    names = distinct_feature_names(df, "features")
    assert len(collect_names(names)) == len(collect_names(names, limit=20)) == 20
    with pytest.raises(ValueError):
        FeaturizerEstimator(inputCol="features", outputCol="fs", maxNames=19).fit(df)
    assert len(FeaturizerEstimator(inputCol="features", outputCol="fs").fit(df).getFeatures()) == 20


def test_features_long_keeps_the_first_value(spark):
    from keelson.operators.featurize import features_long

    df = spark.createDataFrame([(1, [("hp", 1.0), (None, 5.0), ("hp", 9.0)]), (2, [("mana", None), ("mana", 3.0)]), (3, None)],
                               "id int, features array<struct<name:string, value:double>>")
    assert sorted(map(tuple, features_long(df, ["id"], "features").collect())) == [(1, "hp", 1.0), (2, "mana", None)]
    model = FeaturizerEstimator(inputCol="features", outputCol="fs").fit(df)
    assert [tuple(r.fs) for r in model.transform(df).orderBy("id").collect()] == [(1.0, None), (None, None), (None, None)]
