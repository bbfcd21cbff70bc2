"""S2, S2a, S4 (file stand-in), S8 and the GapFiller stage."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from keelson.operators.ordering import GapFiller
from keelson.sources.sinks import write_table
from keelson.sources.tables import csv, from_rows

CREDIT = """customer_id,limit_bal,sex,age,default_oct
1,20000,2,NA,yes
2,x,1,30,no
3,50000,NA,63,no
"""


def test_csv_na_and_positional(spark, tmp_path):
    p = tmp_path / "train.csv"
    p.write_text(CREDIT)
    df = csv(spark, str(p), infer=True)
    rows = df.orderBy("customer_id").collect()
    assert rows[0]["age"] is None and rows[2]["sex"] is None
    raw = csv(spark, str(p), null_value="\u0000", sep=",")  # S2a: all strings, NA kept as text
    assert raw.schema["age"].dataType.simpleString() == "string"
    assert raw.orderBy("customer_id").first()["age"] == "NA"


def test_write_table_vectors(spark, tmp_path):
    df = from_rows(spark, [(1, [0.5, 0.25])], "id int, v array<double>").select("id", array_to_vector("v").alias("v"))
    path = write_table(df, str(tmp_path / "out"))
    back = spark.read.parquet(path)
    assert back.schema["v"].dataType.simpleString() == "array<double>"


def test_gap_filler_stage(spark, tmp_path):
    df = spark.createDataFrame([(1,), (4,)], "k int")
    stage = GapFiller(inputCol="k", outputCol="off", maxGap=5)
    out = sorted(tuple(r) for r in stage.transform(df).collect())
    assert out == [(1, 0), (1, 1), (1, 2), (4, 0)]
    model = Pipeline(stages=[stage]).fit(df)
    model.write().overwrite().save(str(tmp_path / "gf"))
    assert PipelineModel.load(str(tmp_path / "gf")).transform(df).count() == 4
    with pytest.raises(ValueError):
        GapFiller(inputCol="k", outputCol="k").transform(df)


def test_csv_sink_vectors_and_select(spark, tmp_path):
    from keelson.sources.sinks import write_csv

    df = from_rows(spark, [(1, [0.5, 0.25]), (2, [1.0, 2.0])], "id int, v array<double>") \
        .select("id", array_to_vector("v").alias("v"))
    path = write_csv(df, str(tmp_path / "out"), select_exprs=["id", "v", "id * 2 as twice"], single_file=True)
    back = spark.read.csv(path, header=True).orderBy("id").collect()
    assert [r.twice for r in back] == ["2", "4"] and back[0].v == "[0.5,0.25]"
