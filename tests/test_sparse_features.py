"""F9, F10 for any number of names; S5 as one file."""

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from keelson.operators import featurize
from keelson.operators.featurize import SparseFeaturizer, SparseFeaturizerEstimator
from keelson.sources.sinks import write_csv


def test_vectors_over_a_learned_table(spark, tmp_path):
    rows = [(1, [("b", 1.0), ("a", 2.0), ("b", 9.0)]), (2, []), (3, None), (4, [(None, 5.0), ("c", None), ("é", -1.0)]), (5, [("a", None), ("a", 3.0)])]
    df = spark.createDataFrame(rows, "id int, f array<struct<name:string,value:double>>").withColumn("index", F.lit("x"))
    model = SparseFeaturizerEstimator(inputCol="f", outputCol="v", keyCols=["id"], namesPath=str(tmp_path / "names")).fit(df)
    assert {r.name: r["index"] for r in model.names(spark).collect()} == {"a": 0, "b": 1, "c": 2, "é": 3}
    out = model.transform(df)
    assert out.columns == ["id", "f", "index", "v"]
    got = {r.id: r.v for r in out.collect()}
    empty = SparseVector(4, [], [])
    # the first value of a name counts, also where it is null
    assert got == {1: SparseVector(4, [0, 1], [2.0, 1.0]), 2: empty, 3: empty, 4: SparseVector(4, [3], [-1.0]), 5: empty}
    assert out.schema["v"].dataType == model.transformSchema(df.schema)["v"].dataType
    model.write().overwrite().save(str(tmp_path / "model"))
    again = SparseFeaturizer.load(str(tmp_path / "model")).transform(spark.createDataFrame([(7, [("z", 1.0), ("b", 2.0)])], df.drop("index").schema))
    assert again.first().v == SparseVector(4, [1], [2.0])
    with pytest.raises(ValueError):
        model.transform(df.withColumn("v", F.lit(1)))


def test_a_million_names_without_a_list(spark, monkeypatch):
    monkeypatch.setattr(featurize, "collect_names", None)
    n = 1_000_000
    df = spark.range(0, n, 4, 8).select("id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(
        F.format_string("n%07d", F.col("id") + i).alias("name"), (F.col("id") + i).cast("double").alias("value"))).alias("f"))
    df = df.withColumn("f", F.concat("f", F.array(F.struct(F.lit("shared").alias("name"), F.lit(0.5).alias("value")))))
    model = SparseFeaturizerEstimator(inputCol="f", outputCol="v", keyCols=["id"]).fit(df)
    assert model.getOrDefault(model.size) == n + 1
    flat = featurize.sparse_features(df, ["id"], "f", model.names(spark)).select("id", F.inline(F.arrays_zip("indices", "values")))
    assert flat.where("indices <> if(values = 0.5, 1000000, int(values))").count() == 0
    assert flat.count() == n + n // 4


def test_one_file_from_several_tasks(spark, tmp_path):
    df = spark.range(0, 5000, 1, 6).select("id", F.concat(F.lit('a,"'), "id").alias("x,y"))
    path = str(tmp_path / "out")
    assert write_csv(df.orderBy("id"), path, single_file=True) == path
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    assert names == ["_SUCCESS", "part-00000.csv"] and not list(tmp_path.glob("out.parts*"))
    lines = (tmp_path / "out" / "part-00000.csv").read_text().splitlines()
    assert lines[0] == 'id,"x,y"' and len(lines) == 5001
    assert [int(x.split(",")[0]) for x in lines[1:]] == list(range(5000))  # parts in their order
    assert spark.read.csv(path, header=True, schema="id long, t string", escape="\\").count() == 5000
    write_csv(df, str(tmp_path / "parts"))
    assert len(list((tmp_path / "parts").glob("part-*"))) == 6  # the same plan writes from six tasks
    with pytest.raises(FileExistsError):
        write_csv(df, path, single_file=True)
    write_csv(df.limit(0), path, single_file=True, mode="overwrite")
    assert (tmp_path / "out" / "part-00000.csv").read_text() == 'id,"x,y"\n'
    write_csv(df, path, single_file=True, mode="ignore", header=False)
    assert len((tmp_path / "out" / "part-00000.csv").read_text().splitlines()) == 1
