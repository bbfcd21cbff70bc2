"""A cogroup with a caller's function, hot keys dealt in slices."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from keelson.operators.cogroup import cogroup

SCHEMA = "k long, id long, n long, most double"


def _earlier():
    def earlier(key, left, right):
        """For each left row: how many right rows have a smaller id, and their largest value."""
        ids, values = right["id"].to_pylist(), right["v"].to_pylist()
        out = [(key[0].as_py(), i, [v for j, v in zip(ids, values) if j < i]) for i in left["id"].to_pylist()]
        return pa.table({"k": pa.array([k for k, _, _ in out], pa.int64()), "id": pa.array([i for _, i, _ in out], pa.int64()),
                         "n": pa.array([len(v) for _, _, v in out], pa.int64()), "most": pa.array([max(v, default=None) for _, _, v in out], pa.float64())})

    return earlier  # made here, so that it travels to the workers as it is


earlier = _earlier()


def plain(left, right):
    return sorted(((k, i, len(v), max(v, default=None)) for k, i in left
                   for v in [[v for q, j, v in right if q == k and j < i]]), key=repr)


@pytest.fixture(scope="module")
def sides(spark):
    left = [(None if i % 50 == 7 else 0 if i % 3 == 0 else i % 11, i) for i in range(600)] + [(99, 1)]
    right = [(None if i % 40 == 5 else 0 if i % 3 == 1 else i % 11, i, float(i * 7 % 100)) for i in range(500)] + [(98, 1, 1.0)]
    return (left, right, spark.createDataFrame(left, "k long, id long").repartition(5),
            spark.createDataFrame(right, "k long, id long, v double").repartition(4))


@pytest.mark.parametrize("rows", [None, 20, 1, 10_000])
def test_left_slices_give_the_same_rows(sides, rows):
    left, right, a, b = sides
    got = sorted(map(tuple, cogroup(a, b, "k", earlier, SCHEMA, left_slice_rows=rows).collect()), key=repr)
    assert got == plain(left, right)


def test_a_hot_key_spreads_and_no_slice_is_large(spark):
    n = 30_000
    a = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), "id")
    b = spark.createDataFrame([(-1, i, 1.0) for i in range(50)], "k long, id long, v double")

    def sizes(key, left, right):
        return pa.table({"n": [left.num_rows], "m": [right.num_rows], "k": pa.array([key[0].as_py()], pa.int64())})

    got = [r for r in cogroup(a, b, ["k"], sizes, "n long, m long, k long", left_slice_rows=1000).collect() if r.k == -1]
    assert sum(r.n for r in got) == 2 * n // 3 and len(got) == 20
    assert max(r.n for r in got) < 1300 and {r.m for r in got} == {50}


def test_pairs_of_slices(sides):
    """Both sides in slices: rows that follow from pairs, summed afterwards."""
    left, right, a, b = sides

    def pairs(x, y):
        total = pc.sum(y["v"]).as_py() or 0.0
        return pa.table({"k": x["k"], "id": x["id"], "s": pa.array([total] * x.num_rows, pa.float64())})

    got = (cogroup(a, b, "k", pairs, "k long, id long, s double", left_slice_rows=30, right_slice_rows=40)
           .groupBy("k", "id").agg(F.sum("s").alias("s")).collect())
    sums = {}
    for k, _, v in right:
        sums[k] = sums.get(k, 0.0) + v
    assert sorted(map(tuple, got), key=repr) == sorted(((k, i, sums.get(k, 0.0)) for k, i in left), key=repr)


def test_empty_sides_maps_and_errors(spark, sides):
    _, _, a, b = sides
    assert cogroup(a.limit(0), b.limit(0), "k", earlier, SCHEMA, left_slice_rows=5).collect() == []
    assert cogroup(a, b.limit(0), "k", earlier, SCHEMA, left_slice_rows=5).where("n > 0").count() == 0
    mapped = a.withColumn("m", F.create_map(F.lit("x"), "id"))
    assert cogroup(mapped, b, "k", earlier, SCHEMA, left_slice_rows=5).count() == 601
    with pytest.raises(ValueError):
        cogroup(a, b, [], earlier, SCHEMA)
    with pytest.raises(ValueError):
        cogroup(a.withColumnRenamed("id", "_kl_left_slice"), b, "k", earlier, SCHEMA)
