"""Tables with map and variant columns, which Spark cannot hash, in every operator that hashes rows."""

import pytest
from pyspark.sql import functions as F

from keelson.operators.asof import asof_join
from keelson.operators.ordering import sliding, with_next, with_row_index
from keelson.plans.tuning import fold_of, hash_split


@pytest.fixture(scope="module")
def mapped(spark):
    return spark.range(60).select("id", (F.col("id") % 7).alias("k"), F.create_map(F.lit("x"), "id").alias("m"),
                                  F.struct(F.create_map(F.lit("y"), "id").alias("inner"), F.col("id").alias("n")).alias("s"),
                                  F.array(F.create_map(F.lit("z"), "id")).alias("a"), F.col("id").cast("string").cast("variant").alias("v"))


@pytest.mark.parametrize("n", [2, 3])
def test_sliding(mapped, n):
    rows = sliding(mapped, n, "k", num_buckets=5).collect()
    assert len(rows) == 60 and sorted(r.window[0].id for r in rows) == list(range(60))
    assert all(r.window[0].m == {"x": r.window[0].id} for r in rows)
    assert [len(r.window) for r in rows].count(n) == 61 - n


def test_next_row_and_row_index(mapped):
    ordered = sorted(r.row_index for r in with_row_index(mapped, "k", num_buckets=4).collect())
    assert ordered == list(range(1, 61))
    assert with_next(mapped, "id", num_buckets=4).count() >= 59


def test_asof_join_without_tie_breaks(mapped):
    actions = mapped.select((F.col("id") * 10).alias("t"), "m", "s")
    states = mapped.select((F.col("id") * 10 - 3).alias("u"), "m", "a")
    pairs = asof_join(actions, states, "t", "u", bucket_ms=None, num_buckets=3).collect()
    assert len(pairs) == 60 and all(r.actionEvent.m == r.gameState.m for r in pairs)


def test_folds_and_splits(mapped):
    folds = mapped.withColumn("f", fold_of(mapped, 3)).groupBy("f").count().collect()
    assert len(folds) == 3 and sum(r["count"] for r in folds) == 60
    assert sum(p.count() for p in hash_split(mapped, [0.5, 0.5])) == 60
