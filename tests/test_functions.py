"""P1, P2, P4, P5, P19, P20 and the vector helpers."""

import math

from pyspark.sql import functions as F

from keelson.functions.scalar import age_group, indicator, ms_bucket, parse_int, safe_double


def test_safe_double_and_age_group(spark):
    df = spark.createDataFrame([("1.5",), ("NA",), ("x",), (None,), ("63",), ("31",), ("30",), ("62",)], "s string")
    rows = df.select(safe_double("s").alias("d"), age_group(F.col("s").try_cast("double")).alias("g")).collect()
    assert [r.d for r in rows] == [1.5, 0.0, 0.0, 0.0, 63.0, 31.0, 30.0, 62.0]
    assert [r.g for r in rows] == [0.0, 0.0, 0.0, 0.0, 1.0, 2.0, 0.0, 2.0]


def test_parse_int(spark):
    vals = ["NA", "12.9", "-12.9", "1e3", "3000000000", "-3000000000", "NaN", "abc", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(parse_int("s")).collect()]
    assert got == [0, 12, -12, 1000, 2147483647, -2147483648, 0, None, None]


def test_indicator_and_ms_bucket(spark):
    df = spark.createDataFrame([(1, 1999), (2, -1999), (None, 0)], "sex int, ms bigint")
    rows = df.select(indicator("sex", 1).alias("m"), indicator("sex", 2).alias("f"),
                     ms_bucket("ms").alias("b")).collect()
    assert [(r.m, r.f, r.b) for r in rows] == [(1, 0, 1), (0, 1, -1), (0, 0, 0)]


def test_parse_int_strict_raises(spark):
    import pytest

    df = spark.createDataFrame([("12",), ("oops",)], "s string")
    with pytest.raises(Exception):
        df.select(parse_int("s", strict=True)).collect()
    assert [r[0] for r in df.select(parse_int("s")).collect()] == [12, None]
