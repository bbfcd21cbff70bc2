"""Table readers. Thin on purpose: Spark's own readers do the work, so
Catalyst keeps column pruning, filter pushdown and split planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """S3: Parquet scan."""
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's test tables, ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixed value: the null token of the CSV inputs.
CSV_NULL = "NA"


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
        infer: bool = False, null_value: str = CSV_NULL, sep: str = ",", header: bool = True) -> DataFrame:
    """Header CSV with ``NA`` as null. Pass a schema for reproducible types; inference
    (an extra pass over the data) only when asked for."""
    reader = spark.read.option("header", header).option("sep", sep).option("nullValue", null_value)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Register a DataFrame as a temporary view for ``spark.sql``."""
    df.createOrReplaceTempView(name)
    return df


def from_rows(spark: SparkSession, rows, schema) -> DataFrame:
    """Local rows to a table (tests and fixtures only)."""
    return spark.createDataFrame(rows, schema)
