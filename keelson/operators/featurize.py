"""Long-to-wide featurizing.

Features arrive either as an array of ``struct<name, value>`` on each row (the reference's form)
or as one row per feature. Both become one nullable double per chosen name, the first match
winning, an absent name giving null. For wide data the names are a table with an
index each, joined by name, and a row becomes a sparse vector. The array form is a pure expression (no UDF); the row form
is a ``groupBy().pivot()`` whose partial aggregation runs before the shuffle, so a key with a
third of all rows is pre-aggregated on every task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators.ordering import with_row_index
from keelson.session import side_path


def feature_struct(features: Column, names: Sequence[str]) -> Column:
    """Struct with one nullable double per name: the value of the first element whose name
    matches, null when none does. The array is walked once, into a map of first values."""
    named = F.filter(features, lambda f: f["name"].isNotNull())
    keys = F.transform(named, lambda f: f["name"])
    first = F.map_from_entries(F.transform(
        F.array_distinct(keys), lambda k: F.struct(k, F.element_at(named, F.array_position(keys, k).cast("int"))["value"].cast("double"))))
    return F.struct(*[F.element_at(first, F.lit(n)).alias(n) for n in names])


def features_long(df: DataFrame, key_cols: Sequence[str], features_col: str) -> DataFrame:
    """Row form of the array: one row per key and name with the first value, for any number of
    names; nothing is collected."""
    keys = [F.col(c) for c in key_cols]
    return (df.select(*keys, F.posexplode(features_col).alias("_pos", "_f")).where("_f.name is not null")
            .groupBy(*key_cols, F.col("_f.name").alias("name"))
            .agg(F.min_by(F.col("_f.value").cast("double"), F.col("_pos")).alias("value")))


def distinct_feature_names(df: DataFrame, features_col: str) -> DataFrame:
    """A5: the distinct feature names of an array column, sorted (a small, bounded result)."""
    return (df.select(F.explode(F.col(features_col)["name"]).alias("name"))
            .where(F.col("name").isNotNull()).distinct().orderBy("name"))


def collect_names(names_df: DataFrame, limit: int | None = None) -> list[str]:
    """The names, collected since they become columns; with ``limit`` given, more is an error."""
    rows = (names_df if limit is None else names_df.limit(limit + 1)).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"more than {limit} distinct feature names")
    return [r[0] for r in rows]


def pivot_features(df: DataFrame, key_cols: Sequence[str], name_col: str, value_col: str,
                   names: Sequence[str], order_col: str) -> DataFrame:
    """Row form: one output row per key, one column per name holding the value of the first
    row (by ``order_col``) with that name."""
    return (df.groupBy(*key_cols).pivot(name_col, list(names))
            .agg(F.min_by(F.col(value_col).cast("double"), F.col(order_col))))


class Featurizer(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """from ``array<struct<name, value>>`` to ``struct<name1 double, ...>``."""

    features = Param(Params._dummy(), "features", "feature names to select, in output order",
                     typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None,
                 features: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def getFeatures(self) -> list[str]:
        return self.getOrDefault(self.features)

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        fields = [T.StructField(n, T.DoubleType(), True) for n in self.getFeatures()]
        if self.getOutputCol() in schema.fieldNames():
            raise ValueError(f"column {self.getOutputCol()!r} already exists")
        return T.StructType(schema.fields + [T.StructField(self.getOutputCol(), T.StructType(fields), False)])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(),
                                  feature_struct(F.col(self.getInputCol()), self.getFeatures()))

    def field_names(self) -> list[str]:
        """Dotted names for a ``VectorAssembler`` over the output struct."""
        return [f"{self.getOutputCol()}.{n}" for n in self.getFeatures()]


class FeaturizerEstimator(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable,
                          DefaultParamsWritable):
    """learn the feature names from the data (sorted, so vector order is stable) and
    return a configured ``Featurizer``. Names become columns, so they are collected; ``maxNames``
    (0, the default: no bound) makes more than that many an error. For any number of names use
    ``SparseFeaturizerEstimator``; for known names make a ``Featurizer`` directly."""

    maxNames = Param(Params._dummy(), "maxNames", "most feature names to accept (0: any number)",
                     typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, maxNames: int = 0):
        super().__init__()
        self._setDefault(maxNames=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Featurizer:
        names = collect_names(distinct_feature_names(dataset, self.getInputCol()), self.getOrDefault(self.maxNames) or None)
        return Featurizer(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), features=names)


def name_index(df: DataFrame, features_col: str, order: str = "name") -> DataFrame:
    """``(name, index)``: the distinct names numbered from 0 in their order, as a table; nothing is collected."""
    names = df.select(F.explode(F.col(features_col)["name"]).alias("name")).where(F.col("name").isNotNull()).distinct()
    return with_row_index(names, [order], "index", tie_break=False).select("name", (F.col("index") - 1).cast("int").alias("index"))


def sparse_features(df: DataFrame, key_cols: Sequence[str], features_col: str, names: DataFrame) -> DataFrame:
    """``(keys..., indices, values)``: for every row of ``df`` the indices of its known names in ascending
    order and the first value of each; names without an index and null values are left out.

    ``key_cols`` identify a row. One row per feature is joined by name (a name that most rows hold is one row on
    the other side, so adaptive execution may split it) and gathered per key, a row's own features at most.
    """
    first = features_long(df, key_cols, features_col).where(F.col("value").isNotNull())
    found = (first.join(names, "name").groupBy(*key_cols)
             .agg(F.sort_array(F.collect_list(F.struct("index", "value"))).alias("_kl_f")))
    none = F.array().cast("array<struct<index:int,value:double>>")
    rows = df.select(*key_cols).join(found, list(key_cols), "left").withColumn("_kl_f", F.coalesce("_kl_f", none))
    return rows.select(*key_cols, F.col("_kl_f.index").alias("indices"), F.col("_kl_f.value").alias("values"))


class SparseFeaturizer(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """F9 for any number of names: ``outputCol`` is a sparse ML vector over the table of names at ``namesPath``.

    Rows are staged in the checkpoint folder as a vector's own fields and read back as vectors, so
    that no Python builds them.
    """

    namesPath = Param(Params._dummy(), "namesPath", "Parquet table (name, index)", typeConverter=TypeConverters.toString)
    size = Param(Params._dummy(), "size", "number of names", typeConverter=TypeConverters.toInt)
    keyCols = Param(Params._dummy(), "keyCols", "columns that identify a row", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, keyCols: list[str] | None = None,
                 namesPath: str | None = None, size: int | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def names(self, spark: SparkSession) -> DataFrame:
        """The learned table ``(name, index)``."""
        return spark.read.schema("name string, index int").parquet(self.getOrDefault(self.namesPath))

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        if self.getOutputCol() in schema.fieldNames():
            raise ValueError(f"column {self.getOutputCol()!r} already exists")
        return T.StructType(schema.fields + [T.StructField(self.getOutputCol(), VectorUDT())])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark, keys, out = dataset.sparkSession, self.getOrDefault(self.keyCols), self.getOutputCol()
        self.transformSchema(dataset.schema)
        found = sparse_features(dataset, keys, self.getInputCol(), self.names(spark))
        fields = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(self.getOrDefault(self.size)).alias("size"), "indices", "values")
        path = side_path(spark, "sparse")
        found.select(*keys, fields.alias(out)).write.parquet(path)
        schema = T.StructType([*[dataset.schema[k] for k in keys], T.StructField(out, VectorUDT())])
        return dataset.join(spark.read.schema(schema).parquet(path), list(keys))


class SparseFeaturizerEstimator(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """F10 for any number of names: learns their table, which is written to ``namesPath`` (by default
    into the checkpoint folder) and never reaches the driver; ``keyCols`` identify a row and are not null."""

    namesPath, keyCols = SparseFeaturizer.namesPath, SparseFeaturizer.keyCols

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, keyCols: list[str] | None = None,
                 namesPath: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> SparseFeaturizer:
        path = self.getOrDefault(self.namesPath) if self.isSet(self.namesPath) else side_path(dataset.sparkSession, "names")
        name_index(dataset, self.getInputCol()).write.mode("overwrite").parquet(path)
        size = dataset.sparkSession.read.schema("name string, index int").parquet(path).count()
        return SparseFeaturizer(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), keyCols=self.getOrDefault(self.keyCols),
                                namesPath=path, size=size)
