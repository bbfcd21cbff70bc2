"""Projections as plain ``select`` lists: no typed lambdas, so Catalyst prunes and pushes down
through all of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def project_named(df: DataFrame, exprs: Mapping[str, Column | str], before: Sequence = (),
                  after: Sequence = ()) -> DataFrame:
    """``before`` columns, then one column per ``name -> expression`` in declared order, then
    ``after`` (e.g. key first, label last). String expressions are SQL."""
    body = [(F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in exprs.items()]
    return df.select(*[_c(c) for c in before], *body, *[_c(c) for c in after])


def from_positions(df: DataFrame, fields: Sequence[tuple[str, int, Callable[[Column], Column]]]) -> DataFrame:
    """Build named fields from columns taken by position (``(name, position, fn)``), one
    ``select`` instead of a per-row lambda."""
    cols = df.columns
    return df.select(*[fn(F.col(cols[pos])).alias(name) for name, pos, fn in fields])


def with_run_metadata(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Constant run columns (metric, time stamp, placeholder label) in one projection."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def db_compatible(df: DataFrame) -> DataFrame:
    """Every ML vector column becomes ``array<double>``; other columns pass through; order kept."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, VectorUDT):
            out.append(vector_to_array(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def conform(scored: DataFrame, labeled_columns: Sequence[str], label_col: str,
            prediction_col: str) -> DataFrame:
    """Make scored, unlabeled rows look like the labeled table.

    The prediction becomes the label; only labeled-table columns that exist are kept, in the
    labeled table's order (names compared case-sensitively).
    """
    if prediction_col not in scored.columns:
        raise ValueError(f"prediction column {prediction_col!r} not in {scored.columns}")
    base = scored.drop(label_col) if label_col in scored.columns else scored
    available = set(base.columns) | {label_col}
    keep = [c for c in labeled_columns if c in available]
    renamed = base.withColumnRenamed(prediction_col, label_col)
    return renamed.select(*[F.col(c) for c in keep])


def flatten_optional(df: DataFrame, struct_col: str, fields: Sequence[str],
                     keep: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Keep rows whose optional struct is present and project ``keep`` plus its fields."""
    return (df.where(F.col(struct_col).isNotNull())
            .select(*[F.col(k) for k in keep], *[F.col(f"{struct_col}.{f}").alias(f) for f in fields]))


def pack_pair(pairs: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """``(left struct, right struct)`` pairs to ``(left, key, right)`` with the key lifted
    from the left struct by its dotted name (P14)."""
    return pairs.select(F.col(left), F.col(f"{left}.{key}").alias(key), F.col(right))


def whole_row(df: DataFrame, name: str = "row") -> DataFrame:
    """The whole row as one struct column."""
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias(name))


def fill_nulls_by_type(df: DataFrame, number=0, text: str = "") -> DataFrame:
    """Numeric nulls to ``number``, string nulls to ``text`` (label columns included)."""
    return df.fillna(number).fillna(text)


class ConstantColumn(Transformer, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Append one constant column (default ``extraField = 'hello, world!'``) as an ML stage.

    A literal instead of a zero-argument UDF, so Catalyst folds it.
    """

    value = Param(Params._dummy(), "value", "constant value of the new column",
                  typeConverter=TypeConverters.identity)

    # The reference's column name and message.
    DEFAULT_NAME = "extraField"
    DEFAULT_VALUE = "hello, world!"

    @keyword_only
    def __init__(self, *, outputCol: str = DEFAULT_NAME, value=DEFAULT_VALUE):
        super().__init__()
        self._setDefault(outputCol=self.DEFAULT_NAME, value=self.DEFAULT_VALUE)
        self._set(**self._input_kwargs)

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        name = self.getOutputCol()
        if name in schema.fieldNames():
            raise ValueError(f"column {name!r} already exists")
        dtype = T.StringType() if isinstance(self.getOrDefault(self.value), str) else T.DoubleType()
        return T.StructType(schema.fields + [T.StructField(name, dtype, True)])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self.transformSchema(dataset.schema)
        return dataset.withColumn(self.getOutputCol(), F.lit(self.getOrDefault(self.value)))
