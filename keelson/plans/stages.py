"""F7, F8, F8a and the stage lists the reference composes into pipelines (L1).

These are MLlib's own stages; only the wiring lives here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.base import Params as PipelineStage  # stages share the Params base
from pyspark.ml.feature import HashingTF, RegexTokenizer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.scalar import vector_element

# The tokenizer pattern (whitespace or '|') and the hashed width of the text recipe.
TOKEN_PATTERN = r"[\s\|]+"
HASHED_WIDTH = 256


def tokenizer(col: str, out: str | None = None) -> RegexTokenizer:
    """lowercase, split on ``[\\s|]+``, drop empty tokens."""
    return RegexTokenizer(inputCol=col, outputCol=out or f"tokenized_{col}", pattern=TOKEN_PATTERN,
                          gaps=True, toLowercase=True, minTokenLength=1)


def hasher(col: str, num_features: int = HASHED_WIDTH) -> HashingTF:
    """F8: tokens hashed to a binary vector of ``num_features`` buckets."""
    return HashingTF(inputCol=f"tokenized_{col}", outputCol=f"tf_{col}", binary=True,
                     numFeatures=num_features)


def text_stages(cols: Sequence[str], num_features: int = HASHED_WIDTH) -> list[PipelineStage]:
    """Tokenizer and hasher for each text column."""
    stages: list[PipelineStage] = []
    for c in cols:
        stages += [tokenizer(c), hasher(c, num_features)]
    return stages


def tokenize_and_hash(df: DataFrame, cols: Sequence[str], num_features: int = HASHED_WIDTH) -> DataFrame:
    """F8a end to end: hashed vectors of every column assembled into ``<cols>_hashed``."""
    out = "_".join(cols) + "_hashed"
    stages = text_stages(cols, num_features) + [
        VectorAssembler(inputCols=[f"tf_{c}" for c in cols], outputCol=out)]
    return Pipeline(stages=stages).fit(df).transform(df)


def tokens(col) -> Column:
    """F7 as a built-in expression (codegen, no UDF): lowercase and split on ``[\\s|]+``. Empty
    strings (a leading delimiter) remain; drop them after exploding."""
    c = F.col(col) if isinstance(col, str) else col
    return F.split(F.lower(c), TOKEN_PATTERN)


def token_counts(df: DataFrame, col: str) -> DataFrame:
    """Token frequencies over whole texts, equal to the tokenizer stage's tokens. The count is
    partially aggregated on every task before the shuffle, so very frequent tokens do not gather
    raw rows in one place."""
    return (df.select(F.explode(tokens(col)).alias("token"))
            .where(F.length("token") > 0)
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))


class VectorElement(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """X2/P10 as a stage: element ``index`` of a vector column (e.g. the positive-class
    probability), JVM-side; the reference registered a Scala UDF for SQL instead."""

    index = Param(Params._dummy(), "index", "element to read", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "probability", outputCol: str = "prob", index: int = 1):
        super().__init__()
        self._setDefault(index=1)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(),
                                  vector_element(self.getInputCol(), self.getOrDefault(self.index)))
