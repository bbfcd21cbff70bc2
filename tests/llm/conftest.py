import pytest
from llm_corpus import EXTRA, prose
from pyspark.sql import types as T

@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) tuples, with further columns of clashing names."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in EXTRA]])

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None, *["x"] * len(EXTRA))
                for r in rows]
        return spark.createDataFrame(full, schema).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, one-word, repeated and very long texts, null and repeated ids, ties."""
    long = prose(1, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, prose(2, 120)), (6, prose(2, 120)), (6, prose(2, 120)),
            (6, prose(3, 90)), (None, prose(2, 120)), (None, None), (7, long), (8, long + " end"), (9, "é — \x85  ŝ 𝄞 x")]
