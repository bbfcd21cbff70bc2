"""Checks for the feature-preparation stages F1-F10 and A5."""

from __future__ import annotations

from pyspark.ml.feature import (IndexToString, OneHotEncoder, StringIndexer,
                                VectorAssembler, VectorIndexer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from keelson.operators.featurize import SparseFeaturizerEstimator, sparse_features
from keelson.operators.featurize import (FeaturizerEstimator, collect_names, distinct_feature_names,
                                         pivot_features)
from keelson.plans.registry import query
from keelson.plans.stages import TOKEN_PATTERN, token_counts, tokenize_and_hash
from keelson.sources.tables import table

_TYPE_RANK_SQL = """
WITH r AS (
  SELECT event_type, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS DOUBLE) AS idx
  FROM events GROUP BY event_type)
"""


def _indexed_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    model = StringIndexer(inputCol="event_type", outputCol="event_type_idx",
                          stringOrderType="frequencyDesc").fit(ev)
    return model, model.transform(ev)


@query("f1_string_indexer", _TYPE_RANK_SQL + """
SELECT e.event_id, r.idx AS event_type_idx FROM events e JOIN r USING (event_type)
""")
def f1_string_indexer(spark, sf):
    """Event types indexed by falling frequency (ties alphabetical), fitted on the whole table."""
    _, out = _indexed_events(spark, sf)
    return out.select("event_id", "event_type_idx")


@query("f1a_indexer_skip_unseen", """
WITH r AS (
  SELECT event_type, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS DOUBLE) AS idx
  FROM events WHERE event_type <> 'error' GROUP BY event_type)
SELECT e.event_id, r.idx AS event_type_idx FROM events e JOIN r USING (event_type)
""")
def f1a_indexer_skip_unseen(spark, sf):
    """Fitted without one type; rows of the unseen type are skipped (``handleInvalid='skip'``)."""
    ev = table(spark, sf, "events").select("event_id", "event_type")
    model = StringIndexer(inputCol="event_type", outputCol="event_type_idx", handleInvalid="skip") \
        .fit(ev.where(F.col("event_type") != "error"))
    return model.transform(ev).select("event_id", "event_type_idx")


@query("f1b_indexer_on_union", """
WITH r AS (
  SELECT source, CAST(row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS DOUBLE) AS idx
  FROM documents GROUP BY source)
SELECT d.doc_id, r.idx AS source_idx
FROM documents d JOIN r USING (source) ANTI JOIN labels l ON d.doc_id = l.doc_id
""")
def f1b_indexer_on_union(spark, sf):
    """Fitted on labeled UNION unlabeled rows, so the unlabeled side has no unseen values."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    labeled = docs.join(labels, "doc_id")
    unlabeled = docs.join(labels, "doc_id", "left_anti")
    model = StringIndexer(inputCol="source", outputCol="source_idx").fit(
        labeled.drop("quality").unionByName(unlabeled))
    return model.transform(unlabeled).select("doc_id", "source_idx")


@query("f2_index_to_string", """
SELECT event_id, event_type AS label_back FROM events
""")
def f2_index_to_string(spark, sf):
    model, out = _indexed_events(spark, sf)
    back = IndexToString(inputCol="event_type_idx", outputCol="label_back", labels=model.labels)
    return back.transform(out).select("event_id", "label_back")


@query("f3_one_hot", _TYPE_RANK_SQL + """
SELECT e.event_id,
       CAST(CASE WHEN r.idx = 0 THEN 1 ELSE 0 END AS DOUBLE) AS oh0,
       CAST(CASE WHEN r.idx = 1 THEN 1 ELSE 0 END AS DOUBLE) AS oh1,
       CAST(CASE WHEN r.idx = 2 THEN 1 ELSE 0 END AS DOUBLE) AS oh2,
       CAST(CASE WHEN r.idx = 3 THEN 1 ELSE 0 END AS DOUBLE) AS oh3,
       CAST(4 AS INTEGER) AS width
FROM events e JOIN r USING (event_type)
""")
def f3_one_hot(spark, sf):
    """One-hot of the type index with the last category dropped (5 types -> width 4)."""
    _, out = _indexed_events(spark, sf)
    enc = OneHotEncoder(inputCol="event_type_idx", outputCol="oh", dropLast=True).fit(out)
    arr = vector_to_array(F.col("oh"))
    return enc.transform(out).select("event_id", *[arr[i].alias(f"oh{i}") for i in range(4)],
                                     F.size(arr).alias("width"))


@query("f4_vector_assembler", """
SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS x0, c_acctbal AS x1,
       CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS DOUBLE) AS x2
FROM customer
""")
def f4_vector_assembler(spark, sf):
    """Numbers assembled to a vector (a nested struct field included), read back element-wise."""
    c = table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal",
        F.struct(F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0).alias("flag")).alias("seg"))
    va = VectorAssembler(inputCols=["c_nationkey", "c_acctbal", "seg.flag"], outputCol="features")
    arr = vector_to_array(F.col("features"))
    return va.transform(c).select("c_custkey", *[arr[i].alias(f"x{i}") for i in range(3)])


@query("f5_vector_indexer", """
WITH f AS (
  SELECT l_orderkey, l_linenumber,
         CAST(l_linenumber AS DOUBLE) AS f0,
         CASE l_returnflag WHEN 'A' THEN 7.0 WHEN 'N' THEN 3.0 ELSE 5.0 END AS f1,
         CASE l_linestatus WHEN 'F' THEN 0.0 ELSE -1.0 END AS f2
  FROM lineitem),
c1 AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS i FROM (SELECT DISTINCT f1 AS v FROM f)),
c2 AS (SELECT v, CAST(row_number() OVER (ORDER BY v <> 0.0, v) - 1 AS DOUBLE) AS i FROM (SELECT DISTINCT f2 AS v FROM f))
SELECT f.l_orderkey, f.l_linenumber, f.f0 AS i0, c1.i AS i1, c2.i AS i2
FROM f JOIN c1 ON f.f1 = c1.v JOIN c2 ON f.f2 = c2.v
""")
def f5_vector_indexer(spark, sf):
    """maxCategories=4: 7 line numbers stay continuous; the 3- and 2-valued features become
    categories, sorted, with 0.0 keeping index 0."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.col("l_linenumber").cast("double").alias("f0"),
        F.when(F.col("l_returnflag") == "A", 7.0).when(F.col("l_returnflag") == "N", 3.0).otherwise(5.0).alias("f1"),
        F.when(F.col("l_linestatus") == "F", 0.0).otherwise(-1.0).alias("f2"))
    vec = VectorAssembler(inputCols=["f0", "f1", "f2"], outputCol="features").transform(li)
    model = VectorIndexer(inputCol="features", outputCol="indexed", maxCategories=4).fit(vec)
    arr = vector_to_array(F.col("indexed"))
    return model.transform(vec).select("l_orderkey", "l_linenumber", *[arr[i].alias(f"i{i}") for i in range(3)])


@query("f6_chi_square", """
WITH t AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS o FROM lineitem GROUP BY ALL),
s AS (SELECT o, sum(o) OVER () AS n,
             sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e
      FROM t)
SELECT round(sum((o - e) * (o - e) / e) + max(n) - sum(e), 6) AS statistic,
       CAST(((SELECT count(DISTINCT l_returnflag) FROM lineitem) - 1)
            * ((SELECT count(DISTINCT l_linestatus) FROM lineitem) - 1) AS INTEGER) AS dof
FROM s
""")
def f6_chi_square(spark, sf):
    """Pearson chi-square of return flag against line status (the selector's statistic)."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    li = StringIndexer(inputCol="l_returnflag", outputCol="rf").fit(li).transform(li)
    li = StringIndexer(inputCol="l_linestatus", outputCol="ls").fit(li).transform(li)
    vec = VectorAssembler(inputCols=["rf"], outputCol="features").transform(li)
    res = ChiSquareTest.test(vec, "features", "ls")
    return res.select(F.round(vector_to_array("statistics")[0], 6).alias("statistic"),
                      F.col("degreesOfFreedom")[0].alias("dof"))


@query("f7_token_counts", f"""
SELECT token, count(*) AS n
FROM (SELECT unnest(regexp_split_to_array(lower(text), '{TOKEN_PATTERN}')) AS token FROM documents)
WHERE token <> ''
GROUP BY token
""")
def f7_token_counts(spark, sf):
    """Lowercased tokens split on whitespace or '|', counted over every document's whole text."""
    return token_counts(table(spark, sf, "documents"), "text")


@query("f8_hashing_tf")
def f8_hashing_tf(spark, sf):
    """Tokens of two text columns hashed to binary 256-wide vectors and assembled (rows only:
    bucket numbers are Spark's murmur3)."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    out = tokenize_and_hash(docs, ["text", "lang"], num_features=256)
    return out.select("doc_id", F.size(F.filter(vector_to_array("text_lang_hashed"), lambda x: x != 0)).alias("nnz"))


_FEATURE_ROWS_SQL = """
SELECT user_id,
       arg_min(value, event_id) FILTER (WHERE event_type = 'click') AS click,
       arg_min(value, event_id) FILTER (WHERE event_type = 'error') AS error,
       arg_min(value, event_id) FILTER (WHERE event_type = 'purchase') AS purchase,
       arg_min(value, event_id) FILTER (WHERE event_type = 'signup') AS signup,
       arg_min(value, event_id) FILTER (WHERE event_type = 'view') AS view
FROM events GROUP BY user_id
"""


@query("f9_f10_featurize_rows", _FEATURE_ROWS_SQL)
def f9_f10_featurize_rows(spark, sf):
    """Feature names learned from the data (sorted), then one column per name holding the value
    of the user's first event of that type."""
    ev = table(spark, sf, "events")
    names = collect_names(ev.select(F.col("event_type").alias("name")).distinct().orderBy("name"))
    return pivot_features(ev, ["user_id"], "event_type", "value", names, "event_id")


def _feature_arrays(spark, sf):
    ev = table(spark, sf, "events")
    feats = F.array(
        F.struct(F.col("event_type").alias("name"), F.col("value").alias("value")),
        F.struct(F.lit("props_k").alias("name"),
                 F.get_json_object("props", "$.k").try_cast("double").alias("value")),
        F.struct(F.col("event_type").alias("name"), F.lit(-1.0).alias("value")),
    )
    return ev.select("event_id", feats.alias("features"))


@query("f9_f10_featurize_arrays", """
SELECT event_id,
       CASE WHEN event_type = 'click' THEN value END AS click,
       CASE WHEN event_type = 'error' THEN value END AS error,
       TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS props_k,
       CASE WHEN event_type = 'purchase' THEN value END AS purchase,
       CASE WHEN event_type = 'signup' THEN value END AS signup,
       CASE WHEN event_type = 'view' THEN value END AS view
FROM events
""")
def f9_f10_featurize_arrays(spark, sf):
    """Per-row (name, value) arrays (a repeated name: the first wins) to a struct of doubles."""
    arrays = _feature_arrays(spark, sf)
    model = FeaturizerEstimator(inputCol="features", outputCol="fs").fit(arrays)
    return model.transform(arrays).select("event_id", *[F.col(f"fs.{n}").alias(n) for n in model.getFeatures()])


@query("f9_f10_sparse_rows", """
WITH f AS (
  SELECT event_id, 0 AS pos, 'user ' || user_id AS name, value FROM events UNION ALL
  SELECT event_id, 1, 'event ' || event_id, value + 1 FROM events WHERE event_id % 3 = 0 UNION ALL
  SELECT event_id, 2, event_type, CASE WHEN event_id % 5 > 0 THEN value + 2 END FROM events UNION ALL
  SELECT event_id, 3, 'user ' || user_id, -1 FROM events),
n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS index FROM (SELECT DISTINCT name FROM f)),
g AS (SELECT event_id, name, value FROM f QUALIFY row_number() OVER (PARTITION BY event_id, name ORDER BY pos) = 1)
SELECT event_id, CAST(index AS INTEGER) AS index, value FROM g JOIN n USING (name) WHERE value IS NOT NULL
""")
def f9_f10_sparse_rows(spark, sf):
    """Names in the thousands, learned as a table; each row's sparse vector as (row, index, value)."""
    ev = table(spark, sf, "events")
    name = lambda text, value: F.struct(text.alias("name"), value.cast("double").alias("value"))
    user = F.concat(F.lit("user "), "user_id")
    feats = F.array(name(user, F.col("value")),
                    name(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("event "), "event_id")), F.col("value") + 1),
                    name(F.col("event_type"), F.when(F.col("event_id") % 5 > 0, F.col("value") + 2)), name(user, F.lit(-1)))
    arrays = ev.select("event_id", feats.alias("features"))
    model = SparseFeaturizerEstimator(inputCol="features", outputCol="v", keyCols=["event_id"]).fit(arrays)
    found = sparse_features(arrays, ["event_id"], "features", model.names(spark))
    return found.select("event_id", F.inline(F.arrays_zip("indices", "values"))).select("event_id", F.col("indices").alias("index"), F.col("values").alias("value"))


@query("a5_distinct_feature_names", """
SELECT DISTINCT event_type AS name FROM events UNION SELECT 'props_k'
""")
def a5_distinct_feature_names(spark, sf):
    return distinct_feature_names(_feature_arrays(spark, sf), "features")


@query("f6_chi_square_selector", """
WITH f AS (
  SELECT l_returnflag AS y, 'l_linestatus' AS name, l_linestatus AS x FROM lineitem UNION ALL
  SELECT l_returnflag, 'line', CAST(l_linenumber AS VARCHAR) FROM lineitem UNION ALL
  SELECT l_returnflag, 'part', CAST(l_partkey % 5 AS VARCHAR) FROM lineitem),
o AS (SELECT name, x, y, CAST(count(*) AS DOUBLE) AS o FROM f GROUP BY ALL),
e AS (SELECT name, o, sum(o) OVER (PARTITION BY name, x) * sum(o) OVER (PARTITION BY name, y) / sum(o) OVER (PARTITION BY name) AS e,
             count(*) OVER (PARTITION BY name) AS cells FROM o),
s AS (SELECT name, sum(o * o / e) - sum(o) AS statistic FROM e GROUP BY name)
SELECT name FROM s ORDER BY statistic DESC LIMIT 1
""")
def f6_chi_square_selector(spark, sf):
    """Chi-square selection over categorical columns: the one that depends most on the label."""
    from pyspark.ml.feature import UnivariateFeatureSelector

    li = table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string").alias("line"),
        (F.col("l_partkey") % 5).cast("string").alias("part"))
    names = ["l_linestatus", "line", "part"]
    li = StringIndexer(inputCols=["l_returnflag", *names], outputCols=["label", *[f"{n}_i" for n in names]]).fit(li).transform(li)
    vec = VectorAssembler(inputCols=[f"{n}_i" for n in names], outputCol="features").transform(li)
    selector = UnivariateFeatureSelector(featuresCol="features", labelCol="label", outputCol="selected", selectionMode="numTopFeatures")
    model = selector.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(1).fit(vec)
    # the chosen positions are a driver-side property of the fitted stage
    return spark.createDataFrame([(names[i],) for i in model.selectedFeatures], "name string")
