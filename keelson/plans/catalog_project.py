"""Checks for scans, projections, filters, scalar functions, sorts, limits and set operations
(S3, S7, P1-P12, P14-P20, O1-O3, U1, U2)."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.scalar import (abs_error, age_group, bin_case, epoch_ms, epoch_ms_to_timestamp,
                                      indicator, ms_bucket, parse_int, safe_double, vector_element)
from keelson.operators.metrics import best_or_worst
from keelson.operators.project import (ConstantColumn, conform, db_compatible, fill_nulls_by_type,
                                       flatten_optional, from_positions, project_named, whole_row,
                                       with_run_metadata)
from keelson.plans.registry import query
from keelson.sources.tables import register_view, table

NTZ = T.TimestampNTZType()


def _raw_values(spark, sf):
    """``events.value`` as text, with every 7th row ``NA`` and every 11th ``x`` (by event_id)."""
    ev = table(spark, sf, "events")
    raw = (F.when(F.col("event_id") % 7 == 0, F.lit("NA"))
           .when(F.col("event_id") % 11 == 0, F.lit("x"))
           .otherwise(F.col("value").cast("string")))
    return ev.select("event_id", raw.alias("raw"),
                     (F.col("value") * F.lit(10_000_000.0)).cast("string").alias("raw_big"))


_RAW_SQL = """
WITH t AS (
  SELECT event_id,
         CASE WHEN event_id % 7 = 0 THEN 'NA' WHEN event_id % 11 = 0 THEN 'x'
              ELSE CAST(value AS VARCHAR) END AS raw,
         value * 10000000.0 AS big
  FROM events)
"""


@query("p1_safe_double", _RAW_SQL + """
SELECT event_id, COALESCE(TRY_CAST(raw AS DOUBLE), 0.0) AS value_d FROM t
""")
def p1_safe_double(spark, sf):
    return _raw_values(spark, sf).select("event_id", safe_double("raw").alias("value_d"))


@query("p4_parse_int", _RAW_SQL + """
SELECT event_id,
       CASE WHEN raw = 'NA' THEN 0 ELSE CAST(trunc(TRY_CAST(raw AS DOUBLE)) AS INTEGER) END AS value_i,
       CAST(GREATEST(LEAST(trunc(big), 2147483647), -2147483648) AS INTEGER) AS big_i
FROM t
""")
def p4_parse_int(spark, sf):
    """NA -> 0, text -> double -> int toward zero; values past the int range saturate."""
    raw = _raw_values(spark, sf)
    return raw.select("event_id", parse_int("raw").alias("value_i"), parse_int("raw_big").alias("big_i"))


@query("p2_p5_bins_and_flags", """
SELECT c_custkey,
       CAST(CASE WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal > 0 THEN 2 ELSE 0 END AS DOUBLE) AS acct_group,
       CAST(CASE WHEN c_acctbal / 100 > 62 THEN 1 WHEN c_acctbal / 100 > 30 THEN 2 ELSE 0 END AS DOUBLE) AS age_group,
       CAST(COALESCE(c_mktsegment = 'BUILDING', false) AS INTEGER) AS is_building,
       CAST(COALESCE(c_mktsegment = 'MACHINERY', false) AS INTEGER) AS is_machinery
FROM customer
""")
def p2_p5_bins_and_flags(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey",
        bin_case("c_acctbal", [(">", 5000, 1), (">", 0, 2)], default=0).alias("acct_group"),
        age_group(F.col("c_acctbal") / 100).alias("age_group"),
        indicator("c_mktsegment", "BUILDING").alias("is_building"),
        indicator("c_mktsegment", "MACHINERY").alias("is_machinery"),
    )


@query("p3_named_projection", """
SELECT c_custkey,
       COALESCE(TRY_CAST(c_acctbal AS DOUBLE), 0.0) AS acctbal,
       COALESCE(TRY_CAST(c_nationkey AS DOUBLE), 0.0) AS nation,
       CAST(CASE WHEN c_acctbal / 100 > 62 THEN 1 WHEN c_acctbal / 100 > 30 THEN 2 ELSE 0 END AS DOUBLE) AS age_group,
       c_mktsegment AS label
FROM customer
""")
def p3_named_projection(spark, sf):
    """Key, then a name -> expression map in declared order, then the label."""
    exprs = {
        "acctbal": safe_double("c_acctbal"),
        "nation": safe_double("c_nationkey"),
        "age_group": age_group(F.col("c_acctbal") / 100),
    }
    return project_named(table(spark, sf, "customer"), exprs, before=["c_custkey"],
                         after=[F.col("c_mktsegment").alias("label")])


@query("p6_positional_record", """
SELECT CASE WHEN CAST(c_custkey AS VARCHAR) = 'NA' THEN 0 ELSE CAST(trunc(TRY_CAST(CAST(c_custkey AS VARCHAR) AS DOUBLE)) AS INTEGER) END AS customer_id,
       CASE WHEN CAST(c_nationkey AS VARCHAR) = 'NA' THEN 0 ELSE CAST(trunc(TRY_CAST(CAST(c_nationkey AS VARCHAR) AS DOUBLE)) AS INTEGER) END AS nation,
       CAST(GREATEST(LEAST(trunc(c_acctbal), 2147483647), -2147483648) AS INTEGER) AS balance,
       CAST(COALESCE(c_mktsegment = 'BUILDING', false) AS INTEGER) AS building,
       CAST(COALESCE(c_mktsegment = 'HOUSEHOLD', false) AS INTEGER) AS household,
       c_mktsegment AS segment_raw
FROM customer
""")
def p6_positional_record(spark, sf):
    """Fields taken by position (0 key, 2 nation, 3 balance, 4 segment), one select."""
    c = table(spark, sf, "customer")
    return from_positions(c, [
        ("customer_id", 0, parse_int),
        ("nation", 2, parse_int),
        ("balance", 3, parse_int),
        ("building", 4, lambda x: indicator(x, "BUILDING")),
        ("household", 4, lambda x: indicator(x, "HOUSEHOLD")),
        ("segment_raw", 4, lambda x: x.cast("string")),
    ])


@query("p7_constant_column", """
SELECT p_partkey, 'hello, world!' AS extraField FROM part
""")
def p7_constant_column(spark, sf):
    part = table(spark, sf, "part").select("p_partkey")
    return ConstantColumn().transform(part)


@query("p8_run_metadata", """
SELECT doc_id, CAST(0.25 AS DOUBLE) AS log_loss, CAST(1700000000000 AS BIGINT) AS tstamp, CAST(0.0 AS DOUBLE) AS label FROM labels
""")
def p8_run_metadata(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id")
    return with_run_metadata(labels, {"log_loss": 0.25, "tstamp": 1_700_000_000_000, "label": 0.0})


@query("p9_p10_vectors", """
SELECT vec_id,
       CAST(embedding[1] AS DOUBLE) AS e0,
       CAST(embedding[2] AS DOUBLE) AS e1,
       CAST(len(embedding) AS INTEGER) AS dim,
       CAST(NULL AS DOUBLE) AS past_end,
       label
FROM embeddings
""")
def p9_p10_vectors(spark, sf):
    """Array -> ML vector; element 1 and a past-the-end element read off the vector (null, not an
    error); then every vector column back to an array for a database."""
    emb = table(spark, sf, "embeddings")
    vec = emb.select("vec_id", array_to_vector("embedding").alias("features"), "label")
    scored = vec.withColumns({"e1": vector_element("features", 1),
                              "past_end": vector_element("features", 64)})
    flat = db_compatible(scored)
    return flat.select("vec_id", F.get(F.col("features"), 0).alias("e0"), "e1",
                       F.size("features").alias("dim"), "past_end", "label")


@query("p11_conform_schema", """
SELECT d.doc_id, d.lang, d.n_chars, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS quality
FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id
""")
def p11_conform_schema(spark, sf):
    """Score unlabeled documents with a rule model and conform them to the labeled table."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    labeled = docs.join(labels, "doc_id")
    unlabeled = docs.join(labels, "doc_id", "left_anti")
    model = SQLTransformer(statement="SELECT *, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS prediction "
                                     "FROM __THIS__")
    scored = model.transform(unlabeled.withColumn("quality", F.lit(0.0)))
    return conform(scored, labeled.columns, "quality", "prediction")


@query("p12_p14_flatten_optional", """
SELECT epoch_us(ts) // 1000 AS ts_ms, user_id AS spellId FROM events WHERE event_type = 'click'
""")
def p12_p14_flatten_optional(spark, sf):
    """Events shaped as the dump's rows (timestamp, optional action, optional damage), then the
    action rows flattened to (timestamp, spellId) through dotted names."""
    ev = table(spark, sf, "events")
    rows = whole_row(ev, "r")
    dump = rows.select(
        F.col("r.ts").alias("timestamp"),
        F.when(F.col("r.event_type") == "click", F.struct(F.col("r.user_id").alias("spellId"))).alias("action"),
        F.when(F.col("r.event_type") == "view",
               F.struct(F.col("r.user_id").alias("spellId"),
                        (F.col("r.value") * 100).cast("bigint").alias("amount"))).alias("damage"),
    )
    flat = flatten_optional(dump, "action", ["spellId"], keep=["timestamp"])
    return flat.select(epoch_ms(F.col("timestamp"), NTZ).alias("ts_ms"), "spellId")


@query("p15_filter_predicate", """
SELECT doc_id, quality FROM labels WHERE quality = toxic
""")
def p15_filter_predicate(spark, sf):
    return table(spark, sf, "labels").filter("quality = toxic").select("doc_id", "quality")


@query("p16_sql_stage", """
SELECT doc_id, round(CAST(n_chars AS DOUBLE) / 1000, 3) AS kchars FROM documents
""")
def p16_sql_stage(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    st = SQLTransformer(statement="SELECT doc_id, round(CAST(n_chars AS DOUBLE) / 1000, 3) AS kchars "
                                  "FROM __THIS__")
    return st.transform(docs)


_SCORED_SQL = """
WITH s AS (
  SELECT d.doc_id, CAST(l.quality AS DOUBLE) AS label,
         LEAST(CAST(d.n_chars AS DOUBLE) / 5000, 1.0) AS p
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


def _scored(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("label"),
        F.least(F.col("n_chars").cast("double") / 5000, F.lit(1.0)).alias("p"))


@query("p17_abs_error", _SCORED_SQL + "SELECT doc_id, round(abs(p - label), 6) AS abs_err FROM s")
def p17_abs_error(spark, sf):
    return _scored(spark, sf).select("doc_id", F.round(abs_error("p", "label"), 6).alias("abs_err"))


@query("p18_fill_nulls", """
SELECT d.doc_id, COALESCE(l.quality, 0) AS quality, COALESCE(l.toxic, 0) AS toxic,
       COALESCE(CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, '') AS grade
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def p18_fill_nulls(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    labels = table(spark, sf, "labels").select(
        "doc_id", "quality", "toxic",
        F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("grade"))
    return fill_nulls_by_type(docs.join(labels, "doc_id", "left"))


@query("p19_p20_time_keys", """
SELECT event_id,
       epoch_us(ts) // 1000 AS ts_ms,
       (epoch_us(ts) // 1000) // 1000 AS second_bucket,
       (epoch_us(ts) // 1000) // 86400000 AS day_bucket
FROM events
""")
def p19_p20_time_keys(spark, sf):
    """Timestamp -> epoch ms -> timestamp -> epoch ms round trip, then second and day buckets."""
    ev = table(spark, sf, "events")
    ms = epoch_ms(F.col("ts"), NTZ)
    back = F.unix_millis(epoch_ms_to_timestamp(ms))
    return ev.select("event_id", back.alias("ts_ms"), ms_bucket(back, 1000).alias("second_bucket"),
                     ms_bucket(back, 86_400_000).alias("day_bucket"))


@query("s3_parquet_scan", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45
""")
def s3_parquet_scan(spark, sf):
    """Parquet scan with a pushed filter and a pruned read schema."""
    li = table(spark, sf, "lineitem")
    return li.where(F.col("l_quantity") > 45).select("l_orderkey", "l_linenumber", "l_quantity")


@query("s7_sql_view", """
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type
""")
def s7_sql_view(spark, sf):
    register_view(table(spark, sf, "events"), "keelson_events")
    return spark.sql("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total "
                     "FROM keelson_events GROUP BY event_type")


@query("o1_best_by_abs_error", _SCORED_SQL + """
SELECT doc_id, round(abs(p - label), 6) AS abs_err FROM s ORDER BY abs(p - label), doc_id LIMIT 20
""")
def o1_best_by_abs_error(spark, sf):
    """The 20 held-out rows with the smallest absolute error (top-k, no full sort)."""
    s = _scored(spark, sf).withColumn("_err", abs_error("p", "label"))
    top = best_or_worst(s, 20, "_err", tiebreak="doc_id")
    return top.select("doc_id", F.round("_err", 6).alias("abs_err"))


@query("o2_sql_limit", """
SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 10
""")
def o2_sql_limit(spark, sf):
    register_view(table(spark, sf, "events"), "keelson_events_o2")
    return spark.sql("SELECT event_id, event_type FROM keelson_events_o2 ORDER BY ts, event_id LIMIT 10")


@query("o3_preview", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5
""")
def o3_preview(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)


@query("u1_union_by_name", """
SELECT d.doc_id, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id
UNION ALL
SELECT d.doc_id, d.lang FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id
""")
def u1_union_by_name(spark, sf):
    """Labeled rows without the label, then unlabeled rows, matched by name."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    labeled = docs.join(labels, "doc_id").drop("quality")
    unlabeled = docs.join(labels, "doc_id", "left_anti").select("lang", "doc_id")
    return labeled.unionByName(unlabeled)


@query("u2_distinct", """
SELECT DISTINCT user_id, event_type FROM events
""")
def u2_distinct(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type").distinct()
