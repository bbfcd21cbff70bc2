"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import curriculum, embeddings, fim, lines, order_minhash, packing, quality, rules, search, secrets, simhash, substring, warc
from keelson.llm.common import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (packing.pack(_table(spark, sf_dir, "documents"))
            .select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("length"),
                    F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"))


@query("op6_curriculum_mix", curriculum.plan_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (curriculum.plan(_table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken", "position"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (
  SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM d),
x AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM p WHERE i + 49 <= n),
y AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low FROM x) WHERE low < doc_id),
z AS (
  SELECT doc_id, w, i, max(y.i) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS last
  FROM p LEFT JOIN y USING (doc_id, i)),
k AS (
  SELECT doc_id, string_agg(w[i], ' ' ORDER BY i) AS kept, count(*) AS n
  FROM z WHERE last IS NULL OR i > last + 49 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""


@query("op10_substring_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (substring.remove_repeats(_table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    machine = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return (quality.score(docs, machine)
            .select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"))


@query("op7_embedding_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


@query("op3_line_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, removed="n_removed")


@query("op1_order_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_with_next(_table(spark, sf_dir, "documents"))


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


@query("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), "cut")


@query("op8_warc_derivatives", warc.derive_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(_table(spark, sf_dir, "pages")))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
h AS (
  SELECT doc_id, t, n, CAST('0x' || x[1:8] AS UBIGINT) AS h1, CAST('0x' || x[9:16] AS UBIGINT) AS h2,
         CAST('0x' || x[17:24] AS UBIGINT) AS h3, CAST('0x' || x[25:32] AS UBIGINT) AS h4 FROM d),
f AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT doc_id, t, n, form, a, b, substring(t, 1, CAST(a AS BIGINT)) AS x,
         substring(t, CAST(a AS BIGINT) + 1, CAST(b AS BIGINT) - CAST(a AS BIGINT)) AS y, substring(t, CAST(b AS BIGINT) + 1) AS z FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(b AS BIGINT) - CAST(a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
              ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


@query("op11_fill_in_middle", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
                      F.sha2("fim.output", 256).alias("output_sha256"),
                      F.sha2(fim.restore(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH tokens AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents
  UNION ALL
  SELECT 'i', item_id, row_number() OVER (), text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
w AS (
  SELECT kind, id, r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM tokens WHERE text IS NOT NULL),
tot AS (
  SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM w WHERE kind = 'd' AND len(terms) > 0),
tf AS (
  SELECT kind, id, r, len, t, count(*) AS tf FROM (SELECT kind, id, r, len(terms) AS len, unnest(terms) AS t FROM w) GROUP BY ALL),
df AS (
  SELECT t, count(*) AS df FROM tf WHERE kind = 'd' GROUP BY t),
s AS (
  SELECT i.id AS item_id, i.r, d.id AS doc_id, d.r AS dr,
         CAST(sum(i.tf * CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT)
                  * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (100 - 25 + (25 * d.len * n) // l)))) AS BIGINT) AS score
  FROM tf i JOIN tf d ON i.kind = 'i' AND d.kind = 'd' AND i.t = d.t JOIN df ON df.t = i.t CROSS JOIN tot
  GROUP BY ALL),
k AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, r ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20"""


@query("op12_dual_tree_search", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


@query("op13_quality_rules")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = rules.measure(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    measured = Scratch(spark, "op13").stage(measured.select("doc_id", "stats"))
    labelled = rules.label_rows(measured, _table(spark, sf_dir, "labels"), "quality")
    learned = rules.learn(labelled.where(~quality.held_out(F.col("doc_id"))))
    return (rules.judge(measured, learned)
            .select("doc_id", "stats.n_words", "stats.word_chars", "stats.n_symbols", "stats.n_dup_lines",
                    "stats.n_repeat_words", "stats.base_failed", "kept"))
