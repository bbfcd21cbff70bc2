"""Checks for the event-dump scan (S1): dumps rendered by Spark from ``events`` into the shared
checkpoint folder, then scanned back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.scalar import epoch_ms

from keelson.plans.registry import query
from keelson.session import ensure_checkpoint_dir, remove_at_exit
from keelson.sources.dumpformat import FORMAT, register_event_dump
from keelson.sources.eventdump import ACTION_SECTION, DAMAGE_SECTION, DEFAULT_ROOT, read_event_dump
from keelson.sources.sinks import write_csv, write_table
from keelson.sources.tables import csv, parquet, table


def render_dumps(events, path: str, rows_per_file: int = 20_000, hour_groups: int = 4, lines_joined: int = 1, amount: str = "hundredths") -> str:
    """Write dump files from events: clicks as action lists, views as damage entries (amount =
    value in hundredths), one spell table per user. A file holds the users of one hash group and
    the hours of one hour group, so a busy user is spread over several files and tasks, while all
    rows of one (user, ms) key stay in one file. The number of groups grows with the table.
    ``lines_joined`` entries of a list stand on one line with the openings and ends around them;
    ``amount="value"`` writes amounts as they are, in units with a fraction."""
    user_groups = max(4, -(-events.count() // (rows_per_file * hour_groups)))
    ev = events.select("event_id", "user_id", "event_type", "value",
                       epoch_ms(F.col("ts"), T.TimestampNTZType()).alias("ms"))
    ev = ev.withColumns({
        "fu": F.pmod(F.xxhash64("user_id"), F.lit(user_groups)),
        "fh": F.pmod(F.floor(F.col("ms") / 3_600_000).cast("bigint"), F.lit(hour_groups)),
    })
    spells = ev.select("fu", "fh", "user_id").distinct()
    files = spells.select("fu", "fh").distinct()
    u = F.col("user_id").cast("string")
    zero = F.lit(0).cast("bigint")

    hundredths = F.round(F.col("value") * 100).cast("bigint")
    written = (hundredths if amount == "hundredths" else hundredths.cast("decimal(18,2)") / 100).cast("string")

    def per_file(sec: int, major: int, text: str):
        return files.select("fu", "fh", F.lit(sec).alias("sec"), F.lit(major).alias("major"),
                            zero.alias("user"), F.lit(0).alias("part"), zero.alias("ms"), zero.alias("eid"),
                            F.lit(text).alias("value"))

    def per_spell(sec: int, part: int, text):
        return spells.select("fu", "fh", F.lit(sec).alias("sec"), F.lit(1).alias("major"),
                             F.col("user_id").alias("user"), F.lit(part).alias("part"), zero.alias("ms"),
                             zero.alias("eid"), text.alias("value"))

    def entries(kind: str, sec: int, text):
        return ev.where(F.col("event_type") == kind).select(
            "fu", "fh", F.lit(sec).alias("sec"), F.lit(1).alias("major"), F.col("user_id").alias("user"),
            F.lit(1).alias("part"), "ms", F.col("event_id").alias("eid"), text.alias("value"))

    lines = (per_file(0, 0, f"{DEFAULT_ROOT} = {{")
             .unionByName(per_file(1, 0, f'\t["{ACTION_SECTION}"] = {{'))
             .unionByName(per_spell(1, 0, F.concat(F.lit("\t\t["), u, F.lit("] = {"))))
             .unionByName(entries("click", 1, F.format_string("\t\t\t%d, -- [%d]", F.col("ms"), F.col("event_id"))))
             .unionByName(per_spell(1, 2, F.lit("\t\t},")))
             .unionByName(per_file(1, 2, "\t},"))
             .unionByName(per_file(2, 0, f'\t["{DAMAGE_SECTION}"] = {{'))
             .unionByName(per_spell(2, 0, F.concat(F.lit("\t\t["), u, F.lit("] = {"))))
             .unionByName(entries("view", 2, F.format_string("\t\t\t[%d] = %s,", F.col("ms"), written)))
             .unionByName(per_spell(2, 2, F.lit("\t\t},")))
             .unionByName(per_file(2, 2, "\t},"))
             .unionByName(per_file(3, 0, "}")))
    order = ["sec", "major", "user", "part", "ms", "eid"]
    if lines_joined > 1:  # without comments, which would take the rest of a line
        place = F.row_number().over(Window.partitionBy("fu", "fh").orderBy(*order))
        lines = (lines.withColumn("line", F.floor(place / lines_joined)).groupBy("fu", "fh", "line")
                 .agg(F.sort_array(F.collect_list(F.struct(*order, F.regexp_replace("value", " --.*", "").alias("value")))).alias("all"))
                 .select("fu", "fh", F.col("line").alias("sec"), *[F.lit(0).alias(c) for c in order[1:]],
                         F.array_join(F.transform("all", lambda x: x["value"]), " ").alias("value")))
    (lines.repartition("fu", "fh")
     .sortWithinPartitions("fu", "fh", *order)
     .select("fu", "fh", "value")
     .write.mode("overwrite").partitionBy("fu", "fh").text(path))
    return path


def _folder(spark, label: str) -> str:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/keelson-{label}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


_DUMP_SQL = """
SELECT 'action' AS kind, user_id AS spell_id, epoch_us(ts) // 1000 AS ts_ms, CAST(NULL AS BIGINT) AS amount
FROM events WHERE event_type = 'click'
UNION ALL
SELECT 'damage', user_id, epoch_us(ts) // 1000, arg_max(CAST(round(value * 100) AS BIGINT), event_id)
FROM events WHERE event_type = 'view' GROUP BY user_id, epoch_us(ts) // 1000
"""


def _flat(df):
    return df.select(
        F.when(F.col("action").isNotNull(), F.lit("action")).otherwise(F.lit("damage")).alias("kind"),
        F.coalesce(F.col("action.spellId"), F.col("damage.spellId")).alias("spell_id"),
        F.unix_millis("timestamp").alias("ts_ms"),
        F.col("damage.amount").alias("amount"))


@query("s1_event_dump_scan", _DUMP_SQL)
def s1_event_dump_scan(spark, sf):
    """Render every user's clicks and views as dump files, then scan all files back."""
    path = render_dumps(table(spark, sf, "events"), _folder(spark, "dumps"))
    return _flat(read_event_dump(spark, f"{path}/*/*/*.txt"))


@query("s1_format_in_sql", _DUMP_SQL)
def s1_format_in_sql(spark, sf):
    """The same dumps by the registered format, as a SQL view over ``USING``."""
    path = render_dumps(table(spark, sf, "events"), _folder(spark, "dumps"))
    register_event_dump(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW keelson_dump_rows USING {FORMAT} OPTIONS (path '{path}')")
    return spark.sql("""SELECT IF(action IS NOT NULL, 'action', 'damage') AS kind, coalesce(action.spellId, damage.spellId) AS spell_id,
                               unix_millis(timestamp) AS ts_ms, damage.amount AS amount FROM keelson_dump_rows""")


@query("s1_free_layout", _DUMP_SQL)
def s1_free_layout(spark, sf):
    """The same dumps with eight lines joined to one: several entries, openings and ends on a line."""
    path = render_dumps(table(spark, sf, "events"), _folder(spark, "dumps"), lines_joined=8)
    return _flat(read_event_dump(spark, f"{path}/*/*/*.txt"))


@query("s1b_mixed_amounts", """
WITH v AS (
  SELECT user_id, epoch_us(ts) // 1000 AS ms, arg_max(CAST(round(value * 100) AS BIGINT), event_id) AS c
  FROM events WHERE event_type = 'view' GROUP BY user_id, epoch_us(ts) // 1000)
SELECT user_id AS spell_id, ms AS ts_ms, CASE WHEN c % 100 = 0 THEN 'BIGINT' ELSE 'DOUBLE' END AS type, c / 100 AS amount FROM v
""")
def s1b_mixed_amounts(spark, sf):
    """Amounts with a fraction, as variants: a whole number is a bigint, another a double."""
    path = render_dumps(table(spark, sf, "events"), _folder(spark, "dumps"), amount="value")
    df = read_event_dump(spark, f"{path}/*/*/*.txt", numbers="variant").where("damage is not null")
    return df.select(F.col("damage.spellId").alias("spell_id"), F.unix_millis("timestamp").alias("ts_ms"),
                     F.expr("schema_of_variant(damage.amount)").alias("type"), F.expr("cast(damage.amount as double)").alias("amount"))


_CSV_SQL = """
SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS o_custkey, o_orderstatus, o_totalprice * 2 AS doubled
FROM orders
"""
_CSV_EXPRS = ["o_orderkey", "CASE WHEN o_custkey % 7 = 0 THEN 'NA' ELSE CAST(o_custkey AS STRING) END AS o_custkey",
              "o_orderstatus", "o_totalprice * 2 AS doubled"]


@query("s2_s5_s6_csv_round_trip", _CSV_SQL)
def s2_s5_s6_csv_round_trip(spark, sf):
    """Header CSV written after select expressions and read with a schema; NA is null."""
    path = write_csv(table(spark, sf, "orders"), _folder(spark, "csv"), _CSV_EXPRS)
    return csv(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, doubled double")


@query("s2a_csv_inferred", _CSV_SQL)
def s2a_csv_inferred(spark, sf):
    """The same file with inferred types (widened to the tables' own for the comparison)."""
    path = write_csv(table(spark, sf, "orders"), _folder(spark, "csv"), _CSV_EXPRS)
    df = csv(spark, path, infer=True)
    return df.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_custkey").cast("bigint").alias("o_custkey"),
                     "o_orderstatus", "doubled")


@query("s4_s6_table_round_trip", "SELECT vec_id, CAST(label AS BIGINT) AS label, len(embedding) AS n FROM embeddings")
def s4_s6_table_round_trip(spark, sf):
    """Vector columns become arrays on the way out; the file format stands in for a database."""
    from pyspark.ml.functions import array_to_vector

    df = table(spark, sf, "embeddings").withColumn("embedding", array_to_vector("embedding"))
    back = parquet(spark, write_table(df, _folder(spark, "table")))
    return back.select("vec_id", F.col("label").cast("bigint").alias("label"), F.size("embedding").cast("bigint").alias("n"))
