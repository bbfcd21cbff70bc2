"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources weigh by rank and share a multiple of all words; a source stops at ``limit`` times
its own words and the excess goes to the others by weight (water filling, in closed form over one
row per source).

Positions: each source has a weight schedule over training time 0 to 1, piecewise linear. Its
integral is the source's cumulative demand; a document whose place in its source's word stream is
``c`` gets the time at which demand reaches ``c``, the integral's inverse. Sorting by that time gives
the training order, in which the mixture follows the schedules. Every occurrence is laid out so: a
document's second pass has a time of its own, and its offset is the words of the stream before it.

A source's stream orders documents by a hash of their id. Its running word count comes from two
steps, so that a hot source is no hot key: words per (source, hash range), summed over ranges, and
a window within one range, which holds about ``ROWS_PER_RANGE`` rows at any size of the corpus. Offsets
come alike, from sums over the ranges of the sort by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import WORD, Scratch, row_key, shuffle_partitions, whole_rows

WEIGHTS, SHARE, LIMIT = (3, 1, 2), 1.5, 2
#: (time, weight) knots of the schedules, repeated over the ranked sources as the weights are:
#: one falls, one stays, one is held back until the second half.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)))
ROWS_PER_RANGE = 10_000


def time_sql(share: str, knots) -> str:
    """SQL for the time at which a schedule's integral reaches ``share`` (0 to 1) of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, before, cases = sum(areas), 0.0, []
    for (a, b), area in zip(zip(knots, knots[1:]), areas):
        slope = (b[1] - a[1]) / (b[0] - a[0])
        rest = f"({share} * {whole!r}D - {before!r}D)"
        root = f"sqrt(greatest(0D, {a[1] * a[1]!r}D + {2 * slope!r}D * {rest}))"
        then = f"{a[0]!r}D + 2D * {rest} / ({a[1]!r}D + {root})"
        before += area
        cases.append(f"WHEN {share} * {whole!r}D <= {before!r}D THEN {then}" if b is not knots[-1] else f"ELSE {then}")
    if len(cases) == 1:
        return f"({cases[0].removeprefix('ELSE ')})"
    return f"(CASE {' '.join(cases)} END)"


def _schedule_sql(share: str, rank: str, schedules) -> str:
    whens = " ".join(f"WHEN {i} THEN {time_sql(share, k)}" for i, k in enumerate(schedules))
    return f"(CASE {rank} % {len(schedules)} {whens} END)"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """``(source, source_size, rank, target)`` from one row per source ``(source, source_size)``."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(x).cast("double") for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(limit))
    rows = ranked.withColumns({"w": w, "cap": cap}).withColumn("full_at", F.col("cap") / F.col("w"))
    order = Window.orderBy("full_at", "rank")
    total = F.sum("source_size").over(Window.partitionBy())
    earlier = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    later = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (total * F.lit(float(share)) - earlier) / later)
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(Window.partitionBy())
    return rows.select("source", "source_size", "rank",
                       F.coalesce(F.least(F.col("w") * level, F.col("cap")), F.col("cap")).alias("target"))


def _hash(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
         share: float = SHARE, limit: int = LIMIT, schedules=SCHEDULES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken, position, uses``.

    ``size`` counts words, ``target`` is the source's. ``uses`` lists the row's occurrences in the training
    stream: ``pass``, its training time ``at``, the words ``need`` it gives (all, or what its source's target
    still needs) and its ``offset``, the words of the stream before it (null if nothing is taken).
    ``taken`` adds up the words of ``uses``, ``position`` is the time of the first. Columns ``rank, before,
    whole, a, b`` (source's rank, words of its source before the row, whole-number target, row key) serve :func:`mix`.

    Null texts and texts without words have size 0 and are never taken; a null source is one more
    source and ranks last; null and repeated ids are ordered by their text's hash; repeated rows
    are rows of their own. An empty table gives no rows. Reruns agree, whatever the partitioning.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    key = row_key(doc_id, text)
    rows = scratch.stage(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _hash(F.col(doc_id)).alias("h"), key["a"].alias("a"), key["b"].alias("b")))
    ranges = -(-rows.count() // ROWS_PER_RANGE) or 1
    part = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * ranges).bitwiseAND(F.lit((1 << 63) - 1))
    rows = rows.withColumn("part", F.shiftright(part, 32))
    sums = scratch.stage(rows.groupBy("source", "part").agg(F.sum("size").alias("words")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, limit)
    along = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sums.withColumn("ahead", F.coalesce(F.sum("words").over(along), F.lit(0))).drop("words")
              .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
              .withColumnsRenamed({"source": "s", "part": "p"}))
    within = (Window.partitionBy("source", "part").orderBy("h", F.col("doc_id").asc_nulls_last(), "a", "b")
              .rowsBetween(Window.unboundedPreceding, 0))
    out = (rows.withColumn("upto", F.sum("size").over(within))
           .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
           .withColumn("before", F.col("ahead") + F.col("upto") - F.col("size"))
           .withColumn("whole", F.floor("target")))
    out = scratch.stage(out.select("doc_id", "size", "source_size", "target", "rank", "before", "whole", "a", "b"))
    need = "least(size, whole - source_size * pass - before)"
    used = (out.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max(0, int(limit) - 1)))))
            .withColumn("need", F.expr(need)).where("need > 0"))
    # rows with words differ in (rank, before); the others are never taken
    uses = F.array_sort(F.collect_list(F.struct("pass", "at", "need", "offset"))).alias("uses")
    taken = _in_training_order(used, schedules, scratch).groupBy(*out.columns).agg(uses)
    left = out.where("size = 0 or whole <= before").withColumn("uses", F.lit(None).cast(taken.schema["uses"].dataType))
    words = F.aggregate("uses", F.lit(0).cast("long"), lambda n, use: n + use["need"])
    return (taken.unionByName(left)
            .select("doc_id", "size", "source_size", "target", F.coalesce(words, F.lit(0)).alias("taken"),
                    F.col("uses")[0]["at"].alias("position"), "uses", "rank", "before", "whole", "a", "b"))


def _in_training_order(used: DataFrame, schedules, scratch: Scratch) -> DataFrame:
    """``used``, a row per occurrence, sorted by training time: with its time ``at`` and ``offset``, the words before it."""
    order = ["at", "rank", "before", "pass"]
    at = _schedule_sql("(CAST(source_size * pass + before AS DOUBLE) / target)", "rank", schedules)
    # staged, so that a range is read as it was dealt
    stream = scratch.stage(used.withColumn("at", F.expr(at)).repartitionByRange(shuffle_partitions(used.sparkSession), *order)
                           .withColumn("range", F.spark_partition_id()))
    along = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (stream.groupBy("range").agg(F.sum("need").alias("words"))
              .select("range", F.coalesce(F.sum("words").over(along), F.lit(0)).alias("start")))
    upto = F.sum("need").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return (stream.withColumn("upto", upto).join(F.broadcast(starts), "range")
            .withColumn("offset", F.col("start") + F.col("upto") - F.col("need")).drop("range", "start", "upto"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        share: float = SHARE, limit: int = LIMIT, schedules=SCHEDULES) -> DataFrame:
    """The training stream: rows of ``docs`` in training order, one per occurrence.

    Documents the mix does not take go; one taken twice comes twice; the one occurrence per source
    at which the target is met is cut after the word that meets it. Further columns pass through,
    and only ``text`` of the cut occurrence changes. Nulls, ties and empty tables as in
    :func:`plan`. The result is range-partitioned and sorted by training time.
    """
    scratch = Scratch(docs.sparkSession, "mix-out")
    planned = plan(docs, doc_id, text, source, weights, share, limit, schedules).where("taken > 0")
    cut = F.transform("uses", lambda use: F.struct(use["offset"].alias("offset"), F.when(use["need"] < F.col("size"), use["need"]).alias("cut")))
    times = planned.select("a", "b", "before", cut.alias("uses"))
    # rows equal in id and text are numbered, so that each meets its own place in the stream
    same = Window.partitionBy("a", "b")
    times = scratch.stage(times.withColumn("n", F.row_number().over(same.orderBy("before"))).drop("before"))
    rows = whole_rows(docs, doc_id, text).withColumn("n", F.row_number().over(same.orderBy(F.lit(0))))
    # the number is a key of the join, so that k equal rows meet k places and not k times k
    found = rows.join(times, ["a", "b", "n"]).select("row", F.explode("uses").alias("use"))
    words = F.regexp_extract_all(F.col("row")[text], F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("use.cut").cast("int")), "")
    found = found.select(F.when(F.col("use.cut").isNull(), F.col("row")).otherwise(F.col("row").withField(text, cut)).alias("row"),
                         "use.offset")
    return (found.repartitionByRange(shuffle_partitions(docs.sparkSession), "offset").sortWithinPartitions("offset")
            .select("row.*"))


def plan_sql(weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT, schedules=SCHEDULES) -> str:
    """DuckDB SQL of :func:`plan` over ``documents``."""
    at = _schedule_sql("(CAST(before AS DOUBLE) / target)", "(rank - 1)", schedules).replace("D ", " ")
    import re

    at = re.sub(r"(?<=[0-9])D\b", "", at)
    w = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(weights))
    taken = " + ".join(f"greatest(0, least(size, CAST(floor(target) AS BIGINT) - source_size * {n} - before))"
                       for n in range(int(limit)))
    return f"""
WITH r AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM r GROUP BY source),
w AS (
  SELECT *, CAST(CASE (rank - 1) % {len(weights)} {w} END AS DOUBLE) AS w, source_size * {float(limit)!r}::DOUBLE AS cap FROM s),
l AS (
  SELECT *, cap / w AS full_at,
         (sum(source_size) OVER () * {float(share)!r}::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, rank,
         coalesce(least(w * max(CASE WHEN level <= full_at THEN level END) OVER (), cap), cap) AS target FROM l),
d AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, t.rank,
         CAST(coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h, r.doc_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CAST({taken} AS BIGINT) AS taken FROM d)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN {at} END AS position FROM x"""
