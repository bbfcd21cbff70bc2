"""Checks for the order-dependent operators: J1, J3, W1, W2, W3 (plus P13/P14/P19/P20 inside)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.scalar import epoch_ms
from keelson.operators.asof import asof_join
from keelson.operators.cogroup import cogroup
from keelson.operators.ordering import gap_fill, sliding, with_next, with_row_index
from keelson.operators.project import pack_pair
from keelson.plans.registry import query
from keelson.sources.tables import table

DAY_MS = 86_400_000
NTZ = T.TimestampNTZType()


def _clicks_views(spark, sf):
    ev = table(spark, sf, "events")
    clicks = ev.where(F.col("event_type") == "click").select("event_id", "user_id", "ts")
    views = ev.where(F.col("event_type") == "view").select("event_id", "user_id", "ts")
    return clicks, views


def _pairs_out(pairs):
    packed = pack_pair(pairs, "actionEvent", "gameState", key="user_id")
    a_ms = epoch_ms(F.col("actionEvent.ts"), NTZ)
    s_ms = epoch_ms(F.col("gameState.ts"), NTZ)
    return packed.select(
        F.col("actionEvent.event_id").alias("click_id"),
        F.col("user_id"),
        a_ms.alias("click_ms"),
        F.col("gameState.event_id").alias("view_id"),
        s_ms.alias("view_ms"),
        (a_ms - s_ms).alias("lag_ms"),
    )


_ASOF_SQL = """
WITH c AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ms FROM events WHERE event_type = 'click'),
v AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ms FROM events WHERE event_type = 'view'),
j AS (
  SELECT c.event_id AS click_id, c.user_id, c.ms AS click_ms, v.event_id AS view_id, v.ms AS view_ms,
         row_number() OVER (PARTITION BY c.event_id ORDER BY v.ms DESC, v.event_id DESC) AS rk
  FROM c JOIN v ON c.user_id = v.user_id AND {bucket} AND v.ms < c.ms)
SELECT click_id, user_id, click_ms, view_id, view_ms, click_ms - view_ms AS lag_ms FROM j WHERE rk = 1
"""


@query("j1_asof_bucketed", _ASOF_SQL.format(bucket="c.ms // 86400000 = v.ms // 86400000"))
def j1_asof_bucketed(spark, sf):
    """Latest strictly earlier view for every click of the same user and UTC day."""
    clicks, views = _clicks_views(spark, sf)
    pairs = asof_join(clicks, views, "ts", "ts", by="user_id", bucket_ms=DAY_MS,
                      action_tiebreak="event_id", state_tiebreak="event_id")
    return _pairs_out(pairs)


@query("j1_asof_second", """
WITH e AS (SELECT event_id, event_type, user_id % 3 AS grp, event_id * 70 AS ms FROM events),
j AS (
  SELECT c.event_id AS click_id, v.event_id AS view_id, c.ms - v.ms AS lag_ms,
         row_number() OVER (PARTITION BY c.event_id ORDER BY v.ms DESC) AS rk
  FROM e c JOIN e v ON c.event_type = 'click' AND v.event_type = 'view' AND c.grp = v.grp AND c.ms // 1000 = v.ms // 1000 AND v.ms < c.ms)
SELECT click_id, view_id, lag_ms FROM j WHERE rk = 1
""")
def j1_asof_second(spark, sf):
    """The reference's own setting, one-second buckets, on epoch milliseconds 70 ms apart (the
    table's own times are too sparse for a match within a second)."""
    ev = table(spark, sf, "events").select("event_id", "event_type", (F.col("user_id") % 3).alias("grp"),
                                           (F.col("event_id") * 70).alias("ms"))
    clicks, views = (ev.where(F.col("event_type") == t).drop("event_type") for t in ("click", "view"))
    pairs = asof_join(clicks, views, "ms", "ms", by="grp", bucket_ms=1000,
                      action_tiebreak="event_id", state_tiebreak="event_id")
    return pairs.select(F.col("actionEvent.event_id").alias("click_id"), F.col("gameState.event_id").alias("view_id"),
                        (F.col("actionEvent.ms") - F.col("gameState.ms")).alias("lag_ms"))


@query("j1_asof_unbucketed_left", """
WITH c AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ms FROM events WHERE event_type = 'click'),
v AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ms FROM events WHERE event_type = 'view'),
j AS (
  SELECT c.event_id AS click_id, c.user_id, c.ms AS click_ms, v.event_id AS view_id, v.ms AS view_ms,
         row_number() OVER (PARTITION BY c.event_id ORDER BY v.ms DESC NULLS LAST, v.event_id DESC NULLS LAST) AS rk
  FROM c LEFT JOIN v ON c.user_id = v.user_id AND v.ms < c.ms)
SELECT click_id, user_id, click_ms, view_id, view_ms, click_ms - view_ms AS lag_ms FROM j WHERE rk = 1
""")
def j1_asof_unbucketed_left(spark, sf):
    """No time bucket, keyed by user, clicks without an earlier view kept with nulls."""
    clicks, views = _clicks_views(spark, sf)
    pairs = asof_join(clicks, views, "ts", "ts", by="user_id", bucket_ms=None, how="left",
                      action_tiebreak="event_id", state_tiebreak="event_id")
    return _pairs_out(pairs)


@query("w1_sliding_global", """
SELECT o_orderkey,
       CAST(count(*) OVER w AS INTEGER) AS win_size,
       last(o_orderkey) OVER w AS last_key,
       round(sum(o_totalprice) OVER w, 2) AS win_total
FROM orders
WINDOW w AS (ORDER BY o_totalprice, o_orderkey ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)
""")
def w1_sliding_global(spark, sf):
    """sliding(4) over all orders by total price (order key breaks ties)."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    win = sliding(orders, 4, ["o_totalprice", "o_orderkey"], name="window")
    w = F.col("window")
    return win.select(
        w[0]["o_orderkey"].alias("o_orderkey"),
        F.size(w).alias("win_size"),
        F.element_at(w, -1)["o_orderkey"].alias("last_key"),
        F.round(F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x["o_totalprice"]), 2).alias("win_total"),
    )


@query("w1_sliding_by_user", """
SELECT event_id,
       CAST(count(*) OVER w AS INTEGER) AS win_size,
       last(event_id) OVER w AS last_id,
       round(sum(value) OVER w, 2) AS win_value
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)
""")
def w1_sliding_by_user(spark, sf):
    """sliding(3) per user by time; a busy user is split over buckets like any other key."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    win = sliding(ev, 3, ["ts", "event_id"], partition_by=["user_id"], name="window")
    w = F.col("window")
    return win.select(
        w[0]["event_id"].alias("event_id"),
        F.size(w).alias("win_size"),
        F.element_at(w, -1)["event_id"].alias("last_id"),
        F.round(F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x["value"]), 2).alias("win_value"),
    )


@query("w2_row_index", """
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row_index FROM events
""")
def w2_row_index(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts")
    return with_row_index(ev, ["ts", "event_id"], name="row_index").select("event_id", "row_index")


@query("j3_next_row", """
SELECT event_id,
       lead(event_id) OVER w AS next_event_id,
       (epoch_us(lead(ts) OVER w) // 1000) - (epoch_us(ts) // 1000) AS gap_ms
FROM events WINDOW w AS (ORDER BY ts, event_id)
""")
def j3_next_row(spark, sf):
    """Each event joined to the next one in time order, with the time difference."""
    ev = table(spark, sf, "events").select("event_id", "ts")
    nxt = with_next(ev, ["ts", "event_id"], name="next")
    return nxt.select(
        "event_id",
        F.col("next.event_id").alias("next_event_id"),
        (epoch_ms(F.col("next.ts"), NTZ) - epoch_ms(F.col("ts"), NTZ)).alias("gap_ms"),
    )


@query("w3_gap_fill", """
WITH s AS (
  SELECT o_orderkey, o_custkey,
         lead(o_custkey) OVER (ORDER BY o_custkey, o_orderkey) - o_custkey AS d
  FROM orders)
SELECT o_orderkey, o_custkey,
       CAST(unnest(CASE WHEN d IS NULL OR d > 10 OR d = 0 THEN [0] ELSE range(0, d) END) AS BIGINT) AS gap_offset
FROM s
""")
def w3_gap_fill(spark, sf):
    """Gap fill over customer keys of all orders, maxGap 10 (order key breaks ties)."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return gap_fill(orders, "o_custkey", "gap_offset", 10, tiebreak="o_orderkey")


def _chain(spark, sf, n):
    """Windows over a key that ties everywhere: how many rows there are, follow and end a chain."""
    ev = table(spark, sf, "events").select("event_id", "user_id")
    w = sliding(ev, n, ["user_id"])
    at = [F.get("window", i)["event_id"] for i in range(n)]
    return w.select(*[c.alias(f"e{i}") for i, c in enumerate(at)]).agg(
        *[F.count_distinct(f"e{i}").alias(f"distinct_at_{i}") for i in range(n)],
        F.count_if(F.col("e1").isNull()).alias("ends"))


@query("w1_sliding_tied_2", """
SELECT count(*) AS distinct_at_0, count(*) - 1 AS distinct_at_1, 1::BIGINT AS ends FROM events
""")
def w1_sliding_tied_2(spark, sf):
    """Order by user alone: each row still follows at most one row, and one follows none."""
    return _chain(spark, sf, 2)


@query("w1_sliding_tied_3", """
SELECT count(*) AS distinct_at_0, count(*) - 1 AS distinct_at_1, count(*) - 2 AS distinct_at_2, 1::BIGINT AS ends FROM events
""")
def w1_sliding_tied_3(spark, sf):
    return _chain(spark, sf, 3)


@query("w2_row_index_tied", """
SELECT user_id, count(*) AS n, CAST(sum(rank) AS BIGINT) AS index_sum
FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) AS rank FROM events) GROUP BY user_id
""")
def w2_row_index_tied(spark, sf):
    """Row numbers over a tied key: each number once, the numbers of a user consecutive."""
    ev = table(spark, sf, "events").select("event_id", "user_id")
    return (with_row_index(ev, ["user_id"], name="i").groupBy("user_id")
            .agg(F.count_distinct("i").alias("n"), F.sum("i").alias("index_sum")))


@query("j2_cogroup", """
SELECT c.event_id, count(v.event_id) AS n_earlier, max(v.value) AS most
FROM events c LEFT JOIN events v ON v.event_type = 'view' AND v.user_id = c.user_id AND v.ts < c.ts
WHERE c.event_type = 'click' GROUP BY c.event_id
""")
def j2_cogroup(spark, sf):
    """Clicks cogrouped with views by user: for each click the user's earlier views and their highest
    value. Users with many clicks are dealt in slices of 500."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "value", "event_type")
    clicks = ev.where("event_type = 'click'").select("event_id", "user_id", "ts")
    views = ev.where("event_type = 'view'").select("user_id", "ts", "value")
    return cogroup(clicks, views, "user_id", _earlier_views, "event_id long, n_earlier long, most double", left_slice_rows=500)


def _earlier_views(clicks: pa.Table, views: pa.Table) -> pa.Table:
    views = views.sort_by("ts")
    times, values = views["ts"].to_numpy(), views["value"].to_numpy()
    n = np.searchsorted(times, clicks["ts"].to_numpy(), side="left")
    most = np.maximum.accumulate(values) if len(values) else np.empty(0)
    return pa.table({"event_id": clicks["event_id"], "n_earlier": pa.array(n.astype(np.int64)),
                     "most": pa.array([float(most[i - 1]) if i else None for i in n], pa.float64())})


@query("j2_cogroup_totals", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_clicks, count(*) FILTER (WHERE event_type = 'view') AS n_views,
       max(value) FILTER (WHERE event_type = 'click') AS top_click, max(value) FILTER (WHERE event_type = 'view') AS top_view
FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id
""")
def j2_cogroup_totals(spark, sf):
    """One row per user of either side from both sides' rows."""
    ev = table(spark, sf, "events").select("user_id", "value", "event_type")
    a, b = (ev.where(F.col("event_type") == kind).select("user_id", "value") for kind in ("click", "view"))

    def totals(key, x, y):
        most = lambda t: pa.array([pc.max(t["value"]).as_py()], pa.float64())
        return pa.table({"user_id": pa.array([key[0].as_py()], pa.int64()), "n_clicks": [x.num_rows], "n_views": [y.num_rows],
                         "top_click": most(x), "top_view": most(y)})

    return cogroup(a, b, "user_id", totals, "user_id long, n_clicks long, n_views long, top_click double, top_view double")
