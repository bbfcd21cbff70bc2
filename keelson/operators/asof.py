"""Bucketed, strict, backward as-of join of events to their latest earlier state.

Semantics (the reference's cogroup): for every action, the state with the greatest time that is
strictly earlier (``state.ts < action.ts``) within the same time bucket (``ts div bucket_ms``)
and the same ``by`` keys; actions without one are dropped (``how="inner"``) or kept with a null
state (``how="left"``). Ties between states of equal time go to the greatest tie-break.

Plan: both sides are unioned into one narrow frame tagged with a kind (actions sort before
states of the same time, which makes the match strict) and laid out over range buckets of the
order ``(by, time bucket, ts, kind, tiebreak)`` (see ``ordering``). One shuffle; inside a bucket
``last(state, ignorenulls)`` over a running frame finds the latest state. The latest state of
earlier buckets is carried in from a table of at most one row per bucket, so a key that holds a
third of all rows is spread over many tasks and no group is ever held in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.scalar import epoch_ms, hashable_columns, ms_bucket
from keelson.operators.ordering import BUCKET, _lit_array, _sources, plan_layout
from keelson.session import small_side


def _ms_of(df: DataFrame, ts) -> Column:
    if isinstance(ts, str):
        return epoch_ms(F.col(ts), df.schema[ts].dataType)
    return ts.cast("bigint")


def _tie_of(df: DataFrame, tiebreak) -> Column:
    if tiebreak is None:
        return F.xxhash64(*hashable_columns(df), F.lit(0))
    if isinstance(tiebreak, str):
        return F.col(tiebreak)
    return tiebreak


def asof_join(actions: DataFrame, states: DataFrame, action_ts, state_ts, by=None,
              bucket_ms: int | None = 1000, allow_exact: bool = False,
              tolerance_ms: int | None = None, how: str = "inner",
              action_tiebreak=None, state_tiebreak=None,
              action_name: str = "actionEvent", state_name: str = "gameState",
              num_buckets: int | None = None) -> DataFrame:
    """Pair every action with its latest earlier state; returns ``(action_name, state_name)``
    struct columns holding the whole action row and the whole state row.

    ``by`` names columns present on both sides; ``bucket_ms=None`` means no time bucket.
    ``allow_exact`` admits a state at the action's own time; ``tolerance_ms`` bounds how old a
    state may be. Timestamps may be timestamp columns or epoch-ms integers.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    # no ``by`` and no bucket is allowed: one global running order, still spread over buckets
    by = [by] if isinstance(by, str) else list(by or [])
    a_kind, s_kind = (1, 0) if allow_exact else (0, 1)

    a_row = F.struct(*[F.col(c) for c in actions.columns])
    s_row = F.struct(*[F.col(c) for c in states.columns])
    a_ts, s_ts = _ms_of(actions, action_ts), _ms_of(states, state_ts)
    a_tie, s_tie = _tie_of(actions, action_tiebreak), _tie_of(states, state_tiebreak)
    tie_type = actions.select(a_tie.alias("t")).schema["t"].dataType

    s_struct_type = states.select(F.struct(F.lit(0).cast("bigint").alias("ts"), s_row.alias("row"))
                                  .alias("s")).schema["s"].dataType
    a_struct_type = actions.select(a_row.alias("a")).schema["a"].dataType

    def side(df, ts, kind, tie, a_val, s_val):
        cols = [F.col(b).alias(f"_g{i}") for i, b in enumerate(by)]
        return df.select(*cols, ts.alias("_ts"), F.lit(kind).alias("_kind"),
                         tie.cast(tie_type).alias("_tie"), a_val.alias("_a"), s_val.alias("_s"))

    left = side(actions, a_ts, a_kind, a_tie, a_row, F.lit(None).cast(s_struct_type))
    right = side(states, s_ts, s_kind, s_tie, F.lit(None).cast(a_struct_type),
                 F.struct(s_ts.alias("ts"), s_row.alias("row")))
    u = left.unionByName(right)
    groups = [F.col(f"_g{i}") for i in range(len(by))]
    if bucket_ms is not None:
        u = u.withColumn("_tb", ms_bucket(F.col("_ts"), bucket_ms))
        groups.append(F.col("_tb"))
    order = [F.col("_ts"), F.col("_kind"), F.col("_tie")]
    is_state = F.col("_kind") == F.lit(s_kind)

    layout = plan_layout(u, groups + order, num_buckets=num_buckets, count=False)
    b = layout.add_bucket(u)

    running = (Window.partitionBy(BUCKET, *groups).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = b.withColumn("_in", F.last("_s", ignorenulls=True).over(running)).where(~is_state)

    # carry-in: the last state of the nearest earlier bucket that has any state
    carry = (b.where(is_state)
             .groupBy(F.col(BUCKET).alias("_cb"))
             .agg(F.max_by(F.struct(*[g.alias(f"c{i}") for i, g in enumerate(groups)], F.col("_s").alias("s")),
                           F.struct(*groups, *order)).alias("_carry")))
    carry = small_side(carry, layout.num_buckets)  # at most one row per bucket; broadcast if small
    has_state = [0] * layout.num_buckets
    for r in carry.select("_cb").collect():  # bucket ids only, read back from the small table
        has_state[r[0]] = 1
    src = _sources(has_state)
    joined = within.join(carry, F.get(_lit_array(src, "int"), F.col(BUCKET)) == F.col("_cb"), "left")
    same_group = F.lit(True)
    for i, g in enumerate(groups):
        same_group = same_group & F.col(f"_carry.c{i}").eqNullSafe(g)
    state = F.coalesce(F.col("_in"), F.when(F.col("_carry").isNotNull() & same_group, F.col("_carry.s")))
    if tolerance_ms is not None:
        state = F.when(F.col("_ts") - state["ts"] <= F.lit(int(tolerance_ms)), state)
    out = joined.select(F.col("_a").alias(action_name), state["row"].alias(state_name))
    if how == "inner":
        out = out.where(F.col(state_name).isNotNull())
    return out
