"""Cogroup of two keyed tables with a caller's function over Arrow tables.

Spark's own cogroup puts both sides of a key into one task. Here a key with more rows than a bound
is dealt in slices: its left rows by a hash of the row, each slice against the key's right rows (or
against each slice of these). The copies of the right rows grow with the number of left slices of
their key alone, so a key with a third of all rows costs what its size asks for and its memory stays bounded.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.scalar import hashable_columns

_L, _R = "_kl_left_slice", "_kl_right_slice"


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*hashable_columns(df), F.lit(7))


def _hot(df: DataFrame, on: Sequence[str], rows: int, name: str) -> DataFrame:
    """``(keys..., name)`` of the keys with more than ``rows`` rows: how many slices each is dealt in."""
    counts = df.groupBy(*on).agg(F.count("*").alias("_kl_n")).where(F.col("_kl_n") > rows)
    return counts.select(*[F.col(c).alias(f"_kl_key_{i}") for i, c in enumerate(on)], F.ceil(F.col("_kl_n") / rows).cast("int").alias(name))


def _dealt(df: DataFrame, on: Sequence[str], own: DataFrame | None, other: DataFrame | None, own_name: str, other_name: str) -> DataFrame:
    """Each row in its own slice, once for every slice of the other side."""
    for side in (own, other):
        if side is not None:
            same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_kl_key_{i}")) for i, c in enumerate(on)]
            condition = same[0]
            for c in same[1:]:
                condition = condition & c
            df = df.join(side, condition, "left").drop(*[f"_kl_key_{i}" for i in range(len(on))])
    n = F.coalesce(F.col("_kl_own"), F.lit(1)) if own is not None else F.lit(1)
    m = F.coalesce(F.col("_kl_other"), F.lit(1)) if other is not None else F.lit(1)
    rows = [c for c in df.columns if c not in ("_kl_own", "_kl_other")]
    mine = F.pmod(_row_hash(df.select(*rows)), n).cast("int").alias(own_name) if own is not None else F.lit(0).alias(own_name)
    theirs = F.explode(F.sequence(F.lit(0), m - 1)).alias(other_name) if other is not None else F.lit(0).alias(other_name)
    # new columns, as both sides may come from one table
    return df.select(*[F.col(f"`{c}`").alias(c) for c in rows], mine, theirs)


def cogroup(left: DataFrame, right: DataFrame, on: str | Sequence[str], func: Callable[..., pa.Table], schema,
            left_slice_rows: int | None = None, right_slice_rows: int | None = None) -> DataFrame:
    """``func(left_rows, right_rows)`` or ``func(key, left_rows, right_rows)`` for every key of either side.

    Both are ``pyarrow.Table`` (without rows where a side lacks the key), as is the result, of ``schema``.
    Null keys are one key. With ``left_slice_rows`` a key with more left rows is cut into slices of about
    that many, and ``func`` is called once a slice with all right rows of the key: for functions whose
    rows follow from one left row and the right rows. With ``right_slice_rows`` the right rows are cut as
    well, and ``func`` sees every pair of slices: for functions whose rows follow from pairs. Rows equal in all hashable
    columns stay in one slice. Without either, a key's rows meet in one task, as in Spark's cogroup.
    """
    on = [on] if isinstance(on, str) else list(on)
    clash = {_L, _R} & {*left.columns, *right.columns}
    if not on or clash:
        raise ValueError("on must name key columns" if not on else f"reserved column names: {sorted(clash)}")
    hot_left = _hot(left, on, left_slice_rows, "_kl_slices") if left_slice_rows else None
    hot_right = _hot(right, on, right_slice_rows, "_kl_slices") if right_slice_rows else None
    named = lambda hot, name: None if hot is None else hot.withColumnRenamed("_kl_slices", name)
    a = _dealt(left, on, named(hot_left, "_kl_own"), named(hot_right, "_kl_other"), _L, _R)
    b = _dealt(right, on, named(hot_right, "_kl_own"), named(hot_left, "_kl_other"), _R, _L)
    with_key = len(inspect.signature(func).parameters) == 3
    keys = len(on)

    def call(key, x: pa.Table, y: pa.Table) -> pa.Table:
        x, y = x.drop_columns([_L, _R]), y.drop_columns([_L, _R])
        return func(key[:keys], x, y) if with_key else func(x, y)

    groups = [*on, _L, _R]
    return a.groupBy(*groups).cogroup(b.groupBy(*groups)).applyInArrow(call, schema)
