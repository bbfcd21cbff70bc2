"""Plan shape of the order operators: one shuffle of the data, never a single partition, no
Python evaluation in the data path (survey section 5, check d)."""

import re

import pytest
from pyspark.sql import functions as F

from keelson.operators.asof import asof_join
from keelson.operators.ordering import fill_forward, gap_fill, sliding, with_next, with_row_index


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet")


CASES = {
    "row_index": lambda ev: with_row_index(ev.select("event_id", "ts"), ["ts", "event_id"]),
    "sliding": lambda ev: sliding(ev.select("event_id", "user_id", "ts"), 3, ["ts", "event_id"],
                                  partition_by=["user_id"]),
    "next": lambda ev: with_next(ev.select("event_id", "ts"), ["ts", "event_id"]),
    "gap_fill": lambda ev: gap_fill(ev.select("event_id", "user_id"), "user_id", "off", 5, tiebreak="event_id"),
    "fill_forward": lambda ev: fill_forward(
        ev.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "view", F.col("value")).alias("v")),
        ["v"], ["ts", "event_id"], partition_by="user_id"),
    "asof": lambda ev: asof_join(ev.where("event_type = 'click'").select("event_id", "user_id", "ts"),
                                 ev.where("event_type = 'view'").select("event_id", "user_id", "ts"),
                                 "ts", "ts", by="user_id", bucket_ms=None, action_tiebreak="event_id",
                                 state_tiebreak="event_id"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_one_shuffle_no_single_partition(spark, events, name):
    plan = _plan(CASES[name](events))
    shuffles = re.findall(r"Exchange hashpartitioning", plan)
    assert len(shuffles) == 1, plan
    assert "SinglePartition" not in plan
    assert "EvalPython" not in plan and "MapInArrow" not in plan and "MapInPandas" not in plan
