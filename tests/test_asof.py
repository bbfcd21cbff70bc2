"""The cases of fixture 6, plus options and invariance."""

import pytest
from pyspark.sql import functions as F

from keelson.operators.asof import asof_join

BASE = 1_476_615_547_000  # a whole second


def _run(spark, actions, states, **kw):
    a = spark.createDataFrame(actions, "aid int, ms bigint")
    s = spark.createDataFrame(states, "sid int, combatLogTimestamp bigint")
    out = asof_join(a, s, "ms", "combatLogTimestamp", action_tiebreak="aid", state_tiebreak="sid", **kw)
    return {r["actionEvent"]["aid"]: (r["gameState"]["sid"] if r["gameState"] else None) for r in out.collect()}


def test_fixture_cases(spark):
    actions = [
        (1, BASE + 500),   # state at its own ms only -> no match (strict)
        (2, BASE + 700),   # state 1 ms before -> match
        (3, BASE + 2_100), # state in the previous second only -> no match with 1 s buckets
        (4, BASE + 3_900), # two states in its second -> the latest wins
        (5, BASE + 5_500), # no state at all -> dropped
        (6, BASE + 6_800), # two actions on one state
        (7, BASE + 6_900),
    ]
    states = [
        (10, BASE + 500),
        (11, BASE + 699),
        (12, BASE + 1_900),
        (13, BASE + 3_100), (14, BASE + 3_800),
        (15, BASE + 6_100),
    ]
    got = _run(spark, actions, states, bucket_ms=1000, num_buckets=3)
    assert got == {2: 11, 4: 14, 6: 15, 7: 15}


def test_exact_tolerance_left_and_no_bucket(spark):
    actions = [(1, BASE + 500), (2, BASE + 2_100)]
    states = [(10, BASE + 500), (12, BASE + 1_900)]
    assert _run(spark, actions, states, bucket_ms=1000, allow_exact=True) == {1: 10}
    assert _run(spark, actions, states, bucket_ms=None) == {2: 12}
    assert _run(spark, actions, states, bucket_ms=None, tolerance_ms=100, how="left") == {1: None, 2: None}
    assert _run(spark, actions, states, bucket_ms=None, tolerance_ms=200, how="left") == {1: None, 2: 12}


def test_equal_state_times_take_greatest_tiebreak(spark):
    got = _run(spark, [(1, BASE + 900)], [(20, BASE + 100), (21, BASE + 100)], bucket_ms=1000)
    assert got == {1: 21}


def test_hot_key_split_over_buckets_matches_single_bucket(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    one_user = ev.withColumn("user_id", F.lit(7))  # every row on one key
    clicks = one_user.where("event_type = 'click'").select("event_id", "user_id", "ts")
    views = one_user.where("event_type = 'view'").select("event_id", "user_id", "ts")

    def run(n):
        out = asof_join(clicks, views, "ts", "ts", by="user_id", bucket_ms=None, action_tiebreak="event_id",
                        state_tiebreak="event_id", num_buckets=n)
        return sorted((r[0], r[1]) for r in out.select("actionEvent.event_id", "gameState.event_id").collect())

    assert run(1) == run(13)
    assert len(run(13)) > 1900


def test_invariant_under_partitioning(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    clicks = ev.where("event_type = 'click'").select("event_id", "user_id", "ts")
    views = ev.where("event_type = 'view'").select("event_id", "user_id", "ts")

    def run(c, v, n):
        out = asof_join(c, v, "ts", "ts", by="user_id", bucket_ms=86_400_000, action_tiebreak="event_id",
                        state_tiebreak="event_id", num_buckets=n, how="left")
        return sorted((r[0], r[1]) for r in out.select("actionEvent.event_id", "gameState.event_id").collect())

    base = run(clicks, views, 2)
    assert run(clicks.repartition(1), views.repartition(7), 200) == base
    assert run(clicks.repartition(7), views.repartition(1), 1) == base
    plan = asof_join(clicks, views, "ts", "ts", by="user_id")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "EvalPython" not in plan


def test_side_tables_without_broadcast(spark):
    # with automatic broadcast off, the per-bucket side tables are joined by shuffle instead
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = _run(spark, [(1, BASE + 700), (2, BASE + 5_500)], [(11, BASE + 699), (12, BASE + 5_000)],
                   bucket_ms=None, num_buckets=4)
        assert got == {1: 11, 2: 12}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_randomized_against_brute_force(spark, seed):
    import random

    rnd = random.Random(seed)
    users = [None, 1, 2, 3]
    actions = [(i, rnd.choice(users) if rnd.random() < 0.5 else 2, rnd.randint(0, 60)) for i in range(150)]
    states = [(1000 + i, rnd.choice(users) if rnd.random() < 0.5 else 2, rnd.randint(0, 60)) for i in range(150)]
    bucket = rnd.choice([None, 10])
    exact = rnd.choice([False, True])
    a = spark.createDataFrame(actions, "aid int, u int, ms bigint")
    s = spark.createDataFrame(states, "sid int, u int, ms bigint")
    out = asof_join(a, s, "ms", "ms", by="u", bucket_ms=bucket, allow_exact=exact, how="left",
                    action_tiebreak="aid", state_tiebreak="sid", num_buckets=rnd.choice([1, 4, 9]))
    got = {r["actionEvent"]["aid"]: (r["gameState"]["sid"] if r["gameState"] else None) for r in out.collect()}

    def same(x, y):
        return x == y  # None matches None, as a null-safe grouping key does

    want = {}
    for aid, u, ms in actions:
        best = None
        for sid, su, sms in states:
            if not same(u, su) or (bucket and sms // bucket != ms // bucket):
                continue
            if sms < ms or (exact and sms == ms):
                if best is None or (sms, sid) > best:
                    best = (sms, sid)
        want[aid] = best[1] if best else None
    assert got == want
