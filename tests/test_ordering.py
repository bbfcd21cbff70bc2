"""Edge cases, invariance under partitioning, and plan shape."""

import pytest
from pyspark.sql import functions as F

from keelson.operators.ordering import (check_gap_fill_schema, gap_fill, plan_layout, sliding, with_next,
                                        with_row_index)


def _ids(df, col="window", field="a"):
    return sorted(tuple(r) for r in df.select(F.transform(col, lambda x: x[field])).toPandas().iloc[:, 0])


def test_sliding_shuffled_permutation(spark):
    # fixture 4: 100 rows, each column a permutation of 1..100; windows of 2 hold consecutive b
    import random

    rnd = random.Random(3)
    a, b, c = (rnd.sample(range(1, 101), 100) for _ in range(3))
    df = spark.createDataFrame(list(zip(a, b, c)), "a int, b int, c int")
    out = sliding(df, 2, ["b"], num_buckets=5)
    wins = [list(r) for r in out.select(F.transform("window", lambda x: x["b"])).toPandas().iloc[:, 0]]
    assert len(wins) == 100
    assert sum(1 for w in wins if len(w) == 1) == 1
    assert all(w[1] == w[0] + 1 for w in wins if len(w) == 2)


@pytest.mark.parametrize("n", [1, 3, 150])
def test_sliding_matches_brute_force(spark, n):
    rows = [(i, (i * 7919) % 101) for i in range(120)]
    df = spark.createDataFrame(rows, "a int, k int")
    got = _ids(sliding(df, n, ["k", "a"], num_buckets=9))
    order = [a for a, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    want = sorted(tuple(order[i:i + n]) for i in range(len(order)))
    assert got == want


def test_sliding_empty_and_bad_n(spark):
    df = spark.createDataFrame([], "a int, k int")
    assert sliding(df, 3, ["k"]).count() == 0
    with pytest.raises(ValueError):
        sliding(df, 0, ["k"])


def test_sliding_partitioned_with_hot_key(spark):
    # one partition key holds most rows; it must still be split over buckets and stay correct
    rows = [(i, 0 if i % 3 else i % 5, i) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, p int, t int")
    out = sliding(df, 3, ["t"], partition_by=["p"], keep_columns=True, num_buckets=6)
    got = {r["a"]: [x["a"] for x in r["window"]] for r in out.collect()}
    by_p = {}
    for a, p, t in sorted(rows, key=lambda r: (r[1], r[2])):
        by_p.setdefault(p, []).append(a)
    for ids in by_p.values():
        for i, a in enumerate(ids):
            assert got[a] == ids[i:i + 3]
    layout = plan_layout(df, ["p", "t"], num_buckets=6)
    assert max(layout.counts) < 200  # the hot key (200 rows) is spread over buckets


def test_row_index_invariance(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts")
    base = with_row_index(ev, ["ts", "event_id"]).select("event_id", "row_index").toPandas()
    for parts in (1, 7):
        again = with_row_index(ev.repartition(parts), ["ts", "event_id"], num_buckets=parts + 2) \
            .select("event_id", "row_index").toPandas()
        m = base.merge(again, on="event_id")
        assert (m.row_index_x == m.row_index_y).all() and len(m) == len(base)
    assert sorted(base.row_index) == list(range(1, len(base) + 1))


def test_with_next_nulls_last(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "a int, k int")
    got = {r["a"]: (r["next"]["a"] if r["next"] else None) for r in with_next(df, ["k", "a"]).collect()}
    # nulls sort first ascending, as in ORDER BY
    assert got == {3: 1, 1: 2, 2: None}


def test_gap_fill_edges(spark):
    keys = [0, 0, 1, 3, 13, 24, 30]  # gaps 0, 1, 2, 10 (= maxGap), 11 (> maxGap), 6
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k bigint, i int")
    out = gap_fill(df, "k", "offset", 10, tiebreak="i", num_buckets=3)
    got = sorted((r["k"], r["offset"]) for r in out.collect())
    # d: 0->0 is 0, 0->1 is 1, 1->3 is 2, 3->13 is 10 (= maxGap, filled), 13->24 is 11 (too far),
    # 24->30 is 6, 30 has no next
    want = sorted([(0, 0), (0, 0), (1, 0), (1, 1)] + [(3, o) for o in range(10)] + [(13, 0)]
                  + [(24, o) for o in range(6)] + [(30, 0)])
    assert got == want


def test_gap_fill_schema_rules(spark):
    df = spark.createDataFrame([(1, 1.0, "x")], "k int, d double, s string")
    out = check_gap_fill_schema(df.schema, "k", "off")
    assert out["off"].dataType.simpleString() == "bigint"
    with pytest.raises(ValueError):
        check_gap_fill_schema(df.schema, "k", "s")
    with pytest.raises(ValueError):
        check_gap_fill_schema(df.schema, "d", "off")


def test_no_single_partition_window(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df = sliding(ev.select("event_id", "ts"), 4, ["ts", "event_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_fill_forward_brute_force(spark):
    from keelson.operators.ordering import fill_forward

    rows = [(i, 0 if i % 4 else i % 3, i * 7 % 1000, (i if i % 5 == 0 else None)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, p int, t int, v int")
    out = {r.id: r.v_ff for r in fill_forward(df, ["v"], ["t", "id"], partition_by="p", num_buckets=7).collect()}
    last = {}
    want = {}
    for i, p, t, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if v is not None:
            last[p] = v
        want[i] = last.get(p)
    assert out == want


def test_empty_inputs(spark):
    from keelson.operators.asof import asof_join
    from keelson.operators.ordering import fill_forward

    df = spark.createDataFrame([], "k bigint, t int, v int")
    assert with_row_index(df, ["k", "t"]).count() == 0
    assert with_next(df, ["k", "t"]).count() == 0
    assert gap_fill(df, "k", "off", 5, tiebreak="t").count() == 0
    assert fill_forward(df, ["v"], ["t"], partition_by="k").count() == 0
    a = spark.createDataFrame([], "id int, ms bigint")
    s = spark.createDataFrame([(1, 5)], "id int, ms bigint")
    assert asof_join(a, s, "ms", "ms").count() == 0
    assert asof_join(s, a, "ms", "ms", how="left").count() == 1


def test_key_types_match_spark_order(spark):
    import random
    from decimal import Decimal

    from pyspark.sql import types as T

    rnd = random.Random(5)
    words = ["ä", "a", "z", "\U0001F600x", "Ωmega", "", "abc", "abd", "ab"] + [f"w{i}" for i in range(50)]
    rows = [(i, Decimal(rnd.randint(-10**6, 10**6)) / Decimal(1000),
             bytes([rnd.randint(0, 255) for _ in range(rnd.randint(0, 4))]), rnd.choice(words),
             rnd.choice([None, -0.0, 0.0, 1.5, float("nan"), float("inf"), -float("inf")]))
            for i in range(400)]
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("d", T.DecimalType(12, 3)),
                           T.StructField("b", T.BinaryType()), T.StructField("s", T.StringType()),
                           T.StructField("f", T.DoubleType())])
    df = spark.createDataFrame(rows, schema)
    for keys in (["d", "id"], ["b", "id"], ["s", "id"], ["f", "id"]):
        got = {r.id: r.row_index for r in with_row_index(df, keys, num_buckets=7).collect()}
        want = [r.id for r in df.orderBy(*keys).collect()]
        assert [got[i] for i in want] == list(range(1, len(want) + 1)), keys


def test_sliding_two_brute_force_many_buckets(spark):
    rows = [(i, (i * 31) % 57) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, k int")
    got = _ids(sliding(df, 2, ["k", "a"], num_buckets=23))
    order = [a for a, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert got == sorted(tuple(order[i:i + 2]) for i in range(len(order)))


def test_first_rows_fallback_when_bounds_are_absent(spark):
    from pyspark.sql import types as T

    from keelson.operators import ordering as O

    df = spark.createDataFrame([(2 * i,) for i in range(50)], "k bigint")
    layout = O.OrderLayout(bounds=[(11,), (23,)], types=[T.LongType()], key_exprs=[F.col("k")])
    follow = O._first_rows(layout.add_bucket(df), layout, [F.col("k")], F.struct("k"))
    got = {r[O.BUCKET]: r["_kl_follow"]["k"] for r in follow.collect() if r[O.BUCKET] >= 0}
    assert got == {0: 12, 1: 24}


def test_constant_leading_key_and_common_string_prefix(spark):
    import random

    from keelson.operators import ordering as O

    rnd = random.Random(11)
    names = [f"hdfs://cluster/data/part-{i:05d}" for i in range(60)] + ["a", "zzz", "hdfs://c", None]
    rows = [(i, "same", rnd.choice(names), rnd.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, p string, s string, t int")
    keys = ["p", "s", "t", "id"]
    layout = O.plan_layout(df, keys, num_buckets=9)
    m, const, prefix = layout._image_plan()
    assert m == 1 and const == ("same",) and prefix.startswith(b"hdfs://c")
    got = {r.id: r.row_index for r in with_row_index(df, keys, num_buckets=9).collect()}
    want = [r.id for r in df.orderBy(*keys).collect()]
    assert [got[i] for i in want] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("lead", [False, True])
def test_hot_key_second_level_search(spark, lead):
    from keelson.operators import ordering as O

    # a third of the rows share p = 0; with a constant leading column the image moves to p
    rows = [(i, 0 if i % 3 == 0 else i % 7 + 1, (i * 13) % 1000) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, p int, t int")
    if lead:
        df = df.withColumn("c", F.lit("x"))
    keys = (["c"] if lead else []) + ["p", "t", "id"]
    layout = O.plan_layout(df, keys, num_buckets=16)
    m, _, _ = layout._image_plan()
    images = [O._image_value(b[m], layout.types[m]) for b in layout.bounds]
    groups = []
    for i, v in enumerate(images):
        if groups and groups[-1][0] == v:
            groups[-1] = (v, groups[-1][1], groups[-1][2] + 1)
        else:
            groups.append((v, i, 1))
    assert layout._hot_group(groups, m) is not None
    got = {r.id: r.row_index for r in with_row_index(df, keys, layout=layout).collect()}
    want = [r.id for r in df.orderBy(*keys).collect()]
    assert [got[i] for i in want] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_randomized_against_spark_order(spark, seed):
    import random

    rnd = random.Random(seed)
    hot = rnd.randint(0, 3)
    vals = [None, -0.0, 0.0, float("nan"), 1.0, 2.5, -3.0]
    rows = []
    for i in range(300):
        p = hot if rnd.random() < 0.4 else rnd.choice([None, 0, 1, 2, 3, 4, 5])
        rows.append((i, p, rnd.choice(vals), rnd.choice(["", "a", "ab", "b", None, "zz" * rnd.randint(0, 3)])))
    df = spark.createDataFrame(rows, "id int, p int, d double, s string")
    keys = rnd.choice([["p", "d", "id"], ["s", "p", "id"], ["d", "s", "id"]])
    n = rnd.choice([1, 3, 7, 16])
    want = [r.id for r in df.orderBy(*keys).collect()]
    got = {r.id: r.row_index for r in with_row_index(df, keys, num_buckets=n).collect()}
    assert [got[i] for i in want] == list(range(1, len(want) + 1))
    nxt = {r.id: (r.next.id if r.next else None) for r in with_next(df, keys, num_buckets=n).collect()}
    assert [nxt[i] for i in want] == want[1:] + [None]


def test_untyped_null_column_in_payload(spark):
    df = spark.createDataFrame([(i,) for i in range(30)], "k int").withColumn("z", F.lit(None))
    got = [r.next.k if r.next else None for r in with_next(df, ["k"], num_buckets=4).orderBy("k").collect()]
    assert got == list(range(1, 30)) + [None]


def test_row_index_with_uncounted_layout(spark):
    from keelson.operators.ordering import plan_layout

    df = spark.createDataFrame([(i,) for i in range(40)], "k int")
    layout = plan_layout(df, ["k"], num_buckets=5, count=False)
    got = sorted((r.k, r.row_index) for r in with_row_index(df, ["k"], layout=layout).collect())
    assert got == [(i, i + 1) for i in range(40)]


@pytest.mark.parametrize("seed,n", [(1, 2), (2, 3), (3, 5)])
def test_randomized_partitioned_sliding(spark, seed, n):
    import random

    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, 1, 2, 2, 2, 3]), rnd.choice([None, 0, 1, 2, 3, 4])) for i in range(250)]
    df = spark.createDataFrame(rows, "id int, p int, t int")
    out = sliding(df, n, ["t", "id"], partition_by=["p"], keep_columns=True, num_buckets=rnd.choice([3, 8]))
    got = {r.id: [x.id for x in r.window] for r in out.collect()}

    def k(v):
        return (v is not None, v if v is not None else 0)

    ordered = sorted(rows, key=lambda r: (k(r[1]), k(r[2]), r[0]))
    for i, (rid, p, _) in enumerate(ordered):
        same = [r[0] for r in ordered[i:] if r[1] == p][:n]
        assert got[rid] == same


@pytest.mark.parametrize("n", [2, 3])
def test_sliding_by_one_tied_column_is_one_chain(spark, n):
    """The order column alone ties everywhere: still each row follows at most one row."""
    rows = [(i, (i * 7919) % 200) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id int, k int").repartition(7)
    wins = [[x["id"] for x in r["window"]] for r in sliding(df, n, ["k"], num_buckets=16).collect()]
    assert len(wins) == 20_000 and len({w[0] for w in wins}) == 20_000
    follows = [w[1] for w in wins if len(w) > 1]
    assert len(follows) == len(set(follows)) == 19_999
    chain = {w[0]: w[1] for w in wins if len(w) > 1}
    assert all(chain.get(w[1]) == w[2] for w in wins if len(w) > 2)


def test_with_next_by_one_tied_column_is_one_chain(spark):
    df = spark.createDataFrame([(i, i % 11) for i in range(3_000)], "id int, k int").repartition(5)
    nxt = [r["next"]["id"] for r in with_next(df, ["k"], num_buckets=9).collect() if r["next"] is not None]
    assert len(nxt) == len(set(nxt)) == 2_999


def test_gap_fill_on_keys_at_both_ends_of_the_range(spark):
    lo, hi = -(2 ** 63), 2 ** 63 - 1
    df = spark.createDataFrame([(lo,), (0,), (2,), (hi,)], "k long")
    got = sorted((r.k, r.off) for r in gap_fill(df, "k", "off", 300).collect())
    assert got == [(lo, 0), (0, 0), (0, 1), (2, 0), (hi, 0)]


def test_order_of_planning_jobs_uses_no_python(spark):
    """Sampling and counting run on the JVM too: no Python node in any plan the layout runs."""
    plans = []
    df = spark.range(5_000).select("id", (F.col("id") % 13).alias("k"))
    frame, collect = type(df), type(df).collect
    try:
        frame.collect = lambda self: (plans.append(self._jdf.queryExecution().toString()), collect(self))[1]
        sliding(df, 2, ["k"], num_buckets=6).collect()
    finally:
        frame.collect = collect
    assert len(plans) >= 2 and not any(w in p for p in plans for w in ("MapInArrow", "MapInPandas", "EvalPython"))
