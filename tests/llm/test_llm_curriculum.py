import math

from pyspark.sql import functions as F

from keelson.llm import curriculum


def targets(sizes):
    """Reshare by weight round by round, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not full:
            out.update((s, weight[s] * level) for s in free)
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


ROWS = [(i, "w " * (i * 7 % 23), ["a", "b", "é", "Z", None][i % 5]) for i in range(200)] + [(300, None, "a"), (301, "", "only-empty"),
        (None, "x y z", "b"), (7, "dup id", "b"), (7, "dup id", "b"), (302, "one two", "tiny")]


def words(text):
    return len((text or "").encode().split())


def test_targets_and_taken(make_docs):
    sizes = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = targets(sizes)
    docs = make_docs(ROWS)
    found = curriculum.plan(docs).collect()
    assert len(found) == len(ROWS)
    assert sum(r.taken for r in found) <= 1.5 * sum(sizes.values()) and all(0 <= r.taken <= 2 * r.size for r in found)
    per_source = curriculum.mix(docs).groupBy("source").agg(F.sum(F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))).alias("n"))
    taken = {r.source: r.n for r in per_source.collect()}
    for s, t in want.items():
        assert any(math.isclose(r.target, t) and r.source_size == sizes[s] for r in found)
        assert taken.get(s, 0) == math.floor(t + 1e-9)


def test_reruns_agree_under_other_partitionings(make_docs):
    key = lambda df: sorted((tuple(r) for r in df.select("doc_id", "size", "taken", "position").collect()), key=repr)
    assert key(curriculum.plan(make_docs(ROWS, 2))) == key(curriculum.plan(make_docs(ROWS, 7)))


def test_stream_is_in_time_order_and_schedules_hold(make_docs):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(900)]
    stream = [r.source for r in curriculum.mix(make_docs(rows)).collect()]
    first = stream[:len(stream) // 4]
    share = {s: first.count(s) / stream.count(s) for s in "abc"}
    assert share["a"] > share["b"] > share["c"]  # falling, level and held-back schedules


def test_time_inverts_the_integral(spark):
    for knots in curriculum.SCHEDULES:
        rows = spark.range(101).select((F.col("id") / 100).alias("u"))
        for u, t in rows.select("u", F.expr(curriculum.time_sql("u", knots))).collect():
            area = lambda x: sum((min(x, b) - a) * (wa + wa + (wb - wa) * (min(x, b) - a) / (b - a)) / 2
                                 for (a, wa), (b, wb) in zip(knots, knots[1:]) if x > a)
            assert math.isclose(area(t) / area(1.0), u, abs_tol=1e-9)


def test_empty_and_wordless_tables(make_docs):
    assert curriculum.plan(make_docs([])).collect() == []
    assert curriculum.mix(make_docs([])).collect() == []
    only = curriculum.plan(make_docs([(1, None), (2, " ")])).collect()
    assert [(r.size, r.target, r.taken, r.position) for r in only] == [(0, 0.0, 0, None)] * 2


def test_a_group_of_equal_rows_meets_as_many_places(spark, make_docs):
    """Equal rows: joined by number, k rows make k rows, not k times k."""
    docs = make_docs([(1, "one two three")]).crossJoin(spark.range(100_000).drop("id")).unionByName(make_docs([(i, f"w{i} x") for i in range(2, 40)]))
    out = curriculum.mix(docs)
    equal = out.where("doc_id = 1").groupBy("text").count().collect()
    assert sum(r["count"] * len(r.text.split()) for r in equal) == sum(r.taken for r in curriculum.plan(docs).where("doc_id = 1").select("taken").collect())


def test_every_occurrence_has_its_time_and_offset_in_the_stream(make_docs):
    """The plan lays out repeats too: sorted by time their offsets are gapless, and the stream of texts follows them."""
    docs = make_docs(ROWS)
    planned = curriculum.plan(docs).collect()
    uses = sorted(((u.at, r.rank, r.before, u["pass"]), u.offset, u.need, r) for r in planned for u in r.uses or [])
    at = 0
    for _, offset, need, _ in uses:
        assert offset == at and need > 0
        at += need
    assert at == sum(r.taken for r in planned) and any(u["pass"] == 1 for r in planned for u in r.uses or [])
    assert all(r.taken == sum(u.need for u in r.uses or []) and r.position == (r.uses[0].at if r.uses else None) for r in planned)
    stream = curriculum.mix(docs).collect()
    assert [(r.doc_id, words(r.text)) for r in stream] == [(r.doc_id, need) for _, _, need, r in uses]
