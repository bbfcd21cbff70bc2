"""Dumps in any layout, at any split size, by the scan and by the registered format."""

import random

import pytest
from pyspark.sql import functions as F

from keelson.sources import dumplex
from keelson.sources.dumpformat import EventDumpReader, events, register_event_dump
from keelson.sources.eventdump import EVENT_DUMP_SCHEMA, EVENT_DUMP_VARIANT_SCHEMA, read_event_dump

ONE_PER_LINE = """
Before = 5
Name = "x { y -- z"
WTFTestAddonData = {
\t["actionEvents"] = {
\t\t[1966] = {
\t\t\t1476615547158, -- [1]
\t\t\t1476615552665, -- [2]
\t\t\t1476615552665, -- [3]
\t\t},
\t\t[77] = {
\t\t},
\t},
\t["damageEvents"] = {
\t\t[0] = {
\t\t\t[1476616461654] = 17803,
\t\t\t[1476616461654] = 18000,
\t\t\t[1476616211921] = 34729,
\t\t},
\t\t[8] = {
\t\t\t[1476616211922] = 1,
\t\t},
\t},
\t["notes } { --[["] = {
\t\t["a"] = "b",
\t},
}
After = {
\t["actionEvents"] = {
\t\t[5] = {
\t\t\t1, -- [1]
\t\t},
\t},
}
"""

#: The same content: several entries on a line, inline tables, names as keys, brackets and dashes inside
#: texts and comments, texts and comments over several lines, keys apart from their values.
FREE = [
    """Before = 5 Name = "x { y -- z" WTFTestAddonData = { ["actionEvents"] = { [1966] = { 1476615547158, 1476615552665,
1476615552665 }, [77] = {} }, ["damageEvents"] = { [0] = { [1476616461654] = 17803, [1476616461654] = 18000; [1476616211921] = 34729 }, [8]={[1476616211922]=1} },
["notes } { --[["] = { ["a"] = "b" } } After = { ["actionEvents"] = { [5] = { 1 } } }""",
    """Before
=
5
Name = "x { y \\
-- z } \\" \\
still a text" WTFTestAddonData
= { actionEvents
= { [
1966 -- a key { on its own
] --[[ and } a
longer ]] =
{ 1476615547158 ; --[==[ ]] } 5, { ]=]
[9] = 9, ]==] 1476615552665 , 1476615552665
, } , [ 77 ] =
{
} ; } ,
damageEvents = { [0] = { [1476616461654] = 17803 , [
1476616461654
] = 18000 , [1476616211921] =
34729 , [14766162119210] = nil } , [8] = { [1476616211922] =
-- [3] = {
1 } } , notes = { a = [[ b } } } ]] , b = [=[
} ]] } { -- ]=] , 'it\\'s } {' , c = { { { } } , true } } } After = { actionEvents = { [5] = { 1 } } }
""",
]
WANT = sorted([(1476615547158, 1966, None, None), (1476615552665, 1966, None, None), (1476615552665, 1966, None, None),
               (1476616461654, None, 0, 18000), (1476616211921, None, 0, 34729), (1476616211922, None, 8, 1)], key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.select(F.unix_millis("timestamp"), "action.spellId", "damage.spellId",
                                                "damage.amount").collect()), key=repr)


def _local(text):
    out = []
    for damage, spell, ms, amounts in events(iter(text.split("\n")), "WTFTestAddonData", "raise", "ignore", "here"):
        out += [(int(t), None, spell, amounts[i]) if damage else (int(t), spell, None, None) for i, t in enumerate(ms)]
    return sorted(out, key=repr)


@pytest.fixture
def split_bytes(spark):
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, str(n))
    spark.conf.set(name, old)


def test_any_layout_reads_alike(spark, tmp_path, split_bytes):
    for n, text in enumerate([ONE_PER_LINE, *FREE]):
        assert _local(text) == WANT
        (tmp_path / f"d{n}.lua").write_text(text)
    for size in (150, 1 << 20):
        split_bytes(size)
        assert _rows(read_event_dump(spark, str(tmp_path))) == sorted(WANT * 3, key=repr)


def test_random_breaks_read_alike(spark, tmp_path, split_bytes):
    """Line ends at random places between tokens, in one folder of files."""
    rng = random.Random(3)
    tokens, want = [], []
    for line in ONE_PER_LINE.split("\n"):
        tokens += dumplex.lex_line(line, "")[0]
    parts = [x for t in tokens for x in (t.replace("[", "[ ").replace("]", " ] ").split() if not t.startswith('"') and '"' not in t else [t])]
    for n in range(3):
        text = "".join(p + rng.choice([" ", "\n", " -- } {\n", "\n\n", " --[[ } \n ]] "]) for p in parts)
        (tmp_path / f"d{n}.lua").write_text(text)
        assert _local(text) == WANT
        want += WANT
    split_bytes(300)
    assert _rows(read_event_dump(spark, str(tmp_path))) == sorted(want, key=repr)


FAULTS = ["[5] = { 1 2 },", "[5] = { , },", "[5] = { [1] 2, },", "[5] = { {1}, },", "[5] = { \"x\", },", "[5] = { (1), },",
          "[5] = { 1.5, },", "[5] = { true },", "[5] = { [1] = = 2 },", "[\"x\"] = { 1, },", "7,", "{ 1, },"]


def test_faults_are_errors_both_ways(spark, tmp_path):
    for n, line in enumerate(FAULTS):
        text = 'WTFTestAddonData = {\n["actionEvents"] = {\n' + line + "\n},\n}\n"
        (tmp_path / f"bad{n}.lua").write_text(text)
        with pytest.raises(ValueError, match="cannot read a line"):
            _local(text)
    kept = read_event_dump(spark, str(tmp_path), errors="column").where("_error is not null").select("_error").distinct().collect()
    assert {r._error for r in kept} == set(FAULTS)
    with pytest.raises(Exception, match="cannot read a line"):
        read_event_dump(spark, str(tmp_path / "bad3.lua")).collect()


def test_keyed_actions_and_deleted_entries(spark, tmp_path):
    text = 'WTFTestAddonData = { ["actionEvents"] = { [5] = { [1] = 10, [2] = 20, [1] = 30, [3] = 40, [3] = nil, 50 } },\n' \
           '["damageEvents"] = { [5] = { [10] = 1, [10] = nil, [20] = nil, [20] = 2, [30.0] = 4e0 } } }'
    path = tmp_path / "keyed.lua"
    path.write_text(text)
    want = sorted([(30, 5, None, None), (20, 5, None, None), (50, 5, None, None), (20, None, 5, 2), (30, None, 5, 4)], key=repr)
    assert _rows(read_event_dump(spark, str(path))) == _local(text) == want


def test_fractional_amounts_as_variants(spark, tmp_path):
    path = tmp_path / "mixed.lua"
    path.write_text('WTFTestAddonData = { ["damageEvents"] = { [3] = { [1476616000000] = 5.5, [2000] = 7, [3000] = 8.0, [4000] = -2.5e-1, [5000] = nil } } }')
    df = read_event_dump(spark, str(path), numbers="variant")
    assert df.schema == EVENT_DUMP_VARIANT_SCHEMA
    got = df.select(F.unix_millis("timestamp").alias("ms"), F.expr("schema_of_variant(damage.amount)").alias("type"),
                    F.expr("cast(damage.amount as double)").alias("value")).collect()
    assert sorted(map(tuple, got)) == [(2000, "BIGINT", 7.0), (3000, "BIGINT", 8.0), (4000, "DOUBLE", -0.25), (1476616000000, "DOUBLE", 5.5)]
    with pytest.raises(ValueError):
        read_event_dump(spark, str(path), numbers="float")


def test_registered_format(spark, tmp_path):
    register_event_dump(spark)
    for n, text in enumerate([ONE_PER_LINE, *FREE]):
        (tmp_path / f"d{n}.lua").write_text(text)
    df = spark.read.format("keelson_dump").option("partitionBytes", 100).load(str(tmp_path / "*.lua"))
    assert df.schema == EVENT_DUMP_SCHEMA and _rows(df) == sorted(WANT * 3, key=repr)
    assert len(EventDumpReader({"path": str(tmp_path), "partitionBytes": "100"}).partitions()) == 3
    assert len(EventDumpReader({"path": f"file://{tmp_path}"}).partitions()) == 1
    df.createOrReplaceTempView("dump_format")
    assert spark.sql("select * from dump_format limit 10").count() == 10
    spark.sql(f"create or replace temporary view dump_using using keelson_dump options (path '{tmp_path}')")
    assert spark.sql("select count(*) as n from dump_using where damage.amount = 18000").first().n == 3


def test_registered_format_pushes_times_and_checks_options(spark, tmp_path):
    register_event_dump(spark)
    (tmp_path / "d.lua").write_text(ONE_PER_LINE)
    df = spark.read.format("keelson_dump").load(str(tmp_path / "d.lua"))
    cut = F.timestamp_millis(F.lit(1476616211922))
    assert [r[0] for r in _rows(df.where(F.col("timestamp") >= cut))] == [1476616211922, 1476616461654]
    assert [r[2] for r in _rows(df.where(F.col("timestamp") == cut))] == [8]
    with pytest.raises(Exception, match="Path is required"):
        spark.read.format("keelson_dump").load().collect()
    with pytest.raises(ValueError, match="Path is required"):
        EventDumpReader({})
    with pytest.raises(FileNotFoundError):
        EventDumpReader({"path": str(tmp_path / "none*")}).partitions()
    with pytest.raises(ValueError):
        EventDumpReader({"path": "x", "errors": "column"})
    reader = EventDumpReader({"path": str(tmp_path)})
    import datetime as dt

    from pyspark.sql.datasource import EqualTo, GreaterThan
    filters = [GreaterThan(("timestamp",), dt.datetime(2016, 10, 16, 11, 10, tzinfo=dt.timezone.utc)), EqualTo(("action", "spellId"), 5)]
    assert list(reader.pushFilters(filters)) == filters and len(reader.bounds) == 1
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3
