"""S1, S1a-S1c on small files of the dump grammar and a generated dump spread over many splits."""

import pytest
from pyspark.sql import functions as F

from keelson.sources.eventdump import EVENT_DUMP_SCHEMA, read_event_dump

DUMP_A = """
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
\t},
}
OtherAddon = {
\t["actionEvents"] = {
\t\t[5] = {
\t\t\t1, -- [1]
\t\t},
\t},
}
"""

DUMP_B = """WTFTestAddonData = {
\t["damageEvents"] = {
\t\t[3] = {
\t\t\t[1476616000000] = 5,
\t\t},
\t},
\t["somethingElse"] = {
\t\t[1] = {
\t\t\t[2] = 3,
\t\t},
\t},
}
"""

BAD = """WTFTestAddonData = {
\t["damageEvents"] = {
\t\t[3] = {
\t\t\t[1476616000000] = 5.5,
\t\t},
\t},
}
"""


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_two_files_and_rules(spark, tmp_path):
    _write(tmp_path, "a.lua", DUMP_A)
    _write(tmp_path, "b.lua", DUMP_B)
    df = read_event_dump(spark, str(tmp_path / "*.lua"))
    assert df.schema == EVENT_DUMP_SCHEMA
    rows = df.select(F.unix_millis("timestamp").alias("ms"), "action.spellId", "damage.spellId", "damage.amount")
    got = sorted(tuple(r) for r in rows.collect())
    assert got == sorted([
        (1476615547158, 1966, None, None),
        (1476615552665, 1966, None, None),   # equal action times are kept
        (1476615552665, 1966, None, None),
        (1476616461654, None, 0, 18000),     # repeated damage key: the last line wins
        (1476616211921, None, 0, 34729),
        (1476616000000, None, 3, 5),
    ])


def test_errors(spark, tmp_path):
    path = _write(tmp_path, "bad.lua", BAD)
    with pytest.raises(Exception):
        read_event_dump(spark, path).collect()
    assert read_event_dump(spark, path, errors="drop").count() == 0
    col = read_event_dump(spark, path, errors="column").collect()
    assert len(col) == 1 and "5.5" in col[0]["_error"]
    with pytest.raises(ValueError, match="Path is required"):
        read_event_dump(spark, "")
    other = _write(tmp_path, "b.lua", DUMP_B)
    with pytest.raises(Exception):
        read_event_dump(spark, other, unknown_sections="raise").collect()


def _generated_dump(tmp_path, spells=13, per_spell=80, damage_spells=11, per_damage=240):
    """A dump of the same grammar with known content, and the rows it must give."""
    lines, want = ["WTFTestAddonData = {", '\t["actionEvents"] = {'], []
    t = 1476615543972
    for s in range(spells):
        lines.append(f"\t\t[{1000 + s * 7}] = {{")
        for i in range(per_spell):
            ms = t + s * 100_000 + i * 997
            lines.append(f"\t\t\t{ms}, -- [{i + 1}]")
            want.append((ms, 1000 + s * 7, None, None))
        lines.append("\t\t},")
    lines += ["\t},", '\t["damageEvents"] = {']
    for s in range(damage_spells):
        lines.append(f"\t\t[{s * 3}] = {{")
        last = {}
        for i in range(per_damage):
            ms = t + (i % 200) * 1_003  # keys repeat: the last line wins
            amount = 1000 + s * 10_000 + i
            lines.append(f"\t\t\t[{ms}] = {amount},")
            last[ms] = amount
        want += [(ms, None, s * 3, amount) for ms, amount in last.items()]
        lines.append("\t\t},")
    lines += ["\t},", "}"]
    path = tmp_path / "generated.lua"
    path.write_text("\n".join(lines) + "\n")
    return str(path), sorted(want, key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.select(F.unix_millis("timestamp"), "action.spellId", "damage.spellId",
                                                "damage.amount").collect()), key=repr)


def test_generated_dump_in_sql(spark, tmp_path):
    path, want = _generated_dump(tmp_path)
    df = read_event_dump(spark, path)
    assert _rows(df) == want
    df.createOrReplaceTempView("dump_view")
    assert spark.sql("select * from dump_view limit 10").count() == 10


def test_one_file_over_many_splits(spark, tmp_path):
    path, want = _generated_dump(tmp_path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() >= 10
        assert _rows(read_event_dump(spark, path)) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_splits_that_move_between_building_and_running(spark, tmp_path):
    path, want = _generated_dump(tmp_path)
    names = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")
    old = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.set(names[1], "64")
        for built, run in (("4", "13"), ("16", "2")):
            spark.conf.set(names[0], built)
            df = read_event_dump(spark, path)
            spark.conf.set(names[0], run)
            spark.conf.set(names[2], "5000")
            assert _rows(df) == want
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("split", [64, 200, 1 << 20])
def test_other_globals_around_the_table(spark, tmp_path, split):
    text = "\n".join([
        "Before = 5", "Name = \"x { y\"", "Other = {", "\t[1] = {", "\t\t{", "\t\t\t7, -- [1]", "\t\t}, -- [1]", "\t},", "}",
        "WTFTestAddonData = {", '\t["actionEvents"] = {', "\t\t[42] = {", "\t\t\t1476615543972, -- [1]", "\t\t},", "\t},",
        '\t["damageEvents"] = {', "\t\t[43] = {", "\t\t\t[1476615543973] = 9,", "\t\t},", "\t},", "}",
        "OtherVar = 5", "Flag = true", "Third = {", '\t["actionEvents"] = {', "\t\t[1] = {", "\t\t\t3,", "\t\t},", "\t},", "}", "Last = nil"])
    path = tmp_path / "globals.lua"
    path.write_text(text + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        assert _rows(read_event_dump(spark, str(path))) == sorted(
            [(1476615543972, 42, None, None), (1476615543973, None, 43, 9)], key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_value_after_its_section_closed_is_an_error(spark, tmp_path):
    path = tmp_path / "stray.lua"
    path.write_text('WTFTestAddonData = {\n\t["actionEvents"] = {\n\t\t[42] = {\n\t\t},\n\t},\n\t5,\n}\n')
    with pytest.raises(Exception, match="cannot read a line"):
        read_event_dump(spark, str(path)).collect()
