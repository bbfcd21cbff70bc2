import re
from collections import Counter

import pytest
from keelson.llm import catalog, quality, rules
from keelson.llm.common import Scratch
from pyspark.sql import functions as F

SF01 = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_version(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_odd_rows(make_docs, odd_rows):
    more = ["a b c a b c", "a a a", "a a a a", "x y", "a b c d a b c e b c d", "#*$ %& |<>", "l 1\nl 1\n\n \nl 1 \r\nl 1", "\n", "a  b\tc\x0ba\x0cb\rc",
            "a b", "é𝄞 é𝄞 é𝄞 é𝄞", "ab c a bc ab c", "a b c d e " * 40, "\x00 \x85  "]
    rows = odd_rows + [(50 + i, t) for i, t in enumerate(more)]
    docs = make_docs(rows)
    done = rules.measure(docs)
    assert done.columns == [*docs.columns, "stats"]
    got = sorted((str(r.doc_id), r.text or "", *[r.stats[c] for c in BASE]) for r in done.collect())
    assert got == sorted((str(d), t or "", *plain_version(t)) for d, t, *_ in rows)
    assert rules.measure(make_docs([])).collect() == []
    judged = rules.judge(done, rules.DecisionList())
    assert all(r.kept == (not r.stats.base_failed) for r in judged.collect())


def test_a_long_text_with_repeats(make_docs, odd_rows):
    long = odd_rows[10][1]
    text = long + " " + long[:5000] + " tail " + long[-4000:]
    stats = rules.measure(make_docs([(1, text)])).first().stats
    assert tuple(stats[c] for c in BASE) == plain_version(text)


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    """Rows whose label follows from two rules: many symbols, or capitals in long lines."""
    rows = []
    for i in range(900):
        symbols, capitals, lines = i % 7 == 0, i % 5 == 0, 1 + i % 4
        word = lambda k: f"{'W' if capitals and k % 2 else 'w'}{i}n{k}{'#' if symbols and k % 3 == 0 else ''}"
        text = "\n".join(" ".join(word(60 * j + k) for k in range(60 if lines < 3 else 20)) for j in range(lines))
        rows.append((i, text, int(not (symbols or capitals and lines < 3))))
    docs = rules.measure(make_docs([r[:2] for r in rows]))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    return Scratch(spark, "test").stage(rules.label_rows(docs, labels, "quality").where("not stats.base_failed").select("doc_id", "stats", "label"))


def test_learns_conjunctions_and_reads_as_conditions(labelled):
    found = rules.learn(labelled)
    assert all(isinstance(c.value, int) and c.stat in rules.RATES for r in found.rules for c in r.conditions)
    assert any(len(r.conditions) >= 2 for r in found.rules)
    judged = rules.judge(labelled, found)
    assert judged.where("kept <> (label = 1)").count() == 0
    assert "CASE WHEN" in str(found.label()) and str(found).endswith("else -> 1")
    again = rules.learn(labelled.repartition(7))
    assert again == found


def test_labels_of_one_kind_repeats_and_null_ids(spark, labelled, make_docs):
    assert rules.learn(labelled.where("label = 1")) == rules.DecisionList()
    assert rules.learn(labelled.where("false")) == rules.DecisionList()
    base = rules.learn(labelled)
    # a hot row is one counted row of the staged table, whatever its number
    hot = labelled.where("doc_id = 1").crossJoin(spark.range(20_000)).drop("id")
    found = rules.learn(labelled.unionByName(hot))
    assert rules.judge(labelled, found).where("kept <> (label = 1)").count() <= rules.judge(labelled, base).where("kept <> (label = 1)").count() + 20
    docs = rules.measure(make_docs([(None, "a"), (1, "a"), (1, "a")]))
    labels = spark.createDataFrame([(None, 1), (1, 1), (1, 0), (2, None)], "doc_id long, quality int")
    assert [r.label for r in rules.label_rows(docs, labels, "quality").collect()] == [0, 0]


def test_levels_keep_two_digits(spark):
    values = [0, 7, 10, 99, 100, 104, 999, 1234, 99999, 10 ** 12 + 5]
    df = spark.createDataFrame([(v,) for v in values], "x long").select("x", F.expr(rules._level("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == {v: int(str(v)[:2] + "0" * (len(str(v)) - 2)) if v > 99 else v for v in values}


def test_query_against_a_plain_version_and_held_out_labels(spark):
    rows = {r.doc_id: r for r in catalog.QUERIES["op13_quality_rules"](spark, SF01).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert set(rows) == set(docs)
    for d, text in docs.items():
        assert tuple(rows[d][c] for c in BASE) == plain_version(text)
        assert not (rows[d].base_failed and rows[d].kept)
    labels = (spark.read.parquet(f"{SF01}/labels.parquet").where(quality.held_out(F.col("doc_id"))).collect())
    decided = [(rows[r.doc_id].kept, r.quality) for r in labels if not rows[r.doc_id].base_failed]
    assert sum(k == bool(q) for k, q in decided) >= 0.95 * len(decided)


def test_no_python_in_the_plan(spark, make_docs):
    plan = rules.measure(make_docs([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
