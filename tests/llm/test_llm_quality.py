import zlib

import numpy as np
from llm_corpus import prose
from pyspark.sql import functions as F

from keelson.llm import quality

SF01 = "/root/testdata/sf0.01"


def test_pairs_by_the_identity_equal_pairs_one_by_one():
    rng = np.random.default_rng(3)
    m = quality.Machine(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, quality.RANK)))
    i, x = quality.features("some text with words with words | 12 !!")
    slow = m.w0 + sum(m.w[a] * x[p] for p, a in enumerate(i)) + sum(
        m.v[i[p]] @ m.v[i[q]] * x[p] * x[q] for p in range(len(i)) for q in range(p + 1, len(i)))
    assert np.isclose(m.margins(i, x, np.array([0]))[0], slow)


def test_held_out_accuracy_and_reruns(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    machine = quality.fit(docs, labels)
    again = quality.fit(docs.repartition(5), labels.repartition(3))
    assert machine.w0 == again.w0 and (machine.v == again.v).all()
    scored = quality.score(docs, machine)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.2
    changed = docs.select((F.col("doc_id") * 7).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(None).alias("source"))
    moved = {r.doc_id // 7: r.score for r in quality.score(changed, machine).collect()}
    assert moved == {r.doc_id: r.score for r in scored.collect()}  # only the text counts


def test_odd_rows(make_docs, odd_rows, spark):
    docs = make_docs(odd_rows)
    labels = spark.createDataFrame([(5, 1), (6, 1), (7, 0), (8, 0), (9, None), (None, 1), (77, 1)], "doc_id long, quality int")
    machine = quality.fit(docs, labels)
    found = quality.score(docs, machine).collect()
    assert len(found) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    kept = quality.keep_good(docs, machine)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in found)


def test_empty_tables_and_one_label(make_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(make_docs([]), quality.fit(make_docs([]), none)).collect() == []
    docs = make_docs([(i, prose(i, 9)) for i in range(6)])
    assert {round(r.score, 6) for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(6)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in quality.score(docs, quality.fit(docs, ones)).collect())


def test_a_repeated_labelled_id_is_one_row(make_docs, spark, odd_rows):
    rows = [(i, t) for i, (_, t, *_) in enumerate(odd_rows)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(rows))] + [(None, 1), (3, 7)], "doc_id long, quality int")
    docs = make_docs(rows)
    hot = docs.unionByName(docs.where("doc_id = 7").limit(1).select(
        "doc_id", *[c for c in docs.columns if c != "doc_id"]).crossJoin(spark.range(100_000).drop("id")).withColumn("text", F.lit("zz, the same other text")))
    machine = quality.fit(hot, labels)
    assert quality.score(docs, machine).count() == len(rows)
    again = quality.fit(hot.repartition(11), labels)
    assert again.w0 == machine.w0
