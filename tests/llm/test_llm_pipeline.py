from collections import Counter

import corpus_pipeline
import pytest
from keelson.llm import catalog, curriculum, simhash
from keelson.llm.common import Scratch

SF01 = "/root/testdata/sf0.01"


def test_queries_are_registered():
    assert [n.split("_")[0] for n in sorted(catalog.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def stages(spark):
    scratch, out = Scratch(spark, "test"), []
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.stage(stage(spark, docs, SF01))
        out.append(docs)
    return out


def test_each_stage_takes_effect(stages, spark):
    docs, good, lines, single, mixed, packed = stages
    assert all(s.columns == docs.columns for s in (good, lines, single, mixed))
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id for r in good.collect()}
    assert sum(q == 1 and d in kept for d, q in quality.items()) >= 0.98 * sum(quality.values())
    assert sum(q == 0 and d in kept for d, q in quality.items()) <= 0.15 * sum(1 - q for q in quality.values())
    assert sum(r.n_chars for r in lines.collect()) < sum(r.n_chars for r in good.collect()) and lines.count() == good.count()
    groups = simhash.near_duplicates(lines).select("component_id").distinct().count()
    assert single.count() == groups
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in simhash.near_duplicates(lines).collect()}
    taken = {r.doc_id: r.taken for r in curriculum.plan(single).collect()}
    stream = Counter(r.doc_id for r in mixed.collect())
    assert set(stream) == {d for d, t in taken.items() if t} and max(stream.values()) <= 2
    assert Counter(r.doc_id for r in packed.where("start = 0").collect()) == stream


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF01)
        assert docs.count() == 0
