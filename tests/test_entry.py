"""The driver contract: entry(), queries(), oracle_sql()."""

import __spark_entry__ as E


def test_registry_shape():
    qs, sqls = E.queries(), E.oracle_sql()
    assert len(qs) >= 60
    assert set(sqls) <= set(qs)
    # the corpus queries come with their package only
    assert ("pipeline" in qs) == any(k.startswith("op") for k in qs) == (E.llm_catalog is not None)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["click_id", "user_id", "click_ms", "view_id", "view_ms", "lag_ms"]
    assert df.count() >= 0


def test_some_queries_at_smoke_scale(spark):
    qs = E.queries()
    for name in ("w1_sliding_global", "w3_gap_fill", "p1_safe_double", "f7_token_counts"):
        assert qs[name](spark, "/root/testdata/sf0.001").count() > 0
