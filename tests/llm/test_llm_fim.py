import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from keelson.llm import catalog, fim
from pyspark.sql import functions as F


def plain_version(doc_id, text):
    """By slices of the text, without bytes or rotations."""
    text = text or ""
    digest = hashlib.sha256(b"1:" + ("" if doc_id is None else str(doc_id)).encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aé𝄞<>PSM\x00 \n", max_size=40), st.integers(0, 10 ** 6))
def test_cut_and_back(text, doc_id):
    n, form, a, b, out = fim.cut_and_rotate(text.encode(), fim.draws(str(doc_id)))
    assert (n, form, a, b, out.decode()) == plain_version(doc_id, text)
    assert fim.rotate_back(out, form).decode() == text


@pytest.mark.parametrize("n", [0, 1, 2, 3, 65_535, 65_536, 200_001])
def test_blocks_larger_than_a_step_are_exchanged(n):
    data = bytes(i * 7 % 251 for i in range(n))
    for cut in {0, 1 if n else 0, n // 3, n}:
        buffer = bytearray(data)
        fim.exchange(buffer, 0, cut, n)
        assert bytes(buffer) == data[cut:] + data[:cut]


def test_odd_rows(make_docs, odd_rows):
    rows = odd_rows + [(30 + i, t) for i, t in enumerate(["<P>", "a<S", "S><M", "x<M>y", "<", ">" * 9, "<P <S <M" * 5])]
    docs = make_docs(rows)
    done = fim.fill_in_middle(docs).withColumn("back", fim.restore(F.col("fim.output"), F.col("fim.form")))
    assert done.columns == [*docs.columns, "fim", "back"]
    got = sorted((str(r.doc_id), r.text or "", tuple(r.fim), r.back) for r in done.collect())
    assert got == sorted((str(d), t or "", plain_version(d, t), t or "") for d, t, *_ in rows)
    kept = done.select("row", "a").distinct().collect()
    assert kept and all(r == ("x", "x") for r in kept)


def test_a_column_of_the_result_name_is_replaced_and_empty_tables_stay_empty(make_docs):
    docs = make_docs([(1, "some text here")]).withColumn("fim", F.lit(1))
    assert fim.fill_in_middle(docs).first().fim.n == 14
    assert fim.fill_in_middle(make_docs([])).collect() == []


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = catalog.QUERIES["op11_fill_in_middle"](spark, sf).collect()
    assert len(rows) == len(texts) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        n, form, a, b, out = plain_version(r.doc_id, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, a, b, sha(out), sha(texts[r.doc_id] or ""))
