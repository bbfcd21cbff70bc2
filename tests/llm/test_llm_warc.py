import gzip
import hashlib
import html as html_module

import duckdb
import pytest

from keelson.llm import warc

PAGES = [
    (1, "http://a.example/1", "<html><head><title>A &amp; B\n title</title><style>p{}</style></head><body><p>One&nbsp;two<br>three"
     "</p><script>var t='</p>';</script><!-- <p>no</p> --><a href='/x?a=1&amp;b=2'>li<b>nk</b></a><A class=z HREF=\"/y\">y</A></body></html>"),
    (2, None, "plain &lt;text&gt; &#65;&#x42;&#38;lt; &#xD800; &#0; &copy; 5 < 6 &unknown;"), (3, "http://a.example/3", None),
    (4, "http://a.example/4", ""), (None, "http://a.example/5", "<div>Größe 𝄞</div>\r\n\r\n<div>x\ty</div>"), (4, "http://a.example/4", ""),
    (6, "u", "<p>" + "long word " * 60_000 + "</p>"), (7, "u", "<script>never closed"), (8, "u", "<p <b> odd & tags"),
]
SCHEMA = "page_id long, url string, html string, block string, record_id string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "extra", "extra") for p in PAGES], SCHEMA)


def test_rows_match_duckdb(pages):
    got = warc.derive(warc.responses(pages))
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    want = con.execute(warc.derive_sql())
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted((tuple(r) for r in got.select(*names).collect()), key=repr)
    assert len(rows) == 2 * len(PAGES) and rows == sorted(want.fetchall(), key=repr)


def test_text_and_links(pages):
    rows = {(r.page_id, r.record_type): r for r in warc.derive(warc.responses(pages)).collect()}
    one, meta = rows[1, "conversion"], rows[1, "metadata"]
    assert one.block == "One two\nthree\nlinky"
    assert "title: A & B title\r\n" in meta.block and "outlink: /x?a=1&b=2\r\noutlink: /y\r\n" in meta.block
    assert rows[2, "conversion"].block == "plain <text> AB&lt; � � © 5 < 6 &unknown;"
    assert rows[3, "conversion"].block == rows[4, "conversion"].block == ""
    assert rows[None, "conversion"].block == "Größe 𝄞\nx y"
    assert one.refers_to == meta.refers_to and one.record_id in meta.block and one.record_id != meta.record_id
    body = PAGES[0][2].encode()
    assert one.source_digest == "sha256:" + hashlib.sha256(body).hexdigest() and one.source_digest in meta.block
    assert f"source-status: HTTP/1.1 200 OK\r\nsource-Content-Type: text/html; charset=utf-8\r\nsource-Content-Length: {len(body)}\r\n" in meta.block
    assert one.block_digest == "sha256:" + hashlib.sha256(one.block.encode()).hexdigest()
    assert len(rows[6, "conversion"].block) == len("long word " * 60_000) - 1


def test_references_agree_with_the_standard_library(spark):
    texts = ["&amp;lt;", "&lt;&gt;&quot;&apos;&hellip;", "&#169;&#x20AC;&#128512;", "no references & here;", "&euro;&times;&deg;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.unescape(warc.F.col("t")).alias("u"))
    assert all(r.u == html_module.unescape(r.t) for r in df.collect())


def test_files_read_back(pages, tmp_path):
    records = warc.derive(warc.responses(pages))
    warc.write(records, str(tmp_path / "w"))
    found = []
    for path in (tmp_path / "w").glob("part-*.gz"):
        data = gzip.decompress(path.read_bytes())
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n")
            n = int(fields["Content-Length"])
            block, data = rest[:n], rest[n:]
            assert data.startswith(b"\r\n\r\n")
            data = data[4:]
            assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
            found.append((fields["WARC-Type"], fields["WARC-Record-ID"], fields["WARC-Refers-To"], fields.get("WARC-Target-URI"), block.decode()))
    want = [(r.record_type, r.record_id, r.refers_to, r.target_uri, r.block) for r in records.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert warc.derive(warc.responses(spark.createDataFrame([], SCHEMA))).collect() == []
