import random

from llm_corpus import prose

from keelson.llm import lines

BLANKS = " \t\n\v\f\r"


def plain(rows, similarity=0.8):
    """All pairs of distinct lines by exact Jaccard; the first place of each component keeps its line."""
    places = {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        for i, x in enumerate((t or "").split("\n")):
            if x.strip(BLANKS):
                places.setdefault(x.strip(BLANKS), []).append((d, i))
    names = list(places)
    bags = [{x[i:i + 5] for i in range(max(1, len(x) - 4))} for x in names]
    group = list(range(len(names)))
    for i in range(len(names)):
        for j in range(i):
            both = len(bags[i] & bags[j])
            if group[i] != group[j] and both >= similarity * len(bags[i] | bags[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    gone = set()
    for g in set(group):
        gone |= set(sorted(p for x, h in zip(names, group) if h == g for p in places[x])[1:])
    return {d: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t, *_ in rows}


def planted():
    rng = random.Random(2)
    pool = [prose(i, rng.randrange(6, 40)) for i in range(40)]
    def near(x):
        w = x.split()
        w[rng.randrange(len(w))] = rng.choice(["", "changed", "x"])
        return " ".join(w)
    rows = []
    for d in range(50):
        own = [prose(1000 + 10 * d + k, rng.randrange(5, 30)) for k in range(3)]
        some = [near(rng.choice(pool)) if rng.random() < 0.6 else rng.choice(pool) for _ in range(4)]
        rows.append((d, "\n".join(rng.sample(own + some + ["", "  ", "ok", " ok ", "ab"], 12))))
    return rows


def test_planted_lines_match_plain_version(make_docs):
    rows = planted()
    want = plain(rows)
    found = lines.dedup_lines(make_docs(rows), removed="n_removed").collect()
    assert {r.doc_id: r.text for r in found} == want
    assert sum(r.n_removed for r in found) > 50
    blocks = lines.dedup_lines(make_docs(rows), block_lines=2).collect()
    assert {r.doc_id: r.text for r in blocks} == want


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert len(found) == len(odd_rows)
    texts = dict(odd_rows[:6])
    assert (1, None) in found and (2, "") in found and (3, " \n\t ") in found and (4, "word") in found
    assert (5, texts[5]) in found  # the least id keeps the shared line
    assert found.count((6, "")) == 2 and (None, "") in found and (None, None) in found
    assert sum(t is not None and t.startswith("the") or bool(t) for _, t in found) >= 5


def test_rows_equal_in_id_and_text_keep_a_line_once(make_docs):
    out = lines.dedup_lines(make_docs([(1, "one line\n\nother"), (1, "one line\n\nother")])).collect()
    assert sorted(r.text for r in out) == ["", "one line\n\nother"]


def test_hashed_shingles_count_like_shingles():
    texts = [prose(3, 60), "ab", "", "𝄞é𝄞é𝄞é𝄞", "aaaaaaaaaa", prose(3, 59)]
    bags = lines.shingle_hashes(texts)
    plain_bags = [lines.shingles(t) for t in texts]
    for x, a in zip(bags, plain_bags):
        assert len(x) == len(a)
        assert [len(x & y) for y in bags] == [len(a & b) for b in plain_bags]


def test_empty_table(make_docs):
    assert lines.dedup_lines(make_docs([])).collect() == []


def test_collisions_over_batches():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows = sorted(zip(rng.integers(0, 40, 300).tolist(), rng.integers(0, 9, 300).tolist()))
    members = {}
    for k, x in rows:
        members.setdefault(k, set()).add(x)
    want = sorted((k, x) for k, s in members.items() if len(s) > 1 for x in s)
    for size in (1, 2, 3, 7, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i:i + size]], pa.int64()) for c in (0, 1)], names=["key", "line"])
                   for i in range(0, 300, size)]
        found = [(k, x) for b in lines._collisions(iter(batches)) for k, x in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(found) == want


def test_unsorted_keys_of_a_partition_collide_alike():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    rows = list(zip(rng.integers(-40, 40, 300).tolist(), rng.integers(0, 9, 300).tolist()))
    rows += [(100, 5)] * 3 + [(101, 5)]  # one line alone, however often
    members = {}
    for k, x in rows:
        members.setdefault(k, set()).add(x)
    want = sorted((k, x) for k, s in members.items() if len(s) > 1 for x in s)
    for size in (1, 7, 304):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i:i + size]], pa.int64()) for c in (0, 1)], names=["key", "line"])
                   for i in range(0, 304, size)]
        assert [(k, x) for b in lines._met(iter(batches)) for k, x in zip(*(c.to_pylist() for c in b.columns))] == want
    assert list(lines._met(iter([]))) == [] and sum(b.num_rows for b in lines._met(iter([b.slice(0, 0) for b in batches]))) == 0


def test_sorted_shingles_and_keys_do_not_depend_on_the_lines_beside():
    texts = [prose(3, 60), "ab", "𝄞é𝄞é𝄞é𝄞", "aaaaaaaaaa", prose(4, 59), prose(5, 200)]
    bags = lines.shingle_arrays(texts)
    for x, a in zip(bags, texts):
        assert x.tolist() == sorted(lines.shingle_hashes([a])[0])
        for y, b in zip(bags, texts):
            assert lines.shared(x, y) == len(lines.shingles(a) & lines.shingles(b))
    assert lines.band_keys(texts).tolist() == [lines.band_keys([t])[0].tolist() for t in texts]


def test_packed_keys_come_back_in_their_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = list(zip(rng.integers(-1 << 63, 1 << 63, 500).tolist(), rng.integers(-9, 9, 500).tolist()))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i:i + 60]], pa.int64()) for c in (0, 1)], names=["key", "line"])
               for i in range(0, 500, 60)]
    monkeypatch.setattr(lines, "PACKED_KEYS", 150)
    for parts in (1, 7, 1 << 17):
        packed = list(lines._packed(parts, iter([*batches, batches[0].slice(0, 0)])))
        assert len(packed) == 3 and all(b.num_rows <= min(parts, 180) for b in packed)
        for b in packed:
            for part, row in zip(b.column("part").to_pylist(), range(b.num_rows)):
                own = next(lines._unpacked([b.slice(row, 1)])).column("key").to_pylist()
                assert own and {k % (1 << 64) % parts for k in own} == {part}
        assert sorted((k, x) for b in lines._unpacked(packed) for k, x in zip(*(c.to_pylist() for c in b.columns))) == sorted(rows)
    assert list(lines._packed(3, iter([]))) == [] == list(lines._unpacked([]))


def test_band_keys_cross_the_shuffle_packed(make_docs, tmp_path):
    """A signing task hands over at most one row for each part, not one for each key."""
    from keelson.llm.common import Scratch, row_key

    docs = make_docs([(i, "\n".join(prose(10 * i + k, 12) for k in range(10))) for i in range(60)], parts=2)
    key, staged = row_key(), []

    class Seen(Scratch):
        def stage(self, df):
            staged.append(df._jdf.queryExecution().optimizedPlan().toString())
            return super().stage(df)

    lines.similar_lines(docs.select("doc_id", "text", key["a"].alias("a"), key["b"].alias("b")), Seen(docs.sparkSession, "seen"))
    met = next(p for p in staged if p.count("MapInArrow") == 2)
    assert "keys#" in met and "lines#" in met and "part#" in met


def test_lines_of_bytes_are_lines_of_text():
    import pyarrow as pa

    texts = [None, "", "a\n b \n\n\v\f\u00a0\u2003x\x85\n", "𝄞é\r\n\t\u2028—\n\x1c", "\n" + prose(3, 9)]
    found = list(lines._named(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])))
    for text, own in zip(texts, found, strict=True):
        want = [(i, x.strip(BLANKS)) for i, x in enumerate((text or "").split("\n")) if x.strip(BLANKS)]
        assert [(i, x.decode()) for i, x, _ in own] == want
        assert lines._signed([h for _, _, h in own]).tolist() == [lines.line_id(x) for _, x in want]


def test_band_keys_do_not_depend_on_the_parts_their_runs_are_hashed_in(monkeypatch):
    texts = [prose(3, 60), "ab", "𝄞é𝄞é𝄞é𝄞", "aaaaaaaaaa", "abcde", prose(5, 200)]
    want = lines.band_keys(texts).tolist()
    for size in (1, 4, 5, 97):
        monkeypatch.setattr(lines, "_RUNS", size)
        assert lines.band_keys(texts).tolist() == want
    assert lines.band_keys(["ab"]).tolist() == [want[1]]
