import re

import xxhash

from keelson.llm import simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = {}
    for g, (d, *_rest) in zip(group, rows):
        ids[g] = min((x for x in (ids.get(g), d) if x is not None), default=None)
    return sorted(((d, f"{f:016x}", ids[g]) for (d, *_rest), f, g in zip(rows, fps, group)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_rows_match_plain_version(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    assert got(simhash.near_duplicates(docs)) == plain_components(odd_rows)


def test_empty_table(make_docs):
    docs = make_docs([])
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(docs).count() == 0


def test_long_postings_give_the_same_components(spark):
    base = 0x0123456789ABCDEF
    fps = [base ^ (1 << i) ^ (1 << j) for i in range(0, 64, 5) for j in range(i, 64, 7)] + [base, 0, 7, 0xFFFF0000FFFF0000]
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long")

    def parts(posting_rows):
        group = {f: f for f in signed}
        for u, v in simhash.links(distinct, posting_rows).collect():
            assert bin((u ^ v) & (1 << 64) - 1).count("1") <= 2
            old, new = group[u], group[v]
            group = {k: new if g == old else g for k, g in group.items()}
        return sorted(sorted(k for k in group if group[k] == g) for g in set(group.values()))

    expected = {f: f for f in signed}
    for x in signed:
        for y in signed:
            if bin((x ^ y) & (1 << 64) - 1).count("1") <= 2:
                old, new = expected[x], expected[y]
                expected = {k: new if g == old else g for k, g in expected.items()}
    expected = sorted(sorted(k for k in expected if expected[k] == g) for g in set(expected.values()))
    assert parts(10_000) == expected and parts(1) == expected


def test_keep_one_keeps_the_least_of_each_group(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    groups = {c for _, _, c in plain_components(odd_rows)}
    assert {i for i, _ in ids} == groups and len(ids) == len(groups)
