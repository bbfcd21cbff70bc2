import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from keelson.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, k=20):
    docs = [(d, Counter(terms(t))) for d, t, *_ in docs if terms(t)]
    total, words = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        found = []
        for d, c in docs:
            m = 100 - 25 + 25 * sum(c.values()) * total // words
            score = sum(n * floor(1000 * log((2 * total + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, n in Counter(terms(text)).items() if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def check(spark, make_docs, docs, items, **kwargs):
    table = spark.createDataFrame(items, "item_id long, text string")
    got = search.search(make_docs(docs, 5), table, **kwargs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(docs, items, kwargs.get("k", 20))


def corpus(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Río", "ÉTÉ", "été", "𝄞x", "don't", "A-b_c", "42"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 80))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, make_docs, seed):
    docs = list(enumerate(corpus(seed, 400)))
    check(spark, make_docs, docs, list(enumerate(corpus(seed + 10, 23))))


def test_ties_repeats_and_small_blocks(spark, make_docs):
    docs = [(i, "same words here") for i in range(200)] + [(500, "same words here")] * 30 + list(enumerate(corpus(3, 50), 600))
    items = [(1, "same"), (1, "same"), (1, "words here"), (2, "w0 w0 w1"), (3, "nowhere to be found"), (4, "same w3 w2 Río été")]
    check(spark, make_docs, docs, items, block_terms=2)
    check(spark, make_docs, docs, items, k=3)


def test_odd_rows(spark, make_docs, odd_rows):
    items = [(1, None), (2, ""), (3, " ,. "), (4, "word"), (None, "river stone"), (5, odd_rows[4][1]), (6, odd_rows[10][1]), (7, "é ŝ 𝄞 \x85")]
    check(spark, make_docs, odd_rows, items)


def test_empty_tables(spark, make_docs):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert search.search(make_docs([]), items).collect() == []
    assert search.search(make_docs([(1, None), (2, " . ")]), items).collect() == []
    assert search.search(make_docs([(1, "word")]), items.limit(0)).collect() == []


def small_tree(docs, items, k, seeds=()):
    block = search.Items.of([(i, Counter(search.terms_of(t.encode()))) for i, t in items])
    counts = [Counter(search.terms_of(t.encode())) for _, t in docs]
    df = Counter(block.number[t] for c in counts for t in c if t in block.number)
    words = sum(sum(c.values()) for c in counts)
    query = search.Query.of(block, len(docs), words, df)
    rows = [[(block.number[t], n) for t, n in c.items() if t in block.number] for c in counts]
    flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 2)
    start = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    m = np.array([query.size_factor(sum(c.values())) for c in counts])
    value = 10 ** 9 * flat[:, 1] // (1000 * flat[:, 1] + 12 * np.repeat(m, np.diff(start)))
    best = search.Best(len(items), k, dict(seeds))
    return search.DualTree(query, best, search.Rows(start, flat[:, 0], value), np.arange(len(docs)), np.zeros(len(docs), bool)), best


def test_node_bounds_hold_and_pairs_are_pruned():
    topic = lambda seed, n: list(enumerate(" ".join(f"t{(i * 7 + k) % 90}x{k}" for k in range(8)) + " " + t
                                           for i, t in enumerate(corpus(seed, n, 400))))
    docs, items = topic(5, 3000), topic(6, 40)
    tree, best = small_tree(docs, items, 5)
    exact = np.array([tree.bounds(0, i, 0, np.arange(len(docs))) for i in range(len(items))])
    for item_level in range(len(tree.query.tree)):
        width = search.ITEM_FAN ** item_level
        for level in range(len(tree.tree)):
            span = 1 if level == 0 else search.LEAF_DOCS * search.FAN ** (level - 1)
            for node in range(len(tree.query.tree[item_level])):
                bound = tree.bounds(item_level, node, level, np.arange(len(tree.tree[level])))
                below = exact[node * width:(node + 1) * width].max(axis=0)
                assert (bound >= np.maximum.reduceat(below, np.arange(0, len(docs), span))).all()
    tree.bounded = 0
    tree.run()
    assert tree.bounded < 0.6 * len(docs) * len(items)
    want = [(i, r, d, s) for i, r, d, s in brute_force(docs, items, 5)]
    got = [(item, r + 1, int(d), int(s)) for item, (score, ids, _) in enumerate(best.found) for r, (s, d) in enumerate(zip(score, ids))]
    assert sorted(got, key=str) == want
    # with the final floors as seeds the same results come from fewer bounds
    before = tree.bounded
    again, same = small_tree(docs, items, 5, {i: (best.score[i], best.id[i]) for i in range(len(items))})
    again.run()
    assert again.bounded <= before
    assert all(np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) for a, b in zip(best.found, same.found))
