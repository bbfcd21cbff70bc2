import random

import numpy as np
from llm_corpus import prose

from keelson.llm import substring


def plain(rows, window=50):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    first = {}
    for (d, *_rest), w in zip(rows, words):
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i:i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, *_rest), w in zip(rows, words):
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i:i + window])] < d:
                    gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((d, len(w), len(gone), kept))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def planted():
    rng = random.Random(5)
    passage, short = prose(100, 64), prose(101, 49)
    rows = []
    for d in range(60):
        own = prose(200 + d, rng.randrange(0, 160))
        mid = [passage, short, passage + " " + passage, prose(102, 70) if d % 2 else "", ""][d % 5]
        rows.append((d, f"{own}\n{mid}\t{prose(300 + d, rng.randrange(0, 60))}"))
    rows += [(100 + i, rows[3][1]) for i in range(8)] + [(200, "the " * 300), (201, "the " * 120), (202, prose(100, 50))]
    return rows


def test_planted_repeats_match_plain_version(make_docs):
    rows = planted()
    want = plain(rows)
    assert sum(n for _, _, n, _ in want) > 1000
    assert got(substring.remove_repeats(make_docs(rows))) == want
    assert got(substring.remove_repeats(make_docs(rows), group_docs=3)) == want  # long prefixes


def test_odd_rows(make_docs, odd_rows):
    assert got(substring.remove_repeats(make_docs(odd_rows))) == plain(odd_rows)


def test_empty_table(make_docs):
    assert substring.remove_repeats(make_docs([])).collect() == []


def test_other_windows(make_docs):
    rows = planted()
    assert got(substring.remove_repeats(make_docs(rows), window=13, prefix=4)) == plain(rows, 13)


def test_ranks_follow_the_words_and_hashes_decide_nothing(monkeypatch):
    rng = random.Random(9)
    codes = np.array([rng.randrange(3) for _ in range(400)], np.int64)
    for window in (1, 2, 3, 5, 8, 13, 50):
        at = np.arange(len(codes) - window + 1)
        paths = [tuple(codes[i:i + window]) for i in at]
        order = {p: n for n, p in enumerate(sorted(set(paths)))}
        assert substring.path_ranks(codes, at, window).tolist() == [order[p] for p in paths]
    contexts = [[b"%d" % rng.randrange(2) for _ in range(rng.randrange(5, 30))] for _ in range(40)]
    leaves, docs = [len(c) - 4 for c in contexts], [rng.randrange(20) for _ in contexts]
    least = {}
    for c, k, d in zip(contexts, leaves, docs):
        for i in range(k):
            least[tuple(c[i:i + 5])] = min(least.get(tuple(c[i:i + 5]), d), d)
    want = [[least[tuple(c[i:i + 5])] for i in range(k)] for c, k in zip(contexts, leaves)]
    assert [x.tolist() for x in substring.deep_nodes(contexts, leaves, docs, 5)] == want
    monkeypatch.setattr(substring, "_runs_hash", lambda h, length, base: np.zeros(len(h) - length + 1, np.uint64))  # all collide
    assert [x.tolist() for x in substring.deep_nodes(contexts, leaves, docs, 5)] == want
