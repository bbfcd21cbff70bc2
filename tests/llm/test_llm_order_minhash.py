import hashlib

import numpy as np
from llm_corpus import prose

from keelson.llm import order_minhash as omh


def fp(text):
    return omh.fingerprint(omh.codes_of(text))


def plain(rows):
    """Contract columns, document by document, in descending order of id."""
    order = sorted(rows, key=lambda r: r[0], reverse=True)
    out = []
    for (d, t, *_), (_, following, *_rest) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        half = len(t) // 2
        changed = t[:len(t) - half] + following[:half] if half else t
        near = lambda a, b: float(np.mean(fp(a) == fp(b)))
        out.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), omh.as_text(fp(t)), omh.as_text(fp(changed)),
                    near(t, changed), near(t, following)))
    return sorted(out)


def test_selection_matches_its_definition():
    """Per function: the two least numbered k-mers of its share, in text order, hashed as a tuple."""
    text = prose(4, 700) + " again and again and again and again"
    codes = omh.codes_of(text)
    hashes = omh._kmers(codes)
    seen, ranks = {}, []
    for h in hashes.tolist():
        n = seen[h] = seen.get(h, -1) + 1
        ranks.append(h if not n else int(omh._mix(np.array([h + n * int(omh._B) & (1 << 64) - 1], np.uint64))[0]))
    assert max(seen.values()) > 0
    value = omh.fingerprint(codes)
    for sketch in range(omh.SKETCHES):
        own = sorted((r, i) for i, r in enumerate(ranks) if r >> 57 == sketch)[:omh.TUPLE]
        if len(own) == omh.TUPLE:
            x = np.array([sketch + 1], np.uint64)
            for _, i in sorted(own, key=lambda p: p[1]):
                x = omh._mix(x * omh._B + np.uint64(ranks[i]))
            assert value[sketch] == int(x[0]) >> 48


def test_order_counts_and_equal_texts_agree():
    a, b = prose(5, 400), prose(6, 400)
    assert (fp(a + " " + b) == fp(a + " " + b)).all()
    assert omh.likeness(fp(a + " " + b), fp(b + " " + a)) < 0.75  # the same k-mers, moved
    near = [omh.likeness(fp(a), fp(a[:n] + b[n:])) for n in (len(a), len(a) * 3 // 4, len(a) // 2, 0)]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] and near[3] < 0.05


def test_next_documents(make_docs):
    rows = [(i, prose(i, 30 + i)) for i in range(40)] + [(50, None), (51, ""), (52, "x"), (53, "ab"), (54, prose(9, 20_000))]
    found = omh.compare_with_next(make_docs(rows, 5)).collect()
    assert sorted(tuple(r) for r in found) == plain(rows)


def test_odd_rows_keep_their_places(make_docs, odd_rows):
    found = omh.compare_with_next(make_docs(odd_rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in found) == sorted(
        (d is None, d or 0, len(t or "")) for d, t, *_ in odd_rows)
    single = omh.compare_with_next(make_docs([(1, "only one")])).collect()
    assert [(r.doc_id, r.near_next) for r in single] == [(1, 1.0)]
    assert omh.compare_with_next(make_docs([])).collect() == []
    own = omh.fingerprints(make_docs(odd_rows)).collect()
    assert len(own) == len(odd_rows) and {r.fingerprint for r in own if not r.n_chars} == {"0" * 4 * omh.SKETCHES}
