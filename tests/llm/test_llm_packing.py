import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keelson.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def check(rows, pieces, tokenizer):
    want = sorted((d is None, d or 0, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for d, t, *_ in rows)
    total = sum(len(x[2]) for x in want)
    ids = lambda p: np.frombuffer(p.ids, "<u4").tolist()
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    lengths = []
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p.offset):
            assert p.offset == at
            at += len(ids(p))
        lengths.append(at)
    assert sum(lengths) == total
    assert all(n == 2048 or (n < 2048 and n & (n - 1) == 0) for n in lengths)
    # pieces of one document follow each other without gap or overlap
    unique = {d for d, *_ in rows if sum(x[0] == d for x in rows) == 1}
    for d in unique:
        own = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start)
        whole = next(x[2] for x in want if not x[0] and x[1] == d) if d is not None else next(x[2] for x in want if x[0])
        assert [p.start for p in own] == np.cumsum([0] + [len(ids(p)) for p in own])[:-1].tolist()
        assert sum((ids(p) for p in own), []) == whole
        assert {p.doc_tokens for p in own} == {len(whole)}
    return lengths


def test_odd_rows(make_docs, odd_rows, tokenizer):
    docs = make_docs(odd_rows + [(20, "<|endoftext|>x <|ENDOFTEXT|> Σας ΣΑΣ x\x1cy"), (21, "Å é it's We'LL 123")])
    pieces = packing.pack(docs).collect()
    check(odd_rows + [(20, "<|endoftext|>x <|ENDOFTEXT|> Σας ΣΑΣ x\x1cy"), (21, "Å é it's We'LL 123")], pieces, tokenizer)


def test_capitals_that_compose_only_in_lower_case(make_docs, tokenizer):
    texts = ["H\u0331amza", "J\u030cx", "T\u0308a", "W\u030a", "Y\u030a", "Plain H\u0331 J\u030C WORDS, Ünïcode ŠJ\u030cA"]
    rows = list(enumerate(texts, 1))
    tokens = packing.Tokens.of(packing.VOCABULARY)
    assert [np.frombuffer(i, "<u4").tolist() for i in tokens.encode_all(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    check(rows, packing.pack(make_docs(rows)).collect(), tokenizer)


def test_many_partitions_merge_level_by_level(make_docs, tokenizer):
    rows = [(i, "alpha beta gamma " * (i * 37 % 300)) for i in range(120)]
    lengths = check(rows, packing.pack(make_docs(rows, 9), fan_in=2, open_windows=3).collect(), tokenizer)
    assert sum(n < 2048 for n in lengths) <= 11


def test_empty_table(make_docs):
    assert packing.pack(make_docs([])).collect() == []


def test_packer_keeps_the_bound_and_loses_nothing():
    packer = packing.Packer(window=64, open_windows=4)
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 200, 300)
    for tag, size in enumerate(sizes):
        packer.add((tag,), 0, np.full(size, tag, "<u4"))
        assert len(packer.open) <= 4 and sorted(packer.rooms)[0][0] > 0 if packer.rooms else True
    assert all(sum(len(p[2]) for p in s) == 64 for s in packer.done)  # emitted windows are full
    packer.finish()
    assert sum(len(p[2]) for s in packer.done for p in s) == sizes.sum()
