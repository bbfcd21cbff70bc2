"""Exact substring dedup: prefix-partitioned suffix trees over words.

A window is ``WINDOW`` (50) consecutive words; a window of a document goes if its word sequence also
starts in a document with a smaller id. Windows that share their words are the leaves under one
internal node, at least 50 words deep, of the corpus's suffix tree. The tree is built in parts:

1. Sampled suffixes. Each window is assigned the least hashed run of ``PREFIX`` (8) words in it,
   so equal windows choose the same run at the same place, and only about one word in 22 is an
   anchor. Anchors are listed as (prefix hash, document); a prefix that all its anchors have in
   one document starts no repeat and its suffixes are left out.
2. The remaining anchors' contexts (the words of all windows they stand for) are dealt out by
   prefix. Equal contexts of a batch of documents travel once, with their places.
3. A task reads whole prefix groups in order, several small ones at a time, and builds the deep
   part of their subtree: leaves (windows) whose path has a hash of its own have no deep node; the others
   are sorted by the words of their paths, by prefix doubling, and runs of neighbours whose common
   prefix reaches 50 are the leaves of one internal node. A leaf goes if its node also has a leaf of a
   smaller document. Neighbouring leaves of a document make one maximal repeat, reported as a span of words.
4. Prefixes are of variable length: one that more than ``GROUP_DOCS`` documents share would not fit
   memory, so it is lengthened to the whole window. Each such leaf is then its own group, its
   least document comes from a pre-aggregated shuffle, and is joined back, so one passage in a
   third of all documents is never gathered anywhere.
5. Spans are joined back to the texts, whose one shuffle by document serves steps 2 and 5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keelson.llm.common import Scratch, row_key, shuffle_partitions, slices, texts_of

WINDOW, PREFIX = 50, 8
#: Documents that share a prefix up to which its subtree is built in one task (about 50 MB).
GROUP_DOCS = 100_000
_KNOWN_WORDS, _BLOCK, _BATCH_ROWS, _GROUP_BYTES = 400_000, 1 << 19, 2_000, 8 << 20
_POS = np.uint64((1 << 20) - 1)
_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

_known: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    known = _known
    found = [known.get(w) for w in words]
    if None in found:
        if len(known) > _KNOWN_WORDS:
            known.clear()
        for i, h in enumerate(found):
            if h is None:
                found[i] = known[words[i]] = xxhash.xxh64_intdigest(words[i], 11)
    return np.array(found, np.uint64)


def _runs_hash(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every run of ``length`` entries, by doubling."""
    done, size, offset = None, 1, 0
    power, now, rest = base, h, length
    while rest:
        if rest & 1:
            if done is None:
                done, offset = now, size
            else:  # append a run of ``size`` after the ``offset`` entries that are done
                n = len(h) - offset - size + 1
                done = done[:n] * np.uint64(power) + now[offset:offset + n]
                offset += size
        rest >>= 1
        if rest:
            now = now[:-size] * np.uint64(power) + now[size:]
            size, power = 2 * size, power * power & (1 << 64) - 1
    return done


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_A)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_B)
    return x ^ (x >> np.uint64(32))


def anchors(hashes: np.ndarray, window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor of a document: its prefix's hash, and the first and last window it stands for."""
    windows = len(hashes) - window + 1
    none = np.zeros(0, np.int64)
    if windows <= 0:
        return none, none, none
    grams, span = _mix(_runs_hash(hashes, prefix, _A)), window - prefix + 1
    at = np.empty(windows, np.int64)
    for start in range(0, windows, _BLOCK):
        part = grams[start:start + _BLOCK + span - 1]
        low = (part & ~_POS) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[:len(low) - (span - size)], low[span - size:])
        at[start:start + len(low)] = (low & _POS).astype(np.int64) + start
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], windows] - 1
    return grams[at[first]].view(np.int64), first, last


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8").split()


_ANCHORS = T.StructType([T.StructField("prefix", T.LongType()), T.StructField("doc_id", T.LongType()),
                         T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_PLACE = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "a", "b", "at")])
_CONTEXTS = T.StructType([T.StructField("prefix", T.LongType()), T.StructField("words", T.BinaryType()),
                          T.StructField("leaves", T.LongType()), T.StructField("places", T.ArrayType(_PLACE))])
_SPANS = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b", "start", "stop")])
_LEAVES = T.StructType([T.StructField(n, T.LongType()) for n in ("h1", "h2", "doc_id", "a", "b", "at")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _list_anchors(window: int, prefix: int):
    schema = to_arrow_schema(_ANCHORS)

    def run(batches):
        for batch in batches:
            for part in slices(batch, _BATCH_ROWS):
                keys = [part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "a", "b")]
                found = [np.unique(anchors(_word_hashes(_words(t)), window, prefix)[0]) for t in texts_of(part)]
                sizes = [len(x) for x in found]
                columns = [np.concatenate(found) if found else np.zeros(0, np.int64), *(np.repeat(k, sizes) for k in keys)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def _documents(batch: pa.RecordBatch, column: str, window: int, prefix: int):
    """Per document its id, key, words, word hashes and the anchors listed in ``column``."""
    keys = [batch.column(c).to_pylist() for c in ("doc_id", "a", "b")]
    for doc_id, a, b, text, wanted in zip(*keys, texts_of(batch), batch.column(column).to_pylist()):
        if not wanted:
            continue
        words = _words(text)
        hashes = _word_hashes(words)
        names, first, last = anchors(hashes, window, prefix)
        at = np.flatnonzero(np.isin(names, np.array(wanted, np.int64)))
        yield doc_id, a, b, words, hashes, list(zip(names[at].tolist(), first[at].tolist(), last[at].tolist()))


def _list_contexts(window: int, prefix: int):
    schema = to_arrow_schema(_CONTEXTS)

    def run(batches):
        for batch in batches:
            for part in slices(batch, _BATCH_ROWS):
                found: dict[tuple, list] = {}
                for doc_id, a, b, words, _, listed in _documents(part, "few", window, prefix):
                    for name, first, last in listed:
                        context = b" ".join(words[first:last + window])
                        found.setdefault((name, context, last - first + 1), []).append((doc_id, a, b, first))
                yield _batch([(n, c, k, [dict(zip(("doc_id", "a", "b", "at"), p)) for p in places])
                              for (n, c, k), places in found.items()], schema)

    return run


def _list_leaves(window: int, prefix: int):
    schema = to_arrow_schema(_LEAVES)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                for doc_id, a, b, _, hashes, listed in _documents(part, "many", window, prefix):
                    at = np.concatenate([np.arange(first, last + 1) for _, first, last in listed] or [np.zeros(0, np.int64)])
                    h1, h2 = (_mix(_runs_hash(hashes, window, base))[at].view(np.int64) for base in (_A, _B))
                    same = [np.full(len(at), x, np.int64) for x in (doc_id, a, b)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (h1, h2, *same, at)], schema=schema)

    return run


def path_ranks(codes: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The rank of the ``window`` words from each of the places ``at``, in the order of their words; equal words, equal rank.

    Ranks of runs of 1, 2, 4, ... words come from those of half the length (prefix doubling), and two
    overlapping runs make the window, so the order is that of the paths in a suffix tree and no hash decides.
    """
    ranks, size = codes, 1
    top = int(codes.max()) + 1 if len(codes) else 1
    while 2 * size <= window:  # places too near the end give ranks that no window reads
        ahead = np.r_[ranks[size:], np.zeros(min(size, len(ranks)), np.int64)]
        _, ranks = np.unique(ranks * top + ahead, return_inverse=True)
        top, size = int(ranks.max()) + 1 if len(ranks) else 1, 2 * size
    return np.unique(ranks[at] * top + ranks[at + window - size], return_inverse=True)[1]


def deep_nodes(contexts: list[list[bytes]], leaves: list[int], docs: list[int], window: int) -> list[np.ndarray]:
    """Per context, the least document of each leaf's node at depth ``window``.

    A leaf whose path has a hash of its own shares no node of that depth. The other leaves are sorted by
    the words of their paths; neighbours whose common prefix reaches ``window`` are below one deep node.
    """
    codes: dict[bytes, int] = {}
    flat = np.array([codes.setdefault(w, len(codes)) for c in contexts for w in c], np.int64)
    sizes, counts = np.array([len(c) for c in contexts]), np.array(leaves)
    starts = np.cumsum(sizes) - sizes
    before = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) - np.repeat(before, counts) + np.repeat(starts, counts)
    owner = np.repeat(np.array(docs, np.int64), counts)
    paths = _runs_hash(_mix(flat.astype(np.uint64) + np.uint64(1)), window, _B)[at]
    order = np.argsort(paths, kind="stable")
    near = paths[order][1:] == paths[order][:-1]
    shared = order[np.r_[near, False] | np.r_[False, near]] if len(order) else order
    out = owner.copy()
    if len(shared):
        mine = np.repeat(np.arange(len(counts)), counts)
        held = np.unique(mine[shared])  # contexts with such a leaf, laid end to end
        words = np.concatenate([flat[starts[i]:starts[i] + sizes[i]] for i in held])
        begin = np.cumsum(sizes[held]) - sizes[held]
        place = begin[np.searchsorted(held, mine[shared])] + at[shared] - starts[mine[shared]]
        ranks = path_ranks(words, place, window)
        sorted_ = np.argsort(ranks, kind="stable")
        deep = ranks[sorted_][1:] == ranks[sorted_][:-1]  # the common prefix of neighbours reaches the window
        node = np.r_[0, np.cumsum(~deep)]
        least = np.full(node[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, owner[shared[sorted_]])
        out[shared[sorted_]] = least[node]
    return np.split(out, np.cumsum(counts)[:-1])


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def _subtrees(window: int):
    schema = to_arrow_schema(_SPANS)

    def build(rows):
        merged: dict[tuple, list] = {}
        for _, words, leaves, places in rows:
            merged.setdefault((words, leaves), []).extend(places)
        items = list(merged.items())
        least = deep_nodes([c.split() for (c, _), _ in items], [k for (_, k), _ in items],
                           [min(p["doc_id"] for p in places) for _, places in items], window)
        out = []
        for (_, places), low in zip(items, least):
            for p in places:
                out += [(p["a"], p["b"], p["at"] + i, p["at"] + j + window) for i, j in _spans(low < p["doc_id"])]
        return _batch(out, schema)

    def run(batches):
        waiting, held, last = [], 0, None
        for batch in batches:
            for part in slices(batch, 256):
                columns = (part.column(c).to_pylist() for c in ("prefix", "words", "leaves", "places"))
                for row in zip(*columns):
                    if row[0] != last and held >= _GROUP_BYTES:  # whole groups only
                        yield build(waiting)
                        waiting, held = [], 0
                    last = row[0]
                    waiting.append(row)
                    held += len(row[1]) + 64 * len(row[3])
        if waiting:
            yield build(waiting)

    return run


def _cut(window: int, doc_type):
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
                        T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    schema = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 512):
                rows = []
                for doc_id, text, spans in zip(part.column("doc_id").to_pylist(), texts_of(part), part.column("spans").to_pylist()):
                    words = _words(text)
                    keep, at = [], 0
                    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
                        if start > at:
                            keep += words[at:start]
                        at = max(at, stop)
                    keep += words[at:]
                    rows.append((doc_id, len(words), len(words) - len(keep), b" ".join(keep).decode()))
                yield _batch(rows, schema)

    return run, out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                   prefix: int = PREFIX, group_docs: int = GROUP_DOCS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``, one row per row of ``docs``.

    ``kept`` holds the words no removed window covers, joined by one space. Windows are judged on
    the input. Null texts have no words; texts under ``window`` words lose nothing; a document
    without an id neither loses words nor makes others lose them; rows with the same id never take
    words from each other. ``doc_id`` is read as a bigint; further columns are not read. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "substring"), shuffle_partitions(spark)
    key = row_key(doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       key["a"].alias("a"), key["b"].alias("b"))
    listed = scratch.stage(rows.where("doc_id is not null").mapInArrow(_list_anchors(window, prefix), _ANCHORS))
    shared = (listed.groupBy("prefix").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("docs"))
              .where("lo < hi").select("prefix", (F.col("docs") > group_docs).alias("hot")))
    wanted = (listed.join(shared, "prefix").groupBy("a", "b")
              .agg(F.collect_set(F.expr("case when not hot then prefix end")).alias("few"),
                   F.collect_set(F.expr("case when hot then prefix end")).alias("many")))
    by_doc = rows.repartition(n, "a", "b")  # one shuffle of the texts for both joins below
    with_anchors = by_doc.join(scratch.stage(wanted), ["a", "b"])
    contexts = with_anchors.where("size(few) > 0").mapInArrow(_list_contexts(window, prefix), _CONTEXTS)
    spans = (contexts.repartition(n, "prefix").sortWithinPartitions("prefix").mapInArrow(_subtrees(window), _SPANS))
    if not shared.where("hot").isEmpty():
        leaves = with_anchors.where("size(many) > 0").mapInArrow(_list_leaves(window, prefix), _LEAVES)
        leaves = scratch.stage(leaves)
        low = leaves.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"))
        gone = leaves.join(low, ["h1", "h2"]).where("low < doc_id")
        spans = spans.unionByName(gone.select("a", "b", F.col("at").alias("start"), (F.col("at") + window).alias("stop")))
    per_doc = spans.groupBy("a", "b").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    run, out = _cut(window, docs.schema[doc_id].dataType)
    return by_doc.join(per_doc, ["a", "b"], "left").select("doc_id", "text", "spans").mapInArrow(run, out)
