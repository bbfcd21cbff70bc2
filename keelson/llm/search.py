"""Ranked lexical search by dual trees over items and documents.

The score of an item against a document is a sum over terms of an item coordinate (weight of the
term times its repeats in the item) and a document coordinate (a saturated term frequency), both
non-negative whole numbers. So the sum over terms of the two nodes' coordinate maxima bounds the score of every
item below one node against every document below another.

1. Items are read in blocks of at most ``BLOCK_TERMS`` terms (one longer item is a block of its own).
   The tables of a block have a bounded size; every block sees all documents.
2. One pass over the whole texts turns each document into its size and the counts of the block's
   terms, staged in the shared folder. Collection size, document count and document frequencies are
   aggregations over that table.
3. Every task builds a tree over each batch of documents: documents ordered by their strongest terms,
   ``LEAF_DOCS`` to a leaf and ``FAN`` children to a node, each with its maxima as a sparse row. The items' tree
   is built once. The search descends both trees at a time. A pair of nodes goes, with all that is
   below it, if its bound is under the weakest k-th score among the node's items; at the bottom the bound is the score.
4. A first search over one document in ``SEED_SHARE`` (by hash) gives each item a k-th score, a lower
   bound of the final one, from which every task of the main search starts. About ``k * SEED_SHARE``
   results an item then leave the tasks, however many documents there are; the best of them are
   taken by salted windows. Nothing is approximate, and the seeds only decide what is pruned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from keelson.llm.common import Scratch, slices

TOP = 20
#: Terms of a block of items, documents of a leaf, children of a document node and of an item node.
BLOCK_TERMS, LEAF_DOCS, FAN, ITEM_FAN = 100_000, 8, 8, 4
#: One document in so many gives the seeds; entries of a batch's tree; parts a hot item's results are cut into.
SEED_SHARE, TREE_ENTRIES, SALTS = 64, 2_000_000, 64
_SEPARATES = bytes(b for b in range(128) if not chr(b).isalnum())
_TERMS = bytes.maketrans(bytes(range(65, 91)) + _SEPARATES, bytes(range(97, 123)) + b" " * len(_SEPARATES))
_LAST = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters, digits and all other characters, A-Z lower-cased."""
    return text.translate(_TERMS).split()


@dataclass
class Rows:
    """Sparse rows: entries ``start[i]:start[i + 1]`` of ``term`` and ``value`` belong to row ``i``."""

    start: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the entries of ``rows``, row after row, and where each row begins among them."""
        sizes = self.start[rows + 1] - self.start[rows]
        begin = np.concatenate(([0], np.cumsum(sizes)))
        return np.repeat(self.start[rows] - begin[:-1], sizes) + np.arange(begin[-1]), begin

    def take(self, rows: np.ndarray) -> Rows:
        at, begin = self.entries(rows)
        return Rows(begin, self.term[at], self.value[at])

    def by_strongest(self, weight: np.ndarray, depth: int = 3) -> np.ndarray:
        """The rows ordered by their term with the largest weighted value, then by the next ones."""
        sizes = np.diff(self.start)
        row = np.repeat(np.arange(len(self)), sizes)
        order = np.lexsort((self.term, -(self.value * weight[self.term]), row))
        keys = []
        for k in range(depth):
            key, has = np.full(len(self), -1, np.int64), sizes > k
            key[has] = self.term[order][self.start[:-1][has] + k]
            keys.append(key)
        return np.lexsort(keys[::-1])

    def maxima(self, fan: int, terms: int) -> Rows:
        """Rows of nodes with ``fan`` children each: the largest value of every term."""
        node = np.repeat(np.arange(len(self)) // fan, np.diff(self.start))
        key = node * terms + self.term
        order = np.argsort(key, kind="stable")
        key, value = key[order], self.value[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        nodes = -(-len(self) // fan)
        size = np.bincount(key[first] // terms, minlength=nodes)
        return Rows(np.concatenate(([0], np.cumsum(size))), key[first] % terms,
                    np.maximum.reduceat(value, first) if len(first) else value)


def levels(rows: Rows, fans: list[int], terms: int) -> list[Rows]:
    """A tree, from its rows (level 0) up to one root; the last fan holds for all further levels."""
    tree = [rows]
    while len(tree[-1]) > 1:
        tree.append(tree[-1].maxima(fans[min(len(tree), len(fans)) - 1], terms))
    return tree


@dataclass
class Items:
    """A block of items: ids, repeats of each term, and the number of every term."""

    ids: list
    rows: Rows
    number: dict[bytes, int]

    @classmethod
    def of(cls, block: list[tuple]) -> Items:
        number: dict[bytes, int] = {}
        for _, counts in block:
            for term in counts:
                number.setdefault(term, len(number))
        rows = [sorted((number[t], n) for t, n in counts.items()) for _, counts in block]
        flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 2)
        return cls([i for i, _ in block], Rows(np.concatenate(([0], np.cumsum([len(r) for r in rows]))), flat[:, 0], flat[:, 1]), number)


@dataclass
class Query:
    """What a task needs to search for a block: weights, totals and the item tree."""

    weight: np.ndarray
    documents: int
    words: int
    order: np.ndarray
    tree: list[Rows]

    @classmethod
    def of(cls, items: Items, documents: int, words: int, df: dict[int, int]) -> Query:
        weight = np.array([floor(1000 * log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(items.number))], np.int64)
        rows = items.rows
        valued = Rows(rows.start, rows.term, rows.value * weight[rows.term])
        order = valued.by_strongest(np.ones(len(weight), np.int64))
        return cls(weight, documents, words, order, levels(valued.take(order), [ITEM_FAN], len(weight)))

    def size_factor(self, n: int) -> int:
        return 100 - 25 + 25 * n * self.documents // self.words


def items_in_blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[Items]:
    """Blocks of items that have terms, in the order of their ids; equal rows are one item."""
    rows = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where("text is not null").distinct()
    block, size = [], 0
    for row in rows.orderBy("id", F.xxhash64("text")).toLocalIterator():
        counts = Counter(terms_of(row["text"].encode("utf-8", "surrogatepass")))
        if not counts:
            continue
        if block and size + len(counts) > limit:
            yield Items.of(block)
            block, size = [], 0
        block.append((row["id"], counts))
        size += len(counts)
    if block:
        yield Items.of(block)


_INDEX = "doc_id long, n long, terms array<int>, counts array<int>"


def index(docs: DataFrame, number: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n, terms, counts)`` of every document with a term: its size in terms and its counts of known ones."""
    def run(batches):
        known = number.keys()
        for batch in batches:
            for part in slices(batch, 256):
                keep, sizes, lengths, terms, counts = [], [], [], [], []
                for at, t in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    words = terms_of(t) if t else ()
                    if words:
                        own = Counter(words)
                        hits = own.keys() & known
                        keep.append(at)
                        sizes.append(len(words))
                        lengths.append(len(hits))
                        terms.extend(number[w] for w in hits)
                        counts.extend(own[w] for w in hits)
                ends = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, _INDEX)


class Best:
    """The best ``k`` documents of every item so far, and the floor under which none counts."""

    def __init__(self, items: int, k: int, seeds: dict[int, tuple[int, int]]):
        self.k = k
        self.score = np.ones(items, np.int64)  # the least score that counts is 1, with any id
        self.id = np.full(items, _LAST, np.int64)
        for item, (score, doc) in seeds.items():
            self.score[item], self.id[item] = score, doc
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in range(items)]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        take = (scores > self.score[item]) | ((scores == self.score[item]) & (ids <= self.id[item]))
        if not take.any():
            return
        scores, ids, null = (np.concatenate((a, b[take])) for a, b in zip(self.found[item], (scores, ids, null)))
        order = np.lexsort((null, ids, -scores))[:self.k]
        self.found[item] = scores[order], ids[order], null[order]
        if len(order) == self.k:
            last = (self.found[item][0][-1], self.found[item][1][-1])
            if (-last[0], last[1]) < (-self.score[item], self.id[item]):
                self.score[item], self.id[item] = last


class DualTree:
    """The search of one batch of documents for all items of a block."""

    def __init__(self, query: Query, best: Best, docs: Rows, ids: np.ndarray, null: np.ndarray):
        self.query, self.best = query, best
        order = docs.by_strongest(query.weight)
        self.ids, self.null = ids[order], null[order]
        self.tree = levels(docs.take(order), [LEAF_DOCS, FAN], len(query.weight))
        self.least = [self.ids]
        for level, fan in zip(self.tree[1:], [LEAF_DOCS] + [FAN] * len(self.tree)):
            self.least.append(np.minimum.reduceat(self.least[-1], np.arange(0, len(self.least[-1]), fan)))
            assert len(self.least[-1]) == len(level)
        self.dense = np.zeros(len(query.weight), np.int64)
        self.bounded = 0

    def bounds(self, item_level: int, item: int, level: int, nodes: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores below the item node against those below each document node."""
        rows, own = self.tree[level], self.query.tree[item_level]
        span = slice(own.start[item], own.start[item + 1])
        self.dense[own.term[span]] = own.value[span]
        at, begin = rows.entries(nodes)
        sums = np.concatenate(([0], np.cumsum(rows.value[at] * self.dense[rows.term[at]])))
        self.dense[own.term[span]] = 0
        self.bounded += len(nodes)
        return sums[begin[1:]] - sums[begin[:-1]]

    def run(self) -> None:
        self.visit(len(self.query.tree) - 1, 0, len(self.tree) - 1, np.zeros(1, np.int64))

    def _children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        fan = LEAF_DOCS if level == 1 else FAN
        below = (nodes[:, None] * fan + np.arange(fan)).ravel()
        return below[below < len(self.tree[level - 1])]

    def visit(self, item_level: int, item: int, level: int, nodes: np.ndarray) -> None:
        """Search the items below one node against the documents below ``nodes`` of a level."""
        if item_level == 0:
            return self.visit_item(item, level, nodes)
        width = ITEM_FAN ** item_level
        below = self.query.order[item * width:(item + 1) * width]
        nodes = nodes[self.bounds(item_level, item, level, nodes) >= self.best.score[below].min()]
        if len(nodes):
            if level:
                level, nodes = level - 1, self._children(level, nodes)
            for child in range(item * ITEM_FAN, min((item + 1) * ITEM_FAN, len(self.query.tree[item_level - 1]))):
                self.visit(item_level - 1, child, level, nodes)

    def visit_item(self, place: int, level: int, nodes: np.ndarray) -> None:
        """One item: nodes of high bounds go first, and raise the floor for the others."""
        item, best = self.query.order[place], self.best
        bounds = self.bounds(0, place, level, nodes)
        if level == 0:
            return best.add(item, bounds, self.ids[nodes], self.null[nodes])
        order = np.argsort(-bounds, kind="stable")
        nodes, bounds, at, step = nodes[order], bounds[order], 0, 4
        while at < len(nodes):
            high = bounds[at:at + step]
            open_ = (high > best.score[item]) | ((high == best.score[item]) & (self.least[level][nodes[at:at + step]] <= best.id[item]))
            if high[0] < best.score[item]:
                return None
            if open_.any():
                self.visit_item(place, level - 1, self._children(level, nodes[at:at + step][open_]))
            at, step = at + step, step * 2
        return None


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch with at most ``TREE_ENTRIES`` entries (or one row)."""
    sizes = np.diff(np.asarray(batch.column("terms").offsets))
    begin, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if held and held + size > TREE_ENTRIES:
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _winners(indexed: DataFrame, query: Query, ids: list, id_type: T.DataType, k: int, seeds: dict[int, tuple[int, int]]) -> DataFrame:
    """``(item, item_id, doc_id, score)``: what each task's best results are."""
    out = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_type),
                        T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])

    def run(batches):
        best = Best(len(ids), k, seeds)
        for batch in batches:
            for part in _batches(batch):
                lists = part.column("terms")
                start = np.asarray(lists.offsets).astype(np.int64)
                term = np.asarray(lists.flatten()).astype(np.int64)
                tf = np.asarray(part.column("counts").flatten()).astype(np.int64)
                start = start - start[0]
                m = np.array([query.size_factor(n) for n in part.column("n").to_pylist()], np.int64)
                value = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(start)))
                doc = part.column("doc_id")
                null = np.asarray(doc.is_null())
                DualTree(query, best, Rows(start, term, value), np.asarray(doc.fill_null(_LAST)), null).run()
        for item, (score, doc, null) in enumerate(best.found):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), item, np.int32)), pa.array([ids[item]] * len(score), pa_type),
                     pa.array(doc, pa.int64(), mask=null), pa.array(score)], names=out.names)

    pa_type = to_arrow_type(id_type)
    return indexed.mapInArrow(run, out)


def _ranked(winners: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of every item with their rank: first of each salt, then of these."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = Window.partitionBy("item", "salt").orderBy(*order)
    first = (winners.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(SALTS)))
             .withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k).drop("salt", "rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item with a score above 0.

    Equal scores go by ascending ``doc_id`` (whole numbers), null last. Null and empty texts have no terms: such
    documents count in nothing and match nothing, such items have no rows. Repeated documents are
    documents of their own, also in the ranks. Equal item rows are one item; an id that repeats with another text is
    another item under that id. Further columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    id_type = items.schema[item_id].dataType
    found = [_search_block(spark, docs, block, id_type, k, doc_id, text)
             for block in items_in_blocks(items, item_id, item_text, block_terms)]
    if not found:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()),
                                                       T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    return reduce(DataFrame.unionByName, found)


def _search_block(spark: SparkSession, docs: DataFrame, items: Items, id_type: T.DataType, k: int, doc_id: str, text: str) -> DataFrame:
    scratch = Scratch(spark, "search")
    indexed = scratch.stage(index(docs, items.number, doc_id, text))
    total = indexed.agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
    # one count per term of the block
    df = {r["t"]: r["n"] for r in indexed.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    query = Query.of(items, total["n"], total["words"] or 1, df)
    holding = indexed.where(F.size("terms") > 0)  # the others score 0
    sample = holding.where(F.pmod(F.xxhash64("doc_id"), F.lit(SEED_SHARE)) == 0)
    seeds = (_ranked(_winners(sample, query, items.ids, id_type, k, {}), k).where(F.col("rank") == k)
             .select("item", "score", F.coalesce("doc_id", F.lit(int(_LAST))).alias("doc_id")).collect())
    floors = {r["item"]: (r["score"], r["doc_id"]) for r in seeds}
    winners = scratch.stage(_winners(holding, query, items.ids, id_type, k, floors))
    scratch.drop(indexed)
    return _ranked(winners, k).select("item_id", "rank", "doc_id", "score")
