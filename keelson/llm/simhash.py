"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most d = 2 bits
share at least 8 - 2 = 6 positional bytes, which is the count a pair must reach before it is
verified. Postings of single bytes would hold 1/256 of all fingerprints each, so the index
intersects them up front: bytes form four blocks of two, and a posting is a pair of blocks (four
positional bytes). Two differing bytes touch two blocks at most, so every pair with six shared
bytes meets in one of the six postings.

* Equal fingerprints are one entry: groups of exact copies cost one row.
* A posting of up to ``posting_rows`` entries yields its pairs; shared positional bytes are
  tallied, pairs under the guaranteed minimum go, the rest are verified by bit distance.
* A longer posting never yields its pairs. Each entry emits itself and its one-bit changes within
  the four other bytes; two entries meet in such a variant exactly if they differ in two bits or
  fewer, and a variant's group has at most 33 entries. Links to the least entry of a variant's
  group connect the same components.

Components come from :mod:`keelson.llm.components`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import Scratch, row_key, texts_of, whole_rows
from keelson.llm.components import connected_components

SEED = 42
#: Words per shingle and the most differing bits of a link.
SHINGLE_WORDS, MAX_BITS = 3, 2
#: Entries of a posting from which links are found by one-bit variants instead of pairs.
POSTING_ROWS = 64
_CHUNK = 1 << 16
_BLOCKS = [(0, 1), (2, 3), (4, 5), (6, 7)]


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) word shingles of the whole text.

    Repeats count; fewer words than a shingle: the whole sequence is one; no word: 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, _CHUNK):
        digests = [xxhash.xxh64_digest(b" ".join(words[i:i + shingle_words]), SEED)
                   for i in range(start, min(n, start + _CHUNK))]
        bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle_words: int = SHINGLE_WORDS, *keys: str) -> DataFrame:
    """``keys`` plus ``fp`` (the fingerprint as a signed long), one row per row of ``docs``."""
    kept = docs.select(*keys, F.col(text).alias("__text"))
    schema = kept.drop("__text").schema.add("fp", "long")

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle_words) for t in texts_of(batch, "__text")]
            columns = [batch.column(k) for k in keys]
            columns.append(pa.array(np.array(fps, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "fp"])

    return kept.mapInArrow(run, schema)


def _byte(column: Column, i: int) -> Column:
    return F.shiftrightunsigned(column, 8 * i).bitwiseAND(F.lit(255))


def _postings(distinct: DataFrame) -> DataFrame:
    """``(posting, other, fp)``: six postings per entry; ``other`` is the number of the block pair."""
    rows = []
    for n, (x, y) in enumerate(combinations(_BLOCKS, 2)):
        value = F.lit(0).cast("long")
        for at, i in enumerate((*x, *y)):
            value = value.bitwiseOR(F.shiftleft(_byte(F.col("fp"), i), 8 * at))
        rows.append(F.struct(F.lit(n).alias("blocks"), value.alias("bytes")))
    return distinct.select("fp", F.explode(F.array(*rows)).alias("p")).select("fp", "p.*")


def _free_bits() -> list[list[int]]:
    """Per block pair, the single-bit masks of the four bytes outside of it, and 0."""
    out = []
    for x, y in combinations(_BLOCKS, 2):
        free = [i for i in range(8) if i not in (*x, *y)]
        masks = [0] + [1 << (8 * i + b) for i in free for b in range(8)]
        out.append([m - (1 << 64) if m >> 63 else m for m in masks])
    return out


def links(distinct: DataFrame, posting_rows: int = POSTING_ROWS) -> DataFrame:
    """Edges ``(u, v)`` between entries of ``distinct.fp`` that connect the same components as all
    pairs within two differing bits; every edge is such a pair."""
    posted = _postings(distinct)
    size = posted.groupBy("blocks", "bytes").agg(F.count("*").alias("size")).where("size > 1")
    posted = posted.join(size, ["blocks", "bytes"])

    few = posted.where(F.col("size") <= posting_rows)
    left, right = few.alias("l"), few.alias("r")
    apart = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    shared = sum((F.when(_byte(apart, i) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))
    pairs = (left.join(right, [F.col("l.blocks") == F.col("r.blocks"), F.col("l.bytes") == F.col("r.bytes"),
                               F.col("l.fp") < F.col("r.fp")])
             .where(shared >= 8 - MAX_BITS)
             .where(F.bit_count(apart) <= MAX_BITS)
             .select(F.col("r.fp").alias("u"), F.col("l.fp").alias("v")))

    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in _free_bits()])
    variants = (posted.where(F.col("size") > posting_rows)
                .select("blocks", "fp", F.explode(F.element_at(masks, F.col("blocks") + 1)).alias("mask"))
                .select("blocks", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")))
    least = variants.groupBy("blocks", "variant").agg(F.min("fp").alias("v"), F.max("fp").alias("hi")).where("v < hi")
    many = (variants.join(least.drop("hi"), ["blocks", "variant"]).where("fp <> v")
            .select(F.col("fp").alias("u"), "v").distinct())
    return pairs.unionByName(many)


def _components(rows: DataFrame, scratch: Scratch, posting_rows: int) -> DataFrame:
    """``(fp, component)`` for every fingerprint of the staged ``rows``."""
    entries = scratch.stage(rows.select("fp").distinct())
    found = scratch.stage(links(entries, posting_rows))
    parts = connected_components(found, scratch).withColumnRenamed("node", "fp")
    return entries.join(parts, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS,
                    posting_rows: int = POSTING_ROWS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` the least id of the documents
    reachable by links of at most two differing bits. Null texts read as empty, whose fingerprint
    is zero like that of any text without words, and links like any other. A null id stays null in
    its row and names a component only if none of its documents has an id. Repeated rows and ids
    keep one row each; further columns of ``docs`` are not read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = scratch.stage(fingerprints(rows, "text", shingle_words, "doc_id"))
    parts = _components(rows, scratch, posting_rows)
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    least = parts.join(first, "fp").groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = scratch.stage(parts.join(least, "component").select("fp", "component_id"))
    return (rows.join(by_fp, "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS,
             posting_rows: int = POSTING_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that represent their component: one document of each group.

    It is the row with the least id (nulls last), then the least hash of the text; of rows equal
    in both, any one. Texts and ids are read as in :func:`near_duplicates`.
    """
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    key = row_key(doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                       key["a"].alias("a"), key["b"].alias("b"))
    rows = scratch.stage(fingerprints(rows, "text", shingle_words, "doc_id", "a", "b"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "a", "b")
    first = rows.groupBy("fp").agg(F.min(order).alias("first"))
    least = (_components(rows, scratch, posting_rows).join(first, "fp").groupBy("component")
             .agg(F.min("first").alias("first")).select("first.a", "first.b"))
    kept = whole_rows(docs, doc_id, text).join(scratch.stage(least), ["a", "b"], "left_semi").dropDuplicates(["a", "b"])
    return kept.select("row.*")
