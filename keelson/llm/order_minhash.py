"""Document fingerprints by Order MinHash.

A text's k-mers of code points are numbered by occurrence, so that repeats differ. Each of
``SKETCHES`` hash functions selects the ``TUPLE`` least numbered k-mers, puts them back into text
order and hashes them as a tuple; a fingerprint is the row of these hashes. Two texts agree at a
position with a probability that falls with their edit distance: unlike plain MinHash, moving a
passage changes tuples although the k-mers stay.

The functions share one hash pass: a k-mer's hash chooses the function it competes in, and its
rest is its rank there (one-permutation hashing), so a text costs two sorts and not one scan per
function. A function for which a short text has too few k-mers ranks all of them by a permutation
of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keelson.llm.common import Scratch, shuffle_partitions, slices

KMER, SKETCHES, TUPLE = 8, 128, 2
_B = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_OWN = np.random.default_rng(23).integers(0, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _kmers(codes: np.ndarray) -> np.ndarray:
    """Hashes of all k-mers; a text shorter than one is a single k-mer."""
    runs, size, power = codes.astype(np.uint64) + np.uint64(1), 1, _B
    if len(codes) < KMER:
        whole = np.uint64(len(codes))
        for c in runs:
            whole = np.uint64((int(whole) * int(_B) + int(c)) & (1 << 64) - 1)
        return _mix(np.array([whole]))
    while size < KMER:  # KMER is a power of two
        runs = runs[:-size] * power + runs[size:]
        power, size = np.uint64(int(power) * int(power) & (1 << 64) - 1), 2 * size
    return _mix(runs)


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, occurrence): the first keeps its hash, a later one is hashed with its number."""
    n = len(hashes)
    bits = np.uint64(max(1, n.bit_length()))
    place = np.arange(n, dtype=np.uint64)
    packed = np.sort((hashes >> bits << bits) | place)
    runs = packed >> bits
    again = np.flatnonzero(runs[1:] == runs[:-1]) + 1
    if not len(again):
        return hashes
    first = np.r_[True, runs[1:] != runs[:-1]]
    number = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    at = (packed[again] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    out = hashes.copy()
    out[at] = _mix(hashes[at] + number[again].astype(np.uint64) * _B)
    return out


def fingerprint(codes: np.ndarray) -> np.ndarray:
    """``SKETCHES`` 16-bit values of a text given as code points; an empty text has zeros."""
    if not len(codes):
        return np.zeros(SKETCHES, np.uint16)
    ranks = _numbered(_kmers(codes))
    n = len(ranks)
    bits = np.uint64(max(1, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = np.sort((ranks >> bits << bits) | np.arange(n, dtype=np.uint64))
    shift = np.uint64(64 - (SKETCHES - 1).bit_length())
    edges = np.searchsorted(packed, np.arange(SKETCHES, dtype=np.uint64) << shift)
    counts = np.r_[edges[1:], n] - edges
    chosen = np.zeros((SKETCHES, TUPLE), np.int64)
    full = np.flatnonzero(counts >= TUPLE)
    for t in range(TUPLE):
        chosen[full, t] = (packed[edges[full] + t] & low).astype(np.int64)
    short = np.flatnonzero(counts < TUPLE)
    if len(short):
        own = _mix(ranks[None, :] ^ _OWN[short][:, None])
        take = min(TUPLE, n)
        least = np.argpartition(own, take - 1, axis=1)[:, :take] if take < n else np.tile(np.arange(n), (len(short), 1))
        chosen[short] = np.concatenate([least, np.repeat(least[:, :1], TUPLE - take, axis=1)], axis=1)
    chosen.sort(axis=1)  # text order
    tuples = np.arange(1, SKETCHES + 1, dtype=np.uint64)
    for t in range(TUPLE):
        tuples = _mix(tuples * _B + ranks[chosen[:, t]])
    return (tuples >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal positions."""
    return float(np.mean(a == b))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def as_text(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_chars, fingerprint)`` per row of ``docs``, without a shuffle.

    Null texts read as empty, whose fingerprint is all zeros. Null and repeated ids and repeated
    rows keep one row each; further columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = T.StructType([rows.schema["doc_id"], T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 256):
                found = [codes_of(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(c) for c in found], pa.int64()),
                     pa.array([as_text(fingerprint(c)) for c in found])], names=["doc_id", "n_chars", "fingerprint"])

    return rows.mapInArrow(run, out)


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by the first as many code points of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half] if half else text


_PAIRED = T.StructType([T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
                        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
                        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text, its edited text and the next document's text, compared by fingerprint.

    The next document is the one with the next smaller id; after the last comes the first. Returns
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per
    row. Null texts read as empty; null ids come last; repeated ids follow the hash of their text,
    and rows equal in both are neighbours. A single row is its own next. An empty table gives no
    rows. Further columns are not read.

    Texts are shuffled once, into sorted ranges of ids, and each task walks its range holding one
    document. A range's last document needs the first of the next range: these two per range are
    staged with their texts and joined by the number of the range.
    """
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "omh"), shuffle_partitions(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()]
    out = T.StructType([rows.schema["doc_id"], *_PAIRED.fields])
    edge = [T.StructField("part", T.IntegerType()), T.StructField("role", T.IntegerType()), T.StructField("text", T.StringType())]
    full = T.StructType([*out.fields, *edge])
    walked = scratch.stage(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_walk(full), full))

    first = walked.where(F.col("role") == _FIRST).select("part", F.col("text").alias("following"))
    last = walked.where(F.col("role") == _LAST).select("doc_id", "text", "part")
    parts = first.select("part")  # one row per range, without texts
    ring = parts.withColumn("after", F.coalesce(F.lead("part").over(Window.orderBy("part")),
                                                F.min("part").over(Window.partitionBy())))
    ends = last.join(ring, "part").drop("part").join(first.withColumnRenamed("part", "after"), "after")
    schema = to_arrow_schema(out)

    def close(batches):
        for batch in batches:
            for part in slices(batch, 16):
                done = []
                for name, own, following in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
                    codes = codes_of(own)
                    done.append(_compared(name, own, codes, fingerprint(codes), following, fingerprint(codes_of(following))))
                yield _rows(done, schema)

    closed = ends.select("doc_id", "text", "following").mapInArrow(close, out)
    return walked.where(F.col("role") == _DONE).select(*out.names).unionByName(closed)


_DONE, _FIRST, _LAST = 0, 1, 2


def _compared(name, text: str, codes: np.ndarray, fp: np.ndarray, following: str, next_fp: np.ndarray) -> tuple:
    changed = edited(text, following)
    own = fingerprint(codes_of(changed)) if changed != text else fp
    return (name, len(codes), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), as_text(fp), as_text(own),
            likeness(fp, own), likeness(fp, next_fp))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _walk(full: T.StructType):
    """Compares each sorted row of a partition with the next; the first and the last keep their texts."""
    schema = to_arrow_schema(full)
    empty = (None,) * len(_PAIRED.fields)

    def run(batches):
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            for rows in slices(batch, 128):
                done = []
                for name, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                    codes = codes_of(text)
                    fp = fingerprint(codes)
                    if held is None:
                        done.append((name, *empty, part, _FIRST, text))
                    else:
                        done.append((*_compared(*held, text, fp), part, _DONE, None))
                    held = (name, text, codes, fp)
                yield _rows(done, schema)
        if held is not None:
            yield _rows([(held[0], *empty, part, _LAST, held[1])], schema)

    return run
