"""Fuzzy line dedup: MinHash banding, exact Jaccard verification, distributed union-find.

A line is a document's text between line feeds, without white space at its ends; blank lines are
never duplicates. Its shingles are the distinct runs of ``SHINGLE`` characters (a shorter line is its
own one shingle).

1. Lines are listed as (hash, place). Each task signs each distinct line once: ``BANDS * ROWS``
   MinHash values, computed for blocks of lines of similar length, hashed band by band. With 16
   bands of 6 rows a pair at similarity 0.8 meets in a band with probability 0.992.
2. Lines that meet another in a band are collisions, the rest leave at once. Bands whose members
   are the same set are kept once.
3. Only colliding lines fetch their text. Pairs of a bucket are verified by exact Jaccard
   similarity, skipping those that a union-find already joins. Buckets with the same least line are
   verified together, and a pair that meets in several of them once. A bucket of more than
   ``BLOCK_LINES`` is cut into blocks, and each pair of blocks is a group of its own.
4. Components come from the distributed union-find of :mod:`keelson.llm.components`. One place of
   each component keeps its line, the first by document id; the others lose theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import Scratch, row_key, shuffle_partitions, slices, whole_rows
from keelson.llm.components import UnionFind, connected_components

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 16, 6, 0.8
#: Lines of a block of a large bucket.
BLOCK_LINES = 512
#: Band keys of a partition, which one task holds.
MET_ROWS = 1 << 21
#: Band keys that a signing task packs at once.
PACKED_KEYS = 1 << 20
#: Characters of lines that are shingled at once.
_VERIFIED_CHARS = 1 << 18
_BLANKS, _SEED, _CELLS, _RUNS = " \t\n\v\f\r", 42, 1 << 17, 1 << 15
_BLANK_BYTES, _FULL = _BLANKS.encode(), (1 << 64) - 1
_B = np.uint64(0x9E3779B97F4A7C15)
_B32 = np.uint32(0x9E3779B1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _mix32(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def lines_of(text: str) -> list[str]:
    return text.split("\n")


def line_id(line: str) -> int:
    """Signed 64-bit hash of a line (without white space at its ends)."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), _SEED)
    return h - (1 << 64) if h >> 63 else h


def _named(batch: pa.RecordBatch):
    """Per text of a batch (null: empty) its non-blank lines as ``(place, line, hash)``: UTF-8 bytes, stripped, and :func:`line_id` unsigned."""
    hashed = xxhash.xxh64_intdigest
    for text in batch.column("text").cast(pa.binary()).to_pylist():
        yield [(i, x, hashed(x, _SEED)) for i, line in enumerate((text or b"").split(b"\n")) if (x := line.strip(_BLANK_BYTES))]


def _signed(hashes) -> np.ndarray:
    return np.array(hashes, np.uint64).view(np.int64)


def shingles(line: str, length: int = SHINGLE) -> set[str]:
    return {line[i:i + length] for i in range(max(1, len(line) - length + 1))}


def shingle_arrays(lines: list[str], length: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each line as sorted 64-bit hashes, computed over all lines at once."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    runs = codes[:max(0, len(codes) - length + 1)].copy()
    for k in range(1, length):
        runs = runs * _B + codes[k:k + len(runs)]
    hashes, out, at = _mix(runs), [], 0
    for line in lines:
        if len(line) < length:  # a short line is its own one shingle
            out.append(np.array([line_id(line) & _FULL], np.uint64))
        else:
            own = np.sort(hashes[at:at + len(line) - length + 1])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        at += len(line)
    return out


def shingle_hashes(lines: list[str], length: int = SHINGLE) -> list[set[int]]:
    """:func:`shingle_arrays` as sets."""
    return [set(x.tolist()) for x in shingle_arrays(lines, length)]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    both = np.concatenate((a, b))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def band_keys(lines: list[str], length: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One row of band hashes per (non-empty) line; the band's number is part of the hash."""
    rng = np.random.default_rng(_SEED)
    factors = (rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    sizes = np.array([len(x) for x in lines])
    starts = np.cumsum(sizes) - sizes
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes = np.zeros(len(codes), np.uint32)  # of the run that starts at each character
    for start in range(0, len(codes) - length + 1, _RUNS):  # a part that stays in the processor's cache
        end = min(start + _RUNS, len(codes) - length + 1)
        runs = codes[start:end].copy()
        for k in range(1, length):
            runs *= _B32
            runs += codes[start + k:end + k]
        hashes[start:end] = _mix32(runs)
    for i in np.flatnonzero(sizes < length):  # a short line is one shingle
        whole = int(sizes[i])
        for c in codes[starts[i]:starts[i] + sizes[i]].tolist():
            whole = (whole * int(_B32) + c) & 0xFFFFFFFF
        hashes[starts[i]] = _mix32(np.array([whole], np.uint32))[0]
    heights = np.maximum(1, sizes - length + 1)
    order = np.argsort(heights, kind="stable")
    sorted_heights = heights[order]
    out = np.empty((len(lines), bands), np.int64)
    mark = _mix(np.arange(1, bands + 1, dtype=np.uint64))
    at = 0
    while at < len(order):  # a block of lines of about one length, one row per line
        limit = int(sorted_heights[at]) * 9 // 8 + 4
        end = min(int(np.searchsorted(sorted_heights, limit, side="right")), at + max(1, _CELLS // limit))
        chosen = order[at:end]
        cells_at = np.minimum(np.arange(int(sorted_heights[end - 1])), heights[chosen, None] - 1)
        cells = hashes[cells_at + starts[chosen, None]]
        least = np.empty((bands * rows, len(chosen)), np.uint64)
        for k, factor in enumerate(factors):  # a product of odd factors permutes the hashes
            cells *= factor
            least[k] = cells.min(axis=1)
        keys = np.repeat(mark[:, None], len(chosen), axis=1)
        for r in range(rows):
            keys = _mix(keys * _B + least[r::rows])
        out[chosen] = keys.T.view(np.int64)
        at = end
    return out


def _list_lines(batches):
    for batch in batches:
        for part in slices(batch, 512):
            keys = [part.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]
            names, numbers, sizes = [], [], []
            for found in _named(part):
                names += [h for _, _, h in found]
                numbers += [i for i, _, _ in found]
                sizes.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(names)), *(pa.array(np.repeat(k, sizes)) for k in keys),
                 part.column("doc_id").take(pa.array(np.repeat(np.arange(part.num_rows), sizes))),
                 pa.array(numbers, pa.int32())], names=["line", "a", "b", "doc_id", "at"])


def _packed(parts: int, batches):
    """Rows ``(part, keys, lines)`` of batches of ``key`` and ``line``: what goes to the same part is one
    row, as 64-bit numbers, so that the shuffle moves few long rows."""
    def pack(held):
        keys, lines = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("key", "line"))
        part = (keys.view(np.uint64) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int32)
        order, counts = np.argsort(part, kind="stable"), np.bincount(part)
        own = np.flatnonzero(counts)
        ends = np.r_[0, np.cumsum(8 * counts[own])].astype(np.int32)
        columns = [pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(x[order])]) for x in (keys, lines)]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *columns], names=["part", "keys", "lines"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PACKED_KEYS:
            yield pack(held)
            held, size = [], 0
    if size:
        yield pack(held)


def _unpacked(batches):
    """The ``key`` and ``line`` of :func:`_packed` rows."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64)) for c in ("keys", "lines")],
                                         names=["key", "line"])


def _list_bands(length: int, bands: int, rows: int):
    def run(batches):
        seen: set[int] = set()  # lines this task has signed: at most those of its split
        for batch in batches:
            for part in slices(batch, 512):
                new: dict[int, bytes] = {}
                for found in _named(part):
                    for _, x, h in found:
                        if h not in seen:
                            new[h] = x
                            seen.add(h)
                keys = band_keys([x.decode() for x in new.values()], length, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1)), pa.array(np.repeat(_signed(list(new)), bands))],
                    names=["key", "line"])

    return run


def _collisions(batches):
    """Of rows sorted by key and line: the different ones whose key another line shares."""
    key, line, told = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the last entry so far
    for batch in batches:
        keys = np.r_[key, batch.column("key").to_numpy()]
        lines = np.r_[line, batch.column("line").to_numpy()]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (lines[1:] != lines[:-1])][:len(keys)]
        keys, lines = keys[new], lines[new]
        same = keys[1:] == keys[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        last = bool(keep[-1])
        if told:
            last, keep[0] = last or len(keep) == 1, False
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(lines[keep])], names=["key", "line"])
        key, line, told = keys[-1:], lines[-1:], last


def _met(batches):
    """:func:`_collisions` of all rows of a partition, in any order. Few keys are shared, so rows are
    sorted by key alone and only those that share one by line."""
    found = [(b.column("key").to_numpy(), b.column("line").to_numpy()) for b in batches]
    if not found:
        return
    keys, lines = (np.concatenate(x) for x in zip(*found))
    del found
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    chosen = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
    keys, lines = keys[chosen], lines[chosen]
    order = np.lexsort((lines, keys))
    table = pa.Table.from_arrays([pa.array(keys[order]), pa.array(lines[order])], names=["key", "line"])
    yield from _collisions(table.to_batches(max_chunksize=1 << 16))


class _Verifier:
    """Exact Jaccard (of shingles as 64-bit hashes) over the lines of a group; pairs that are joined or known to differ are skipped."""

    def __init__(self, bags: list[np.ndarray], similarity: float):
        self.bags, self.similarity, self.sets, self.differ = bags, similarity, UnionFind(), set()

    def _similar(self, x: int, y: int) -> bool:
        a, b = self.bags[x], self.bags[y]
        size, other = len(a), len(b)
        if min(size, other) < self.similarity * max(size, other) or (x, y) in self.differ:
            return False
        both = shared(a, b)
        if both >= self.similarity * (size + other - both):
            return True
        self.differ.add((x, y))
        return False

    def _clusters(self, members: list[int]) -> list[list[int]]:
        """Members by the set they are in, so that lines already joined are one entry."""
        found: dict[int, list[int]] = {}
        for x in members:
            found.setdefault(self.sets.find(x), []).append(x)
        return list(found.values())

    def link(self, left: list[int], right: list[int] | None = None) -> None:
        """Joins the similar pairs within ``left``, or between ``left`` and ``right``.

        Clusters of joined lines are compared until one pair is similar; then they are one cluster.
        Pairs inside a cluster are never looked at.
        """
        if right is None:
            done: list[list[int]] = []
            for cluster in self._clusters(left):
                apart = []
                for other in done:
                    if any(self._similar(*((x, y) if x < y else (y, x))) for x in cluster for y in other):
                        self.sets.union(cluster[0], other[0])
                        cluster = cluster + other
                    else:
                        apart.append(other)
                done = [*apart, cluster]
            return
        others = self._clusters(right)
        for x in left:
            joined, apart = [], []
            for other in others:
                if self.sets.find(x) == self.sets.find(other[0]) or any(self._similar(*((x, y) if x < y else (y, x))) for y in other):
                    self.sets.union(x, other[0])
                    joined += other
                else:
                    apart.append(other)
            others = [*apart, joined] if joined else apart

    def edges(self, names: list[int]) -> list[tuple[int, int]]:
        return [(names[x], names[r]) for x in range(len(names)) if (r := self.sets.find(x)) != x]


def _sorted_groups(batches, group: list[str], columns: list[str]):
    """``(group, rows)`` of batches sorted by ``group``; one group is held at a time."""
    last, rows = None, []
    for batch in batches:
        for part in slices(batch, 1024):
            for *key, row in zip(*(part.column(c).to_pylist() for c in group), zip(*(part.column(c).to_pylist() for c in columns))):
                if key != last:
                    if len(rows) > 1:
                        yield last, rows
                    last, rows = key, []
                rows.append(row)
    if len(rows) > 1:
        yield last, rows


def _verified(groups, length: int, similarity: float, link):
    """Edges of groups ``(key, rows)``, the text last in a row; many small groups are shingled and leave together."""
    def edges(held):
        bags, at, found = shingle_arrays([r[-1] for _, rows in held for r in rows], length), 0, []
        for key, rows in held:
            verifier = _Verifier(bags[at:at + len(rows)], similarity)
            link(verifier, key, rows)
            found += verifier.edges([r[0] for r in rows])
            at += len(rows)
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    held, size = [], 0
    for key, rows in groups:
        held.append((key, rows))
        size += sum(len(r[-1]) for r in rows)
        if size >= _VERIFIED_CHARS:
            yield edges(held)
            held, size = [], 0
    if held:
        yield edges(held)


def _links_by_least(length: int, similarity: float):
    """Buckets that share their least line are verified together, so that a pair that meets in
    several of them is compared once."""

    def link(verifier, _, rows):
        buckets: dict[int, list[int]] = {}
        for n, (_, keys, _) in enumerate(rows):
            for key in keys:
                buckets.setdefault(key, []).append(n)
        for members in set(map(tuple, buckets.values())):
            verifier.link(list(members))

    def run(batches):
        yield from _verified(_sorted_groups(batches, ["least"], ["line", "keys", "text"]), length, similarity, link)

    return run


def _links_by_block(length: int, similarity: float):
    """One pair of blocks of a large bucket at a time."""

    def link(verifier, key, rows):
        _, i, j = key
        if i == j:
            verifier.link(list(range(len(rows))))
        else:
            verifier.link(*([n for n, r in enumerate(rows) if bool(r[1]) == right] for right in (False, True)))

    def run(batches):
        groups = _sorted_groups(batches, ["key", "i", "j"], ["line", "side", "text"])
        yield from _verified(groups, length, similarity, link)

    return run


_TEXTS = T.StructType([T.StructField("line", T.LongType()), T.StructField("text", T.StringType())])


def _fetch(batches):
    for batch in batches:
        for part in slices(batch, 512):
            found: dict[int, bytes] = {}
            for named, wanted in zip(_named(part), part.column("wanted").to_pylist()):
                want = set(wanted)
                for _, x, h in named:
                    if (h - (1 << 64) if h >> 63 else h) in want:
                        found[h] = x
            yield pa.RecordBatch.from_arrays([pa.array(_signed(list(found))), pa.array(list(found.values()), pa.binary()).cast(pa.string())],
                                             names=["line", "text"])


def similar_lines(docs: DataFrame, scratch: Scratch, length: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
                  similarity: float = SIMILARITY, block_lines: int = BLOCK_LINES) -> tuple[DataFrame, DataFrame]:
    """``(places, components)`` of documents ``(doc_id, text, a, b)``.

    ``places`` has a row ``(line, a, b, doc_id, at)`` per non-blank line; ``components`` the
    ``(node, component)`` of the lines linked to others by Jaccard similarity.
    """
    n = shuffle_partitions(docs.sparkSession)
    out = T.StructType([T.StructField("line", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                        docs.schema["doc_id"], T.StructField("at", T.IntegerType())])
    places = scratch.stage(docs.mapInArrow(_list_lines, out))
    dealt = max(n, -(-places.count() * bands // MET_ROWS))
    sign = _list_bands(length, bands, rows)
    signed = docs.select("text").mapInArrow(lambda batches: _packed(dealt, sign(batches)), "part int, keys binary, lines binary")
    met = scratch.stage(signed.repartitionById(dealt, "part").mapInArrow(lambda batches: _met(_unpacked(batches)), "key long, line long"))
    sets = met.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("line")).alias("x"),
                                  F.bit_xor(F.xxhash64("line", F.lit(1))).alias("y"), F.min("line").alias("least"))
    once = (sets.groupBy("size", "x", "y", "least").agg(F.min("key").alias("key"))
            .select("key", "least", F.expr(f"int((size - 1) div {int(block_lines)}) + 1").alias("blocks")))
    buckets = scratch.stage(met.join(once, "key"))
    where = (places.join(buckets.select("line").distinct(), "line", "left_semi").groupBy("line")
             .agg(F.min(F.struct("a", "b")).alias("p")).groupBy("p.a", "p.b").agg(F.collect_set("line").alias("wanted")))
    texts = scratch.stage(docs.join(where, ["a", "b"]).select("text", "wanted").mapInArrow(_fetch, _TEXTS)
                          .dropDuplicates(["line"]))
    small = (buckets.where("blocks = 1").groupBy("least", "line").agg(F.collect_set("key").alias("keys")).join(texts, "line")
             .select("least", "line", "keys", "text").repartition(n, "least").sortWithinPartitions("least", "line")
             .mapInArrow(_links_by_least(length, similarity), "u long, v long"))
    large = (buckets.where("blocks > 1").join(texts, "line")
             .withColumn("own", F.pmod(F.xxhash64("line", F.lit(2)), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     (F.col("own") > F.col("other")).alias("side"), "line", "text")
             .repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "line")
             .mapInArrow(_links_by_block(length, similarity), "u long, v long"))
    edges = scratch.stage(small.unionByName(large))
    return places, connected_components(edges, scratch)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str | None = None, **options) -> DataFrame:
    """The rows of ``docs``, all columns, with ``text`` freed of lines that another place keeps.

    Over the whole corpus one line of each component stays: that of the least document id (nulls
    last), then the least hash of id and text, then the first in its text. Other lines go with
    their line feed; blank lines stay. Of rows equal in id and text the first alone keeps lines.
    Null texts stay null. With ``removed`` given, a column of that name counts the lines that went.
    An empty table gives no rows.
    """
    scratch, n = Scratch(docs.sparkSession, "lines"), shuffle_partitions(docs.sparkSession)
    key = row_key(doc_id, text)
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), key["a"].alias("a"), key["b"].alias("b"))
    places, parts = similar_lines(read, scratch, **options)
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "a", "b", "at")
    per_line = places.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    per_line = (per_line.join(parts.withColumnRenamed("node", "line"), "line", "left").where("copies > 1 or component is not null")
                .withColumn("component", F.coalesce("component", "line")))
    kept = per_line.groupBy("component").agg(F.min("first").alias("kept"))
    named = scratch.stage(per_line.join(kept, "component").select("line", F.col("kept.a").alias("ka"), F.col("kept.b").alias("kb"),
                                                                  F.col("kept.at").alias("kat")))
    gone = scratch.stage(places.join(named, "line").where("not (a = ka and b = kb and at = kat)")
                         .groupBy("a", "b").agg(F.collect_set("at").alias("gone")))
    again = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.lit(0))) > 1
    rows = (whole_rows(docs, doc_id, text).repartition(n, "a", "b").withColumn("again", again)
            .join(gone, ["a", "b"], "left").select("row", "again", "gone"))
    schema = T.StructType([*docs.schema.fields, *([T.StructField(removed, T.LongType())] if removed else [])])
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 256):
                arrays = pa.array(part.column("row")).flatten()
                found, counts = [], []
                for value, copy, listed in zip(arrays[at].to_pylist(), part.column("again").to_pylist(), part.column("gone").to_pylist()):
                    if value is None or not (copy or listed):
                        found.append(value)
                        counts.append(0)
                        continue
                    drop, old = set(listed or ()), lines_of(value)
                    keep = [x for i, x in enumerate(old) if not (i in drop or copy and x.strip(_BLANKS))]
                    found.append("\n".join(keep))
                    counts.append(len(old) - len(keep))
                arrays[at] = pa.array(found, arrays[at].type)
                if removed:
                    arrays.append(pa.array(counts, pa.int64()))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)
