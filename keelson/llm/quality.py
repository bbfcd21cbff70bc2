"""Quality classifier: a factorization machine over hashed words and structure statistics.

Score: sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j). The pairwise part is summed in
time linear in the features by the identity 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2].

Features of a whole text: its distinct words, hashed into a fixed number of slots and weighted by
the logarithm of their counts (unit length over the text); statistics of its structure (shares of
capitals, digits, symbols, repeats, line and word lengths, sizes), each as a number and as the bin
it falls in. Labels, language, source and ids are never features.

The model is fitted by mini-batch Adam on at most ``SAMPLE_ROWS`` labelled documents (those whose id
hashes lowest), the only rows that reach the driver, as feature vectors; it has a fixed size. All
documents are then scored where they lie, without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import slices, texts_of

#: Bound on the labelled rows a fit reads, word slots, factors per feature, and the score from
#: which a document passes.
SAMPLE_ROWS, SLOTS, RANK, THRESHOLD = 6_000, 1 << 16, 8, 0.3
#: Rows visited by a fit (so 8 to 40 epochs), rows of a mini-batch, step size, decay of word weights.
VISITS, BATCH, RATE, WORD_DECAY, SEED = 60_000, 128, 0.02, 2e-3, 7
_KNOWN_WORDS = 400_000
_STATS = 16
_EDGES = np.array([0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
_BINS = len(_EDGES) + 1
FEATURES = SLOTS + _STATS * (1 + _BINS)

_known: dict[bytes, int] = {}


def _slot(word: bytes) -> int:
    slot = _known.get(word)
    if slot is None:
        if len(_known) > _KNOWN_WORDS:
            _known.clear()
        slot = _known[word] = xxhash.xxh64_intdigest(word, SEED) % SLOTS
    return slot


def _byte_set(chars: bytes) -> np.ndarray:
    mask = np.zeros(256)
    mask[list(chars)] = 1
    return mask


_UPPER = _byte_set(bytes(range(65, 91)))
_LETTER = _UPPER + _byte_set(bytes(range(97, 123)))
_DIGIT = _byte_set(b"0123456789")
_PROSE = _byte_set(b".,;:'\"-?()")
_SYMBOL = _byte_set(bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,;:'\"-?()"))


def statistics(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Structure of a text as numbers between 0 and 1 (sizes on a logarithmic scale)."""
    n, size = len(words), len(raw)
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if size else np.zeros(256)
    solid = max(1.0, float(chars.sum() - chars[[9, 10, 11, 12, 13, 32]].sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:]))
    share = lambda x, of: float(x) / of if of else 0.0
    return [
        1.0,
        min(1.0, np.log1p(n) / 12),
        min(1.0, np.log1p(size) / 16),
        share(chars @ _UPPER, max(1.0, chars @ _LETTER)),
        share(chars @ _DIGIT, solid),
        share(chars @ _SYMBOL, solid),
        share(chars @ _PROSE, solid),
        min(1.0, share(chars[ord("|")], n)),
        min(1.0, share(chars[ord("!")], n)),
        share(again, max(1, n - 1)),
        share(len(counts), n),
        share(max(counts.values(), default=0), n),
        1 - share(len(set(lines)), len(lines)) if lines else 0.0,
        min(1.0, share(size, 40 * max(1, len(lines))) / 20),
        min(1.0, share(solid if n else 0, n) / 20),
        share(sum(c for c in counts.values() if c > 1), n),
    ]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    counts = Counter(words)
    stats = statistics(raw, words, counts)
    slots = np.fromiter(map(_slot, counts), np.int64, len(counts))
    values = np.log1p(np.fromiter(counts.values(), float, len(counts)))
    if len(values):
        values /= np.sqrt(values @ values)
    bins = np.searchsorted(_EDGES, stats, side="right")
    numbers = SLOTS + _STATS + np.arange(_STATS) * _BINS + bins
    return (np.concatenate([slots, SLOTS + np.arange(_STATS), numbers]),
            np.concatenate([values, stats, np.full(_STATS, 0.5)]))


@dataclass
class Machine:
    """A fitted factorization machine: intercept, weights, factors."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, index: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log odds of rows laid end to end; row r begins at ``starts[r]`` and none is empty."""
        vx = self.v[index] * x[:, None]
        pairs = (np.add.reduceat(vx, starts) ** 2 - np.add.reduceat(vx * vx, starts)).sum(axis=1) / 2
        return self.w0 + np.add.reduceat(self.w[index] * x, starts) + pairs


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Fit on feature vectors, in the given order; without both labels the score is their share."""
    rng = np.random.default_rng(SEED)
    share = float(np.mean(labels)) if len(labels) else 0.5
    w0 = float(np.clip(np.log((share + 1e-3) / (1 - share + 1e-3)), -4, 4))
    w, v = np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, RANK))
    if not len(labels) or share in (0.0, 1.0):
        return Machine(w0, w, np.zeros_like(v))
    theta = np.concatenate([w[:, None], v], axis=1)
    m, s, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(min(40, max(8, VISITS // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            index = np.concatenate([rows[r][0] for r in chosen])
            x = np.concatenate([rows[r][1] for r in chosen])
            sizes = np.array([len(rows[r][0]) for r in chosen])
            starts = np.cumsum(sizes) - sizes
            used, place = np.unique(index, return_inverse=True)
            now = theta[used]
            vx = now[place, 1:] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            z = w0 + np.add.reduceat(now[place, 0] * x, starts) + (sums ** 2 - np.add.reduceat(vx * vx, starts)).sum(axis=1) / 2
            error = (_sigmoid(z) - labels[chosen]) / len(chosen)
            each = np.repeat(error, sizes) * x
            terms = np.concatenate([each[:, None], each[:, None] * (np.repeat(sums, sizes, axis=0) - vx)], axis=1)
            by = np.argsort(place, kind="stable")
            edges = np.searchsorted(place[by], np.arange(len(used)))
            gradient = np.add.reduceat(terms[by], edges) + np.where(used < SLOTS, WORD_DECAY, 1e-5)[:, None] * now
            step += 1
            m[used] = 0.9 * m[used] + 0.1 * gradient
            s[used] = 0.999 * s[used] + 0.001 * gradient ** 2
            theta[used] = now - RATE * (m[used] / (1 - 0.9 ** step)) / (np.sqrt(s[used] / (1 - 0.999 ** step)) + 1e-8)
            w0 -= RATE * float(error.sum())
    return Machine(w0, theta[:, 0].copy(), theta[:, 1:].copy())


def held_out(doc_id: Column) -> Column:
    """True for the fold that no fit reads: crc32 of the id as text, divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
        sample_rows: int = SAMPLE_ROWS) -> Machine:
    """A machine fitted on at most ``sample_rows`` labelled documents outside the held-out fold.

    Labels other than 0 and 1, null ids and labelled ids without a document are not used. An id that
    repeats in ``docs`` counts once for each of its labels, with the text whose hash is least (null
    texts read as empty), so that at most ``sample_rows`` rows reach the driver. Ties go by id, and reruns agree.
    Without labelled rows the machine scores everything alike. Further columns are not read.
    """
    known = (labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y"))
             .where(F.col("__y").isin(0, 1)).where(~held_out(F.col("__id"))))
    known = known.orderBy(F.xxhash64("__id"), "__id", "__y").limit(int(sample_rows))  # bounds what is broadcast
    picked = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id")
    picked = picked.groupBy("__id", "__y").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), "__text")).alias("least"))
    picked = picked.select("__id", "__y", F.col("least.__text").alias("__text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                found = [features(t) for t in texts_of(part, "__text")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([str(x) for x in part.column("__id").to_pylist()]), part.column("__y"),
                     pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())),
                     pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))], names=["id", "y", "i", "x"])

    got = picked.mapInArrow(run, "id string, y int, i array<int>, x array<float>").toArrow()
    rows = sorted(zip(got["id"].to_pylist(), got["y"].to_pylist(), got["i"].to_numpy(), got["x"].to_numpy()),
                  key=lambda r: (r[0], r[1], len(r[2]), r[3].tobytes()))[:int(sample_rows)]
    return fit_rows([(i.astype(np.int64), x.astype(float)) for _, _, i, x in rows], np.array([r[1] for r in rows], float))


def _scores(machine: Machine, texts: list[str]) -> np.ndarray:
    found = [features(t) for t in texts]
    sizes = np.array([len(i) for i, _ in found])
    z = machine.margins(np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found]), np.cumsum(sizes) - sizes)
    return _sigmoid(z)


def score(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, predicted)``, one row per row of ``docs``.

    ``score`` (0 to 1) is the probability of a good document, ``predicted`` is 1 from ``threshold``
    on. Null texts read as empty, and empty texts get the score of their statistics. Null and
    repeated ids and repeated rows keep one row each; further columns are not read. An empty table
    gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_scores(machine, texts_of(part)))],
                                                 names=["doc_id", "score"])

    return rows.mapInArrow(run, out).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose score reaches ``threshold``.

    Null texts read as empty, and empty texts have the score of their statistics. Rows with null or
    repeated ids and repeated rows are judged one by one, equal texts alike. An empty table stays empty.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                yield part.filter(pa.array(_scores(machine, texts_of(part, text)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
