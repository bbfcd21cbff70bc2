"""Bounded-space online packing of tokenized documents into fixed windows.

Each partition reads its documents once and keeps a fixed number of open windows. A document's
full windows leave at once; its remainder goes to the open window it fits best (least room left).
When none fits and all windows are open, the fullest window is filled from the front of the piece
and emitted, and the rest of the piece is placed in turn. What is still open when a partition ends is
staged, and packed again by groups of partitions, level by level, until one group is left; there
the last windows are filled up one from another, and the last tokens leave as sequences whose
lengths are powers of two, which need no padding.

Memory per task: the open windows and one slice of documents. No document meets another partition
but for its leftovers, and nothing is shuffled but those.
"""

from __future__ import annotations

import os
import re
import unicodedata
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import Scratch, slices, texts_of

VOCABULARY, END_ID, WINDOW = "word_bpe_49k.json", 1, 2048
#: Open windows of a partition, and leftover partitions that are packed together at each level.
OPEN_WINDOWS, FAN_IN = 64, 64
#: Chunks between white space whose ids a worker remembers, and the longest of them.
CACHE_ENTRIES, CACHE_BYTES = 1_000_000, 48
_BLOCK_BYTES, _GROUP_BYTES, _SLICE_ROWS, _FLUSH_TOKENS, _JOINED = 1 << 20, 4 << 20, 1024, 1 << 20, 500
_ID = np.dtype("<u4")


#: Marks that compose with A-Z or a-z.
_MARKS = re.compile("[\u0300-\u037f]")
_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")  # fixed value: the vocabulary's pattern over ASCII


def _words(chunk: bytes) -> int:
    """How many words the vocabulary sees in a chunk; 0 where that is not plain."""
    if chunk.isascii():
        return 0 if b"<|" in chunk else 1 if chunk.isalpha() else len(_WORDS.findall(chunk.lower()))
    text = chunk.decode()
    return int(text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha())


class Tokens:
    """Ids of whole texts. The vocabulary's pattern never crosses white space and drops it, so a
    text's ids are those of its chunks between ASCII white space, which are remembered."""

    _shared: dict[str, Tokens] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        # which ids end a word, where the vocabulary marks them
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    @classmethod
    def of(cls, vocabulary: str) -> Tokens:
        if vocabulary not in cls._shared:
            import public_tokenizers

            path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
            cls._shared[vocabulary] = cls(path)
        return cls._shared[vocabulary]

    def _learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of unknown chunks. Those whose number of words is known go many to a text, line by line:
        the last token of every word is marked as such in the vocabulary, so that counting words tells
        where a chunk ends. If the count is off, and for all other chunks, each goes by itself."""
        found: dict[bytes, bytes] = {}
        if self.ends is not None:
            single = [c for c in chunks if c.isalpha()]  # ASCII letters alone are one word
            self._joined(single, None, found)
            mixed = [(c, n) for c in chunks if not c.isalpha() and (n := _words(c))]
            self._joined([c for c, _ in mixed], np.array([n for _, n in mixed], np.int64), found)
        rest = [c for c in chunks if c not in found]
        encoded = self.tokenizer.encode_batch_fast([c.decode() for c in rest], add_special_tokens=False)
        found.update((c, np.array(e.ids, _ID).tobytes()) for c, e in zip(rest, encoded))
        if len(self.known) + len(found) > CACHE_ENTRIES:
            self.known.clear()
        self.known.update(found if max(map(len, found), default=0) <= CACHE_BYTES else
                          {c: ids for c, ids in found.items() if len(c) <= CACHE_BYTES})
        return found

    def _joined(self, chunks: list[bytes], words: np.ndarray | None, found: dict[bytes, bytes]) -> None:
        """Adds the ids of chunks of so many words each (of one, if not given)."""
        for at in range(0, len(chunks), _JOINED):
            part = chunks[at:at + _JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([b"\n".join(part).decode()], add_special_tokens=False)[0].ids, _ID)
            last = np.arange(len(part)) if words is None else np.cumsum(words[at:at + _JOINED]) - 1
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != last[-1] + 1 or ends[-1] != len(ids):
                continue
            raw, stops = ids.tobytes(), (ends[last] * _ID.itemsize).tolist()
            found.update(zip(part, [raw[a:b] for a, b in zip([0, *stops], stops)]))

    def _blocks(self, text: str):
        """Lists of chunks. Letters A-Z are lowered first, as the vocabulary does, so that fewer
        chunks differ, unless the text may spell a special token. The vocabulary composes characters
        before it lowers them: where marks that compose with A-Z or a-z occur (U+0300 to U+037F,
        whose first bytes are CC and CD), only chunks of ASCII alone are lowered here."""
        raw = text.encode("utf-8")
        keep = b"<|" in raw
        start = 0
        while start < len(raw):
            end = min(len(raw), start + _BLOCK_BYTES)
            while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
                end += 1
            block = raw[start:end]
            if keep:
                yield block.split()
            elif b"\xcc" not in block and b"\xcd" not in block:
                yield block.lower().split()
            else:
                yield [c.lower() if c.isascii() else c for c in block.split()]
            start = end

    def _found(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk; unknown ones are encoded in one call."""
        ids = list(map(self.known.get, chunks))
        if None in ids:
            new = self._learn(list({c for c, x in zip(chunks, ids) if x is None}))
            ids = [new[c] if x is None else x for c, x in zip(chunks, ids)]
        return ids

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may be lowered as a whole: Arrow cuts them into chunks and numbers the
        distinct ones, these are looked up once, and one gather writes the ids of all texts."""
        cut = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
        flat = cut.flatten().dictionary_encode()
        distinct = self._found(flat.dictionary.cast(pa.large_binary()).to_pylist())
        pool = np.frombuffer(b"".join(distinct), _ID)
        size = np.array([len(x) for x in distinct], np.int64) // _ID.itemsize
        begin = np.cumsum(size) - size
        codes = flat.indices.to_numpy(zero_copy_only=False)
        n = size[codes]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = pool[np.repeat(begin[codes] - upto[:-1], n) + np.arange(upto[-1])]
        bounds = upto[np.asarray(cut.offsets) - cut.offsets[0].as_py()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def _group(self, texts: list[str]) -> list[bytes]:
        """Ids of each of some texts of bounded size."""
        plain = [i for i, t in enumerate(texts) if "<|" not in t and not _MARKS.search(t)]
        out = [b""] * len(texts)
        if plain:
            for i, ids in zip(plain, self._plain([texts[i] for i in plain])):
                out[i] = ids
        for i in set(range(len(texts))).difference(plain):
            out[i] = b"".join(self._found([c for chunks in self._blocks(texts[i]) for c in chunks]))
        return out

    def encode_all(self, texts: list[str]):
        """Little-endian unsigned 32-bit ids of each whole text, in order."""
        waiting: list[str] = []
        held = 0
        for text in texts:
            if len(text) >= _BLOCK_BYTES:  # a long text goes by itself, block by block
                yield from self._group(waiting)
                waiting, held = [], 0
                yield b"".join(x for chunks in self._blocks(text) for x in self._found(chunks))
                continue
            waiting.append(text)
            held += len(text)
            if held >= _GROUP_BYTES:
                yield from self._group(waiting)
                waiting, held = [], 0
        yield from self._group(waiting)


class Packer:
    """Best-fit online packing with a bounded number of open windows.

    ``add`` takes a piece as ``(tag, start, ids)``; ``done`` collects closed sequences as lists of
    ``(tag, start, ids, offset)``. Pieces may be cut anywhere; each id lands in exactly one piece.
    """

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.limit = window, open_windows
        self.rooms: list[tuple[int, int]] = []  # (room left, number), sorted
        self.open: dict[int, list] = {}
        self.count, self.done = 0, []

    def add(self, tag, start: int, ids: np.ndarray) -> None:
        while len(ids) >= self.window:
            self.done.append([(tag, start, ids[:self.window], 0)])
            start, ids = start + self.window, ids[self.window:]
        while len(ids):
            at = bisect_left(self.rooms, (len(ids), -1))
            if at == len(self.rooms) and len(self.rooms) < self.limit:
                self.count += 1
                self.open[self.count] = []
                room, number = self.window, self.count
            else:  # the best fit, or the fullest window if the piece fits none
                room, number = self.rooms.pop(at if at < len(self.rooms) else 0)
            part = ids[:room]
            self.open[number].append((tag, start, part, self.window - room))
            if len(part) == room:
                self.done.append(self.open.pop(number))
            else:
                insort(self.rooms, (room - len(part), number))
            start, ids = start + len(part), ids[len(part):]

    def leftovers(self) -> list[list]:
        left = [self.open[number] for _, number in sorted(self.rooms)]
        self.rooms, self.open = [], {}
        return left

    def finish(self) -> None:
        """Close everything: fill windows one from another, then cut the last into powers of two."""
        pieces = [p[:3] for w in self.leftovers() for p in w]
        self.limit = 1  # the one open window always takes the next piece
        for tag, start, ids in pieces:
            self.add(tag, start, ids)
        for rest in self.leftovers():
            total = sum(len(p[2]) for p in rest)
            sizes = [1 << b for b in range(self.window.bit_length(), -1, -1) if total >> b & 1]
            queue = [p[:3] for p in rest]
            for size in sizes:
                sequence, at = [], 0
                while at < size:
                    tag, start, ids = queue.pop(0)
                    part = ids[:size - at]
                    sequence.append((tag, start, part, at))
                    at += len(part)
                    if len(part) < len(ids):
                        queue.insert(0, (tag, start + len(part), ids[len(part):]))
                self.done.append(sequence)


def _emit(packer: Packer, base: int, schema: pa.Schema, final: bool | None = None):
    """Batches of the packer's closed sequences; with ``final`` given also what is open."""
    groups = [(s, False) for s in packer.done]
    packer.done = []
    if final is False:
        groups += [(s, True) for s in packer.leftovers()]
    rows = []
    for sequence, is_open in groups:
        number = base + packer.number
        packer.number += 1
        rows += [(*tag, start, ids.tobytes(), number, offset, is_open) for tag, start, ids, offset in sequence]
        if len(rows) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _run(batches, feed, level: int, window: int, open_windows: int, schema: pa.Schema, final: bool):
    packer = Packer(window, open_windows)
    packer.number, base = 0, None
    for batch in batches:
        if base is None and batch.num_rows:  # a group of partitions is whole in one task, so its first group names it
            own = batch.column("g")[0].as_py() if level else TaskContext.get().partitionId()
            base = (level << 58) + (own << 32)
        for tag, start, ids in feed(batch):
            packer.add(tag, start, ids)
            if len(packer.done) * window >= _FLUSH_TOKENS:
                yield from _emit(packer, base, schema)
    if final:
        packer.finish()
    yield from _emit(packer, base, schema, final)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID,
         vocabulary: str = VOCABULARY, open_windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per piece: ``doc_id, start, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit numbers, ``start`` the ids
    of its document before it, ``doc_tokens`` those of the whole document with the closing
    ``end_id``. A sequence's pieces lie gapless from offset 0 and hold at most ``window`` ids; a
    shorter sequence is a power of two. Null texts read as empty and give the closing id alone.
    Null and repeated ids, and repeated rows, are documents of their own. Further columns are not
    read. An empty table gives no rows. ``vocabulary`` is a file's path, or a public file's name.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("doc_tokens", T.LongType()),
                        T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType()),
                        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
                        T.StructField("open", T.BooleanType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def read_texts(batch):
        tokens = Tokens.of(vocabulary)
        end = np.array([end_id], _ID).tobytes()
        for part in slices(batch, _SLICE_ROWS):
            for name, raw in zip(part.column("doc_id").to_pylist(), tokens.encode_all(texts_of(part))):
                ids = np.frombuffer(raw + end, _ID)
                yield (name, len(ids)), 0, ids

    def read_pieces(batch):
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start", "ids")]
        for name, size, start, ids in zip(*columns):
            yield (name, size), start, np.frombuffer(ids, _ID)

    now = scratch.stage(rows.mapInArrow(
        lambda batches: _run(batches, read_texts, 0, window, open_windows, arrow, False), out))
    parts, level = [], 0
    while True:
        parts.append(now.where("not open"))
        left = now.where("open")
        top = left.agg(F.max(F.expr("shiftrightunsigned(sequence_id, 32) & 67108863"))).first()[0]
        if top is None:
            break
        level += 1
        groups = top // fan_in + 1
        dealt = (left.withColumn("g", F.expr(f"(shiftrightunsigned(sequence_id, 32) & 67108863) div {int(fan_in)}"))
                 .repartition(groups, "g").sortWithinPartitions("g", "sequence_id", "offset"))
        run = _again(read_pieces, level, window, open_windows, arrow, groups == 1)
        now = scratch.stage(dealt.mapInArrow(run, out))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found.select("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset")


def _again(feed, level, window, open_windows, schema, final):
    return lambda batches: _run(batches, feed, level, window, open_windows, schema, final)
