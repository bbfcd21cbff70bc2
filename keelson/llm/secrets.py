"""Secret scans through nested encodings: a worklist of layers, decoded until nothing new appears.

Every text is scanned as it is (base spans). Then a worklist unwraps it: lines with URL escapes
(``%41``), lines with Unicode escapes (``\\u0041``, ``\\U00000041``, ``\\x41``, ``\\u{41}``, ``%u0041``), runs of base64 (plain
or URL-safe alphabet, also runs joined across line ends however short the lines; from each of the first four characters, as
other characters may stand before the encoded ones), and in the bytes behind base64 or escapes gzip, zlib, bzip2, xz or
Zstandard data, all members of it and compressed again or not. Decoded bytes are read one character a byte: the patterns and encodings are
ASCII, so bytes that are no text are noise which hides nothing. Each new layer is scanned with the same patterns and unwrapped in turn. A layer
seen before, with its text from the same places, ends its branch, as does one that repeats a layer
it came from (cycle detection); the same text from other places is a layer of its own. So the list
runs dry: escapes and base64 only shrink.

What a compressed run holds is decompressed piece by piece and scanned in windows that overlap, so a
layer of any size is scanned whole in bounded memory; all of it came from the one run, so that only
the kinds found in it count. A window grows while a compressed run inside it goes on past its end.
Only a bomb is cut: a document that gives more than ``MAX_EXPANDED`` bytes, or streams more than
``MAX_DEPTH`` deep, has ``cut`` set in its row.

Each layer carries, per character, the span of the original text it came from; spans found in a
layer are mapped back through it. Work is per document, in place, without a shuffle.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import slices, texts_of

#: Bytes that decompression may give per document, and compressed runs inside one another, beyond which it is a bomb.
MAX_EXPANDED, MAX_DEPTH = 16 << 30, 40
#: Bytes of a decompressed layer that one window adds, bytes that it shares with the one before, bytes of a piece.
_ADDED, _SHARED, _PIECE, _LITTLE = 4 << 20, 4 << 20, 1 << 16, 1 << 8

# fixed values: the kinds in listed order, their patterns and least lengths
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

_HEX_RUN = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_HIGH_URL = re.compile("%[0189A-Fa-f][0-9A-Fa-f]")  # bytes that text seldom has
_UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|%u([0-9A-Fa-f]{4})")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
# line ends, also as written in strings, with blanks around; each further line is a run as a whole
_END = r"[ \t]*+(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*+"
_LINE_END = re.compile(_END)
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{_END}[A-Za-z0-9+/_-]++(?==|[ \t]*+(?:[\r\n\\\"'<>,;)\]}}]|\Z)))++={{0,2}}")
_BYTES = re.compile("[\0-\xff]{8,}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|[\x50-\x5f]\x2a\x4d\x18", re.S)


def _may_wrap(text: str) -> bool:
    """True if 16 base64 characters or more stand on lines of their own, however short these are."""
    if "\n" not in text and "\r" not in text and "\\n" not in text:
        return False
    return any(len(_LINE_END.sub("", m[0])) >= 16 for m in _WRAPPED.finditer(text))


def _table(chars: str) -> bytes:
    marked = set(chars.encode())
    return bytes(49 if c in marked else 48 for c in range(256))


_HEX_TABLE = _table("0123456789abcdef")
_B64_TABLE = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


@dataclass
class Layer:
    """A decoded text; character i came from ``start[i]:stop[i]`` of the original.

    ``goes_on`` marks a text that ends where a window ends, so that more of it may follow."""

    text: str
    start: np.ndarray
    stop: np.ndarray
    goes_on: bool = False

    @classmethod
    def flat(cls, text: str, start: int, stop: int, goes_on: bool = False) -> Layer:
        """A text that came from one place as a whole."""
        return cls(text, *(np.broadcast_to(np.int64(x), len(text)) for x in (start, stop)), goes_on)

    @property
    def is_flat(self) -> bool:
        return self.start.strides == (0,)

    def cut(self, a: int, b: int) -> Layer:
        return Layer(self.text[a:b], self.start[a:b], self.stop[a:b], self.goes_on and b == len(self.text))

    def key(self, raw: bytes) -> bytes:
        """Equal for layers with the same text from the same places."""
        h = hashlib.blake2b(raw, digest_size=16)
        few = 1 if self.is_flat else len(self.start)
        h.update(b"\xff" + self.start[:few].tobytes() + self.stop[:few].tobytes())
        return h.digest()


def scan(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """``(start, kind number, stop)`` of the secrets of one layer, in order."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):  # any match holds one of them
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if b"1" * MIN_HEX in raw.translate(_HEX_TABLE):  # a whole run is one match, so short ones may be skipped
        found += [(m.start(), 2, m.end()) for m in _HEX_RUN.finditer(text)]
    return sorted(found)


def _lines_with(text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Bounds of the lines that hold a match."""
    found: list[tuple[int, int]] = []
    for m in pattern.finditer(text):
        if not found or m.start() >= found[-1][1]:
            stop = text.find("\n", m.end())
            found.append((text.rfind("\n", 0, m.start()) + 1, stop if stop >= 0 else len(text)))
    return found


def _spliced(layer: Layer, pattern: re.Pattern, decode) -> Layer:
    """The layer with every match replaced by ``decode(match)``: pieces ``(text, from, to)``."""
    texts, starts, stops, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        texts.append(layer.text[at:m.start()])
        starts.append(layer.start[at:m.start()])
        stops.append(layer.stop[at:m.start()])
        for piece, a, b in decode(m):
            texts.append(piece)
            starts.append(np.full(len(piece), layer.start[m.start() + a]))
            stops.append(np.full(len(piece), layer.stop[m.start() + b - 1]))
        at = m.end()
    texts.append(layer.text[at:])
    starts.append(layer.start[at:])
    stops.append(layer.stop[at:])
    if layer.is_flat:
        return Layer.flat("".join(texts), layer.start[0], layer.stop[0], layer.goes_on)
    return Layer("".join(texts), np.concatenate(starts), np.concatenate(stops), layer.goes_on)


def _characters(raw: bytes) -> list[tuple[str, int, int]]:
    """UTF-8 characters with their byte bounds; a bad byte is one replacement character."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append((raw[at:at + size].decode(), at, at + size))
                break
            except UnicodeDecodeError:
                if size == 4:
                    out.append(("�", at, at + 1))
                    size = 1
                    break
        at += size
    return out


def _url(m: re.Match):
    return [(c, 3 * a, 3 * b) for c, a, b in _characters(bytes.fromhex(m[0].replace("%", "")))]


def _url_bytes(m: re.Match):
    """One character a byte."""
    return [(chr(b), 3 * i, 3 * i + 3) for i, b in enumerate(bytes.fromhex(m[0].replace("%", "")))]


def _unicode(m: re.Match):
    code = int(next(g for g in m.groups() if g), 16)
    return [(chr(code) if code < 0x110000 else "�", 0, m.end() - m.start())]


def _pairs(layer: Layer) -> Layer:
    """Joins surrogate pairs written as two escapes; lone surrogates become replacement characters."""
    def join(m: re.Match):
        if len(m[0]) == 2:
            return [(chr(0x10000 + (ord(m[0][0]) - 0xD800 << 10) + ord(m[0][1]) - 0xDC00), 0, 2)]
        return [("�", 0, 1)]

    if not re.search("[\ud800-\udfff]", layer.text):
        return layer
    return _spliced(layer, re.compile("[\ud800-\udbff][\udc00-\udfff]|[\ud800-\udfff]"), join)


def _format(head: bytes) -> str | None:
    """How bytes that begin like this are compressed, None if not in a known way."""
    if head[:2] == b"\x1f\x8b":
        return "zlib"
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return "zlib"
    if head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5:
        return "zstd"  # a frame to skip
    return {b"BZh": "bz2", b"\xfd7z": "xz", b"\x28\xb5\x2f": "zstd"}.get(head[:3])


@dataclass
class _Ends:
    """How compressed bytes end: too early, or with bytes that are not compressed data."""

    short: bool = False
    odd: bool = False


def _unpacker(form: str):
    if form == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return {"zlib": lambda: zlib.decompressobj(47), "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[form]()


def _unpacked(pieces: Iterator[bytes], ends: _Ends) -> Iterator[bytes]:
    """What the members of compressed data hold, up to bytes that are not compressed."""
    data = b""
    try:
        while True:
            while len(data) < 6 and (piece := next(pieces, b"")):
                data = (data + piece).lstrip(b"\0")
            form = _format(data)
            if not form:
                ends.odd |= bool(data)
                return
            unpack = _unpacker(form)
            while not unpack.eof:
                if form == "zstd":  # has no bound on what it returns, so it gets little at once
                    out, data = unpack.decompress(data[:_LITTLE]), data[_LITTLE:]
                    wants = not data
                else:
                    out = unpack.decompress(data, _PIECE)
                    data = unpack.unconsumed_tail if form == "zlib" else b""
                    wants = not data and len(out) < _PIECE if form == "zlib" else unpack.needs_input
                if out:
                    yield out
                if wants and not unpack.eof:
                    data = next(pieces, b"")
                    if not data:
                        ends.short = True
                        return
            data = (unpack.unused_data + data if form == "zstd" else unpack.unused_data).lstrip(b"\0")
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
        ends.odd = True
    except Exception as bad:
        ends.odd = True
        if not type(bad).__module__.startswith("zstandard"):
            raise


def _compressed(layer: Layer) -> Iterator[Run]:
    """Compressed data in a layer of one character a byte. Characters that are no bytes end it."""
    for part in _BYTES.finditer(layer.text):
        raw, at = part[0].encode("latin-1"), 0
        for m in _MAGIC.finditer(raw):
            if m.start() < at or not _may_begin(raw[m.start():m.start() + _PIECE]):
                continue
            run = Run(raw[m.start():], int(layer.start[part.start() + m.start()]), int(layer.stop[part.end() - 1]),
                      layer.goes_on and part.end() == len(layer.text))
            yield run
            if run.clean:  # the rest is inside it
                at = len(raw)


def _may_begin(raw: bytes) -> bool:
    """False if these are no first bytes of compressed data."""
    ends = _Ends()
    return any(True for _ in _unpacked(iter([raw]), ends)) or not ends.odd


class _Search:
    """Layers below one document: what is left of its bounds, and what its compressed runs held."""

    def __init__(self, max_expanded: int):
        self.left, self.depth, self.cut = max_expanded, 0, False
        self.streams: dict[bytes, tuple[frozenset[int], _Ends]] = {}

    def _inflated(self, raw: bytes, levels: int, ends: _Ends) -> Iterator[bytes]:
        """What compressed bytes hold, unwrapped so many times, in pieces."""
        pieces = (raw[i:i + _PIECE] for i in range(0, len(raw), _PIECE))
        for level in range(levels):
            pieces = self._counted(_unpacked(pieces, ends if level == 0 else _Ends()))
        return pieces

    def _counted(self, pieces: Iterator[bytes]) -> Iterator[bytes]:
        for out in pieces:
            if self.left <= 0:
                self.cut = True
                return
            self.left -= len(out)
            yield out

    def stream(self, raw: bytes) -> tuple[frozenset[int], _Ends]:
        """Kind numbers of the secrets anywhere in a compressed run, and how it ends."""
        key = hashlib.blake2b(raw, digest_size=16).digest()
        if key in self.streams:
            return self.streams[key]
        ends, kinds = _Ends(), set()
        if self.depth >= MAX_DEPTH:
            self.cut = True
            return frozenset(), ends
        self.streams[key] = frozenset(), ends  # a run inside itself adds nothing
        self.depth += 1
        for levels in range(1, MAX_DEPTH + 1):
            pieces = self._inflated(raw, levels, ends)
            head = self._windows(pieces, kinds)
            if levels == 1:
                for _ in pieces:  # how the run ends is known at its end only
                    pass
            if not _format(head) or len(kinds) == len(KINDS):
                break
        else:
            self.cut = True
        self.depth -= 1
        self.streams[key] = frozenset(kinds), ends
        return self.streams[key]

    def _windows(self, pieces: Iterator[bytes], kinds: set[int]) -> bytes:
        """Adds the kind numbers of a layer given in pieces; its first bytes."""
        window, more, head = b"", True, b""
        while more and len(kinds) < len(KINDS):
            parts, added = [window], 0
            while added < max(_ADDED, len(window) if len(window) > _SHARED else 0):
                piece = next(pieces, None)
                if piece is None:
                    more = False
                    break
                parts.append(piece)
                added += len(piece)
            window = b"".join(parts)
            head = head or window[:8]
            layer = Layer.flat(window.decode("latin-1"), 0, 1, more)
            kinds.update(kind for _, kind, _ in scan(layer.text, window))
            below: set[tuple[int, int, int]] = set()
            goes_on = self.walk(layer, window, below)
            kinds.update(kind for _, kind, _ in below)
            if more and not goes_on and len(window) > _SHARED:
                at = len(window) - _SHARED
                line = window.find(b"\n", at, at + _SHARED // 2)
                window = window[line + 1 if line >= 0 else at:]
        return head

    def walk(self, layer: Layer, raw: bytes, spans: set[tuple[int, int, int]]) -> bool:
        """Adds the spans of all layers below one; true if a compressed run may go on after its end."""
        seen, known, goes_on = set(), {}, False
        work = [(layer, raw, frozenset([layer.text]))]
        while work:
            layer, raw, above = work.pop()
            for child in _children(layer, raw):
                if isinstance(child, Run):
                    kinds, ends = self.stream(child.raw)
                    spans.update((child.start, kind, child.stop) for kind in kinds)
                    goes_on |= ends.short and child.goes_on
                    child.clean = not ends.short and not ends.odd
                    continue
                if child.text in above:
                    continue
                below = child.text.encode("utf-8", "surrogatepass")
                key = child.key(below)
                if key in seen:
                    continue
                seen.add(key)
                if child.text not in known:  # a repeat is only mapped to its own places
                    known[child.text] = scan(child.text, below)
                spans.update((int(child.start[a]), kind, int(child.stop[b - 1])) for a, kind, b in known[child.text])
                work.append((child, below, above | {child.text}))
        return goes_on


def _may_hold(raw: bytes) -> bool:
    """False for bytes without any secret or further encoding."""
    low = raw.lower()
    return (b"%" in raw or b"\\" in raw or b"AKIA" in raw or any(w.encode() in low for w in _WORDS)
            or b"1" * 16 in raw.translate(_B64_TABLE) or b"1" * MIN_HEX in raw.translate(_HEX_TABLE)
            or _may_wrap(raw.decode("latin-1")))


@dataclass
class Run:
    """Compressed bytes, which came from ``start:stop`` of the original; who unpacks them sets ``clean``
    if they are compressed data to their end."""

    raw: bytes
    start: int
    stop: int
    goes_on: bool
    clean: bool = False


def _runs(text: str) -> Iterator[tuple[str, np.ndarray, int, int]]:
    """Runs of base64 characters, their places in the text, and where the run with its padding begins and ends."""
    for m in _BASE64.finditer(text):
        body = m[0].rstrip("=")
        yield body, np.arange(m.start(), m.start() + len(body)), m.start(), m.end()
    for m in _WRAPPED.finditer(text):
        parts, at = [], m.start()
        for end in _LINE_END.finditer(text, m.start(), m.end()):
            parts.append((at, end.start()))
            at = end.end()
        parts.append((at, m.end() - len(m[0]) + len(m[0].rstrip("="))))
        body = "".join([text[a:b] for a, b in parts])
        if len(body) >= 16:
            yield body, np.concatenate([np.arange(a, b) for a, b in parts]), m.start(), m.end()


def _bytes_layer(raw: bytes, layer: Layer, places: np.ndarray, goes_on: bool) -> Layer:
    """Bytes as a layer of one character each; byte i came from bits 8i to 8i + 8 of base64 characters."""
    text = raw.decode("latin-1")
    if layer.is_flat:
        return Layer.flat(text, layer.start[0], layer.stop[0], goes_on)
    byte = np.arange(len(raw))
    return Layer(text, layer.start[places[byte * 8 // 6]], layer.stop[places[(byte * 8 + 7) // 6]], goes_on)


def _base64(layer: Layer):
    for body, places, start, stop in _runs(layer.text):
        goes_on = layer.goes_on and stop == len(layer.text)
        body = body.replace("-", "+").replace("_", "/")
        shifted, begins = [], []
        for shift in range(4):
            part = body[shift:len(body) - ((len(body) - shift) % 4 == 1)]  # one character alone holds no byte
            raw = base64.b64decode(part + "=" * (-len(part) % 4), validate=True)
            shifted.append(raw)
            begins += [(shift + m.start() // 3 * 4, shift, m.start()) for m in _MAGIC.finditer(raw) if m.start() % 3 == 0]
        if _format(shifted[0]):
            begins.append((0, 0, 0))
        end = len(body)
        for at, shift, byte in sorted(set(begins)):
            if at and not _may_begin(shifted[shift][byte:byte + _PIECE]):
                continue
            run = Run(shifted[shift][byte:], int(layer.start[places[at] if at else start]), int(layer.stop[stop - 1]), goes_on)
            yield run
            if run.clean:  # the rest is inside it
                end = at
                break
        for shift, raw in enumerate(shifted):
            raw = raw[:max(0, end - shift) * 6 // 8] if end < len(body) else raw
            if _may_hold(raw):
                yield _bytes_layer(raw, layer, places[shift:], goes_on and end == len(body))


def _to_last(line: Layer, pattern: re.Pattern) -> Layer:
    """A line up to its last escape and the characters that need none behind it."""
    end = max(m.end() for m in pattern.finditer(line.text))
    while end < len(line.text) and (line.text[end].isalnum() or line.text[end] in "_.~-"):
        end += 1
    return line.cut(0, end)


def _children(layer: Layer, raw: bytes):
    """What a layer holds one step further in: texts behind escapes and base64, and compressed data behind
    either. Escapes may stand for bytes that are no text, so that compressed data is looked for in their bytes."""
    text = layer.text
    if "%" in text:
        for a, b in _lines_with(text, _URL):
            line = layer.cut(a, b)
            yield _spliced(line, _URL, _url)
            if _HIGH_URL.search(text, a, b):
                yield from _compressed(_spliced(_to_last(line, _URL), _URL, _url_bytes))
    if "\\" in text or "%u" in text:
        for a, b in _lines_with(text, _UNICODE):
            line = layer.cut(a, b)
            yield _pairs(_spliced(line, _UNICODE, _unicode))
            yield from _compressed(_spliced(_to_last(line, _UNICODE), _UNICODE, _unicode))
    if b"1" * 16 in raw.translate(_B64_TABLE) or _may_wrap(text):
        yield from _base64(layer)


def search(text: str, max_expanded: int = MAX_EXPANDED) -> tuple[list, list, bool]:
    """``(base, all)`` spans of a text as sorted ``(start, kind number, stop)``, and whether a bomb was cut."""
    raw = text.encode("utf-8", "surrogatepass")
    base = scan(text, raw)
    if "%" not in text and "\\" not in text and b"1" * 16 not in raw.translate(_B64_TABLE) and not _may_wrap(text):
        return base, base, False
    spans, place, layers = set(base), np.arange(len(text)), _Search(max_expanded)
    layers.walk(Layer(text, place, place + 1), raw, spans)
    return base, sorted(spans), layers.cut


def find(text: str, max_expanded: int = MAX_EXPANDED) -> tuple[list, list]:
    """``(base, all)`` spans of a text as sorted ``(start, kind number, stop)``."""
    return search(text, max_expanded)[:2]


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("stop", T.LongType())]))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_expanded: int = MAX_EXPANDED) -> DataFrame:
    """``(doc_id, base, spans, cut)``, one row per row of ``docs``.

    ``base`` and ``spans`` are arrays of ``(kind, start, stop)`` by start, kind as listed and stop, in code points of the
    whole text with exclusive ends: ``base`` from the text as it is, ``spans`` with those found in its
    decoded layers. ``cut`` is true if a bomb's layers were not scanned to their end. Null texts read as empty and have none. Null and repeated ids and repeated rows
    keep one row each; further columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = T.StructType([rows.schema["doc_id"], T.StructField("base", _SPAN), T.StructField("spans", _SPAN),
                        T.StructField("cut", T.BooleanType())])

    def named(spans):
        return [{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in spans]

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 256):
                found = [search(t, max_expanded) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array([named(f[i]) for f in found], kind) for i in (0, 1)),
                     pa.array([f[2] for f in found], pa.bool_())],
                    names=["doc_id", "base", "spans", "cut"])

    return rows.mapInArrow(run, out)
