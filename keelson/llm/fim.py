"""Fill-in-middle transformation: sentinels in a bytearray, blocks exchanged by three reversals.

A text is cut in two places into prefix, middle and suffix. One scan of its UTF-8 bytes turns cuts in
code points into cuts in bytes. A bytearray takes ``<P>`` prefix ``<M>`` middle ``<S>`` suffix, and two
neighbouring blocks are exchanged where they lie: reversing both blocks and then the whole exchanges
them without a second copy of the text.

* psm: the blocks ``<M>`` middle and ``<S>`` suffix change places: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* spm: ``<P>`` prefix ``<M>`` middle and ``<S>`` suffix do: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle;
* plain: the text stays as it is.

:func:`restore` reads the output alone: it finds the sentinels, turns the same rotation back and cuts
the sentinels out. This is exact, since a text that holds a sentinel stays plain and no sentinel can
arise where text and sentinel meet (it would have to begin or end with part of another one, and ``<``
only begins, ``>`` only ends one).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The three marks, and the percentages of texts transformed at all and, of these, in spm order.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
RATE, SPM_RATE = 90, 20
#: Bytes exchanged at once by a reversal.
_STEP = 1 << 16

FORM = "n long, form string, prefix_chars long, middle_chars long, output string"


def reverse(block: np.ndarray) -> None:
    """Reverse ``block`` in place, at most ``_STEP`` bytes from either end at a time."""
    low, high = 0, len(block)
    while high - low > 1:
        n = min(_STEP, (high - low) // 2)
        held = block[low:low + n].copy()
        block[low:low + n] = block[high - n:high][::-1]
        block[high - n:high] = held[::-1]
        low, high = low + n, high - n


def exchange(buffer: bytearray, start: int, cut: int, stop: int) -> None:
    """Exchange the blocks ``start:cut`` and ``cut:stop`` of ``buffer`` by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view[start:cut])
    reverse(view[cut:stop])
    reverse(view[start:stop])


def byte_cuts(data: bytes, cuts: list[int]) -> tuple[int, list[int]]:
    """The number of code points of UTF-8 ``data``, and the byte where each code point of ``cuts`` begins."""
    starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    n = len(starts)
    return n, [int(starts[c]) if c < n else len(data) for c in cuts]


def draws(doc_id: str) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that follow from the id alone."""
    digest = hashlib.sha256(b"1:" + doc_id.encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def cut_and_rotate(data: bytes, h: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
    """``(n, form, prefix_chars, middle_chars, output)`` of a text as UTF-8 under the draws ``h``."""
    n = byte_cuts(data, [])[0]
    if not n or h[2] % 100 >= RATE or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    first_byte, second_byte = byte_cuts(data, [first, second])[1]
    buffer = bytearray(data)
    # from the right, so that the earlier cuts stay where they are
    for at, mark in ((second_byte, SUFFIX), (first_byte, MIDDLE), (0, PREFIX)):
        buffer[at:at] = mark
    middle_at = len(PREFIX) + first_byte
    suffix_at = len(PREFIX) + len(MIDDLE) + second_byte
    form = "spm" if h[3] % 100 < SPM_RATE else "psm"
    exchange(buffer, 0 if form == "spm" else middle_at, suffix_at, len(buffer))
    return n, form, first, second - first, bytes(buffer)


def rotate_back(output: bytes, form: str) -> bytes:
    """The text that :func:`cut_and_rotate` turned into ``output``."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    moved = output.index(PREFIX) if form == "spm" else output.index(SUFFIX)
    if form == "spm":  # <S> suffix | <P> prefix <M> middle
        exchange(buffer, 0, moved, len(buffer))
        suffix_at = len(buffer) - moved
    else:  # <P> prefix [<S> suffix | <M> middle]
        middle = output.index(MIDDLE)
        exchange(buffer, moved, middle, len(buffer))
        suffix_at = moved + len(buffer) - middle
    middle_at = buffer.index(MIDDLE)
    for at, mark in ((suffix_at, SUFFIX), (middle_at, MIDDLE), (0, PREFIX)):
        del buffer[at:at + len(mark)]
    return bytes(buffer)


def _bytes_of(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def transform(doc_id: Column, text: Column) -> Column:
    """A struct ``n, form, prefix_chars, middle_chars, output`` per row, from its id and whole text.

    The draws follow from the decimal id (null: as an empty one), so rows equal in id and text have
    equal results. Null texts read as empty; empty texts and texts that hold a sentinel stay plain,
    with null lengths. Memory: a text, its bytes and one copy.
    """
    @F.arrow_udf(FORM)
    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [cut_and_rotate(t, draws(i or "")) for i, t in zip(ids.to_pylist(), _bytes_of(texts))]
        n, form, prefix, middle, output = zip(*rows) if rows else [()] * 5
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
             pa.array(output, pa.binary()).cast(pa.string())], names=["n", "form", "prefix_chars", "middle_chars", "output"])

    return run(doc_id.cast("string"), text)


def restore(output: Column, form: Column) -> Column:
    """The exact text behind ``output``; null where either is null."""
    @F.arrow_udf("string")
    def run(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        rows = [None if o is None or f is None else rotate_back(o, f)
                for o, f in zip(outputs.cast(pa.binary()).to_pylist(), forms.to_pylist())]
        return pa.array(rows, pa.binary()).cast(pa.string())

    return run(output, form)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "fim") -> DataFrame:
    """``docs`` with the struct of :func:`transform` as the column ``out``, without a shuffle.

    Every other column stays as it is whatever its name (one named ``out`` is replaced); repeated rows
    and null ids keep one row each; an empty table stays empty.
    """
    return docs.withColumn(out, transform(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
