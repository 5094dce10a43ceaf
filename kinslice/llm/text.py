"""Vectorised text primitives over the bytes of whole Arrow batches.

Words are maximal runs of bytes outside ``\x20 \x09-\x0D``. Every word, line or window of words is
named by a 64-bit hash. All hashes of a chunk come from one prefix sum modulo 2**64: the hash of
``[s, e)`` is ``(S[e] - S[s]) * B**-s`` with ``S`` the running sum of ``T[byte] * B**i``, so no
Python code runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xC2B2AE3D27D4EB4F}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CONTINUATION = np.zeros(256, bool)
CONTINUATION[0x80:0xC0] = True


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(kind)
    if have is None or len(have[0]) < n:
        base = _BASES[kind]
        # most chunks fit the first size; a longer text makes the tables grow
        size = max(n, CHUNK_BYTES + (1 << 16) if kind == "byte" else CHUNK_BYTES // 4)
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[kind] = (np.cumprod(up), np.cumprod(down))
    return have


_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system: Spark keeps its Python workers, and what they hold."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray, kind: str) -> np.ndarray:
    up, _ = _powers(kind, len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, kind: str) -> np.ndarray:
    """Mixed hashes of the spans ``[start, end)`` of what ``sums`` was made from."""
    _, down = _powers(kind, len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


#: Bytes of terms: letters, digits and all beyond ASCII.
TERM = np.zeros(256, bool)
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True


class Text:
    """The texts of some rows as one byte array; ``off`` has each row's bounds. Null is empty."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.rows = buf, off, len(off) - 1
        self._sums: np.ndarray | None = None

    def lower(self) -> Text:
        return Text(LOWER[self.buf], self.off)

    def lower_latin(self) -> Text:
        """A-Z and the capitals of two bytes that start with C3 (À to Þ) in lower case."""
        buf = LOWER[self.buf]
        at = np.flatnonzero(buf[:-1] == 0xC3) + 1
        at = at[(buf[at] >= 0x80) & (buf[at] <= 0x9E) & (buf[at] != 0x97)]
        buf[at] += 0x20
        return Text(buf, self.off)

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            self._sums = prefix_sums(_BYTE[self.buf], "byte")
        return self._sums

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return spans(self.sums, start, end, "byte")

    def bounds(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of True in ``inside`` that don't cross a row's end."""
        n = len(self.buf)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        heads, tails = self.off[:-1], self.off[1:] - 1
        before[heads[heads < n]] = False
        after[tails[tails >= 0]] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many of a row's bytes are flagged."""
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]


class Words:
    """Words of a Text in order: byte bounds, row of each, and ``first[row]``, its first word."""

    def __init__(self, text: Text, inside: np.ndarray | None = None):
        self.text = text
        self.start, self.end = text.bounds((~SPACE if inside is None else inside)[text.buf])
        self.first = np.searchsorted(self.start, text.off)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(text.rows), self.count)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.text.hashes(self.start, self.end)
        return self._hash

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of ``k`` consecutive words of one row."""
        room = np.repeat(self.first[1:], self.count) - np.arange(len(self.row))
        at = np.flatnonzero(room >= k)
        return at, spans(prefix_sums(self.hash, "word"), at, at + k, "word")


def text_of(column: pa.Array) -> Text:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return Text(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Text(buf[off[0] : off[-1]], off - off[0])


def chunks(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, Text]]:
    """Slices of batches of about ``limit`` bytes of text (one row at least), with their Text.

    Freed memory goes back to the system after the last one.
    """
    for batch in batches:
        whole = text_of(batch.column(column))
        lo = 0
        while lo < whole.rows:
            hi = int(np.searchsorted(whole.off, whole.off[lo] + limit, "right")) - 1
            hi = min(max(hi, lo + 1), whole.rows)
            off = whole.off[lo : hi + 1]
            yield batch.slice(lo, hi - lo), Text(whole.buf[off[0] : off[-1]], off - off[0])
            lo = hi
    give_back()


def integers(column: pa.Array, null: int) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def unique_in_rows(row: np.ndarray, values: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the bounds of each row's run."""
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    return values[new], np.searchsorted(row[new], np.arange(rows + 1))


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row i holds ``data[bounds[i]:bounds[i + 1]]``."""
    raw = np.ascontiguousarray(data)
    off = (np.asarray(bounds, np.int64) * raw.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(raw.view(np.uint8))]
    )
