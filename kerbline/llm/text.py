"""Vectorised work on batches of texts inside tasks: slices, words, fingerprints.

Texts stay UTF-8 bytes in the Arrow buffer. Words are found by byte class; all separators are
ASCII, so no character is cut. The fingerprint of bytes ``i..j`` comes from one running sum of
``table[byte] * BASE**position``; multiplying by the inverse power makes it independent of the place.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n > 4 * SLICE_BYTES:
            return have  # a huge text: not kept
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


class Texts(NamedTuple):
    """Rows ``first .. first+count`` of a batch, their bytes in one buffer."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Runs of rows with at most ``limit`` bytes of text (or one row). Null counts as empty."""
    text = batch.column(column)
    if text.type not in (pa.string(), pa.large_string()):
        text = text.cast(pa.string())
    if text.null_count:
        text = pc.fill_null(text, "")
    wide = np.int64 if text.type == pa.large_string() else np.int32
    n = len(text)
    if not n:
        return
    _, offset_buffer, data_buffer = text.buffers()
    offsets = np.frombuffer(offset_buffer, wide)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield Texts(slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


class Prefix:
    """Fingerprints of any byte range of ``data``."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER if lower else _TABLE)[data] * powers(_BASE, len(data)), out=total[1:])
        self.total = total

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = powers(_INVERSE, len(self.total))
        raw = (self.total[end] - self.total[start]) * inverse[start]
        return mix(raw + (end - start).astype(np.uint64))

    def runs(self, length: int) -> np.ndarray:
        """The fingerprints of all runs of ``length`` bytes."""
        n = max(len(self.total) - length, 0)
        raw = self.total[len(self.total) - n :] - self.total[:n]
        raw *= powers(_INVERSE, len(self.total))[:n]
        raw += np.uint64(length)
        return mix(raw)


class Words(NamedTuple):
    """Words of a slice in order: fingerprints, byte ranges, row within the slice; ``first`` has
    the index of each row's first word and one more entry for the end."""

    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray


def words(texts: Texts, lower: bool = False, breaks: np.ndarray = SPACE, prefix: Prefix | None = None) -> Words:
    """Maximal runs of bytes that are no separators; a run never crosses rows."""
    data, offsets = texts.data, texts.offsets
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~breaks[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[offsets] = False  # a row begins
    after = inside.copy()
    after[offsets] = False
    start = np.flatnonzero(inside & ~before)
    closes = np.zeros(len(data) + 1, bool)
    closes[1:] = inside[:-1]
    end = np.flatnonzero(closes & ~after)
    row = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets, "left")
    return Words((prefix or Prefix(data, lower)).of(start, end), start, end, row, first)


def grams(code: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Fingerprints of all runs of ``n`` codes, across rows as well: mask with ``gram_rows``."""
    if len(code) < n:
        return np.zeros(0, np.uint64)
    total = np.full(len(code) - n + 1, salt, np.uint64)
    for j in range(n):
        total += code[j : len(code) - n + 1 + j] * _STEP[(j + 7 * salt) % 256]
    return mix(total)


def within(row: np.ndarray, n: int) -> np.ndarray:
    """Whether the run of ``n`` items that starts here stays in its row."""
    if len(row) < n:
        return np.zeros(0, bool)
    return row[: len(row) - n + 1] == row[n - 1 :]
