"""Vectorised text helpers for Arrow batches: words, word hashes, n-gram hashes.

Everything here works on one slice of a record batch (a few MB of text), so a
task's memory is bounded by the slice, or by a single text if that is longer.
Hashes are 64-bit and depend only on the bytes of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)

_B = np.arange(256)
LOWER = np.where((_B >= 0x41) & (_B <= 0x5A), _B + 32, _B).astype(np.uint8)
# the contract's words: digits, a-z and everything above ASCII, after lower-casing A-Z
IS_WORD = ((_B >= 0x30) & (_B <= 0x39)) | ((_B >= 0x61) & (_B <= 0x7A)) | (_B >= 0x80)
# blank-separated words: all but space and \t \n \v \f \r
IS_TOKEN = ~((_B == 0x20) | ((_B >= 0x09) & (_B <= 0x0D)))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + (1 << 16))
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text (at least one row)."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + n + 1]
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Flat:
    data: np.ndarray   # bytes of all texts, one after the other
    off: np.ndarray    # start of each text; one more at the end

    @property
    def n(self) -> int:
        return len(self.off) - 1


def flat(col: pa.Array) -> Flat:
    """The bytes of a string column; null counts as empty."""
    col = col.cast(pa.large_binary()).fill_null(b"")
    n = len(col)
    if not n:
        return Flat(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + n + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return Flat(data[off[0]: off[-1]], off - off[0])


@dataclass
class Runs:
    """Maximal runs of wanted bytes (words or lines), in text order."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray   # index of each text's first run; one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def runs(f: Flat, wanted: np.ndarray) -> Runs:
    """Runs of bytes whose flag in ``wanted`` (one flag per byte of data) is set, broken at text ends."""
    m, n = wanted, len(f.data)
    if not n:
        e = np.zeros(0, np.int64)
        return Runs(e, e, e, np.zeros(f.n + 1, np.int64))
    full = np.flatnonzero(np.diff(f.off))
    s = m.copy()
    s[1:] &= ~m[:-1]
    at = f.off[full]
    s[at] = m[at]
    e = m.copy()
    e[:-1] &= ~m[1:]
    at = f.off[full + 1] - 1
    e[at] = m[at]
    start, end = np.flatnonzero(s), np.flatnonzero(e) + 1
    doc = np.searchsorted(f.off, start, "right") - 1
    return Runs(doc, start, end, np.searchsorted(doc, np.arange(f.n + 1)))


def run_hashes(data: np.ndarray, r: Runs) -> np.ndarray:
    """64-bit hash of the bytes of each run."""
    if not len(r.start):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.get(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = (total[r.end] - total[r.start]) * down[r.start]
    return mix(h + (r.end - r.start).astype(np.uint64) * _GRAM)


def words(f: Flat) -> tuple[Runs, np.ndarray]:
    """The contract's words of lower-cased texts and their hashes."""
    low = LOWER[f.data]
    r = runs(f, IS_WORD[low])
    return r, run_hashes(low, r)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes; callers drop grams that cross texts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _GRAM
        out += h[j: j + n]
    return mix(out + np.uint64(k))


def inside(doc: np.ndarray, k: int) -> np.ndarray:
    """Flag for each gram start: its k words are of one text."""
    n = len(doc) - k + 1
    return doc[:n] == doc[k - 1:] if n > 0 else np.zeros(0, bool)


def unique_by_doc(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, value) pairs, sorted by doc, then value."""
    if not len(doc):
        return doc, value
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return d[keep], v[keep]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from concatenated values and the length of each list."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
