"""Vectorised word scanning over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D.  UTF-8 never
uses those bytes inside a longer character, so byte scanning is exact.  Each
word gets a 64-bit polynomial fingerprint computed from prefix sums, so the
cost per byte is a few array operations and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SEGMENT + 1), base, dtype=_U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * SEGMENT:
            _powers[base] = have
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of 64-bit words."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as doubles in the open interval (0, 1)."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


@dataclass
class Words:
    """All words of some texts: per word its text's index, byte span and fingerprint."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    n_docs: int

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    base = bounds[0] if len(bounds) else 0
    return raw[base : bounds[-1] if len(bounds) else 0], bounds - base


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 * SEGMENT) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows with about `limit` text bytes each."""
    if not batch.num_rows:
        return
    _, bounds = text_buffers(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def _spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~WHITE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[bounds[(bounds >= 0) & (bounds <= len(data))]] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    before |= cut[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    after |= cut[1:]
    return np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1


def fingerprints(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the byte spans, which ascend and do not overlap."""
    out = np.empty(len(start), dtype=_U)
    at = 0
    while at < len(start):
        upto = int(np.searchsorted(start, start[at] + SEGMENT, side="left"))
        low, high = int(start[at]), int(end[upto - 1])
        n = high - low
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum((data[low:high].astype(_U) + _U(1)) * _power(_BASE, n)[:n], out=sums[1:])
        s, e = start[at:upto] - low, end[at:upto] - low
        out[at:upto] = mix64((sums[e] - sums[s]) * _power(_INVERSE, n + 1)[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
        at = upto
    return out


def scan(column: pa.Array, lower: bool = False) -> Words:
    """The words of a string column in text order."""
    data, bounds = text_buffers(column)
    if lower:
        data = LOWER[data]
    n = len(column)
    starts, ends = [], []
    low = 0
    while low < len(data):
        high = min(low + SEGMENT, len(data))
        while high < len(data) and not WHITE[data[high - 1]] and not _is_bound(bounds, high):
            step = data[high : high + 4096]
            gap = np.flatnonzero(WHITE[step])
            nxt = high + (int(gap[0]) + 1 if len(gap) else len(step))
            inside = bounds[np.searchsorted(bounds, high, side="right") :][:1]
            high = min(nxt, int(inside[0]) if len(inside) else nxt, len(data))
        lo, hi = np.searchsorted(bounds, [low, high])
        s, e = _spans(data[low:high], bounds[lo : hi + 1] - low)
        starts.append(s + low)
        ends.append(e + low)
        low = high
    start = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
    doc = np.searchsorted(bounds, start, side="right") - 1
    return Words(data, doc.astype(np.int64), start, end, fingerprints(data, start, end), n)


def _is_bound(bounds: np.ndarray, at: int) -> bool:
    i = int(np.searchsorted(bounds, at))
    return i < len(bounds) and bounds[i] == at


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=_U)


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, fingerprint) of every n-word window that lies within one text."""
    size = len(words.hash) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
    acc = np.full(size, n, dtype=_U)
    for k in range(n):
        acc = (acc ^ words.hash[k : k + size]) * _ODD[k % 8]
        acc ^= acc >> _U(29)
    inside = words.doc[:size] == words.doc[n - 1 :]
    return words.doc[:size][inside], mix64(acc[inside])
