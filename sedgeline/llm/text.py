"""Words and their hashes for Arrow batches of texts, in numpy over the UTF-8 bytes.

All helpers take whole texts; a text is never cut. Work goes on in chunks of
about ``CHUNK`` bytes (one longer text is a chunk of its own), so that memory
follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK, CHUNK_ROWS = 1 << 21, 60_000
#: Spans are hashed as polynomials of their bytes at two places, modulo a prime: unlike a power of two it has no texts that meet at every place.
_PRIME = (1 << 31) - 1
_PLACES = (0x2F5A1C97, 0x61D3B0E5)
_FOLD, _MOD = np.uint64(31), np.uint64(_PRIME)
_STEP = 1 << 14
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are what lies between ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of ASCII letters and digits and of all non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x80:] = ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, in place."""
    for _ in range(2):
        high = x >> _FOLD
        x &= _MOD
        x += high
    return np.minimum(x, x - _MOD, out=x)  # what is under the prime wraps round


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of a base modulo the prime."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        p = np.ones(size, dtype=np.uint64)
        done = 1
        while done < size:
            m = min(done, size - done)
            p[done : done + m] = _fold(p[:m] * np.uint64(pow(base, done, _PRIME)))
            done += m
        have = _powers[base] = p.astype(np.uint32)
    return have[:n]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    n, _, bufs = len(col), col.null_count, col.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8)[off[0] : off[-1]] if bufs[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(col: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets of chunks of a column."""
    data, off = buffers(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + CHUNK_ROWS, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


@dataclass
class Words:
    """Words of a chunk in order: row, byte range, hash."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    n_docs: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def runs(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the maximal runs of bytes that the table marks; none crosses a row."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = table[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return np.searchsorted(off, start, side="right") - 1, start, end


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start..end, one range after the other."""
    n = end - start
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray = SPACED, lower: bool = True) -> Words:
    doc, start, end = runs(data, off, table)
    return Words(doc, start, end, span_hash(LOWER[data] if lower else data, start, end), len(off) - 1)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums, one row for each place, from which span_hash takes any span's hash."""
    n = len(data)
    sums = np.zeros((len(_PLACES), n + 1), dtype=np.uint32)
    powers = [_power(base, n) for base in _PLACES]
    for lo in range(0, n, _STEP):  # steps that stay in a core's cache
        plain = np.add(data[lo : lo + _STEP], 1, dtype=np.uint64)
        for row, p in zip(sums, powers, strict=True):
            x = plain * p[lo : lo + _STEP]
            np.cumsum(x, out=x)
            x += row[lo]
            row[lo + 1 : lo + 1 + len(x)] = _fold(x)
    return sums


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    sums = prefix(data) if sums is None else sums
    down = [_power(pow(base, -1, _PRIME), len(data) + 1) for base in _PLACES]
    out = np.empty(len(start), dtype=np.uint64)
    for lo in range(0, len(start), _STEP):
        s, e = start[lo : lo + _STEP], end[lo : lo + _STEP]
        total = (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k, (row, p) in enumerate(zip(sums, down, strict=True)):
            h = row[e].astype(np.uint64)
            h += _MOD
            h -= row[s]
            h *= p[s]
            total += _fold(h) << np.uint64(32 * k)
        out[lo : lo + _STEP] = mix(total)
    return out


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n hashes from each position on, in order."""
    m = len(h) - n + 1
    out = np.full(max(m, 0), n, dtype=np.uint64)
    for i in range(n if m > 0 else 0):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[i : i + m]
    return mix(out)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct n-word shingles, sorted by row and hash; a row of fewer words, but not none, has its whole sequence as one."""
    h = combine(w.hash, n)
    whole = w.doc[: len(h)] == w.doc[n - 1 :] if len(h) else np.zeros(0, bool)
    doc, h = w.doc[: len(h)][whole], h[whole]
    count = w.counts()
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        first = np.searchsorted(w.doc, few)
        own = np.empty(len(few), dtype=np.uint64)
        for c in np.unique(count[few]):
            at = count[few] == c
            own[at] = combine(w.hash, int(c))[first[at]]
        doc, h = np.concatenate([doc, few]), np.concatenate([h, own])
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], h[keep]


def lists(values: np.ndarray, doc: np.ndarray, n_docs: int, kind: pa.DataType) -> pa.ListArray:
    """List column from values that are grouped by row."""
    off = np.zeros(n_docs + 1, dtype=np.int32)
    np.cumsum(np.bincount(doc, minlength=n_docs), out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, type=kind))
