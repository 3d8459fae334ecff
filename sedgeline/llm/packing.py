"""Packing of tokenised documents into windows: repeat counts of length combinations by non-negative least squares.

A document's ids (one end id after its text) are cut into whole windows, then
one piece of a multiple of GRID ids and one crumb of fewer. Combinations of at
most DEPTH grid lengths that fill a window exactly are enumerated; the counts
by which they repeat are solved against the histogram of grid lengths, rounded
so that no length is used more often than it occurs, and topped up greedily.
The pieces beyond are packed end to end, and so are the crumbs after them; a
piece that lies across a window's end is cut there. So of the whole corpus
only one window isn't full.

A piece's place follows from its length and its rank among the pieces of that
length. The driver sees the histogram alone, and ranks are counted in buckets
of each length, so that one common length is no single task.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .text import SPACED, chunks, words

WINDOW, GRID, DEPTH, END_ID = 2048, 64, 4, 1
UNITS = WINDOW // GRID
#: The words of which a worker keeps the ids; the kept ones are dropped together when there are more.
KEPT_WORDS = 600_000
TEXT_CHUNK = 1 << 21
ROWS_A_BUCKET = 500_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, parts binary"


class WordIds:
    """Ids of words by a tokenizer for which white space ends a word, so that a text's ids are its words' ids in order."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.hash, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, size = [], []
        for e in self.tokenizer.encode_batch([new[i : i + 4000] for i in range(0, len(new), 4000)], is_pretokenized=True, add_special_tokens=False):
            got = np.array(e.ids, dtype=np.uint32)
            of = np.array(e.word_ids, dtype=np.float64)  # None (nan) where the tokenizer names no word
            if np.isnan(of).any():
                return self._one_by_one(new)
            ids.append(got)
            size.append(of.astype(np.int64))
        counts = [np.bincount(s, minlength=len(new[i * 4000 : (i + 1) * 4000])) for i, s in enumerate(size)]
        return np.concatenate(ids), np.concatenate(counts)

    def _one_by_one(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in new]
        return np.array([x for g in got for x in g], dtype=np.uint32), np.array([len(g) for g in got], dtype=np.int64)

    def of(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in order, each row with its end id; offsets of the rows)."""
        w = words(data, off, SPACED, lower=False)
        uniq, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hash, uniq)
        known = self.hash[np.minimum(place, max(len(self.hash) - 1, 0))] == uniq if len(self.hash) else np.zeros(len(uniq), bool)
        if not known.all():
            if len(self.hash) > KEPT_WORDS:
                self.clear()
                known[:] = False
            at = at[~known]
            raw = data.tobytes()
            ids, size = self._encode([raw[s:e].decode() for s, e in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
            first = np.cumsum(size) - size + len(self.pool)
            self.pool = np.concatenate([self.pool, ids])
            at = np.searchsorted(self.hash, uniq[~known])
            self.hash, self.first, self.size = np.insert(self.hash, at, uniq[~known]), np.insert(self.first, at, first), np.insert(self.size, at, size)
            place = np.searchsorted(self.hash, uniq)
        n_docs = len(off) - 1
        size = np.concatenate([self.size[place][inverse], np.ones(n_docs, np.int64)])
        first = np.concatenate([self.first[place][inverse], np.full(n_docs, len(self.pool), np.int64)])
        doc = np.concatenate([w.doc, np.arange(n_docs)])
        order = np.argsort(doc.astype(np.uint16), kind="stable")  # the end id after each row's words
        size, first, doc = size[order], first[order], doc[order]
        pool = np.append(self.pool, np.uint32(END_ID))
        take = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        rows = np.zeros(n_docs + 1, dtype=np.int64)
        np.cumsum(np.bincount(doc, weights=size, minlength=n_docs).astype(np.int64), out=rows[1:])
        return pool[take].astype("<u4"), rows


_kept: dict[str, WordIds] = {}


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _kept:
            _kept[path] = WordIds(path)
        for b in batches:
            for lo, _, data, off in chunks(b.column(1), TEXT_CHUNK):
                ids, rows = _kept[path].of(data, off)
                raw = memoryview(ids).cast("B")
                doc, start, length, crc, parts = [], [], [], [], []
                for d, (x, y) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
                    cut = list(range(0, y - x - WINDOW + 1, WINDOW))
                    at = len(cut) * WINDOW
                    spans = [(s, WINDOW) for s in cut]
                    if grid := (y - x - at) // GRID * GRID:
                        spans.append((at, grid))
                    if y - x - at > grid:
                        spans.append((at + grid, y - x - at - grid))
                    for s, n in spans:
                        own = raw[4 * (x + s) : 4 * (x + s + n)]
                        doc.append(d)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(own))
                        # what a later cut needs: checksums of the blocks of GRID ids, or a crumb's ids
                        parts.append(None if n == WINDOW else bytes(own) if n < GRID else b"".join(zlib.crc32(own[i : i + 4 * GRID]).to_bytes(4, "little") for i in range(0, 4 * n, 4 * GRID)))
                doc = np.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc + lo)), *(pa.array(v, pa.int64()) for v in (start, length, crc)), pa.array(np.diff(rows)[doc], pa.int64()), pa.array(parts, pa.binary())],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts"],
                )

    return run


def combinations(units: int = UNITS, depth: int = DEPTH) -> np.ndarray:
    """A row for each way to fill ``units`` with 2 to ``depth`` lengths: how often it takes each of the lengths 1 to units - 1."""
    out = []

    def grow(left: int, largest: int, taken: list[int]) -> None:
        if not left:
            out.append(np.bincount(taken, minlength=units)[1:])
        elif len(taken) < depth:
            for x in range(min(left, largest), 0, -1):
                grow(left - x, x, [*taken, x])

    grow(units, units - 1, [])
    return np.array(out)


def nnls(a: np.ndarray, b: np.ndarray, most: int = 2000) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by Lawson and Hanson's active sets."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    for _ in range(most):
        slope = a.T @ (b - a @ x)
        slope[passive] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        passive[j] = True
        while True:
            z = np.zeros_like(x)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (z[passive] > 0).all():
                x = z
                break
            low = passive & (z <= 0)
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
    return x


def plan(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, repeats) for a histogram of the lengths 1 to UNITS - 1; no length is used more often than it occurs."""
    ways = combinations()
    solved = nnls(ways.T.astype(float), hist.astype(float))
    left, repeats = hist.astype(np.int64).copy(), np.zeros(len(ways), dtype=np.int64)
    order = np.argsort(-solved, kind="stable")
    for rounded in (True, False):  # the rounded solution, then what still fits
        for j in order:
            uses = ways[j] > 0
            n = int((left[uses] // ways[j][uses]).min())
            n = min(n, int(solved[j] + 0.5)) if rounded else n
            repeats[j] += n
            left -= n * ways[j]
    return ways[repeats > 0], repeats[repeats > 0]


def _zeros(c: int, n_ids: int) -> int:
    """The checksum c after n_ids zero ids: its linear part carries a checksum over what follows."""
    zero = bytes(4 * n_ids)
    return zlib.crc32(zero, c) ^ zlib.crc32(zero)


def _over_blocks(parts: bytes) -> int:
    crc = 0
    for i in range(0, len(parts), 4):
        crc = _zeros(crc, GRID) ^ int.from_bytes(parts[i : i + 4], "little")
    return crc


def _placed(ways: np.ndarray, repeats: np.ndarray, counts: dict[int, int]):
    """Gives each ranked piece its sequence and offset, from the plan and the number of pieces by length."""
    base = np.cumsum(repeats) - repeats
    n_full = counts.get(WINDOW, 0)
    chain_id = n_full + int(repeats.sum())
    slots, chain, at = {}, {}, 0
    for u in range(UNITS - 1, 0, -1):
        use = np.flatnonzero(ways[:, u - 1]) if len(ways) else np.zeros(0, np.int64)
        n = repeats[use] * ways[use, u - 1]
        # longer lengths stand first in a window
        before = (ways[use, u:] * np.arange(u + 1, UNITS)).sum(1) * GRID
        slots[u * GRID] = (np.cumsum(n), use, before)
        chain[u * GRID] = (int(n.sum()), at)
        at += (counts.get(u * GRID, 0) - int(n.sum())) * u * GRID
    for t in range(GRID - 1, 0, -1):
        chain[t] = (0, at)
        at += counts.get(t, 0) * t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, offset, first = np.zeros_like(length), np.zeros_like(length), length.copy()
            full = length == WINDOW
            seq[full] = rank[full]
            for n in np.unique(length[~full]).tolist():
                own = length == n
                used, place = chain[n]
                if used:
                    ends, use, before = slots[n]
                    at = np.flatnonzero(own & (rank < used))
                    k = np.searchsorted(ends, rank[at], side="right")
                    j = use[k]
                    copies = ways[j, n // GRID - 1]
                    r = rank[at] - (ends[k] - repeats[j] * copies)
                    seq[at] = n_full + base[j] + r // copies
                    offset[at] = before[k] + r % copies * n
                at = np.flatnonzero(own & (rank >= used))
                p = place + (rank[at] - used) * n
                seq[at], offset[at] = chain_id + p // WINDOW, p % WINDOW
                first[at] = np.minimum(n, WINDOW - p % WINDOW)
            crc = b.column("ids_crc32").to_numpy().copy()
            cut = np.flatnonzero(first < length)
            head, tail = [], []
            for i, p in zip(cut.tolist(), b.column("parts").take(pa.array(cut)).to_pylist(), strict=True):
                k = int(first[i])
                head.append(zlib.crc32(p[: 4 * k]) if length[i] < GRID else _over_blocks(p[: k // GRID * 4]))
                tail.append(zlib.crc32(p[4 * k :]) if length[i] < GRID else _over_blocks(p[k // GRID * 4 :]))
            crc[cut] = head
            take = np.concatenate([np.arange(len(length)), cut])
            more = len(cut)
            start, n = b.column("start").to_numpy()[take], np.concatenate([first, (length - first)[cut]])
            start[len(length) :] += first[cut]
            seq, offset, crc = np.concatenate([seq, seq[cut] + 1]), np.concatenate([offset, np.zeros(more, np.int64)]), np.concatenate([crc, np.array(tail, dtype=np.int64)])
            arrays = [b.column("doc_id").take(pa.array(take)), *(pa.array(x, pa.int64()) for x in (start, n, crc, b.column("doc_tokens").to_numpy()[take], seq, offset))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file whose words end at white
    space. A null or empty text is its end id alone. Each row of ``docs`` is a
    document; rows that repeat an id give pieces for each. An empty table gives
    no pieces. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = scratch.save(texts.mapInArrow(_pieces(tokenizer), PIECES), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most GRID + UNITS rows
    hist = np.array([counts.get(u * GRID, 0) for u in range(1, UNITS)])
    ways, repeats = plan(hist)

    buckets = max(64, sum(counts.values()) // ROWS_A_BUCKET)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = dealt.withColumn("own", rank).join(before.select("length", "bucket", "before"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts", (F.col("before") + F.col("own") - 1).alias("rank"))
    return ranked.mapInArrow(_placed(ways, repeats, counts), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
