"""N-gram Jaccard self-join by PartEnum signatures, with one class id for each document.

Two sets link when 100 * |a & b| >= percent * |a | b|. Sizes fall into bands so
narrow that linked sets lie in one band or in two adjacent ones. For each band
the greatest symmetric difference k of a linked pair is known. The domain of
shingles is dealt into n1 groups of n2 parts; a group with at most one
difference (there are n1 - k // 2 at least) agrees in n2 - 1 of its parts, and
a signature is made for each choice of n2 - 1 parts. ``spare`` groups more than
k // 2 + 1 are made, so that a choice of parts without any shingle need not
count as agreement: only a set with more than ``spare`` groups that have such
a choice signs those too.

Equal sets are one node before any signature is compared. In each bucket of a
signature the best connected node is the hub, and the others are compared with
it alone; a small bucket gives all its pairs. What these links have not made one
component is compared, by sketches inside of the bucket, in buckets of up to OPEN
nodes; only pairs that pass leave it. The nodes of larger buckets meet by the shingles
that stand first from rare to common, of which linked sets have one in common. So no link
between components is lost and no clique is written out. A parity sketch has
two bits a shingle (256 to 4,096) and each shingle flip one of them, so two sketches,
folded to one length, differ in no more bits than the sets in shingles, and no
linked pair can fail. Pairs of small buckets meet one of 256 bits first. Whole
sets are made again from the texts, for the nodes of pairs that pass alone.

Signatures that a sample of sets shows to be very common are dealt to several
tasks, which hand their rows to the hub step unpaired; the sample decides only
where a row goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from ..scratch import Scratch
from .text import SPACED, chunks, lists, mix, shingles, words

SKETCH = ["node", "size", "s0", "s1", "s2", "s3"]
#: Share of sets that may sign empty choices too, and shingles that a choice of parts should hold, so that few unlike sets agree in one.
SPARSE, FULL = 1e-2, 1.5
#: Buckets of at most so many nodes give all their pairs at once; after the hub step, of at most so many.
PAIRED, OPEN = 6, 500
#: One of so many sets is a sample that shows hot signatures: those of so many of its sets, and of a thousandth; rows of one that go to a task.
SAMPLE, HOT, TASK_ROWS = 64, 32, 20_000
_NODE, _WIDE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _tail(lam: float, e: int) -> float:
    term = total = exp(-lam)
    for i in range(1, e + 1):
        term *= lam / i
        total += term
    return max(0.0, 1 - total)


@lru_cache
def bands(percent: int, most: int) -> np.ndarray:
    """Rows (last size, n1, n2, spare) of the bands up to size ``most`` and one further; n1 is 0 where only equal sets link."""
    out, lo, before = [], 1, 1
    while not out or before <= most:
        hi = lo * 100 // percent
        k = 2 * hi * (100 - percent) // (100 + percent)
        for n2 in (2, 3, 4):  # the fewest parts whose choices hold FULL shingles of the least set

            def miss(e: int, n2: int = n2, k: int = k, least: int = before) -> float:
                groups = k // 2 + 1 + e
                return _tail(groups * n2 * exp(-least * (n2 - 1) / n2 / groups), e)

            spare = next((e for e in range(k + 2) if miss(e) < SPARSE), None)
            if spare is None:
                spare = min(range(k + 2), key=miss)
            if before * (n2 - 1) / n2 / (k // 2 + 1 + spare) >= FULL:
                break
        out.append((hi, k // 2 + 1 + spare if k else 0, n2, spare))
        before, lo = lo, hi + 1
    return np.array(out, dtype=np.int64)


def nodes(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit fingerprint of each row's set."""
    size, sums = np.bincount(doc, minlength=n_docs), np.zeros(n_docs, dtype=np.uint64)
    np.add.at(sums, doc, mix(h ^ _NODE))
    return size, mix(sums + size.astype(np.uint64) * _NODE)


def signatures(doc: np.ndarray, h: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of all rows' sets, for each one's own band and the next."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    table = bands(percent, int(size.max()))
    own = np.searchsorted(table[:, 0], size)
    rows, sigs = [], []
    value, deal = mix(h), mix(h + np.uint64(0x632BE59BD9B4E019))
    for step in (0, 1):
        band = own + step
        n1, n2, spare = (np.where(size > 0, table[band, i], 0) for i in (1, 2, 3))
        for parts in (2, 3, 4):
            groups = np.where(n2 == parts, n1, 0)
            first = np.zeros(len(size) + 1, dtype=np.int64)
            np.cumsum(groups, out=first[1:])
            if not first[-1]:
                continue
            at = np.flatnonzero(groups[doc] > 0) if (groups == 0).any() else slice(None)
            d, v, w = doc[at], value[at], deal[at]
            group = ((w >> np.uint64(32)) * groups[d].astype(np.uint64)) >> np.uint64(32)
            slot = (first[d] + group.astype(np.int64)) * parts + ((w & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(first[-1] * parts, dtype=np.uint64)
            np.add.at(sums, slot, v)
            full = np.bincount(slot, minlength=len(sums)).reshape(-1, parts)
            sums = sums.reshape(-1, parts)
            row = np.repeat(np.arange(len(size)), groups)
            name = (band[row].astype(np.uint64) << np.uint64(40)) + (np.arange(first[-1]) - first[row]).astype(np.uint64)
            choices = list(combinations(range(parts), parts - 1))
            filled = np.stack([full[:, c].sum(1) > 0 for c in choices], 1)
            sparse = np.bincount(row, weights=~filled.all(1), minlength=len(size))
            also = (sparse > spare)[row]
            for i, c in enumerate(choices):
                key = mix(name * np.uint64(8) + np.uint64(i))
                for p in c:
                    key = mix(key * np.uint64(0x9FB21C651E98DF25) + sums[:, p] + np.uint64(p))
                keep = filled[:, i] | also
                rows.append(row[keep])
                sigs.append(key[keep])
    return (np.concatenate(rows), np.concatenate(sigs)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _chunked(batch: pa.RecordBatch, n: int):
    for lo, hi, data, off in chunks(batch.column(1)):
        doc, h = shingles(words(data, off, SPACED), n)
        yield lo, hi, doc, h, *nodes(doc, h, hi - lo)


def _members(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, doc, h, size, node in _chunked(b, n):
                chosen = (size > 0) & (node % np.uint64(SAMPLE) == 0)
                keep = chosen[doc]
                row, sig = signatures(doc[keep], h[keep], np.where(chosen, size, 0), percent)
                order = np.argsort(row, kind="stable")
                sample = lists(sig[order].view(np.int64), row[order], hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(node.view(np.int64), mask=size == 0), sample], ["id", "n_shingles", "node", "sample"])

    return run


def _signed(n: int, percent: int, hot: np.ndarray, tasks: np.ndarray):
    """Rows (sig, node, deal): deal is the task of a hot signature that the node goes to, else -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets sign once as long as they are remembered
        for b in batches:
            for _, _, doc, h, size, node in _chunked(b, n):
                first = np.zeros(len(node), dtype=bool)
                which, at = np.unique(node, return_index=True)
                first[[i for x, i in zip(which.tolist(), at.tolist(), strict=True) if x not in seen]] = True
                seen = seen.union(which.tolist()) if len(seen) < 1 << 18 else set(which.tolist())
                keep = first[doc]
                row, sig = signatures(doc[keep], h[keep], np.where(first, size, 0), percent)
                deal = np.full(len(sig), -1, dtype=np.int32)
                if len(hot):
                    place = np.minimum(np.searchsorted(hot, sig), len(hot) - 1)
                    known = np.flatnonzero(hot[place] == sig)
                    deal[known] = (mix(node[row[known]]) % tasks[place[known]].astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node[row].view(np.int64)), pa.array(deal)], ["sig", "node", "deal"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, few, key): each shingle of each set, with the number of shingles that linked sets must have one in common of; from rows (node, need, set)."""
    for b in batches:
        whole = b.column(2).to_pylist()
        size = np.array([len(x) // 8 for x in whole], dtype=np.int64)
        row = pa.array(np.repeat(np.arange(len(size)), size))
        yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(np.frombuffer(b"".join(whole), dtype=np.int64))], ["node", "few", "key"])


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, _, h, size, node in _chunked(b, n):
                at = np.flatnonzero(size)
                cut = np.split(h, np.cumsum(size[at])[:-1]) if len(at) else []
                yield pa.RecordBatch.from_arrays([pa.array(node[at].view(np.int64)), pa.array(size[at], pa.int64()), pa.array([x.tobytes() for x in cut], pa.binary())], ["node", "size", "set"])

    return run


def _sketches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, doc, h, size, node in _chunked(b, n):
                at = np.flatnonzero(size)
                bit = (mix(h + _NODE) >> np.uint64(56)).astype(np.int64)
                sketch = np.zeros(len(size) * 4, dtype=np.uint64)
                np.bitwise_xor.at(sketch, doc * 4 + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
                parts = sketch.view(np.int64).reshape(-1, 4)[at]
                bit = (mix(h ^ _WIDE) >> np.uint64(52)).astype(np.int64)
                width = 1 << np.clip(np.ceil(np.log2(np.maximum(size, 1) / 32)), 2, 6).astype(np.int64)
                start = np.cumsum(width) - width
                wide = np.zeros(int(width.sum()), dtype=np.uint64)
                np.bitwise_xor.at(wide, start[doc] + (bit >> 6) % width[doc], np.uint64(1) << (bit & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(node[at].view(np.int64)), pa.array(size[at], pa.int64()), *(pa.array(np.ascontiguousarray(parts[:, i])) for i in range(4)), pa.array([wide[start[i] : start[i] + width[i]].tobytes() for i in at.tolist()], pa.binary())], [*SKETCH, "wide"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (sig, node, deal) in order: the pairs (node, other) of buckets of at most PAIRED distinct nodes, and the rows (sig, node) of larger and of hot ones.

    Whatever a bucket's size, no more than PAIRED rows are held over.
    """
    sig, node, hot, going = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), False  # going: the first row is of a large bucket, and is out

    def out(s, n, other=None):
        none = pa.nulls(len(n), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(s) if other is None else none, pa.array(n), none if other is None else pa.array(other)], ["sig", "node", "other"])

    for b in chain(batches, (None,)):
        if b is not None:
            sig, node, hot = (np.concatenate([x, y]) for x, y in zip((sig, node, hot), (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy() >= 0), strict=True))
        if not len(sig):
            continue
        new = np.ones(len(sig), dtype=bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, hot = sig[new], node[new], hot[new]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        size = np.diff(np.append(first, len(sig)))
        large = (size > PAIRED) | hot[first]
        large[0] |= going
        rows = np.repeat(large, size)
        rows[0] &= not going
        done = np.ones(len(first), dtype=bool)
        done[-1] = b is None
        yield out(sig[rows], node[rows])
        for n in range(2, PAIRED + 1):
            at = first[done & ~large & (size == n)]
            for i, j in combinations(range(n), 2) if len(at) else ():
                yield out(None, node[at + i], node[at + j])
        going = bool(large[-1]) and b is not None
        keep = len(sig) - 1 if going else first[-1]
        sig, node, hot = sig[keep:], node[keep:], hot[keep:]


def _passing(percent: int, m: np.ndarray, n: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of m and n shingles whose sketches differ in so many bits may link."""
    return (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & ((100 + percent) * differ <= (100 - percent) * (m + n))


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.array(x.to_pylist(), dtype=object) if pa.types.is_binary(x.type) else x.to_numpy() for x in b.columns]


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches of one length as rows of so many words, a power of two."""
    return np.bitwise_xor.reduce(np.frombuffer(b"".join(sketches), dtype=np.uint64).reshape(len(sketches), -1, words), axis=1)


def _even(sketches: np.ndarray) -> np.ndarray:
    """Sketches of several lengths, all folded to the shortest."""
    long = np.array([len(x) // 8 for x in sketches], dtype=np.int64)
    out = np.zeros((len(long), int(long.min())), dtype=np.uint64)
    for n in np.unique(long).tolist():
        at = np.flatnonzero(long == n)
        out[at] = _folded(sketches[at], out.shape[1])
    return out


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which sketches of pairs (a row of both) differ, each pair at the shorter one's length."""
    wide = np.array([(len(p) // 8, len(q) // 8) for p, q in zip(x, y, strict=True)], dtype=np.int64).reshape(-1, 2)
    out = np.zeros(len(x), dtype=np.int64)
    for p, q in np.unique(wide, axis=0).tolist():
        at = np.flatnonzero((wide == (p, q)).all(1))
        out[at] = np.bitwise_count(_folded(x[at], min(p, q)) ^ _folded(y[at], min(p, q))).sum(1, dtype=np.int64)
    return out


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (a, b)], ["a", "b"])


def _hubs(percent: int):
    """Pairs of the first row of a bucket with those of the others that may link; from rows (sig, node, size, wide sketch) in order of sig. One row is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = _columns(batch)
            if held is not None:
                c = [np.concatenate([x, y]) for x, y in zip(held, c, strict=True)]
            first = np.flatnonzero(np.r_[True, c[0][1:] != c[0][:-1]])
            hub = np.repeat(first, np.diff(np.append(first, len(c[0]))))
            near = np.flatnonzero(c[1] != c[1][hub])
            other = hub[near]
            hold = _passing(percent, c[2][near], c[2][other], _differ(c[3][near], c[3][other]))
            yield _pairs([c[1][other[hold]]], [c[1][near[hold]]])
            held = [x[hub[-1:]] for x in c]

    return run


def _across(percent: int, most: int | None):
    """Pairs (a, b) of unlike labels in a bucket that may link; from rows (sig, node, size, wide sketch, label) in order of sig and label.

    A bucket of more than ``most`` rows gives its nodes instead, with a null b, and no more rows than that are held over.
    """

    def compared(c: list[np.ndarray], a: list[np.ndarray], b: list[np.ndarray]) -> None:
        node, size, label = c[1], c[2], c[4]
        if label[0] == label[-1]:
            return
        sketch = _even(c[3])
        step = max(1, (1 << 20) // len(node))
        for lo in range(0, len(node), step):
            y = int(np.searchsorted(label, label[lo], "right"))  # those before are of this label or have been compared
            if y == len(node):
                return
            x = slice(lo, lo + step)
            differ = sum(np.bitwise_count(s[x, None] ^ s[None, y:]).astype(np.int64) for s in sketch.T)
            i, j = np.nonzero(_passing(percent, size[x, None], size[None, y:], differ) & (label[x, None] < label[None, y:]))
            a.append(node[lo + i])
            b.append(node[y + j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, going = None, None  # rows of the bucket that is open; the signature of one that is known to be large
        for batch in chain(batches, (None,)):
            c = None if batch is None else _columns(batch)
            if held is not None:
                c = held if c is None else [np.concatenate([x, y]) for x, y in zip(held, c, strict=True)]
            if c is None or not len(c[0]):
                continue
            first = np.flatnonzero(np.r_[True, c[0][1:] != c[0][:-1]])
            ends = np.append(first[1:], len(c[0]))
            a, b, large = [], [], []
            for lo, hi in zip(first.tolist(), ends.tolist(), strict=True):
                last = hi == len(c[0]) and batch is not None
                if c[0][lo] == going or (most is not None and hi - lo > most):
                    large.append(c[1][lo:hi])
                    going, held = c[0][lo], None
                elif last:
                    held = [x[lo:hi] for x in c]
                else:
                    held = None
                    if hi - lo > 1:
                        compared([x[lo:hi] for x in c], a, b)
            yield _pairs(a, b)
            if large:
                node = np.concatenate(large)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64())], ["a", "b"])

    return run


def _sketched(percent: int):
    """Pairs (a, b) that their sizes and wide sketches let pass, from rows (a, b, size of a, sketch of a, size of b, sketch of b); the longer sketch is folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, m, x, n, y = _columns(batch)
            yield batch.select([0, 1]).filter(pa.array(_passing(percent, m, n, _differ(x, y))))

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            hold = np.zeros(batch.num_rows, dtype=bool)
            last, x = None, None
            for i, (k, p, q) in enumerate(zip(a.to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if k != last:
                    last, x = k, np.frombuffer(p.as_buffer(), dtype=np.uint64)
                y = np.frombuffer(q.as_buffer(), dtype=np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                hold[i] = 100 * common >= percent * (len(x) + len(y) - common)
            mask = pa.array(hold)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return run


#: A side of at most so many rows of two longs (64 MB) is sent to all executors; beyond, the join is by shuffle.
BROADCAST_ROWS = 4_000_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_equal) for each row: the classes of texts that links join.

    Words are what lies between ASCII white space, A-Z in lower case. A text of
    fewer than n words, but not none, has its whole sequence as its one shingle;
    a null or wordless text has none and links with nothing (n_equal is 1, its
    class is its own id). component_id is the least id that links reach; n_equal
    counts the rows with the same set. Rows that repeat an id are one document
    of the class that any of them reaches. A row of a null id links as any
    other and has a null class where no id is reached. Ids are integers. Other
    columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    members = scratch.save(texts.mapInArrow(_members(n, percent), "id long, n_shingles long, node long, sample array<long>"), "members")
    hot, tasks = _hot(members)
    members = members.drop("sample")
    signed = texts.mapInArrow(_signed(n, percent, hot, tasks), "sig long, node long, deal int")
    shared = scratch.save(signed.repartition("sig", "deal").sortWithinPartitions("sig", "node").mapInArrow(_shared, "sig long, node long, other long"), "shared")
    few = scratch.save(shared.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct(), "few")
    multi = scratch.save(shared.where("other IS NULL").select("sig", "node"), "multi")
    scratch.drop(shared)
    scratch.release()  # the shuffle of all signatures is by far the largest

    # the nodes that share a signature, each with one of its rows
    active = multi.select("node").union(few.select("a")).union(few.select("b")).distinct()
    source = scratch.save(members.join(active, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")), "source")

    def made(own: DataFrame, of, fields: str) -> DataFrame:
        """What ``of`` makes of the texts of nodes, from rows (node, id); other texts of those ids too, and a node twice where rows repeat an id."""
        wanted = _small(own.select("id").where("id IS NOT NULL").distinct(), own.count())
        out = texts.join(wanted, "id", "left_semi").select("id", "text").mapInArrow(of(n), fields)
        bare = own.where("id IS NULL").select("node")
        if not bare.isEmpty():  # nodes that no row with an id has
            out = out.union(texts.where("id IS NULL").mapInArrow(of(n), fields).join(bare, "node", "left_semi").dropDuplicates(["node"]).select(out.columns))
        return out

    sketches = scratch.save(made(source, _sketches, _SKETCHES), "sketches")
    sketch = sketches.select(SKETCH)

    def may_link(x: str, y: str):
        """Bounds that every linked pair meets, on sizes and on the sketches."""
        a, b = F.col(f"{x}.size"), F.col(f"{y}.size")
        differ = sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(4)), F.lit(0))
        return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * differ <= (100 - percent) * (a + b))

    wide = sketches.select("node", "size", "wide")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = scratch.save(pairs.distinct(), "pairs")
        own = scratch.save(source.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"), "own")
        sets = scratch.save(made(own, _sets, _SETS), "sets")
        near = _small(pairs, pairs.count()).join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        both = near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
        out = scratch.save(both.select("a", "b", "x", "y").mapInArrow(_verified(percent), "a long, b long"), "links")
        scratch.drop(pairs, own, sets)
        return out

    degree = multi.groupBy("node").agg(F.count("*").alias("degree"))
    rows = multi.join(degree.join(wide, "node"), "node").select("sig", "node", "size", "wide", "degree")
    hubs = rows.repartition("sig").sortWithinPartitions("sig", F.desc("degree"), "node").mapInArrow(_hubs(percent), "a long, b long")
    near = few.join(sketch.alias("x"), F.col("a") == F.col("x.node")).join(sketch.alias("y"), F.col("b") == F.col("y.node")).where(may_link("x", "y")).select("a", "b")
    x, y = wide.toDF("a", "m", "v"), wide.toDF("b", "n", "w")
    near = near.join(x, "a").join(y, "b").select("a", "b", "m", "v", "n", "w").mapInArrow(_sketched(percent), "a long, b long")
    edges = linked(hubs.union(near))
    label = components(edges, scratch)
    scratch.release()

    def labelled(buckets: DataFrame, most: int | None) -> DataFrame:
        """What _across finds in the buckets (sig, node)."""
        marks = wide.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        in_order = buckets.join(marks, "node").select("sig", "node", "size", "wide", "label").repartition("sig").sortWithinPartitions("sig", "label")
        return in_order.mapInArrow(_across(percent, most), "a long, b long")

    found = scratch.save(labelled(multi, OPEN), "found")
    more = linked(found.where("b IS NOT NULL"))
    large = found.where("b IS NULL").select(F.col("a").alias("node")).distinct()
    if not large.isEmpty():
        need = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1  # linked sets share percent of the greater one's shingles at least
        spread = scratch.save(made(source.join(large, "node", "left_semi"), _sets, _SETS).join(large, "node", "left_semi").dropDuplicates(["node"]).select("node", need.cast("long").alias("few"), "set").mapInArrow(_spread, "node long, few long, key long"), "spread")
        common = spread.groupBy("key").agg(F.count("*").alias("k"))
        place = F.row_number().over(Window.partitionBy("node").orderBy("k", "key"))
        first = spread.join(common, "key").withColumn("place", place).where("place <= few AND k > 1").select(F.col("key").alias("sig"), "node")
        more = more.union(linked(labelled(first, None)))
    if not more.isEmpty():
        label = components(edges.union(more), scratch)

    scratch.drop(sketches, multi, few, source, found)  # the result reads none of them

    # the least id of each class; equal sets belong to one node
    per_node = members.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n_equal"))
    classed = per_node.join(label, "node", "left").select("node", "least", "n_equal", F.coalesce("label", "node").alias("label"))
    by_label = classed.groupBy("label").agg(F.min("least").alias("component_id"))
    classed = classed.join(by_label, "label").select("node", "n_equal", "component_id")
    out = members.join(classed, "node", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_equal", F.lit(1)).alias("n_equal"))


_SKETCHES, _SETS = "node long, size long, s0 long, s1 long, s2 long, s3 long, wide binary", "node long, size long, set binary"


def _hot(members: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, sorted, of many of the sample's sets (a thousandth at least, so that they are few), and the tasks that each goes to."""
    sample = members.where(F.size("sample") > 0).dropDuplicates(["node"])
    most = max(HOT, sample.count() // 1000)
    got = sample.select(F.explode("sample").alias("sig")).groupBy("sig").agg(F.count("*").alias("k")).where(F.col("k") >= most).toArrow()
    sig, k = got["sig"].to_numpy().view(np.uint64), got["k"].to_numpy()
    order = np.argsort(sig)
    return sig[order], np.maximum(2, k[order] * SAMPLE // TASK_ROWS)
