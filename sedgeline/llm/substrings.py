"""Exact substring deduplication: bytes of strings of ``size`` bytes that start anywhere else too.

Equal windows of ``size`` bytes have equal least hashes of their K-byte grams,
so the windows of a text that share a least gram are one context, and equal
windows meet in the contexts of one gram. Contexts that occur twice are
repeated whole. Of the grams with several different contexts, or with a context
that holds them twice, each context is fetched once, and blocks of them get a suffix array, by linear grouping
(suffix.py), over phrases that their content cuts: a window can occur twice
only where its run of whole phrases is shared with a neighbour in suffix order.
Windows that meet by the hash of their bytes are then compared byte by byte.
Contexts are equal when the gram's and the context's hashes are, 128 bits
together, and texts when two hashes of theirs are.

The contexts of a gram that has very many are dealt to several tasks. Each of
their blocks gives its distinct windows once, as arrays for PIECES ranges of
their hashes, and the arrays of a gram's piece are compared after a shuffle.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .suffix import suffix_array
from .text import buffers, chunks, prefix, span_hash

K = 32
#: Phrases end where a hash of PHRASE bytes is the least within RADIUS positions on either side.
PHRASE, RADIUS = 4, 8
#: Grams go into one suffix array until their contexts have so many bytes; a gram that has more than SPLIT is cut into blocks, whose windows are then compared by shuffle.
BLOCK, SPLIT = 1 << 18, 1 << 22
#: Contexts of one gram that go to one task.
TASK_CONTEXTS = 1_000
#: Ranges of hashes in which the windows of dealt or split grams meet.
PIECES = 256


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` entries, by doubling."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def contexts(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(row, first window within the row, windows, gram hash, hash of the bytes, whether the gram is in it twice) of each run of windows with one least gram."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    if len(data) < size:
        return none
    sums = prefix(data)
    pos = np.arange(len(data) - K + 1)
    grams = span_hash(data, pos, pos + K, sums)
    least = _least(grams, size - K + 1)
    start = np.arange(len(least))
    doc = np.searchsorted(off, start, side="right") - 1
    ok = start + size <= off[doc + 1]
    start, doc, least = start[ok], doc[ok], least[ok]
    if not len(start):
        return none
    first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
    last = np.append(first[1:], len(start)) - 1
    a, b = start[first], start[last] + size
    # the first place of the gram is in the first window, its last one in the last window
    within = np.arange(size - K + 1)
    twice = np.zeros(len(a), dtype=bool)
    for x in range(0, len(a), 4096):
        y = slice(x, x + 4096)
        left = (grams[a[y, None] + within] == least[first[y], None]).argmax(1)
        right = (grams[b[y, None] - K - within] == least[first[y], None]).argmax(1)
        twice[y] = a[y] + left != b[y] - K - right
    return doc[first], a - off[doc[first]], last - first + 1, least[first], span_hash(data, a, b, sums), twice


def _spans(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, off in chunks(b.column(3)):
                doc, first, n, h, c, twice = contexts(data, off, size)
                at = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(first), pa.array(n), pa.array(twice)], ["t", "u", "id", "h", "c", "first", "n", "twice"])

    return run


def _fetched(size: int):
    """The bytes of the wanted contexts of each text, from rows (text, list of (h, c, first, n, deal))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(0))
            h, c, deal, raw = [], [], [], []
            for d, wanted in enumerate(b.column(1).to_pylist()):
                for w in wanted:
                    a = off[d] + w["first"]
                    h.append(w["h"])
                    c.append(w["c"])
                    deal.append(w["deal"])
                    raw.append(data[a : a + w["n"] + size - 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(deal, pa.int64()), pa.array(c, pa.int64()), pa.array(raw, pa.binary())], ["h", "deal", "c", "bytes"])

    return run


def _phrases(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Marks the positions where phrases begin: at each context's start, and where content says so."""
    n = len(data)
    begin = np.zeros(n + 1, dtype=bool)
    begin[off] = True
    m = n - PHRASE + 1
    if m > 2 * RADIUS:
        pos = np.arange(m)
        h = span_hash(data, pos, pos + PHRASE)
        mid = h[RADIUS : m - RADIUS]
        least = np.ones(len(mid), dtype=bool)
        for k in range(1, RADIUS + 1):
            least &= (mid < h[RADIUS - k : m - RADIUS - k]) & (mid <= h[RADIUS + k : m - RADIUS + k])
        begin[RADIUS : m - RADIUS] |= least
    return begin


def repeated(data: np.ndarray, off: np.ndarray, size: int) -> np.ndarray:
    """Marks the positions of a block of contexts at which a window of ``size`` bytes starts that another position of the block has too."""
    n = len(data)
    begin = _phrases(data, off)
    start = np.flatnonzero(begin[:n])
    end = np.append(start[1:], n)
    ctx = np.searchsorted(off, start, side="right") - 1
    # a phrase that its context's end cuts has a name of its own, and so ends every match
    name = span_hash(data, start, end)
    name[end == off[ctx + 1]] = np.arange(int((end == off[ctx + 1]).sum()), dtype=np.uint64)
    _, symbol = np.unique(name, return_inverse=True)
    sa = suffix_array(symbol)
    # bytes of whole phrases that each suffix shares with the one before it in order
    shared = np.zeros(len(sa), dtype=np.int64)
    if len(sa) > 1:
        i, j = sa[1:].copy(), sa[:-1].copy()
        live, got = np.arange(len(i)), np.zeros(len(i), dtype=np.int64)
        while len(live):
            ok = (i < len(symbol)) & (j < len(symbol))
            live, i, j = live[ok], i[ok], j[ok]
            ok = symbol[i] == symbol[j]
            live, i, j = live[ok], i[ok], j[ok]
            got[live] += end[i] - start[i]
            ok = got[live] < size
            live, i, j = live[ok], i[ok] + 1, j[ok] + 1
        shared[sa[1:]] = np.maximum(shared[sa[1:]], got)
        np.maximum.at(shared, sa[:-1], got)
    # a window's phrases that its own bytes decide begin RADIUS after its start, and end RADIUS and PHRASE before its end
    w = np.arange(n)
    w_ctx = np.searchsorted(off, w, side="right") - 1
    w = w[w + size <= off[w_ctx + 1]]
    edge = np.append(start, n)
    p = np.searchsorted(start, w + RADIUS)
    q = np.searchsorted(start, w + size - RADIUS - PHRASE, side="right") - 1
    sure = np.append(shared, 0)[np.minimum(p, len(start))] >= edge[np.maximum(q, 0)] - edge[np.minimum(p, len(start))]
    w = w[(q <= p) | sure]
    out = np.zeros(n, dtype=bool)
    if not len(w):
        return out
    h = span_hash(data, w, w + size)
    order = np.argsort(h, kind="stable")
    x, y, same = w[order][:-1], w[order][1:], h[order][1:] == h[order][:-1]
    x, y, of = x[same], y[same], h[order][1:][same]
    equal = _equal(data, x, y, size)
    if equal.all():
        out[x] = out[y] = True
    else:  # hashes of unlike windows met: the bytes themselves decide
        met = w[np.isin(h, np.unique(of[~equal]))]
        sure = ~np.isin(of, np.unique(of[~equal]))
        out[x[sure]] = out[y[sure]] = True
        raw = [data[a : a + size].tobytes() for a in met]
        times = Counter(raw)
        out[[a for a, r in zip(met, raw, strict=True) if times[r] > 1]] = True
    return out


def _equal(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Whether the windows at x and y have the same bytes: of pairs that both move on by one place, all but the last byte is known."""
    order = np.argsort(x, kind="stable")
    a, b = x[order], y[order]
    start = np.ones(len(a), dtype=bool)
    start[1:] = (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)
    good = data[a + size - 1] == data[b + size - 1]
    at, step = np.flatnonzero(start), np.arange(size)
    for i in range(0, len(at), 8192):
        k = at[i : i + 8192]
        good[k] = (data[a[k, None] + step] == data[b[k, None] + step]).all(1)
    # a run is good as far as all of it is
    bad = np.cumsum(~good)
    run = np.cumsum(start) - 1
    before = bad[at] - ~good[at]
    out = np.empty(len(a), dtype=bool)
    out[order] = bad - before[run] == 0
    return out


BLOCK_FIELDS = "h long, c long, first long, last long, piece int, windows binary"
BLOCK_NAMES = ["h", "c", "first", "last", "piece", "windows"]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c, first, last) of the windows that blocks of one gram have in common and that aren't marked; from rows (h, piece, windows) in order of h and piece. A piece of one gram is held."""

    def compared(h: int, parts: list[bytes]) -> pa.RecordBatch:
        w, c, first = np.frombuffer(b"".join(parts), dtype=np.int64).reshape(-1, 3).T
        order = np.argsort(w, kind="stable")
        w, c, first = w[order], c[order], first[order]
        same = np.r_[False, w[1:] == w[:-1]]
        new = (same | np.r_[same[1:], False]) & (first >= 0)
        return pa.RecordBatch.from_arrays([pa.array(np.full(int(new.sum()), h)), pa.array(c[new]), pa.array(first[new]), pa.array(first[new])], BLOCK_NAMES[:4])

    of, parts = None, []
    for b in batches:
        for h, piece, windows in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if (h, piece) != of:
                if len(parts) > 1:
                    yield compared(of[0], parts)
                of, parts = (h, piece), []
            parts.append(windows)
    if len(parts) > 1:
        yield compared(of[0], parts)


def _blocks(size: int, most: int, split: int):
    """From contexts in order of (h, deal, c): rows (h, c, first, last) of runs of repeated windows; and, where a gram's contexts are cut into blocks or dealt to tasks, rows (h, piece, windows): distinct windows as (hash, c, first), with first as -1 - first for those marked already."""

    def work(h: list[int], c: list[int], raw: list[bytes], part: bool) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        off = np.cumsum([0, *map(len, raw)])
        hit = repeated(data, off, size)
        begin = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
        begin = np.union1d(begin, off[:-1][hit[off[:-1]]]) if len(off) > 1 else begin
        ctx = np.searchsorted(off, begin, side="right") - 1
        clear = np.flatnonzero(np.r_[~hit, True])
        last = np.minimum(clear[np.searchsorted(clear, begin)], off[ctx + 1]) - 1
        hs, cs = np.array(h, dtype=np.int64), np.array(c, dtype=np.int64)
        runs = pa.RecordBatch.from_arrays([pa.array(hs[ctx]), pa.array(cs[ctx]), pa.array(begin - off[ctx]), pa.array(last - off[ctx]), pa.nulls(len(ctx), pa.int32()), pa.nulls(len(ctx), pa.binary())], BLOCK_NAMES)
        if not part:
            return runs
        at = np.arange(len(data))
        of = np.searchsorted(off, at, side="right") - 1
        at = at[(at + size <= off[of + 1])]
        w = span_hash(data, at, at + size)
        # of the windows that the block repeats, one tells other blocks
        again = np.flatnonzero(hit[at])
        once = np.r_[np.flatnonzero(~hit[at]), again[np.unique(w[again], return_index=True)[1]]]
        once = once[np.argsort(w[once], kind="stable")]
        at, w = at[once], w[once]
        of = np.searchsorted(off, at, side="right") - 1
        packed = np.stack([w.view(np.int64), cs[of], np.where(hit[at], -1 - (at - off[of]), at - off[of])], 1)
        piece, start = np.unique((w >> np.uint64(32)) * np.uint64(PIECES) >> np.uint64(32), return_index=True)
        parts = [x.tobytes() for x in np.split(packed, start[1:])] if len(w) else []
        none = pa.nulls(len(parts), pa.int64())
        told = pa.RecordBatch.from_arrays([pa.array([h[0]] * len(parts), pa.int64()), none, none, none, pa.array(piece.astype(np.int32)), pa.array(parts, pa.binary())], BLOCK_NAMES)
        return pa.concat_batches([runs, told])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c, raw, held, part, gram = [], [], [], 0, False, None  # part: the gram has a block out already, or other tasks have some of it
        for b in batches:
            for x, deal, y, z in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if h and (x, deal) == gram and y == c[-1]:
                    continue
                if (x, deal) != gram:
                    if h and (part or held >= most or deal >= 0):
                        yield work(h, c, raw, part)
                        h, c, raw, held = [], [], [], 0
                    part, gram = deal >= 0, (x, deal)
                elif held >= split:
                    k = h.index(x)
                    if k:  # the grams before it have a block of their own
                        yield work(h[:k], c[:k], raw[:k], False)
                        h, c, raw = h[k:], c[k:], raw[k:]
                        held = sum(map(len, raw))
                    if held >= split:
                        yield work(h, c, raw, True)
                        h, c, raw, held, part = [], [], [], 0, True
                h.append(x)
                c.append(y)
                raw.append(z)
                held += len(z)
        if h:
            yield work(h, c, raw, part)

    return run


FIELDS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _removed(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(1))
            n, gone, runs, sha, kept = [], [], [], [], []
            for d, spans in enumerate(b.column(2).to_pylist()):
                own, at, parts, k, removed = memoryview(data[off[d] : off[d + 1]]), 0, [], 0, 0
                for s in sorted((s["a"], s["b"]) for s in spans or ()):
                    if s[0] > at or not k:
                        parts.append(own[at : s[0]])
                        k += 1
                    removed += max(0, s[1] - max(s[0], at if k else 0))
                    at = max(at, s[1])
                parts.append(own[at:])
                left = b"".join(parts)
                n.append(len(own))
                gone.append(len(own) - len(left))
                runs.append(k)
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left if keep_bytes else None)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row; kept are the bytes left, null without keep_bytes.

    A byte goes if a string of ``size`` bytes that covers it starts anywhere
    else too, in its own text or another; strings are judged on the input. A
    null or empty text has no bytes. Rows that repeat a text repeat all of it.
    Bytes are those of UTF-8, and what is left may cut a character in two. Ids
    are integers; a null id is kept, and its text counts as any other's. Other
    columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    texts = docs.select(F.xxhash64(text_col).alias("t"), F.xxhash64(F.lit(1), text_col).alias("u"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # every join goes by shuffle, whatever the sizes: lists of spans grow with the text, and would go through the driver
    spans = scratch.save(texts.where(F.octet_length("text") >= size).mapInArrow(_spans(size), "t long, u long, id long, h long, c long, first long, n long, twice boolean"), "spans")
    ctx = spans.groupBy("h", "c").agg(F.count("*").alias("times"), F.max(F.col("twice").cast("long")).alias("twice"), F.min(F.struct("t", "u", "id", "first", "n")).alias("at"))
    ctx = scratch.save(ctx, "contexts")
    scratch.release()  # shuffle files of what is written
    grams = ctx.groupBy("h").agg((F.sum("times") + F.max("twice")).alias("total"), (F.count("*") + F.max("twice")).alias("kinds")).where("total > 1")
    live = scratch.save(ctx.join(grams.hint("merge"), "h").select("h", "c", "times", "kinds", "at"), "live")
    scratch.drop(ctx)
    scratch.release()

    # of a gram with more contexts than a task should have, each goes to one of several tasks
    deal = F.when(F.col("kinds") > TASK_CONTEXTS, F.pmod(F.xxhash64("c"), F.ceil(F.col("kinds") / TASK_CONTEXTS))).otherwise(-1).cast("long")
    wanted = live.where("kinds > 1").groupBy("at.t", "at.u", "at.id").agg(F.collect_list(F.struct("h", "c", "at.first", "at.n", deal.alias("deal"))).alias("wanted"))
    wanted = scratch.save(wanted, "wanted")
    x, y = texts.alias("x"), wanted.hint("merge").alias("y")
    raw = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.u") == F.col("y.u")) & F.col("x.id").eqNullSafe(F.col("y.id"))).select("text", "wanted")
    raw = raw.mapInArrow(_fetched(size), "h long, deal long, c long, bytes binary")
    found = raw.repartition("h", "deal").sortWithinPartitions("h", "deal", "c").mapInArrow(_blocks(size, block, split), BLOCK_FIELDS)
    found = scratch.save(found, "found")
    scratch.drop(wanted)
    scratch.release()
    # windows of grams that went over several blocks
    over = found.where("piece IS NOT NULL").select("h", "piece", "windows").repartition("h", "piece").sortWithinPartitions("h", "piece").mapInArrow(_met, "h long, c long, first long, last long")
    runs = found.where("piece IS NULL").select("h", "c", "first", "last").union(over)
    whole = live.where("times > 1").select("h", "c", F.lit(0).cast("long").alias("first"), (F.col("at.n") - 1).alias("last"))
    marks = runs.union(whole).select("h", "c", F.col("first").alias("x"), F.col("last").alias("y"))

    hit = spans.join(marks.hint("merge"), ["h", "c"]).select("t", "u", F.struct((F.col("first") + F.col("x")).alias("a"), (F.col("first") + F.col("y") + size).alias("b")).alias("s"))
    covered = scratch.save(hit.groupBy("t", "u").agg(F.collect_set("s").alias("spans")), "covered")
    scratch.drop(spans, live, found)
    scratch.release()
    out = texts.join(covered.hint("merge"), ["t", "u"], "left").select("id", "text", "spans")
    return out.mapInArrow(_removed(keep_bytes), FIELDS).withColumnRenamed("doc_id", id_col)
