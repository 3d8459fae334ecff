"""Benchmark decontamination by a broadcast set of normalised word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import annotate
from ..scratch import Scratch
from .text import ALNUM, LOWER, chunks, mix, words

#: Broadcast at most so many windows of the benchmark at once (about 100 bytes each); more are taken in several blocks of items.
BLOCK_WINDOWS = 1_000_000
FIELDS = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def _windows(h: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of all windows of each length, from one running sum."""
    acc = np.zeros(len(h), dtype=np.uint64)
    for i in range(1, max(lengths, default=0) + 1):
        m = len(h) - i + 1
        if m <= 0:
            return
        acc = acc[:m] * np.uint64(0x9FB21C651E98DF25) + h[i - 1 : i - 1 + m]
        if i in lengths:
            yield i, mix(acc + np.uint64(i))


def _of_items(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, off in chunks(b.column(1)):
                data = LOWER[data]
                w = words(data, off, ALNUM, lower=False)
                count = w.counts()
                lengths = sorted({size, *(int(x) for x in np.unique(count[(count > 0) & (count < size)]))})
                for n, h in _windows(w.hash, lengths):
                    doc = w.doc[: len(h)]
                    ok = (doc == w.doc[n - 1 :]) & ((n == size) | (count[doc] == n))
                    at = np.flatnonzero(ok)
                    text = [b" ".join(bytes(data[s:e]) for s, e in zip(w.start[i : i + n], w.end[i : i + n], strict=True)) for i in at]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[at] + lo)), pa.array(h[at].view(np.int64)), pa.array(np.full(len(at), n, np.int32)), pa.array(text, pa.binary())], ["item", "hash", "length", "words"])

    return run


def _scan(known) -> callable:
    """Finds the windows of ``known`` (a broadcast of {length: (sorted hashes, words, items)}) in texts."""

    def run(text: pa.Array) -> Iterator[dict[str, pa.Array]]:
        tables = known.value
        quick = {}
        for n, (h, _, _) in tables.items():
            quick[n] = np.zeros(1 << 20, dtype=bool)
            quick[n][h >> np.uint64(44)] = True
        for lo, hi, data, off in chunks(text):
            data = LOWER[data]
            w = words(data, off, ALNUM, lower=False)
            change = np.zeros(len(w.hash) + 1, dtype=np.int64)
            items: dict[int, set[str]] = {}
            for n, h in _windows(w.hash, list(tables)):
                all_h, all_words, all_items = tables[n]
                at = np.flatnonzero(quick[n][h >> np.uint64(44)])
                at = at[w.doc[at] == w.doc[at + n - 1]]
                place = np.searchsorted(all_h, h[at])
                same = all_h[np.minimum(place, len(all_h) - 1)] == h[at]
                for i, p in zip(at[same].tolist(), place[same].tolist(), strict=True):
                    if b" ".join(bytes(data[s:e]) for s, e in zip(w.start[i : i + n], w.end[i : i + n], strict=True)) == all_words[p]:
                        change[i] += 1
                        change[i + n] -= 1
                        items.setdefault(int(w.doc[i]), set()).update(all_items[p])
            hit = np.cumsum(change[:-1]) > 0
            n_hit = np.bincount(w.doc[hit], minlength=hi - lo)
            spans: list[list[dict]] = [[] for _ in range(hi - lo)]
            for d in np.flatnonzero(n_hit):
                a, b = np.searchsorted(w.doc, [d, d + 1])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
                whole = bytes(data[off[d] : off[d + 1]])
                for x, y in edge.reshape(-1, 2):
                    s, e = w.start[a + x] - off[d], w.end[a + y - 1] - off[d]
                    s_at = len(whole[:s].decode())
                    spans[d].append({"start": s_at, "end": s_at + len(whole[s:e].decode())})
            yield {
                "n_words": pa.array(w.counts(), pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "items": pa.array([sorted(items.get(d, ())) for d in range(hi - lo)], pa.list_(pa.string())),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }

    return run


def _known(rows: list) -> dict:
    out: dict[int, dict] = {}
    for r in rows:
        got = out.setdefault(r.length, {}).setdefault(r.hash % (1 << 64), (bytes(r.words), set()))
        if got[0] != bytes(r.words):
            raise ValueError("two benchmark windows have one hash")
        got[1].update(x for x in r.items if x is not None)
    return {n: (np.array(sorted(d), dtype=np.uint64), [d[h][0] for h in sorted(d)], [sorted(d[h][1]) for h in sorted(d)]) for n, d in out.items()}


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", out_col: str = "contamination") -> DataFrame:
    """``docs`` with the struct ``out_col``: n_words, n_hit, items (ids as strings, sorted), spans (code points, ascending).

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z in
    lower case. An item's windows are its runs of ``size`` words; one of fewer
    words, but not none, is one window. A word within any occurrence of a window
    is hit. Every hash that is found is verified word by word. Null and wordless
    texts have no words and no hits; a null item text has no windows; a null
    item id hits without being listed; an empty benchmark hits nothing. Repeated
    items and rows are as good as one each.

    The windows are broadcast while they are at most ``BLOCK_WINDOWS``; a larger
    benchmark is scanned in blocks of items, each within that bound, one after
    the other over all documents, and hits add up; what a block leaves is written
    and its broadcast destroyed before the next one is collected.
    """
    spark = docs.sparkSession
    windows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).mapInArrow(_of_items(size), "item string, hash long, length int, words binary")
    windows = windows.groupBy("hash", "length", "words").agg(F.collect_set(F.coalesce("item", F.lit(""))).alias("items"), F.max(F.col("item").isNull()).alias("unnamed"))
    scratch = Scratch(spark, "benchmark")
    windows = scratch.save(windows.select("hash", "length", "words", F.when(F.col("unnamed"), F.array_remove("items", "")).otherwise(F.col("items")).alias("items")), "windows")
    n_blocks = -(-windows.count() // (BLOCK_WINDOWS // 2)) if windows.count() > BLOCK_WINDOWS else 1
    out = docs
    for block in range(n_blocks):
        part = windows if n_blocks == 1 else windows.where(F.pmod("hash", F.lit(n_blocks)) == block)
        known = spark.sparkContext.broadcast(_known(part.collect()))  # at most BLOCK_WINDOWS rows
        out = annotate(out, _scan(known), FIELDS, out_col if block == 0 else f"{out_col}_{block}", text_col)
        if block:
            out = _added(out, out_col, f"{out_col}_{block}", text_col)
        if n_blocks > 1:
            out = scratch.save(out, "hits")
            known.destroy(blocking=True)
            if block:
                scratch.drop(written)
            written = out
    return out


def _added(out: DataFrame, one: str, two: str, text_col: str) -> DataFrame:
    """Hits of two blocks as one: spans are united, and words in them counted anew."""
    spans = F.array_sort(F.concat(f"{one}.spans", f"{two}.spans"))

    def step(acc, x):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    kind = "array<struct<start:bigint,end:bigint>>"
    united = F.aggregate(spans, F.array().cast(kind), step)
    out = out.withColumn("_united", united)
    hits = F.aggregate(F.transform("_united", lambda s: F.size(F.regexp_extract_all(F.substring(F.col(text_col), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")), F.lit("([^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)"), 1)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    merged = F.struct(F.col(f"{one}.n_words"), hits.alias("n_hit"), F.array_sort(F.array_union(f"{one}.items", f"{two}.items")).alias("items"), F.col("_united").alias("spans"))
    return out.withColumn(one, merged).drop("_united", two)


def is_contaminated(out_col: str = "contamination"):
    """The contract's rule: a word is hit, and at least one word in twenty."""
    return (F.col(f"{out_col}.n_hit") > 0) & (20 * F.col(f"{out_col}.n_hit") >= F.col(f"{out_col}.n_words"))


def without_spans(text_col: str = "text", out_col: str = "contamination"):
    """The text with the hit spans cut out, for callers who remove spans and not documents."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col(f"{out_col}.spans.end"))
    starts = F.concat(F.col(f"{out_col}.spans.start"), F.array(F.length(text_col).cast("long")))
    return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(F.col(text_col), a.cast("int") + 1, (b - a).cast("int"))), "")
