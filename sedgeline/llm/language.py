"""Language identification by bit-sliced Bloom filters of character n-grams.

Training counts the distinct words of each text, by language, and with a word
its n-grams. A language's set has the n-grams whose count is at least ``LEAST``
of its number of words, and whose share of the words is at least ``NEAR`` of
the greatest share that any language has. Shares, not numbers, decide, so a
set's size is bounded by the mean number of n-grams in a word divided by
``LEAST``, however many texts there are.

All sets go into one filter: a place of the filter is a row of bits, one for
each language, and an n-gram sets its languages' bits at each of its places.
The conjunction of an n-gram's rows is the bitmask of all languages that have
it. Summed over a text's n-grams this gives a count for each language; the
share f of set bits of a language makes each absent n-gram look present with
probability f^k, and the counts are corrected for that. The language of the
greatest corrected count is the text's.

N-grams are 1 to ``LONGEST`` characters of lower-cased words (runs of
letters) between marks, so scripts with and without spaces both give some.

Defined results: a null text, or one without a letter, has the language ``und``
and the score 0. Where no n-gram of a text is in any set, the prediction is the
language with the most training texts (of equal ones the least value), and the
score is 1 / number of languages. Without training texts all is ``und`` with
score 0. Equal counts go to the least value. Empty strings are languages like
any other; null ones, and rows whose id is null, aren't learned from. Repeated
rows count as often as they stand there.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .rows import annotate, free
from .text import chunks, mix, runs, span_hash, spans

LONGEST = 4
LEAST, NEAR = 1 / 20_000, 0.25
#: Places of the filter for each n-gram of the largest set, and how many of them an n-gram has.
ROOM, HASHES = 16, 3
UNKNOWN = "und"
#: A task sends its counts on when it holds so many.
HELD = 1 << 20
TEXT_CHUNK, PIECE = 1 << 21, 1 << 19
_MARK = np.uint64(0x1FFFFF)  # no character has this number


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


@dataclass
class Spelled:
    """The distinct words of a chunk, and of each text's distinct words the row, the word and how often it stands there."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    times: np.ndarray


def words_of(data: np.ndarray, off: np.ndarray) -> Spelled:
    """The words of a chunk of lower-case texts."""
    text = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    # characters begin at bytes that aren't continuations
    begin = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    edge = np.searchsorted(begin, off)
    doc, start, end = runs(text, edge, _letters())
    h = span_hash(data, begin[start], begin[end])
    order = np.lexsort((h, doc))
    new = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1]))) if len(h) else np.zeros(0, np.int64)
    first = order[new]
    _, own, word = np.unique(h[first], return_index=True, return_inverse=True)
    return Spelled(text, start[first[own]], end[first[own]], doc[first], word, np.diff(np.append(new, len(h))))


def grams(w: Spelled) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct word and hash of the n-grams of a chunk's distinct words, some words and one n at a time."""
    size = w.end - w.start
    edge = np.append(0, np.cumsum(size + 2))
    lo = 0
    while lo < len(size):
        hi = max(int(np.searchsorted(edge, edge[lo] + PIECE, side="right")) - 1, lo + 1)
        to = edge[lo + 1 : hi + 1] - edge[lo]
        flat = np.full(int(to[-1]), _MARK, dtype=np.uint64)
        flat[spans(to - size[lo:hi] - 1, to - 1)] = w.text[spans(w.start[lo:hi], w.end[lo:hi])]
        word = np.repeat(np.arange(lo, hi), size[lo:hi] + 2)
        h = np.zeros(len(flat), dtype=np.uint64)
        for n in range(1, min(LONGEST, len(flat)) + 1):
            m = len(flat) - n + 1
            h = h[:m] * np.uint64(0x9FB21C651E98DF25) + flat[n - 1 :] + np.uint64(1)
            own = (word[:m] == word[n - 1 :]) if n > 1 else flat != _MARK
            yield word[:m][own], mix(h[own] + np.uint64(n))
        lo = hi


@dataclass
class Filters:
    """Rows of bits by place, the languages in order of their bits, and each language's share of set bits."""

    languages: list[str]
    rows: np.ndarray
    share: np.ndarray
    common: int

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The languages' bits of each n-gram: n-grams x words of 64 bits."""
        out = None
        for p in places(h, len(self.rows)):
            out = self.rows[p] if out is None else out & self.rows[p]
        return out

    def counts(self, w: Spelled, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Corrected numbers of n-grams (texts x languages) and how many n-grams each text has."""
        n_words, n_langs = len(w.start), len(self.languages)
        n, hits = np.zeros(n_words), np.zeros((n_langs, n_words))
        for of, h in grams(w):
            masks = self.masks(h)
            n += np.bincount(of, minlength=n_words)
            for i in range(n_langs):
                hits[i] += np.bincount(of, weights=(masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), minlength=n_words)
        total = np.bincount(w.doc, weights=n[w.word] * w.times, minlength=n_docs)
        out, wrong = np.zeros((n_docs, n_langs)), self.share**HASHES
        for i in range(n_langs):
            own = np.bincount(w.doc, weights=hits[i][w.word] * w.times, minlength=n_docs)
            out[:, i] = np.maximum(own - total * wrong[i], 0) / max(1 - wrong[i], 1e-9)
        return out, total.astype(np.int64)


def places(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The places of each n-gram; ``size`` is a power of two."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield ((h + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


def _counted(languages: list[str]) -> Callable:
    """From (text, language) to (gram, language, number of words of texts), added up as far as a task's bound allows."""
    number = {x: i for i, x in enumerate(languages)}

    def flush(held: list) -> pa.RecordBatch:
        g, y, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((y, g))
        g, y, n = g[order], y[order], n[order]
        new = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (y[1:] != y[:-1])))
        held[:] = [(g[new], y[new], np.add.reduceat(n, new))]
        g, y, n = held[0]
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(y.astype(np.int32)), pa.array(n)], ["gram", "language", "n"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        total = np.zeros(len(languages), dtype=np.int64)
        for b in batches:
            lang = np.array([number[x] for x in b.column(1).to_pylist()], dtype=np.int64)
            for lo, hi, data, off in chunks(b.column(0), TEXT_CHUNK):
                w = words_of(data, off)
                spoken = lang[lo:hi][w.doc]
                times = {y: np.bincount(w.word[spoken == y], minlength=len(w.start)) for y in np.unique(spoken).tolist()}
                for y, n in times.items():
                    total[y] += int(n.sum())
                for of, h in grams(w):
                    g, at = np.unique(h, return_inverse=True)
                    for y, n in times.items():
                        c = np.bincount(at, weights=n[of], minlength=len(g)).astype(np.int64)
                        held.append((g[c > 0], np.full(int((c > 0).sum()), y), c[c > 0]))
                    if sum(len(x[0]) for x in held) > HELD:
                        out = flush(held)
                        if out.num_rows > HELD // 2:
                            yield out
                            held = []
        if held:
            yield flush(held)
        # rows without a gram: the words of each language
        yield pa.RecordBatch.from_arrays([pa.nulls(len(languages), pa.int64()), pa.array(np.arange(len(languages), dtype=np.int32)), pa.array(total)], ["gram", "language", "n"])

    return over


def fit_languages(docs: DataFrame, learns: Column, lang_col: str = "lang", text_col: str = "text") -> Filters:
    """Filters over the rows for which ``learns`` holds and whose language is not null.

    The driver holds the languages with their numbers of texts and the filter,
    whose size follows from the languages' sets (see above).
    """
    lang = F.col(f"`{lang_col}`")
    rows = docs.where(learns & lang.isNotNull()).select(F.lower(f"`{text_col}`").alias("text"), lang.cast("string").alias("lang"))
    total = sorted((r.lang, r["count"]) for r in rows.groupBy("lang").count().collect())
    languages = [x for x, _ in total]
    words = max(-(-len(languages) // 64), 1)
    if not languages:
        return Filters([], np.zeros((1, words), np.uint64), np.zeros(0), 0)
    scratch = Scratch(docs.sparkSession, "language")
    counts = rows.mapInArrow(_counted(languages), "gram long, language int, n long").groupBy("gram", "language").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts, "counts")
    spoken = {r.language: r.n for r in counts.where("gram IS NULL").collect()}
    spoken = F.element_at(F.array(*(F.lit(max(spoken.get(i, 0), 1)) for i in range(len(languages)))), F.col("language") + 1)
    rates = counts.where("gram IS NOT NULL").withColumn("rate", F.col("n") / spoken).groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("language", "rate")).alias("of"))
    sets = rates.select("gram", F.filter("of", lambda x: (x["rate"] >= LEAST) & (x["rate"] >= NEAR * F.col("top"))).alias("of")).where(F.size("of") > 0)
    sets = scratch.save(sets.select("gram", F.transform("of", lambda x: x["language"]).alias("languages")), "sets")
    largest = sets.select(F.explode("languages").alias("language")).groupBy("language").count().agg(F.max("count")).first()[0] or 1
    size = 1 << max((ROOM * largest - 1).bit_length(), 10)
    bits = sets.mapInArrow(_placed(size, words), f"place long, {', '.join(f'm{i} long' for i in range(words))}")
    got = bits.groupBy("place").agg(*(F.bit_or(f"m{i}").alias(f"m{i}") for i in range(words))).toArrow()
    scratch.drop(sets, counts)
    filled = np.zeros((size, words), dtype=np.uint64)
    for i in range(words):
        filled[got["place"].to_numpy(), i] = got[f"m{i}"].to_numpy().view(np.uint64)
    share = np.array([((filled[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Filters(languages, filled, share, max(range(len(total)), key=lambda i: (total[i][1], -i)))


def _placed(size: int, words: int):
    """From (gram, its languages) to the bits at each of its places."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            own = np.repeat(np.arange(len(h)), np.diff(b.column(1).offsets.to_numpy()))
            bit = b.column(1).flatten().to_numpy().astype(np.int64)
            masks = np.zeros((len(h), words), dtype=np.uint64)
            np.bitwise_or.at(masks, (own, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
            for p in places(h, size):
                yield pa.RecordBatch.from_arrays([pa.array(p), *(pa.array(masks[:, i].copy().view(np.int64)) for i in range(words))], ["place", *(f"m{i}" for i in range(words))])

    return over


def identify(docs: DataFrame, filters: Filters, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with the struct ``out_col``: lang, score (the language's part of all languages' counts) and n_grams."""
    low = free(docs, "_lower")
    names = pa.array([*filters.languages, UNKNOWN], pa.string())
    none, width = len(filters.languages), max(len(filters.languages), 1)

    def run(text: pa.Array) -> Iterator[dict[str, pa.Array]]:
        for lo, hi, data, off in chunks(text, TEXT_CHUNK):
            c, n = filters.counts(words_of(data, off), hi - lo)
            if none:
                best, sums = c.argmax(1), c.sum(1)
                best[sums == 0] = filters.common
                score = np.where(sums > 0, c.max(1) / np.maximum(sums, 1e-300), 1 / width)
            else:
                best, score = np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
            best[n == 0], score[n == 0] = none, 0.0
            yield {"lang": names.take(pa.array(best)), "score": pa.array(score), "n_grams": pa.array(n)}

    out = annotate(docs.withColumn(low, F.lower(f"`{text_col}`")), run, "lang string, score double, n_grams long", out_col, low)
    return out.drop(low)
