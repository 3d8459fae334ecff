"""Subword lattice likelihood: the probability of a text over all its segmentations into pieces of an existing vocabulary.

Pieces don't cross white space, so a text's lattice falls apart at the words:
its log-probability is the sum of its words' marginals and of one end. A
word's marginal is the forward recursion over byte positions in log space,
over all pieces that end there. The vocabulary is that of a public tokenizer
file, whose scores (ranks) give the first piece probabilities; passes of
expectation and maximisation over the training words fit them, and the
vocabulary itself is never changed.

The words that most tokens are, a bounded number of them, are broadcast with
their numbers; all other words are joined by shuffle, without frequent keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .text import LOWER, SPACED, chunks, prefix, span_hash, words

#: So many of the most frequent words are broadcast at most (about 40 bytes each).
FREQUENT = 1 << 18
PASSES = 2
TEXT_CHUNK = 1 << 23
_MANY = 100_000
_LONG = 64
_START = b"\x01"  # stands before a word, as the vocabulary's mark of a space does
_TEN = math.log(10)


class Pieces:
    """Pieces as bytes, by hash, with log-probabilities."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        end = np.cumsum([len(p) for p in pieces])
        h = span_hash(data, end - np.array([len(p) for p in pieces]), end)
        # a byte may be a piece twice, as a character and as a fallback
        self.hash, self.of = np.unique(h, return_inverse=True)
        self.longest = max(map(len, pieces))
        self.logp = np.full(len(self.hash), -np.inf)
        np.logaddexp.at(self.logp, self.of, logp)
        self.quick = np.zeros(1 << 20, dtype=bool)
        self.quick[self.hash >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and which."""
        at = np.flatnonzero(self.quick[h >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        same = self.hash[place] == h[at]
        return at[same], place[same]


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Bytes and first log-probabilities of a sentencepiece file's pieces: Zipf's law over the ranks that its scores give."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores = [], []
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        p = sp.id_to_piece(i)
        pieces.append(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", "\x01").encode())
        scores.append(-1e9 if sp.is_byte(i) else sp.get_score(i))
    rank = np.argsort(np.argsort(-np.array(scores), kind="stable"), kind="stable")
    p = 1 / (rank + 10.0)
    return pieces, np.log(p / p.sum())


def _long(pieces: Pieces, word: bytes, weight: float, counts: np.ndarray | None) -> float:
    """One long word: its pieces are looked up side by side, and the recursion visits those found."""
    data = np.frombuffer(word, dtype=np.uint8)
    n, sums = len(data), prefix(data)
    ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for k in range(1, min(pieces.longest, n) + 1):
        start = np.arange(n - k + 1)
        for s, p in zip(*(x.tolist() for x in pieces.find(span_hash(data, start, start + k, sums))), strict=True):
            ends[s + k].append((s, p))
    logp = pieces.logp
    alpha = [0.0] + [-math.inf] * n
    for i in range(1, n + 1):
        x = [alpha[s] + logp[p] for s, p in ends[i]]
        if x and (top := max(x)) > -math.inf:
            alpha[i] = top + math.log(sum(math.exp(v - top) for v in x))
    if counts is not None and alpha[n] > -math.inf:
        gain = [0.0] * n + [1.0]  # share of the word's mass that passes a position
        for i in range(n, 0, -1):
            if gain[i] > 0:
                for s, p in ends[i]:
                    share = gain[i] * math.exp(alpha[s] + logp[p] - alpha[i])
                    gain[s] += share
                    counts[p] += share * weight
    return alpha[n]


def marginals(pieces: Pieces, raw: list[bytes], weight: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
    """Natural log-probability of each word; adds to counts (by piece) how often each is expected, times the word's weight.

    Words of one length go side by side. A word that the pieces can't spell has
    -inf; with single bytes among the pieces there is none.
    """
    out = np.zeros(len(raw))
    size = np.array([len(w) for w in raw], dtype=np.int64) + 1
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        if n > _LONG:
            for i in own.tolist():
                out[i] = _long(pieces, _START + raw[i], 0.0 if weight is None else float(weight[i]), counts)
            continue
        data = np.frombuffer(b"".join(_START + raw[i] for i in own.tolist()), dtype=np.uint8)
        sums, first = prefix(data), np.arange(len(own)) * n
        alpha = np.full((n + 1, len(own)), -np.inf)
        alpha[0] = 0
        found = []
        for i in range(1, n + 1):
            for j in range(max(0, i - pieces.longest), i):
                rows, p = pieces.find(span_hash(data, first + j, first + i, sums))
                if len(rows):
                    alpha[i, rows] = np.logaddexp(alpha[i, rows], alpha[j, rows] + pieces.logp[p])
                    found.append((j, i, rows, p))
        out[own] = alpha[n]
        if counts is not None:
            gain = np.zeros_like(alpha)
            gain[n] = np.where(np.isfinite(alpha[n]), 1.0, 0.0)
            for j, i, rows, p in reversed(found):
                with np.errstate(invalid="ignore"):
                    share = np.nan_to_num(gain[i, rows] * np.exp(alpha[j, rows] + pieces.logp[p] - alpha[i, rows]))
                gain[j, rows] += share  # rows are distinct
                np.add.at(counts, p, share * weight[own[rows]])
    return out


def _gathered(batches: Iterator[pa.RecordBatch], n: int = _MANY) -> Iterator[pa.Table]:
    """Small batches put together to about n rows, so that words of one length are many."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= n:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of a chunk of texts with their times in training rows, which come first: one row of a word for each chunk."""
    for b in batches:
        for lo, hi, data, off in chunks(b.column(1), TEXT_CHUNK):
            data = LOWER[data]
            w = words(data, off, SPACED, lower=False)
            train = b.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
            uniq, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
            c = np.bincount(inverse, weights=train[w.doc], minlength=len(uniq)).astype(np.int64)
            raw = data.tobytes()
            own = [raw[s:e] for s, e in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(own, pa.binary()), pa.array(c)], ["h", "word", "c"])


def _expected(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(pieces.hash))
        for t in _gathered(batches):
            marginals(pieces, t.column("word").to_pylist(), t.column("c").to_numpy().astype(float), counts)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["piece", "n"])

    return run


def _valued(pieces: Pieces, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches):
            c = t.column("c").to_numpy()
            base = np.log10((c + 1) / total)
            score = marginals(pieces, t.column("word").to_pylist()) / _TEN
            yield pa.RecordBatch.from_arrays([t.column("h").combine_chunks(), pa.array(c), pa.array(base), pa.array(score)], ["h", "c", "base", "score"])

    return run


ROWS = "rid long, id long, train boolean, h long, n long, known long, base double, score double"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def _rows(shared):
    """For each text one row of sums over the broadcast words (h is null), and one row for each other word and chunk row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known, base, score = shared.value
        for b in batches:
            for lo, hi, data, off in chunks(b.column(3)):
                n = hi - lo
                w = words(data, off, SPACED)
                place = np.minimum(np.searchsorted(hashes, w.hash), max(len(hashes) - 1, 0))
                has = hashes[place] == w.hash if len(hashes) else np.zeros(len(w.hash), bool)
                d, p = w.doc[has], place[has]
                sums = lambda v: np.bincount(d, weights=v, minlength=n).astype(float)  # noqa: E731, B023
                rid, id_, train = (b.column(i).slice(lo, n) for i in range(3))
                yield pa.RecordBatch.from_arrays([rid, id_, train, pa.nulls(n, pa.int64()), pa.array(w.counts(), pa.int64()), pa.array(sums(known[p]).astype(np.int64)), pa.array(sums(base[p])), pa.array(sums(score[p]))], _NAMES)
                h, d = w.hash[~has], w.doc[~has]
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(h)))
                m = len(first)
                yield pa.RecordBatch.from_arrays([rid.take(pa.array(d[first])), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.array(h[first].view(np.int64)), pa.array(times, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], _NAMES)

    return run


def score_texts(docs: DataFrame, vocabulary: str, trains: Column, id_col: str = "doc_id", text_col: str = "text", passes: int = PASSES, frequent: int = FREQUENT) -> DataFrame:
    """(id, trained, n_tokens, n_known, train_tokens, base_score, score) for each row.

    ``trains`` says which rows the counts and piece probabilities are learnt
    from; a null counts as no. Tokens are words between ASCII white space, A-Z
    in lower case, and one end for each text; a null or empty text is its end.
    base_score adds log10((c + 1) / (N + V + 1)) over tokens, with counts c, N
    tokens and V distinct ones in training rows; score is the lattice model's
    log10-probability of the words and the end. Rows that repeat an id are
    scored each; without training rows all counts are 0 and pieces keep their
    first probabilities.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lattice")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(trains, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    vocab = texts.select("train", "text").mapInArrow(_tokens, "h long, word binary, c long").groupBy("h", "word").agg(F.sum("c").alias("c"))
    vocab = scratch.save(vocab, "vocabulary")
    n_words, n_distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    n_ends = texts.where("train").count()
    n_tokens, n_distinct = n_words + n_ends, n_distinct + (n_ends > 0)
    total = n_tokens + n_distinct + 1

    spelt, logp = read_pieces(vocabulary)
    pieces = Pieces(spelt, logp)
    used = 0.0
    for _ in range(passes if n_words else 0):
        got = vocab.where("c > 0").mapInArrow(_expected(pieces), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row for each piece
        counts = np.full(len(pieces.hash), 0.1)
        for r in got:
            counts[r.piece] += r.n
        used = counts.sum()
        pieces.logp = np.log(counts / used)
    # the end is one more piece: each text draws it once, after its words' pieces
    end = (n_ends + 1) / (used + n_ends + 2)
    pieces.logp = pieces.logp + math.log1p(-end)

    values = scratch.save(vocab.mapInArrow(_valued(pieces, total), "h long, c long, base double, score double"), "values")
    # the least count of a frequent word, from a histogram of eighths of powers of two, so that no more than ``frequent`` rows reach the driver
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = values.where("c > 1").groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    within = np.cumsum([r.n for r in sizes]) <= frequent
    least = min((r.step for r, ok in zip(sizes, within, strict=True) if ok), default=1 << 30)
    top = values.where("c > 1").where(step >= least).toPandas()
    order = np.argsort(top.h.to_numpy().view(np.uint64)) if len(top) else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast((top.h.to_numpy(dtype=np.int64).view(np.uint64)[order], (top.c.to_numpy()[order] > 0).astype(float), top.base.to_numpy(dtype=float)[order], top.score.to_numpy(dtype=float)[order]))

    numbered = texts.select(F.monotonically_increasing_id().alias("rid"), "id", "train", "text")
    rows = scratch.save(numbered.mapInArrow(_rows(shared), ROWS), "rows")  # written, so that rid is the same from here on
    rare = rows.where("h IS NOT NULL").select("rid", "h", "n").join(values, "h")
    rare = rare.select("rid", F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.col("base")).alias("base"), (F.col("n") * F.col("score")).alias("score"))
    rare = rare.groupBy("rid").agg(*(F.sum(c).alias(f"rare_{c}") for c in ("known", "base", "score")))
    out = rows.where("h IS NULL").join(rare, "rid", "left")
    out = out.select("id", "train", "n", *((F.col(c) + F.coalesce(f"rare_{c}", F.lit(0))).alias(c) for c in ("known", "base", "score")))
    return out.select(
        F.col("id").alias(id_col), F.col("train").alias("trained"), (F.col("n") + 1).alias("n_tokens"), (F.col("known") + int(n_ends > 0)).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"), (F.col("base") + math.log10((n_ends + 1) / total)).alias("base_score"), (F.col("score") + math.log10(end)).alias("score"),
    )
