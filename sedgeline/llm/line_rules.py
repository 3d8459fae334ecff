"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

The field has two labels, a weight for each label and bin of a line's style
features, and a weight for each pair of neighbouring labels. It is trained by
its likelihood on a bounded sample of labelled documents whose lines are
marked from afar: the lines of good documents are content; those of bad ones
are boilerplate where a line's bins are commoner in bad documents than in good
ones. Whole documents are decoded by Viterbi's recursion, all of a chunk side
by side, and the share of words in content lines decides whether one is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .rows import annotate
from .style import BANG, DIGIT, LOW, MARK, OTHER, PIPE, SYMBOL, UP, Lines, repeated_words
from .text import chunks, span_hash

#: The field is trained on so many documents of each label at most, those of the least id hashes, and on so many lines of theirs: whole documents in that order.
DOCUMENTS, LINES = 1_500, 300_000
#: Least share of words in content lines of a kept document.
CONTENT = 0.5
#: Where the bins of each feature end.
EDGES = {
    "words": [1, 3, 6, 12, 30, 100], "upper": [0.05, 0.2, 0.5, 0.8], "pipes": [0.001, 0.1, 0.3], "symbols": [0.001, 0.1, 0.3],
    "bangs": [0.001, 0.1, 0.4], "digits": [0.001, 0.05, 0.3], "others": [0.001, 0.1], "marks": [0.001, 0.05, 0.2],
    "next_same": [0.02, 0.2, 0.5], "again": [0.5], "distinct": [0.3, 0.6, 0.9],
}
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, content_words long"
_WIDTH = [len(e) + 1 for e in EDGES.values()]
N_BINS = sum(_WIDTH)
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _again(x: Lines) -> np.ndarray:
    """Marks lines with a word whose bytes equal an earlier line of their row."""
    if not len(x.start):
        return np.zeros(0, dtype=bool)
    end = x.end - ((x.end > x.start) & (x.data[np.maximum(x.end - 1, 0)] == 0x0A))
    h = span_hash(x.data, x.start, end)
    at = np.flatnonzero(x.words > 0)
    order = at[np.lexsort((h[at], x.doc[at]))]  # stable: the first of equals comes first
    out = np.zeros(len(x.start), dtype=bool)
    out[order[1:][(h[order][1:] == h[order][:-1]) & (x.doc[order][1:] == x.doc[order][:-1])]] = True
    return out


def line_bins(x: Lines, again: np.ndarray) -> np.ndarray:
    """A row for each line: for each feature the index of its bin among all bins."""
    w, n = x.word, np.maximum(x.words, 1).astype(float)
    chars = np.maximum(np.bincount(x.of, weights=w.end - w.start, minlength=len(x.start)), 1)
    same = np.bincount(x.of[1:], weights=(w.hash[1:] == w.hash[:-1]) & (x.of[1:] == x.of[:-1]), minlength=len(x.start)) if len(x.of) else np.zeros(len(x.start))
    order = np.lexsort((w.hash, x.of))
    fresh = np.r_[True, (w.hash[order][1:] != w.hash[order][:-1]) | (x.of[order][1:] != x.of[order][:-1])] if len(order) else np.zeros(0, bool)
    k = x.kinds
    values = {
        "words": x.words, "upper": k[:, UP] / np.maximum(k[:, UP] + k[:, LOW], 1), "pipes": k[:, PIPE] / n, "symbols": k[:, SYMBOL] / n,
        "bangs": k[:, BANG] / n, "digits": k[:, DIGIT] / chars, "others": k[:, OTHER] / n, "marks": k[:, MARK] / chars,
        "next_same": same / n, "again": again, "distinct": np.bincount(x.of[order][fresh], minlength=len(x.start)) / n,
    }
    first = np.cumsum([0, *_WIDTH])
    return np.column_stack([np.searchsorted(EDGES[f], values[f], side="right") + first[i] for i, f in enumerate(EDGES)])


@dataclass
class Field:
    """state[label, bin] and step[before, after]; label 1 is content."""

    state: np.ndarray
    step: np.ndarray

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.state[:, bins].sum(2).T

    def decode(self, scores: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """The likeliest label of each line, by Viterbi over every row's whole sequence; rows side by side, longest first."""
        size = np.bincount(doc, minlength=n_docs)
        first = np.cumsum(size) - size
        rows = np.argsort(-size, kind="stable")
        first, size = first[rows], size[rows]
        live = np.searchsorted(-size, -np.arange(1, (size.max(initial=0)) + 1), side="right")
        back = np.zeros((len(scores), 2), dtype=np.int8)
        label = np.zeros(len(scores), dtype=np.int8)
        best = np.zeros((len(rows), 2))
        for t, n in enumerate(live):
            at = first[:n] + t
            if t:
                through = best[:n, :, None] + self.step[None]
                back[at] = through.argmax(1)
                best[:n] = through.max(1)
            best[:n] += scores[at]
        last = best.argmax(1)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            at = first[:n] + t
            label[at] = last[:n]
            if t:
                last[:n] = back[at, last[:n]]
        return label


def train_field(bins: np.ndarray, label: np.ndarray, doc: np.ndarray, steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Greatest penalised likelihood by Adam; forward and backward sums run over all sequences side by side."""
    n_docs = int(doc.max(initial=-1)) + 1
    size = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(size) - size
    rows = np.argsort(-size, kind="stable")
    first, size = first[rows], size[rows]
    live = np.searchsorted(-size, -np.arange(1, size.max(initial=0) + 1), side="right")
    w, m, v = np.zeros(2 * N_BINS + 4), 0.0, 0.0
    seen = np.zeros((2, N_BINS))
    for y in (0, 1):
        seen[y] = np.bincount(bins[label == y].ravel(), minlength=N_BINS)
    pairs = np.zeros((2, 2))
    inner = doc[1:] == doc[:-1]
    np.add.at(pairs, (label[:-1][inner], label[1:][inner]), 1)
    for i in range(1, steps + 1):
        field = Field(w[: 2 * N_BINS].reshape(2, N_BINS), w[2 * N_BINS :].reshape(2, 2))
        s = field.scores(bins)
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        for t, n in enumerate(live):
            at = first[:n] + t
            alpha[at] = s[at] if not t else s[at] + np.logaddexp.reduce(alpha[at - 1][:, :, None] + field.step, axis=1)
        for t in range(len(live) - 2, -1, -1):
            at = first[: live[t + 1]] + t
            beta[at] = np.logaddexp.reduce(field.step + (s[at + 1] + beta[at + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(alpha + beta, axis=1)
        p = np.exp(alpha + beta - z[:, None])
        want = np.zeros((2, N_BINS))
        for y in (0, 1):
            np.add.at(want[y], bins.ravel(), np.repeat(p[:, y], bins.shape[1]))
        at = np.flatnonzero(inner)
        both = np.exp(alpha[at][:, :, None] + field.step + (s[at + 1] + beta[at + 1])[:, None, :] - z[at][:, None, None]).sum(0)
        grad = np.concatenate([(want - seen).ravel(), (both - pairs).ravel()]) / max(len(doc), 1) + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return Field(w[: 2 * N_BINS].reshape(2, N_BINS), w[2 * N_BINS :].reshape(2, 2))


def mark_lines(bins: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Labels from afar: 1 for lines of good documents, and for those lines of bad ones that look no worse than good ones."""
    odds = np.zeros(N_BINS)
    n1, n0 = max(good.sum(), 1), max((~good).sum(), 1)
    of_good = np.bincount(bins[good].ravel(), minlength=N_BINS)
    of_bad = np.bincount(bins[~good].ravel(), minlength=N_BINS)
    odds = np.log((of_good + 0.5) / n1) - np.log((of_bad + 0.5) / n0)
    return (good | (odds[bins].sum(1) > 0)).astype(np.int64)


def _binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, off in chunks(b.column(2)):
            x = Lines(data, off, lower=False)
            bins = line_bins(x, _again(x))
            cut = np.split(bins.astype(np.int16), np.searchsorted(x.doc, np.arange(1, hi - lo)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array([c.tobytes() for c in cut], pa.binary())], ["id", "good", "bins"])


def fit_rules(docs: DataFrame, labels: DataFrame, trains: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", documents: int = DOCUMENTS, lines: int = LINES) -> Field:
    """The field of a bounded sample of labelled documents, by default from all labelled ones.

    A document is good if all its labels are 1; of rows that repeat an id, the
    least text counts. Null ids and labels are left out. Without labelled
    documents, every line counts as content. ``lines`` bounds what the driver
    holds; from the document on that would go over it, they are left out.
    """
    ship(docs.sparkSession)
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.lit(True) if trains is None else trains))
    marked = marked.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("good"))
    few = [marked.where(F.col("good") == y).orderBy(F.xxhash64("id"), "id").limit(documents) for y in (0, 1)]
    chosen = F.broadcast(few[0].union(few[1]))  # 2 * documents rows of two numbers
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    texts = texts.groupBy("id").agg(F.min("good").alias("good"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    so_far = F.sum(F.length(F.regexp_replace("text", "[^\n]", "")) + 1).over(Window.partitionBy("good").orderBy(F.xxhash64("id"), "id"))  # over 2 * documents rows
    texts = texts.withColumn("so_far", so_far).where(F.col("so_far") <= lines // 2).select("id", "good", "text")
    got = texts.mapInArrow(_binned, "id long, good int, bins binary").toPandas().sort_values("id", kind="stable")
    parts = [np.frombuffer(x, dtype=np.int16).reshape(-1, len(EDGES)).astype(np.int64) for x in got.bins]
    sizes = [len(p) for p in parts]
    bins = np.concatenate([np.zeros((0, len(EDGES)), np.int64), *parts])
    if not len(bins):
        return Field(np.array([[0.0], [1.0]]).repeat(N_BINS, 1), np.zeros((2, 2)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    good = np.repeat(got.good.to_numpy() == 1, sizes)
    return train_field(bins, mark_lines(bins, good), doc)


def apply_rules(docs: DataFrame, field: Field, text_col: str = "text", out_col: str = "rules") -> DataFrame:
    """``docs`` with the struct ``out_col``: counts of the fixed rules, lines, and words in lines marked as content.

    Words lie between ASCII white space. A null or empty text has none, and no
    lines; it fails the rules. Rows are judged one by one.
    """

    def run(text: pa.Array) -> Iterator[dict[str, pa.Array]]:
        for lo, hi, data, off in chunks(text):
            n = hi - lo
            x = Lines(data, off, lower=False)
            w, again = x.word, _again(x)
            starts = np.zeros(len(data) + 1, dtype=np.int64)  # of code points
            np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
            symbols = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum(_SYMBOLS[data], out=symbols[1:])
            label = field.decode(field.scores(line_bins(x, again)), x.doc, n) if len(x.doc) else np.zeros(0, np.int8)
            sums = lambda doc, v: pa.array(np.bincount(doc, weights=v, minlength=n).astype(np.int64))  # noqa: E731, B023
            yield {
                "n_words": pa.array(w.counts(), pa.int64()),
                "word_chars": sums(w.doc, starts[w.end] - starts[w.start]),
                "n_symbols": pa.array(symbols[off[1:]] - symbols[off[:-1]]),
                "n_dup_lines": sums(x.doc, again),
                "n_repeat_words": sums(w.doc, repeated_words(w)),
                "n_lines": pa.array(np.bincount(x.doc, minlength=n), pa.int64()),
                "content_words": sums(x.doc, x.words * (label == 1)),
            }

    return annotate(docs, run, FIELDS, out_col, text_col)


def base_failed(out_col: str = "rules") -> Column:
    return (F.col(f"{out_col}.n_words") < 20) | (100 * F.col(f"{out_col}.n_repeat_words") > 30 * F.col(f"{out_col}.n_words"))


def is_kept(out_col: str = "rules", content: float = CONTENT) -> Column:
    return ~base_failed(out_col) & (F.col(f"{out_col}.content_words") >= content * F.col(f"{out_col}.n_words"))
