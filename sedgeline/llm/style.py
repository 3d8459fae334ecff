"""Numbers that describe the style of whole texts, in numpy for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .text import CHUNK_ROWS, SPACED, chunks, combine, words

#: Classes of bytes: lower case, upper case, digit, space, newline, plain marks, pipe, symbols, ! and ?, other ASCII, non-ASCII.
LOW, UP, DIGIT, SPACE, NEWLINE, MARK, PIPE, SYMBOL, BANG, OTHER, WIDE = range(11)
_CLASS = np.full(256, OTHER, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = LOW, UP, DIGIT, WIDE
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], _CLASS[0x0A], _CLASS[0x7C] = SPACE, NEWLINE, PIPE
_CLASS[list(b".,;:'\"-()")], _CLASS[list(b"#*$%&<>")], _CLASS[list(b"!?")] = MARK, SYMBOL, BANG
N_CLASSES = 11

NAMES = (
    "log_words", "word_length", "upper", "digits", "pipes", "symbols", "bangs", "others", "wide", "lines", "marks",
    "repeated_windows", "repeated_lines", "repeated_next", "distinct_words", "few_words", "worst_upper", "worst_pipes", "worst_symbols",
    "worst_bangs", "worst_next", "in_upper", "in_pipes", "in_symbols", "in_bangs", "in_next",
)


class Lines:
    """Lines of a chunk of texts: row, byte range, words, bytes by class, hash of the line's words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = True):
        w = words(data, off, SPACED, lower)
        self.data = data
        n_docs = len(off) - 1
        new = np.zeros(len(data) + 1, dtype=bool)
        new[1:][data == 0x0A] = True
        new[off] = True
        start = np.flatnonzero(new[: len(data)])
        self.start, self.end = start, np.append(start[1:], len(data))
        self.doc = np.searchsorted(off, start, side="right") - 1
        kinds = np.repeat(np.arange(len(start)) * N_CLASSES, self.end - start)
        kinds += _CLASS[data]
        self.kinds = np.bincount(kinds, minlength=len(start) * N_CLASSES).reshape(-1, N_CLASSES)
        of = np.searchsorted(start, w.start, side="right") - 1
        self.words = np.bincount(of, minlength=len(start))
        self.first_word = np.searchsorted(of, np.arange(len(start)))
        self.word, self.n_docs, self.of = w, n_docs, of

    def by_doc(self, values: np.ndarray, how=np.add) -> np.ndarray:
        """Values of lines put together for each row; 0 for a row without lines."""
        out = np.zeros((self.n_docs, *values.shape[1:]), dtype=values.dtype)
        if len(self.doc):
            first = np.flatnonzero(np.r_[True, self.doc[1:] != self.doc[:-1]])
            out[self.doc[first]] = how.reduceat(values, first)
        return out


def repeated_words(w, n: int = 8) -> np.ndarray:
    """Marks the words in n-word windows that their row holds twice or more."""
    h = combine(w.hash, n)
    at = np.flatnonzero(w.doc[: len(h)] == w.doc[n - 1 :]) if len(h) else np.zeros(0, np.int64)
    order = at[np.argsort(h[at])]
    order = order[np.argsort(w.doc[order].astype(np.uint16), kind="stable")]
    same = (h[order][1:] == h[order][:-1]) & (w.doc[order][1:] == w.doc[order][:-1])
    twice = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
    change = np.zeros(len(w.doc) + 1, dtype=np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + n, -1)
    return np.cumsum(change[:-1]) > 0


def style(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text; a text without words has zeros but for few_words."""
    x = Lines(data, off)
    w, n_docs = x.word, x.n_docs
    kinds = x.by_doc(x.kinds).astype(float)
    n = w.counts()
    some = np.maximum(n, 1).astype(float)
    chars = np.bincount(w.doc, weights=(w.end - w.start), minlength=n_docs)
    letters = np.maximum(kinds[:, LOW] + kinds[:, UP], 1)

    order = np.lexsort((w.hash, w.doc))
    fresh = np.r_[True, (w.hash[order][1:] != w.hash[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])] if len(order) else np.zeros(0, bool)
    distinct = np.bincount(w.doc[order][fresh], minlength=n_docs)

    line_hash = np.zeros(len(x.start), dtype=np.uint64)
    np.add.at(line_hash, x.of, w.hash * (np.arange(len(w.hash)) - x.first_word[x.of] + 1).astype(np.uint64))
    lorder = np.lexsort((line_hash, x.doc))
    again = np.r_[False, (line_hash[lorder][1:] == line_hash[lorder][:-1]) & (x.doc[lorder][1:] == x.doc[lorder][:-1])] if len(lorder) else np.zeros(0, bool)
    dup = np.zeros(len(x.start), dtype=bool)
    dup[lorder[again]] = True

    lw = np.maximum(x.words, 1).astype(float)
    ll = np.maximum(x.kinds[:, LOW] + x.kinds[:, UP], 1)
    next_same = np.bincount(x.of[1:], weights=(w.hash[1:] == w.hash[:-1]) & (x.of[1:] == x.of[:-1]), minlength=len(x.start))
    rates = np.stack([x.kinds[:, UP] / ll, x.kinds[:, PIPE] / lw, x.kinds[:, SYMBOL] / lw, x.kinds[:, BANG] / lw, next_same / lw], 1)
    rates[x.words < 3] = 0
    worst = x.by_doc(rates, np.maximum)
    inside = x.by_doc((rates > np.array([0.6, 0.25, 0.25, 0.25, 0.25])) * x.words[:, None].astype(float)) / some[:, None]
    few = x.by_doc(((x.words > 0) & (x.words < 5)) * x.words) / some
    cols = [
        np.log1p(n), chars / some, kinds[:, UP] / letters, kinds[:, DIGIT] / some, kinds[:, PIPE] / some,
        kinds[:, SYMBOL] / some, kinds[:, BANG] / some, kinds[:, OTHER] / some, kinds[:, WIDE] / np.maximum(chars, 1),
        x.by_doc((x.words > 0).astype(float)) / some, kinds[:, MARK] / some,
        np.bincount(w.doc, weights=repeated_words(w), minlength=n_docs) / some, x.by_doc(dup * x.words) / some,
        np.bincount(w.doc[1:], weights=(w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]), minlength=n_docs) / some, distinct / some, few,
    ]
    return np.column_stack([*cols, worst, inside])


def style_chunks(text: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, off in chunks(text):
        yield style(data, off)


assert CHUNK_ROWS < 1 << 16  # rows of a chunk are sorted as 16-bit numbers
