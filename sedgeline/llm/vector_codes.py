"""Product codes of vectors: each part of a vector becomes the number of its nearest codebook entry.

Vectors are turned into integers first, so that every distance, tie and mean is
exact and no result depends on how rows are dealt to tasks. Codebooks are
fitted by a fixed number of rounds; a round is one pass over all vectors in
which each task adds up the parts of each entry and Spark adds up the tasks.
The driver holds the codebooks only: parts x entries integers vectors.

The nearest entry is found in a vantage-point tree over the entries of a part
position. A subtree keeps the least and the greatest distance of its entries
from the vantage point, rounded outwards to integers. It is visited unless the
triangle inequality excludes it, and also when its bound equals the best
distance found, since an entry of a lower index may lie at that distance. The
distances that decide are integers.

Defined results:

* Rows whose vector is null, or holds null or non-finite components, are
  dropped, and so are rows whose length isn't the most frequent one (the
  greater of two equally frequent ones). Without rows left the result is empty.
* Part p of a vector of d components goes from floor(p*d/parts) to
  floor((p+1)*d/parts); parts are equal where ``parts`` divides d. A part
  without components has index 0 and error 0.
* The first codebooks are the rows of least id, null ids last, rows of one id in
  the order of their components; fewer rows than entries give smaller books.
* Components are held within +-2^27 (for 64 components; see ``bound``) so
  that errors fit a long; |x| up to 131,072 isn't changed by this.
* Repeated rows count as often as they stand there. All other columns pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .rows import annotate, free

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LEAF = 24
#: So many components are worked on at once.
CELLS = 1 << 19


def bound(dim: int) -> int:
    """Components lie within +-bound, so that a squared distance of whole vectors is under 2^62."""
    return 1 << ((62 - math.ceil(math.log2(max(dim, 1)))) // 2 - 1)


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of rows of components, within the bound."""
    most = bound(x.shape[1])
    return np.clip(np.floor(x.astype(np.float64) * scale), -most, most).astype(np.int64)


def squared(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of q to all rows of e."""
    most = max(int(np.abs(q).max(initial=0)), int(np.abs(e).max(initial=0)))
    if 4 * q.shape[1] * most * most < 1 << 53:  # every sum is an integer that a double holds
        x, y = q.astype(np.float64), e.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    out = np.zeros((len(q), len(e)), dtype=np.int64)
    for i in range(q.shape[1]):
        d = q[:, i, None] - e[:, i]
        out += d * d
    return out


def root_down(d: np.ndarray) -> np.ndarray:
    """Greatest integers whose squares aren't over d."""
    r = np.sqrt(d.astype(np.float64)).astype(np.int64)
    r -= r * r > d
    r += (r + 1) * (r + 1) <= d
    return r


def root_up(d: np.ndarray) -> np.ndarray:
    """Least integers whose squares aren't under d."""
    r = root_down(d)
    return r + (r * r < d)


@dataclass
class Node:
    """A leaf's entries, or a vantage point with the range of distances of its near and far half."""

    entries: np.ndarray
    vantage: int = -1
    half: int = 0
    sides: tuple = ()


class VantageTree:
    """Nearest rows of one codebook part; of rows at one distance, that of the lowest index."""

    def __init__(self, entries: np.ndarray):
        self.e = np.ascontiguousarray(entries, dtype=np.int64)
        self.root = self._build(np.arange(len(self.e)))

    def _build(self, at: np.ndarray) -> Node:
        if len(at) <= LEAF:
            return Node(at)
        # the entry farthest from the first one tells the others apart best
        vantage = int(at[np.argmax(squared(self.e[at[:1]], self.e[at])[0])])
        at = at[at != vantage]
        d = squared(self.e[[vantage]], self.e[at])[0]
        half = int(np.median(d))
        near = d <= half
        if near.all():
            return Node(np.sort(np.append(at, vantage)))
        sides = tuple((self._build(at[m]), int(root_down(d[m]).min()), int(root_up(d[m]).max())) for m in (near, ~near))
        return Node(np.array([vantage]), vantage, half, sides)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance for each row of q."""
        q = np.ascontiguousarray(q, dtype=np.int64)
        best, index = np.full(len(q), np.iinfo(np.int64).max), np.zeros(len(q), dtype=np.int64)
        self._visit(self.root, np.arange(len(q)), q, best, index)
        return index, best

    def _offer(self, entries: np.ndarray, rows: np.ndarray, q: np.ndarray, best: np.ndarray, index: np.ndarray) -> np.ndarray:
        d = squared(q[rows], self.e[entries])
        least = d.argmin(1)  # entries ascend, so the first is that of the lowest index
        found, own = d[np.arange(len(rows)), least], entries[least]
        better = (found < best[rows]) | ((found == best[rows]) & (own < index[rows]))
        best[rows[better]], index[rows[better]] = found[better], own[better]
        return d

    def _visit(self, node: Node, rows: np.ndarray, q: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(rows) or not len(node.entries):
            return
        d = self._offer(node.entries, rows, q, best, index)
        if node.vantage < 0:
            return
        d = d[:, 0]
        low, high, near = root_down(d), root_up(d), d <= node.half
        for first, second in ((0, 1), (1, 0)):
            mine = near if first == 0 else ~near
            self._visit(node.sides[first][0], rows[mine], q, best, index)
            child, least, most = node.sides[second]
            reach = root_up(best[rows[mine]])
            open_ = (low[mine] - reach <= most) & (high[mine] + reach >= least)
            self._visit(child, rows[mine][open_], q, best, index)


@dataclass
class Codebooks:
    """Entries by part: entries x components of the part."""

    dim: int
    scale: int
    parts: list[np.ndarray]

    def edges(self) -> list[int]:
        return [p * self.dim // len(self.parts) for p in range(len(self.parts) + 1)]

    def text(self) -> str:
        """All entries' components by part, entry and position, comma-joined."""
        return ",".join(str(x) for p in self.parts for x in p.ravel().tolist())


def kept(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite."""
    x = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(x, F.lit(False))


def _rows(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def _assigned(x: np.ndarray, edges: list[int], trees: list[VantageTree]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and squared distances of rows by part, some rows at a time."""
    index, error = np.zeros((len(x), len(trees)), np.int64), np.zeros((len(x), len(trees)), np.int64)
    step = max(CELLS // max(x.shape[1], 1), 1)
    for lo in range(0, len(x), step):
        for p, tree in enumerate(trees):
            index[lo : lo + step, p], error[lo : lo + step, p] = tree.nearest(x[lo : lo + step, edges[p] : edges[p + 1]])
    return index, error


def usable(vectors: DataFrame, vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """The rows that are coded, and their number of components."""
    v = F.col(f"`{vector_col}`")
    good = vectors.where(kept(v))
    found = good.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = found.d if found else 0
    return good.where(F.size(v) == dim), dim


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks after ``rounds`` rounds over all usable rows."""
    ship(vectors.sparkSession)
    good, dim = usable(vectors, vector_col)
    rows = good.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    # so many rows of a fixed number of components: the start of the books
    start = rows.orderBy(F.col("id").asc_nulls_last(), F.transform("v", lambda x: F.floor(x * scale))).limit(entries).collect()
    x = integers(np.array([r.v for r in start], dtype=np.float64).reshape(len(start), dim), scale)
    books = Codebooks(dim, scale, [])
    books.parts = [x[:, p * dim // parts : (p + 1) * dim // parts] for p in range(parts)]
    for _ in range(rounds if len(start) else 0):
        books.parts = _round(rows.select("v"), books)
    return books


def _round(rows: DataFrame, books: Codebooks) -> list[np.ndarray]:
    """Each entry replaced by the floored mean of the parts that are nearest to it; one without parts stays."""
    edges, dim, scale, parts = books.edges(), books.dim, books.scale, books.parts
    widest = max(edges[p + 1] - edges[p] for p in range(len(parts)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(p) for p in parts]
        size = len(parts[0])
        # by part and entry: how many, and their sums
        total = np.zeros((len(parts) * size, widest + 1), dtype=np.int64)
        for b in batches:
            x = integers(_rows(b.column(0), dim), scale)
            index, _ = _assigned(x, edges, trees)
            for p in range(len(parts)):
                order = np.argsort(index[:, p], kind="stable")
                own, first = np.unique(index[order, p], return_index=True)
                if len(own):
                    total[p * size + own, 0] += np.diff(np.append(first, len(order)))
                    total[p * size + own, 1 : 1 + edges[p + 1] - edges[p]] += np.add.reduceat(x[order, edges[p] : edges[p + 1]], first, axis=0)
        own = np.flatnonzero(total[:, 0])
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * (widest + 1)), pa.array(total[own].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(own), flat], ["slot", "s"])

    got = rows.mapInArrow(sums, "slot long, s array<long>").groupBy("slot").agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(widest + 1)))
    out = [p.copy() for p in parts]
    size = len(parts[0])
    for r in got.collect():  # a row for each entry in use
        p, e = divmod(r[0], size)
        out[p][e] = np.array(r[2 : 2 + edges[p + 1] - edges[p]], dtype=np.int64) // r[1]
    return out


def encode(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding", out_col: str = "vector_code") -> DataFrame:
    """The usable rows with the struct ``out_col``: indexes by part, code (two or more hex digits each, in part order) and error (squared distances summed)."""
    edges, dim, scale, parts = books.edges(), books.dim, books.scale, books.parts
    v = F.col(f"`{vector_col}`")
    own = free(vectors, "_vector")
    good = vectors.where(kept(v) & (F.size(v) == dim)).withColumn(own, v.cast("array<double>"))
    digits = max(2, len(f"{max(len(parts[0]) - 1, 0):x}")) if parts else 2
    trees: list[VantageTree] = []

    def run(vector: pa.Array) -> Iterator[dict[str, pa.Array]]:
        if not trees:  # once for each task
            trees.extend(VantageTree(p) for p in parts)
        step = max(CELLS // max(dim, 1), 1)
        for lo in range(0, len(vector), step):
            x = integers(_rows(vector.slice(lo, step), dim), scale)
            index, error = _assigned(x, edges, trees)
            text = pc.binary_join_element_wise(*(pa.array([f"{i:0{digits}x}" for i in range(max(len(parts[0]), 1))]).take(pa.array(index[:, p])) for p in range(len(parts))), "")
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(parts)), pa.array(index.astype(np.int32).ravel()))
            yield {"indexes": flat, "code": text, "error": pa.array(error.sum(1))}

    out = annotate(good, run, "indexes array<int>, code string, error long", out_col, own)
    return out.drop(own)


def decode(coded: DataFrame, books: Codebooks, code_col: str = "vector_code", out_col: str = "vector") -> DataFrame:
    """``coded`` with the integer vectors that the codes stand for, put together from the entries by Spark's own functions."""
    tables = [F.from_json(F.lit(str(p.tolist())), "array<array<long>>") for p in books.parts]
    chosen = [F.element_at(t, F.col(code_col)["indexes"][p] + 1) for p, t in enumerate(tables)]
    return coded.withColumn(out_col, F.concat(*chosen))


def label_errors(coded: DataFrame, label_col: str = "label", error_col: str = "error") -> DataFrame:
    """``coded`` with label_error: the errors summed over equal labels, nulls together (null where a long can't hold it).

    The sums are combined before the shuffle, and joined back by a join that
    adaptive execution broadcasts by measured size or splits where a label is hot.
    """
    coded = coded.drop("label_error")
    label, key = F.col(f"`{label_col}`"), free(coded, "_label")
    sums = coded.groupBy(label.alias(key)).agg(F.try_sum(error_col).alias("label_error"))
    return coded.join(sums, label.eqNullSafe(F.col(key))).drop(key)
