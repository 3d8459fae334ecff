"""Quality classifier: positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows of label 1; unlabelled text is any text.
With a class prior p, the risk p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])
is unbiased as far as its second part isn't negative; where it is, the step
raises that part. l is the logistic loss, so that g is the log-odds of a
positive, and g adds up weights of style features that are cut into bins.

The prior is estimated from positives and unlabelled texts alone: of a scorer
that tells the two apart, it is the least share of unlabelled texts over a
threshold for one of positives over it, as no more than all that lies there
can be positive; less two standard errors, as too great a prior hides negatives.

All documents count. Their binned features are written once; each step of
Newton's method sums the gradient over all of them in Spark, and only the
curvature, which doesn't move the optimum, is that of a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .rows import annotate
from .style import NAMES, style_chunks

BINS = 10
#: Rows whose curvature shapes the steps, those of the least id hashes.
CURVATURE = 8_000
#: Significant digits of feature values among which bin edges are sought.
DIGITS = 3
#: Weight of the squared weights in the risk.
RIDGE = 3e-5
_CELLS = 1_000


@dataclass
class Model:
    edges: list[np.ndarray]
    weight: np.ndarray
    prior: float

    def columns(self, x: np.ndarray) -> np.ndarray:
        """The index of each value's bin among all weights."""
        first = np.cumsum([0, *(len(e) + 1 for e in self.edges)])
        return np.column_stack([np.searchsorted(e, x[:, i], side="right") + first[i] for i, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weight[self.columns(x)].sum(1) + self.weight[-1], -30, 30)))


def bin_edges(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Quantiles of all values (ascending, with counts), and of those over the median, where most features are 0 but for junk."""

    def quantiles(v: np.ndarray, k: np.ndarray, q: list[float]) -> np.ndarray:
        return v[np.searchsorted(np.cumsum(k), np.array(q) * k.sum()).clip(0, len(v) - 1)]

    median = quantiles(value, n, [0.5])[0]
    over = value > median
    rare = [np.nextafter(median, np.inf), *quantiles(value[over], n[over], [0.25, 0.5, 0.75, 0.9])] if over.any() else []
    return np.unique([*quantiles(value, n, list(np.linspace(0.02, 0.98, BINS))), *rare])


@dataclass
class Sums:
    """Over unlabelled texts (u) and positives (p): rows, sums of l(-g), of its gradient and of the features."""

    n_u: float
    n_p: float
    loss_u: float
    loss_p: float
    grad_u: np.ndarray
    grad_p: np.ndarray
    x_p: np.ndarray

    @classmethod
    def of(cls, v: np.ndarray) -> Sums:
        n = (len(v) - 4) // 3
        return cls(*v[:4], v[4 : 4 + n], v[4 + n : 4 + 2 * n], v[4 + 2 * n :])

    def negative(self, prior: float) -> float:
        """The part of the risk that must not be negative."""
        return self.loss_u / self.n_u - prior * self.loss_p / self.n_p


def sums(columns: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The numbers of Sums for a block of rows; every row is an unlabelled one, positives too."""
    n = len(weight)
    g = weight[columns].sum(1) + weight[-1]
    s, loss = 1 / (1 + np.exp(-np.clip(g, -500, 500))), np.logaddexp(0, g)

    def add(v: np.ndarray, rows: slice | np.ndarray) -> np.ndarray:
        out = np.bincount(columns[rows].ravel(), weights=np.repeat(v[rows], columns.shape[1]), minlength=n)
        out[-1] = v[rows].sum()
        return out

    at = np.flatnonzero(positive)
    return np.concatenate([[len(g), len(at), loss.sum(), loss[at].sum()], add(s, slice(None)), add(s, at), add(np.ones(len(g)), at)])


def descend(at, n_weights: int, sample: np.ndarray, step, most: int = 16, ridge: float = RIDGE) -> np.ndarray:
    """Newton's method from zero: ``at`` gives the Sums of weights, ``step`` their gradient and the scale of its curvature, which is taken from the sample."""
    w = np.zeros(n_weights)
    one_hot = np.zeros((len(sample), n_weights), dtype=np.float32)
    np.put_along_axis(one_hot, sample, 1, 1)
    one_hot[:, -1] = 1
    for i in range(most):
        g = one_hot @ w.astype(np.float32)
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        grad, scale = step(at(w))
        curve = one_hot.T @ (one_hot * np.maximum(s * (1 - s), 0.02)[:, None]) * (scale / max(len(sample), 1))
        move = np.linalg.solve(curve + ridge * np.eye(n_weights), grad + ridge * w)
        move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-12)) / (1 + i / 4)
        w = w - move
        if np.abs(move).max() < 0.01:
            break
    return w


def least_share(of_u: np.ndarray, of_p: np.ndarray, delta: float = 0.1) -> float:
    """The prior from counts of unlabelled texts and positives by score, ascending: the least ratio of their shares over a threshold, with both shares at the far end of their confidence."""
    n_u, n_p = max(of_u.sum(), 1), max(of_p.sum(), 1)
    u, p = np.cumsum(of_u[::-1]) / n_u, np.cumsum(of_p[::-1]) / n_p
    room = np.sqrt(np.log(4 / delta) / 2 / n_u) + np.sqrt(np.log(4 / delta) / 2 / n_p)
    ok = p > max(10 / n_p, room)
    if not ok.any():
        return 0.5
    best = np.argmin((u + room)[ok] / p[ok])
    u, p = u[ok][best], p[ok][best]
    error = np.sqrt(u * (1 - u) / n_u + (u / p) ** 2 * p * (1 - p) / n_p) / p
    return float(np.clip(u / p - 2 * error, 0.02, 0.98))


def narrow(x: np.ndarray) -> np.ndarray:
    """Styles in the width in which they are written; fitting and scoring both bin them in it."""
    return x.astype(np.float32)


def _styles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = 0
        for x in style_chunks(b.column(1)):
            x = narrow(x)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(x)), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "style"])
            done += len(x)


def _read(col: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=kind).reshape(len(col), -1)


def _rounded(x: np.ndarray) -> np.ndarray:
    """To DIGITS significant digits."""
    size = 10.0 ** (np.floor(np.log10(np.maximum(np.abs(x), 1e-6))) - DIGITS + 1)
    return np.round(np.round(x / size) * size, 9)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, value, n): rounded values, counted."""
    for b in batches:
        x = _rounded(_read(b.column(0), np.float32).astype(float))
        for i in range(x.shape[1]) if len(x) else ():
            v, n = np.unique(x[:, i], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, dtype=np.int32)), pa.array(v), pa.array(n, pa.int64())], ["feature", "value", "n"])


def _columns(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = model.columns(_read(b.column(1), np.float32).astype(float)).astype(np.int16)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in c], pa.binary()), b.column(2)], ["id", "bins", "positive"])

    return run


def _added(weight: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 + 3 * len(weight))
        for b in batches:
            if b.num_rows:
                total += sums(_read(b.column(0), np.int16).astype(np.int64), b.column(1).to_numpy(zero_copy_only=False), weight)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "v"])

    return run


def _scored(weight: np.ndarray):
    """(cell, u, p): rows and positives by score, in _CELLS steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, p = np.zeros(_CELLS, dtype=np.int64), np.zeros(_CELLS, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                g = weight[_read(b.column(0), np.int16).astype(np.int64)].sum(1) + weight[-1]
                cell = np.minimum((_CELLS / (1 + np.exp(-np.clip(g, -30, 30)))).astype(np.int64), _CELLS - 1)
                u += np.bincount(cell, minlength=_CELLS)
                p += np.bincount(cell[b.column(1).to_numpy(zero_copy_only=False)], minlength=_CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_CELLS, dtype=np.int32)), pa.array(u), pa.array(p)], ["cell", "u", "p"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of rows for which ``trains`` (of the id) holds.

    A document is a trusted positive if all its labels are 1; each of its rows
    counts. Labels of 0 are never used. Null ids and labels are left out.
    Without positives, all texts count as good.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    marked = labels.where(trains & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    good = marked.where("label = 1").select("id", F.lit(True).alias("positive"))
    texts = docs.where(trains & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    styles = scratch.save(texts.mapInArrow(_styles, f"id {kind}, style binary"), "styles")
    seen = styles.select("style").mapInArrow(_values, "feature int, value double, n long").groupBy("feature", "value").agg(F.sum("n").alias("n")).toPandas().sort_values(["feature", "value"])
    none = Model([np.zeros(0)] * len(NAMES), np.append(np.zeros(len(NAMES)), 2.0), 1.0)
    if not len(seen):
        return none
    model = Model([bin_edges(x.value.to_numpy(), x.n.to_numpy()) for _, x in seen.groupby("feature")], np.zeros(0), 1.0)
    n = sum(len(e) + 1 for e in model.edges) + 1
    binned = styles.join(good, "id", "left").select("id", "style", F.coalesce("positive", F.lit(False)).alias("positive"))
    binned = scratch.save(binned.mapInArrow(_columns(model), f"id {kind}, bins binary, positive boolean"), "binned")
    scratch.drop(styles)

    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2))

    def at(w: np.ndarray, rows: DataFrame = binned) -> Sums:
        got = rows.select("bins", "positive").mapInArrow(_added(w), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")
        return Sums.of(got.v.to_numpy())

    if not at(np.zeros(n)).n_p:
        return none
    sample = binned.orderBy(F.xxhash64("id"), "id", "bins").limit(CURVATURE).select("bins").toArrow()["bins"]
    sample = np.frombuffer(b"".join(sample.to_pylist()), dtype=np.int16).reshape(-1, len(NAMES)).astype(np.int64)

    # a scorer that tells positives from unlabelled texts, fitted on one half of the documents and judged by the other, for the prior
    fitted = binned.where(half == 0) if at(np.zeros(n), binned.where(half == 0)).n_p else binned
    apart = descend(lambda w: at(w, fitted), n, sample, lambda s: (s.grad_u / s.n_u + (s.grad_p - s.x_p) / s.n_p, 2.0), most=5)
    judged = binned if fitted is binned else binned.where(half == 1)
    of = judged.select("bins", "positive").mapInArrow(_scored(apart), "cell int, u long, p long").groupBy("cell").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).toPandas().sort_values("cell")
    model.prior = least_share(of.u.to_numpy(), of.p.to_numpy())

    def risk(s: Sums) -> tuple[np.ndarray, float]:
        """The gradient of the risk, or where its second part is negative the one that raises that part."""
        prior = model.prior
        if s.negative(prior) < 0:
            return prior * s.grad_p / s.n_p - s.grad_u / s.n_u, 1.0
        return s.grad_u / s.n_u - prior * s.x_p / s.n_p, 1.0

    model.weight = descend(at, n, sample, risk)
    scratch.drop(binned)
    return model


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """``docs`` with the struct ``out_col``: score, the probability that a text is good. A null text is an empty one."""

    def run(text: pa.Array) -> Iterator[dict[str, pa.Array]]:
        for x in style_chunks(text):
            yield {"score": pa.array(model.score(narrow(x).astype(float)))}

    return annotate(docs, run, "score double", out_col, text_col)


def crc_mod(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % n
