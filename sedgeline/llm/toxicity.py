"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the beginnings of words, all of them on both sides. The examples
are a bounded sample of labelled rows, and the index holds every term of
theirs; document frequencies are counted over all terms of all documents, so
that a query's norm takes in also what no example has. The driver and the
tasks hold the frequencies of the examples' terms and of the most frequent
others; the rest of a norm comes from a join by shuffle. A query visits blocks
of examples in the order of the greatest cosine that any example of the block
can have, and leaves out those that can't reach the k-th best found. Votes are
weighted by distance and by how far each class was sampled, and calibrated on
the examples themselves, each with its own vote left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .rows import annotate
from ..scratch import Scratch
from .text import ALNUM, LOWER, chunks, prefix, runs, span_hash

#: Examples of each class at most (those of the least id hashes), and nearest examples that vote.
EXAMPLES, NEAREST = 3_000, 15
BLOCK = 64
#: A term that so large a share of the examples has is a row of their weights beside its postings.
DENSE = 0.1
#: Terms outside the examples that are broadcast, the most frequent ones; the others are joined by shuffle.
FREQUENT = 1 << 18
#: Bytes of a word that make its terms.
STEMS = (4, 6)
FIELDS = "score double, neighbours array<struct<id:long,toxic:int,cosine:double>>"


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term hash, times in the row), by row: the first 4 bytes of a word in lower case, and the first 6 of a longer one."""
    data = LOWER[data]
    doc, start, end = runs(data, off, ALNUM)
    sums = prefix(data)
    longer = np.flatnonzero(end - start > STEMS[0])
    h = np.concatenate([span_hash(data, start[at], np.minimum(end[at], start[at] + n), sums) for n, at in zip(STEMS, (slice(None), longer), strict=True)])
    doc = np.concatenate([doc, doc[longer]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, np.int64)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def find(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in a sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start..end, one range after the other."""
    n = end - start
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps (x, value) that fit y best, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([x[i], x[i], y[i] * weight[i], weight[i]])
        while len(pools) > 1 and (pools[-2][1] == pools[-1][0] or pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]):
            _, hi, s, w = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + s, pools[-1][3] + w]
    p = np.array([[lo, hi, s / w] for lo, hi, s, w in pools])
    return p[:, :2].ravel(), np.repeat(p[:, 2], 2)


@dataclass
class Index:
    """Postings of unit vectors by term and block, with each block's greatest weight."""

    known: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    rows: np.ndarray
    v: np.ndarray
    #: by term the range of its cells; by cell its block, greatest weight and range of postings
    cells: np.ndarray
    block: np.ndarray
    most: np.ndarray
    edge: np.ndarray
    plain: float = 0.05
    steps: tuple = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    #: frequent terms that no example has, and the written frequencies (term, n) of those left, if any
    other: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    other_idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    n_docs: int = 0
    rare: DataFrame | None = None
    #: by term its row in ``full``, or -1
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    full: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @staticmethod
    def vector(idf: np.ndarray, t: np.ndarray, tf: np.ndarray, outside: float = 0.0) -> np.ndarray:
        """Weights of the terms t of a unit vector; outside: the sum of squares of what it has besides them."""
        v = (1 + np.log(tf)) * idf[t]
        return v / np.sqrt((v**2).sum() + outside)

    @classmethod
    def build(cls, known, idf, ids, toxic, weight, rows, t, tf) -> Index:
        """rows, t, tf: sparse counts of the examples, by row."""
        v = (1 + np.log(np.maximum(tf, 1))) * idf[t]
        norm = np.sqrt(np.bincount(rows, weights=v**2, minlength=len(ids)))
        v = v / np.maximum(norm[rows], 1e-12)
        order = np.lexsort((rows, t))
        rows, t, v = rows[order], t[order], v[order]
        cut = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (rows[1:] // BLOCK != rows[:-1] // BLOCK)]) if len(t) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(v, cut) if len(cut) else np.zeros(0)
        out = cls(known, idf, ids, toxic, weight, rows, v, np.searchsorted(t[cut], np.arange(len(known) + 1)), rows[cut] // BLOCK, most, np.append(cut, len(t)))
        common = np.flatnonzero(np.bincount(t, minlength=len(known)) >= max(DENSE * len(ids), 1))
        out.place, out.full = np.full(len(known), -1), np.zeros((len(common), len(ids)))
        out.place[common] = np.arange(len(common))
        at = np.flatnonzero(out.place[t] >= 0)
        out.full[out.place[t[at]], rows[at]] = v[at]
        return out

    def common(self, row: np.ndarray, t: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
        """For each of n queries (row, t, q) the part of all cosines that terms of ``full`` make."""
        at = np.flatnonzero(self.place[t] >= 0)
        wanted = np.zeros((n, len(self.full)))
        wanted[row[at], self.place[t[at]]] = q[at]
        return wanted @ self.full

    def nearest(self, t: np.ndarray, q: np.ndarray, k: int, without: int = -1, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the greatest cosine above 0, exactly, and their cosines; fewer if fewer share a term. base: the query's row of ``common``."""
        if base is None:
            base = self.common(np.zeros(len(t), dtype=np.int64), t, q, 1)[0]
        few = self.place[t] < 0
        t, q = t[few], q[few]
        cell = spans(self.cells[t], self.cells[t + 1])
        own = np.repeat(q, self.cells[t + 1] - self.cells[t])
        n_blocks = max(1, -(-len(self.ids) // BLOCK))
        block = self.block[cell]
        bound = np.bincount(block, weights=own * self.most[cell], minlength=n_blocks)
        if len(base):
            bound = bound + np.maximum.reduceat(base, np.arange(0, len(base), BLOCK))
        got_i, got_s = np.zeros(0, np.int64), np.zeros(0)

        def visit(blocks: np.ndarray) -> None:
            nonlocal got_i, got_s
            mark = np.zeros(n_blocks, dtype=bool)
            mark[blocks] = True
            at = mark[block]
            x, y = self.edge[cell[at]], self.edge[cell[at] + 1]
            post = spans(x, y)
            s = np.bincount(self.rows[post], weights=np.repeat(own[at], y - x) * self.v[post], minlength=len(self.ids)) + base
            s[~np.repeat(mark, BLOCK)[: len(s)]] = 0
            rows = np.flatnonzero(s > (got_s[-1] - 1e-12 if len(got_s) >= k else 0))
            rows = rows[rows != without]
            got_i, got_s = np.concatenate([got_i, rows]), np.concatenate([got_s, s[rows]])
            top = np.lexsort((got_i, -got_s))[:k]
            got_i, got_s = got_i[top], got_s[top]

        # the blocks of the greatest bounds first; their k-th best rules others out
        order = np.argsort(-bound, kind="stable")
        visit(order[:2])
        least = got_s[-1] if len(got_s) >= k else 0.0
        left = order[2:][bound[order[2:]] > max(least - 1e-12, 0)]
        if len(left):
            visit(left)
        return got_i, np.minimum(got_s, 1.0)

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        w = self.weight[near] / (0.05 + 1 - cosine) ** 4
        return float((w * self.toxic[near]).sum() / w.sum())

    def score(self, vote: float) -> float:
        return float(np.clip(np.interp(vote, *self.steps), 0.001, 0.999))

    def calibrate(self, rows: np.ndarray, t: np.ndarray, tf: np.ndarray, k: int) -> None:
        edge = np.searchsorted(rows, np.arange(len(self.ids) + 1))
        bare = np.diff(edge) == 0
        votes, of = [], []
        for lo in range(0, len(bare), BLOCK):
            x, y = edge[lo], edge[min(lo + BLOCK, len(bare))]
            length = np.sqrt(np.bincount(rows[x:y] - lo, weights=((1 + np.log(tf[x:y])) * self.idf[t[x:y]]) ** 2, minlength=BLOCK))
            q = (1 + np.log(tf[x:y])) * self.idf[t[x:y]] / length[rows[x:y] - lo]
            base = self.common(rows[x:y] - lo, t[x:y], q, BLOCK)
            for i in lo + np.flatnonzero(~bare[lo : lo + BLOCK]):
                own = slice(edge[i] - x, edge[i + 1] - x)
                near, cosine = self.nearest(t[x:y][own], q[own], k, without=i, base=base[i - lo])
                if len(near):
                    votes.append(self.vote(near, cosine))
                    of.append(i)
        if votes:
            self.steps = isotonic(np.array(votes), self.toxic[of].astype(float), self.weight[of])
        w = self.weight[bare]
        self.plain = float(((w * self.toxic[bare]).sum() + 0.1) / (w.sum() + 2))


def _pairs(*without: np.ndarray):
    """(two columns as they are, term, tf) of the texts in the third column, without the terms of the sorted tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, off in chunks(b.column(2)):
                doc, h, tf = terms(data, off)
                for table in without:
                    new = find(table, h) < 0
                    doc, h, tf = doc[new], h[new], tf[new]
                take = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(h.view(np.int64)), pa.array(tf, pa.int64())], [*b.schema.names[:2], "term", "tf"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents that have it), partly added up; the number of documents under null."""

    def out(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["term", "n"])

    h, n, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for b in batches:
        for lo, hi, data, off in chunks(b.column(0)):
            new, times = np.unique(terms(data, off)[1], return_counts=True)
            both = np.concatenate([h, new])
            h, place = np.unique(both, return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([n, times]), minlength=len(h)).astype(np.int64)
            rows += hi - lo
            if len(h) > 1 << 20:
                yield out(h, n)
                h, n = h[:0], n[:0]
    yield out(h, n)
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([rows], pa.int64())], ["term", "n"])


def _idf(n_docs: int, n: np.ndarray) -> np.ndarray:
    return 1 + np.log((1 + n_docs) / (1 + n))


def fit_toxicity(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES, k: int = NEAREST, frequent: int = FREQUENT) -> Index:
    """The index over labelled rows for which ``trains`` (of the id) holds.

    A document is toxic if any of its labels is 1; null ids and labels are left
    out. The driver holds the bounded sample's terms and the ``frequent`` most
    frequent others. Without examples of both classes the vocabulary is empty,
    and every text has the same score.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    marked = labels.where(trains & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    marked = scratch.save(marked.where("toxic IN (0, 1)"), "marked")
    total = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    few = [marked.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(examples) for y in (0, 1)]
    chosen = F.broadcast(few[0].union(few[1]))  # 2 * examples rows of two numbers
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sample = scratch.save(texts.join(chosen, "id").select("id", "toxic", "text"), "sample")
    n = {y: 0 for y in (0, 1)} | {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    none = Index.build(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), *[np.zeros(0, np.int64)] * 3)
    if not n[0] or not n[1]:
        none.plain = 0.5 if not n[0] and not n[1] else float(n[1] > 0)
        return none

    got = sample.mapInArrow(_pairs(), "id long, toxic int, term long, tf long").toArrow().to_pandas().drop_duplicates(["id", "term"])
    hashes = got.term.to_numpy().view(np.uint64)
    known = np.unique(hashes)
    counted = scratch.save(texts.select("text").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "counted")
    n_docs = counted.where("term IS NULL").first().n
    counted = counted.where("term IS NOT NULL")
    listed = docs.sparkSession.createDataFrame(pa.table({"term": known.view(np.int64)}))

    def held(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and frequencies, sorted by hash."""
        t = df.select("term", "n").toArrow()
        h, n = t["term"].to_numpy().view(np.uint64), t["n"].to_numpy()
        order = np.argsort(h)
        return h[order], n[order]

    # an example's text may have none of the counted terms only where it has none at all
    of_known = dict(zip(*(x.tolist() for x in held(counted.join(F.broadcast(listed), "term", "left_semi"))), strict=True))
    idf = _idf(n_docs, np.array([of_known.get(h, 0) for h in known.tolist()], dtype=float))
    others = counted.join(F.broadcast(listed), "term", "left_anti")
    least, room, some_left = 1, frequent, False
    for r in sorted(others.groupBy("n").count().collect(), key=lambda r: -r.n):
        room -= r["count"]
        if room < 0:
            least, some_left = r.n + 1, True
            break
    other, n_other = held(others.where(F.col("n") >= least))
    got = got.assign(term=np.searchsorted(known, hashes))

    all_rows = sample.select("id", "toxic").toPandas().sort_values(["id", "toxic"], kind="stable").drop_duplicates("id")
    # examples that share their rarest term stand together, so that blocks differ
    lead = got.sort_values(["id", "tf", "term"]).groupby("id").term.first() if len(got) else got.term
    all_rows = all_rows.assign(lead=all_rows.id.map(lead).fillna(-1)).sort_values(["lead", "id"], kind="stable")
    ids, toxic = all_rows.id.to_numpy(), all_rows.toxic.to_numpy().astype(np.int64)
    place = {d: i for i, d in enumerate(ids.tolist())}
    rows = np.array([place[d] for d in got.id.tolist()], dtype=np.int64)
    t, tf = got.term.to_numpy().astype(np.int64), got.tf.to_numpy().astype(float)
    order = np.lexsort((t, rows))
    rows, t, tf = rows[order], t[order], tf[order]
    weight = np.where(toxic == 1, total[1] / n[1], total[0] / n[0])
    index = Index.build(known, idf, ids, toxic, weight, rows, t, tf)
    index.other, index.other_idf, index.n_docs = other, _idf(n_docs, n_other), n_docs
    index.rare = others.where(F.col("n") < least) if some_left else None
    index.calibrate(rows, t, tf, k)
    return index


def score_toxicity(docs: DataFrame, index: Index, k: int = NEAREST, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with the struct ``out_col``: score (0 to 1) and the labelled neighbours that are its evidence.

    A text without any term of the examples, such as a null or empty one, has
    no neighbours; its score is the share of toxic ones among examples without terms.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(replace(index, rare=None))
    own = docs.columns
    if index.rare is None:
        docs = docs.withColumn("_outside", F.lit(0.0))
    else:
        # equal keys are equal texts; the other columns spread the copies of one text
        plain = [F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, AtomicType)]
        docs = docs.withColumns({"_key": F.xxhash64(*plain), "_text": F.md5(F.col(f"`{text_col}`"))})
        pairs = docs.select("_key", "_text", F.col(f"`{text_col}`")).mapInArrow(_pairs(index.known, index.other), "_key long, _text string, term long, tf long").distinct()
        idf = 1 + F.log((1 + F.lit(index.n_docs)) / (1 + F.coalesce("n", F.lit(0))))
        outside = pairs.join(index.rare, "term", "left").groupBy("_key", "_text").agg(F.sum(((1 + F.log("tf")) * idf) ** 2).alias("_outside"))
        outside = Scratch(spark, "toxicity").save(outside, "outside")
        docs = docs.join(outside, ["_key", "_text"], "left").select(*(F.col(f"`{c}`") for c in own), F.coalesce("_outside", F.lit(0.0)).alias("_outside"))

    def run(text: pa.Array, outside: pa.Array) -> Iterator[dict[str, pa.Array]]:
        ix = shared.value
        kind = pa.list_(pa.struct([("id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
        rare = outside.to_numpy(zero_copy_only=False)
        for lo, hi, data, off in chunks(text):
            doc, h, tf = terms(data, off)
            t = find(ix.known, h)
            at = find(ix.other, h)
            more = np.flatnonzero(at >= 0)
            square = rare[lo:hi] + np.bincount(doc[more], weights=((1 + np.log(tf[more])) * ix.other_idf[at[more]]) ** 2, minlength=hi - lo)
            doc, t, tf = doc[t >= 0], t[t >= 0], tf[t >= 0]
            # unit vectors over all terms, those outside of the index too
            v = (1 + np.log(tf)) * ix.idf[t]
            length = np.sqrt(np.bincount(doc, weights=v**2, minlength=hi - lo) + square)
            v = v / length[doc]
            edge = np.searchsorted(doc, np.arange(hi - lo + 1))
            scores, near = np.full(hi - lo, ix.plain), [[] for _ in range(hi - lo)]
            for at in range(0, hi - lo, BLOCK):
                x, y = edge[at], edge[min(at + BLOCK, hi - lo)]
                base = ix.common(doc[x:y] - at, t[x:y], v[x:y], BLOCK)
                for d in at + np.flatnonzero(np.diff(edge[at : at + BLOCK + 1])):
                    own, cosine = ix.nearest(t[edge[d] : edge[d + 1]], v[edge[d] : edge[d + 1]], k, base=base[d - at])
                    if len(own):
                        scores[d] = ix.score(ix.vote(own, cosine))
                        near[d] = [{"id": int(ix.ids[i]), "toxic": int(ix.toxic[i]), "cosine": float(c)} for i, c in zip(own, cosine, strict=True)]
            yield {"score": pa.array(scores), "neighbours": pa.array(near, kind)}

    return annotate(docs, run, FIELDS, out_col, text_col, "_outside")
