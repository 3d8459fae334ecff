"""Cosine identities of all pairs within a label, as products of blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Rows of a label in a block, about; a task holds two blocks, and multiplies TILE rows of one by TILE of the other.
BLOCK, TILE = 16_384, 1_024
#: A similarity so near the limit is taken again, term after term.
NEAR = 1e-9
FIELDS = "label {}, sum double, n long, lo double, hi double, nans long, under long"


def _compared(limit: float):
    """Sums over the pairs of two blocks, from rows (label, dim, x, y, side, id, vector) in order of all but the last two."""

    def products(key: tuple, ids: list, vectors: list, sides: list) -> list:
        v, ids = np.array(vectors, dtype=np.float64), np.array(ids)
        norm = np.sqrt((v * v).sum(1))
        left = np.flatnonzero(np.array(sides) == 0)
        right = left if key[2] == key[3] else np.flatnonzero(np.array(sides) == 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = v / norm[:, None]
        total, n, lo, hi, nans, under = 0.0, 0, np.inf, -np.inf, 0, 0
        for a in range(0, len(left), TILE):
            for b in range(a if key[2] == key[3] else 0, len(right), TILE):
                i, j = left[a : a + TILE], right[b : b + TILE]
                s = unit[i] @ unit[j].T * 100
                if key[2] == key[3]:  # one block with itself: each pair once, none of one id
                    s = s[(ids[i][:, None] != ids[j][None, :]) & (i[:, None] < j[None, :])]
                    at = None
                near = np.argwhere(np.abs(s - limit) < NEAR)
                if len(near):
                    if key[2] == key[3]:
                        at = np.argwhere((ids[i][:, None] != ids[j][None, :]) & (i[:, None] < j[None, :]))[near[:, 0]]
                    else:
                        at = near
                    for place, (p, q) in zip(map(tuple, near), at, strict=True):
                        x, y = (i[p], j[q]) if ids[i[p]] < ids[j[q]] else (j[q], i[p])
                        s[place] = np.add.accumulate(v[x] * v[y])[-1] / np.sqrt(np.add.accumulate(v[x] ** 2)[-1]) / np.sqrt(np.add.accumulate(v[y] ** 2)[-1]) * 100
                s = s.ravel()
                bad = np.isnan(s)
                nans += int(bad.sum())
                s = s[~bad] if bad.any() else s
                if len(s):
                    total, n, lo, hi, under = total + s.sum(), n + len(s), min(lo, s.min()), max(hi, s.max()), under + int((s < limit).sum())
        return [key[0], float(total), n, float(lo) if n else None, float(hi) if n else None, nans, under]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, sides, kind = None, [], [], [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            cols = [batch.column(i).to_pylist() for i in range(6)]
            flat = batch.column(6)
            for r, (label, dim, x, y, side, i) in enumerate(zip(*cols, strict=True)):
                if (label, dim, x, y) != key:
                    if ids:
                        yield row(kind, products(key, ids, vectors, sides))
                    key, ids, vectors, sides = (label, dim, x, y), [], [], []
                ids.append(i)
                sides.append(side)
                vectors.append(flat[r].values.to_numpy())
        if ids:
            yield row(kind, products(key, ids, vectors, sides))

    def row(kind: pa.DataType, values: list) -> pa.RecordBatch:
        types = [kind, pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["label", "sum", "n", "lo", "hi", "nans", "under"])

    return run


def pair_identity(rows: DataFrame, label: str, id_col: str, vector: str, limit: float = 90.0) -> DataFrame:
    """(label, n_pairs, mean, lo, hi, under_90) of 100 times the cosine over the pairs of unlike ids of each label.

    Rows are dealt to blocks by their ids, and each pair of a label's blocks is
    one group: the work is that of all pairs, the memory that of two blocks. A
    null vector, one that holds a null, and one of another length make pairs
    without a cosine, which count as pairs alone; NaN is the greatest value.
    """
    scratch = Scratch(rows.sparkSession, "identity")
    e = rows.select(F.col(label).alias("label"), F.col(id_col).alias("id"), F.col(vector).alias("v")).where("label IS NOT NULL AND id IS NOT NULL")
    each = e.groupBy("label", "id").agg(F.count("*").alias("k")).groupBy("label").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).cast("long").alias("n_pairs"), F.sum("k").alias("rows"))
    each = scratch.save(each.where("n_pairs > 0"), "labels")
    dealt = e.join(each.select("label", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "label").where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    at = ["label", "dim", "x", "y"]
    dealt = dealt.select("label", F.size("v").alias("dim"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", F.col("v").cast("array<double>").alias("v"))
    found = dealt.repartition(*at).sortWithinPartitions(*at, "side").mapInArrow(_compared(limit), FIELDS.format(e.schema["label"].dataType.simpleString()))
    sums = found.groupBy("label").agg(*(f(c).alias(c) for f, c in ((F.sum, "sum"), (F.sum, "n"), (F.min, "lo"), (F.max, "hi"), (F.sum, "nans"), (F.sum, "under"))))
    nan, some = F.lit(float("nan")), F.col("nans") > 0
    return each.join(sums, "label", "left").select(
        F.col("label").alias(label), "n_pairs", F.round(F.when(some, nan).when(F.col("n") > 0, F.col("sum") / F.col("n")), 3).alias("mean"), F.round(F.coalesce("lo", F.when(some, nan)), 3).alias("lo"),
        F.round(F.when(some, nan).otherwise(F.col("hi")), 3).alias("hi"), F.coalesce("under", F.lit(0)).cast("long").alias("under_90"),
    )
