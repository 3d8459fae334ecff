"""Importance resampling towards a target distribution, by hashed word runs.

Texts become runs of words, and runs become buckets. A bucket's gain is the
scaled log-ratio of its smoothed shares in the target's and in all texts; the
gains are one array of ``buckets`` integers, and a text's weight is the sum of
the gains of its runs. Weight plus Gumbel noise, which a hash of the id fixes,
is an integer score; the highest scores are a draw without replacement in
proportion to the weights.

The draw is exact and has no group or task that grows with a score's rows. The
scores are counted, the counts are laid out in ranges of scores, and suffix
sums over the ranges' totals and within ranges give each score its number of
higher ones. That number alone says where the cutoff lies. Within a score that
survives rows are numbered in order of id; as many rows may share a score, each
score is cut where the ranges of (score, id) are, and a range starts where the
ranges before it end.

Defined results: null texts are empty; a text without words has no features and
weight 0 and is never drawn if ``least_words`` is over 0. A null id is hashed
as an empty string and comes after all others among equal scores; rows of one
id and score are ranked by weight, then by number of features. Repeated rows
count as often as they stand there. Empty tables give an empty result; an empty
target has only smoothed counts. All other columns pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..session import ship
from .rows import annotate, free
from .text import ALNUM, LOWER, chunks, runs

BUCKETS, RUN, LEAST_WORDS, SHARE, SEED = 10_000, 1, 20, (10, 100), 2024
_SHORT = 48

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The crc32 of each byte span; all spans go on by a byte at a time, long ones one by one."""
    out, size = np.zeros(len(start), dtype=np.int64), end - start
    for i in np.flatnonzero(size > _SHORT):
        out[i] = zlib.crc32(data[start[i] : end[i]])
    at = np.flatnonzero(size <= _SHORT)
    at = at[np.argsort(-size[at], kind="stable")]
    left = np.searchsorted(-size[at], -np.arange(_SHORT), side="left")  # spans of over i bytes
    crc, first = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32), start[at]
    for i in range(_SHORT):
        n = left[i]
        if not n:
            break
        crc[:n] = _CRC[(crc[:n] ^ data[first[:n] + i]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out[at] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def features(data: np.ndarray, off: np.ndarray, run: int = RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of all runs of 1 to ``run`` words of a chunk, and the number of words by row."""
    data = LOWER[data]
    doc, start, end = runs(data, off, ALNUM)
    docs, found = [doc], [crc32_spans(data, start, end)]
    if run > 1:
        # words joined by one space each
        size = end - start + 1
        to = np.cumsum(size)
        flat = np.full(int(to[-1]) if len(to) else 0, 0x20, dtype=np.uint8)
        inside = np.arange(len(flat)) - np.repeat(to - size, size)
        real = inside < np.repeat(size - 1, size)
        flat[real] = data[(np.repeat(start, size) + inside)[real]]
        for n in range(2, run + 1):
            whole = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
            docs.append(doc[whole])
            found.append(crc32_spans(flat, (to - size)[whole], to[whole + n - 1] - 1))
    return np.concatenate(docs), np.concatenate(found) % buckets, np.bincount(doc, minlength=len(off) - 1)


def bucket_counts(docs: DataFrame, text_col: str = "text", run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: an array of ``buckets`` numbers."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, _, data, off in chunks(b.column(0)):
                total += np.bincount(features(data, off, run, buckets)[1], minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    got = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(everywhere: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the ratio of smoothed shares) by bucket."""
    m = len(everywhere)
    ratio = (target + 1.0) * float(everywhere.sum() + m) / ((everywhere + 1.0) * float(target.sum() + m))
    return np.floor(scale * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", out_col: str = "importance", run: int = RUN) -> DataFrame:
    """``docs`` with the struct ``out_col``: n_words, n_features and weight (the gains of all features summed)."""

    def over(text: pa.Array) -> Iterator[dict[str, pa.Array]]:
        for lo, hi, data, off in chunks(text):
            doc, bucket, n_words = features(data, off, run, len(gain))
            order = np.argsort(doc, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
            edge = np.searchsorted(doc[order], np.arange(hi - lo + 1))
            yield {"n_words": pa.array(n_words.astype(np.int64)), "n_features": pa.array(np.diff(edge)), "weight": pa.array(np.diff(sums[edge]))}

    return annotate(docs, over, "n_words long, n_features long, weight long", out_col, text_col)


def noise(id_col: Column, seed: int = SEED, scale: int = 1000) -> Column:
    """Gumbel noise as an integer: floor(-scale * ln(-ln u)), u from the first 32 bits of sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-scale * F.log(-F.log(u))).cast("long")


def ranked(scored: DataFrame, draw: int, scratch: Scratch, score: str = "score", order: tuple[str, ...] = ("doc_id",), eligible: Column | None = None) -> DataFrame:
    """``scored`` (a written table) with ``rank``: 1 to ``draw`` by descending score and ``order`` (nulls last) among eligible rows, null for all others."""
    if "rank" in scored.columns:
        raise ValueError("the rows have a column named rank")
    eligible = F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True)
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if draw < 1:
        return none
    rows = scored.where(eligible)
    # counts by score in ranges of scores; a range's rows are different scores
    hist = rows.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n")).repartitionByRange(F.col("s").desc())
    hist = scratch.save(hist.withColumn("block", F.spark_partition_id()), "histogram")
    above, base = 0, []  # a row for each range: its number and how many rows score higher
    for r in hist.groupBy("block").agg(F.sum("n").alias("n"), F.max("s").alias("top")).orderBy(F.desc("top")).collect():
        if above < draw:
            base.append((r.block, above))
        above += r.n
    blocks = F.broadcast(hist.sparkSession.createDataFrame(base, "block int, base long"))
    before = Window.partitionBy("block").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.join(blocks, "block").withColumn("above", F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("above") < draw)
    cutoff = offsets.agg(F.min("s")).first()[0]
    if cutoff is None:
        return none
    # the survivors, dealt by ranges of score and id: what shares a score is cut where the ranges are
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in order]
    own = free(scored, "_range")
    alive = rows.where(F.col(score) >= cutoff).repartitionByRange(F.col(score).desc(), *keys).withColumn(own, F.spark_partition_id())
    alive = scratch.save(alive, "survivors")
    pieces = alive.groupBy(F.col(score).alias("s"), F.col(own).alias("piece")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("s").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a score's ranges, not its rows
    pieces = pieces.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    starts = pieces.join(offsets.select("s", "above"), "s").select("s", "piece", (F.col("above") + F.col("earlier")).alias("start"))
    within = Window.partitionBy(own, score).orderBy(*keys)
    numbered = alive.withColumn("rank", F.row_number().over(within).cast("long"))
    numbered = numbered.join(starts, (F.col(own) == F.col("piece")) & (F.col(score) == F.col("s")))
    place = F.col("rank") + F.col("start")
    drawn = numbered.select(*(F.col(f"`{c}`") for c in scored.columns), F.when(place <= draw, place).alias("rank"))
    return drawn.unionByName(none.where(~eligible | (F.col(score) < cutoff) | F.col(score).isNull()))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` without its text, with n_features, weight, score and rank (null where it isn't drawn).

    Of the rows with at least ``least_words`` words the share is drawn, rounded
    down. Columns of these names in ``docs`` are replaced.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    gain = gains(bucket_counts(docs, text_col, run, buckets), bucket_counts(target, text_col, run, buckets))
    new = ("n_features", "weight", "score", "rank")
    own = [c for c in docs.columns if c not in new]
    at = free(docs, "_importance")
    out = weigh(docs.select(*(F.col(f"`{c}`") for c in own)), gain, text_col, at, run)
    weight = F.col(f"{at}.weight")
    words = free(docs, "_words")
    out = out.select(
        *(F.col(f"`{c}`") for c in own if c != text_col), F.col(f"{at}.n_features").alias("n_features"), weight.alias("weight"),
        (weight + noise(F.col(f"`{id_col}`"), seed)).alias("score"), F.col(f"{at}.n_words").alias(words),
    )
    out = scratch.save(out, "scored")
    enough = F.col(words) >= least_words
    draw = out.where(enough).count() * share[0] // share[1]
    return ranked(out, draw, scratch, order=(id_col, "weight", "n_features"), eligible=enough).drop(words)
