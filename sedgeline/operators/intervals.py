"""Chains of hits along a sequence, and the lengths that intervals cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chain_hits(hits: DataFrame, max_gap: int, tolerance: int = 50) -> DataFrame:
    """The best chain of each (target): of the hits on a strand, in order of start, the next one joins if the gap is at most max_gap and the model advances.

    hits: target, strand, start, end, mdl_from, mdl_to, score, evalue, ord
    (ord makes the order total). The greatest total score wins; '+' before '-'
    and the earlier chain on ties. A chain ends by a look at the hit before
    alone, so one window pass does it.
    """
    w = Window.partitionBy("target", "strand").orderBy("start", "ord")
    prev = {c: F.lag(c).over(w) for c in ("end", "mdl_from", "mdl_to")}
    advances = F.when(F.col("strand") == "+", F.col("mdl_from") >= prev["mdl_to"] - tolerance).otherwise(F.col("mdl_to") <= prev["mdl_from"] + tolerance)
    breaks = F.when(prev["end"].isNull() | (F.col("start") - prev["end"] - 1 > max_gap) | ~advances, 1).otherwise(0)
    chained = hits.withColumn("_break", breaks).withColumn("chain", F.sum("_break").over(w))
    chains = chained.groupBy("target", "strand", "chain").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("mdl_from").alias("mdl_from"), F.max("mdl_to").alias("mdl_to"),
        F.sum("score").alias("score"), F.min("evalue").alias("evalue"), F.count("*").alias("n_hits"),
    )
    best = Window.partitionBy("target").orderBy(F.desc("score"), F.when(F.col("strand") == "+", 0).otherwise(1), "chain")
    return chains.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def coverage(intervals: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, covered): length of the union of inclusive intervals; adjacent ones merge."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start) - 1, F.coalesce(before, F.col(start) - 1)))
    return intervals.select(key, new.alias("_new")).groupBy(key).agg(F.sum("_new").cast("long").alias("covered"))
