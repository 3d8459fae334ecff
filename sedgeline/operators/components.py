"""Connected components of a distributed edge table by alternating star contractions, and names that are one by way of others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: each node's neighbours are linked to its least neighbour instead.

    The minimum is combined before the shuffle, and the join back is one that
    adaptive execution can split, so a hub with a third of all edges is no
    single task.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select("b", "a"))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the least node of its component.

    Nodes without an edge aren't in the result. An empty table gives an empty one.
    """
    now = scratch.save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    sign = None
    for _ in range(most):
        large = scratch.save(_stars(now, True), "large")
        scratch.drop(now)
        now = scratch.save(_stars(large, False), "small")
        scratch.drop(large)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max(F.when(F.col("a") < F.col("b"), 1).otherwise(0))).first()
        if got == sign:
            break
        sign = got
    else:
        raise RuntimeError("star contraction did not end")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b"), F.col("b")).distinct())


def canonical_names(lines: DataFrame, names_col: str = "names", scratch: Scratch | None = None) -> DataFrame:
    """(name, canonical) for every name of ``lines``, whose array says that its names are one: the least name of all that are linked, however long the chain.

    Null and empty names, and lines with fewer than two different ones, say nothing.
    """
    clean = F.array_distinct(F.filter(F.col(f"`{names_col}`"), lambda n: n.isNotNull() & (n != "")))
    own = lines.select(clean.alias("n")).where(F.size("n") > 1)
    edges = own.select(F.explode(F.slice("n", 2, F.size("n") - 1)).alias("a"), F.col("n")[0].alias("b"))
    found = components(edges, scratch or Scratch(lines.sparkSession, "synonyms"))
    return found.select(F.col("node").alias("name"), F.col("label").alias("canonical"))
