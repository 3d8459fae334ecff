"""How well a clustering agrees with names, and which settings of a sweep are best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .running import running


def _entropy(counts: DataFrame, n: str = "n") -> Column:
    return -F.sum(F.col(n) / F.col("total") * F.log(F.col(n) / F.col("total")))


def cluster_metrics(pairs: DataFrame, cluster: str, truth: str) -> DataFrame:
    """One row: homogeneity, completeness, v_measure, ari, split and mixed counts of a table of (cluster, truth).

    Everything follows from the contingency counts, which are combined before
    the shuffle; the row table itself is read once.
    """
    cells = pairs.groupBy(cluster, truth).agg(F.count("*").alias("n"))
    a = cells.groupBy(cluster).agg(F.sum("n").alias("a"), F.count("*").alias("k"))
    b = cells.groupBy(truth).agg(F.sum("n").alias("b"), F.count("*").alias("k"))
    total = cells.agg(F.sum("n").alias("total"))
    two = lambda x: F.col(x) * (F.col(x) - 1) / 2
    part = lambda x: F.col(x) / F.col("total")
    of_a = a.crossJoin(total).agg(F.sum(-part("a") * F.log(part("a"))).alias("hc"), F.sum(two("a")).alias("ca"), F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).alias("mixed_clusters"))
    of_b = b.crossJoin(total).agg(F.sum(-part("b") * F.log(part("b"))).alias("hs"), F.sum(two("b")).alias("cb"), F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).alias("split_species"))
    both = cells.join(a.select(cluster, "a"), cluster).join(b.select(truth, "b"), truth).crossJoin(total)
    of_cells = both.agg(F.sum(-part("n") * F.log(F.col("n") / F.col("a"))).alias("hsc"), F.sum(-part("n") * F.log(F.col("n") / F.col("b"))).alias("hcs"), F.sum(two("n")).alias("cn"), F.max("total").alias("n"))
    row = of_a.crossJoin(of_b).crossJoin(of_cells)  # three rows of totals
    h = F.when(F.col("hs") == 0, 1.0).otherwise(1 - F.col("hsc") / F.col("hs"))
    c = F.when(F.col("hc") == 0, 1.0).otherwise(1 - F.col("hcs") / F.col("hc"))
    row = row.withColumn("homogeneity", h).withColumn("completeness", c)
    expected = F.col("ca") * F.col("cb") / (F.col("n") * (F.col("n") - 1) / 2)
    most = (F.col("ca") + F.col("cb")) / 2
    v = F.when(F.col("homogeneity") + F.col("completeness") == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness")))
    ari = F.when(most == expected, 0.0).otherwise((F.col("cn") - expected) / (most - expected))
    four = lambda x, name: F.round(x, 4).alias(name)
    return row.select("n", "split_species", "mixed_clusters", four(F.col("homogeneity"), "homogeneity"), four(F.col("completeness"), "completeness"), four(v, "v_measure"), four(ari, "ari"))


def pareto(grid: DataFrame, x: str, y: str) -> DataFrame:
    """Rows of a grid that no other row beats: none is at most as great in both and smaller in one.

    After sorting by (x, y), a row stands if its y is under all before it of
    smaller x; so no join of the grid with itself is needed. Rows with a null in
    either are passed over.
    """
    best = grid.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(F.min(y).alias(y))
    before = running(best, [], [x], {"_before": F.col(y)}, Scratch(grid.sparkSession, "pareto"), F.min, before=True)
    front = before.where(F.col("_before").isNull() | (F.col(y) < F.col("_before"))).drop("_before")
    return grid.join(front, [x, y], "left_semi")


def plateau(grid: DataFrame, by: str, step: str, value: str, tolerance: float) -> DataFrame:
    """For each ``by``: the greatest value, and the last step whose value is within tolerance of it."""
    top = grid.groupBy(by).agg(F.max(value).alias("best"))
    near = grid.join(top, by).where(F.col(value) >= (1 - tolerance) * F.col("best"))
    return near.groupBy(by).agg(F.max("best").alias("best"), F.max(step).alias("edge"))


def steps(grid: DataFrame, by: str, step: str, value: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(step)
    return grid.withColumn("delta", F.col(value) - F.lag(value).over(w))
