"""Average-linkage clustering of pairs that are given as a table, and the order of its leaves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Distances are added up as whole numbers of this fraction, so that no order of adding changes them.
UNIT = 1e-6


def average_linkage(spark: SparkSession, pairs: DataFrame, group: str = "species") -> tuple[DataFrame, DataFrame]:
    """(leaves, merges) of the dendrograms of all groups, from pairs (group, a, b, distance) in either order.

    leaves: (group, leaf, part, place), places from 1 within each part; merges:
    (group, a, b, height, size), each part under its least leaf. Singles come
    before parts, of two singles the lesser, of two parts the one merged first.

    Repeated pairs count by their mean. Pairs that are missing say nothing: the
    distance of two parts is the mean over the pairs there are, and parts
    without any stay apart, each with places of its own. A row whose distance
    is null or whose ends are equal only names its leaves; rows with a null
    group or name are left out. Equal distances go by the names of the pair.

    In each round all pairs merge whose ends are each other's nearest; as means
    never fall below the nearest of what they merge, that gives the same tree
    as one merge at a time. Rounds are few where parts grow alike, and as many
    as merges where one part takes leaf after leaf. Each is written; no task
    holds a group or a row of the matrix, and no side of a join, all of which
    grow with the pairs, goes through the driver.
    """
    scratch = Scratch(spark, "linkage")
    rows = pairs.select(group, "a", "b", F.round(F.col("distance").cast("double") / UNIT).cast("long").alias("s")).dropna(subset=[group, "a", "b"])
    leaves = rows.select(group, F.explode(F.array("a", "b")).alias("leaf")).distinct()
    state = {"node": F.col("leaf"), "place": F.lit(1).cast("long"), "size": F.lit(1).cast("long"), "height": F.lit(-1.0), "born": F.lit(0)}
    leaves = scratch.save(leaves.withColumns(state), "leaves")
    rows = rows.where("a <> b").dropna(subset=["s"]).withColumn("n", F.lit(1).cast("long"))
    edges = scratch.save(_added(rows, group), "edges")
    merges, born = [], 0
    while not edges.isEmpty():
        born += 1
        merged = scratch.save(_reciprocal(edges, leaves.where("leaf = node"), group), "merged")
        merges.append(merged)
        ahead = F.when(F.col("first"), 0).otherwise(F.col("size_b")).alias("shift")
        behind = F.when(F.col("first"), F.col("size_a")).otherwise(0).alias("shift")
        grown = [F.col("a").alias("to"), (F.col("size_a") + F.col("size_b")).alias("total"), F.col("d")]
        sides = merged.select(group, F.col("a").alias("node"), ahead, *grown).union(merged.select(group, F.col("b").alias("node"), behind, *grown))
        moved = leaves.join(sides.hint("merge"), [group, "node"], "left").select(
            group, "leaf", F.coalesce("to", "node").alias("node"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"), F.coalesce("total", "size").alias("size"),
            F.coalesce("d", "height").alias("height"), F.when(F.col("to").isNotNull(), born).otherwise(F.col("born")).alias("born"),
        )
        fewer = edges
        for end in ("a", "b"):
            names = merged.select(group, F.col("b").alias(end), F.col("a").alias("to"))
            fewer = fewer.join(names.hint("merge"), [group, end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
        old = leaves, edges
        leaves, edges = scratch.save(moved, "leaves"), scratch.save(_added(fewer.where("a <> b"), group), "edges")
        scratch.drop(*old)
    scratch.drop(edges)
    none = spark.createDataFrame([], leaves.select(group, F.col("leaf").alias("a"), F.col("leaf").alias("b"), "height", "size").schema)
    tree = reduce(DataFrame.union, [m.select(group, "a", "b", F.col("d").alias("height"), (F.col("size_a") + F.col("size_b")).alias("size")) for m in merges], none)
    return leaves.select(group, "leaf", F.col("node").alias("part"), "place"), tree


def _added(rows: DataFrame, group: str) -> DataFrame:
    """Sums and counts of pairs, the lesser name first."""
    return rows.groupBy(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def _reciprocal(edges: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """(group, a, b, d, size_a, size_b, first): pairs that are nearest at both ends; first: a's leaves come before b's."""
    near = edges.withColumn("d", F.col("s") / F.col("n") * UNIT)
    ends = near.select(group, F.explode(F.array("a", "b")).alias("node"), F.struct("d", "a", "b").alias("e"))
    best = ends.groupBy(group, "node").agg(F.min("e").alias("e"))
    both = best.groupBy(group, "e").agg(F.count("*").alias("k")).where("k = 2").select(group, "e.*")
    for end in ("a", "b"):
        side = nodes.select(group, F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.struct("height", "born", "node").alias(f"made_{end}"))
        both = both.join(side.hint("merge"), [group, end])
    first = F.when(F.col("size_a") == 1, True).when(F.col("size_b") == 1, False).otherwise(F.col("made_a") < F.col("made_b"))
    return both.select(group, "a", "b", "d", "size_a", "size_b", first.alias("first"))


def matrix_cells(identities: DataFrame, group: str = "species") -> DataFrame:
    """(group, a, b, text): cells of the square matrices, from identities (group, a, b, identity) in either order.

    The greatest identity of a pair counts, with three decimals; the diagonal
    is 100. Pairs that are missing have no cell: they become empty on writing.
    """
    rows = identities.dropna(subset=[group, "a", "b"])
    best = rows.where("a <> b").groupBy(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("identity").alias("v")).dropna(subset=["v"])
    text = F.format_string("%.3f", F.col("v").cast("double")).alias("text")
    both = best.select(group, "a", "b", text).union(best.select(group, "b", "a", text))
    names = rows.select(group, F.explode(F.array("a", "b")).alias("a")).distinct()
    return both.union(names.select(group, "a", F.col("a").alias("b"), F.lit("100")))


def write_matrix(cells: DataFrame, path: str, names: list[str]) -> None:
    """One group's cells (a, b, text) as a tab-separated square, rows and columns in the order of names."""
    places = list(range(1, len(names) + 1))
    place = lambda end: F.array_position(F.array(*(F.lit(n) for n in names)), F.col(end).cast("string")).cast("int")
    wide = cells.select(F.col("a").alias("cluster"), place("a").alias("row"), place("b").alias("column"), "text").where("row > 0 AND column > 0")
    wide = wide.groupBy("row", "cluster").pivot("column", places).agg(F.first("text")).fillna("").orderBy("row")
    out = wide.select("cluster", *(F.col(f"`{i}`").alias(n) for i, n in zip(places, names, strict=True)))
    out.coalesce(1).write.option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "").csv(path, mode="overwrite")
