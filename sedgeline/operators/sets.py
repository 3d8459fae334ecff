"""Set combinations, agreement between sources, filters by cell, and stacked counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def combinations(members: DataFrame, entity: str, name: str) -> DataFrame:
    """(combination, n): how many entities have exactly these values, 'a&b'."""
    sets = members.groupBy(entity).agg(F.array_join(F.array_sort(F.collect_set(name)), "&").alias("combination"))
    return sets.groupBy("combination").agg(F.count("*").alias("n"))


def concordance(a: DataFrame, b: DataFrame, key: str, values: str) -> DataFrame:
    """One row: coverage of two sources of value sets, and how many entities they agree on in any value."""
    both = a.select(key, F.col(values).alias("_a")).join(b.select(key, F.col(values).alias("_b")), key, "full")
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    x, y = has("_a"), has("_b")
    return both.agg(
        F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"),
        F.count_if(~x & ~y).alias("neither"), F.count_if(x & y & F.arrays_overlap("_a", "_b")).alias("agree"),
    )


def drop_hyperhosts(hosts: DataFrame, cell: list[str], explicit: str, direct: str, parasite: str) -> DataFrame:
    """Rows left in a cell after two rules: explicit hyperhosts go if the cell has a direct host or parasite; unmarked companions go if it has a parasite. One window, no join."""
    w = Window.partitionBy(*cell)
    any_direct, any_parasite = F.max(F.col(direct) | F.col(parasite)).over(w), F.max(F.col(parasite)).over(w)
    rule_1 = F.col(explicit) & any_direct
    rule_2 = ~F.col(explicit) & ~F.col(direct) & ~F.col(parasite) & any_parasite
    return hosts.withColumn("_drop", rule_1 | rule_2).where(~F.col("_drop")).drop("_drop")


def by_role(hosts: DataFrame, column: str, role: str) -> DataFrame:
    """Rows of a role, 'natural' or 'experimental'; rows that name neither are kept."""
    natural, experimental = F.col(column).rlike("(?i)natural"), F.col(column).rlike("(?i)experiment")
    mine = natural if role == "natural" else experimental
    return hosts.where(mine | (~natural & ~experimental))


def stacked(rows: DataFrame, group: str, unit: str, named: str, least: int) -> DataFrame:
    """(group, named, provisional, total) of units: one is named if any of its rows is; groups under ``least`` units become 'Other'."""
    units = rows.groupBy(group, unit).agg(F.max(named).alias("_named"))
    counts = units.groupBy(group).agg(F.count_if("_named").alias("named"), F.count_if(~F.col("_named")).alias("provisional"))
    pooled = counts.withColumn(group, F.when(F.col("named") + F.col("provisional") < least, F.lit("Other")).otherwise(F.col(group)))
    return pooled.groupBy(group).agg(F.sum("named").alias("named"), F.sum("provisional").alias("provisional"), F.sum(F.col("named") + F.col("provisional")).alias("total"))
