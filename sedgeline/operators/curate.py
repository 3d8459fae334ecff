"""Trimming decisions, name picks, set unions and quality reports of curated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Fixed value: the group's name, where a cluster has no genus.
FALLBACK = "Microsporidia"


def trim_status(has_hit: Column, length: Column, coverage: Column, min_length: int, min_coverage: int) -> tuple[Column, Column]:
    """(status, reason): dropped without a hit, then by length, then by model coverage; else kept with no reason."""
    short = F.concat(F.lit("trimmed length "), length.cast("string"), F.lit(f" < {min_length}"))
    thin = F.concat(F.lit("model coverage "), coverage.cast("string"), F.lit(f" < {min_coverage}"))
    reason = F.when(~has_hit, "no significant CM hit").when(length < min_length, short).when(coverage < min_coverage, thin).otherwise("")
    return F.when(reason == "", "kept").otherwise("dropped"), reason


def tagged_length(header: Column, sequence: Column) -> Column:
    """The number of a header's cm_cov tag, or else the length of the sequence."""
    return F.coalesce(F.nullif(F.regexp_extract(header, r"cm_cov=([0-9]+)", 1), F.lit("")).cast("long"), F.length(sequence).cast("long"))


def upper_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, least, median, most): the median of an even number of values is the upper one. Values are counted before they are put in order."""
    n = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by)
    at = n.withColumn("_to", F.sum("_n").over(w.orderBy(value))).withColumn("_all", F.sum("_n").over(w))
    return at.groupBy(by).agg(F.min(value).alias("least"), F.min(F.when(F.col("_to") > F.floor(F.col("_all") / 2), F.col(value))).alias("median"), F.max(value).alias("most"))


def pick_name(names: DataFrame, key: str, name: str, rank: str, order: str) -> DataFrame:
    """(key, name, n_names): of the best rank the name of two words at most, the shortest, the commonest, the first seen.

    Spellings that differ in case and white space alone are one name, written as it was first.
    """
    spelt = tx.clean(F.col(name))
    n = names.withColumn("_name", spelt).where("_name <> ''").groupBy(key, F.lower("_name").alias("_folded"))
    n = n.agg(F.min(rank).alias("_rank"), F.count("*").alias("_n"), F.min(F.struct(order, "_name")).alias("_first"))
    best = F.struct("_rank", F.size(F.split("_folded", " ")) > 2, F.length("_folded"), -F.col("_n"), F.col("_first")[order])
    return n.groupBy(key).agg(F.min_by(F.col("_first._name"), best).alias(name), F.count("*").alias("n_names"))


def majority(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, votes): the commonest value, of equals the first seen; blanks don't count."""
    n = df.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(key, value).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    return n.groupBy(key).agg(F.max_by(value, F.struct("votes", -F.col("_first"))).alias(value), F.max("votes").alias("votes"))


def provisional_label(genus: Column, prefix: str, cluster: Column) -> Column:
    """'Genus sp. MSP-C0042'; without a genus that of the whole group, and a cluster that is no number as it is."""
    c = cluster.cast("string")
    tag = F.when(c.rlike("^[0-9]+$"), F.lpad(c, F.greatest(F.length(c), F.lit(4)), F.lit("0"))).otherwise(c)
    name = F.when(F.coalesce(genus, F.lit("")) == "", F.lit(FALLBACK)).otherwise(F.initcap(genus))
    return F.concat(name, F.lit(f" sp. {prefix}-C"), tag)


def united(values: DataFrame, key: str, source: str, order: str, value: str) -> DataFrame:
    """(key, vals, sources): sorted distinct values, and the sources that gave any in fixed order."""
    g = values.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(key)
    sources = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(order, source))), lambda s: s[source]), "+")
    return g.agg(F.array_join(F.array_sort(F.collect_set(value)), "; ").alias("vals"), sources.alias("sources"))


def merged(a: Column, b: Column) -> tuple[Column, Column]:
    """(distinct values of a and then of b, without regard to case and white space, in their first spelling; how many of b, as they stand there, a lacks)."""
    lacks = lambda low: F.filter(b, lambda v: ~F.array_contains(low, F.lower(v)))
    new = tx.once(F.transform(a, lambda x: F.lower(x)), lacks)
    return tx.dedupe(F.transform(F.concat(a, new), lambda v: tx.clean(v))), F.size(new).cast("long")


def pooled(counts: DataFrame, group: str, parent: str, n: str, least: int) -> DataFrame:
    """(parent, group, n): groups under ``least`` are put together as the other ones of their parent."""
    name = F.when(F.col(n) < least, F.concat(F.lit("other "), F.col(parent))).otherwise(F.col(group))
    return counts.groupBy(parent, name.alias(group)).agg(F.sum(n).alias(n))


def averages(pairs: DataFrame, cluster: str, species: str, value: str, low: float) -> DataFrame:
    """(species, clusters, mean, sd, least, most, n_low): over the means of clusters; sd is of a sample, null for one."""
    each = pairs.groupBy(species, cluster).agg(F.avg(value).alias("_m"))
    r = lambda c, name: F.round(c, 4).alias(name)
    return each.groupBy(species).agg(F.count("*").alias("clusters"), r(F.avg("_m"), "mean"), r(F.stddev_samp("_m"), "sd"), r(F.min("_m"), "least"), r(F.max("_m"), "most"), F.count_if(F.col("_m") < low).alias("n_low"))


def identity_class(c: Column) -> Column:
    return F.when(c < 90, "<90").when(c < 95, "90-95").when(c < 98, "95-98").when(c < 99, "98-99").otherwise(">=99")


def edits(a: Column, b: Column) -> Column:
    """Edit distance; 99 where the lengths differ by more than two."""
    return F.when(F.abs(F.length(a) - F.length(b)) > 2, 99).otherwise(F.levenshtein(a, b))


def first_rule(rules: list[tuple[str, str, list[str]]], other: str, none: str) -> Column:
    """The label of the first rule (label, column, values) that holds without regard to case; ``other`` where any of the columns has a value."""
    cols = list(dict.fromkeys(c for _, c, _ in rules))
    out = None
    for label, c, values in rules:
        hit = F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin([v.lower() for v in values])
        out = F.when(hit, label) if out is None else out.when(hit, label)
    some = F.concat(*(F.coalesce(F.col(c), F.lit("")) for c in cols)) != ""
    return out.when(some, other).otherwise(none)


def name_changed(asked: Column, got: Column) -> Column:
    """Whether genus and epithet of an answer differ from those asked for, letters only; no answer is no change."""
    two = lambda c: F.slice(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z ]", ""), " +"), lambda t: t != ""), 1, 2)
    return (F.trim(F.coalesce(got, F.lit(""))) != "") & (two(asked) != two(got))


def place(c: Column) -> tuple[Column, Column]:
    """(country, region): apart at the first colon."""
    p = F.split(F.coalesce(c, F.lit("")), ":", 2)
    return F.trim(p[0]), F.trim(F.coalesce(F.try_element_at(p, F.lit(2)), F.lit("")))
