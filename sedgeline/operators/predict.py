"""Environments of hosts, predicted from the genus by a table of genera, by patterns and by close spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import GENUS_PATTERNS, NOT_TAXA

#: The greatest number of edits between a genus and a known one that is reported.
EDITS = 2
#: A genus shorter than this has no close spellings.
LEAST_LETTERS = 6
_PIECES = EDITS + 1


def genus_table(assignments: DataFrame) -> DataFrame:
    """(genus, grp, ord) from assignments (ord, genus, grp): the last assignment of a genus wins, its place is that of the first.

    Genera are compared in lower case; rows with a null ord, genus or grp and blank genera are left out.
    """
    rows = assignments.select("ord", F.lower(F.trim("genus")).alias("genus"), "grp").dropna().where("genus <> ''")
    return rows.groupBy("genus").agg(F.max_by("grp", F.struct("ord", "grp")).alias("grp"), F.min("ord").alias("ord"))


def _pieces(known: Column) -> Column:
    """The three pieces of a known genus: two edits leave one of them whole, at most two places from where it was."""
    n = F.length(known)
    start = lambda i: F.floor(n * i / _PIECES).cast("int")
    return F.array(*(F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring(known, start(i) + 1, start(i + 1) - start(i)).alias("piece")) for i in range(_PIECES)))


def _probes(key: Column) -> Column:
    """The pieces of all known genera that a key may be two edits from, where the key has them."""
    n = F.length(key)

    def of(i: int, longer: int, shift: int) -> Column:
        m = n + longer
        start = F.floor(m * i / _PIECES).cast("int")
        size = F.floor(m * (i + 1) / _PIECES).cast("int") - start
        at = start + shift
        return F.when((at >= 0) & (at + size <= n), F.struct(m.alias("n"), F.lit(i).alias("i"), F.substring(key, at + 1, size).alias("piece")))

    span = range(-EDITS, EDITS + 1)
    return F.array_distinct(F.array_compact(F.array(*(of(i, longer, shift) for i in range(_PIECES) for longer in span for shift in span))))


def close_genera(keys: DataFrame, genera: DataFrame) -> DataFrame:
    """(key, near, edits, grp): the nearest genus (genus, grp, ord) within two edits of each key, the first by ord of equal ones.

    Key and genus begin with the same letter, and the key has at least six.
    Both meet by a piece that two edits can't have touched, so no key is held
    against all genera.
    """
    k = keys.select("key").dropna().distinct().where(F.length("key") >= LEAST_LETTERS)
    probes = k.select("key", F.substring("key", 1, 1).alias("letter"), F.explode(_probes(F.col("key"))).alias("p")).select("key", "letter", "p.*")
    known = genera.select("genus", "grp", "ord", F.substring("genus", 1, 1).alias("letter"), F.explode(_pieces(F.col("genus"))).alias("p")).select("genus", "grp", "ord", "letter", "p.*")
    near = probes.join(known, ["letter", "n", "i", "piece"]).withColumn("edits", F.levenshtein("key", "genus", EDITS)).where(F.col("edits") >= 0)
    best = near.groupBy("key").agg(F.min(F.struct("edits", "ord", "genus", "grp")).alias("b"))
    return best.select("key", F.col("b.genus").alias("near"), "b.edits", "b.grp")


def predict(hosts: DataFrame, assignments: DataFrame, groups: DataFrame, patterns: tuple = GENUS_PATTERNS, not_taxa: str = NOT_TAXA) -> DataFrame:
    """Rows of hosts (host, and other columns) with the prediction's columns added in place of any of the same names.

    primary_environment, environments, host_group, note, confidence and basis
    come from groups (grp, environment, environments, host_group, note,
    confidence), each grp once, by the first that applies: a blank or null host
    has none; a word that is no taxon has none; the genus is in the table of
    assignments (ord, genus, grp); the genus fits a pattern (pattern, grp,
    confidence), in order; it is one edit from a known genus; it is two edits
    from one, which is reported and not applied; nothing. A grp that groups
    lacks counts as none at all: "genus not in table".

    Each distinct genus is looked up once, so a host that holds a third of all
    rows costs one row until the answers are joined back; close spellings see
    only genera that table and patterns leave.
    """
    table = genus_table(assignments).join(groups.select("grp"), "grp", "left_semi")
    h = hosts.withColumn("_host", F.regexp_replace(F.coalesce("host", F.lit("")), r"^\s+|\s+$", ""))
    h = h.withColumn("_key", F.when((F.col("_host") != "") & ~F.col("_host").rlike(not_taxa), F.lower(F.regexp_extract("_host", r"^(\S+)", 1))))
    keys = h.select(F.col("_key").alias("key")).dropna().distinct()
    keys = keys.join(table.select(F.col("genus").alias("key"), F.col("grp").alias("_known")), "key", "left")
    shape, sure = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, grp, confidence in reversed(patterns):
        fits = F.col("key").rlike(pattern)
        shape, sure = F.when(fits, grp).otherwise(shape), F.when(fits, confidence).otherwise(sure)
    keys = keys.withColumn("_shape", F.when(F.col("_known").isNull(), shape)).withColumn("_sure", F.when(F.col("_known").isNull(), sure))
    near = close_genera(keys.where("_known IS NULL AND _shape IS NULL"), table)
    keys = keys.join(near.withColumnsRenamed({"grp": "_typo"}), "key", "left")
    one = F.col("edits") == 1
    keys = keys.withColumn("_grp", F.coalesce("_known", "_shape", F.when(one, F.col("_typo"))))
    info = groups.select(F.col("grp").alias("_grp"), F.struct("environment", "environments", "host_group", "note", "confidence").alias("_g"))
    keys = keys.join(info, "_grp", "left").withColumn("_near", F.initcap("near"))
    found = F.col("_g").isNotNull()
    basis = (
        F.when(found & F.col("_known").isNotNull(), F.format_string("genus table (%s)", "_known"))
        .when(found & F.col("_shape").isNotNull(), F.format_string("name pattern (%s)", "_shape"))
        .when(found & one, F.format_string("fuzzy match to %s (1 edit) - LIKELY MISSPELLING", "_near"))
        .when(F.col("edits") > 1, F.format_string("possible misspelling of %s (%d edits) - NOT APPLIED, check manually", "_near", "edits"))
        .otherwise("genus not in table")
    )
    level = F.when(~found, "none").when(F.col("_known").isNotNull(), F.col("_g.confidence")).when(F.col("_shape").isNotNull(), F.col("_sure")).otherwise("medium")
    keys = keys.select(F.col("key").alias("_key"), F.col("_g"), level.alias("_level"), basis.alias("_basis"))
    out = h.join(keys, "_key", "left")
    none = F.when(F.col("_host") == "", "no host name parsed").when(F.col("_key").isNull(), "not a taxon name")
    empty = F.array().cast("array<string>")
    values = {
        "primary_environment": F.coalesce("_g.environment", F.lit("")), "environments": F.coalesce("_g.environments", empty), "host_group": F.coalesce("_g.host_group", F.lit("Unresolved")),
        "note": F.coalesce("_g.note", F.lit("")), "confidence": F.coalesce("_level", F.lit("none")), "basis": F.coalesce(none, "_basis"),
    }
    return out.select(*(F.col(f"`{c}`") for c in hosts.columns if c not in values), *(v.alias(k) for k, v in values.items()))
