"""Rows of a curated table that a cluster belongs to, by accession, name and spelling."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..scratch import Scratch
from ..session import ship, spread
from .prefixes import MOST, Prefixes
from .resolve import count_tiers

#: Keys that a task holds as a tree of their beginnings, about, and keys that it looks up in it at once.
BLOCK, AT_ONCE = 10_000, 64


def _best(key: str, found: list[tuple[float, str]], matcher: SequenceMatcher, cutoff: float, most: int) -> list[tuple[float, str]]:
    """The ``most`` best (ratio, other) of ``found`` (highest ratio that letters in common allow, other); what can't be among them isn't compared."""
    out = []
    matcher.set_seq2(key)
    for bound in sorted(found, reverse=True):
        if len(out) == most and out[-1] > bound:
            break
        matcher.set_seq1(bound[1])
        if (ratio := matcher.ratio()) >= cutoff:
            out = sorted([*out, (ratio, bound[1])], reverse=True)[:most]
    return out


def _closest(cutoff: float, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function from the asked and the known keys of a genus to the best pairs (key, other, ratio) of each."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        out: list[tuple[str, str, float]] = []
        if asked.num_rows and known.num_rows:
            genus, keys, others = asked["of"][0].as_py(), asked["key"].to_pylist(), sorted(known["other"].to_pylist())
            n, matcher = len(genus), SequenceMatcher()
            tree = Prefixes([o[n:] for o in others], n)
            short = [k for k in keys if len(k) - n <= MOST]
            for at in range(0, len(short), AT_ONCE):
                some: dict[str, list[tuple[float, str]]] = {}
                chunk = short[at : at + AT_ONCE]
                for i, j, c in zip(*(v.tolist() for v in tree.near([k[n:] for k in chunk], cutoff)), strict=True):
                    some.setdefault(chunk[i], []).append((2.0 * c / max(len(chunk[i]) + len(others[j]), 1), others[j]))
                out += [(k, o, r) for k, found in some.items() for r, o in _best(k, found, matcher, cutoff, most)]
            for k in keys:
                if len(k) - n > MOST:
                    found = [(2.0 * min(len(k), len(o)) / (len(k) + len(o)), o) for o in others]
                    out += [(k, o, r) for r, o in _best(k, [f for f in found if f[0] >= cutoff], matcher, cutoff, most)]
        return pa.table({"key": pa.array([x[0] for x in out], pa.string()), "other": pa.array([x[1] for x in out], pa.string()), "ratio": pa.array([x[2] for x in out], pa.float64())})

    return run


def close_spellings(asked: DataFrame, known: DataFrame, cutoff: float = 0.9, most: int = 3) -> DataFrame:
    """(key, other, ratio, place): for each ``key`` of ``asked`` the ``most`` closest keys of ``known`` of the same genus at a ratio of matching letters of at least the cutoff.

    The ratio is that of matching blocks, twice their letters by those of both
    keys; of equal ratios the key that sorts last comes first. Both tables are
    of distinct keys 'genus epithet'; null keys are passed over. Known keys are
    written in ranges of about BLOCK, so that a genus of any size is many
    tasks, and the asked keys of a genus go to each of its ranges. Matching
    blocks never hold more letters than the longest common subsequence, so
    only pairs with a long enough one are compared; these are found by walking
    the tree of beginnings of a range.
    """
    spark = asked.sparkSession
    ship(spark)
    one = lambda t: t.select("key").where("key IS NOT NULL").distinct().withColumn("genus", F.split_part("key", F.lit(" "), F.lit(1)))
    scratch = Scratch(spark, "spellings")
    every = scratch.save(one(known).withColumnRenamed("key", "other"), "known")
    n = max(every.count() // BLOCK + 1, spark.sparkContext.defaultParallelism)
    ranges = scratch.save(every.repartitionByRange(n, "genus", "other").withColumn("block", F.spark_partition_id()), "ranges")
    scratch.drop(every)
    places = ranges.select(F.col("genus").alias("of"), F.col("block").alias("to")).distinct()
    sent = one(asked).join(places, F.col("genus") == F.col("of")).select("of", "to", "key")
    found = spread(sent, "of", "to").groupBy("of", "to").cogroup(spread(ranges, "genus", "block").groupBy("genus", "block"))
    scored = found.applyInArrow(_closest(cutoff, most), "key string, other string, ratio double")
    best = Window.partitionBy("key").orderBy(F.desc("ratio"), F.desc("other"))
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)


def name_index(rows: DataFrame, row_col: str = "row", name_col: str = "name") -> DataFrame:
    """(row, key, abbreviated, epithet) for each key that a row is found under: its own and those of its other names."""
    own = rows.select(F.col(f"`{row_col}`").alias("row"), F.explode(tx.all_keys(F.col(f"`{name_col}`"))).alias("key"))
    second = F.coalesce(F.try_element_at(F.split("key", " "), F.lit(2)), F.lit(""))
    return own.select("row", "key", tx.abbreviated_key(F.col("key")).alias("abbreviated"), F.when(second != "sp", second).otherwise("").alias("epithet"))


def attribute(clusters: DataFrame, rows: DataFrame, cutoff: float | None = 0.9, cluster_col: str = "cluster", name_col: str = "name", accessions_col: str = "accessions", row_col: str = "row") -> DataFrame:
    """(cluster, status, basis, n_rows, first_row) for each cluster: the rows of the first tier that has any.

    Both tables have a name and a cell of accessions. Tiers, each for what the
    ones before it left: a shared accession; the same key, other names
    included; an abbreviated genus on either side; the same epithet in another
    genus; a close spelling in the same genus (none without a cutoff). Only
    usable binomials go beyond the first. Each tier's side of the rows is added
    up by key first, so a key that many rows and clusters share makes no pairs;
    only a cluster that finds rows by several accessions is joined to them.
    """
    c = clusters.select(F.col(f"`{cluster_col}`").alias("cluster"), tx.name_key(F.col(f"`{name_col}`")).alias("key"), tx.accessions(F.col(f"`{accessions_col}`")).alias("acc")).where("cluster IS NOT NULL").dropDuplicates(["cluster"])
    index = name_index(rows, row_col, name_col)
    parts = F.split("key", " ")
    second = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    short = F.when(F.length(parts[0]) == 1, F.col("key")).otherwise(tx.abbreviated_key(F.col("key")))
    c = c.withColumns({"named": tx.name_rank(F.col("key")) == 0, "short": short, "second": second})

    db = rows.select(F.col(f"`{row_col}`").alias("row"), F.explode(tx.accessions(F.col(f"`{accessions_col}`"))).alias("a"))
    shared = count_tiers(c.select("cluster", F.explode("acc").alias("a")), db, "cluster", "row", [("accession", "a", "a")])
    hit = shared.select("cluster", "n_rows", F.col("row").alias("first_row"))
    done = [hit.select("cluster", F.lit("existing").alias("status"), F.lit("accession").alias("basis"), "n_rows", "first_row")]
    left = c.join(hit, "cluster", "left_anti").where("named")
    for status, basis, mine, theirs in (("existing", "species name", "key", "key"), ("existing", "abbreviated genus", "short", "abbreviated"), ("probable", "same epithet, different genus", "second", "epithet")):
        by = index.where(F.col(theirs) != "").groupBy(F.col(theirs).alias("k")).agg(F.count_distinct("row").alias("n_rows"), F.min("row").alias("first_row"))
        done.append(left.join(by, F.col(mine) == F.col("k")).select("cluster", F.lit(status).alias("status"), F.lit(basis).alias("basis"), "n_rows", "first_row"))
        left = left.join(by, F.col(mine) == F.col("k"), "left_anti")
    if cutoff is not None:
        close = close_spellings(left.select("key"), index.where("key <> ''").select("key"), cutoff)
        best = close.groupBy("key").agg(F.min_by("other", "place").alias("best"))
        counted = close.join(index.select(F.col("key").alias("other"), "row"), "other").groupBy("key").agg(F.count_distinct("row").alias("n_rows"), F.min("row").alias("first_row"))
        done.append(left.join(best, "key").join(counted, "key").select("cluster", F.lit("probable").alias("status"), F.concat(F.lit("close spelling to "), "best").alias("basis"), "n_rows", "first_row"))
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return c.select("cluster").join(found, "cluster", "left").select("cluster", F.coalesce("status", F.lit("new")).alias("status"), F.coalesce("basis", F.lit("")).alias("basis"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "first_row")
