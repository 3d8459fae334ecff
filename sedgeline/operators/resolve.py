"""Votes of disagreeing sources, ownership, tiered matching and write-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..scratch import Scratch


def vote(claims: DataFrame, key: str, value: str, source: str, order: str) -> DataFrame:
    """(key, winner, votes, agree, dissent, tied): the value of most sources; of equals the one of the earliest source; blank values don't vote."""
    cast = claims.where(F.coalesce(F.col(value), F.lit("")) != "")
    by_value = cast.groupBy(key, value).agg(F.count("*").alias("votes"), F.min(order).alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, source))), lambda s: s[source]), "; ").alias("sources"))
    w = Window.partitionBy(key)
    ranked = by_value.withColumn("rank", F.row_number().over(w.orderBy(F.desc("votes"), "first"))).withColumn("most", F.max("votes").over(w))
    return ranked.groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.col(value))).alias("winner"), F.max("votes").alias("votes"),
        F.max(F.when(F.col("rank") == 1, F.col("sources"))).alias("agree"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("first", "sources")))), lambda s: s["sources"]), "; ").alias("dissent"),
        (F.count_if(F.col("votes") == F.col("most")) > 1).alias("tied"),
    )


def ownership(shared: DataFrame, row: str, cluster: str, accession_pos: str) -> DataFrame:
    """The cluster that owns each row: most shared accessions; of equals the one with the first-listed accession."""
    n = shared.groupBy(row, cluster).agg(F.count("*").alias("n_shared"), F.min(accession_pos).alias("first_pos"))
    w = Window.partitionBy(row).orderBy(F.desc("n_shared"), "first_pos", cluster)
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _tiers(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[tuple[str, str, str]], scratch: Scratch) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """(ids of one key, ids of several, rows) by tier, each (id, _k) and distinct; left ids are those that no earlier tier hits."""
    keyed = lambda t, i, c: t.where(F.coalesce(F.col(c), F.lit("")) != "").select(F.col(i), F.col(c).alias("_k")).distinct()
    sides = lambda t, i, cols: scratch.save(t.select(i, *(c for c in dict.fromkeys(cols) if c != i)), "keys")
    left, right = sides(left, left_id, [lk for _, lk, _ in tiers]), sides(right, right_id, [rk for _, _, rk in tiers])
    out, done = [], None
    for _, lk, rk in tiers:
        b = keyed(right, right_id, rk)
        a = keyed(left, left_id, lk).join(b.select("_k").distinct(), "_k", "left_semi").select(left_id, "_k")
        if done is not None:
            a = a.join(done, left_id, "left_anti")
        a = scratch.save(a.withColumn("_n", F.count("*").over(Window.partitionBy(left_id))), "hit")
        done = a.select(left_id).distinct() if done is None else done.union(a.select(left_id).distinct())
        out.append((a.where("_n = 1").drop("_n"), a.where("_n > 1").drop("_n"), b))
    return out


def match_tiers(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[tuple[str, str, str]]) -> DataFrame:
    """Matches by the first tier that hits, for each left id.

    tiers: (name, left key column, right key column) in order; a blank key
    doesn't match. Keys are looked up first, so that each tier joins only the
    left ids that it decides, and no pair is made that isn't returned.
    """
    found = None
    for i, (one, many, b) in enumerate(_tiers(left, right, left_id, right_id, tiers, Scratch(left.sparkSession, "tiers"))):
        # an id of one key meets a row once; by several keys it may meet it again
        hits = one.join(b, "_k").select(left_id, right_id).union(many.join(b, "_k").select(left_id, right_id).distinct())
        hits = hits.select(left_id, right_id, F.lit(i + 1).alias("tier"), F.lit(tiers[i][0]).alias("basis"))
        found = hits if found is None else found.union(hits)
    return found


def count_tiers(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[tuple[str, str, str]]) -> DataFrame:
    """(left id, n_rows, right id, basis): match_tiers counted, with its least right id.

    Rows are added up by key before they meet an id of one key; only ids of
    several keys in a tier make pairs, since their keys may share rows.
    """
    found = None
    for i, (one, many, b) in enumerate(_tiers(left, right, left_id, right_id, tiers, Scratch(left.sparkSession, "tiers"))):
        by_key = b.groupBy("_k").agg(F.count(right_id).alias("n_rows"), F.min(right_id).alias(right_id))
        hits = one.join(by_key, "_k").select(left_id, "n_rows", right_id)
        hits = hits.union(many.join(b, "_k").groupBy(left_id).agg(F.countDistinct(right_id).alias("n_rows"), F.min(right_id).alias(right_id)))
        hits = hits.withColumn("basis", F.lit(tiers[i][0]))
        found = hits if found is None else found.union(hits)
    return found


def one_edit(names: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b) of distinct names one edit apart.

    Names share a deletion neighbour or are one: each name is joined by itself
    and its forms with one character out, so no pair is compared that isn't near.
    """
    n = names.select(F.col(name).alias("a")).distinct()
    forms = F.concat(F.array("a"), F.transform(F.sequence(F.lit(1), F.greatest(F.length("a"), F.lit(1))), lambda i: F.concat(F.left(F.col("a"), i - 1), F.substr(F.col("a"), i + 1, F.length("a")))))
    keyed = n.select("a", F.explode(F.array_distinct(forms)).alias("_k"))
    other = keyed.select(F.col("a").alias("b"), "_k")
    return keyed.join(other, "_k").where("a < b").select("a", "b").distinct().where(F.levenshtein("a", "b") == 1)


def append_values(current: Column, new: Column) -> Column:
    """Values of ``new`` that ``current`` lacks, without regard to case, after those it has."""
    lacks = lambda have: F.filter(new, lambda v: ~F.array_contains(have, F.lower(v)))
    return F.concat(current, tx.once(F.transform(current, lambda x: F.lower(x)), lacks))


def novel_values(new: Column, known: Column) -> Column:
    """Values that neither contain a known one nor lie within one."""
    return F.filter(new, lambda v: ~F.exists(known, lambda k: F.lower(k).contains(F.lower(v)) | F.lower(v).contains(F.lower(k))))


def carry_forward(cells: DataFrame, cell: str, pos: str, key: str, value: str, out: str) -> DataFrame:
    """The first value of the key earlier in the cell, such as the genus that an initial stands for."""
    w = Window.partitionBy(cell, key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn(out, F.first(value, ignorenulls=True).over(w))


def write_back(updates: DataFrame, rows: DataFrame, update: str, row: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(matched, review) of updates to rows: by the first key that hits any row; more than one row goes to review, as does none.

    matched: update, row, basis. review: update, n_rows, reason.
    """
    n = count_tiers(updates, rows, update, row, [(k, k, k) for k in keys])
    n = updates.select(update).distinct().join(n, update, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))
    review = n.where("n_rows <> 1").select(update, "n_rows", F.when(F.col("n_rows") == 0, "no row").otherwise("ambiguous").alias("reason"))
    return n.where("n_rows = 1").select(update, row, "basis"), review


def disposition(n_rows: Column, kind: Column, is_new: Column) -> Column:
    """What becomes of a cluster: known, ambiguous, new, provisional or left out."""
    return (
        F.when(n_rows == 1, F.when(is_new, "update").otherwise("already there"))
        .when(n_rows > 1, "ambiguous")
        .when(kind == "named", "new")
        .when(kind == "provisional", "provisional")
        .otherwise("insufficient")
    )


def mixture_cause(genera: Column, epithets: Column, names: Column) -> Column:
    """Why a cluster holds several names, from its counts of distinct genera, epithets and names."""
    return (
        F.when(names <= 1, "pure")
        .when(genera > 1, F.when(epithets == 1, "same epithet in other genera").otherwise("several genera"))
        .when(epithets > 1, "several species of one genus")
        .otherwise("spelling")
    )
