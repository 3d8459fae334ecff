"""Where the rows of a curated table come from, by the marks in their remarks, and what became of merged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean

# The marks.
CLUSTER_MARK = r"PROVISIONAL SPECIES:\s*defined by 18S sequence cluster"
ADDED_MARK = r"\[ADDED ([0-9]{4}-[0-9]{2}-[0-9]{2})"
TRANSFER_MARK = r"\[TRANSFERRED/ADDED [0-9]{4}-[0-9]{2}-[0-9]{2}"
MERGED_ROWS = r"\[MERGED [0-9]{4}-[0-9]{2}-[0-9]{2}:\s*original rows ([0-9, ]+)\]"
MERGED_NAMES = r"combined records:\s*([^;\]]+)"


def merged_rows(remarks: Column) -> Column:
    """Numbers of the first note 'original rows a, b'."""
    return F.transform(F.regexp_extract_all(F.regexp_extract(remarks, MERGED_ROWS, 1), F.lit("([0-9]+)"), 1), lambda x: x.try_cast("long"))


def merged_names(remarks: Column) -> Column:
    """Names of the first note 'combined records: A | B', blank ones too but for a last one."""
    found = F.regexp_extract(remarks, MERGED_NAMES, 1)
    return F.when(found == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(F.regexp_replace(found, r"\|$", ""), r"\|"), clean))


def _key(c: Column) -> Column:
    return F.lower(clean(c))


def _kept(rows: DataFrame) -> DataFrame:
    return rows.select("row", clean(F.col("name")).alias("name"), clean(F.col("remarks")).alias("remarks")).where("name <> ''")


def carriers(rows: DataFrame, originals: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, row) for each row of originals (name): the row that carries it now, null where there is none.

    The first row of that name without regard to case and white space, else the
    first whose note of combined records has it, else the first of its alias
    (name, current). Blank and null names of originals are left out; repeated
    ones stay. Names are added up before they are joined, so that a name held
    by a third of all rows is one row of the join.
    """
    d = _kept(rows)
    direct = d.groupBy(_key(F.col("name")).alias("key")).agg(F.min("row").alias("direct"))
    noted = d.select("row", F.explode(merged_names(F.col("remarks"))).alias("n")).groupBy(_key(F.col("n")).alias("key")).agg(F.min("row").alias("noted"))
    known = aliases.select(_key(F.col("name")).alias("key"), _key(F.col("current")).alias("current")).groupBy("key").agg(F.min("current").alias("current"))
    renamed = known.join(direct.select(F.col("key").alias("current"), F.col("direct").alias("renamed")), "current").select("key", "renamed")
    o = originals.select(clean(F.col("name")).alias("name")).where("name <> ''").withColumn("key", _key(F.col("name")))
    return o.join(direct, "key", "left").join(noted, "key", "left").join(renamed, "key", "left").select("name", F.coalesce("direct", "noted", "renamed").alias("row"))


def provenance(rows: DataFrame, carried: DataFrame | None, row_limit: int) -> DataFrame:
    """One row for each of rows (row, name, remarks) with a name: its provenance, and what was merged into it.

    carried is what ``carriers`` returns; without it a row is an original by
    its marks alone: neither of a cluster nor added, and not transferred or
    combined with more records than were transferred. An original that has
    another mark counts as original (conflict). Numbers of merged rows up to
    row_limit are those of originals, greater ones of submissions; the row that
    stays is one of them. row is unique; a null remark says nothing.
    """
    d = _kept(rows).withColumns({
        "_cluster": F.col("remarks").rlike("(?i)" + CLUSTER_MARK), "_added": F.col("remarks").rlike(ADDED_MARK),
        "_moved": F.size(F.regexp_extract_all("remarks", F.lit(TRANSFER_MARK), 0)), "_rows": merged_rows(F.col("remarks")), "_n": F.size(merged_names(F.col("remarks"))),
    })
    if carried is None:
        d = d.withColumn("_original", ~F.col("_cluster") & ~F.col("_added") & ((F.col("_moved") == 0) | (F.col("_n") > F.col("_moved"))))
    else:
        mine = carried.select("row").dropna().distinct().withColumn("_original", F.lit(True))
        d = d.join(mine, "row", "left").withColumn("_original", F.coalesce("_original", F.lit(False)))
    what = F.when(F.col("_original"), "original").when(F.col("_cluster"), "genbank_cluster").when(F.col("_added"), "llm_search").when(F.col("_moved") > 0, "publication_submission").otherwise("llm_search_unmarked")
    d = d.withColumn("_a", F.size(F.filter("_rows", lambda r: r <= row_limit))).withColumn("_b", F.size(F.filter("_rows", lambda r: r > row_limit)))
    d = d.withColumn("_b", F.greatest(F.col("_b") - F.when(F.col("_a") == 0, 1).otherwise(0), F.lit(0)))
    d = d.withColumn("_s", F.least("_moved", "_n")).withColumn("_o", F.col("_n") - F.col("_s"))
    some = lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    return d.select(
        "row", what.alias("provenance"), (F.col("_original") & (F.col("_cluster") | F.col("_added"))).alias("conflict"), F.when(what == "llm_search", F.regexp_extract("remarks", ADDED_MARK, 1)).alias("added"),
        some("_o").alias("merged_originals"), (F.when(F.col("_a") > 0, F.col("_b")).otherwise(0) + F.when(F.col("_o") > 0, F.col("_s")).otherwise(0)).alias("into_original"),
        (F.when(F.col("_a") == 0, F.col("_b")).otherwise(0) + F.when(F.col("_o") == 0, some("_s")).otherwise(0)).alias("duplicates"), some("_a").alias("redundant_rows"),
    )


def ledger(found: DataFrame, carried: DataFrame) -> DataFrame:
    """(metric, value): counts that add up from original entries and submissions to the rows there are.

    original entries = retained + merged by a note + consolidated before; rows
    = retained + new submissions + additions + clusters.
    """
    of = lambda *kinds: F.count_if(F.col("provenance").isin(*kinds))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = found.agg(
        F.count("*").alias("rows"), of("original").alias("originals_retained"), total("merged_originals").alias("originals_merged"), of("publication_submission").alias("submissions_new"),
        total("into_original").alias("submissions_into_original"), total("duplicates").alias("submissions_duplicates"), of("llm_search", "llm_search_unmarked").alias("search_additions"), of("genbank_cluster").alias("cluster_additions"), F.count_if("conflict").alias("conflicts"),
    )
    old = carried.agg(F.count("*").alias("original_entries"), F.count_if(F.col("row").isNull()).alias("unaccounted"))
    n = lambda c: F.col(c).cast("long")
    both = one.join(old, F.lit(True)).withColumn("originals_consolidated", n("original_entries") - n("originals_retained") - n("originals_merged"))
    both = both.withColumn("submissions", n("submissions_new") + n("submissions_into_original") + n("submissions_duplicates"))
    return both.select(F.explode(F.create_map(*(x for c in both.columns for x in (F.lit(c), n(c))))).alias("metric", "value"))
