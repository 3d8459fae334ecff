"""What the records of a cluster say, put together: names, hosts, places, years, and what kind of entry that makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers import earliest_year
from . import curate

#: Dates in the order in which they stand for a year of description, with fixed labels of where they come from.
YEAR_BASIS = (("publication_years", "publication year"), ("submission_years", "GenBank submission year"), ("collection_years", "sample collection year"), ("record_years", "GenBank record date"))

#: Columns of text that a record may have besides its cluster and place in it; those a table lacks are blank.
RECORD = ("accession", "organism", "host", "lab_host", "locality", "country", "collection_year", "pub_year", "submitted_year", "record_date", "isolation_source", "isolate", "strain", "pubmed", "reference")


def _lists() -> dict[str, tuple[Column, str, bool]]:
    """Of each list: the values of a record, the mark between values, and whether values are sorted by themselves instead of by place."""
    one = lambda *names: F.filter(F.array(*(tx.clean(F.col(n)) for n in names)), lambda v: v != "")
    many = lambda n, comma=False: F.transform(tx.split_multi(F.col(n), comma), tx.clean)
    key = tx.name_key(F.col("organism"))
    return {
        "distinct_species": (F.when(tx.name_rank(key) == 0, F.array(key)).otherwise(F.array().cast("array<string>")), " | ", False),
        "all_names": (one("organism"), " | ", False),
        "hosts": (many("host"), "; ", False),
        "experimental_hosts": (many("lab_host"), "; ", False),
        "localities": (one("locality"), "; ", False),
        "countries": (one("country"), "; ", False),
        "collection_years": (one("collection_year"), "; ", True),
        "publication_years": (one("pub_year"), "; ", True),
        "submission_years": (one("submitted_year"), "; ", True),
        "record_years": (F.filter(F.array(earliest_year(F.col("record_date")).cast("string")), lambda v: v.isNotNull()), "; ", True),
        "isolation_sources": (one("isolation_source"), "; ", False),
        "isolates_strains": (one("isolate", "strain"), "; ", False),
        "pubmed": (many("pubmed", True), ", ", False),
        "references": (one("reference"), " | ", False),
    }


def summarise(records: DataFrame, cluster: str = "cluster", order: str = "ord") -> DataFrame:
    """A row for each cluster: n_members, n_with_host, n_with_locality, species_name, the lists as joined text, accessions, and n_distinct_names, n_binomials, n_hosts, n_countries.

    Lists hold distinct values without regard to case and white space, in
    their first spelling and the order of ``order``; years are sorted, and
    accessions are those of all members. Values are distinct before a cluster
    is put together, so a cluster with a third of all rows brings no more than
    what its row holds. Null cells are blank; records without a cluster are
    passed over; an empty table gives no rows.
    """
    have = {c.lower() for c in records.columns}
    r = records.select(F.col(f"`{cluster}`").alias("cluster"), F.col(f"`{order}`").alias("ord"), *((F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in RECORD)).where("cluster IS NOT NULL")
    lists = _lists()
    placed = lambda field, values: F.transform(values, lambda x, i: F.struct(F.lit(field).alias("field"), i.alias("place"), x.alias("value")))
    each = F.concat(*(placed(f, v) for f, (v, _, _) in lists.items()))
    flat = r.select("cluster", "ord", F.explode(each).alias("x")).select("cluster", "ord", "x.*")
    first = flat.groupBy("cluster", "field", F.lower("value").alias("_fold")).agg(F.min(F.struct("ord", "place", "value")).alias("_f"))
    by_value = F.col("field").isin([f for f, (_, _, s) in lists.items() if s])
    put = F.struct(F.when(by_value, F.col("_f.value")).alias("v"), F.col("_f.ord").alias("o"), F.col("_f.place").alias("p"), F.col("_f.value").alias("value"))
    cells = first.groupBy("cluster", "field").agg(F.transform(F.array_sort(F.collect_list(put)), lambda x: x["value"]).alias("a"))
    joined = cells.groupBy("cluster").agg(
        *(F.max(F.when(F.col("field") == f, F.array_join("a", mark))).alias(f) for f, (_, mark, _) in lists.items()),
        *(F.max(F.when(F.col("field") == f, F.size("a"))).alias(n) for n, f in (("n_distinct_names", "all_names"), ("n_binomials", "distinct_species"), ("n_hosts", "hosts"), ("n_countries", "countries"))),
    )
    names = curate.pick_name(r.select("cluster", "ord", "organism", tx.name_rank(tx.name_key(F.col("organism"))).alias("rank")), "cluster", "organism", "rank", "ord")
    counted = r.groupBy("cluster").agg(
        F.count("*").alias("n_members"), F.count_if(F.col("host") != "").alias("n_with_host"), F.count_if(F.col("locality") != "").alias("n_with_locality"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "accession"))), lambda x: x["accession"]), "; ").alias("accessions"),
    )
    out = counted.join(names.select("cluster", F.col("organism").alias("species_name")).hint("merge"), "cluster", "left").join(joined.hint("merge"), "cluster", "left")
    return out.na.fill("", ["species_name", *lists]).na.fill(0, ["n_distinct_names", "n_binomials", "n_hosts", "n_countries"])


def entry_kind(n_binomials: Column, n_hosts: Column, least_hosts: int = 1) -> tuple[Column, Column]:
    """(kind, reason): a cluster with a binomial is named, one with enough hosts provisional, any other insufficient."""
    kind = F.when(n_binomials >= 1, "named").when(n_hosts >= least_hosts, "provisional").otherwise("insufficient")
    return kind, F.when(kind == "insufficient", "no binomial and no reported host").otherwise("")


def entry_year(first: str | None = None) -> tuple[Column, Column]:
    """(year, basis) of a summary: the first kind of date that has any, ``first`` before all others if given; blank where none has."""
    order = sorted(YEAR_BASIS, key=lambda b: b[0] != first)
    year = F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c, _ in order), F.lit(""))
    basis = F.coalesce(*(F.when(F.trim(F.col(c)) != "", label) for c, label in order), F.lit(""))
    return year, basis
