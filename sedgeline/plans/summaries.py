"""Summaries of clusters, and the entries that they make."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summary
from .curation import _RANK
from .queries import _KEYTOK, query
from .views import duck, view

_KEY = f"array_to_string(({_KEYTOK})[1:2], ' ')"
_FOLD = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_MANY = "unnest(string_split_regex(coalesce({}, ''), '{}'))"
#: Of each list: the SQL of a record's values, their mark, and their order.
_SQL_LISTS = {
    "distinct_species": ("k", " | ", "f"), "all_names": ("organism", " | ", "f"), "hosts": (_MANY.format("host", "[;\\n]"), "; ", "f"), "experimental_hosts": (_MANY.format("lab_host", "[;\\n]"), "; ", "f"), "localities": ("locality", "; ", "f"), "countries": ("country", "; ", "f"),
    "publication_years": ("pub_year", "; ", "v"), "submission_years": ("submitted_year", "; ", "v"), "record_years": ("split_part(record_date, '-', 3)", "; ", "v"), "isolates_strains": ("unnest([isolate, strain])", "; ", "f"), "pubmed": (_MANY.format("pubmed", "[;\\n,]"), ", ", "f"),
}


def _list_sql(name: str) -> str:
    values, mark, order = _SQL_LISTS[name]
    source = "(SELECT * FROM m WHERE r = 0) m" if name == "distinct_species" else "m"
    # the place of a value within its record follows from the order in which a list is taken apart
    rows = f"SELECT cluster, v, row_number() OVER (ORDER BY ord, i) AS f FROM (SELECT cluster, ord, unnest(range(len(l))) AS i, unnest(l) AS v FROM (SELECT cluster, ord, list({_FOLD.format('x')}) AS l FROM (SELECT cluster, ord, {values} AS x FROM {source}) GROUP BY 1, 2)) WHERE v <> ''"
    return f"l_{name} AS (SELECT cluster, string_agg(v, '{mark}' ORDER BY {order}) AS {name}, count(*) AS n FROM (SELECT cluster, arg_min(v, f) AS v, min(f) AS f FROM ({rows}) GROUP BY cluster, lower(v)) GROUP BY cluster)"


_M = f"""m AS MATERIALIZED (SELECT *, {_RANK} AS r FROM (SELECT *, string_split(k, ' ') AS t FROM (SELECT *, {_KEY.replace('nm', 'organism')} AS k FROM {duck('members')} b) b) b)"""
_NAME = f"""d AS (SELECT cluster, lower(organism) AS low, min(r) AS r, count(*) AS n, min(ord) AS f, arg_min(organism, ord) AS nm FROM (SELECT cluster, ord, r, {_FOLD.format('organism')} AS organism FROM m) GROUP BY 1, 2),
  s AS (SELECT cluster, nm AS species_name FROM d QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY r, len(string_split(nm, ' ')) > 2, length(nm), -n, f) = 1)"""
_SUMMARY = f"""WITH {_M}, {_NAME}, {', '.join(map(_list_sql, _SQL_LISTS))}, c AS (SELECT cluster, count(*) AS n_members, count(*) FILTER (host <> '') AS n_with_host, count(*) FILTER (locality <> '') AS n_with_locality, string_agg(accession, '; ' ORDER BY ord) AS accessions FROM m GROUP BY cluster),
  q AS (SELECT c.*, species_name, {', '.join(f"coalesce({x}, '') AS {x}" for x in _SQL_LISTS)}, coalesce(l_all_names.n, 0) AS n_distinct_names, coalesce(l_distinct_species.n, 0) AS n_binomials, coalesce(l_hosts.n, 0) AS n_hosts, coalesce(l_countries.n, 0) AS n_countries
    FROM c LEFT JOIN s ON s.cluster = c.cluster {' '.join(f'LEFT JOIN l_{x} ON l_{x}.cluster = c.cluster' for x in _SQL_LISTS)})"""
_BLANK = "'' AS collection_years, '' AS isolation_sources, '' AS \"references\""


@query(f"{_SUMMARY} SELECT *, {_BLANK} FROM q")
def cluster_summaries(spark, sf_dir):
    return summary.summarise(view(spark, sf_dir, "members", dealt=True, merge=True))


@query(
    f"""{_SUMMARY} SELECT cluster, CASE WHEN n_binomials > 0 THEN 'named' WHEN n_hosts > 0 THEN 'provisional' ELSE 'insufficient' END AS kind, CASE WHEN n_binomials = 0 AND n_hosts = 0 THEN 'no binomial and no reported host' ELSE '' END AS reason,
  CASE WHEN publication_years <> '' THEN publication_years WHEN submission_years <> '' THEN submission_years ELSE record_years END AS year, CASE WHEN publication_years <> '' THEN 'publication year' WHEN submission_years <> '' THEN 'GenBank submission year' WHEN record_years <> '' THEN 'GenBank record date' ELSE '' END AS basis FROM q"""
)
def cluster_entries(spark, sf_dir):
    """What kind of entry each cluster is, and its year with where that comes from."""
    s = summary.summarise(view(spark, sf_dir, "members", dealt=True, merge=True))
    kind, reason = summary.entry_kind(F.col("n_binomials"), F.col("n_hosts"))
    year, basis = summary.entry_year()
    return s.select("cluster", kind.alias("kind"), reason.alias("reason"), year.alias("year"), basis.alias("basis"))
