"""Queries of provenance and of what became of merged rows."""

from __future__ import annotations

from ..operators import provenance as pv
from .queries import query
from .views import duck, view

_LIMIT = 1440
_CLEAN = "trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
_BASE = rf"""d AS MATERIALIZED (SELECT row, name, lower(name) AS key, r, string_split(regexp_replace(regexp_extract(r, '{pv.MERGED_NAMES}', 1), '\|$', ''), '|') AS names, regexp_matches(r, '{pv.MERGED_NAMES}') AS noted
  FROM (SELECT row, {_CLEAN.format(c='name')} AS name, {_CLEAN.format(c='remarks')} AS r FROM {duck('noted')} q) q WHERE name <> ''),
c AS MATERIALIZED (SELECT o.name, coalesce((SELECT min(row) FROM d WHERE d.key = o.key), (SELECT min(row) FROM (SELECT row, {_CLEAN.format(c='lower(unnest(names))')} AS n FROM d WHERE noted) n WHERE n.n = o.key), (SELECT min(row) FROM d JOIN {duck('aliases')} a ON d.key = lower(a.current) WHERE lower(a.name) = o.key)) AS row
  FROM (SELECT {_CLEAN.format(c='name')} AS name, lower({_CLEAN.format(c='name')}) AS key FROM {duck('originals')} q) o),
m AS (SELECT row, row IN (SELECT row FROM c WHERE row IS NOT NULL) AS o, regexp_matches(r, '(?i){pv.CLUSTER_MARK}') AS cl, regexp_matches(r, '{pv.ADDED_MARK}') AS ad, len(regexp_extract_all(r, '{pv.TRANSFER_MARK}')) AS t, CASE WHEN noted THEN len(names) ELSE 0 END AS n, r,
  [v::BIGINT FOR v IN regexp_extract_all(regexp_extract(r, '{pv.MERGED_ROWS}', 1), '[0-9]+')] AS v FROM d),
k AS (SELECT *, CASE WHEN o THEN 'original' WHEN cl THEN 'genbank_cluster' WHEN ad THEN 'llm_search' WHEN t > 0 THEN 'publication_submission' ELSE 'llm_search_unmarked' END AS what, len([x FOR x IN v IF x <= {_LIMIT}]) AS a, len([x FOR x IN v IF x > {_LIMIT}]) AS b FROM m),
f AS MATERIALIZED (SELECT row, what AS provenance, o AND (cl OR ad) AS conflict, CASE WHEN what = 'llm_search' THEN regexp_extract(r, '{pv.ADDED_MARK}', 1) END AS added, greatest(n - t - 1, 0) AS merged_originals,
  CASE WHEN a > 0 THEN b ELSE 0 END + CASE WHEN n > t THEN t ELSE 0 END AS into_original, CASE WHEN a = 0 THEN greatest(b - 1, 0) ELSE 0 END + CASE WHEN n <= t THEN greatest(n - 1, 0) ELSE 0 END AS duplicates, greatest(a - 1, 0) AS redundant_rows FROM k)"""


def _tables(spark, sf_dir):
    rows = view(spark, sf_dir, "noted")
    carried = pv.carriers(rows, view(spark, sf_dir, "originals"), view(spark, sf_dir, "aliases"))
    return carried, pv.provenance(rows, carried, _LIMIT)


@query(f"WITH {_BASE} SELECT name, row FROM c")
def original_carriers(spark, sf_dir):
    return _tables(spark, sf_dir)[0]


@query(f"WITH {_BASE} SELECT * FROM f")
def row_provenance(spark, sf_dir):
    return _tables(spark, sf_dir)[1]


@query(
    f"""WITH {_BASE}, s AS (SELECT count(*) AS rows, count(*) FILTER (provenance = 'original') AS kept, sum(merged_originals) AS merged, count(*) FILTER (provenance = 'publication_submission') AS fresh, sum(into_original) AS into_o, sum(duplicates) AS dup,
  count(*) FILTER (provenance LIKE 'llm%') AS search, count(*) FILTER (provenance = 'genbank_cluster') AS cl, count(*) FILTER (conflict) AS bad FROM f), e AS (SELECT count(*) AS entries, count(*) - count(row) AS lost FROM c)
SELECT unnest(['rows', 'originals_retained', 'originals_merged', 'submissions_new', 'submissions_into_original', 'submissions_duplicates', 'search_additions', 'cluster_additions', 'conflicts', 'original_entries', 'unaccounted', 'originals_consolidated', 'submissions']) AS metric,
  unnest([rows, kept, merged, fresh, into_o, dup, search, cl, bad, entries, lost, entries - kept - merged, fresh + into_o + dup])::BIGINT AS value FROM s, e"""
)
def merge_ledger(spark, sf_dir):
    carried, found = _tables(spark, sf_dir)
    return pv.ledger(found, carried)
