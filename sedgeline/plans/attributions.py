"""Queries that put clusters and names to rows of a curated table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import attribution as at
from ..operators.components import canonical_names
from .queries import _ABBR, _KEYTOK, _UNINF, QUERIES, _table, query
from .views import duck, view

_ACC = r"list_distinct(list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace(upper({c}), '\b([A-Z]{{1,4}})\s+([0-9]{{5,}})', '\1\2', 'g'), '[,;/|\s]+'), lambda x: regexp_replace(regexp_replace(x, '^[()\[\].]+|[()\[\].]+$', '', 'g'), '\.[0-9]+$', '')), lambda x: regexp_full_match(x, '[A-Z]{{1,6}}_?[0-9]{{5,12}}')), lambda x: replace(x, '_', '')))"
_LEAD = tx.SYNONYM_LEAD
_WORDS = "list_filter(regexp_split_to_array(regexp_replace(strip_accents({x}), '[^A-Za-z\\s.]', ' ', 'g'), '\\s+'), lambda t: t <> '')"


def _keyed(frm: str) -> str:
    """Rows of nm with the key k and its words t."""
    return f"(SELECT *, array_to_string(tok[1:2], ' ') AS k, tok[1:2] AS t FROM (SELECT *, {_KEYTOK} AS tok FROM {frm}) q)"


_ALL_KEYS = f"""
raw AS MATERIALIZED (SELECT row, name, accessions FROM {duck('curated')} q),
alt AS (
  SELECT row, {_WORDS.format(x=f"regexp_replace(trim(unnest(regexp_extract_all(name, '\\(([^)]*)\\)', 1))), '{_LEAD}', '')")} AS w, false AS sp FROM raw
  UNION ALL SELECT row, {_WORDS.format(x='p')} AS w, true FROM (SELECT row, unnest(regexp_split_to_array(regexp_replace(name, '\\([^)]*\\)', ' ', 'g'), '{tx.SYNONYM_BREAK}')[2:]) AS p FROM raw)),
every AS (SELECT row, name AS nm FROM raw UNION ALL SELECT row, w[1] || ' ' || w[2] FROM alt WHERE len(w) >= 2 AND length(w[1]) > 2 AND regexp_matches(w[1], '^[A-Z]') AND regexp_matches(w[2], '^[a-z]') AND (sp OR rtrim(w[2], '.') NOT IN ('sp', 'spp'))),
ix AS MATERIALIZED (SELECT DISTINCT row, k, {_ABBR} AS ab, CASE WHEN len(t) = 2 AND t[2] <> 'sp' THEN t[2] ELSE '' END AS ep FROM {_keyed('every')} q WHERE k <> '')"""


@query(f"WITH {_ALL_KEYS} SELECT row, k AS key, ab AS abbreviated, ep AS epithet FROM ix")
def name_index(spark, sf_dir):
    return at.name_index(view(spark, sf_dir, "curated"))


@query(
    f"""WITH {_ALL_KEYS},
cl AS MATERIALIZED (SELECT *, NOT (k = '' OR regexp_matches(k, '{_UNINF}')) AND t[1] <> 'sp' AND len(t) >= 2 AND t[2] <> 'sp' AND NOT regexp_full_match(t[2], '[0-9]+') AS named, {_ABBR} AS ab FROM {_keyed(f"(SELECT cluster, name AS nm, accessions FROM {duck('found')} q)")} q),
hits AS (
  SELECT c.cluster, 1 AS tier, r.row FROM (SELECT cluster, unnest({_ACC.format(c='accessions')}) AS a FROM cl) c JOIN (SELECT row, unnest({_ACC.format(c='accessions')}) AS a FROM raw) r ON c.a = r.a
  UNION SELECT cluster, 2, row FROM cl JOIN ix ON cl.k = ix.k WHERE named
  UNION SELECT cluster, 3, row FROM cl JOIN ix ON CASE WHEN length(t[1]) = 1 THEN cl.k ELSE cl.ab END = ix.ab WHERE named AND ix.ab <> ''
  UNION SELECT cluster, 4, row FROM cl JOIN ix ON cl.t[2] = ix.ep WHERE named AND ix.ep <> ''),
b AS (SELECT cluster, tier, count(*) AS n, min(row) AS f FROM hits GROUP BY cluster, tier QUALIFY tier = min(tier) OVER (PARTITION BY cluster))
SELECT cl.cluster, CASE WHEN tier IS NULL THEN 'new' WHEN tier < 4 THEN 'existing' ELSE 'probable' END AS status, CASE tier WHEN 1 THEN 'accession' WHEN 2 THEN 'species name' WHEN 3 THEN 'abbreviated genus' WHEN 4 THEN 'same epithet, different genus' ELSE '' END AS basis, coalesce(n, 0) AS n_rows, f AS first_row
FROM cl LEFT JOIN b ON cl.cluster = b.cluster"""
)
def attributions(spark, sf_dir):
    """The tiers that SQL can say; close_spellings has the last one."""
    return at.attribute(view(spark, sf_dir, "found"), view(spark, sf_dir, "curated"), cutoff=None)


def close_spellings(spark, sf_dir):
    """Keys of every fiftieth row against all keys. SQL has no ratio of matching blocks; tests hold it against all pairs."""
    keys = view(spark, sf_dir, "spellings")
    return at.close_spellings(keys.where("id % 50 = 0"), keys)


QUERIES["close_spellings"] = close_spellings

_PAIRS = "SELECT DISTINCT 'n' || CAST(l_partkey AS STRING) AS a, 'n' || CAST(l_partkey + l_linenumber * 3 AS STRING) AS b FROM {lineitem} WHERE l_quantity = 7"


@query(
    f"""WITH RECURSIVE p AS MATERIALIZED ({_PAIRS.replace('{lineitem}', 'lineitem')}), e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(name, o) AS (SELECT a, a FROM e UNION SELECT r.name, e.b FROM r JOIN e ON r.o = e.a) SELECT name, min(o) AS canonical FROM r GROUP BY name"""
)
def synonym_names(spark, sf_dir):
    lines = spark.sql(_PAIRS, lineitem=_table(spark, sf_dir, "lineitem"))
    return canonical_names(lines.select(F.array("a", "b").alias("names")))
