"""Queries of host cells, agreement of names and resolution of hosts; the SQL goes by fragments, stage by stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hosts as hs
from ..functions.terms import PHYLUM_ALIASES
from ..operators import resolve_hosts as rh
from .queries import query
from .views import duck, view


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _clean(x: str) -> str:
    """SQL of clean_epithet."""
    for pattern, to in ((r"(?i)\b(?:sp|spp)\.?\s*(?:nov\.?)?\s*\d*$", "sp."), (r"(?i)\b(?:cf|aff|nr)\.?\s+", ""), (r"(?i)\s+(?:sensu lato|s\.l\.|sensu stricto|s\.s\.)$", ""), (hs.AUTHOR_YEAR, "")):
        x = f"regexp_replace({x}, {_sql(pattern)}, {_sql(to)}, 'g')"
    return f"trim({x})"


def _cleaned(x: str) -> str:
    return _clean(f"trim(regexp_replace(strip_accents({x}), '\\s+', ' ', 'g'), ' .,;:')")


def _repair(have: str, frm: str, more: str) -> str:
    """SQL of repair_name and of the rank of what it gives."""
    return f"""(SELECT *, list_filter(string_split_regex(name, '\\s+'), lambda t: t <> '') AS toks FROM (
  SELECT * EXCLUDE (n4, note4, up, low), CASE WHEN up AND low NOT IN ('sp', 'spp') THEN regexp_extract(n4, {_sql(hs.RAISED_EPITHET)}, 1) || ' ' || low ELSE n4 END AS name,
    array_to_string(list_filter(note4 || [CASE WHEN up AND low NOT IN ('sp', 'spp') THEN 'epithet decapitalised' ELSE '' END], lambda t: t <> ''), '; ') AS repair FROM (
  SELECT * EXCLUDE (n3, note3), regexp_matches(n4, {_sql(hs.RAISED_EPITHET)}) AS up, lower(regexp_extract(n4, {_sql(hs.RAISED_EPITHET)}, 2)) AS low FROM (
  SELECT *, regexp_replace(n3, {_sql(hs.SHORT_MIDDLE)}, '\\1 \\2') AS n4, note3 || [CASE WHEN regexp_matches(n3, {_sql(hs.SHORT_MIDDLE)}) THEN 'abbreviated subspecies dropped' ELSE '' END] AS note4 FROM (
  SELECT * EXCLUDE (n2, note2), regexp_replace(n2, {_sql(hs.AGGREGATE)}, '\\1') AS n3, note2 || [CASE WHEN regexp_matches(n2, {_sql(hs.AGGREGATE)}) THEN 'aggregate reduced to first name' ELSE '' END] AS note3 FROM (
  SELECT * EXCLUDE (n1, note1), regexp_replace(n1, {_sql(hs.JOINED_INITIAL)}, '\\1. \\2') AS n2, note1 || [CASE WHEN regexp_matches(n1, {_sql(hs.JOINED_INITIAL)}) THEN 'missing space after initial' ELSE '' END] AS note2 FROM (
  SELECT * EXCLUDE (t0, t1), array_to_string(t1, ' ') AS n1, [CASE WHEN t0 <> t1 THEN 'confusable letter' ELSE '' END] AS note1 FROM (
  SELECT *, list_transform(t0, lambda t, i: CASE WHEN i = 1 THEN t WHEN regexp_full_match(t, '[IO][a-z-]{{2,}}') THEN translate(t[1], 'IO', 'lo') || t[2:] ELSE regexp_replace(t, '([a-z])I([a-z])', '\\1l\\2', 'g') END) AS t1 FROM (
  SELECT *, list_filter(string_split_regex({have}, '\\s+'), lambda t: t <> '') AS t0{more} FROM {frm}))))))))) r"""


_RANK = "CASE WHEN len(toks) >= 2 AND lower(toks[2]) IN ('sp.', 'sp', 'spp.', 'spp') THEN 'genus' WHEN len(toks) >= 2 AND regexp_full_match(toks[2], '[a-z-]+') THEN 'species' WHEN len(toks) = 1 AND regexp_full_match(toks[1], '[A-Z][a-z]+') THEN 'genus' ELSE 'other' END"
_LOOKUP = "CASE rank WHEN 'species' THEN toks[1] || ' ' || toks[2] WHEN 'genus' THEN toks[1] ELSE name END"
_DESCRIBED = f"base <> '' AND (NOT regexp_matches(base, '^\\p{{Lu}}') OR regexp_matches(base, {_sql(hs.DESCRIPTION)}))"

_HOSTS = f"""
WITH p AS (SELECT id, unnest(string_split(cell, ';')) AS part, generate_subscripts(string_split(cell, ';'), 1) AS i FROM {duck('host_cells')} q),
f AS (SELECT *, list_filter(list_transform(string_split(part, ','), lambda x: trim(x)), lambda x: x <> '') AS fs FROM p WHERE trim(part) <> ''),
g AS (SELECT *, CASE WHEN contains(part, ',') AND len(list_filter(fs, lambda x: regexp_matches(x, {_sql(hs.BINOMIAL_FIRST)}))) >= 2 AND len(list_filter(fs, lambda x: regexp_matches(x, {_sql(hs.YEAR_ONLY)}))) = 0 THEN fs ELSE [part] END AS fr FROM f),
r AS (SELECT id, i, generate_subscripts(fr, 1) AS j, trim(unnest(fr)) AS raw FROM g),
a AS MATERIALIZED (
  SELECT *, list_transform(list_transform(regexp_extract_all(raw, '\\(([^)]*)\\)', 1), lambda x: trim(x)), lambda x: {{'t': x, 'k':
    CASE WHEN regexp_matches(x, {_sql(hs.SYNONYM)}) THEN 's' WHEN regexp_matches(x, {_sql(hs.CONTEXT)}) OR regexp_matches(x, {_sql(hs.CONTEXT_WORD)}) THEN 'c' WHEN regexp_matches(x, {_sql(hs.ROLE)}) THEN 'r' WHEN regexp_matches(x, '^[A-Z][a-z]+ [a-z-]+') THEN 'n' ELSE '' END}}) AS ins,
    regexp_matches(raw, {_sql(hs.SUBGENUS)}) AS sub FROM r WHERE raw <> ''),
b AS (
  SELECT *, coalesce(list_filter(ins, lambda x: x.k = 'r')[1].t, '') AS role0, list_filter(ins, lambda x: x.k = 'c') AS cs,
    list_filter(list_transform(ins, lambda x: CASE x.k WHEN 's' THEN {_cleaned(f"regexp_extract(x.t, {_sql(hs.SYNONYM)}, 1)")} WHEN 'r' THEN {_cleaned("regexp_extract(x.t, '\\b([A-Z][a-z]+ [a-z-]{3,})', 1)")} WHEN 'n' THEN {_cleaned('x.t')} ELSE '' END), lambda x: x <> '') AS syn,
    regexp_extract(raw, {_sql(hs.SUBGENUS)}, 2) AS subgenus, CASE WHEN sub THEN trim(regexp_replace(raw, {_sql(hs.SUBGENUS)}, '\\1 \\3')) ELSE raw END AS use FROM a),
c AS (
  SELECT *, regexp_extract(use, {_sql(hs.BARE_CONTEXT)}, 0) AS bare, coalesce(list_filter(list_transform(cs, lambda x: regexp_extract(x.t, {_sql(hs.BINOMIAL_IN)}, 0)), lambda x: x <> '')[-1], '') AS inner_host FROM b),
d AS (
  SELECT *, lower(role0) AS role, CASE WHEN inner_host <> '' THEN regexp_replace(inner_host, '\\s+', ' ') ELSE regexp_extract(use, {_sql(hs.BARE_CONTEXT)}, 1) END AS secondary_organism,
    CASE WHEN len(cs) > 0 AND cs[-1].t <> '' THEN lower(cs[-1].t) ELSE lower(trim(bare)) END AS context, left(use, length(use) - length(bare)) AS kept FROM c),
e AS (SELECT *, trim({_cleaned("regexp_replace(kept, '\\([^)]*\\)', ' ', 'g')")}, ' "''') AS base FROM d),
k AS MATERIALIZED (SELECT *, {_DESCRIBED} AS described FROM e WHERE ({_DESCRIBED}) OR (base <> '' AND NOT regexp_matches(base, {_sql(hs.NO_TAXON)}))),
u AS MATERIALIZED (SELECT *, CASE WHEN NOT described AND rank <> 'other' THEN string_split({_LOOKUP}, ' ')[1] END AS genus FROM (SELECT *, {_RANK} AS rank FROM {_repair('base', 'k', '')}) q),
v AS (SELECT * EXCLUDE (name, repair, toks, rank, genus), first(genus IGNORE NULLS) OVER (PARTITION BY id, base[1] ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM u),
w AS MATERIALIZED (SELECT * EXCLUDE (base), CASE WHEN seen IS NOT NULL AND regexp_matches(base, {_sql(hs.INITIAL)}) THEN seen || ' ' || regexp_extract(base, {_sql(hs.INITIAL)}, 2) ELSE base END AS base FROM v),
z AS (SELECT *, {_RANK} AS rank FROM {_repair('base', 'w', '')})
SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, j) AS pos, raw, CASE WHEN described THEN '' ELSE {_LOOKUP} END AS name, CASE WHEN described THEN 'unidentified' ELSE rank END AS rank, role,
  CASE WHEN described THEN '' ELSE array_to_string(syn, '|') END AS synonyms, secondary_organism, context, subgenus, CASE WHEN described THEN '' ELSE repair END AS repair FROM z
"""


@query(_HOSTS)
def host_cells(spark, sf_dir):
    """Outer, since Spark would parse each cell a second time, and before its rows are dealt, to drop those that give nothing."""
    rows = hs.parse_host_cells(view(spark, sf_dir, "host_cells")).select("id", F.posexplode_outer("hosts").alias("pos", "h")).where("h IS NOT NULL")
    h = F.col("h")
    return rows.select("id", (F.col("pos") + 1).cast("long").alias("pos"), *(h[c].alias(c) for c in ("raw", "name", "rank", "role")), F.array_join(h["synonyms"], "|").alias("synonyms"), *(h[c].alias(c) for c in ("secondary_organism", "context", "subgenus", "repair")))


def _stem(x: str) -> str:
    cut = f"regexp_replace({x}, '{hs.GENDER_END}', '')"
    return f"(CASE WHEN length({cut}) >= 3 THEN {cut} ELSE {x} END)"


def _edits(a: str, b: str) -> str:
    return f"(CASE WHEN abs(length({a}) - length({b})) > 2 THEN 99 ELSE levenshtein({a}, {b}) END)"


_AGREES = f"""
j0 AS MATERIALIZED (SELECT *, trim(coalesce(returned, '')) AS ret, list_filter(string_split(regexp_replace(strip_accents(coalesce(asked, '')), '[^A-Za-z ]', ' ', 'g'), ' '), lambda t: t <> '') AS q,
    list_filter(string_split_regex(regexp_replace(regexp_replace(strip_accents(trim(coalesce(returned, ''))), '\\([^)]*\\)', ' ', 'g'), {_sql(hs.AUTHORITY)}, ''), '\\s+'), lambda t: t <> '') AS r FROM {duck('answers')} a),
j1 AS (SELECT *, coalesce(q[1], '') AS qg, coalesce(r[1], '') AS rg, coalesce(q[2], '') AS qe, CASE WHEN regexp_full_match(coalesce(r[2], ''), '[a-z][a-z-]+') THEN r[2] ELSE '' END AS re FROM j0),
j2 AS (SELECT *, {_edits('lower(qg)', 'lower(rg)')} AS d, least(length(qg), length(rg)) >= 6 AS long, {_edits('lower(qe)', 'lower(re)')} AS de FROM j1),
j AS MATERIALIZED (SELECT *, ret = '' OR len(q) = 0 OR len(r) = 0 AS blank, d > CASE WHEN long THEN 1 ELSE 0 END AS far,
    rank = 'species' AND qe <> '' AND re <> '' AND lower(qe) <> lower(re) AND {_stem('lower(qe)')} <> {_stem('lower(re)')} AND de > CASE WHEN least(length(qe), length(re)) >= 6 THEN 2 ELSE 1 END AS wrong FROM j2),
y AS MATERIALIZED (SELECT *, CASE WHEN blank THEN true WHEN far AND d <= 2 AND long THEN NULL WHEN far OR wrong THEN false ELSE true END AS agrees,
    CASE WHEN blank THEN '' WHEN far AND d <= 2 AND long THEN 'genus differs by ' || d || ': asked ' || qg || ', got ' || rg WHEN far THEN 'genus differs: asked ' || qg || ', got ' || rg WHEN wrong THEN 'epithet differs: asked ' || qe || ', got ' || re ELSE '' END AS reason FROM j)
"""


@query("WITH" + _AGREES + "SELECT host, cand, source, asked, returned, agrees, reason FROM y")
def name_agreement(spark, sf_dir):
    a = view(spark, sf_dir, "answers", dealt=True).withColumn("a", hs.name_agrees(F.col("asked"), F.trim(F.coalesce("returned", F.lit(""))), F.col("rank")))
    return a.select("host", "cand", "source", "asked", "returned", "a.agrees", "a.reason")


_TWO = "array_to_string(list_filter(string_split(regexp_replace(lower({x}), '[^a-z ]', '', 'g'), ' '), lambda t: t <> '')[1:2], ' ')"
_R = ", ".join(f'"{r}"' for r in rh.RANKS)
_ALIASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PHYLUM_ALIASES.items())
_VOTE = """SELECT host, arg_max(v, (n, -f)) AS top, max(n) AS most FROM (SELECT host, v, count(*) AS n, min(ord) AS f FROM {t} WHERE {raw} <> '' GROUP BY host, v) GROUP BY host"""

_RESOLVED = f"""
WITH {_AGREES},
k0 AS (SELECT *, agrees IS NOT TRUE AND coalesce(match_type, '') = 'free_text' AND ret <> '' AS vern, lower("kingdom") IN ({', '.join(f"'{k}'" for k in rh.IMPLAUSIBLE)}) AS bad FROM y),
k1 AS (SELECT *, (vern OR agrees IS TRUE) AND NOT bad AS acc, agrees IS NULL AND NOT vern AS prov, CASE WHEN vern OR agrees THEN CASE WHEN bad THEN 'kingdom ' || "kingdom" || ' is not a microsporidian host' ELSE '' END ELSE reason END AS why FROM k0),
k2 AS (SELECT *, min(CASE WHEN acc THEN cand END) OVER (PARTITION BY host) AS lst FROM k1),
k3 AS (SELECT *, row_number() OVER (PARTITION BY host, source ORDER BY acc DESC, cand, ord, ret) AS o, {_TWO.format(x='ret')} AS key FROM k2 WHERE lst IS NULL OR cand <= lst),
k4 AS (SELECT *, prov AND key <> '' AND count(*) FILTER (acc OR prov) OVER (PARTITION BY host, key) >= 2 AS backed FROM k3 WHERE o = 1),
s AS MATERIALIZED (SELECT *, acc OR backed AS yes, CASE WHEN lower("phylum") IN ('myzozoa', 'miozoa') THEN CASE WHEN lower("class") IN ({', '.join(f"'{c}'" for c in rh.APICOMPLEXAN_CLASSES)}) OR lower("order") IN ({', '.join(f"'{c}'" for c in rh.APICOMPLEXAN_ORDERS)}) THEN 'Apicomplexa' ELSE "phylum" END ELSE CASE lower("phylum") {_ALIASES} ELSE "phylum" END END AS normal,
    {' + '.join(f'''CAST("{r}" <> '' AS INTEGER)''' for r in rh.RANKS)} AS filled FROM k4),
vp AS ({_VOTE.format(t='(SELECT *, normal AS v FROM s WHERE yes)', raw='"phylum"')}),
vo AS ({_VOTE.format(t='(SELECT *, "order" AS v FROM s WHERE yes)', raw='"order"')}),
tp AS (SELECT host, count(*) > 1 AS tied FROM (SELECT host, normal, count(*) AS n FROM s WHERE yes AND "phylum" <> '' GROUP BY 1, 2) JOIN vp USING (host) WHERE n = most GROUP BY host),
b AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.host ORDER BY NOT (coalesce(top, '') = '' OR "phylum" IN ('', top)), filled DESC, ord) AS bo FROM s LEFT JOIN vp ON s.host = vp.host WHERE yes) WHERE bo = 1),
g AS (
  SELECT s.host, count(*) FILTER (yes) AS n, coalesce(string_agg(source, ';' ORDER BY ord) FILTER (yes), '') AS found, coalesce(string_agg(source || '(' || ret || ': ' || why || ')', ';' ORDER BY ord) FILTER (NOT yes), '') AS rejected, count(*) FILTER (NOT yes) AS n_no,
    count(*) FILTER (yes AND "phylum" <> '') AS n_vote, count(*) FILTER (yes AND "phylum" <> '' AND normal <> vp.top) AS n_lost, coalesce(string_agg(source || ':' || normal, ';' ORDER BY ord) FILTER (yes AND "phylum" <> '' AND normal <> vp.top), '') AS lost,
    coalesce(string_agg(source || ':' || "order", ';' ORDER BY ord) FILTER (yes AND "order" <> '' AND "order" <> vo.top), '') AS o_lost, bool_or(vern AND yes) AS vern, bool_or(backed) AS backed
  FROM s LEFT JOIN vp ON s.host = vp.host LEFT JOIN vo ON s.host = vo.host GROUP BY s.host),
h AS (SELECT g.*, coalesce(tied, false) AS tied, length(trim(g.host)) >= 4 AND regexp_full_match(trim(g.host), '[A-Z][a-z-]+(\\s+[a-z-]+)?') AS taxon FROM g LEFT JOIN tp ON g.host = tp.host),
m AS (SELECT h.*, taxon AND h.n > 0 AND NOT tied AS use, b.source AS bs, b.filled AS bf, b.asked AS ba, b.ret AS br, {', '.join(f'b."{r}" AS b_{r}' for r in rh.RANKS)} FROM h LEFT JOIN b ON h.host = b.host)
SELECT host, CASE WHEN taxon THEN n ELSE 0 END AS n_sources_found, CASE WHEN taxon THEN found ELSE '' END AS sources_found, CASE WHEN taxon THEN rejected ELSE '' END AS sources_rejected,
  CASE WHEN taxon AND n_vote > 0 THEN (n_vote - n_lost) || '/' || n_vote ELSE '' END AS phylum_agreement, CASE WHEN taxon AND n > 0 THEN lost ELSE '' END AS phylum_dispute, CASE WHEN taxon AND tied THEN 'yes' ELSE '' END AS phylum_tied,
  CASE WHEN taxon AND n > 0 THEN o_lost ELSE '' END AS order_dispute, CASE WHEN use THEN bs ELSE '' END AS taxonomy_source, CASE WHEN use THEN bf ELSE 0 END AS n_ranks, CASE WHEN use THEN ba ELSE '' END AS matched_name,
  {', '.join(f"""CASE WHEN use THEN b_{r} ELSE '' END AS "{r}" """ for r in rh.RANKS)},
  CASE WHEN NOT taxon THEN 'not a scientific name; not looked up' WHEN n > 0 AND tied THEN 'TIE: no majority phylum, lineage withheld; ' || lost
    WHEN n > 0 THEN array_to_string(list_filter([CASE WHEN vern THEN 'resolved from a common name -- verify' END, CASE WHEN backed THEN 'spelling corrected, corroborated by 2+ sources' END, CASE WHEN n_lost > 0 THEN 'PHYLUM DISAGREEMENT' END, CASE WHEN o_lost <> '' THEN 'order disagreement' END,
      CASE WHEN n = 1 THEN 'single source only' END, CASE WHEN n_no > 0 THEN 'a source answered about a different organism' END], lambda x: x IS NOT NULL), '; ')
    WHEN n_no > 0 THEN 'all sources rejected: ' || rejected ELSE 'no source had this name' END AS flag,
  CASE WHEN use AND br <> '' AND {_TWO.format(x='ba')} <> {_TWO.format(x='br')} THEN br ELSE '' END AS name_changed FROM m
"""


@query(_RESOLVED)
def resolved_hosts(spark, sf_dir):
    return rh.resolve_hosts(view(spark, sf_dir, "answers", dealt=True))
