"""Queries that predict the environments of hosts, and that read cells of measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.terms import GENUS_PATTERNS, NOT_TAXA, OTHER_SHAPES, SHAPES
from ..operators import measurements as me
from ..operators import predict as pr
from .queries import query
from .views import duck, view

_TABLE = f"t AS MATERIALIZED (SELECT lower(genus) AS genus, arg_max(grp, ord) AS grp, min(ord) AS ord FROM {duck('genera')} q GROUP BY ALL)"
_SHAPE = "CASE " + " ".join(f"WHEN regexp_matches(key, '{p}') THEN ['{g}', '{c}']" for p, g, c in GENUS_PATTERNS) + " END"


@query(f"WITH {_TABLE} SELECT * FROM t")
def genus_groups(spark, sf_dir):
    """The last group that each genus was put in."""
    return pr.genus_table(view(spark, sf_dir, "genera"))


@query(
    f"""WITH {_TABLE}, i AS MATERIALIZED {duck('host_groups')}, u AS MATERIALIZED (SELECT * FROM t WHERE grp IN (SELECT grp FROM i)),
h AS MATERIALIZED (SELECT id, host AS given, trim(coalesce(host, '')) AS host FROM {duck('taxa')} q),
k AS (SELECT id, given, host, CASE WHEN host <> '' AND NOT regexp_matches(host, '{NOT_TAXA}') THEN lower(split_part(host, ' ', 1)) END AS key FROM h),
c AS MATERIALIZED (SELECT key, u.grp AS known, CASE WHEN u.grp IS NULL THEN {_SHAPE} END AS shape FROM (SELECT DISTINCT key FROM k WHERE key IS NOT NULL) LEFT JOIN u ON key = genus),
n AS (SELECT key, genus, u.grp, levenshtein(key, genus) AS d FROM c JOIN u ON key[1] = genus[1] AND abs(length(key) - length(genus)) <= 2 WHERE known IS NULL AND shape IS NULL AND length(key) >= 6 AND levenshtein(key, genus) <= 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY d, u.ord) = 1),
a AS (SELECT c.key, coalesce(known, shape[1], CASE WHEN d = 1 THEN n.grp END) AS grp, known, shape, d, upper(n.genus[1]) || n.genus[2:] AS near FROM c LEFT JOIN n ON c.key = n.key)
SELECT id, given AS host, coalesce(environment, '') AS primary_environment, coalesce(array_to_string(environments, '; '), '') AS environments, coalesce(host_group, 'Unresolved') AS host_group, coalesce(note, '') AS note,
  CASE WHEN i.grp IS NULL THEN 'none' WHEN known IS NOT NULL THEN confidence WHEN shape IS NOT NULL THEN shape[2] ELSE 'medium' END AS confidence,
  CASE WHEN host = '' THEN 'no host name parsed' WHEN k.key IS NULL THEN 'not a taxon name' WHEN known IS NOT NULL THEN 'genus table (' || known || ')' WHEN i.grp IS NOT NULL AND shape IS NOT NULL THEN 'name pattern (' || shape[1] || ')'
    WHEN d = 1 THEN 'fuzzy match to ' || near || ' (1 edit) - LIKELY MISSPELLING' WHEN d = 2 THEN 'possible misspelling of ' || near || ' (2 edits) - NOT APPLIED, check manually' ELSE 'genus not in table' END AS basis
FROM k LEFT JOIN a ON k.key = a.key LEFT JOIN i ON a.grp = i.grp"""
)
def predictions(spark, sf_dir):
    out = pr.predict(view(spark, sf_dir, "taxa"), view(spark, sf_dir, "genera"), view(spark, sf_dir, "host_groups"))
    return out.withColumn("environments", F.array_join("environments", "; "))


_N = r"[0-9]+(?:\.[0-9]+)?"
_CUT = "SELECT id, unnest(x) AS t, generate_subscripts(x, 1) AS idx FROM (SELECT id, list_filter(list_transform(string_split({c}, ';'), lambda t: trim(t)), lambda t: t <> '') AS x FROM {frm})"
_RANK = "CASE WHEN trim(c) = '' THEN 3 " + " ".join(f"WHEN contains(c, '{w}') THEN {i}" for i, w in enumerate(me.CONDITIONS, 1) if w != "unspecified") + f" ELSE 7 END + CASE WHEN regexp_matches(c, '{'|'.join(me.LAST_KINDS)}') THEN 10 ELSE 0 END"


def _values(frm: str) -> str:
    """Parts (id, idx, t) with value, basis, condition c, label and rank."""
    num = "list_transform(regexp_extract_all({x}, '" + _N + "'), lambda v: v::DOUBLE)"
    return rf"""SELECT *, {_RANK} AS rank, trim(regexp_replace(regexp_replace(c, '[^a-z ]', ' ', 'g'), '\s+', ' ', 'g')) AS label,
      CASE WHEN a <> '' THEN a::DOUBLE WHEN len(r) = 2 THEN (r[1] + r[2]) / 2 WHEN len(o) > 0 THEN o[1] WHEN len(i) > 1 THEN (i[1] + i[2]) / 2 ELSE i[1] END AS value,
      CASE WHEN a <> '' THEN 'stated average' WHEN len(r) = 2 THEN 'range midpoint' WHEN len(o) > 0 THEN 'first value' WHEN len(i) > 1 THEN 'range midpoint (parenthetical)' WHEN len(i) = 1 THEN 'first value (parenthetical)' ELSE 'no number found' END AS basis
    FROM (SELECT id, idx, regexp_extract(lower(t), '(?:avg|average|mean)\s*[:=]?\s*({_N})', 1) AS a, {num.format(x=r"regexp_extract(trim(regexp_replace(t, '\([^)]*\)', ' ', 'g')), '^" + _N + r"\s*[-–]\s*" + _N + "')")} AS r,
      {num.format(x=r"regexp_replace(t, '\([^)]*\)', ' ', 'g')")} AS o, {num.format(x='t')} AS i,
      array_to_string(regexp_extract_all(lower(t), '\(([^)]*)\)', 1), ' ') || ' ' || CASE WHEN regexp_matches(lower(t), '{me.BARE_CONDITIONS}') THEN lower(t) ELSE '' END AS c FROM ({frm}) p) q"""


def _slashed(c: str) -> str:
    return rf"""SELECT id, trim(s) AS t, row_number() OVER (PARTITION BY id ORDER BY idx, j) AS idx FROM (
      SELECT id, idx, unnest(y) AS s, generate_subscripts(y, 1) AS j FROM (SELECT id, idx, CASE WHEN len(list_filter(string_split(u, '/'), lambda v: NOT regexp_matches(v, '[0-9]'))) = 0 AND regexp_matches(lower(u), '{me.SLASH_CONDITIONS}') THEN string_split(u, '/') ELSE [u] END AS y
        FROM (SELECT id, idx, regexp_replace(t, '\+\s*/\s*-', '+-', 'g') AS u FROM ({_CUT.format(c=c, frm='s')}) z) z) z) z"""


def _clash(a: str, b: str) -> str:
    def one(words: tuple[str, ...]) -> str:
        x, y = (f"list_sort(list_intersect(list_distinct(string_split(regexp_replace({c}, '[^a-z ]+', ' ', 'g'), ' ')), {list(words)}))" for c in (a, b))
        return f"(len({x}) > 0 AND len({y}) > 0 AND {x} <> {y})"

    return f"({one(me.PREPARATIONS)} OR {one(me.KINDS)})"


_CLASS = "CASE " + " ".join(f"WHEN {p} THEN '{k}'" for k, p in ((k, f"regexp_matches(d, '{v.replace('(?![^,]*(posterior|anterior|end|pole))', '')}')") for k, v in (SHAPES | {"Other": OTHER_SHAPES}).items())) + " END"


@query(
    rf"""WITH s AS MATERIALIZED {duck('spores')}, l1 AS ({_values(_CUT.format(c='length', frm='s'))}), w1 AS ({_values(_CUT.format(c='width', frm='s'))}),
ls AS MATERIALIZED ({_values(_slashed('length'))}), ws AS MATERIALIZED ({_values(_slashed('width'))}),
lb AS (SELECT * FROM l1 WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, idx) = 1), wb AS (SELECT * FROM w1 WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, idx) = 1),
n AS (SELECT id, greatest((SELECT count(*) FROM ls WHERE ls.id = s.id), (SELECT count(*) FROM ws WHERE ws.id = s.id)) AS most, (SELECT count(*) FROM ls WHERE ls.id = s.id AND value IS NOT NULL) AS nl, (SELECT count(*) FROM ws WHERE ws.id = s.id AND value IS NOT NULL) AS nw FROM s),
li AS (SELECT * FROM ls WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, idx) = 1), wi AS (SELECT id, idx FROM ws WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, idx) = 1),
hit AS (SELECT li.id, ws.idx, ws.value, ws.c FROM n JOIN li USING (id) JOIN ws ON ws.id = li.id WHERE most > 1 AND ws.value IS NOT NULL AND (ws.label = li.label OR nl = nw AND ws.idx = li.idx) QUALIFY row_number() OVER (PARTITION BY li.id ORDER BY ws.label <> li.label, ws.idx) = 1),
pr AS (SELECT hit.* FROM hit JOIN wi ON hit.id = wi.id AND hit.idx <> wi.idx),
sh AS MATERIALIZED (SELECT id, idx, k, c, {_CLASS} AS class FROM (SELECT id, idx, length(t) AS k, lower(regexp_extract(t, '\(([^)]*)\)', 1)) AS c, trim(regexp_replace(lower(t), '\([^)]*\)', ' ', 'g')) AS d FROM ({_CUT.format(c='shape', frm='s')}) p) q),
sb AS (SELECT id, class, trim(regexp_replace(c, '[^a-z]+', ' ', 'g')) AS c FROM sh WHERE class <> 'Other' QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN regexp_matches(c, '{me.WORSE_SHAPES}') THEN 2 WHEN c = '' OR regexp_matches(c, 'fresh|live') THEN 0 ELSE 1 END + CASE WHEN regexp_matches(c, '{'|'.join(me.LAST_KINDS)}') THEN 1 ELSE 0 END, idx) = 1),
x AS (SELECT s.id, coalesce(sb.class, CASE WHEN s.id IN (SELECT id FROM sh WHERE class = 'Other') THEN 'Other' END) AS class, sb.c AS sc, coalesce(trim(lb.c), '') AS lc, (SELECT count(*) FROM sh WHERE sh.id = s.id) AS parts FROM s LEFT JOIN sb ON s.id = sb.id LEFT JOIN lb ON s.id = lb.id),
bad AS (SELECT x.* FROM x WHERE lc <> '' AND sc <> '' AND {_clash('lc', 'sc')}),
alt AS (SELECT bad.id, sh.class FROM bad JOIN sh ON bad.id = sh.id WHERE parts > 1 AND sh.class <> 'Other' AND NOT {_clash('sh.c', 'lc')} QUALIFY row_number() OVER (PARTITION BY bad.id ORDER BY idx) = 1)
SELECT x.id, lb.value AS length, coalesce(lb.basis, CASE WHEN trim(coalesce(s.length, '')) = '' THEN 'empty' ELSE 'no number found' END) AS length_basis, x.lc AS condition, coalesce(pr.value, wb.value) AS width,
  coalesce(wb.basis, CASE WHEN trim(coalesce(s.width, '')) = '' THEN 'empty' ELSE 'no number found' END) || CASE WHEN pr.id IS NULL THEN '' ELSE ' (paired to length term)' END AS width_basis, trim(CASE WHEN pr.id IS NULL THEN coalesce(wb.c, '') ELSE pr.c END) AS width_condition, pr.id IS NOT NULL AS paired,
  CASE WHEN bad.id IS NULL THEN x.class ELSE alt.class END AS shape, CASE WHEN alt.id IS NULL THEN x.sc ELSE x.lc END AS shape_condition, CASE WHEN bad.id IS NULL THEN '' WHEN alt.id IS NULL THEN 'excluded' ELSE 'retaken' END AS shape_action
FROM x JOIN s USING (id) LEFT JOIN lb ON x.id = lb.id LEFT JOIN wb ON x.id = wb.id LEFT JOIN pr ON x.id = pr.id LEFT JOIN bad ON x.id = bad.id LEFT JOIN alt ON x.id = alt.id"""
)
def spore_measurements(spark, sf_dir):
    """Each row's length, the width of the same spore, and its shape."""
    return me.spores(view(spark, sf_dir, "spores", dealt=True), "id", "length", "width", "shape")


@query(
    rf"""WITH s AS MATERIALIZED {duck('spores')}, a AS (SELECT id, value FROM ({_values(_CUT.format(c='coils', frm='s'))}) q WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, idx) = 1),
d AS (SELECT id, coalesce(CASE WHEN regexp_full_match(coil_range, '[0-9]{{5}}') THEN DATE '1899-12-30' + coil_range::INT WHEN regexp_matches(coil_range, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN coil_range[:10]::DATE END) AS day, coil_range FROM s),
e AS (SELECT id, day, CASE WHEN day IS NULL THEN coil_range ELSE month(day) || ' - ' || day(day) END AS text FROM d),
t AS (SELECT id, list_transform(regexp_extract_all(regexp_replace(t, '\([^)]*\)', ' ', 'g'), '{_N}'), lambda v: v::DOUBLE) AS v FROM ({_CUT.format(c='text', frm='e')}) q WHERE regexp_matches(regexp_replace(t, '\([^)]*\)', ' ', 'g'), '[0-9]') QUALIFY row_number() OVER (PARTITION BY id ORDER BY idx) = 1)
SELECT e.id, coalesce(a.value, CASE WHEN text = 'Uncoiled' THEN 0 WHEN len(v) > 1 THEN (v[1] + v[2]) / 2 ELSE v[1] END) AS value, a.value IS NULL AND day IS NOT NULL AS repaired,
  CASE WHEN a.id IS NOT NULL THEN 'stated average' WHEN text = '' THEN 'empty' WHEN text = 'Uncoiled' THEN 'uncoiled' WHEN len(v) > 1 THEN 'range midpoint' WHEN len(v) = 1 THEN 'single value' ELSE 'no number found' END AS basis
FROM e LEFT JOIN a ON e.id = a.id LEFT JOIN t ON e.id = t.id"""
)
def spore_coils(spark, sf_dir):
    return view(spark, sf_dir, "spores", dealt=True).select("id", me.coils("coils", "coil_range").alias("c")).select("id", "c.*")
