"""Queries of places in localities.

The SQL takes another way than the operator: it goes through the names one by
one, from the longest on, and cuts each out of the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import places as fixed
from ..operators import gazetteer as gz
from .queries import query
from .views import duck, view

#: Country names come from a table; these stand for the few that the generated cells name.
_WORLD = "SELECT 'nation ' || CAST(n_nationkey AS STRING) AS alias, 'N' || CAST(n_nationkey AS STRING) AS value FROM {nation} UNION ALL SELECT * FROM (VALUES ('Canada', 'CAN'), ('India', 'IND'), ('Guinea', 'GIN'), ('Guinea-Bissau', 'GNB'), ('Niger', 'NER'), ('Russia', 'RUS'), ('Georgia', 'GEO'), ('Papua New Guinea', 'PNG')) v(alias, value)"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_TABLES = (fixed.HISTORICAL, fixed.VARIANTS, dict.fromkeys(fixed.US_STATES, "USA"), dict.fromkeys(fixed.CA_PROVINCES, "CAN"), fixed.OTHER_SUBNATIONAL)
_BACK = "\\1"
_TEXT = "' ' || lower(strip_accents(segment)) || ' '"
for _p, _to in fixed.ABBREVIATIONS:
    # the engine has no lookahead: the letter after it is taken and put back
    _TEXT = f"regexp_replace({_TEXT}, '{_p.replace('(?![a-z])', '([^a-z]|$)')}', '{_to + _BACK if '(?!' in _p else _to}', 'g')"
_PLACES = f"""
WITH RECURSIVE cells AS MATERIALIZED (SELECT * FROM {duck('localities')} q),
seg AS MATERIALIZED (SELECT id, i, trim(x) AS segment FROM (SELECT id, unnest(string_split(cell, ';')) AS x, generate_subscripts(string_split(cell, ';'), 1) AS i FROM cells) WHERE trim(x) <> ''),
world AS (SELECT 0 AS source, 0 AS pos, alias, value FROM ({_WORLD.replace('{nation}', 'nation')}) UNION ALL SELECT * FROM (VALUES {_values((t + 1, i, a, v) for t, names in enumerate(_TABLES) for i, (a, v) in enumerate(names.items()))}) v(source, pos, alias, value)),
gaz AS (SELECT alias, arg_min(value, (source, pos)) AS value, min((source, pos)) AS pos FROM (SELECT source, pos, trim(regexp_replace(lower(strip_accents(alias)), '[^a-z0-9]+', ' ', 'g')) AS alias, value FROM world) GROUP BY alias),
steps AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY class, CASE WHEN class IN (0, 2) THEN -length(alias) ELSE 0 END, pos) AS k, alias, class, value FROM (
    SELECT alias, value, 0 AS class, (0, i) AS pos FROM (VALUES {_values((i, a, v) for i, (a, v) in enumerate(fixed.SEAS.items()))}) v(i, alias, value)
    UNION ALL SELECT 'usa|united states', '', 1, (0, 0) UNION ALL SELECT alias, value, 2, pos FROM gaz
    UNION ALL SELECT alias, '', 3, (0, i) FROM (VALUES {_values((i, a) for i, a in enumerate([*fixed.NOISE, *fixed.WEAK]))}) v(i, alias))),
walk AS (
  SELECT segment, CAST(0 AS BIGINT) AS k, ' ' || regexp_replace({_TEXT}, '[^a-z0-9]+', ' ', 'g') || ' ' AS s, CAST([] AS VARCHAR[]) AS seas, CAST([] AS VARCHAR[]) AS iso, CAST([] AS VARCHAR[]) AS weak, false AS us FROM (SELECT DISTINCT segment FROM seg)
  UNION ALL
  SELECT segment, t.k, CASE WHEN hit AND t.class <> 1 AND NOT (t.class = 2 AND w) THEN regexp_replace(s, '\\b' || t.alias || '\\b', ' ', 'g') ELSE s END,
    CASE WHEN hit AND t.class = 0 THEN list_append(seas, t.value) ELSE seas END,
    CASE WHEN hit AND t.class = 2 AND NOT w THEN list_append(iso, CASE WHEN t.alias IN ('georgia', 'cornwall') THEN CASE WHEN us OR list_contains(iso, 'USA') THEN 'USA' WHEN t.alias = 'georgia' THEN 'GEO' ELSE 'GBR' END ELSE t.value END) ELSE iso END,
    CASE WHEN hit AND t.class = 2 AND w THEN list_append(weak, t.value) ELSE weak END, us OR (hit AND t.class = 1)
  FROM (SELECT walk.*, t, regexp_matches(s, '\\b(' || t.alias || ')\\b') AS hit, t.alias IN ({', '.join(f"'{w}'" for w in fixed.WEAK)}) AS w FROM walk JOIN steps t ON t.k = walk.k + 1)),
done AS MATERIALIZED (
  SELECT segment, list_distinct(CASE WHEN len(iso) > 0 THEN iso ELSE weak END) AS iso, list_distinct(seas) AS seas,
    list_filter(string_split(s, ' '), lambda w: length(w) > 2 OR regexp_matches(w, '[0-9]')) AS words FROM walk WHERE k = (SELECT max(k) FROM steps)),
parts AS MATERIALIZED (
  SELECT id, i, seg.segment, iso, seas, list_filter(words, lambda w: NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains([{', '.join(f"'{w}'" for w in fixed.FILLER)}], w)) AS told, words
  FROM seg JOIN done ON seg.segment = done.segment),
places AS MATERIALIZED (
  SELECT c.id, any_value(c.species) AS species, any_value(c.cell) AS cell, coalesce(list_sort(list_distinct(flatten(list(iso ORDER BY i) FILTER (iso IS NOT NULL)))), []) AS iso, coalesce(list_sort(list_distinct(flatten(list(seas ORDER BY i) FILTER (seas IS NOT NULL)))), []) AS seas,
    coalesce(array_to_string(flatten(list(words ORDER BY i) FILTER (words IS NOT NULL)), ' '), '') AS leftover, coalesce(array_to_string(flatten(list(told ORDER BY i) FILTER (told IS NOT NULL)), ' '), '') AS informative,
    coalesce(string_agg(segment, '; ' ORDER BY i) FILTER (len(iso) = 0 AND len(seas) = 0 AND len(told) > 0), '') AS unresolved, count(segment) AS n_segments
  FROM cells c LEFT JOIN parts p ON c.id = p.id GROUP BY c.id)
"""


def _parsed(spark, sf_dir):
    cells = view(spark, sf_dir, "localities")
    world = spark.sql(_WORLD, nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))
    return cells, gz.parse_places(cells, gz.gazetteer(spark, world))


@query(_PLACES + "SELECT id, array_to_string(iso, ';') AS places, array_to_string(seas, ';') AS seas, leftover, informative, unresolved FROM places")
def locality_places(spark, sf_dir):
    _, got = _parsed(spark, sf_dir)
    return got.select("id", F.array_join(F.array_sort("places"), ";").alias("places"), F.array_join(F.array_sort("seas"), ";").alias("seas"), "leftover", "informative", F.array_join("unresolved", "; ").alias("unresolved"))


@query(
    _PLACES
    + f"""SELECT coalesce(b.basin, s.sea) AS water, count(DISTINCT species) AS n FROM (SELECT species, unnest(seas) AS sea FROM places WHERE len(iso) = 0) s
  LEFT JOIN (VALUES {_values(fixed.BASINS.items())}) b(sea, basin) ON s.sea = b.sea GROUP BY 1"""
)
def basin_counts(spark, sf_dir):
    cells, got = _parsed(spark, sf_dir)
    return gz.water_counts(got.join(cells.select("id", "species"), "id"))


@query(
    _PLACES
    + """SELECT count(*) AS cells, count(*) FILTER (n_segments = 0) AS blank, count(*) FILTER (len(iso) > 0) AS resolved, count(*) FILTER (len(iso) = 0 AND len(seas) > 0) AS open_water,
  count(*) FILTER (n_segments > 0 AND len(iso) = 0 AND len(seas) = 0) AS unplaced, count(*) FILTER (n_segments > 1 AND unresolved <> '' AND len(iso) > 0) AS partly,
  len(list_distinct(flatten(list(iso)))) AS countries FROM places"""
)
def locality_totals(spark, sf_dir):
    cells, got = _parsed(spark, sf_dir)
    rows = got.join(cells.select("id", F.size(gz.segments(F.col("cell"))).alias("n")), "id")
    some, sea = F.size("places") > 0, F.size("seas") > 0
    count = lambda c, name: F.count_if(c).alias(name)
    return rows.agg(
        F.count("*").alias("cells"), count(F.col("n") == 0, "blank"), count(some, "resolved"), count(~some & sea, "open_water"), count((F.col("n") > 0) & ~some & ~sea, "unplaced"),
        count((F.col("n") > 1) & (F.size("unresolved") > 0) & some, "partly"),
    ).crossJoin(got.select(F.explode("places").alias("place")).agg(F.count_distinct("place").alias("countries")))


_OLD = "|".join(fixed.HISTORICAL)


@query(_PLACES + f"SELECT trim(cell) AS locality, array_to_string(iso, ';') AS places, count(*) AS n_entries FROM places WHERE regexp_matches(lower(strip_accents(cell)), '{_OLD}') GROUP BY 1, 2")
def historical_names(spark, sf_dir):
    cells, got = _parsed(spark, sf_dir)
    old = cells.where(F.lower(gz.tx.deaccent(F.col("cell"))).rlike(_OLD))
    rows = old.join(got, "id").select(F.trim("cell").alias("locality"), F.array_join(F.array_sort("places"), ";").alias("places"))
    return rows.groupBy("locality", "places").agg(F.count("*").alias("n_entries"))
