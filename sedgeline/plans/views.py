"""Views that shape the generic tables into attribute tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

_GENUS = "upper(substr(p_name, 1, 1)) || split_part(substr(p_name, 2), ' ', 1)"
_EPITHET = "split_part(p_name, ' ', 2)"
_PART = f"(SELECT *, {_GENUS} AS g, {_EPITHET} AS e FROM {{part}}) q"

VIEWS: dict[str, str] = {
    "names": f"""SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN g || ' ' || e WHEN 1 THEN g || ' ' || e || ' sp. nov.' WHEN 2 THEN g || ' sp.'
      WHEN 3 THEN 'Uncultured ' || g || ' ' || e WHEN 4 THEN g || ' ' || e || ' (' || p_brand || ')' WHEN 5 THEN g || ' ' || CAST(p_size AS STRING)
      WHEN 6 THEN g || ' ' || e || ' n. gen. n. sp.' WHEN 7 THEN g || ' cf. ' || e WHEN 8 THEN g || ' ' || e || ' Sprague & Vavra 1976'
      WHEN 9 THEN g || ' ' || e || ' strain ' || p_type WHEN 10 THEN substr(g, 1, 1) || '. ' || e ELSE upper(g) || ' ' || e || ' gen. et sp. nov.' END AS nm FROM {_PART}""",
    "dates": """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN CAST(1990 + o_orderkey % 34 AS STRING) WHEN 1 THEN CAST(1950 + o_orderkey % 70 AS STRING) || '; ' || CAST(1990 + o_custkey % 30 AS STRING)
      WHEN 2 THEN '(Samples collected ' || CAST(1970 + o_orderkey % 40 AS STRING) || ') ' || CAST(1990 + o_custkey % 30 AS STRING) WHEN 3 THEN '' WHEN 4 THEN 'no. 19855 of ' || CAST(2000 + o_custkey % 20 AS STRING)
      ELSE CAST(44000 + o_orderkey % 700 AS STRING) END AS cell FROM {orders}""",
    "cells": """SELECT p_partkey AS id, p_name || '; ' || upper(p_name) || ';  ' || p_brand || CASE p_partkey % 3 WHEN 0 THEN '; type ' || p_brand WHEN 1 THEN chr(10) || p_type ELSE ' ;' END AS cell,
      CASE p_partkey % 7 WHEN 0 THEN 'Estuary near a lake' WHEN 1 THEN 'deep-sea benthic' WHEN 2 THEN 'Forest soil, pond' WHEN 3 THEN 'brackish' WHEN 4 THEN 'fresh water stream' WHEN 5 THEN p_type ELSE '' END AS place,
      'MG ' || CAST(100000 + p_partkey AS STRING) || '.1; XR_' || CAST(200000 + p_size AS STRING) || ', (AB' || CAST(300000 + p_partkey % 50 AS STRING) || ') junk12 ' AS acc,
      CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS STRING) || '.5 +/- 0.2' WHEN 1 THEN CAST(p_size AS STRING) || '-' || CAST(p_size + 3 AS STRING) || ' fresh' WHEN 2 THEN 'c. ' || CAST(p_size AS STRING) WHEN 3 THEN '' ELSE CAST(p_size AS STRING) || '.25' END AS size_cell,
      CASE p_partkey % 4 WHEN 0 THEN 'oval' WHEN 1 THEN 'rod' WHEN 2 THEN 'sphere' ELSE 'pyriform' END AS shape FROM {part}""",
    "sources": """SELECT p.p_partkey AS host, s.ord, s.source, CASE (p.p_partkey * 7 + s.ord * 3) % 5 WHEN 0 THEN '' WHEN 1 THEN 'Chordata' WHEN 2 THEN 'Mollusca' ELSE 'Arthropoda' END AS phylum
      FROM {part} p CROSS JOIN (SELECT 0 AS ord, 'alpha' AS source UNION ALL SELECT 1, 'beta' UNION ALL SELECT 2, 'gamma' UNION ALL SELECT 3, 'delta') s""",
    "hosts": """SELECT l_partkey AS species, l_suppkey AS cell, l_linenumber AS pos, l_orderkey AS ord, CASE l_orderkey % 4 WHEN 0 THEN 'natural host' WHEN 1 THEN 'Experimental' WHEN 2 THEN 'natural; experimental' ELSE '' END AS role,
      l_orderkey % 5 = 0 AS hyper, l_orderkey % 5 IN (1, 2) AS direct, l_orderkey % 7 = 3 AS parasite, 'phylum ' || CAST(l_suppkey % 40 * (l_suppkey % 3) AS STRING) AS phylum, l_returnflag = 'A' AS named FROM {lineitem}""",
    "hits": """SELECT l_partkey AS target, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand, l_orderkey % 3000 AS start, l_orderkey % 3000 + CAST(l_quantity AS BIGINT) * 4 AS "end",
      l_suppkey * 10 AS mdl_from, l_suppkey * 10 + CAST(l_quantity AS BIGINT) * 4 AS mdl_to, CAST(l_quantity AS BIGINT) AS score, l_tax AS evalue, (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS ord FROM {lineitem}""",
    "grid": "SELECT l_suppkey AS row, l_linenumber AS step, round(avg(l_discount), 6) AS value, round(avg(l_tax), 6) AS cost, sum(l_quantity) AS size FROM {lineitem} GROUP BY l_suppkey, l_linenumber",
    "localities": """SELECT c_custkey AS id, c_custkey % 211 AS species, CASE c_custkey % 9 WHEN 0 THEN a WHEN 1 THEN a || '; ' || b WHEN 2 THEN b || ' (' || a || ')' WHEN 3 THEN a || ', ' || n || '; ; ' || b || ' [' || a || ']' WHEN 4 THEN 'Near ' || b || ' and ' || a
      WHEN 5 THEN upper(b) || ' - ' || a || ';' || n WHEN 6 THEN a || ' River, ' || b || ' 12 km' WHEN 7 THEN '' ELSE n || ': ' || b END AS cell
      FROM (SELECT c_custkey, 'NATION ' || CAST(c_nationkey AS STRING) AS n,
        CASE c_custkey * 7 % 23 WHEN 0 THEN 'U.S.A. (California)' WHEN 1 THEN 'Russia: Lake Baikal' WHEN 2 THEN 'U.S.S.R. (Moldavia)' WHEN 3 THEN 'Czechoslovakia (near Chotebor)' WHEN 4 THEN 'Puget Sound' WHEN 5 THEN 'Strait of Georgia'
          WHEN 6 THEN 'Indian Ocean' WHEN 7 THEN 'India' WHEN 8 THEN 'Gulf of Mexico' WHEN 9 THEN 'Georgia' WHEN 10 THEN 'U.S. Georgia' WHEN 11 THEN 'Papua New Guinea' WHEN 12 THEN 'Guinea-Bissau' WHEN 13 THEN 'New  York' WHEN 14 THEN 'Yugoslavia'
          WHEN 15 THEN 'Soviet Union' WHEN 16 THEN 'Réunion' WHEN 17 THEN 'South Korea' WHEN 18 THEN 'Baltic, Gulf of Finland' WHEN 19 THEN 'Wolga Delta' WHEN 20 THEN 'west africa' WHEN 21 THEN 'Cornwall, England' ELSE 'St. Petersburg' END AS a,
        CASE c_custkey * 5 % 17 WHEN 0 THEN 'Canada' WHEN 1 THEN 'United States' WHEN 2 THEN 'new hampshire' WHEN 3 THEN 'Black Sea coast' WHEN 4 THEN 'Lake Biwa' WHEN 5 THEN 'u. k.' WHEN 6 THEN 'unknown pond' WHEN 7 THEN 'North Sea' WHEN 8 THEN 'Niger'
          WHEN 9 THEN 'São Paulo' WHEN 10 THEN 'Victoria, Australia' WHEN 11 THEN 'laboratory; insectary' WHEN 12 THEN 'Czechoslovakia' WHEN 13 THEN 'Zurich 1987' WHEN 14 THEN 'A. S. S. R. steppe' WHEN 15 THEN 'caspian' ELSE 'Virginia' END AS b FROM {customer}) q""",
    "edges": "SELECT p_partkey DIV 2 AS parent, p_partkey AS child FROM {part} WHERE p_partkey >= 2",
    "identities": """SELECT 'species ' || CAST(l_suppkey AS STRING) AS species, 'c' || CAST(l_partkey % 17 AS STRING) AS a, 'c' || CAST(l_orderkey % 13 AS STRING) AS b, 60 + CAST(l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31 AS BIGINT) % 39989 / 1000.0 AS identity FROM {lineitem}""",
    "records": """SELECT o_orderkey AS rec, o_custkey AS cust, o_orderkey % 997 AS cluster, o_custkey % 211 AS db_row, o_orderkey AS acc_pos, o_totalprice AS price FROM {orders}""",
}


#: Forms that cells of hosts take.
_PHRASES = (
    "Aedes cantans (type host)", "Bombus honshuensis, Bombus diversus diversus, Bombus ussurensis", "Daphnia magna", "D. pulex", "Sycia inopinata (in the polychaete annelid Audouinia tentaculata)",
    "Lecudina (Ophioidina) sp.", "A gregarine in gut of Capitella capitata", "Daphnia Iongispina", "Ageneotettix d. deorum", "S.mauritia acronyctoides", "Daphnia longispina/galeata complex",
    "Dissosteira Carolina", "Aedes sticticus (= Ochlerotatus crinifer)", "Simulium sp. nov. 2", "crab", "Unknown", "Various", "Gammarus", "A. flavescens", "Nosema bombycis Nageli, 1857",
    "Poecilia reticulata (Swamp Guppy)", "Simulium vittatum (should be Simulium aureum)", "Énchytreus cf. albidus", "Heterophyes heterophyes (parasite in Liza ramada) (experimental)", "B. diversus",
    "Ixodes ricinus in Apodemus sylvaticus", "L. zonata (also Lecudina polymorpha)", " ",
)


def _phrase(number: str) -> str:
    return f"CASE ({number}) % {len(_PHRASES)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_PHRASES)) + " END"


#: Names of groups by number; the genera that are known by their shape have seven of them.
_GROUP = "CASE {0} WHEN 0 THEN 'amphipod_fw' WHEN 1 THEN 'copepod_fw' WHEN 2 THEN 'cladoceran' WHEN 3 THEN 'blackfly' WHEN 4 THEN 'mosquito' ELSE 'group ' || CAST({0} AS STRING) END"


def _spore(form: str, n: str) -> str:
    n = f"CAST({n} AS STRING)"
    forms = (f"{n} || '.25 +/- 0.3 (3.71 - 4.33 um); '", f"{n} || '.1 fixed/' || {n} || '.75 fresh;'", f"{n} || '-' || {n} || '.5 (stained); '", f"'(' || {n} || '-9.5 um diameter) ; '", f"{n} || ' (fresh); '", f"'3.7 - 4.9 um (avg: ' || {n} || '.4 um); '",
             f"{n} || ' (macrospore, fresh);; '", "'not measured; '", f"'Meiospore ' || {n} || '.5 live; '", f"{n} || '.5-2.0/0.8; '", f"'(' || {n} || ' um); '", f"{n} || ' x (type b) (Fixed); '")
    return f"CASE ({form}) % {len(forms)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(forms)) + " END"


VIEWS |= {
    "host_cells": f"""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN a WHEN 1 THEN a || '; ' || b WHEN 2 THEN b || ';' || g || ' ' || e || '; ' || substr(g, 1, 1) || '. ' || e || 'us' WHEN 3 THEN b || ';;' || a || ' ; ' || g
      WHEN 4 THEN g || ' ' || e || ', ' || g || ' ' || e || 'a, ' || a ELSE a || '; ' || b || '; ' || g || ' ' || e || ' (host ' || CAST(p_size % 10 AS STRING) || ')' END AS cell
      FROM (SELECT p_partkey, p_size, g || 'ella' AS g, e, {_phrase('p_partkey * 5 + p_size')} AS a, {_phrase('p_partkey * 11 + p_size * 3')} AS b FROM {_PART}) c""",
    "spellings": f"""SELECT p_partkey AS id, lower(g) || 'ella ' || e || translate(CAST(p_partkey AS STRING), '0123456789', 'abcdefghij') AS key FROM {_PART}""",
    "curated": f"""SELECT p_partkey AS row, CASE p_partkey % 5 WHEN 0 THEN g || 'ella ' || e || x WHEN 1 THEN g || 'ella ' || e || x || ' (' || g || 'opsis ' || e || 'us)' WHEN 2 THEN g || 'ella ' || e || ' Sprague & Vávra, 1976 = ' || g || 'idia ' || e || x
      WHEN 3 THEN g || 'ella sp. (siberian isolate)' ELSE g || 'ella cf. ' || e || ' sp. nov.' END AS name, 'MG ' || CAST(100000 + p_partkey AS STRING) || '.1; XR_' || CAST(200000 + p_partkey % 7 AS STRING) AS accessions
      FROM (SELECT *, translate(CAST(p_partkey % 100 AS STRING), '0123456789', 'abcdefghij') AS x FROM {_PART}) a""",
    "found": f"""SELECT l AS cluster, CASE l % 7 WHEN 0 THEN g || 'ella ' || e || x WHEN 1 THEN substr(g, 1, 1) || '. ' || e || x WHEN 2 THEN g || 'opsis ' || e || 'us' WHEN 3 THEN g || 'osema ' || e WHEN 4 THEN 'Uncultured ' || g WHEN 5 THEN g || 'ella ' || e || 'zzz' ELSE g || 'idia ' || e || x END AS name,
      CASE WHEN l % 11 = 0 THEN 'AB' || CAST(500000 + l AS STRING) || ', mg' || CAST(100000 + l AS STRING) WHEN l % 13 = 0 THEN 'XR200003.1' ELSE '' END AS accessions
      FROM (SELECT c_custkey AS l, translate(CAST(c_custkey % 150 AS STRING), '0123456789', 'abcdefghij') AS x, p.g, p.e FROM {{customer}} c JOIN (SELECT p_partkey, g, e FROM {_PART}) p ON c.c_custkey * 3 % 500 = p.p_partkey) a""",
    "spores": f"""SELECT p_partkey AS id, CASE p_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE {_spore('p_partkey', 'p_size')} || {_spore('p_partkey DIV 7', 'p_size + 3')} END AS length, {_spore('p_partkey * 3', 'p_size DIV 2')} || CASE WHEN p_partkey % 4 < 3 THEN {_spore('p_partkey DIV 5 + p_size', 'p_size DIV 3')} ELSE '' END AS width,
      CASE p_partkey % 9 WHEN 0 THEN 'rod (fixed); oval (fresh)' WHEN 1 THEN 'Pyriform (stained)' WHEN 2 THEN 'spherical' WHEN 3 THEN 'oval (meiospore); ellipsoid (macrospore, fresh)' WHEN 4 THEN 'kidney-shaped; curved' WHEN 5 THEN '' WHEN 6 THEN 'ovocylindrical (live); barrel (stained) ; rod (octospore)' WHEN 7 THEN 'horseshoe (fixed); slender (Fresh smear)' ELSE 'Broad; ovoid (fixed)' END AS shape,
      CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(p_size AS STRING) || '.5 (meiospores); 7 (macrospores)' ELSE 'several' END AS coils, CASE p_partkey % 8 WHEN 0 THEN '5 - 6' WHEN 1 THEN CAST(44000 + p_partkey % 700 AS STRING) WHEN 2 THEN '2021-05-06' WHEN 3 THEN 'Uncoiled' WHEN 4 THEN '' WHEN 5 THEN '(10) ; 8 (rarely 9); 3-4' WHEN 6 THEN 'about 11' ELSE 'many' END AS coil_range FROM {{part}}""",
    "noted": """SELECT o_orderkey AS row, CASE o_orderkey % 17 WHEN 3 THEN ' ' ELSE 'Genus  ' || CAST(o_orderkey % 3001 AS STRING) END AS name, CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN 'Provisional species: defined by 18S sequence cluster 7' WHEN 2 THEN 'x [ADDED 2026-07-0' || CAST(1 + o_custkey % 9 AS STRING) || ']'
      WHEN 3 THEN '[TRANSFERRED/ADDED 2026-08-01]' WHEN 4 THEN '[MERGED 2026-08-06: original rows ' || CAST(o_custkey AS STRING) || ', ' || CAST(o_custkey * 30 AS STRING) || ', ' || CAST(o_custkey + 5 AS STRING) || ']' WHEN 5 THEN 'combined records: OLD ' || CAST(o_custkey AS STRING) || ' | Old  9; [TRANSFERRED/ADDED 2026-08-02] [TRANSFERRED/ADDED 2026-08-03]'
      WHEN 6 THEN '[MERGED 2026-08-06: original rows ' || CAST(2000 + o_custkey AS STRING) || ',2900 ] [TRANSFERRED/ADDED 2026-08-02]' WHEN 7 THEN 'combined records: Old ' || CAST(o_custkey AS STRING) || ' | Genus 2 | Old 14]' WHEN 8 THEN 'combined records: A | B | C [TRANSFERRED/ADDED 2026-08-02]' ELSE '' END AS remarks FROM {orders}""",
    "originals": """SELECT CASE c_custkey % 4 WHEN 0 THEN 'Genus ' || CAST(c_custkey * 3 AS STRING) WHEN 1 THEN ' genus  ' || CAST(c_custkey AS STRING) WHEN 2 THEN 'Old ' || CAST(c_custkey AS STRING) ELSE 'Alias ' || CAST(c_custkey AS STRING) END AS name FROM {customer}""",
    "aliases": "SELECT 'alias ' || CAST(s_suppkey * 4 + 3 AS STRING) AS name, 'GENUS ' || CAST(s_suppkey * 2 AS STRING) AS current FROM {supplier}",
    "genera": f"""SELECT p_partkey AS ord, g || e || translate(CAST(p_partkey % 150 AS STRING), '0123456789', 'abcdefghij') AS genus, {_GROUP.format('(p_partkey * 7 + p_size) % 27')} AS grp FROM {_PART}""",
    "host_groups": f"""SELECT {_GROUP.format('n_nationkey')} AS grp, CASE n_nationkey % 3 WHEN 0 THEN 'freshwater' WHEN 1 THEN 'marine' ELSE 'terrestrial' END AS environment,
      split(CASE n_nationkey % 3 WHEN 0 THEN 'freshwater;terrestrial' WHEN 1 THEN 'marine;brackish' ELSE 'terrestrial' END, ';') AS environments, n_name AS host_group, CASE WHEN n_nationkey % 4 = 0 THEN 'aquatic larva' ELSE '' END AS note, CASE WHEN n_nationkey % 5 = 0 THEN 'medium' ELSE 'high' END AS confidence FROM {{nation}}""",
    "taxa": f"""SELECT c_custkey AS id, CASE c_custkey % 14 WHEN 0 THEN g || ' magna' WHEN 1 THEN substr(g, 1, 2) || substr(g, 4) || ' sp.' WHEN 2 THEN substr(g, 1, 3) || 'zz' || substr(g, 6) WHEN 3 THEN g || 'q longa' WHEN 4 THEN substr(g, 1, 4) || 'gammarus pulex'
      WHEN 5 THEN 'Culex ' || g WHEN 6 THEN ' ' WHEN 7 THEN 'Shrimp' WHEN 8 THEN ' ' || upper(g) || ' X' WHEN 9 THEN NULL WHEN 10 THEN 'Wyz' || g WHEN 11 THEN substr(g, 1, 1) || '.' WHEN 12 THEN substr(g, 1, 4) ELSE substr(g, 1, 2) || 'y' || substr(g, 3, 3) || 'y' || substr(g, 7) END AS host
      FROM (SELECT c_custkey, g || e || translate(CAST(p_partkey % 150 AS STRING), '0123456789', 'abcdefghij') AS g FROM {{customer}} JOIN {_PART} ON p_partkey = c_custkey) c""",
    "answers": f"""SELECT CASE WHEN p_partkey % 29 = 5 THEN e WHEN p_partkey % 31 = 7 THEN g || ' ' || e || ' x' ELSE g || ' ' || e END AS host, 'species' AS rank, s.cand, s.ord, s.source, CASE s.cand WHEN 0 THEN g ELSE 'Syno' || lower(g) END || ' ' || e AS asked,
      CASE (p_partkey * 7 + s.ord * 3 + s.cand * 5) % 12 WHEN 0 THEN g || ' ' || e WHEN 1 THEN g || ' ' || e || ' Sprague, 1976' WHEN 2 THEN g || ' (' || g || 'ina)' WHEN 3 THEN 'X' || substr(g, 2) || ' ' || e WHEN 4 THEN 'Xy' || substr(g, 3) || ' ' || e WHEN 5 THEN 'Other thing'
        WHEN 6 THEN g || ' ' || e || 'um' WHEN 7 THEN g || ' differens' WHEN 8 THEN '' WHEN 9 THEN 'Syno' || lower(g) || ' ' || e WHEN 10 THEN 'Xy' || substr(g, 3) || ' ' || e || ' (L., 1758)' ELSE NULL END AS returned,
      CASE WHEN s.ord = 3 AND p_size % 9 = 0 THEN 'free_text' WHEN p_size % 4 = 0 THEN NULL ELSE 'EXACT' END AS match_type, CASE WHEN (p_partkey + s.ord) % 13 = 0 THEN 'Plantae' ELSE 'Animalia' END AS kingdom,
      CASE (p_partkey * 5 + s.ord * p_size) % 7 WHEN 0 THEN '' WHEN 1 THEN 'Chordata' WHEN 2 THEN 'Craniata' WHEN 3 THEN 'Myzozoa' WHEN 4 THEN 'Miozoa' ELSE 'Arthropoda' END AS phylum, CASE WHEN p_size % 2 = 0 THEN 'Conoidasida' ELSE '' END AS class,
      CASE (p_partkey + s.ord * 2) % 5 WHEN 0 THEN 'Eugregarinida' WHEN 1 THEN '' ELSE 'Diptera' END AS `order`, CASE WHEN (p_partkey + s.ord) % 3 = 0 THEN '' ELSE g || 'idae' END AS family, g AS genus, g || ' ' || e AS species
      FROM (SELECT p_partkey, p_size, g || 'ella' AS g, e || translate(CAST(p_partkey AS STRING), '0123456789', 'abcdefghij') AS e FROM {_PART}) p
      CROSS JOIN (SELECT 0 AS cand, 0 AS ord, 'GBIF' AS source UNION ALL SELECT 0, 1, 'COL' UNION ALL SELECT 0, 2, 'WoRMS' UNION ALL SELECT 0, 3, 'NCBI' UNION ALL SELECT 1, 0, 'GBIF' UNION ALL SELECT 1, 2, 'WoRMS') s""",
}

VIEWS["members"] = f"""SELECT id % 97 AS cluster, id AS ord, 'MG' || CAST(100000 + id AS STRING) AS accession, CASE WHEN id % 97 % 9 = 2 THEN 'Uncultured thing' WHEN id % 5 = 1 THEN upper(nm) ELSE nm END AS organism,
  CASE WHEN id % 97 % 7 = 3 THEN '' WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'Daphnia magna; ' || p_brand || ';;' ELSE upper(p_brand) || chr(10) || 'daphnia  magna' END AS host, CASE WHEN id % 6 = 0 THEN p_type ELSE '' END AS lab_host,
  CASE id % 3 WHEN 0 THEN 'Lake  ' || CAST(p_size % 5 AS STRING) WHEN 1 THEN ' lake ' || CAST(p_size % 5 AS STRING) END AS locality, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Chile' WHEN 2 THEN 'chile' ELSE 'Peru' END AS country,
  CASE WHEN id % 97 % 5 = 1 THEN '' ELSE CAST(1990 + p_size % 7 AS STRING) END AS pub_year, CASE WHEN id % 97 % 10 = 1 THEN NULL ELSE CAST(2000 + p_size % 5 AS STRING) END AS submitted_year, '2' || CAST(id % 9 AS STRING) || '-MAY-' || CAST(2010 + p_size % 4 AS STRING) AS record_date,
  CASE WHEN id % 2 = 0 THEN p_brand ELSE lower(p_brand) END AS isolate, CASE WHEN id % 3 = 0 THEN p_type END AS strain, CAST(p_size AS STRING) || ', ' || CAST(p_size % 7 AS STRING) AS pubmed FROM ({VIEWS['names']}) n JOIN {{part}} ON p_partkey = id"""


def view(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False, merge: bool = False) -> DataFrame:
    """The view over the tables in a folder; ``dealt``: their rows are spread over all cores first, for queries that take long over a row; ``merge``: they join by shuffle, since a small file may hold many rows."""
    text = VIEWS[name].replace('"end"', "`end`")
    used = [t for t in ("part", "orders", "lineitem", "supplier", "customer", "nation") if "{" + t + "}" in text]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    tables = {t: spread(df) if dealt else df for t, df in tables.items()}
    return spark.sql(text, **{t: df.hint("merge") if merge else df for t, df in tables.items()})


def duck(name: str) -> str:
    """The view as a DuckDB subquery."""
    text = VIEWS[name].replace(" DIV ", " // ").replace("`", '"')
    for t in ("part", "orders", "lineitem", "supplier", "customer", "nation"):
        text = text.replace("{" + t + "}", t)
    return f"({text})"
