"""Queries over the views, each beside the SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import text as tx
from ..operators import clusters, identity, intervals, resolve, sets, trees
from .views import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ACT1 = r"\b(?:nov|n)\.(?:\s*,?\s*(?:n\.\s*)?(?:gen|sp|spp|comb)\.?)+"
_ACT2 = r"\b(?:gen|sp|spp|ssp|subsp|var|comb|stat)\.?\s*,?\s*(?:et\s*|and\s*|&\s*)?(?:nov(?:\.|\b)|n\.)"
_UNINF = r"^(?:uncultured|unidentified|unclassified|environmental|microsporidian?|fungal|eukaryot[a-z0-9_]*|unnamed|unknown|undescribed|mutated)\b"
_BARE = rf"regexp_replace(regexp_replace(regexp_replace(lower(NAME), '\(.*?\)', ' ', 'g'), '{_ACT1}', ' ', 'g'), '{_ACT2}', ' ', 'g')"
_TOK = rf"list_filter(regexp_split_to_array(regexp_replace(regexp_replace({_BARE}, '\b(?:cf|aff|nr)\.?\s+', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda t: t NOT IN ('', 'nov', 'gen', 'et', 'and', 'comb', 'stat'))"
_CLASS = rf"""CASE WHEN len(tok) < 2 OR regexp_matches(array_to_string(tok, ' '), '{_UNINF}') OR len(list_filter(tok[1:3], lambda t: t IN ('sp', 'spp'))) > 0 OR regexp_full_match(tok[2], '[0-9]+') THEN 'provisional' ELSE 'named' END"""
_NAMED = f"(SELECT id, nm, {_CLASS} AS class FROM (SELECT id, nm, {_TOK.replace('NAME', 'nm')} AS tok FROM {duck('names')}))"


@query(f"SELECT id, nm, class FROM {_NAMED}")
def classify_names(spark, sf_dir):
    return view(spark, sf_dir, "names").select("id", "nm", tx.classify_name(F.col("nm")).alias("class"))


_YEARS = r"list_filter(list_transform(list_filter(regexp_extract_all(CELL, '[0-9]+'), lambda x: length(x) = 4), lambda x: CAST(x AS INTEGER)), lambda y: y BETWEEN 1600 AND 2026)"


_WITHOUT_COLLECTION = "regexp_replace(cell, '[(][^)]*collect[^)]*[)]', ' ', 'g')"


@query(
    f"""SELECT id, list_min({_YEARS.replace('CELL', 'cell')}) AS earliest,
  coalesce(list_min({_YEARS.replace('CELL', _WITHOUT_COLLECTION)}), list_min({_YEARS.replace('CELL', 'cell')})) AS published FROM {duck('dates')}"""
)
def years(spark, sf_dir):
    c = F.col("cell")
    return view(spark, sf_dir, "dates").select("id", num.earliest_year(c).alias("earliest"), num.publication_year(c).alias("published"))


@query(
    f"""WITH y AS (SELECT n.id, class, list_min({_YEARS.replace('CELL', 'd.cell')}) AS y FROM {_NAMED} n JOIN {duck('dates')} d ON n.id = d.id),
  c AS (SELECT CAST(floor(y / 10) * 10 AS INTEGER) AS decade, count(*) FILTER (class = 'named') AS named, count(*) FILTER (class = 'provisional') AS provisional FROM y WHERE y IS NOT NULL GROUP BY 1),
  b AS (SELECT unnest(range((SELECT min(decade) FROM c), (SELECT max(decade) FROM c) + 1, 10)) AS decade)
  SELECT CAST(b.decade AS BIGINT) AS decade, coalesce(named, 0) AS named, coalesce(provisional, 0) AS provisional, coalesce(named, 0) + coalesce(provisional, 0) AS total FROM b LEFT JOIN c ON b.decade = c.decade"""
)
def named_by_decade(spark, sf_dir):
    """Names by decade of their earliest year, with empty decades between filled in."""
    dated = view(spark, sf_dir, "names").join(view(spark, sf_dir, "dates"), "id").select(tx.classify_name(F.col("nm")).alias("class"), num.earliest_year(F.col("cell")).alias("y")).where("y IS NOT NULL")
    c = dated.groupBy((F.floor(F.col("y") / 10) * 10).alias("decade")).agg(F.count_if(F.col("class") == "named").alias("named"), F.count_if(F.col("class") == "provisional").alias("provisional"))
    bins = c.agg(F.min("decade").alias("lo"), F.max("decade").alias("hi")).select(F.explode(F.sequence("lo", "hi", F.lit(10).cast("long"))).alias("decade"))
    n, p = F.coalesce("named", F.lit(0)), F.coalesce("provisional", F.lit(0))
    return bins.join(c, "decade", "left").select("decade", n.alias("named"), p.alias("provisional"), (n + p).alias("total"))


_AUTHORITY = tx.AUTHORITY.replace("\\u00c0-\\u024f", "À-ɏ").replace("\\u2019", "’").replace("'", "''")
_KEYTOK = f"lower(strip_accents(regexp_replace(nm, '{_AUTHORITY}', ' ', 'g')))"
for _gone, _to in ((r"\(.*?\)", " "), (tx.KEY_ACTS, " "), (tx.QUALIFIERS, " "), (tx.STRAINS, " "), (tx.BARE_SP, " sp "), (r"[^a-z0-9\s]", " ")):
    _KEYTOK = f"regexp_replace({_KEYTOK}, '{_gone}', '{_to}', 'g')"
_KEYTOK = f"list_filter(regexp_split_to_array({_KEYTOK}, '\\s+'), lambda t: t NOT IN ('', 'nov', 'gen', 'et', 'and'))"
_KEYED = f"(SELECT id, nm, array_to_string(tok[1:2], ' ') AS k, tok[1:2] AS t FROM (SELECT id, nm, {_KEYTOK} AS tok FROM {duck('names')}))"
_ABBR = "CASE WHEN len(t) = 2 AND length(t[1]) > 1 AND t[2] <> 'sp' THEN substr(t[1], 1, 1) || ' ' || t[2] ELSE '' END"


@query(f"SELECT id, k AS key, {_ABBR} AS abbreviated, CASE WHEN k = '' OR regexp_matches(k, '{_UNINF}') THEN 2 WHEN t[1] = 'sp' THEN 1 WHEN len(t) >= 2 AND t[2] <> 'sp' AND NOT regexp_full_match(t[2], '[0-9]+') THEN 0 ELSE 1 END AS rank FROM {_KEYED}")
def name_keys(spark, sf_dir):
    k = view(spark, sf_dir, "names").select("id", tx.name_key(F.col("nm")).alias("key"))
    return k.select("id", "key", tx.abbreviated_key(F.col("key")).alias("abbreviated"), tx.name_rank(F.col("key")).alias("rank"))


@query(
    f"""WITH n AS (SELECT id, k, t, {_ABBR} AS ab FROM {_KEYED}), a AS (SELECT *, CASE WHEN length(t[1]) = 1 THEN k ELSE ab END AS sh FROM n WHERE id % 50 = 0), b AS (SELECT * FROM n),
  m AS (SELECT a.id AS l, b.id AS r, 1 AS tier, 'exact' AS basis FROM a JOIN b ON a.k = b.k WHERE a.k <> '' UNION SELECT a.id, b.id, 2, 'abbreviated' FROM a JOIN b ON a.sh = b.ab WHERE b.ab <> ''
    UNION SELECT a.id, b.id, 3, 'epithet' FROM a JOIN b ON a.t[2] = b.t[2] WHERE coalesce(a.t[2], '') <> '')
  SELECT l AS "left", r AS "right", tier, basis FROM m QUALIFY tier = min(tier) OVER (PARTITION BY l)"""
)
def match_tiers(spark, sf_dir):
    """Every fiftieth name against all names."""
    k = view(spark, sf_dir, "names").select("id", tx.name_key(F.col("nm")).alias("k"))
    k = k.select("id", "k", tx.abbreviated_key(F.col("k")).alias("ab"), F.try_element_at(F.split("k", " "), F.lit(2)).alias("ep"))
    k = k.withColumn("short", F.when(F.length(F.split("k", " ")[0]) == 1, F.col("k")).otherwise(F.col("ab")))
    left, right = k.where("id % 50 = 0").withColumnRenamed("id", "left"), k.withColumnRenamed("id", "right")
    return resolve.match_tiers(left, right, "left", "right", [("exact", "k", "k"), ("abbreviated", "short", "ab"), ("epithet", "ep", "ep")])


@query(rf"""SELECT id, array_to_string(list_filter(v, lambda x, i: list_position(f, f[i]) = i), '|') AS vals, len(v) AS n FROM (SELECT id, v, list_transform(v, lambda x: lower(regexp_replace(x, '\s+', ' ', 'g'))) AS f
  FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(cell, '[;\n]'), lambda x: trim(x)), lambda x: x <> '') AS v FROM {duck('cells')}))""")
def split_dedupe(spark, sf_dir):
    v = view(spark, sf_dir, "cells").select("id", tx.split_multi(F.col("cell")).alias("v"))
    return v.select("id", F.array_join(tx.dedupe(F.col("v")), "|").alias("vals"), F.size("v").cast("long").alias("n"))


@query(f"SELECT id, 'MG' || (100000 + id) || '|XR' || (200000 + s) || '|AB' || (300000 + id % 50) AS keys FROM (SELECT p_partkey AS id, p_size AS s FROM part)")
def accession_keys(spark, sf_dir):
    return view(spark, sf_dir, "cells").select("id", F.array_join(tx.accessions(F.col("acc")), "|").alias("keys"))


_ENV = "concat_ws('; ', CASE WHEN regexp_matches(t, 'brackish|estuar') THEN 'brackish' END, CASE WHEN regexp_matches(t, 'fresh\\s*water|limnetic|lacustrine|riverine|pond|lake|stream') THEN 'freshwater' END, CASE WHEN regexp_matches(t, 'marine|salt\\s*water|sea\\b|ocean|deep-sea|pelagic|benthic|reef|estuar') THEN 'marine' END, CASE WHEN regexp_matches(t, 'terrestrial|soil|land\\b|forest|compost|tree-bark|domestic') THEN 'terrestrial' END)"
_ENVS = f"(SELECT id, {_ENV} AS envs FROM (SELECT id, lower(place) AS t FROM {duck('cells')}))"


@query(f"SELECT id, envs FROM {_ENVS}")
def habitat_words(spark, sf_dir):
    return view(spark, sf_dir, "cells").select("id", F.array_join(tx.habitats(F.col("place")), "; ").alias("envs"))


@query(f"SELECT replace(envs, '; ', '&') AS combination, count(*) AS n FROM {_ENVS} WHERE envs <> '' GROUP BY 1")
def habitat_combinations(spark, sf_dir):
    long = view(spark, sf_dir, "cells").select("id", F.explode(tx.habitats(F.col("place"))).alias("env"))
    return sets.combinations(long, "id", "env")


@query(
    f"""WITH a AS (SELECT id, envs AS e FROM {_ENVS}), b AS (SELECT id * 2 + 1 AS id, envs AS e FROM {_ENVS}),
  j AS (SELECT coalesce(a.e, '') AS x, coalesce(b.e, '') AS y FROM a FULL JOIN b ON a.id = b.id)
  SELECT count(*) FILTER (x <> '' AND y <> '') AS "both", count(*) FILTER (x <> '' AND y = '') AS only_a, count(*) FILTER (x = '' AND y <> '') AS only_b, count(*) FILTER (x = '' AND y = '') AS neither,
    count(*) FILTER (x <> '' AND y <> '' AND len(list_intersect(string_split(x, '; '), string_split(y, '; '))) > 0) AS agree FROM j"""
)
def concordance(spark, sf_dir):
    e = view(spark, sf_dir, "cells").select("id", tx.habitats(F.col("place")).alias("e"))
    return sets.concordance(e, e.withColumn("id", F.col("id") * 2 + 1), "id", "e")


@query(f"""SELECT id, CASE WHEN regexp_full_match(cell, '[0-9]{{5}}') THEN month(d) || '-' || day(d) ELSE cell END AS fixed FROM (SELECT id, cell, DATE '1899-12-30' + coalesce(TRY_CAST(regexp_extract(cell, '^[0-9]{{5}}$') AS INTEGER), 0) AS d FROM {duck('dates')})""")
def excel_dates(spark, sf_dir):
    return view(spark, sf_dir, "dates").select("id", num.excel_range(F.col("cell")).alias("fixed"))


_SIZE = r"coalesce(TRY_CAST(regexp_extract(size_cell, '([0-9]+\.?[0-9]*)\s*\+/-', 1) AS DOUBLE), (TRY_CAST(regexp_extract(size_cell, '^\s*([0-9]+\.?[0-9]*)\s*-\s*([0-9]+\.?[0-9]*)', 1) AS DOUBLE) + TRY_CAST(regexp_extract(size_cell, '^\s*([0-9]+\.?[0-9]*)\s*-\s*([0-9]+\.?[0-9]*)', 2) AS DOUBLE)) / 2, TRY_CAST(regexp_extract(size_cell, '[0-9]+\.?[0-9]*') AS DOUBLE))"


@query(f"SELECT id, v AS value, CASE WHEN v > 0 AND v <= 10 THEN 'small' WHEN v > 10 AND v <= 30 THEN 'medium' WHEN v > 30 AND v <= 100 THEN 'large' END AS bin FROM (SELECT id, {_SIZE} AS v FROM {duck('cells')})")
def measures(spark, sf_dir):
    v = view(spark, sf_dir, "cells").select("id", num.measure(F.col("size_cell")).alias("value"))
    return v.withColumn("bin", num.binned(F.col("value"), [0, 10, 30, 100], ["small", "medium", "large"]))


@query(f"SELECT shape, count(v) AS n, round(median(v), 4) AS median, min(v) AS lo, max(v) AS hi FROM (SELECT shape, {_SIZE} AS v FROM {duck('cells')}) GROUP BY shape")
def shape_summary(spark, sf_dir):
    v = view(spark, sf_dir, "cells").select("shape", num.measure(F.col("size_cell")).alias("v"))
    return v.groupBy("shape").agg(F.count("v").alias("n"), F.round(F.median("v"), 4).alias("median"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("""SELECT p_partkey AS id, replace(replace(replace(replace(p_name || chr(9) || '"' || p_type || chr(10), chr(9), ' '), chr(10), ' '), chr(13), ' '), '"', '''') AS safe FROM part""")
def tsv_safe(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), tx.tsv_safe(F.concat("p_name", F.lit('\t"'), "p_type", F.lit("\n"))).alias("safe"))


@query("""SELECT id, CASE WHEN r > 1 THEN label || '_' || r ELSE label END AS label FROM (SELECT p_partkey AS id, regexp_replace(p_brand || '|' || p_name, '[\\s,:;()\\[\\]''"|/\\\\]+', '_', 'g') AS label,
  row_number() OVER (PARTITION BY regexp_replace(p_brand || '|' || p_name, '[\\s,:;()\\[\\]''"|/\\\\]+', '_', 'g') ORDER BY p_partkey) AS r FROM part)""")
def header_labels(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.safe_label(F.concat_ws("|", "p_brand", "p_name")).alias("label"))
    r = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    return p.select("id", F.when(r > 1, F.concat("label", F.lit("_"), r.cast("string"))).otherwise(F.col("label")).alias("label"))


@query("SELECT p_partkey AS id, reverse(translate(upper(p_name), 'ACGTURYKMBVDH', 'TGCAAYRMKVBHD')) AS rc FROM part")
def reverse_complements(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.reverse_complement(F.upper("p_name")).alias("rc"))


@query(f"""WITH s AS (SELECT * FROM {duck('sources')} WHERE phylum <> ''), v AS (SELECT host, phylum, count(*) AS votes, min(ord) AS f, string_agg(source, '; ' ORDER BY ord) AS srcs FROM s GROUP BY host, phylum),
  r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY votes DESC, f) AS rank, max(votes) OVER (PARTITION BY host) AS most FROM v)
  SELECT host, max(phylum) FILTER (rank = 1) AS winner, max(votes) AS votes, max(srcs) FILTER (rank = 1) AS agree, coalesce(string_agg(srcs, '; ' ORDER BY f) FILTER (rank > 1), '') AS dissent, count(*) FILTER (votes = most) > 1 AS tied FROM r GROUP BY host""")
def phylum_vote(spark, sf_dir):
    return resolve.vote(view(spark, sf_dir, "sources"), "host", "phylum", "source", "ord")


@query(f"SELECT db_row, cluster, n AS n_shared, f AS first_pos FROM (SELECT db_row, cluster, count(*) AS n, min(acc_pos) AS f FROM {duck('records')} GROUP BY db_row, cluster) QUALIFY row_number() OVER (PARTITION BY db_row ORDER BY n DESC, f, cluster) = 1")
def ownership(spark, sf_dir):
    return resolve.ownership(view(spark, sf_dir, "records"), "db_row", "cluster", "acc_pos")


@query(f"""SELECT cell, species, ord, pos FROM (SELECT *, max(direct OR parasite) OVER w AS d, max(parasite) OVER w AS p FROM {duck('hosts')} WINDOW w AS (PARTITION BY species, cell)) WHERE NOT ((hyper AND d) OR (NOT hyper AND NOT direct AND NOT parasite AND p))""")
def hyperhosts(spark, sf_dir):
    return sets.drop_hyperhosts(view(spark, sf_dir, "hosts"), ["species", "cell"], "hyper", "direct", "parasite").select("cell", "species", "ord", "pos")


@query(f"SELECT role, count(*) AS n FROM {duck('hosts')} WHERE regexp_matches(role, '(?i)natural') OR NOT (regexp_matches(role, '(?i)natural') OR regexp_matches(role, '(?i)experiment')) GROUP BY role")
def role_filter(spark, sf_dir):
    return sets.by_role(view(spark, sf_dir, "hosts"), "role", "natural").groupBy("role").agg(F.count("*").alias("n"))


@query(f"""WITH u AS (SELECT phylum, species, bool_or(named) AS nm FROM {duck('hosts')} GROUP BY phylum, species), c AS (SELECT phylum, count(*) FILTER (nm) AS a, count(*) FILTER (NOT nm) AS b FROM u GROUP BY phylum)
  SELECT CASE WHEN a + b < 1200 THEN 'Other' ELSE phylum END AS phylum, CAST(sum(a) AS BIGINT) AS named, CAST(sum(b) AS BIGINT) AS provisional, CAST(sum(a + b) AS BIGINT) AS total FROM c GROUP BY 1""")
def phylum_bars(spark, sf_dir):
    return sets.stacked(view(spark, sf_dir, "hosts"), "phylum", "species", "named", 1200)


@query(f"""WITH h AS (SELECT *, CASE WHEN lag("end") OVER w IS NULL OR start - lag("end") OVER w - 1 > 200 OR NOT (CASE WHEN strand = '+' THEN mdl_from >= lag(mdl_to) OVER w - 50 ELSE mdl_to <= lag(mdl_from) OVER w + 50 END) THEN 1 ELSE 0 END AS b
    FROM {duck('hits')} WINDOW w AS (PARTITION BY target, strand ORDER BY start, ord)),
  c AS (SELECT *, sum(b) OVER (PARTITION BY target, strand ORDER BY start, ord ROWS UNBOUNDED PRECEDING) AS chain FROM h),
  g AS (SELECT target, strand, CAST(chain AS BIGINT) AS chain, min(start) AS start, max("end") AS "end", min(mdl_from) AS mdl_from, max(mdl_to) AS mdl_to, CAST(sum(score) AS BIGINT) AS score, min(evalue) AS evalue, count(*) AS n_hits FROM c GROUP BY target, strand, chain)
  SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, strand = '-', chain) = 1""")
def best_chains(spark, sf_dir):
    return intervals.chain_hits(view(spark, sf_dir, "hits"), 200)


@query(f"""WITH m AS (SELECT target, start AS s, "end" AS e, max("end") OVER (PARTITION BY target ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {duck('hits')}),
  i AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
  SELECT target, CAST(sum(n) AS BIGINT) AS covered FROM (SELECT target, k, max(e) - min(s) + 1 AS n FROM i GROUP BY target, k) GROUP BY target""")
def model_coverage(spark, sf_dir):
    return intervals.coverage(view(spark, sf_dir, "hits"), "target")


@query("""WITH x AS (SELECT l_suppkey AS c, l_partkey % 90 AS s FROM lineitem), n AS (SELECT c, s, count(*) AS n FROM x GROUP BY c, s), a AS (SELECT c, sum(n) AS a, count(*) AS k FROM n GROUP BY c), b AS (SELECT s, sum(n) AS b, count(*) AS k FROM n GROUP BY s), t AS (SELECT sum(n) AS t FROM n),
  m AS (SELECT (SELECT -sum(a / t * ln(a / t)) FROM a, t) AS hc, (SELECT -sum(b / t * ln(b / t)) FROM b, t) AS hs, (SELECT -sum(n / t * ln(n / a)) FROM n JOIN a USING (c), t) AS hsc, (SELECT -sum(n / t * ln(n / b)) FROM n JOIN b USING (s), t) AS hcs,
    (SELECT sum(n * (n - 1) / 2) FROM n) AS cn, (SELECT sum(a * (a - 1) / 2) FROM a) AS ca, (SELECT sum(b * (b - 1) / 2) FROM b) AS cb, (SELECT t FROM t) AS t),
  h AS (SELECT *, CASE WHEN hs = 0 THEN 1 ELSE 1 - hsc / hs END AS ho, CASE WHEN hc = 0 THEN 1 ELSE 1 - hcs / hc END AS co, ca * cb / (t * (t - 1) / 2) AS ex, (ca + cb) / 2 AS mx FROM m)
  SELECT CAST(t AS BIGINT) AS n, (SELECT count(*) FROM b WHERE k > 1) AS split_species, (SELECT count(*) FROM a WHERE k > 1) AS mixed_clusters, round(ho, 4) AS homogeneity, round(co, 4) AS completeness, round(2 * ho * co / (ho + co), 4) AS v_measure, round((cn - ex) / (mx - ex), 4) AS ari FROM h""")
def cluster_metrics(spark, sf_dir):
    x = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("c"), (F.col("l_partkey") % 90).alias("s"))
    return clusters.cluster_metrics(x, "c", "s")


@query(f"SELECT g.\"row\", g.step, g.cost, g.value FROM {duck('grid')} g WHERE NOT EXISTS (SELECT 1 FROM {duck('grid')} o WHERE o.cost <= g.cost AND o.value <= g.value AND (o.cost < g.cost OR o.value < g.value))")
def pareto_front(spark, sf_dir):
    return clusters.pareto(view(spark, sf_dir, "grid"), "cost", "value").select("row", "step", "cost", "value")


@query(f"SELECT \"row\", max(b) AS best, max(step) AS edge FROM (SELECT *, max(value) OVER (PARTITION BY \"row\") AS b FROM {duck('grid')}) WHERE value >= 0.9 * b GROUP BY \"row\"")
def plateaus(spark, sf_dir):
    return clusters.plateau(view(spark, sf_dir, "grid"), "row", "step", "value", 0.1)


@query(f"SELECT \"row\", step, round(value - lag(value) OVER (PARTITION BY \"row\" ORDER BY step), 6) AS delta FROM {duck('grid')}")
def step_deltas(spark, sf_dir):
    return clusters.steps(view(spark, sf_dir, "grid"), "row", "step", "value").select("row", "step", F.round("delta", 6).alias("delta"))


_TREE = f"{duck('edges')}"
_UP = f"up(node, ancestor, distance) AS (SELECT child, child, 0 FROM {_TREE} UNION ALL SELECT up.node, e.parent, up.distance + 1 FROM up JOIN {_TREE} e ON up.ancestor = e.child)"


@query(f"WITH RECURSIVE {_UP} SELECT ancestor AS node, count(*) AS n_below FROM up WHERE distance > 0 GROUP BY ancestor")
def descendants(spark, sf_dir):
    return trees.intervals(view(spark, sf_dir, "edges")).where("last > pre").select("node", (F.col("last") - F.col("pre")).alias("n_below"))


@query(f"""WITH RECURSIVE {_UP}, tip AS (SELECT child FROM {_TREE} WHERE child NOT IN (SELECT parent FROM {_TREE})),
  pure AS (SELECT ancestor, count(*) AS n FROM up JOIN tip ON node = child GROUP BY ancestor HAVING min(CASE WHEN (node // 4) % 3 > 0 THEN 1 ELSE 0 END) = 1)
  SELECT ancestor AS node, n AS n_tips FROM pure p WHERE NOT EXISTS (SELECT 1 FROM {_TREE} e JOIN pure q ON q.ancestor = e.parent WHERE e.child = p.ancestor)""")
def pure_subclades(spark, sf_dir):
    e = view(spark, sf_dir, "edges")
    return trees.pure_subclades(spark, e, e.select(F.col("child").alias("node")).where("(node DIV 4) % 3 > 0"))


@query(f"""WITH RECURSIVE {_UP}, m AS (SELECT child AS node, child // 50 AS g FROM {_TREE}), a AS (SELECT g, ancestor, count(*) AS k, max(distance) AS far FROM m JOIN up USING (node) GROUP BY g, ancestor)
  SELECT g, arg_min(ancestor, far) AS node FROM a JOIN (SELECT g, count(*) AS n FROM m GROUP BY g) USING (g) WHERE k = n GROUP BY g""")
def common_ancestors(spark, sf_dir):
    e = view(spark, sf_dir, "edges")
    return trees.common_ancestor(spark, e, e.select(F.col("child").alias("node"), F.expr("child DIV 50").alias("g")), "g")


@query("""WITH p AS (SELECT a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 100 AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)
  SELECT label, count(*) AS n_pairs, round(avg(s), 3) AS mean, round(min(s), 3) AS lo, round(max(s), 3) AS hi, count(*) FILTER (s < 90) AS under_90 FROM p GROUP BY label""")
def pair_identity(spark, sf_dir):
    """Identities within each class: all pairs, block by block."""
    return identity.pair_identity(_table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query("""WITH n AS (SELECT DISTINCT substr(p_type, 1, 5) || CAST(p_size AS STRING) AS a FROM part) SELECT x.a, y.a AS b FROM n x JOIN n y ON x.a < y.a AND levenshtein(x.a, y.a) = 1""")
def similar_names(spark, sf_dir):
    return resolve.one_edit(_table(spark, sf_dir, "part").select(F.concat(F.left("p_type", F.lit(5)), F.col("p_size").cast("string")).alias("nm")), "nm")


@query("SELECT lower(p_name) AS name, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return _table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id")).where("n > 1")


@query("""SELECT coalesce(a.k, b.k) AS host, coalesce(nullif(a.v, ''), b.v, '') AS env, CASE WHEN a.k IS NULL THEN 'prediction' WHEN b.k IS NULL THEN 'lookup' ELSE 'both' END AS side
  FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS v FROM part) a FULL JOIN (SELECT c_custkey * 2 AS k, c_mktsegment AS v FROM customer) b ON a.k = b.k""")
def combined_hosts(spark, sf_dir):
    """Lookup and prediction side by side: the lookup's value first, blanks filled from the prediction."""
    a = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("host"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_type")).alias("a"), F.lit(1).alias("in_a"))
    b = _table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("host"), F.col("c_mktsegment").alias("b"), F.lit(1).alias("in_b"))
    side = F.when(F.col("in_a").isNull(), "prediction").when(F.col("in_b").isNull(), "lookup").otherwise("both")
    return a.join(b, "host", "full").select("host", F.coalesce(F.nullif("a", F.lit("")), "b", F.lit("")).alias("env"), side.alias("side"))


@query("SELECT o_custkey AS cust, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey * 3 FROM supplier) GROUP BY o_custkey")
def cache_todo(spark, sf_dir):
    cache = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("cust"))
    return _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(F.count("*").alias("n")).join(cache, "cust", "left_anti")


@query("SELECT phylum, species, n FROM (SELECT species, count(DISTINCT phylum) AS n, min(phylum) AS phylum FROM " + duck("hosts") + " GROUP BY species) WHERE n > 1 ORDER BY n DESC, species LIMIT 8")
def multi_phylum(spark, sf_dir):
    """The report's eight species of the most phyla."""
    m = view(spark, sf_dir, "hosts").groupBy("species").agg(F.countDistinct("phylum").alias("n"), F.min("phylum").alias("phylum"))
    return m.where("n > 1").orderBy(F.desc("n"), "species").limit(8).select("phylum", "species", "n")


@query("""SELECT month, n, CAST(sum(n) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1)""")
def ledger(spark, sf_dir):
    """Running total over monthly sums; the window sees one row a month."""
    n = _table(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("month")).agg(F.count("*").alias("n"))
    return n.withColumn("running", F.sum("n").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))


@query("""SELECT l_orderkey AS cell, l_linenumber AS pos, first_value(l_partkey) OVER w AS earlier FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)
  WINDOW w AS (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def carried_genera(spark, sf_dir):
    x = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") % 2).alias("initial"), F.col("l_partkey").alias("genus"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    return resolve.carry_forward(x, "cell", "at", "initial", "genus", "earlier").select("cell", "pos", "earlier")


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def json_properties(spark, sf_dir):
    k = F.from_json("props", "k long")["k"] % 10
    return _table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, source, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2, 3""")
def label_concordance(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "source")
    j = d.join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.groupBy(F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"), "source").agg(F.count("*").alias("n"))
