"""More queries: trees, write-back, causes, summaries and selectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import text as tx
from ..operators import dendrogram, resolve, trees
from .queries import _ABBR, _KEYED, _TREE, _UP, QUERIES, _table, query
from .views import duck, view

_CIRCLE = "(SELECT o_custkey % 50 AS tree, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS pos, o_orderkey % 5 < 3 AS m FROM orders)"


@query(
    f"""WITH x AS {_CIRCLE}, e AS (SELECT tree, max(pos) AS n FROM x GROUP BY tree),
  i AS (SELECT tree, pos, pos - row_number() OVER (PARTITION BY tree ORDER BY pos) AS g FROM x WHERE m), r AS (SELECT tree, min(pos) AS a, max(pos) AS b FROM i GROUP BY tree, g),
  s AS (SELECT f.tree, f.b AS fb, l.a AS la FROM e JOIN r f ON f.tree = e.tree AND f.a = 1 JOIN r l ON l.tree = e.tree AND l.b = e.n AND l.a > 1 WHERE f.b < e.n)
  SELECT r.tree, r.a AS first, CASE WHEN r.a = s.la THEN s.fb ELSE r.b END AS last, r.b - r.a + 1 + CASE WHEN r.a = s.la THEN s.fb ELSE 0 END AS n FROM r LEFT JOIN s ON r.tree = s.tree WHERE s.tree IS NULL OR r.a <> 1"""
)
def circular_arcs(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("tree"), "o_orderkey")
    pos = F.row_number().over(Window.partitionBy("tree").orderBy("o_orderkey")).cast("long")
    return trees.arcs(o.select("tree", pos.alias("pos"), (F.col("o_orderkey") % 5 < 3).alias("m")), "tree", "pos", "m")


@query(
    f"""WITH RECURSIVE {_UP}, tip AS (SELECT child AS node FROM {_TREE} WHERE child NOT IN (SELECT parent FROM {_TREE}) AND child % 5 = 0),
  k AS (SELECT DISTINCT ancestor AS node FROM up JOIN tip USING (node) UNION SELECT e.parent FROM up JOIN tip USING (node) JOIN {_TREE} e ON e.child = up.ancestor),
  s AS (SELECT parent AS node FROM {_TREE} e JOIN k ON e.child = k.node GROUP BY parent HAVING count(*) > 1 UNION SELECT node FROM tip)
  SELECT (SELECT arg_min(u.ancestor, u.distance) FROM up u JOIN s t ON t.node = u.ancestor WHERE u.node = s.node AND u.distance > 0) AS parent, s.node AS child FROM s"""
)
def pruned_tree(spark, sf_dir):
    e = view(spark, sf_dir, "edges")
    return trees.prune(spark, e, e.where("child % 5 = 0").select(F.col("child").alias("node")).join(e.select(F.col("parent").alias("node")).hint("merge"), "node", "left_anti"))


_UPD = "(SELECT c_custkey AS u, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'A' || CAST(c_custkey % 400 AS STRING) END AS acc, c_mktsegment || CAST(c_nationkey AS STRING) AS nm FROM {customer})"
_ROWS = "(SELECT s_suppkey AS r, 'A' || CAST(s_suppkey * 3 % 400 AS STRING) AS acc, CASE WHEN s_suppkey % 2 = 0 THEN 'MACHINERY' ELSE 'BUILDING' END || CAST(s_nationkey AS STRING) AS nm FROM {supplier})"
_HITS = f"(SELECT * FROM (SELECT u, r, 1 AS tier, 'acc' AS basis FROM {_UPD} a JOIN {_ROWS} b ON a.acc = b.acc WHERE a.acc <> '' UNION SELECT u, r, 2, 'nm' FROM {_UPD} a JOIN {_ROWS} b ON a.nm = b.nm) QUALIFY tier = min(tier) OVER (PARTITION BY u))".replace("{customer}", "customer").replace("{supplier}", "supplier")


def _write_back(spark, sf_dir):
    u = spark.sql(f"SELECT * FROM {_UPD} q", customer=_table(spark, sf_dir, "customer"))
    r = spark.sql(f"SELECT * FROM {_ROWS} q", supplier=_table(spark, sf_dir, "supplier"))
    return resolve.write_back(u, r, "u", "r", ["acc", "nm"])


@query(f"SELECT u, min(r) AS r, min(basis) AS basis FROM {_HITS} GROUP BY u HAVING count(DISTINCT r) = 1")
def write_back_changes(spark, sf_dir):
    return _write_back(spark, sf_dir)[0]


@query(f"SELECT c_custkey AS u, coalesce(n, 0) AS n_rows, CASE WHEN n IS NULL THEN 'no row' ELSE 'ambiguous' END AS reason FROM customer LEFT JOIN (SELECT u, count(DISTINCT r) AS n FROM {_HITS} GROUP BY u) h ON u = c_custkey WHERE n IS NULL OR n > 1")
def write_back_review(spark, sf_dir):
    return _write_back(spark, sf_dir)[1]


@query(
    f"""WITH n AS (SELECT id % 300 AS cluster, k, t FROM {_KEYED} WHERE k <> ''), c AS (SELECT cluster, count(DISTINCT t[1]) AS g, count(DISTINCT t[2]) AS e, count(DISTINCT k) AS n FROM n GROUP BY cluster)
  SELECT CASE WHEN n <= 1 THEN 'pure' WHEN g > 1 AND e = 1 THEN 'same epithet in other genera' WHEN g > 1 THEN 'several genera' WHEN e > 1 THEN 'several species of one genus' ELSE 'spelling' END AS cause, count(*) AS n FROM c GROUP BY 1"""
)
def mixture_causes(spark, sf_dir):
    k = view(spark, sf_dir, "names").select((F.col("id") % 300).alias("cluster"), tx.name_key(F.col("nm")).alias("k")).where("k <> ''")
    p = F.split("k", " ")
    c = k.groupBy("cluster").agg(F.countDistinct(p[0]).alias("g"), F.countDistinct(F.try_element_at(p, F.lit(2))).alias("e"), F.countDistinct("k").alias("n"))
    return c.groupBy(resolve.mixture_cause(F.col("g"), F.col("e"), F.col("n")).alias("cause")).agg(F.count("*").alias("n"))


@query(f"SELECT species, count(*) AS n_hosts, count(DISTINCT phylum) AS n_phyla, string_agg(DISTINCT phylum, '; ' ORDER BY phylum) AS phyla, max(named) AS any_named FROM {duck('hosts')} GROUP BY species")
def species_summary(spark, sf_dir):
    h = view(spark, sf_dir, "hosts").groupBy("species")
    return h.agg(F.count("*").alias("n_hosts"), F.countDistinct("phylum").alias("n_phyla"), F.array_join(F.array_sort(F.collect_set("phylum")), "; ").alias("phyla"), F.max("named").alias("any_named"))


@query(f"""SELECT host, count(*) FILTER (phylum <> '') AS n_sources, coalesce(string_agg(CASE WHEN phylum <> '' THEN source END, '+' ORDER BY ord), '') AS sources,
  concat_ws('; ', CASE WHEN sum(CASE WHEN phylum <> '' THEN 1 ELSE 0 END) = 0 THEN 'unresolved' END, CASE WHEN sum(CASE WHEN phylum <> '' THEN 1 ELSE 0 END) = 1 THEN 'single source' END, CASE WHEN count(DISTINCT nullif(phylum, '')) > 1 THEN 'disagreement' END) AS review FROM {duck('sources')} GROUP BY host""")
def review_reasons(spark, sf_dir):
    """Each host with its sources in fixed order and the reasons to look at it again."""
    s = view(spark, sf_dir, "sources").withColumn("v", F.nullif("phylum", F.lit("")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("ord", "source")))), lambda x: x["source"]), "+")
    g = s.groupBy("host").agg(F.count("v").alias("n_sources"), listed.alias("sources"), F.countDistinct("v").alias("k"))
    n = F.col("n_sources")
    review = F.concat_ws("; ", F.when(n == 0, "unresolved"), F.when(n == 1, "single source"), F.when(F.col("k") > 1, "disagreement"))
    return g.select("host", "n_sources", "sources", review.alias("review"))


@query(
    f"""WITH m AS (SELECT id, CASE WHEN id % 50 = 0 THEN 2 WHEN id % 3 = 0 THEN 1 ELSE 0 END AS n, id % 6 = 0 AS fresh, {_ABBR} AS ab FROM {_KEYED})
  SELECT CASE WHEN n = 1 THEN CASE WHEN fresh THEN 'update' ELSE 'already there' END WHEN n > 1 THEN 'ambiguous' WHEN ab <> '' THEN 'new' ELSE 'provisional' END AS what, count(*) AS n FROM m GROUP BY 1"""
)
def dispositions(spark, sf_dir):
    k = view(spark, sf_dir, "names").select("id", tx.abbreviated_key(tx.name_key(F.col("nm"))).alias("ab"))
    n = F.when(F.col("id") % 50 == 0, 2).when(F.col("id") % 3 == 0, 1).otherwise(0)
    kind = F.when(F.col("ab") != "", "named").otherwise("provisional")
    return k.groupBy(resolve.disposition(n, kind, F.col("id") % 6 == 0).alias("what")).agg(F.count("*").alias("n"))


@query("""SELECT id, array_to_string(list_concat(a, list_filter(b, lambda v: NOT list_contains(list_transform(a, lambda x: lower(x)), lower(v)))), '|') AS appended,
  array_to_string(list_filter(b, lambda v: len(list_filter(a, lambda k: contains(lower(k), lower(v)) OR contains(lower(v), lower(k)))) = 0), '|') AS novel
  FROM (SELECT p_partkey AS id, [p_name, p_brand] AS a, [upper(p_name), p_type, split_part(p_name, ' ', 1), p_brand || '0'] AS b FROM part)""")
def appended_values(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    a, b = F.array("p_name", "p_brand"), F.array(F.upper("p_name"), F.col("p_type"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.concat("p_brand", F.lit("0")))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(resolve.append_values(a, b), "|").alias("appended"), F.array_join(resolve.novel_values(b, a), "|").alias("novel"))


_TERMS = "(SELECT p_partkey AS id, CASE p_partkey % 11 WHEN 0 THEN 'broadly rounded posterior, oval' WHEN 1 THEN 'Pear-shaped (fresh)' WHEN 2 THEN 'short cylindrical' WHEN 3 THEN 'round' WHEN 4 THEN 'ellipsoidal' WHEN 5 THEN 'slender rod' WHEN 6 THEN 'kidney' WHEN 7 THEN 'attenuated' WHEN 8 THEN '' WHEN 9 THEN 'egg shaped' ELSE p_type END AS term FROM part)"


@query(
    f"""WITH x AS (SELECT id, term, trim(regexp_replace(regexp_replace(lower(term), '\\(.*?\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM {_TERMS})
  SELECT id, CASE WHEN regexp_matches(t, 'ovo[- ]?cylindric|oval[- ]?cylindric|barrel|short[- ]?cylindric') THEN 'Ovocylindrical' WHEN regexp_matches(t, 'pyriform|pear|flask') THEN 'Pyriform' WHEN regexp_matches(t, 'spheric|globular|coccoid') OR t = 'round' THEN 'Spherical'
    WHEN regexp_matches(t, 'ellips|elliptic') THEN 'Elliptical' WHEN regexp_matches(t, 'rod|bacill|cylindric|tubular|narrow|slender|needle|straight') THEN 'Rod-shaped' WHEN regexp_matches(t, 'oval|ovoid|egg[- ]?shape|oblong|conical') THEN 'Oval' WHEN regexp_matches(t, 'kidney|spiral|wedge') THEN 'Other' END AS class FROM x"""
)
def shape_terms(spark, sf_dir):
    x = spark.sql(_TERMS.replace("FROM part)", "FROM {part})")[1:-1], part=_table(spark, sf_dir, "part"))
    return x.select("id", terms.shape_class(F.col("term")).alias("class"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Chordata' WHEN 1 THEN 'Bryozoa' WHEN 2 THEN 'Mollusca' ELSE 'Annelida' END AS phylum FROM part")
def phylum_names(spark, sf_dir):
    n = F.element_at(F.array(*map(F.lit, ("Craniata", " ectoprocta", "MOLLUSCA", "Echiura"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), terms.phylum(n).alias("phylum"))


_DICT = "(SELECT 'small' AS alias, 'size' AS category, true AS weak UNION ALL SELECT 'ring', 'metal', false UNION ALL SELECT 'small ring', 'jewel', false UNION ALL SELECT 'widget', 'tool', false UNION ALL SELECT 'red', 'colour', true UNION ALL SELECT 'economy', 'grade', false)"


@query(
    f"""WITH w AS (SELECT p_partkey AS id, string_split(lower(p_name || ' ' || p_type), ' ') AS w FROM part), r AS (SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS alias FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(n) WHERE len(w) >= n)),
  h AS (SELECT id, category, r.alias, row_number() OVER (PARTITION BY id ORDER BY weak, i, n DESC, r.alias) AS k FROM r JOIN {_DICT} d ON r.alias = d.alias) SELECT id, category, alias FROM h WHERE k = 1"""
)
def first_terms(spark, sf_dir):
    cells = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return terms.first_term(cells, spark.sql(_DICT[1:-1]), "id", "t")


@query(
    f"""WITH n AS (SELECT id, nm FROM {duck('names')}), f AS (SELECT DISTINCT string_split(nm, ' ')[1] AS g, lower(coalesce(string_split(nm, ' ')[2], '')) AS e FROM n WHERE regexp_matches(nm, '^[A-Z][a-z-]{{2,}}( |$)')),
  a AS (SELECT substr(g, 1, 1) AS i, count(DISTINCT g) AS k, min(g) AS o FROM f GROUP BY 1), x AS (SELECT substr(g, 1, 1) AS i, e, count(*) AS k, min(g) AS o FROM f WHERE e <> '' GROUP BY 1, 2),
  s AS (SELECT id, substr(nm, 1, 1) AS i, regexp_extract(nm, '\\s+([a-z-]+)$', 1) AS e FROM n WHERE regexp_full_match(nm, '[A-Z]\\.?\\s+[a-z-]{{3,}}'))
  SELECT id, CASE WHEN x.k = 1 THEN x.o || ' ' || s.e WHEN a.k = 1 THEN a.o || ' ' || s.e ELSE '' END AS expanded, CASE WHEN x.k = 1 THEN 'unique match' WHEN a.k = 1 THEN 'only candidate' ELSE 'ambiguous' END AS basis FROM s LEFT JOIN x ON s.i = x.i AND s.e = x.e LEFT JOIN a ON s.i = a.i"""
)
def expanded_initials(spark, sf_dir):
    return terms.expand_initials(view(spark, sf_dir, "names"), "id", "nm")


@query(
    """SELECT coalesce(c, 'ALL') AS confidence, count(*) AS n, count(*) FILTER (a = b) AS exact, round(100.0 * count(*) FILTER (a = b) / count(*), 2) AS percent
  FROM (SELECT CASE WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 10 THEN 'medium' ELSE 'low' END AS c, l_returnflag AS a, CASE WHEN l_linenumber % 3 = 0 THEN 'A' ELSE 'N' END AS b FROM lineitem) GROUP BY ROLLUP (c)"""
)
def accuracy_by_confidence(spark, sf_dir):
    """Agreement by confidence, with a row for all, by one rollup."""
    c = F.when(F.col("l_quantity") > 30, "high").when(F.col("l_quantity") > 10, "medium").otherwise("low")
    same = F.col("l_returnflag") == F.when(F.col("l_linenumber") % 3 == 0, "A").otherwise("N")
    x = _table(spark, sf_dir, "lineitem").select(c.alias("c"), same.alias("same"))
    g = x.rollup("c").agg(F.count("*").alias("n"), F.count_if("same").alias("exact"))
    return g.select(F.coalesce("c", F.lit("ALL")).alias("confidence"), "n", "exact", F.round(100.0 * F.col("exact") / F.col("n"), 2).alias("percent"))


@query(
    """SELECT country, count(*) FILTER (named) AS named, count(*) FILTER (NOT named) AS provisional FROM (SELECT o_custkey, n_name AS country, bool_or(o_orderstatus = 'F') AS named FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY country"""
)
def country_counts(spark, sf_dir):
    """Entities once for each country; the dimension is small and Catalyst broadcasts it by its statistics."""
    j = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    unit = j.groupBy("o_custkey", F.col("n_name").alias("country")).agg(F.max(F.col("o_orderstatus") == "F").alias("named"))
    return unit.groupBy("country").agg(F.count_if("named").alias("named"), F.count_if(~F.col("named")).alias("provisional"))


@query(
    f"""WITH i AS MATERIALIZED {duck('identities')}, m AS (SELECT species, least(a, b) AS a, greatest(a, b) AS b, max(identity) AS v FROM i WHERE a <> b GROUP BY ALL)
  SELECT species, a, b, printf('%.3f', v::DOUBLE) AS text FROM m UNION ALL SELECT species, b, a, printf('%.3f', v::DOUBLE) FROM m UNION ALL SELECT species, a, a, '100' FROM (SELECT species, a FROM i UNION SELECT species, b FROM i)"""
)
def identity_matrix(spark, sf_dir):
    """Cells of the matrices of all species."""
    return dendrogram.matrix_cells(view(spark, sf_dir, "identities"))


def leaf_orders(spark, sf_dir):
    """Order of the clusters in each species' matrix. SQL can't merge step by step; tests hold it against one merge at a time."""
    pairs = view(spark, sf_dir, "identities").select("species", "a", "b", (100 - F.col("identity")).alias("distance"))
    leaves, _ = dendrogram.average_linkage(spark, pairs)
    return leaves.withColumnRenamed("leaf", "cluster")


QUERIES["leaf_orders"] = leaf_orders
