"""Queries of trees: numbers of nodes, a new root, clades in pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trees
from ..scratch import Scratch
from ..sources.newick import read_newick, write_newick
from .queries import _TREE, query
from .views import view

#: Every node with the children that lead to it; lists come in the order in which a walk enters the nodes.
_WALK = f"walk(node, parent, path) AS (SELECT 1, NULL::BIGINT, [1]::BIGINT[] UNION ALL SELECT e.child, e.parent, list_append(walk.path, e.child::BIGINT) FROM walk JOIN {_TREE} e ON e.parent = walk.node)"
_TIP = f"tip AS MATERIALIZED (SELECT node, path FROM walk WHERE node NOT IN (SELECT parent FROM {_TREE}))"
_UNDER = "under AS MATERIALIZED (SELECT unnest(path) AS node, node AS tip FROM tip)"


@query(
    f"""WITH RECURSIVE {_WALK}, {_TIP}, {_UNDER}, a AS (SELECT unnest(path) AS node, count(*) AS n FROM walk GROUP BY 1), t AS (SELECT node, count(*) AS n FROM under GROUP BY 1), w AS (SELECT node, parent, len(path) - 1 AS depth, row_number() OVER (ORDER BY path) AS pre FROM walk)
  SELECT node, parent, pre, pre + a.n - 1 AS last, depth, t.n AS n_tips FROM w JOIN a USING (node) JOIN t USING (node)"""
)
def tree_intervals(spark, sf_dir):
    return trees.intervals(view(spark, sf_dir, "edges")).select("node", "parent", "pre", "last", "depth", "n_tips")


@query(
    f"""WITH RECURSIVE {_WALK}, o AS (SELECT path, node FROM walk WHERE node = (SELECT max(child) FROM {_TREE})), p AS (SELECT unnest(path) AS node, unnest(range(len(path))) AS i FROM o),
  e AS (SELECT parent, child FROM {_TREE} WHERE child NOT IN (SELECT node FROM p) UNION ALL SELECT b.node, a.node FROM p a JOIN p b ON b.i = a.i + 1 WHERE b.node <> (SELECT node FROM o)
    UNION ALL SELECT 0, node FROM o UNION ALL SELECT 0, list_extract(path, -2) FROM o)
  SELECT CASE WHEN parent = 1 THEN (SELECT parent FROM e WHERE child = 1) ELSE parent END AS parent, child FROM e WHERE child <> 1"""
)
def rerooted_tree(spark, sf_dir):
    """The tree with the greatest tip as its outgroup; the old root has two children, so it goes."""
    e = view(spark, sf_dir, "edges")
    return trees.reroot(e, e.agg(F.max("child")).first()[0], 0)


@query(
    f"""WITH RECURSIVE {_WALK}, {_TIP}, {_UNDER}, g AS (SELECT DISTINCT (child // 3) % 40 AS clade, child AS node FROM {_TREE} WHERE (child * 7) % 10 < 6 UNION SELECT 90 + child % 2, child FROM {_TREE}), f AS MATERIALIZED (SELECT clade, node FROM g WHERE node IN (SELECT node FROM tip)),
  k AS MATERIALIZED (SELECT clade, u.node, count(*) AS n FROM f JOIN under u ON u.tip = f.node GROUP BY 1, 2), t AS MATERIALIZED (SELECT node, count(*) AS n FROM under GROUP BY 1), q AS MATERIALIZED (SELECT k.clade, k.node, k.n, w.parent FROM k JOIN t ON k.node = t.node AND k.n = t.n JOIN walk w ON w.node = k.node),
  m AS (SELECT clade, count(*) AS pieces, count(*) FILTER (n = 1) AS single_tips, sum(n)::BIGINT AS tips_covered FROM q WHERE NOT EXISTS (SELECT 1 FROM q p WHERE p.clade = q.clade AND p.node = q.parent) GROUP BY clade),
  c AS (SELECT clade, count(*) AS members_found FROM f GROUP BY clade), v AS (SELECT k.clade, arg_max(k.node, len(w.path)) AS node FROM k JOIN c ON k.clade = c.clade AND k.n = c.members_found JOIN walk w ON w.node = k.node WHERE c.members_found > 1 GROUP BY 1)
  SELECT c.clade, (SELECT count(*) FROM g WHERE g.clade = c.clade) AS members_given, c.members_found, m.pieces, m.single_tips, m.tips_covered, v.node, t.n - c.members_found AS foreign_tips FROM c JOIN m USING (clade) LEFT JOIN v USING (clade) LEFT JOIN t ON t.node = v.node"""
)
def clade_report(spark, sf_dir):
    """Forty clades of scattered tips, and two large ones; inner nodes count as given and not found."""
    scratch = Scratch(spark, "clades")
    e = view(spark, sf_dir, "edges")
    small = e.where("(child * 7) % 10 < 6").select(F.expr("(child DIV 3) % 40").alias("clade"), F.col("child").alias("node"))
    members = small.union(e.select(90 + F.col("child") % 2, "child"))
    return trees.clade_report(trees.intervals(e, scratch=scratch), members, scratch)


@query(f"SELECT parent::VARCHAR AS parent, child::VARCHAR AS child FROM {_TREE} UNION ALL SELECT NULL, '1'")
def newick_round_trip(spark, sf_dir):
    """The tree written in brackets and read again; nodes are told by their labels."""
    scratch = Scratch(spark, "brackets")
    path = f"{scratch.root}/tree"
    write_newick(view(spark, sf_dir, "edges"), path)
    nodes = read_newick(spark, path, scratch)
    return nodes.join(nodes.select(F.col("child").alias("parent"), F.col("label").alias("above")), "parent", "left").select(F.col("above").alias("parent"), F.col("label").alias("child"))
