"""Leaf orders and heights against one merge at a time in plain Python."""

import random

from sedgeline.operators import dendrogram as dg
from sedgeline.plans.more import leaf_orders
from sedgeline.plans.views import view


def upgma(pairs):
    """{leaf: (part, place)} and the set of merges, from {(a, b): [distances]} of one group."""
    edges = {}
    for (a, b), ds in pairs.items():
        if a != b:
            k = (min(a, b), max(a, b))
            s, n = edges.get(k, (0, 0))
            edges[k] = (s + sum(round(d * 1e6) for d in ds), n + len(ds))
    order = {x: [x] for p in pairs for x in p}
    made = dict.fromkeys(order, (-1, 0))
    merges, step = set(), 0
    while edges:
        step += 1
        d, a, b = min((s / n * 1e-6, a, b) for (a, b), (s, n) in edges.items())
        la, lb = order[a], order.pop(b)
        a_first = len(la) == 1 or (len(lb) > 1 and made[a] < made[b])
        order[a] = la + lb if a_first else lb + la
        made[a] = (d, step)
        merges.add((a, b, round(d, 6), len(order[a])))
        old, edges = edges, {}
        for (x, y), (s, n) in old.items():
            x, y = sorted((a if x == b else x, a if y == b else y))
            if x != y:
                s0, n0 = edges.get((x, y), (0, 0))
                edges[x, y] = (s0 + s, n0 + n)
    return {x: (part, i) for part, xs in order.items() for i, x in enumerate(xs, 1)}, merges


def _held(leaves, merges, groups):
    want, trees = set(), set()
    for g, pairs in groups.items():
        places, m = upgma(pairs)
        want |= {(g, x, part, i) for x, (part, i) in places.items()}
        trees |= {(g, *t) for t in m}
    got = [tuple(r) for r in leaves.collect()]
    assert len(got) == len(want) and set(got) == want
    if merges is not None:
        found = [(r[0], r.a, r.b, round(r.height, 6), r.size) for r in merges.collect()]
        assert len(found) == len(trees) and set(found) == trees


def test_random_groups_with_missing_and_repeated_pairs(spark):
    rng = random.Random(5)
    groups, rows = {}, []
    for g, n, share in (("x", 13, 1.0), ("y", 9, 0.3), ("z", 2, 1.0), ("w", 12, 0.6)):
        leaves = [f"c{i:02d}" for i in range(n)]
        for i, a in enumerate(leaves):
            for b in leaves[:i]:
                if rng.random() < share:
                    ds = [rng.random() * 90 for _ in range(rng.choice((1, 1, 2)))]
                    groups.setdefault(g, {})[a, b] = ds
                    rows += [(g, a, b, d) if rng.random() < 0.5 else (g, b, a, d) for d in ds]
    leaves, merges = dg.average_linkage(spark, spark.createDataFrame(rows, "species string, a string, b string, distance double"))
    _held(leaves.select("species", "leaf", "part", "place"), merges, groups)


def test_nulls_ties_and_empty_tables(spark):
    schema = "species string, a string, b string, distance double, node int, d int"
    rows = [("s", "p", "q", 1.0, 0, 0), ("s", "r", "t", 1.0, 0, 0), ("s", "p", "r", 5.0, 0, 0), ("s", "u", "u", 0.0, 0, 0), ("s", "v", "p", None, 0, 0), (None, "p", "q", 1.0, 0, 0), ("s", None, "q", 1.0, 0, 0)]
    leaves, merges = dg.average_linkage(spark, spark.createDataFrame(rows, schema))
    assert sorted(tuple(r) for r in leaves.collect()) == [("s", "p", "p", 1), ("s", "q", "p", 2), ("s", "r", "p", 3), ("s", "t", "p", 4), ("s", "u", "u", 1), ("s", "v", "v", 1)]
    assert sorted((r.a, r.b, r.height, r.size) for r in merges.collect()) == [("p", "q", 1.0, 2), ("p", "r", 5.0, 4), ("r", "t", 1.0, 2)]
    leaves, merges = dg.average_linkage(spark, spark.createDataFrame([], schema))
    assert leaves.isEmpty() and merges.isEmpty()


def test_the_query(spark):
    groups = {}
    for r in view(spark, "/root/testdata/sf0.001", "identities").collect():
        groups.setdefault(r.species, {}).setdefault((r.a, r.b), []).append(float(100 - r.identity))
    _held(leaf_orders(spark, "/root/testdata/sf0.001").select("species", "cluster", "part", "place"), None, groups)


def test_matrix_file(spark, tmp_path):
    rows = [("s", "b", "a", 91.5), ("s", "a", "b", 91.25), ("s", "c", "a", 70.12345), ("s", "c", "b", None)]
    cells = dg.matrix_cells(spark.createDataFrame(rows, "species string, a string, b string, identity double"))
    dg.write_matrix(cells.where("species = 's'"), str(tmp_path / "m"), ["a", "b", "c"])
    text = next((tmp_path / "m").glob("*.csv")).read_text()
    assert text == "cluster\ta\tb\tc\na\t100\t91.500\t70.123\nb\t91.500\t100\t\nc\t70.123\t\t100\n"


def test_no_side_of_a_join_goes_through_the_driver(spark):
    edges = spark.range(4).selectExpr("'g' AS species", "'a' AS a", "concat('b', id) AS b", "id AS s", "1L AS n")
    nodes = spark.range(4).selectExpr("'g' AS species", "concat('b', id) AS node", "1L AS size", "0.0D AS height", "0 AS born")
    plan = dg._reciprocal(edges, nodes, "species")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
