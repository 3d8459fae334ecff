"""Tree functions on whole trees that are deeper and larger than those of the registered queries."""

import pytest
from pyspark.sql import functions as F

from sedgeline.operators import trees
from sedgeline.operators.running import running
from sedgeline.scratch import Scratch


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "parent long, child long")


def test_ancestors_of_a_deep_tree(spark):
    pairs = [(i - 1, i) for i in range(1, 151)] + [(40, 1000), (1000, 1001)]
    above = {c: p for p, c in pairs}
    want = set()
    for node in above:
        at, d = node, 0
        want.add((node, node, 0))
        while at in above:
            at, d = above[at], d + 1
            want.add((node, at, d))
    got = [tuple(r) for r in trees.ancestors(spark, _edges(spark, pairs)).select("node", "ancestor", "distance").collect()]
    assert len(got) == len(want) and set(got) == want


def test_subclades_and_common_ancestor_of_a_whole_tree(spark):
    pairs = [(c // 2, c) for c in range(2, 1024)]
    e = _edges(spark, pairs)
    tips = spark.createDataFrame([(t,) for t in range(512, 1024) if t // 64 == 9 or t == 1023], "node long")
    assert sorted(tuple(r) for r in trees.pure_subclades(spark, e, tips).collect()) == [(9, 64), (1023, 1)]
    groups = spark.createDataFrame([(1, 1022), (1, 1023), (2, 512), (2, 1023)], "g long, node long")
    assert sorted(tuple(r) for r in trees.common_ancestor(spark, e, groups, "g").select("g", "node").collect()) == [(1, 511), (2, 1)]


def test_circle(spark):
    with pytest.raises(ValueError):
        trees.ancestors(spark, _edges(spark, [(1, 2), (2, 1)]))


def _walk(pairs):
    """Numbers of nodes by plain recursion over a stack."""
    kids, above = {}, {}
    for p, c in sorted(set(pairs)):
        kids.setdefault(p, []).append(c)
        above[c] = p
    out = {}
    for root in kids:
        if root in above:
            continue
        n = tips = 0
        stack = [(root, 0, False)]
        while stack:
            v, d, leaves = stack.pop()
            if leaves:
                out[v][4], out[v][6] = n, tips - out[v][7] + 1
                continue
            n += 1
            out[v] = [root, v, above.get(v), n, None, d, None, tips + 1]
            if v not in kids:
                tips += 1
            stack.append((v, d, True))
            stack += [(c, d + 1, False) for c in reversed(kids.get(v, []))]
    return sorted(tuple(x) for x in out.values())


def _numbers(df):
    return sorted(tuple(r) for r in df.select("root", "node", "parent", "pre", "last", "depth", "n_tips", "first_tip").collect())


@pytest.mark.parametrize(
    "pairs",
    [
        [(c // 2, c) for c in range(2, 300)],
        [(i, i + 1) for i in range(1, 400)] + [(i, 1000 + i) for i in range(1, 400)],
        [(1, c) for c in range(2, 700)],
        [(1, 2), (1, 3), (1, 3), (10, 11), (20, 21), (21, 22), (21, 23)],
        [],
    ],
    ids=["binary", "caterpillar", "star", "forest with repeats", "empty"],
)
def test_intervals(spark, pairs):
    assert _numbers(trees.intervals(_edges(spark, pairs))) == _walk(pairs)


def test_intervals_pass_over_nulls_and_refuse_what_is_no_forest(spark):
    assert _numbers(trees.intervals(_edges(spark, [(1, 2), (None, 3), (2, None)]))) == _walk([(1, 2)])
    for bad in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 2)], [(1, 3), (2, 3)], [(0, 9), (1, 2), (2, 3), (3, 1)]):
        with pytest.raises(ValueError):
            trees.intervals(_edges(spark, bad))


def test_order_of_children_and_extra_columns(spark):
    df = spark.createDataFrame([("r", "a", 2, "x"), ("r", "b", 1, "x"), ("a", "c", 5, None), ("a", "d", 4, "y")], "parent string, child string, _o int, root string")
    got = {r.node: (r.pre, r.first_tip, r.n_tips) for r in trees.intervals(df, order="_o").collect()}
    assert got == {"r": (1, 1, 3), "b": (2, 1, 1), "a": (3, 2, 2), "d": (4, 2, 1), "c": (5, 3, 1)}


def test_reroot(spark):
    e = _edges(spark, [(1, 2), (1, 3), (2, 4), (2, 5), (5, 6), (5, 7), (50, 51), (50, 52)])
    got = sorted(tuple(r) for r in trees.reroot(e, 6, 99).collect())
    assert got == sorted([(99, 6), (99, 5), (5, 7), (5, 2), (2, 4), (2, 3), (50, 51), (50, 52)])
    # a child of a root of two: the root's id alone
    assert sorted(tuple(r) for r in trees.reroot(e, 3, 99).collect()) == sorted([(99, 3), (99, 2), (2, 4), (2, 5), (5, 6), (5, 7), (50, 51), (50, 52)])
    # a root of three stays
    assert sorted(tuple(r) for r in trees.reroot(_edges(spark, [(1, 2), (1, 3), (1, 4), (2, 5), (2, 6)]), 5, 9).collect()) == sorted([(9, 5), (9, 2), (2, 6), (2, 1), (1, 3), (1, 4)])
    for outgroup, new in ((1, 99), (77, 99), (6, 2)):
        with pytest.raises(ValueError):
            trees.reroot(e, outgroup, new)


def test_clade_report(spark):
    numbers = trees.intervals(_edges(spark, [(1, 2), (1, 3), (2, 4), (2, 5), (3, 6), (3, 7), (7, 8), (7, 9)]))
    members = spark.createDataFrame([("a", 4), ("a", 5), ("a", 8), ("a", 8), ("b", 6), ("b", 900), ("c", 901), ("d", 8), ("d", 9), ("d", 3), (None, 4), ("e", None)], "clade string, node long")
    got = {r.clade: tuple(r)[1:] for r in trees.clade_report(numbers, members, Scratch(spark, "t")).collect()}
    assert got == {"a": (3, 3, 2, 1, 3, 1, 2), "b": (2, 1, 1, 1, 1, None, None), "d": (3, 2, 1, 0, 2, 7, 0)}


def test_running_over_ranges(spark):
    rows = [(g, i, (i * 37) % 101) for g, n in (("hot", 3000), ("b", 1), ("c", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    for how, plain in ((F.max, max), (F.min, min), (F.sum, lambda x: sum(x))):
        got = {(r.g, r.i): (r.a, r.b) for r in running(running(df, ["g"], ["i"], {"a": F.col("v")}, Scratch(spark, "t"), how), ["g"], ["i"], {"b": F.col("v")}, Scratch(spark, "t"), how, before=True).collect()}
        assert len(got) == len(rows)
        seen = {}
        for g, i, v in rows:
            before = seen.get(g)
            seen[g] = v if before is None else plain([before, v])
            assert got[g, i] == (seen[g], before)


def test_rounds_of_the_walk_broadcast_nothing(spark):
    """No table of the size of the tree goes through the driver, small as its files are."""
    plans, save = [], Scratch.save

    def kept(self, df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return save(self, df, name)

    Scratch.save = kept
    try:
        e = spark.range(2, 40).select(F.expr("id div 2").alias("parent"), F.col("id").alias("child"))
        trees.intervals(e).count()
    finally:
        Scratch.save = save
    rounds = [p for n, p in plans if n == "steps"][1:] + [p for n, p in plans if n == "numbers"]
    assert len(rounds) > 3 and all("SortMergeJoin" in p and "Broadcast" not in p for p in rounds)


def test_nothing_that_grows_with_the_tree_is_broadcast(spark, monkeypatch):
    """The final plans of all steps, which Spark may have changed as it ran; a running aggregate has a row for each group."""
    from sedgeline.catalog import QUERIES

    plans, save = [], Scratch.save

    def kept(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan())
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", kept)
    for name in ("common_ancestors", "pruned_tree", "tree_intervals"):
        plans.append(QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan())
    e = _edges(spark, [(c // 2, c) for c in range(2, 400)])
    out = running(e, ["parent"], ["child"], {"last": F.col("child")}, Scratch(spark, "plans"), before=True)
    assert len(out.collect()) == 398
    plans.append(out._jdf.queryExecution().executedPlan())
    assert not [p for p in plans if "Broadcast" in p.toString()]


@pytest.mark.parametrize("name", ["pure_subclades", "descendants"])
def test_subclades_and_descendants_broadcast_nothing(spark, monkeypatch, name):
    """The final plans of all steps and of what follows the last one."""
    from sedgeline.catalog import QUERIES

    plans, save = [], Scratch.save

    def kept(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan())
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", kept)
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert out.collect()
    plans.append(out._jdf.queryExecution().executedPlan())
    assert len(plans) > 9 and not [p for p in plans if "Broadcast" in p.toString()]
