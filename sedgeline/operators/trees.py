"""Rooted trees as edge tables (parent, child), worked on by the numbers that a walk around the tree gives to its nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .running import running


def ancestors(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, ancestor, distance) for every node and all above it, itself at distance 0.

    Jumps double in length from step to step, so that a tree of any depth and
    size takes as many joins as its depth has binary digits; each step is
    written. Edges that go around in a circle raise ValueError.
    """
    scratch = Scratch(spark, "ancestors")
    n = edges.count()
    found = [edges.select(F.col("child").alias("node"), F.col("child").alias("ancestor"), F.lit(0).alias("distance"))]
    jump, length = scratch.save(edges.select(F.col("child").alias("ancestor"), F.col("parent").alias("above")), "jump"), 1
    while not jump.isEmpty():
        if length > n:
            raise ValueError("the edges have a circle")
        up = found[0]
        for more in found[1:]:
            up = up.union(more)
        found.append(scratch.save(up.join(jump, "ancestor").select("node", F.col("above").alias("ancestor"), (F.col("distance") + length).alias("distance")), "up"))
        longer = jump.join(jump.select(F.col("ancestor").alias("above"), F.col("above").alias("top")), "above").select("ancestor", F.col("top").alias("above"))
        longer = scratch.save(longer, "jump")
        scratch.drop(jump)
        jump, length = longer, 2 * length
    up = found[0]
    for more in found[1:]:
        up = up.union(more)
    return up


def _large(table: DataFrame) -> DataFrame:
    """A side of a join that grows with the tree: never sent through the driver, though its files are small (numbers of a walk compress well)."""
    return table.hint("merge")


def intervals(edges: DataFrame, order: str | None = None, marked: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(root, node, parent, pre, last, depth, n_tips, first_tip, n_marked) for every node of a forest of ``edges`` (parent, child).

    Nodes are numbered from 1 in each tree as they are entered; a subtree is
    the numbers pre..last, and its tips are first_tip..first_tip + n_tips - 1
    in the order of tips. Children come in the order of the column ``order``,
    or else of their ids. ``n_marked`` counts the nodes of ``marked`` (node) in
    the subtree. Rows with a null are passed over and repeats count once. A
    node with two parents or a circle raises ValueError; no edges give no rows.

    The numbers are the ranks of a walk around the tree that enters and leaves
    each node: every step knows the one before it, and jumps double in length,
    so that a tree of any depth takes as many joins as the walk's length has
    binary digits, over two rows a node.
    """
    own, scratch = scratch or Scratch(edges.sparkSession, "intervals"), Scratch(edges.sparkSession, "walk")
    e = edges.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child", F.col(order or "child").alias("_o"))
    e = scratch.save(e.groupBy("parent", "child").agg(F.min("_o").alias("_o")), "edges")
    if not e.groupBy("child").count().where("count > 1").isEmpty():
        raise ValueError("a node has two parents")
    inner = e.groupBy("parent").agg(F.max_by("child", F.struct("_o", "child")).alias("to"))
    # the sibling before is the greatest of those that come before
    siblings = running(e.withColumn("_at", F.struct("_o", "child")), ["parent"], ["_o", "child"], {"sibling": F.col("_at")}, scratch, before=True)
    roots = inner.select("parent").join(_large(e.select(F.col("child").alias("parent"))), "parent", "left_anti")
    enter = siblings.select(F.col("child").alias("node"), F.lit(False).alias("leaves"), F.coalesce("sibling.child", "parent").alias("to"), F.col("sibling").isNotNull().alias("to_leaves"))
    enter = enter.union(roots.select("parent", F.lit(False), F.lit(None).cast(e.schema["child"].dataType), F.lit(False)))
    nodes = enter.select("node").join(_large(inner.withColumnRenamed("parent", "node")), "node", "left")
    leave = nodes.select("node", F.lit(True).alias("leaves"), F.coalesce("to", "node").alias("to"), F.col("to").isNotNull().alias("to_leaves"))
    steps = enter.union(leave).withColumns({"entered": F.when(F.col("leaves"), 0).otherwise(1).cast("long"), "open": F.when(F.col("leaves"), -1).otherwise(1).cast("long")})
    # a tip is left for itself
    steps = steps.withColumn("tips", F.when(F.col("leaves") & ~F.col("to_leaves"), 1).otherwise(0).cast("long"))
    if marked is None:
        steps = steps.withColumn("marks", F.lit(0).cast("long"))
    else:
        m = marked.select("node").where("node IS NOT NULL").distinct().withColumn("_m", F.lit(1))
        steps = steps.join(_large(m), "node", "left").withColumn("marks", F.when(F.col("leaves"), F.coalesce("_m", F.lit(0))).otherwise(0).cast("long")).drop("_m")
    now, moves = scratch.save(steps.withColumn("root", F.when(F.col("to").isNull(), F.col("node"))), "steps"), not e.isEmpty()
    counted = ("entered", "open", "tips", "marks")
    length, most = 1, 2 * (e.count() + 1)
    if moves and roots.isEmpty():
        raise ValueError("the edges have a circle")
    while moves:
        if length > 2 * most:
            raise ValueError("the edges have a circle")
        ahead = now.select(F.col("node").alias("to"), F.col("leaves").alias("to_leaves"), F.col("to").alias("_to"), F.col("to_leaves").alias("_leaves"), F.col("root").alias("_root"), *(F.col(c).alias(f"_{c}") for c in counted))
        jumped = now.where("to IS NOT NULL").join(_large(ahead), ["to", "to_leaves"]).select("node", "leaves", F.col("_to").alias("to"), F.col("_leaves").alias("to_leaves"), *((F.col(c) + F.col(f"_{c}")).alias(c) for c in counted), F.col("_root").alias("root"))
        seen = Observation()
        after = scratch.save(jumped.unionByName(now.where("to IS NULL")).observe(seen, F.count_if(F.col("to").isNotNull()).alias("moving")), "steps")
        scratch.drop(now)
        now, length, moves = after, 2 * length, seen.get["moving"] > 0  # a task that ran twice counts twice, but never none
    at = lambda c, leaves: F.max(F.when(F.col("leaves") == leaves, F.col(c)))
    found = now.groupBy("root", "node").agg(
        at("entered", False).alias("pre"), at("entered", True).alias("last"), (at("open", False) - 1).alias("depth"), (at("tips", True) - at("tips", False)).alias("n_tips"),
        (at("tips", False) + 1).alias("first_tip"), (at("marks", True) - at("marks", False)).alias("n_marked"),
    )
    out = own.save(found.join(_large(e.select(F.col("child").alias("node"), "parent")), "node", "left").select("root", "node", "parent", "pre", "last", "depth", "n_tips", "first_tip", "n_marked"), "numbers")
    scratch.clear()
    return out


def pure_pieces(numbers: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(clade, node, n_tips): for each clade of ``members`` (clade, node) the greatest subtrees all of whose tips are members; inner nodes among the members say nothing.

    Members form runs in the order of tips, and a subtree is pure where its
    tips lie in one run: an equi-join by the first tip, and one by the parent.
    """
    tips = numbers.where("pre = last").select("root", "node", "first_tip")
    m = members.select("clade", "node").where("clade IS NOT NULL").distinct().join(_large(tips), "node")
    m = running(m, ["clade", "root"], ["first_tip"], {"_before": F.col("first_tip")}, scratch, before=True)
    begins = F.when(F.col("_before").isNull() | (F.col("_before") < F.col("first_tip") - 1), F.col("first_tip"))
    m = scratch.save(running(m, ["clade", "root"], ["first_tip"], {"_run": begins}, scratch), "runs")
    ends = m.groupBy("clade", "root", "_run").agg(F.max("first_tip").alias("_end"))
    run = m.join(_large(ends), ["clade", "root", "_run"]).select("clade", "root", "first_tip", "_end")
    pure = scratch.save(numbers.join(_large(run), ["root", "first_tip"]).where("first_tip + n_tips - 1 <= _end").select("clade", "node", "parent", "n_tips"), "pure")
    return pure.join(_large(pure.select("clade", F.col("node").alias("parent"))), ["clade", "parent"], "left_anti").select("clade", "node", "n_tips")


def pure_subclades(spark: SparkSession, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(node, n_tips): the greatest subclades of which every tip is a member (members: node)."""
    scratch = Scratch(spark, "subclades")
    return pure_pieces(intervals(edges, scratch=scratch), members.select(F.lit(0).alias("clade"), "node"), scratch).select("node", "n_tips")


def _lowest_above(numbers: DataFrame, ends: DataFrame, keep: Scratch) -> DataFrame:
    """``ends`` (…, root, lo, hi) with ``node``, the deepest node whose numbers hold lo..hi.

    Each row starts at the node numbered lo and takes the jumps of 2^k nodes
    upwards, the longest first, that don't reach a node which holds hi.
    """
    scratch = Scratch(numbers.sparkSession, "jumps")
    jumps = [scratch.save(numbers.select("node", F.col("parent").alias("above")).where("parent IS NOT NULL"), "jump")]
    while True:
        j = jumps[-1]
        longer = scratch.save(j.join(_large(j.select(F.col("node").alias("above"), F.col("above").alias("_top"))), "above").select("node", F.col("_top").alias("above")), "jump")
        if longer.isEmpty():
            break
        jumps.append(longer)
    spans = numbers.select("root", "node", "pre", "last")
    at = ends.join(_large(spans.select("root", F.col("pre").alias("lo"), "node", "last")), ["root", "lo"])
    done, below = at.where("last >= hi").drop("last"), scratch.save(at.where("last < hi").drop("last"), "below")
    for j in reversed(jumps):
        to = j.join(_large(spans.select(F.col("node").alias("above"), "last")), "above").select("node", "above", "last")
        up = below.join(_large(to), "node", "left").withColumn("node", F.when(F.col("last") < F.col("hi"), F.col("above")).otherwise(F.col("node"))).drop("above", "last")
        after = scratch.save(up, "below")
        scratch.drop(below)
        below = after
    last_step = below.join(_large(jumps[0]), "node").drop("node").withColumnRenamed("above", "node")
    out = keep.save(done.unionByName(last_step), "above")
    scratch.clear()
    return out


def common_ancestors(numbers: DataFrame, members: DataFrame, group: str, scratch: Scratch) -> DataFrame:
    """(group, node, n_tips, n_found): the deepest node that is or is above all members (group, node) which the forest has; groups whose members are in two trees have none."""
    found = members.select(F.col(f"`{group}`").alias("_g"), "node").where("_g IS NOT NULL").distinct().join(_large(numbers.select("root", "node", "pre")), "node")
    ends = found.groupBy("_g").agg(F.min("root").alias("root"), F.max("root").alias("_other"), F.min("pre").alias("lo"), F.max("pre").alias("hi"), F.count("*").alias("n_found"))
    got = _lowest_above(numbers, ends.where("root = _other").drop("_other"), scratch)
    return got.join(_large(numbers.select("node", "n_tips")), "node").select(F.col("_g").alias(group), "node", "n_tips", "n_found")


def common_ancestor(spark: SparkSession, edges: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """(group, node): the deepest node above all members (group, node) of each group; a group with a member that the tree lacks has none."""
    scratch = Scratch(spark, "common")
    n = members.groupBy(group).agg(F.countDistinct("node").alias("_n"))
    got = common_ancestors(intervals(edges, scratch=scratch), members, group, scratch)
    return got.join(_large(n), group).where("n_found = _n").select(group, "node")


def clade_report(numbers: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(clade, members_given, members_found, pieces, single_tips, tips_covered, node, foreign_tips) for each clade of ``members`` (clade, node), tips of one tree.

    Members that the tree lacks are given but not found, as are inner nodes; a
    clade without any member found has no row. ``node`` is the common ancestor
    and ``foreign_tips`` those of its tips that are no members; both are null
    for a single member.
    """
    m = members.select("clade", "node").where("clade IS NOT NULL").distinct()
    given = m.groupBy("clade").agg(F.count("*").alias("members_given"))
    tips = m.join(_large(numbers.where("pre = last").select("node")), "node", "left_semi")
    pieces = pure_pieces(numbers, tips, scratch).groupBy("clade").agg(F.count("*").alias("pieces"), F.count_if(F.col("n_tips") == 1).alias("single_tips"), F.sum("n_tips").alias("tips_covered"))
    found = tips.groupBy("clade").agg(F.count("*").alias("members_found"))
    above = common_ancestors(numbers, tips, "clade", scratch).where("n_found > 1")
    out = given.join(found, "clade").join(pieces, "clade").join(above, "clade", "left")
    return out.select("clade", "members_given", "members_found", "pieces", "single_tips", "tips_covered", "node", (F.col("n_tips") - F.col("members_found")).alias("foreign_tips"))


def reroot(edges: DataFrame, outgroup, new_root, scratch: Scratch | None = None) -> DataFrame:
    """(parent, child) of the tree with ``new_root`` put on the edge above ``outgroup``, whose sister all the rest becomes.

    Only the edges on the path to the old root turn around; an old root that
    is left with one child goes. Other trees of the forest stay as they are. A
    tree whose root has two children, the outgroup among them, changes the
    root's id alone. An outgroup that isn't in the tree, or is a root, raises
    ValueError.
    """
    scratch = scratch or Scratch(edges.sparkSession, "reroot")
    numbers = intervals(edges, scratch=scratch)
    spot = numbers.where((F.col("node") == F.lit(outgroup)) & F.col("parent").isNotNull()).first()
    if spot is None:
        raise ValueError(f"{outgroup} is no node below a root")
    if not numbers.where(F.col("node") == F.lit(new_root)).isEmpty():
        raise ValueError(f"{new_root} is in the tree already")
    on_path = (F.col("root") == F.lit(spot.root)) & (F.col("pre") <= spot.pre) & (F.col("last") >= spot.pre)
    e = numbers.where("parent IS NOT NULL").select("parent", F.col("node").alias("child"), on_path.alias("_turns"))
    kids = numbers.where((F.col("parent") == F.lit(spot.root)))
    gone = kids.limit(3).count() == 2  # the old root keeps one child besides that on the path
    own = F.col("child") == F.lit(outgroup)
    new = F.lit(new_root)
    turned = e.where(F.col("_turns") & ~own).select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    top = e.where(own).select(F.explode(F.array(F.struct(new.alias("parent"), F.col("child")), F.struct(new.alias("parent"), F.col("parent").alias("child")))).alias("x")).select("x.*")
    out = e.where(~F.col("_turns")).select("parent", "child").union(turned).union(top)
    if not gone:
        return out
    old = F.lit(spot.root)
    to_old = out.where(F.col("child") == old).select(F.col("parent").alias("_above"))
    joined = out.where(F.col("parent") == old).crossJoin(F.broadcast(to_old)).select(F.col("_above").alias("parent"), "child")  # one row with one row
    return out.where((F.col("parent") != old) & (F.col("child") != old)).union(joined)


def arcs(tips: DataFrame, tree: str, pos: str, member: str) -> DataFrame:
    """(tree, first, last, n): runs of members around a circle of positions 1..n; a run over the seam is one arc."""
    w = Window.partitionBy(tree)
    size = tips.groupBy(tree).agg(F.max(pos).alias("_n"))
    island = tips.where(member).withColumn("_g", F.col(pos) - F.row_number().over(w.orderBy(pos)))
    runs = island.groupBy(tree, "_g").agg(F.min(pos).alias("first"), F.max(pos).alias("last")).join(size, tree)
    # where the first run begins at 1 and another ends at n, they are one
    head = F.max(F.when((F.col("first") == 1) & (F.col("last") < F.col("_n")), F.col("last"))).over(w)
    tail = F.max(F.when((F.col("last") == F.col("_n")) & (F.col("first") > 1), 1)).over(w)
    seam = head.isNotNull() & tail.isNotNull()
    marked = runs.withColumn("_seam", seam).withColumn("_head", head)
    ended = marked.where(~(F.col("_seam") & (F.col("first") == 1)))
    over = F.col("_seam") & (F.col("last") == F.col("_n"))
    return ended.select(tree, "first", F.when(over, F.col("_head")).otherwise(F.col("last")).alias("last"), (F.col("last") - F.col("first") + 1 + F.when(over, F.col("_head")).otherwise(0)).alias("n"))


def prune(spark: SparkSession, edges: DataFrame, tips: DataFrame) -> DataFrame:
    """(parent, child) of the tree over the kept tips (node) alone, with nodes of one child left out; the root of what is left has a null parent."""
    scratch = Scratch(spark, "prune")
    numbers = intervals(edges, marked=tips, scratch=scratch).where("n_marked > 0")
    forks = numbers.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("k")).where("k > 1")
    stays = scratch.save(forks.select(F.col("parent").alias("node")).union(tips.select("node").join(_large(numbers.select("node")), "node", "left_semi")).distinct(), "stays")
    # what goes has one child; its parent is looked up over ever longer jumps
    kept = stays.withColumn("_stays", F.lit(True))
    up = scratch.save(numbers.select("node", F.col("parent").alias("above")).join(_large(kept.select(F.col("node").alias("above"), "_stays")), "above", "left").select("node", "above", (F.col("_stays").isNotNull() | F.col("above").isNull()).alias("done")), "up")
    while not (open_ := up.where("NOT done")).isEmpty():
        ahead = up.select(F.col("node").alias("above"), F.col("above").alias("_above"), F.col("done").alias("_done"))
        after = scratch.save(open_.join(_large(ahead), "above").select("node", F.col("_above").alias("above"), F.col("_done").alias("done")).union(up.where("done").select("node", "above", "done")), "up")
        scratch.drop(up)
        up = after
    return up.join(_large(stays), "node", "left_semi").select(F.col("above").alias("parent"), F.col("node").alias("child"))
