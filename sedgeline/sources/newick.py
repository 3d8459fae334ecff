"""Trees in brackets, read in pieces and written in order.

A file is cut at its commas, however long its one line is: each piece opens
some brackets, holds one tip and closes some brackets. The end of a file is no
cut: what stands before its first comma goes on from the file before it. The depth of a piece is
a running sum over the pieces before it, and the parent of a node is the last
bracket that opened one level higher.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.running import running
from ..operators.trees import intervals
from ..scratch import Scratch


def _over_files(cut: DataFrame) -> DataFrame:
    """``cut`` (_file, _block, _at, value) with the first piece of each file put to the end of the last piece of the file before.

    Only the first and last pieces of files are put in order together; all others stay where they are.
    """
    at = F.struct("_block", "_at")
    ends = cut.groupBy("_file").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    near = cut.join(ends, "_file")
    first = at == F.col("_first")
    order = Window.orderBy("_file", "_block", "_at")
    edge = near.where(first | (at == F.col("_last"))).select("_file", "_block", "_at", "value", F.when(~first, 1).otherwise(0).alias("_new"))
    edge = edge.withColumn("_g", F.sum("_new").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_file", "_block", "_at", "value"))), lambda x: x["value"]), "")
    head = F.min(F.struct("_file", "_block", "_at")).alias("h")
    joined = edge.groupBy("_g").agg(head, text.alias("value")).select("h.*", "value")
    return near.where(~first & (at != F.col("_last"))).select("_file", "_block", "_at", "value").union(joined)


def read_newick(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """(tree, parent, child, label, length) of every node in the files of ``path``: trees end with a semicolon, nodes are numbered as they open, a root's parent is null.

    Files are read in the order of their names, and a tree may go on from one to the next.
    Nodes without a label have '', those without a length null; comments in
    square brackets and quotes around labels go. Quotes or comments that hold
    commas, brackets or semicolons, and brackets that don't match, are errors
    when the rows are read. A file without trees gives no rows.
    """
    scratch = scratch or Scratch(spark, "newick")
    raw = spark.read.option("lineSep", ",").text(path)
    cut = raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    cut = _over_files(scratch.save(cut, "cut"))
    held = F.regexp_replace("value", r"\[[^\]]*\]", "")
    odd = (F.regexp_count(held, F.lit("'")) % 2 > 0) | F.regexp_like(held, F.lit(r"[\[\]]"))
    cut = cut.withColumn("value", F.when(odd, F.raise_error(F.lit("a quote or comment holds a comma"))).otherwise(held))
    p = cut.select("_file", "_block", "_at", F.posexplode(F.split("value", ";")).alias("_sub", "_t"))
    parts = F.regexp_extract("_t", r"^([(\s]*)", 1)
    rest = F.substr("_t", F.length(parts) + 1)
    p = p.select("_file", "_block", "_at", "_sub", F.regexp_count("_t", F.lit(r"\(")).cast("long").alias("_opens"), F.regexp_count(parts, F.lit(r"\(")).cast("long").alias("_leading"), F.split(rest, r"\)").alias("_texts"), (F.trim(F.regexp_replace("_t", r"\s", "")) != "").alias("_some"))
    # a blank piece is a tip without a name between two commas, and nothing after a semicolon
    p = p.withColumn("_holds", F.col("_some") | (F.col("_sub") == 0))
    change = {"_depth": F.col("_opens") - F.size("_texts") + 1, "_nodes": F.when(F.col("_holds"), F.col("_opens") + 1).otherwise(0), "_ends": F.when(F.col("_sub") > 0, 1).otherwise(0)}
    order = ["_file", "_block", "_at", "_sub"]
    p = running(p, [], order, {k: v.cast("long") for k, v in change.items()}, scratch, F.sum, before=True)
    p = p.withColumns({k: F.coalesce(k, F.lit(0)) for k in change}).withColumn("tree", F.col("_ends") + F.when(F.col("_sub") > 0, 1).otherwise(0))
    wrong = (F.col("_opens") != F.col("_leading")) | ((F.col("_sub") > 0) & (F.col("_depth") != 0)) | (F.col("_depth") + F.col("_opens") < F.size("_texts") - 1)
    # what follows the last semicolon of a file, or a file of white space, is no tip
    tips = F.when(wrong, F.raise_error(F.lit("brackets don't match")).cast("boolean")).otherwise(F.expr("_holds AND (_some OR _depth > 0)"))
    p = scratch.save(p.where(tips), "pieces")
    event = lambda level, node, step, opened, child, text: F.struct(level.alias("level"), node.alias("node"), step.alias("step"), opened.alias("opened"), child.alias("child"), text.alias("text"))
    none, last = F.lit(None).cast("long"), F.col("_nodes") + F.col("_opens") + 1
    many = lambda a, b, f: F.when(b >= a, F.transform(F.sequence(a, b), f)).otherwise(F.array())
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    opened = many(one, F.col("_opens"), lambda j: event(F.col("_depth") + j - 1, F.col("_nodes") + j, zero, F.col("_nodes") + j, none, F.lit(None).cast("string")))
    asks = many(one, F.col("_opens") + 1, lambda j: event(F.col("_depth") + j - 2, F.col("_nodes") + j, one, none, F.col("_nodes") + j, F.when(j > F.col("_opens"), F.col("_texts")[0])))
    closed = many(one, F.size("_texts").cast("long") - 1, lambda i: event(F.col("_depth") + F.col("_opens") - i, last, i + 1, none, none, F.get("_texts", i.cast("int"))))
    events = p.select("tree", F.explode(F.concat(opened, asks, closed)).alias("e")).select("tree", "e.*")
    known = scratch.save(running(events, ["tree", "level"], ["node", "step"], {"within": F.col("opened")}, scratch), "events")
    named = known.where("child IS NULL AND opened IS NULL").select(F.col("within").alias("child"), F.col("text").alias("_name"))
    nodes = known.where("child IS NOT NULL").select("tree", F.col("within").alias("parent"), "child", "text").join(named, "child", "left")
    text = F.coalesce("text", "_name", F.lit(""))
    label = F.regexp_replace(F.trim(F.regexp_replace(F.split(text, ":")[0], r"\s+", " ")), "^['\"]|['\"]$", "")
    return nodes.select("tree", "parent", "child", label.alias("label"), F.try_element_at(F.split(text, ":"), F.lit(2)).try_cast("double").alias("length"))


def write_newick(edges: DataFrame, path: str, labels: DataFrame | None = None, order: str | None = None) -> None:
    """Writes the forest of ``edges`` (parent, child) to the folder ``path``, a line for each step of the walk around it, in order over the folder's files.

    ``labels`` (node, label, length) is joined by node; without it labels are
    the nodes themselves. Null labels and lengths are left out; a label that
    holds a mark of the format is an error. No edges give no trees.
    """
    n = intervals(edges, order=order)
    if labels is None:
        n = n.withColumns({"label": F.col("node").cast("string"), "length": F.lit(None).cast("double")})
    else:
        n = n.join(labels.select("node", "label", F.col("length").cast("double")).dropDuplicates(["node"]), "node", "left")
    n = n.join(n.select(F.col("node").alias("parent"), (F.col("pre") + 1).alias("_first")), "parent", "left")
    bad = F.col("label").rlike(r"[\[\](),:;'\"]")
    label = F.when(bad, F.raise_error(F.concat(F.lit("a label holds a mark of the format: "), "label"))).otherwise(F.coalesce("label", F.lit("")))
    name = F.concat(label, F.coalesce(F.concat(F.lit(":"), F.col("length").cast("string")), F.lit("")), F.when(F.col("parent").isNull(), ";").otherwise(""))
    comma = F.when(F.col("pre") > F.col("_first"), ",").otherwise("")
    tip = F.col("pre") == F.col("last")
    enter = F.struct((2 * F.col("pre") - F.col("depth")).alias("at"), F.concat(comma, F.when(tip, name).otherwise("(")).alias("line"))
    leave = F.struct((2 * F.col("last") - F.col("depth") + 1).alias("at"), F.concat(F.lit(")"), name).alias("line"))
    lines = n.select("root", F.explode(F.when(tip, F.array(enter)).otherwise(F.array(enter, leave))).alias("x")).select("root", "x.*")
    lines.orderBy("root", "at").select("line").write.text(path)
