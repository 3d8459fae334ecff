"""Trees in brackets: forms of the format, errors, and whole trees written and read again."""

import pytest

from sedgeline.sources.newick import read_newick, write_newick


def _read(spark, tmp_path, text):
    (tmp_path / "t.nwk").write_text(text)
    return sorted((tuple(r) for r in read_newick(spark, f"file://{tmp_path}/t.nwk").collect()), key=lambda r: r[2])


def test_forms(spark, tmp_path):
    got = _read(spark, tmp_path, "((a:1,b:2e-1)x:3,\n 'c d'[note])root;\n(,(p,q)0.9:1)\n;single;\n")
    assert got == [
        (0, None, 1, "root", None), (0, 1, 2, "x", 3.0), (0, 2, 3, "a", 1.0), (0, 2, 4, "b", 0.2), (0, 1, 5, "c d", None),
        (1, None, 6, "", None), (1, 6, 7, "", None), (1, 6, 8, "0.9", 1.0), (1, 8, 9, "p", None), (1, 8, 10, "q", None), (2, None, 11, "single", None),
    ]


@pytest.mark.parametrize("text", ["((a,b);", "(a,b));", "('a,b',c);", "(a(b,c));"])
def test_errors(spark, tmp_path, text):
    with pytest.raises(Exception, match="match|comma"):
        _read(spark, tmp_path, text)


def test_no_trees(spark, tmp_path):
    assert _read(spark, tmp_path, " \n") == []


def test_round_trip_over_many_splits(spark, tmp_path):
    """A deep chain with tips, a star and a second tree, read in splits of a few hundred bytes."""
    pairs = [(i, i + 1) for i in range(1, 300)] + [(i, 1000 + i) for i in range(1, 300)] + [(7, 5000 + i) for i in range(500)] + [(90000, 90001), (90000, 90002)]
    edges = spark.createDataFrame(pairs, "parent long, child long")
    path = f"file://{tmp_path}/out"
    write_newick(edges, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = read_newick(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    name = {r.child: int(r.label) for r in rows}
    assert sorted((name[r.parent], name[r.child]) for r in rows if r.parent) == sorted(pairs)
    assert sorted(name[r.child] for r in rows if r.parent is None) == [1, 90000] and len(rows) == len(pairs) + 2


def test_a_tree_goes_on_over_files(spark, tmp_path):
    """Files that end within a tip's piece, before a comma, and with one piece alone."""
    for i, text in enumerate(["((a,b\n", ")x\n", ",(c,d)y\n", ")r;\n", "(e\n", ",f)s;\n"]):
        (tmp_path / f"part-{i}").write_text(text)
    rows = read_newick(spark, f"file://{tmp_path}").collect()
    name = {r.child: r.label for r in rows}
    assert sorted((name.get(r.parent, ""), r.label) for r in rows) == [("", "r"), ("", "s"), ("r", "x"), ("r", "y"), ("s", "e"), ("s", "f"), ("x", "a"), ("x", "b"), ("y", "c"), ("y", "d")]
