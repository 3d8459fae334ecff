"""Cells of measurements by rules worked out by hand."""

from sedgeline.operators import measurements as me

#: length, width, shape -> length, width, paired, shape, action
CASES = [
    (("5.5; 4.2 (fresh)", "3.3; 7.0 (fresh)", "oval"), (4.2, 7.0, False, "Oval", "")),
    (("3 (stained); 1.7", "1.45; 3 (stained)", ""), (1.7, 1.45, False, None, "")),
    (("3 (fresh); 2.1 (fixed)", "1.5", None), (3.0, 1.5, False, None, "")),
    (("3 (fixed); 2.5 (fixed, live)", "1 (live); 2 (fixed live)", ""), (2.5, 2.0, True, None, "")),  # by label
    (("4 (a); 5 (b)", "1 (c); 2 (live)", ""), (4.0, 1.0, True, None, "")),  # by place
    (("5.10 fixed/5.75 fresh", "2 fixed/3 fresh", "rod (fixed); oval (fresh)"), (5.1, 2.0, False, None, "excluded")),  # a slash is cut for pairing alone, so the cell names both conditions
    (("4.03 +/- 0.28 (3.71 - 4.33 um)", "3.7 - 4.9 um (avg: 4.4 um)", "pear"), (4.03, 4.4, False, "Pyriform", "")),
    (("0.5-0.8", "(0.5-0.8 um diameter)", "kidney"), (0.65, 0.65, False, "Other", "")),
    (("7 (macrospore, fresh); 5 (stained)", "many", "curved"), (5.0, None, False, None, "")),
    (("5 (fixed)", "2", "rod (fresh); oval (fixed)"), (5.0, 2.0, False, "Oval", "retaken")),
    (("5 (fixed)", "2", "rod (fresh)"), (5.0, 2.0, False, None, "excluded")),
    (("5 (meiospore)", "2", "rod (macrospore); horseshoe (meiospore)"), (5.0, 2.0, False, None, "excluded")),
    (("", " ; ", ";"), (None, None, False, None, "")),
]


def test_pairs_and_shapes_with_repeated_rows(spark):
    rows = [(i, *cells) for i, (cells, _) in enumerate(CASES)] * 2
    out = me.spores(spark.createDataFrame(rows, "id int, l string, w string, s string"), "id", "l", "w", "s").collect()
    assert len(out) == len(rows)
    r3 = lambda v: None if v is None else round(v, 3)
    for r in out:
        assert (CASES[r.id][0], (r3(r.length), r3(r.width), r.paired, r.shape, r.shape_action)) == CASES[r.id]
    last = [r for r in out if r.id == len(CASES) - 1][0]
    assert (last.length_basis, last.width_basis, last.condition) == ("empty", "empty", "")


def test_kept_shapes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "5 (fixed)", "2", "rod (fresh)")], "id int, l string, w string, s string")
    r = me.spores(df, "id", "l", "w", "s", same_condition=False).first()
    assert (r.shape, r.shape_action, r.shape_condition) == ("Rod-shaped", "kept", "fresh")
    assert me.spores(df.limit(0), "id", "l", "w", "s").isEmpty()


def test_coils(spark):
    rows = [("7.3 (meiospores); 7", "1-2", 7.0, "stated average", False), ("", "44322", 5.5, "range midpoint", True), (None, "2021-05-06 00:00:00", 5.5, "range midpoint", True), ("x", "13-14", 13.5, "range midpoint", False),
            ("", "Uncoiled 3", 0.0, "uncoiled", False), ("", "(9); 4", 4.0, "single value", False), ("", None, None, "empty", False), ("", "2021-13-45", 1017.0, "range midpoint", False), ("", "?", None, "no number found", False)]
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "id int, a string, r string")
    out = df.select("id", me.coils("a", "r").alias("c")).select("id", "c.*").collect()
    assert {r.id: (r.value, r.basis, r.repaired) for r in out} == {i: tuple(r[2:]) for i, r in enumerate(rows)}
