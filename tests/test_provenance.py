"""Marks, merges and totals by hand."""

from sedgeline.operators import provenance as pv

ROWS = [
    (2, "Nosema apis", None),
    (3, "Nosema  Bombi", "PROVISIONAL species:  defined by 18S sequence cluster 4"),
    (4, "New one", "[ADDED 2026-07-01] x"),
    (5, "Sent in", "[TRANSFERRED/ADDED 2026-08-01]"),
    (6, "Loose", ""),
    (7, "Kept", "[MERGED 2026-08-06: original rows 10, 20, 1500, 1600]"),
    (8, "Twice sent", "[MERGED 2026-08-06: original rows 1500, 1600] [TRANSFERRED/ADDED 2026-08-01]"),
    (9, "Joined", "combined records: Old a | old  B | C ; [TRANSFERRED/ADDED 2026-08-01]"),
    (10, "nosema apis", "[ADDED 2026-07-02]"),
    (11, " ", "[ADDED 2026-07-02]"),
    (12, "Sent twice", "combined records: X | Y | [TRANSFERRED/ADDED 2026-08-01] [TRANSFERRED/ADDED 2026-08-02]"),
    (13, "Taken over", "[ADDED 2026-07-03]"),
]
WANT = {  # provenance, conflict, added, merged_originals, into_original, duplicates, redundant_rows
    2: ("original", False, None, 0, 0, 0, 0), 3: ("genbank_cluster", False, None, 0, 0, 0, 0), 4: ("llm_search", False, "2026-07-01", 0, 0, 0, 0), 5: ("publication_submission", False, None, 0, 0, 0, 0),
    6: ("llm_search_unmarked", False, None, 0, 0, 0, 0), 7: ("original", False, None, 0, 2, 0, 1), 8: ("publication_submission", False, None, 0, 0, 1, 0), 9: ("original", False, None, 1, 1, 0, 0),
    10: ("llm_search", False, "2026-07-02", 0, 0, 0, 0), 12: ("publication_submission", False, None, 0, 2, 0, 0), 13: ("original", True, None, 0, 0, 0, 0),
}


def _tables(spark):
    rows = spark.createDataFrame(ROWS, "row int, name string, remarks string")
    originals = spark.createDataFrame([("NOSEMA apis",), ("old b",), ("Kept",), ("Kept",), ("Formerly",), ("Gone",), (" ",), (None,)], "name string")
    return rows, originals, spark.createDataFrame([("formerly", "TAKEN over"), ("kept", "Loose"), ("unknown", None)], "name string, current string")


def test_rows_and_totals(spark):
    rows, originals, aliases = _tables(spark)
    carried = pv.carriers(rows, originals, aliases)
    assert sorted(((r.name, r.row) for r in carried.collect()), key=repr) == sorted([("NOSEMA apis", 2), ("old b", 9), ("Kept", 7), ("Kept", 7), ("Formerly", 13), ("Gone", None)], key=repr)
    found = pv.provenance(rows, carried, 1440)
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == WANT
    sums = {r.metric: r.value for r in pv.ledger(found, carried).collect()}
    assert sums["rows"] == 11 == sums["originals_retained"] + sums["submissions_new"] + sums["search_additions"] + sums["cluster_additions"]
    assert sums["original_entries"] == 6 == sums["originals_retained"] + sums["originals_merged"] + sums["originals_consolidated"]
    assert sums["submissions"] == 9 and sums["unaccounted"] == 1 and sums["conflicts"] == 1


def test_marks_alone_and_empty_tables(spark):
    rows, originals, aliases = _tables(spark)
    kinds = {r.row: r.provenance for r in pv.provenance(rows, None, 1440).collect()}
    assert [k for k, v in kinds.items() if v == "original"] == [2, 6, 7, 9, 12] and kinds[13] == "llm_search"
    none = pv.carriers(rows.limit(0), originals, aliases)
    assert none.where("row IS NOT NULL").isEmpty() and pv.provenance(rows.limit(0), none, 1440).isEmpty()
    assert {r.value for r in pv.ledger(pv.provenance(rows.limit(0), none.limit(0), 1440), none.limit(0)).collect()} == {0}
