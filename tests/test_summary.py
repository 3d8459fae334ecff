"""Summaries of clusters by hand: nulls, blanks, repeats, ties, an empty table, columns of clashing names."""

from sedgeline.operators import summary

_COLS = "cluster string, ord int, accession string, organism string, host string, isolate string, strain string, pub_year string, record_date string, a string, _f string"


def _rows(spark, rows):
    return {r.cluster: r for r in summary.summarise(spark.createDataFrame(rows, _COLS)).collect()}


def test_summaries(spark):
    got = _rows(
        spark,
        [
            ("1", 2, "B", "Nosema  APIS", "bee;  Bombus  terrestris ", "i2", "I1", "2001", "3-MAY-2011", "x", "y"),
            ("1", 1, "A", "Nosema apis", "Bee\nbee", "i1", None, "1999", None, "x", "y"),
            ("1", 2, "B", "Nosema  APIS", "bee;  Bombus  terrestris ", "i2", "I1", "2001", "3-MAY-2011", "x", "y"),
            ("1", 3, None, "Uncultured Nosema", None, None, None, None, None, None, None),
            ("2", 1, "C", None, " ; ", None, None, "", "soon", None, None),
            (None, 1, "D", "Nosema bombi", "moth", None, None, None, None, None, None),
        ],
    )
    one, two = got["1"], got["2"]
    assert set(got) == {"1", "2"} and (one.n_members, one.n_with_host, one.n_distinct_names, one.n_binomials, one.n_hosts) == (4, 3, 2, 1, 2)
    assert (one.species_name, one.hosts, one.isolates_strains, one.publication_years, one.record_years, one.accessions) == ("Nosema apis", "Bee; Bombus terrestris", "i1; i2", "1999; 2001", "2011", "A; B; B; ")
    assert one.all_names == "Nosema apis | Uncultured Nosema" and one.distinct_species == "nosema apis" and one.localities == ""
    assert (two.n_members, two.n_binomials, two.n_hosts, two.species_name, two.hosts, two.record_years) == (1, 0, 0, "", "", "")
    assert _rows(spark, []) == {}


def test_kind_and_year(spark):
    s = spark.createDataFrame([(1, 0, "2001", "", "", "2011"), (0, 2, "", "", "", "2011"), (0, 0, "", "", " ", "")], "n_binomials int, n_hosts int, publication_years string, submission_years string, collection_years string, record_years string")
    kind, reason = summary.entry_kind(s.n_binomials, s.n_hosts)
    got = [tuple(r) for r in s.select(kind, reason, *summary.entry_year(), *summary.entry_year("record_years")).collect()]
    assert got == [
        ("named", "", "2001", "publication year", "2011", "GenBank record date"),
        ("provisional", "", "2011", "GenBank record date", "2011", "GenBank record date"),
        ("insufficient", "no binomial and no reported host", "", "", "", ""),
    ]
