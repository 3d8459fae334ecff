import zipfile

from sedgeline.sources import files, sinks


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one two\nACG\nT-a\n>y\nGG\n\n>z d\n")
    got = {r.id: (r.description, r.sequence) for r in files.fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"x": ("one two", "ACGTA"), "y": ("", "GG"), "z": ("d", "")}
    df = spark.createDataFrame([("x", "d", "A" * 130)], "id string, description string, sequence string")
    sinks.write_fasta(df, str(tmp_path / "out"))
    assert [(r.id, r.sequence) for r in files.fasta(spark, str(tmp_path / "out")).collect()] == [("x", "A" * 130)]


def test_clusters_and_hits(spark, tmp_path):
    uc = "# c\nS\t0\t9\t*\t.\t*\t*\t*\ta;size=3;\t*\nH\t0\t9\t98.5\t+\t0\t0\t=\tb\ta\nC\t0\t2\t*\t*\t*\t*\t*\ta\t*\nbad\n"
    (tmp_path / "x.uc").write_text(uc)
    got = [tuple(r) for r in files.clusters_uc(spark, str(tmp_path / "x.uc")).collect()]
    assert got == [("0", "a", True, 100.0), ("0", "b", False, 98.5)]
    row = "t1 - m - cm 1 90 200 110 - no 1 0.5 0.0 88.1 1e-9 ! -"
    (tmp_path / "x.tbl").write_text(f"# h\n{row}\nshort row\n{row.replace('88.1', 'x')}\n")
    [h] = files.hits_tblout(spark, str(tmp_path / "x.tbl")).collect()
    assert (h.target, h.start, h.end, h.strand, h.score) == ("t1", 110, 200, "-", 88.1)


def test_strict_table_and_wins(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('k\tv\na\t"x\nb\t\na\tz\n')
    df = files.table_tsv(spark, str(tmp_path / "t.tsv"), required=("k",))
    assert sorted(map(tuple, df.collect())) == [("a", '"x'), ("a", "z"), ("b", "")]
    o = spark.createDataFrame([("a", 1), ("a", 2), ("", 0)], "k string, n int")
    assert [r.n for r in files.first_wins(o, "k", "n").collect()] == [1] and [r.n for r in files.last_wins(o, "k", "n").collect()] == [2]
    sinks.write_tsv(df, str(tmp_path / "o"), ["v", "k", "none"])
    assert files.table_tsv(spark, str(tmp_path / "o")).columns == ["v", "k", "none"]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    p = tmp_path / "w.xlsx"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="one"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
    from sedgeline.session import ship

    ship(spark)
    spark.dataSource.register(files.WorkbookSource)
    [r] = spark.read.format("workbook").option("columns", "3").load(str(p)).collect()
    assert (r.sheet, r._src_row, r["cells"]) == ("one", 1, ["name", "", "5"])
