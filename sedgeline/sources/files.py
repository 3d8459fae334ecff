"""Readers of the text formats; each gives a DataFrame with its rows' order in _src_row where order matters.

Spark splits the files; only formats whose records run over lines are read a
record at a time, by a record separator, so that a large file is many tasks.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, sequence) of a FASTA file; sequences over several lines are put together, letters only, upper case."""
    rows = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''")
    text = F.regexp_replace("value", "^>", "")
    head = F.trim(F.substring_index(text, "\n", 1))
    body = F.when(F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1)).otherwise("")
    return rows.select(F.substring_index(head, " ", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S+\s*", "")).alias("description"), F.upper(F.regexp_replace(body, "[^A-Za-z]", "")).alias("sequence"))


def clusters_uc(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, label, is_centroid, identity): seeds and hits of a clustering file; cluster summaries, comments and short rows are skipped."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(f.alias("f")).where("size(f) >= 10 AND f[0] IN ('S', 'H')")
    return rows.select(
        F.col("f")[1].alias("cluster"), F.regexp_replace(F.col("f")[8], ";size=[0-9]+;?$", "").alias("label"), (F.col("f")[0] == "S").alias("is_centroid"),
        F.when(F.col("f")[3] == "*", 100.0).otherwise(F.expr("try_cast(f[3] AS double)")).alias("identity"),
    )


def hits_tblout(spark: SparkSession, path: str) -> DataFrame:
    """Hits of a model search table: white space apart, comments, short rows and rows without numbers dropped."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split(F.trim("value"), r"\s+").alias("f")).where("size(f) >= 17")
    out = rows.selectExpr(
        "f[0] AS target", "try_cast(f[5] AS bigint) AS mdl_from", "try_cast(f[6] AS bigint) AS mdl_to", "least(try_cast(f[7] AS bigint), try_cast(f[8] AS bigint)) AS start",
        "greatest(try_cast(f[7] AS bigint), try_cast(f[8] AS bigint)) AS end", "f[9] AS strand", "try_cast(f[14] AS double) AS score", "try_cast(f[15] AS double) AS evalue", "f[16] AS inc",
    )
    return out.where("score IS NOT NULL AND evalue IS NOT NULL")


def table_tsv(spark: SparkSession, path: str, required: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """All-text TSV with a header; blanks are '' and not null. Strict: no quoting, and as many rows as lines after the header, or an error."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "" if strict else '"').option("mode", "FAILFAST").csv(path).na.fill("")
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if strict and (n := spark.read.text(path).where("value <> ''").count() - 1) != df.count():
        raise ValueError(f"{path} has {n} lines after its header, but not as many rows")
    return df


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; blank keys are dropped."""
    w = Window.partitionBy(key).orderBy(order)
    return df.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


class _Sheet(InputPartition):
    def __init__(self, name: str, member: str):
        self.name, self.member = name, member


class _WorkbookReader(DataSourceReader):
    """One partition for each sheet; a file that Spark ships or that all nodes can open."""

    _NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def __init__(self, options):
        self.path, self.width = options["path"], int(options.get("columns", "25"))

    def partitions(self):
        with zipfile.ZipFile(self.path) as z:
            book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        return [_Sheet(s.get("name"), f"xl/worksheets/sheet{i}.xml") for i, s in enumerate(book.iter(f"{self._NS}sheet"), 1)]

    def read(self, partition) -> Iterator[tuple]:
        with zipfile.ZipFile(self.path) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in si.iter(f"{self._NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{self._NS}si")]
            for row in ElementTree.fromstring(z.read(partition.member)).iter(f"{self._NS}row"):
                cells = [""] * self.width
                for c in row.iter(f"{self._NS}c"):
                    at = 0
                    for ch in c.get("r", "A1"):
                        if ch.isalpha():
                            at = at * 26 + ord(ch.upper()) - 64
                    v = c.find(f"{self._NS}v")
                    text = "".join(t.text or "" for t in c.iter(f"{self._NS}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                    if at <= self.width:
                        cells[at - 1] = shared[int(text)] if c.get("t") == "s" else text
                yield (partition.name, int(row.get("r")), cells)


class WorkbookSource(DataSource):
    """``spark.read.format("workbook")``: sheet, row number and text cells of an xlsx file."""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return "sheet string, _src_row int, cells array<string>"

    def reader(self, schema):
        return _WorkbookReader(self.options)
