"""Writers: fixed columns in order, FASTA, and the tagged table of what was dropped or repaired."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tsv_safe


def write_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A TSV of these columns in this order, missing ones blank, other ones left out; written in parallel."""
    have = set(df.columns)
    df.select(*((tsv_safe(F.col(c).cast("string")) if c in have else F.lit("")).alias(c) for c in columns)).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """Records (id, description, sequence), sequences wrapped."""
    head = F.concat(F.lit(">"), F.trim(F.concat_ws(" ", "id", "description")))
    df.select(F.concat(head, F.lit("\n"), F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n"))).write.mode("overwrite").text(path)


def quality_table(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """One table of all exclusions: the name of the check and the key of the row."""
    return reduce(DataFrame.union, (df.select(F.lit(name).alias("check"), F.col(key).cast("string").alias("row")) for name, df in parts.items()))
