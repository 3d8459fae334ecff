"""Row-wise operators: each row keeps its columns and gets one struct column more."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..session import ship


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def annotate(docs: DataFrame, run: Callable[..., Iterator[dict[str, pa.Array]]], fields: str, out_col: str, text_col: str = "text", beside: str | None = None) -> DataFrame:
    """``docs`` with a struct column ``out_col`` that ``run`` makes from the texts.

    run yields, for consecutive slices of an Arrow string array, a dict of
    arrays by field. All that a row has passes through as it is, whatever its
    columns are called; only a column with the name ``out_col`` is replaced.
    The column ``beside``, if any, is the second argument of run and isn't kept.
    """
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c != out_col]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"))
    kind = _parse_datatype_string(f"struct<{fields}>")
    at = [own.index(c) for c in (text_col, beside) if c is not None]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, done = b.column(0), 0
            for got in run(*(pc.struct_field(row, [i]) for i in at)):
                n = len(next(iter(got.values())))
                yield pa.RecordBatch.from_arrays([row.slice(done, n), pa.StructArray.from_arrays(list(got.values()), list(got))], ["row", out_col])
                done += n

    schema = StructType([StructField("row", packed.schema["row"].dataType), StructField(out_col, kind)])
    out = packed.mapInArrow(over, schema)
    return out.select(*(F.col("row")[c].alias(c) for c in own if c != beside), F.col(f"`{out_col}`"))
