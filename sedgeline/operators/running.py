"""Running aggregates over rows in order, where a group may be larger than any task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: How the aggregate of the ranges before is put together with that of the rows of a range.
_JOIN: dict[Callable, Callable[[Column, Column], Column]] = {
    F.max: F.greatest,
    F.min: F.least,
    F.sum: lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
}


def running(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column], scratch: Scratch, how: Callable = F.max, before: bool = False) -> DataFrame:
    """``df`` with a running F.max, F.min or F.sum of each of ``values`` over its group in order, the row itself included unless ``before``.

    Rows are written in ranges of (group, order). A window runs within a range,
    and what the group's ranges before it came to is joined to it, so a group
    of any size is many tasks and a window sees a row for each range at most.
    Groups and orders must not be null; (group, order) should tell rows apart.
    Where nothing comes before, the result is null.
    """
    named = df.withColumns({f"_v_{k}": v for k, v in values.items()})
    rows = scratch.save(named.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(*group, "_range").agg(*(how(f"_v_{k}").alias(f"_t_{k}") for k in values))
    if not group:  # a row for each range, all in one window
        earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select(*group, "_range", *(how(f"_t_{k}").over(earlier).alias(f"_c_{k}") for k in values))
    if group:  # a row for each group and range, which small groups make as many as there are rows: not through the driver
        carried = carried.hint("merge")
    out = rows.withColumns({f"_w_{k}": how(f"_v_{k}").over(inside) for k in values}).join(carried, [*group, "_range"])
    return out.select(*df.columns, *(_JOIN[how](F.col(f"_c_{k}"), F.col(f"_w_{k}")).alias(k) for k in values))
