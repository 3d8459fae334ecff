"""Column functions for years, dates, measures and bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def years(c: Column, first: int = 1600, last: int = 2026) -> Column:
    """Plausible years: runs of exactly four digits within bounds."""
    runs = F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([0-9]+)"), 1), lambda x: F.length(x) == 4)
    return F.filter(F.transform(runs, lambda x: x.cast("int")), lambda y: y.between(first, last))


def earliest_year(c: Column, first: int = 1600, last: int = 2026) -> Column:
    return F.array_min(years(c, first, last))


def publication_year(c: Column, last: int = 2026) -> Column:
    """The earliest year outside of collection clauses in parentheses, else the earliest at all."""
    return F.coalesce(earliest_year(F.regexp_replace(c, r"\([^)]*collect[^)]*\)", " "), last=last), earliest_year(c, last=last))


def decade(year: Column, last: int = 2026) -> Column:
    lo = (F.floor(year / 10) * 10).cast("int")
    return F.concat_ws("-", lo.cast("string"), F.least(lo + 9, F.lit(last)).cast("string"))


def excel_range(c: Column) -> Column:
    """A day number that a spreadsheet made of a range such as 5-6: its month and day; other cells stay."""
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.try_to_number(F.when(c.rlike("^[0-9]{5}$"), c), F.lit("99999")).cast("int"))
    return F.when(c.rlike("^[0-9]{5}$"), F.concat_ws("-", F.month(day).cast("string"), F.dayofmonth(day).cast("string"))).otherwise(c)


_N = r"([0-9]+\.?[0-9]*)"


def _number(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).cast("double")


def measure(c: Column) -> Column:
    """A size: the stated mean before '+/-', the midpoint of a leading range, or the first number."""
    mean = _number(c, _N + r"\s*(\+/-|±)")
    lo, hi = _number(c, r"^\s*" + _N + r"\s*-\s*" + _N, 1), _number(c, r"^\s*" + _N + r"\s*-\s*" + _N, 2)
    return F.coalesce(mean, (lo + hi) / 2, _number(c, _N))


def binned(c: Column, breaks: list[float], labels: list[str]) -> Column:
    """Right-closed bins; null outside of the breaks."""
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(list(zip(breaks[:-1], breaks[1:], labels, strict=True))):
        out = F.when((c > lo) & (c <= hi), name).otherwise(out)
    return out
