"""Cells that list hosts: fragments, roles, synonyms, the host's own host, repairs of names, and whether two names agree.

A cell is read by stages over its fragments, each a transform that adds fields;
all of it is Spark's own functions. Cells that are alike are read once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import text as tx

#: Asides in parentheses that are a role or a note.
ROLE = (
    r"(?i)^(?:type host|intermediate host|definitive host|paratype|natural host|experimental|primary host|secondary host|alternate host|vector"
    r"|\d+|[a-z]\d?|type \d|host \d|\?|unknown|likely|possibly|probably|should be .*|according to .*|misidentified.*|as .*)$"
)
#: Asides that give another name.
SYNONYM = r"(?i)^(?:=|also|syn\.?|synonym of)\s*(.+)$"
#: Fragments that name nothing.
NO_TAXON = r"(?i)^(?:unknown|not (?:stated|reported|known|specified)|n/?a|none|various|several|many|unidentified|undetermined|environmental|host|hosts|\?+|-+)$"
#: First words of descriptions.
DESCRIPTION = r"(?i)^(?:a|an|the|unnamed|unidentified|undescribed|gregarine|form|parasitic)\b"
#: Asides, and text without parentheses, that tell where a host lives.
CONTEXT = r"(?i)^(?:hyperparasit\w*|parasit\w*|found|living|encysted|larva\w*|cyst\w*)?\s*(?:in|of|within|inside|from)\b"
CONTEXT_WORD = r"(?i)hyperparasit|parasit(?:e|ic)\b|gregarin|in gut of"
BARE_CONTEXT = r"""[,;"]?\s*\b(?:hyperparasitic\s+)?(?:in|of|from|within)\b\s+(?:the\s+)?(?:[a-z-]+\s+){0,4}([A-Z][a-z]{2,}\s+[a-z][a-z-]{2,}).*$"""
#: Forms of names.
SUBGENUS = r"^([A-Z][a-z-]+)\s*\(([A-Z][a-z-]+)\)\s*(.*)$"
BINOMIAL_IN = r"\b([A-Z][a-z]{2,})\s+([a-z][a-z-]{2,})\b"
BINOMIAL_FIRST = r"^[A-Z][a-z-]{2,}\s+[a-z][a-z-]{2,}"
YEAR_ONLY = r"^\(?\d{4}\)?$"
INITIAL = r"^([A-Z])\.\s*([a-z][a-z-]+)$"
JOINED_INITIAL = r"^([A-Z])\.([a-z-]{3,})"
AGGREGATE = r"(?i)^([A-Z][a-z-]+\s+[a-z-]+)/[a-z-]+(\s+complex)?$"
SHORT_MIDDLE = r"^([A-Z][a-z-]{2,})\s+[a-z]\.\s+([a-z-]{3,})$"
RAISED_EPITHET = r"^([A-Z][a-z-]{2,})\s+([A-Z][a-z-]{2,})$"
#: An author and a year after a name, and the endings that change with the gender of the genus.
AUTHOR_YEAR = r",?\s*\(?[A-Z][a-z]+(?:\s*&\s*[A-Z][a-z]+)?\)?,?\s*\d{4}$"
AUTHORITY = r"\s*\(?\b[A-Z][A-Za-z.'-]*\b\.?(?:\s*&\s*[A-Z][A-Za-z.'-]*)*\s*,?\s*\d{4}\)?\s*$"
GENDER_END = r"(us|um|a|is|e|i|ii|ae|orum|arum)$"


class Stages:
    """An array of structs to which each stage adds fields, or replaces those of the same name.

    With a table each stage is a column of its own, so that a long chain of
    them is analysed step by step; without one the chain is a single column.
    """

    def __init__(self, values: Column, name: str, df: DataFrame | None = None, at: str = ""):
        self.fields, self.df, self.at = [name], df, at
        self._put(F.transform(values, lambda v: F.struct(v.alias(name))))

    def _put(self, col: Column) -> None:
        self.col = col
        if self.df is not None:
            self.df = self.df.withColumn(self.at, col)
            self.col = F.col(f"`{self.at}`")

    def add(self, **made: Callable[[Column], Column]) -> Stages:
        kept = [f for f in self.fields if f not in made]
        self._put(F.transform(self.col, lambda x: F.struct(*(x[f].alias(f) for f in kept), *(f(x).alias(n) for n, f in made.items()))))
        self.fields = [*kept, *made]
        return self

    def keep(self, test: Callable[[Column], Column]) -> Stages:
        self._put(F.filter(self.col, test))
        return self


def split_hosts(cell: Column) -> Column:
    """Fragments between semicolons; commas split a part only where at least two of its pieces begin like binomials and none is a bare year."""
    parts = Stages(F.filter(F.split(cell, ";"), lambda p: F.trim(p) != ""), "part")
    parts.add(frags=lambda x: F.filter(F.transform(F.split(x["part"], ","), lambda f: _strip(f)), lambda f: f != ""))
    parts.add(names=lambda x: F.size(F.filter(x["frags"], lambda f: f.rlike(BINOMIAL_FIRST))), year=lambda x: F.exists(x["frags"], lambda f: f.rlike(YEAR_ONLY)))
    many = lambda x: x["part"].contains(",") & (x["names"] >= 2) & ~x["year"]
    return F.flatten(F.transform(parts.col, lambda x: F.when(many(x), x["frags"]).otherwise(F.array(x["part"]))))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_epithet(name: Column) -> Column:
    """Without accents, authority, qualifiers and other trailing matter that keeps a name from being found."""
    n = F.btrim(F.regexp_replace(tx.deaccent(name), r"\s+", " "), F.lit(" .,;:"))
    n = F.regexp_replace(n, r"(?i)\b(?:sp|spp)\.?\s*(?:nov\.?)?\s*\d*$", "sp.")
    n = F.regexp_replace(n, r"(?i)\b(?:cf|aff|nr)\.?\s+", "")
    n = F.regexp_replace(n, r"(?i)\s+(?:sensu lato|s\.l\.|sensu stricto|s\.s\.)$", "")
    return F.trim(F.regexp_replace(n, AUTHOR_YEAR, ""))


def is_description(text: Column) -> Column:
    """Whether a text doesn't begin with a capital, or begins with a word that no name begins with; an empty one is none."""
    return (text != "") & (~text.rlike(r"^\p{Lu}") | text.rlike(DESCRIPTION))


def _repaired(s: Stages, have: str) -> Stages:
    """Fields ``name`` and ``repair`` from the field ``have``."""
    note = lambda done, what: F.when(done, F.array(F.lit(what))).otherwise(F.array().cast("array<string>"))
    s.add(toks=lambda x: F.filter(F.split(x[have], r"\s+"), lambda t: t != ""))
    fix = lambda t, i: F.when(i == 0, t).when(t.rlike("^[IO][a-z-]{2,}$"), F.concat(F.translate(F.substring(t, 1, 1), "IO", "lo"), F.substr(t, F.lit(2)))).otherwise(F.regexp_replace(t, "(?<=[a-z])I(?=[a-z])", "l"))
    s.add(fixed=lambda x: F.transform(x["toks"], fix))
    s.add(name=lambda x: F.array_join(x["fixed"], " "), notes=lambda x: note(x["fixed"] != x["toks"], "confusable letter"))
    for pattern, into, what in (
        (JOINED_INITIAL, "$1. $2", "missing space after initial"),
        (AGGREGATE, "$1", "aggregate reduced to first name"),
        (SHORT_MIDDLE, "$1 $2", "abbreviated subspecies dropped"),
    ):
        s.add(new=lambda x, p=pattern, r=into: F.regexp_replace(x["name"], p, r), hit=lambda x, p=pattern: x["name"].rlike(p))
        s.add(name=lambda x: x["new"], notes=lambda x, w=what: F.concat(x["notes"], note(x["hit"], w)))
    s.add(hit=lambda x: x["name"].rlike(RAISED_EPITHET), low=lambda x: F.lower(F.regexp_extract(x["name"], RAISED_EPITHET, 2)))
    s.add(hit=lambda x: x["hit"] & ~x["low"].isin("sp", "spp"))
    s.add(
        name=lambda x: F.when(x["hit"], F.concat(F.regexp_extract(x["name"], RAISED_EPITHET, 1), F.lit(" "), x["low"])).otherwise(x["name"]),
        repair=lambda x: F.array_join(F.concat(x["notes"], note(x["hit"], "epithet decapitalised")), "; "),
    )
    return s


def repair_name(name: Column) -> Column:
    """struct(name, repair): a name with known misspellings put right, and what was done."""
    s = _repaired(Stages(F.array(F.coalesce(name, F.lit(""))), "given"), "given")
    return F.transform(s.col, lambda x: F.struct(x["name"].alias("name"), x["repair"].alias("repair")))[0]


def _ranked(s: Stages) -> Stages:
    """Fields ``rank`` and ``lookup`` from ``name``."""
    s.add(toks=lambda x: F.filter(F.split(x["name"], r"\s+"), lambda t: t != ""))
    s.add(second=lambda x: F.coalesce(F.get(x["toks"], F.lit(1)), F.lit("")), first=lambda x: F.coalesce(F.get(x["toks"], F.lit(0)), F.lit("")))
    many = lambda x: F.size(x["toks"]) >= 2
    s.add(
        rank=lambda x: F.when(many(x) & F.lower(x["second"]).isin("sp.", "sp", "spp.", "spp"), "genus").when(many(x) & x["second"].rlike("^[a-z-]+$"), "species").when((F.size(x["toks"]) == 1) & x["first"].rlike("^[A-Z][a-z]+$"), "genus").otherwise("other")
    )
    s.add(lookup=lambda x: F.when(x["rank"] == "species", F.concat_ws(" ", x["first"], x["second"])).when(x["rank"] == "genus", x["first"]).otherwise(x["name"]))
    return s


def _asides(frag: Column) -> Column:
    """The parentheses of a fragment: what each is, and the names that it holds."""
    s = Stages(F.transform(F.regexp_extract_all(frag, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda t: _strip(t)), "inner")
    s.add(
        kind=lambda x: F.when(x["inner"].rlike(SYNONYM), "synonym").when(x["inner"].rlike(CONTEXT) | x["inner"].rlike(CONTEXT_WORD), "context").when(x["inner"].rlike(ROLE), "role").when(x["inner"].rlike(r"^[A-Z][a-z]+ [a-z-]+"), "name").otherwise("")
    )
    s.add(
        other=lambda x: F.when(x["kind"] == "synonym", F.regexp_extract(x["inner"], SYNONYM, 1)).when(x["kind"] == "role", F.regexp_extract(x["inner"], r"\b([A-Z][a-z]+ [a-z-]{3,})", 1)).when(x["kind"] == "name", x["inner"]).otherwise(""),
        host=lambda x: F.when((x["kind"] == "context") & x["inner"].rlike(BINOMIAL_IN), F.concat_ws(" ", F.regexp_extract(x["inner"], BINOMIAL_IN, 1), F.regexp_extract(x["inner"], BINOMIAL_IN, 2))).otherwise(""),
    )
    return s.add(other=lambda x: clean_epithet(x["other"])).col


def _last(values: Column) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(""))


def parse_host_cells(df: DataFrame, cell_col: str = "cell", out_col: str = "hosts") -> DataFrame:
    """``df`` with ``out_col``: array<struct<raw, name, rank, role, synonyms, secondary_organism, context, subgenus, repair>>, one for each host of a cell.

    name is what to look up; for a description it is empty and the rank
    'unidentified'. An abbreviated genus is that of the first name before it in
    the cell with the same initial. Fragments that name nothing are left out; a
    null or empty cell gives an empty array. Equal cells meet by a shuffle and
    are parsed once; a cell that many rows have costs them the join alone.
    """
    rows = spread(df.drop(out_col).withColumn("_cell", F.coalesce(F.col(f"`{cell_col}`"), F.lit(""))), "_cell")
    frags = F.filter(F.transform(split_hosts(F.col("_cell")), lambda f: _strip(f)), lambda f: f != "")
    s = Stages(frags, "raw", rows.select("_cell").distinct(), out_col)
    s.add(asides=lambda x: _asides(x["raw"]))
    s.add(
        role=lambda x: F.lower(F.coalesce(F.get(F.filter(x["asides"], lambda a: a["kind"] == "role"), F.lit(0))["inner"], F.lit(""))),
        synonyms=lambda x: F.transform(F.filter(x["asides"], lambda a: a["other"] != ""), lambda a: a["other"]),
        secondary_organism=lambda x: _last(F.transform(F.filter(x["asides"], lambda a: a["host"] != ""), lambda a: a["host"])),
        context=lambda x: F.lower(_last(F.transform(F.filter(x["asides"], lambda a: a["kind"] == "context"), lambda a: a["inner"]))),
        subgenus=lambda x: F.regexp_extract(x["raw"], SUBGENUS, 2),
        use=lambda x: F.when(x["raw"].rlike(SUBGENUS), F.trim(F.regexp_replace(x["raw"], SUBGENUS, "$1 $3"))).otherwise(x["raw"]),
    )
    s.add(bare=lambda x: F.regexp_extract(x["use"], BARE_CONTEXT, 0), lives=lambda x: F.regexp_extract(x["use"], BARE_CONTEXT, 1), at=lambda x: F.regexp_instr(x["use"], F.lit(BARE_CONTEXT)))
    s.add(
        secondary_organism=lambda x: F.when(x["secondary_organism"] == "", x["lives"]).otherwise(x["secondary_organism"]),
        context=lambda x: F.when(x["context"] == "", F.lower(_strip(x["bare"]))).otherwise(x["context"]),
        use=lambda x: F.when(x["at"] > 0, F.substring(x["use"], F.lit(1), x["at"] - 1)).otherwise(x["use"]),
    )
    s.add(base=lambda x: F.btrim(clean_epithet(F.regexp_replace(x["use"], r"\([^)]*\)", " ")), F.lit(" \"'")))
    s.add(described=lambda x: is_description(x["base"]))
    s.keep(lambda x: x["described"] | ((x["base"] != "") & ~x["base"].rlike(NO_TAXON)))
    _ranked(_repaired(s, "base"))
    s.add(genus=lambda x: F.when(~x["described"] & x["rank"].isin("species", "genus"), F.split(x["lookup"], " ")[0]))
    earlier = lambda x, i: F.filter(F.slice(s.col, F.lit(1), i), lambda y: F.substring(y["genus"], 1, 1) == F.substring(x["base"], 1, 1))
    s._put(F.transform(s.col, lambda x, i: F.struct(*(x[f].alias(f) for f in s.fields), F.get(earlier(x, i), F.lit(0))["genus"].alias("seen"))))
    s.fields.append("seen")
    s.add(base=lambda x: F.when(x["seen"].isNotNull() & x["base"].rlike(INITIAL), F.concat_ws(" ", x["seen"], F.regexp_extract(x["base"], INITIAL, 2))).otherwise(x["base"]))
    _ranked(_repaired(s, "base"))
    blank = lambda c: (lambda x: F.when(x["described"], F.lit("")).otherwise(x[c]))
    s.add(name=blank("lookup"), repair=blank("repair"), rank=lambda x: F.when(x["described"], F.lit("unidentified")).otherwise(x["rank"]), synonyms=lambda x: F.when(x["described"], F.array().cast("array<string>")).otherwise(x["synonyms"]))
    order = ("raw", "name", "rank", "role", "synonyms", "secondary_organism", "context", "subgenus", "repair")
    parsed = s.df.withColumn(out_col, F.transform(s.col, lambda x: F.struct(*(x[f].alias(f) for f in order))))
    return rows.join(parsed.hint("merge"), "_cell").drop("_cell")


def strip_authority(name: Column) -> Column:
    """The genus and at most one epithet of a returned name, without subgenus, author and year."""
    n = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\([^)]*\)", " "), AUTHORITY, "")
    s = Stages(F.array(F.filter(F.split(n, r"\s+"), lambda t: t != "")), "t")
    s.add(second=lambda x: F.coalesce(F.get(x["t"], F.lit(1)), F.lit("")))
    return F.transform(s.col, lambda x: F.when(F.size(x["t"]) == 0, "").when(x["second"].rlike("^[a-z][a-z-]+$"), F.concat_ws(" ", x["t"][0], x["second"])).otherwise(x["t"][0]))[0]


def stem(epithet: Column) -> Column:
    """An epithet without its gender ending, if at least three letters are left."""
    s = Stages(F.array(epithet), "e").add(cut=lambda x: F.regexp_replace(x["e"], GENDER_END, ""))
    return F.transform(s.col, lambda x: F.when(F.length(x["cut"]) >= 3, x["cut"]).otherwise(x["e"]))[0]


def edits(a: Column, b: Column) -> Column:
    """Edit distance; 99 where the lengths differ by more than two."""
    return F.when(F.abs(F.length(a) - F.length(b)) > 2, 99).otherwise(F.levenshtein(a, b))


def name_agrees(query: Column, returned: Column, rank: Column) -> Column:
    """struct(agrees, reason): true if the returned name is that asked for, false if not, null if only the genus differs by two edits."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda t: t != "")
    given = F.coalesce(returned, F.lit(""))
    s = Stages(F.array(F.struct(words(F.regexp_replace(tx.deaccent(F.coalesce(query, F.lit(""))), "[^A-Za-z ]", " ")).alias("q"), words(strip_authority(tx.deaccent(given))).alias("r"), given.alias("given"), rank.alias("rank"))), "x")
    s.add(q=lambda x: x["x"]["q"], r=lambda x: x["x"]["r"])
    get = lambda c, i: F.coalesce(F.get(c, F.lit(i)), F.lit(""))
    s.add(g=lambda x: get(x["q"], 0), h=lambda x: get(x["r"], 0), e=lambda x: get(x["q"], 1), f=lambda x: get(x["r"], 1))
    s.add(
        d=lambda x: edits(F.lower(x["g"]), F.lower(x["h"])), long=lambda x: F.least(F.length(x["g"]), F.length(x["h"])) >= 6,
        de=lambda x: edits(F.lower(x["e"]), F.lower(x["f"])), same=lambda x: (F.lower(x["e"]) == F.lower(x["f"])) | (stem(F.lower(x["e"])) == stem(F.lower(x["f"]))),
        both=lambda x: (x["x"]["rank"] == "species") & (F.size(x["q"]) > 1) & (F.size(x["r"]) > 1), most=lambda x: F.when(F.least(F.length(x["e"]), F.length(x["f"])) >= 6, 2).otherwise(1),
    )
    s.add(blank=lambda x: (x["x"]["given"] == "") | (F.size(x["q"]) == 0) | (F.size(x["r"]) == 0), far=lambda x: x["d"] > F.when(x["long"], 1).otherwise(0))
    s.add(maybe=lambda x: x["far"] & (x["d"] <= 2) & x["long"], wrong=lambda x: x["both"] & ~x["same"] & (x["de"] > x["most"]))
    reason = lambda x: (
        F.when(x["blank"], "")
        .when(x["maybe"], F.concat(F.lit("genus differs by "), x["d"].cast("string"), F.lit(": asked "), x["g"], F.lit(", got "), x["h"]))
        .when(x["far"], F.concat(F.lit("genus differs: asked "), x["g"], F.lit(", got "), x["h"]))
        .when(x["wrong"], F.concat(F.lit("epithet differs: asked "), x["e"], F.lit(", got "), x["f"]))
        .otherwise("")
    )
    agrees = lambda x: F.when(x["blank"], F.lit(True)).when(x["maybe"], F.lit(None).cast("boolean")).when(x["far"] | x["wrong"], F.lit(False)).otherwise(F.lit(True))
    return F.transform(s.col, lambda x: F.struct(agrees(x).alias("agrees"), reason(x).alias("reason")))[0]
