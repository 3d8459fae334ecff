"""Cells of several measurements under several conditions: the one that counts, width by length, and shape by both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import shape_class
from ..functions.text import deaccent

# Conditions from best to worst, kinds of spore that count last, and the words that tell conditions apart.
CONDITIONS = ("fresh", "live", "unspecified", "fixed", "stained", "preserved", "other")
LAST_KINDS = ("macrospore", "microspore", "meiospore", "aberrant", "binucleate", "transovarial", "octospore")
PREPARATIONS = ("fresh", "live", "fixed", "stained", "preserved", "collapsed", "dried", "smear")
KINDS = ("meiospore", "macrospore", "microspore", "megaspore", "octospore", "monospore", "binucleate", "uninucleate", "diplokaryotic", "primary", "secondary", "lanceolate")
BARE_CONDITIONS = "fresh|live|fixed|stained"
SLASH_CONDITIONS = "fresh|live|fixed|stained|preserv|collaps"
WORSE_SHAPES = "stain|fixed|collaps|preserv|aberrant"

_NUM = r"[0-9]+(?:\.[0-9]+)?"
_AVERAGE = rf"(?:avg|average|mean)\s*[:=]?\s*({_NUM})"
_RANGE = rf"^({_NUM})\s*[-–]\s*({_NUM})"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def terms(cell: Column) -> Column:
    """The parts of a cell between semicolons, without blank ones; null has none."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ";"), _trim), lambda t: t != "")


def unslashed(parts: Column) -> Column:
    """Parts such as '5.10 fixed/5.75 fresh' in two: each side has a number and one names a condition. '+/-' is no slash."""

    def sides(t: Column) -> Column:
        x = F.regexp_replace(t, r"\+\s*/\s*-", "+-")
        cut = F.transform(F.split(x, "/"), _trim)
        two = F.forall(cut, lambda p: p.rlike("[0-9]")) & F.exists(cut, lambda p: F.lower(p).rlike(SLASH_CONDITIONS))
        return F.when(two, cut).otherwise(F.array(x))

    return F.filter(F.flatten(F.transform(parts, sides)), lambda t: t != "")


def condition_rank(condition: Column) -> Column:
    """1 for the best condition; ten more for kinds of spore that count last."""
    low = F.lower(condition)
    rank = F.when(_trim(low) == "", CONDITIONS.index("unspecified") + 1)
    for i, word in enumerate(CONDITIONS, 1):
        if word != "unspecified":
            rank = rank.when(low.contains(word), i)
    return rank.otherwise(len(CONDITIONS)) + F.when(low.rlike("|".join(LAST_KINDS)), 10).otherwise(0)


def _double(c: Column) -> Column:
    return F.nullif(c, F.lit("")).cast("double")


def _condition(term: Column) -> Column:
    low = F.lower(term)
    inside = F.transform(F.regexp_extract_all(low, F.lit(r"\([^)]*\)"), 0), lambda p: F.regexp_replace(p, "[()]", ""))
    return F.concat(F.array_join(inside, " "), F.lit(" "), F.when(low.rlike(BARE_CONDITIONS), low).otherwise(""))


def _measured(parts: Column) -> Column:
    """Structs (rank, idx, value, basis, condition, label) of parts; they order by what counts first.

    The value is a stated average, the middle of a leading range, the first
    number, or what parentheses hold. Stage by stage, so that no lambda works
    out the same thing twice.
    """
    read = F.transform(parts, lambda t: F.struct(F.lower(deaccent(t)).alias("t"), _condition(t).alias("c")))
    read = F.transform(read, lambda x: F.struct(x["t"].alias("t"), x["c"].alias("c"), _trim(F.regexp_replace(x["t"], r"\(.*?\)", " ")).alias("bare")))

    def numbers(x: Column) -> Column:
        middle = (_double(F.regexp_extract(x["bare"], _RANGE, 1)) + _double(F.regexp_extract(x["bare"], _RANGE, 2))) / 2
        inside = F.transform(F.regexp_extract_all(x["t"], F.lit(_NUM), 0), lambda n: n.cast("double"))
        return F.struct(x["c"].alias("c"), _double(F.regexp_extract(x["t"], _AVERAGE, 1)).alias("average"), middle.alias("middle"), _double(F.regexp_extract(x["bare"], _NUM, 0)).alias("lead"), inside.alias("inside"))

    def chosen(x: Column, i: Column) -> Column:
        pair = (F.get(x["inside"], 0) + F.get(x["inside"], 1)) / 2
        basis = (
            F.when(x["average"].isNotNull(), "stated average").when(x["middle"].isNotNull(), "range midpoint").when(x["lead"].isNotNull(), "first value")
            .when(F.size(x["inside"]) > 1, "range midpoint (parenthetical)").when(F.size(x["inside"]) == 1, "first value (parenthetical)").otherwise("no number found")
        )
        value = F.coalesce(x["average"], x["middle"], x["lead"], pair, F.get(x["inside"], 0))
        label = F.trim(F.regexp_replace(F.regexp_replace(x["c"], "[^a-z ]", " "), r"\s+", " "))
        return F.struct(condition_rank(x["c"]).alias("rank"), (i + 1).alias("idx"), value.alias("value"), basis.alias("basis"), _trim(x["c"]).alias("condition"), label.alias("label"))

    return F.transform(F.transform(read, numbers), chosen)


def _numbered(c: Column) -> Column:
    return F.filter(c, lambda m: m["value"].isNotNull())


def conflict(a: Column, b: Column) -> Column:
    """Whether two conditions name preparations, or kinds of spore, and not the same ones."""
    out = F.lit(False)
    for words in (PREPARATIONS, KINDS):
        vocabulary = F.array(*(F.lit(w) for w in words))
        x, y = (F.array_sort(F.array_intersect(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-z ]", " "), " +"), vocabulary)) for c in (a, b))
        out = out | ((F.size(x) > 0) & (F.size(y) > 0) & (x != y))
    return out


def coils(average: str, span: str) -> Column:
    """(value, basis, repaired) of coils: the average cell's measurement, else the middle of the range cell.

    A range that a spreadsheet made a date, as a day number or in ISO form, is
    month - day again; 'uncoiled' is 0.
    """
    best = F.array_min(_numbered(_measured(terms(F.col(average)))))["value"]
    cell = _trim(F.coalesce(F.col(span), F.lit("")))
    day = F.when(cell.rlike("^[0-9]{5}$"), F.date_add(F.lit("1899-12-30").cast("date"), F.regexp_extract(cell, "^([0-9]{5})$", 1).try_cast("int")))
    day = F.coalesce(day, F.when(cell.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(cell, 1, 10).try_cast("date")))
    text = F.coalesce(F.format_string("%d - %d", F.month(day), F.dayofmonth(day)), cell)
    text = F.when(day.isNotNull(), text).otherwise(cell)
    numbers = F.transform(terms(text), lambda t: F.transform(F.regexp_extract_all(F.regexp_replace(t, r"\(.*?\)", " "), F.lit(_NUM), 0), lambda x: x.cast("double")))
    first = F.get(F.filter(numbers, lambda n: F.size(n) > 0), 0)
    uncoiled = text.rlike("(?i)uncoiled")
    value = F.when(best.isNotNull(), best).when(uncoiled, 0.0).when(F.size(first) > 1, (F.get(first, 0) + F.get(first, 1)) / 2).otherwise(F.get(first, 0))
    basis = F.when(best.isNotNull(), "stated average").when(text == "", "empty").when(uncoiled, "uncoiled").when(F.size(first) > 1, "range midpoint").when(F.size(first) == 1, "single value").otherwise("no number found")
    return F.struct(value.alias("value"), basis.alias("basis"), (best.isNull() & day.isNotNull()).alias("repaired"))


def spores(cells: DataFrame, key: str, length: str, width: str, shape: str, same_condition: bool = True) -> DataFrame:
    """(key, length, length_basis, condition, width, width_basis, width_condition, paired, shape, shape_condition, shape_action), row by row.

    Of a cell's parts the one of the best condition counts, of equal ones the
    first with a number. Where either cell has two parts, the width becomes
    that of the part with the length's condition, or else of the part at the
    length's place if both cells have as many numbers. A shape whose condition
    conflicts with the length's is taken again from the first part that
    doesn't ('retaken'); where there is none it becomes null ('excluded'), or
    stays if same_condition is False ('kept'). Null and blank cells are
    'empty'; rows are never dropped, so repeated keys give repeated rows.
    """
    d = cells.select(F.col(key).alias("_k"), F.col(length).alias("_l"), F.col(width).alias("_w"), F.col(shape).alias("_s"))
    for c in ("_l", "_w"):
        d = d.withColumn(f"{c}t", terms(F.col(c))).withColumn(f"{c}u", unslashed(F.col(f"{c}t")))
        d = d.withColumn(f"{c}m", F.array_min(_numbered(_measured(F.col(f"{c}t"))))).withColumn(f"{c}p", _measured(F.col(f"{c}u"))).withColumn(f"{c}n", _numbered(F.col(f"{c}p")))
    several = (F.size("_lp") > 1) | (F.size("_wp") > 1)
    d = d.withColumn("_li", F.array_min("_ln")).withColumn("_wi", F.array_min("_wn"))
    same = F.filter("_wn", lambda m: m["label"] == F.col("_li.label"))
    place = F.filter("_wn", lambda m: (m["idx"] == F.col("_li.idx")) & (F.size("_ln") == F.size("_wn")))
    d = d.withColumn("_hit", F.when(several, F.coalesce(F.get(same, 0), F.get(place, 0))))
    d = d.withColumn("_paired", F.coalesce(F.col("_hit.idx") != F.col("_wi.idx"), F.lit(False)))
    none = lambda c: F.when(F.size(f"{c}t") == 0, "empty").otherwise("no number found")
    blank = F.lit("")
    basis = F.coalesce("_wm.basis", none("_w"))

    shaped = F.transform(terms(F.col("_s")), lambda t, i: F.struct(shape_class(t).alias("class"), F.regexp_replace(F.lower(F.regexp_extract(t, r"\([^)]*\)", 0)), "[()]", "").alias("cond"), i.alias("idx")))
    d = d.withColumn("_st", shaped)
    score = lambda c: F.when(c.rlike(WORSE_SHAPES), 2).when((c == "") | c.rlike("fresh|live"), 0).otherwise(1) + F.when(c.rlike("|".join(LAST_KINDS)), 1).otherwise(0)
    sure = F.filter("_st", lambda t: t["class"] != "Other")
    d = d.withColumn("_sb", F.array_min(F.transform(sure, lambda t: F.struct(score(t["cond"]).alias("score"), t["idx"].alias("idx"), t["class"].alias("class"), t["cond"].alias("cond")))))
    d = d.withColumn("_sc", F.trim(F.regexp_replace(F.regexp_replace(F.col("_sb.cond"), "[^a-z ]", " "), r"\s+", " ")))
    d = d.withColumn("_class", F.coalesce(F.col("_sb.class"), F.when(F.exists("_st", lambda t: F.coalesce(t["class"] == "Other", F.lit(False))), "Other")))
    d = d.withColumn("_lc", F.coalesce("_lm.condition", blank))
    d = d.withColumn("_bad", (F.trim("_lc") != "") & (F.coalesce("_sc", blank) != "") & conflict(F.col("_lc"), F.col("_sc")))
    other = F.filter("_st", lambda t: (t["class"] != "Other") & ~conflict(t["cond"], F.col("_lc")))
    d = d.withColumn("_alt", F.when(F.col("_bad") & (F.size("_st") > 1), F.get(other, 0)["class"]))
    action = F.when(~F.col("_bad"), "").when(F.col("_alt").isNotNull(), "retaken").otherwise("excluded" if same_condition else "kept")
    final = F.when(action == "retaken", F.col("_alt")).when(action == "excluded", F.lit(None)).otherwise(F.col("_class"))
    return d.select(
        F.col("_k").alias(key), F.col("_lm.value").alias("length"), F.coalesce("_lm.basis", none("_l")).alias("length_basis"), F.col("_lc").alias("condition"),
        F.when(F.col("_paired"), F.col("_hit.value")).otherwise(F.col("_wm.value")).alias("width"), F.when(F.col("_paired"), F.concat(basis, F.lit(" (paired to length term)"))).otherwise(basis).alias("width_basis"),
        F.when(F.col("_paired"), F.col("_hit.condition")).otherwise(F.coalesce("_wm.condition", blank)).alias("width_condition"), F.col("_paired").alias("paired"),
        final.alias("shape"), F.when(action == "retaken", F.col("_lc")).otherwise(F.col("_sc")).alias("shape_condition"), action.alias("shape_action"),
    )
