"""One lineage for each host from the answers of several sources: agreement of names, corroboration, vote, choice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hosts as hs
from ..functions.terms import PHYLUM_ALIASES

RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")
#: Kingdoms of homonyms, never of hosts.
IMPLAUSIBLE = ("plantae", "viridiplantae", "bacteria", "archaea", "viruses", "monera")
#: Classes and orders that make Myzozoa and Miozoa the Apicomplexa.
APICOMPLEXAN_CLASSES = ("conoidasida", "gregarinomorphea", "aconoidasida", "gregarinasina", "coccidia", "hematozoa", "sporozoasida", "gregarinia")
APICOMPLEXAN_ORDERS = (
    "eugregarinida", "eugregarinorida", "archigregarinida", "neogregarinorida", "blastogregarinorida", "agamococcidiorida",
    "eucoccidiorida", "adeleorina", "haemosporida", "piroplasmida", "cryptosporidiida", "gregarinida",
)


def normal_phylum(phylum: Column, klass: Column, order: Column) -> Column:
    """One name for a phylum that sources call differently; empty for null."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    p = F.trim(F.coalesce(phylum, F.lit("")))
    known = F.create_map(*(F.lit(x) for kv in PHYLUM_ALIASES.items() for x in kv))
    return F.when(low(phylum).isin("myzozoa", "miozoa"), F.when(low(klass).isin(*APICOMPLEXAN_CLASSES) | low(order).isin(*APICOMPLEXAN_ORDERS), "Apicomplexa").otherwise(p)).otherwise(F.coalesce(F.try_element_at(known, low(phylum)), p))


def looks_like_a_taxon(name: Column) -> Column:
    """Whether a name, trimmed, is a capitalised word of a name of four characters or more, with at most one epithet."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return (F.length(n) >= 4) & n.rlike(r"^[A-Z][a-z-]+(\s+[a-z-]+)?$")


def _two_words(c: Column) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z ]", ""), " +"), lambda t: t != ""), 1, 2), " ")


def judged(answers: DataFrame, any_kingdom: bool = False) -> DataFrame:
    """``answers`` with accepted, provisional, vernacular and reason.

    An answer whose name differs from that asked for is rejected, one whose
    genus differs by two edits is provisional; a common name that a free-text
    search resolved is accepted and marked.
    """
    out = answers.withColumn("_a", hs.name_agrees(F.col("asked"), F.trim(F.coalesce("returned", F.lit(""))), F.col("rank")))
    common = ~F.coalesce(F.col("_a.agrees"), F.lit(False)) & (F.col("match_type") == "free_text") & (F.trim(F.coalesce("returned", F.lit(""))) != "")
    out = out.withColumn("vernacular", F.coalesce(common, F.lit(False)))
    ok = F.when(F.col("vernacular"), True).otherwise(F.col("_a.agrees"))
    bad = F.lit(False) if any_kingdom else F.coalesce(F.lower(F.trim("kingdom")).isin(*IMPLAUSIBLE), F.lit(False))
    why = F.when(F.coalesce(ok, F.lit(False)), F.when(bad, F.concat(F.lit("kingdom "), "kingdom", F.lit(" is not a microsporidian host"))).otherwise("")).otherwise(F.col("_a.reason"))
    return out.withColumns({"accepted": F.coalesce(ok & ~bad, F.lit(False)), "provisional": ok.isNull(), "reason": why}).drop("_a")


def _voted(h: DataFrame, rank: str, value: Callable[[Column], Column]) -> DataFrame:
    """``h`` with the value that most accepted sources give the rank (of equals the first), whether others have as many, and who said otherwise."""
    given = F.filter("yes", lambda x: x["ranks"][rank] != "")
    h = h.withColumn("votes", F.transform(given, lambda x: F.struct(x["source"].alias("source"), value(x).alias("v"))))
    h = h.withColumn("tally", F.transform(F.array_distinct(F.transform("votes", lambda x: x["v"])), lambda v: F.struct(v.alias("v"), F.size(F.filter("votes", lambda y: y["v"] == v)).alias("n"))))
    h = h.withColumn("leaders", F.filter("tally", lambda t: t["n"] == F.array_max(F.transform("tally", lambda u: u["n"]))))
    h = h.withColumns({f"{rank}_top": F.coalesce(F.get("leaders", F.lit(0))["v"], F.lit("")), f"{rank}_tied": F.size("leaders") > 1, f"{rank}_n": F.size("votes")})
    lost = F.filter("votes", lambda x: x["v"] != F.col(f"{rank}_top"))
    return h.withColumn(f"{rank}_lost", F.transform(lost, lambda x: F.concat(x["source"], F.lit(":"), x["v"])))


def resolve_hosts(answers: DataFrame, on_tie: str = "blank", disputed: str = "include", any_kingdom: bool = False) -> DataFrame:
    """A row for each ``host`` of ``answers``: what its sources say, and which of them is followed.

    ``answers`` has a row for each answer that there is: host, rank, cand (0 for
    the name itself, 1 and more for its synonyms), ord (of the source), source,
    asked, returned, match_type and the seven ranks; of two answers of one
    source to one name the one that is accepted counts, else either. Later
    names count only where no earlier one was accepted by any source. A host
    that doesn't look like a taxon isn't resolved.

    The phylum is voted on by its normal name. The lineage is that of the
    source with most ranks filled, of equals the first, among those that
    voted with the majority. Without a majority it is withheld (``on_tie``
    'blank') or the first source's ('source-order'); ``disputed`` 'exclude'
    withholds it on any disagreement. Null ranks are empty ones. A host has as
    many answers as sources and names, so its group is small.
    """
    rows = judged(answers.withColumns({r: F.coalesce(f"`{r}`", F.lit("")) for r in RANKS}), any_kingdom)
    # a window, since a join of the rows with their own aggregate would judge each answer twice
    rows = rows.withColumn("_last", F.min(F.when(F.col("accepted"), F.col("cand"))).over(Window.partitionBy("host"))).where("host IS NOT NULL AND (_last IS NULL OR cand <= _last)")
    filled = sum((F.col(f"`{r}`") != "").cast("int") for r in RANKS)
    said = F.struct(
        "ord", "source", "cand", "asked", F.trim(F.coalesce("returned", F.lit(""))).alias("returned"), "match_type", "accepted", "provisional", "vernacular", "reason",
        normal_phylum(F.col("phylum"), F.col("class"), F.col("order")).alias("normal"), filled.alias("filled"), F.struct(*RANKS).alias("ranks"), _two_words(F.col("returned")).alias("key"),
    )
    each = rows.groupBy("host", "source").agg(F.min_by(said, F.struct(~F.col("accepted"), "cand", "ord", "returned")).alias("said"))
    h = each.groupBy("host").agg(F.array_sort(F.collect_list("said")).alias("said"))

    agreeing = lambda x, every: F.size(F.filter(every, lambda y: (y["accepted"] | y["provisional"]) & (y["key"] == x["key"]) & (y["key"] != ""))) >= 2
    h = h.withColumn("backed", F.transform("said", lambda x: x["provisional"] & agreeing(x, F.col("said"))))
    h = h.withColumn("yes", F.filter("said", lambda x, i: x["accepted"] | F.get("backed", i))).withColumn("no", F.filter("said", lambda x, i: ~x["accepted"] & ~F.get("backed", i)))
    h = _voted(h, "phylum", lambda x: x["normal"])
    h = _voted(h, "order", lambda x: x["ranks"]["order"])
    pool = F.filter("yes", lambda x: (F.col("phylum_top") == "") | (x["ranks"]["phylum"] == "") | (x["ranks"]["phylum"] == F.col("phylum_top")))
    h = h.withColumn("pool", pool).withColumn("pool", F.when(F.size("pool") == 0, F.col("yes")).otherwise(F.col("pool")))
    h = h.withColumn("fullest", F.array_max(F.transform("pool", lambda x: x["filled"])))
    h = h.withColumn("best", F.get(F.filter("pool", lambda x: x["filled"] == F.col("fullest")), F.lit(0)))
    some, tied, lost = F.size("yes") > 0, F.col("phylum_tied"), F.size("phylum_lost") > 0
    rejected = F.array_join(F.transform("no", lambda x: F.concat(x["source"], F.lit("("), x["returned"], F.lit(": "), x["reason"], F.lit(")"))), ";")
    said_no = F.array_join("phylum_lost", ";")
    h = h.withColumn("taxon", looks_like_a_taxon(F.col("host"))).withColumn("rejected", rejected)
    withheld = F.when(some & tied & F.lit(on_tie == "blank"), "TIE: no majority phylum, lineage withheld").when(some & lost & F.lit(disputed == "exclude"), "DISPUTED: lineage withheld")
    h = h.withColumn("withheld", withheld)
    use = F.col("taxon") & some & F.col("withheld").isNull()
    flags = F.array_compact(F.array(
        F.when(F.exists("yes", lambda x: x["vernacular"]), "resolved from a common name -- verify"), F.when(F.exists("backed", lambda b: b), "spelling corrected, corroborated by 2+ sources"),
        F.when(tied, "TIE broken by source order"), F.when(lost, "PHYLUM DISAGREEMENT"), F.when(F.size("order_lost") > 0, "order disagreement"),
        F.when(F.size("yes") == 1, "single source only"), F.when(F.size("no") > 0, "a source answered about a different organism"),
    ))
    flag = (
        F.when(~F.col("taxon"), "not a scientific name; not looked up").when(F.col("withheld").isNotNull(), F.concat("withheld", F.lit("; "), said_no))
        .when(some, F.array_join(flags, "; ")).when(F.size("no") > 0, F.concat(F.lit("all sources rejected: "), "rejected")).otherwise("no source had this name")
    )
    told = F.col("taxon") & some
    changed = _two_words(F.col("best.asked")) != _two_words(F.col("best.returned"))
    text = lambda ok, c: F.when(ok, c).otherwise(F.lit(""))
    return h.select(
        "host", F.when(F.col("taxon"), F.size("yes")).otherwise(0).alias("n_sources_found"), text(F.col("taxon"), F.array_join(F.transform("yes", lambda x: x["source"]), ";")).alias("sources_found"),
        text(F.col("taxon"), F.col("rejected")).alias("sources_rejected"),
        text(told & (F.col("phylum_n") > 0), F.concat((F.col("phylum_n") - F.size("phylum_lost")).cast("string"), F.lit("/"), F.col("phylum_n").cast("string"))).alias("phylum_agreement"),
        text(told, said_no).alias("phylum_dispute"), text(told & tied, F.lit("yes")).alias("phylum_tied"), text(told, F.array_join("order_lost", ";")).alias("order_dispute"),
        text(use, F.col("best.source")).alias("taxonomy_source"), F.when(use, F.col("fullest")).otherwise(0).alias("n_ranks"), text(use, F.col("best.asked")).alias("matched_name"),
        *(text(use, F.col("best.ranks")[r]).alias(r) for r in RANKS), flag.alias("flag"), text(use & (F.col("best.returned") != "") & changed, F.col("best.returned")).alias("name_changed"),
    )
