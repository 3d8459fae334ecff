"""Places in free text: segments of a cell, matched with a table of names in which longer names come first and use up their words.

A segment's words and their runs are joined with the names by equality, so a
gazetteer of any size can be a table; what a segment matched is then folded in
order of precedence. Equal segments are parsed once, which also takes the heat
out of a text that a third of all cells share.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places as fixed
from ..functions import text as tx

#: Classes of names, in the order in which they take words: water, context of ambiguous names, places, phrases without a place.
SEA, CONTEXT, PLACE, NOISE = range(4)


def plain(c: Column) -> Column:
    """Lower-case words of a-z and 0-9 with one space between; dotted abbreviations are told from words first."""
    s = F.concat(F.lit(" "), F.lower(tx.deaccent(c)), F.lit(" "))
    for pattern, name in fixed.ABBREVIATIONS:
        s = F.regexp_replace(s, pattern, name)
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def gazetteer(
    spark: SparkSession,
    world: DataFrame,
    tables: Sequence[Mapping[str, str]] = (fixed.HISTORICAL, fixed.VARIANTS, dict.fromkeys(fixed.US_STATES, "USA"), dict.fromkeys(fixed.CA_PROVINCES, "CAN"), fixed.OTHER_SUBNATIONAL),
    weak: Sequence[str] = fixed.WEAK,
    ambiguous: Mapping[str, str] = fixed.AMBIGUOUS_US,
    context: Sequence[str] = fixed.US_CONTEXT,
    context_value: str = "USA",
    seas: Mapping[str, str] = fixed.SEAS,
    noise: Sequence[str] = fixed.NOISE,
) -> DataFrame:
    """(alias, class, size, pos, value, weak, other) from ``world`` (alias, value) and further tables.

    The first table that has a name decides: ``world``, then ``tables`` in
    order; of one name twice in ``world`` the least value. Names are compared
    as words. ``other`` is the value of an ambiguous name in its context. Rows
    of ``world`` without a name or a value are passed over.
    """
    rows = [(a, v, t + 1, i) for t, names in enumerate(tables) for i, (a, v) in enumerate(names.items())]
    given = spark.createDataFrame(rows, "alias string, value string, source int, pos int")
    known = world.select("alias", "value", F.lit(0).alias("source"), F.lit(0).alias("pos")).where("alias IS NOT NULL AND value IS NOT NULL").union(given)
    words = F.trim(F.regexp_replace(F.lower(tx.deaccent(F.col("alias"))), "[^a-z0-9]+", " "))
    first = F.min(F.struct("source", "pos", "value")).alias("first")
    places = known.groupBy(words.alias("alias")).agg(first).where("alias <> ''")
    by_name = lambda names: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("alias")), F.col("first.value"))
    places = places.select(
        "alias", F.lit(PLACE).alias("class"), (-F.length("alias")).alias("size"), (F.col("first.source") * 100_000 + F.col("first.pos")).alias("pos"),
        (by_name(ambiguous) if ambiguous else F.col("first.value")).alias("value"), F.col("alias").isin(*weak).alias("weak"),
        F.when(F.col("alias").isin(*ambiguous), F.lit(context_value)).alias("other"),
    )
    more = [(a, SEA, -len(a), i, v) for i, (a, v) in enumerate(seas.items())] + [(a, CONTEXT, 0, i, context_value) for i, a in enumerate(context)]
    more += [(a, NOISE, 0, i, "") for i, a in enumerate([*noise, *weak])]
    extra = spark.createDataFrame(more, "alias string, class int, size int, pos int, value string")
    return places.union(extra.select("*", F.lit(False), F.lit(None).cast("string")))


def _once(values: Column, more: Column) -> Column:
    return F.when(F.array_contains(values, more), values).otherwise(F.array_append(values, more))


def _fold(found: Column, context_value: str) -> Column:
    """What the matches of a segment come to when each takes its words in turn."""
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<int>").alias("taken"), none.alias("places"), none.alias("weak"), none.alias("seas"), F.lit(False).alias("context"))

    def step(s: Column, m: Column) -> Column:
        own = F.sequence(m["start"], m["start"] + m["n"] - 1)
        free = ~F.arrays_overlap(s["taken"], own)
        place = F.when(m["other"].isNotNull() & (s["context"] | F.array_contains(s["places"], context_value)), m["other"]).otherwise(m["value"])
        strong = free & (m["class"] == PLACE) & ~m["weak"]
        takes = free & ((m["class"] == SEA) | strong | (m["class"] == NOISE))
        return F.struct(
            F.when(takes, F.concat(s["taken"], own)).otherwise(s["taken"]).alias("taken"),
            F.when(strong, _once(s["places"], place)).otherwise(s["places"]).alias("places"),
            F.when(free & (m["class"] == PLACE) & m["weak"], _once(s["weak"], m["value"])).otherwise(s["weak"]).alias("weak"),
            F.when(free & (m["class"] == SEA), _once(s["seas"], m["value"])).otherwise(s["seas"]).alias("seas"),
            (s["context"] | (free & (m["class"] == CONTEXT))).alias("context"),
        )

    return F.aggregate(found, start, step)


def segments(cell: Column) -> Column:
    """The parts of a cell between semicolons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ";"), lambda s: F.trim(s)), lambda s: s != "")


def parse_segments(texts: DataFrame, names: DataFrame, context_value: str = "USA", filler: Sequence[str] = fixed.FILLER) -> DataFrame:
    """(segment, places, seas, leftover, informative) for each different ``segment`` of ``texts``.

    Places and seas are in the order of precedence in which they matched: the
    longest name first. A weak name counts where no other place was named.
    leftover are the words that nothing took, informative those of them that
    aren't filler.
    """
    words = texts.select("segment").where("segment IS NOT NULL").distinct().select("segment", tx.tokens(plain(F.col("segment"))).alias("words"))
    longest = names.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("words"))), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.struct(i.alias("start"), n.alias("n"), F.array_join(F.slice("words", i, n), " ").alias("alias")))))
    at = words.where(F.size("words") > 0).select("segment", F.explode(runs).alias("run")).select("segment", "run.*")
    key = F.struct("class", "size", "pos", "start", "n", "value", "weak", "other")
    found = at.join(names, "alias").groupBy("segment").agg(F.array_sort(F.collect_list(key)).alias("found"))
    state = words.join(found, "segment", "left").withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))
    state = state.withColumn("s", _fold(F.col("found"), context_value))
    left = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), (i + 1).alias("i"))), lambda x: ~F.array_contains(F.col("s.taken"), x["i"]) & ~x["w"].rlike("^[a-z]{1,2}$"))
    state = state.withColumn("left", F.transform(left, lambda x: x["w"]))
    told = F.filter("left", lambda w: ~w.isin(*filler) & ~w.rlike("^[0-9]+$"))
    return state.select(
        "segment", F.when(F.size("s.places") > 0, F.col("s.places")).otherwise(F.col("s.weak")).alias("places"), F.col("s.seas").alias("seas"),
        F.array_join("left", " ").alias("leftover"), F.array_join(told, " ").alias("informative"),
    )


def parse_places(cells: DataFrame, names: DataFrame, id_col: str = "id", cell_col: str = "cell") -> DataFrame:
    """(id, places, seas, leftover, informative, unresolved) for each id of ``cells``: the union over its cell's segments, in their order.

    unresolved lists the segments that named nothing and aren't mere filler.
    Rows of one id are one cell after the other in an undefined order. A cell
    without a segment, such as a null one, has empty results.
    """
    own = cells.select(F.col(f"`{id_col}`").alias("id"), F.posexplode_outer(segments(F.col(f"`{cell_col}`"))).alias("at", "segment"))
    got = own.join(parse_segments(own, names), "segment", "left")
    by = got.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "segment", "places", "seas", "leftover", "informative"))).alias("s"))
    every = lambda k: F.array_distinct(F.flatten(F.filter(F.transform("s", lambda x: x[k]), lambda v: v.isNotNull())))
    words = lambda k: F.array_join(F.filter(F.transform("s", lambda x: x[k]), lambda v: v != ""), " ")
    lost = F.filter("s", lambda x: (F.size("s") > 0) & x["segment"].isNotNull() & (F.size(x["places"]) == 0) & (F.size(x["seas"]) == 0) & (x["informative"] != ""))
    return by.select(
        "id", every("places").alias("places"), every("seas").alias("seas"), words("leftover").alias("leftover"), words("informative").alias("informative"),
        F.transform(lost, lambda x: x["segment"]).alias("unresolved"),
    )


def water_counts(found: DataFrame, species_col: str = "species", basins: Mapping[str, str] = fixed.BASINS, by_basin: bool = True, everywhere: bool = False) -> DataFrame:
    """(water, n): species by water body or basin, each once; without ``everywhere`` only rows that named no place.

    A water body that no basin is known of is a basin itself.
    """
    rows = found if everywhere else found.where(F.size("places") == 0)
    sea = rows.select(F.col(f"`{species_col}`").alias("species"), F.explode("seas").alias("water"))
    if by_basin:
        known = F.create_map(*(F.lit(x) for kv in basins.items() for x in kv))
        sea = sea.withColumn("water", F.coalesce(F.element_at(known, F.col("water")), F.col("water")))
    return sea.distinct().groupBy("water").agg(F.count("*").alias("n"))
