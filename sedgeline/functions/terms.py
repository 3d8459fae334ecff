"""Ordered rules over free-text terms: shapes, phylum names, date bases, and dictionaries matched within text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import deaccent

#: Shape classes in the order in which they are tried.
SHAPES = {
    "Ovocylindrical": r"ovo[- ]?cylindric|oval[- ]?cylindric|barrel|biconic|rounded[- ]?cylindric|short[- ]?cylindric|shortly cylindric|hemispherical end",
    "Pyriform": r"pyriform|pyrifrom|pyrifom|pear|flask|lageniform|bottle[- ]?shape|drop[- ]?shape|tear[- ]?drop",
    "Spherical": r"spheric|spheroid|globular|coccoid|diplococc|roundish|\bround(ed)?\b(?![^,]*(posterior|anterior|end|pole))|almost uniform in diameter",
    "Elliptical": r"ellips|elliptic|episoid|ellispoid|ellpitic|elipsoid|lozenge",
    "Rod-shaped": r"rod|bacill|bascill|cylindric|tubular|fusiform|elongate narrow|elongate-narrow|narrow|slender|bacculiform|needle|acicular|long thin|straight",
    "Oval": r"oval|ovoid|ovate|oviform|ovoidal|egg[- ]?shape|oblong|conical|coniform|cucumiform|elongat",
}
#: Shapes that are none of the six.
OTHER_SHAPES = r"lanceolate|horseshoe|crescent|c[- ]shaped|bean[- ]?shape|kidney|clavate|club[- ]?shape|cordiform|sphenoidal|rice[- ]?grain|reniform|spindle|comma|spiral|spirilliform|dumbbell|cuneiform|wedge|triangular|rectangular|semicircular|bow[- ]?shape|irregular"
#: Other names of phyla.
PHYLUM_ALIASES = {
    "discosea": "Amoebozoa", "tubulinea": "Amoebozoa", "evosea": "Amoebozoa", "conosa": "Amoebozoa", "lobosa": "Amoebozoa", "longamoebia": "Amoebozoa",
    "ectoprocta": "Bryozoa", "craniata": "Chordata", "vertebrata": "Chordata", "urochordata": "Chordata", "aschelminthes": "Nematoda",
    "priapulida": "Cephalorhyncha", "kinorhyncha": "Cephalorhyncha", "loricifera": "Cephalorhyncha", "rhombozoa": "Dicyemida",
    "pentastomida": "Arthropoda", "myzostomida": "Annelida", "echiura": "Annelida", "sipuncula": "Annelida", "apicomplexa": "Apicomplexa",
}

# Genera that are known by their shape, and words that are no taxon.
GENUS_PATTERNS = (
    ("gammarus$|gammarellus$", "amphipod_fw", "low"),
    ("cyclops$|cyclopina$", "copepod_fw", "medium"),
    ("daphnia$|daphnid", "cladoceran", "medium"),
    ("simulium$|simuliid", "blackfly", "medium"),
    ("chironomus$|chironom", "chironomid", "medium"),
    ("penaeus$", "decapod_marine", "medium"),
    ("cambarus$|astacus$", "decapod_fw", "medium"),
    ("^culex|^aedes|^anopheles", "mosquito", "medium"),
)
NOT_TAXA = r"(?i)^(amphipod|gammaridean|laboratory|labatory|hamsters|unidentified|and|wasp|host|mice|rats|fish|insect|isopod|shrimp|crab|snail|[A-Z]\.?)$"


def first_rule(text: Column, rules: dict[str, str]) -> Column:
    """The name of the first rule whose pattern is in the text."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def shape_class(term: Column) -> Column:
    """One of six classes, 'Other' for a shape that is none of them, null for what names no shape."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(deaccent(F.coalesce(term, F.lit("")))), r"\(.*?\)", " "), r"\s+", " "))
    return first_rule(t, SHAPES | {"Other": OTHER_SHAPES})


def phylum(name: Column) -> Column:
    """The accepted name of a phylum: an alias is replaced, other names are capitalised."""
    key = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    known = F.create_map(*(F.lit(x) for kv in PHYLUM_ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, key), F.initcap(key))


def first_term(cells: DataFrame, dictionary: DataFrame, key: str, text: str, most_words: int = 4) -> DataFrame:
    """(key, category, alias): the dictionary's alias that comes first in each text, the longest of those at one place; weak ones only where no other is.

    dictionary: alias (lower-case words), category, weak. Texts are cut into
    runs of 1 to most_words words with their places, and these are joined with
    the aliases by hash; so a large dictionary costs no more than a small one.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    w = cells.select(key, words.alias("_w")).where("size(_w) > 0")
    runs = None
    for n in range(1, most_words + 1):
        at = _runs(n)
        part = w.where(F.size("_w") >= n).select(key, F.explode(at).alias("_r")).select(key, F.col("_r.at").alias("at"), F.col("_r.alias").alias("alias"), F.lit(n).alias("n"))
        runs = part if runs is None else runs.union(part)
    hits = runs.join(dictionary, "alias")
    best = Window.partitionBy(key).orderBy("weak", "at", F.desc("n"), "alias")
    return hits.withColumn("_k", F.row_number().over(best)).where("_k = 1").select(key, "category", "alias")


def _runs(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("_w", i, F.lit(n)), " ").alias("alias")))


def expand_initials(names: DataFrame, key: str, name: str) -> DataFrame:
    """(key, expanded, basis) of names such as 'D. pulex': the one genus that is named with this epithet elsewhere, else the only genus of the initial."""
    p = F.split(name, " ")
    full = names.where(F.col(name).rlike(r"^[A-Z][a-z-]{2,}( |$)")).select(p[0].alias("genus"), F.lower(F.coalesce(F.try_element_at(p, F.lit(2)), F.lit(""))).alias("epithet")).distinct()
    genera = full.groupBy(F.substring("genus", 1, 1).alias("initial")).agg(F.countDistinct("genus").alias("n_genera"), F.min("genus").alias("only"))
    exact = full.where("epithet <> ''").groupBy(F.substring("genus", 1, 1).alias("initial"), "epithet").agg(F.count("*").alias("n_exact"), F.min("genus").alias("exact"))
    short = names.where(F.col(name).rlike(r"^[A-Z]\.?\s+[a-z-]{3,}$")).select(key, F.substring(name, 1, 1).alias("initial"), F.lower(F.regexp_extract(name, r"\s+([a-z-]+)$", 1)).alias("epithet"))
    j = short.join(exact, ["initial", "epithet"], "left").join(genera, "initial", "left")
    genus = F.when(F.col("n_exact") == 1, F.col("exact")).when(F.col("n_genera") == 1, F.col("only"))
    return j.select(key, F.concat_ws(" ", genus, F.when(genus.isNotNull(), F.col("epithet"))).alias("expanded"), F.when(F.col("n_exact") == 1, "unique match").when(F.col("n_genera") == 1, "only candidate").otherwise("ambiguous").alias("basis"))
