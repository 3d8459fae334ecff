import pytest
from pyspark.sql import functions as F

from sedgeline.functions import hosts as hs

FIELDS = ("name", "rank", "role", "synonyms", "secondary_organism", "context", "subgenus", "repair")
#: cell and, by host, the fields that aren't empty
CELLS = [
    ("Aedes cantans (type host); Aedes flavescens", [{"name": "Aedes cantans", "rank": "species", "role": "type host"}, {"name": "Aedes flavescens", "rank": "species"}]),
    ("Bombus honshuensis, Bombus diversus diversus, Bombus ussurensis", [{"name": n, "rank": "species"} for n in ("Bombus honshuensis", "Bombus diversus", "Bombus ussurensis")]),
    ("Nosema bombycis Nageli, 1857", [{"name": "Nosema bombycis", "rank": "species"}]),
    ("Aedes sp., type host", [{"name": "Aedes sp., type host", "rank": "other"}]),
    ("Daphnia magna; D. pulex", [{"name": "Daphnia magna", "rank": "species"}, {"name": "Daphnia pulex", "rank": "species"}]),
    ("D. pulex; Daphnia magna; D. longispina", [{"name": "D. pulex", "rank": "species"}, {"name": "Daphnia magna", "rank": "species"}, {"name": "D. longispina", "rank": "species"}]),
    ("Sycia inopinata (in the polychaete annelid Audouinia tentaculata)", [{"name": "Sycia inopinata", "rank": "species", "secondary_organism": "Audouinia tentaculata", "context": "in the polychaete annelid audouinia tentaculata"}]),
    ("Heterophyes heterophyes (parasite in Liza ramada)", [{"name": "Heterophyes heterophyes", "rank": "species", "secondary_organism": "Liza ramada", "context": "parasite in liza ramada"}]),
    ("Lecudina (Ophioidina) sp.", [{"name": "Lecudina", "rank": "genus", "subgenus": "Ophioidina"}]),
    ('Lecudina (Ophioidina) sp." in Lumbriconereis latreilli and L. zonata', [{"name": "Lecudina", "rank": "genus", "subgenus": "Ophioidina", "secondary_organism": "Lumbriconereis latreilli", "context": '" in lumbriconereis latreilli and l. zonata'}]),
    ('A gregarine, "form en comete," in the polychaete annelid Capitella capitata', [{"rank": "unidentified", "secondary_organism": "Capitella capitata", "context": '" in the polychaete annelid capitella capitata'}]),
    ("Daphnia Iongispina", [{"name": "Daphnia longispina", "rank": "species", "repair": "confusable letter"}]),
    ("EuboreIlia plebeja", [{"name": "EuboreIlia plebeja", "rank": "species"}]),
    ("Ageneotettix d. deorum", [{"name": "Ageneotettix deorum", "rank": "species", "repair": "abbreviated subspecies dropped"}]),
    ("S.mauritia acronyctoides", [{"name": "S. mauritia", "rank": "species", "repair": "missing space after initial"}]),
    ("Daphnia longispina/galeata complex", [{"name": "Daphnia longispina", "rank": "species", "repair": "aggregate reduced to first name"}]),
    ("Dissosteira Carolina", [{"name": "Dissosteira carolina", "rank": "species", "repair": "epithet decapitalised"}]),
    ("Aedes sticticus (= Ochlerotatus crinifer)", [{"name": "Aedes sticticus", "rank": "species", "synonyms": ["Ochlerotatus crinifer"]}]),
    ("Lepeophtheirus salmonis (also Paranucleospora theridion)", [{"name": "Lepeophtheirus salmonis", "rank": "species", "synonyms": ["Paranucleospora theridion"]}]),
    ("Simulium x (should be Simulium aureum, according to A)", [{"name": "Simulium x", "rank": "species", "role": "should be simulium aureum, according to a", "synonyms": ["Simulium aureum"]}]),
    ("Poecilia reticulata (Swamp Guppy)", [{"name": "Poecilia reticulata", "rank": "species"}]),
    ("Unknown; not stated; ??; crab", [{"rank": "unidentified"}, {"rank": "unidentified"}, {"rank": "unidentified"}]),
    ("Various; None; N/A", []),
    ("Énchytreus cf. albidus s.l.", [{"name": "Enchytreus albidus", "rank": "species"}]),
    ("Gammarus spp. nov. 3", [{"name": "Gammarus", "rank": "genus"}]),
    ("Homarus", [{"name": "Homarus", "rank": "genus"}]),
    ("", []),
    (" ;; ", []),
    (None, []),
]


def test_cells(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CELLS)], "id int, cell string")
    got = {r.id: r.h for r in hs.parse_host_cells(df, "cell", "h").collect()}
    for i, (cell, want) in enumerate(CELLS):
        full = [{f: w.get(f, [] if f == "synonyms" else "") for f in FIELDS} for w in want]
        assert [{f: h[f] for f in FIELDS} for h in got[i]] == full, cell


#: asked, returned, rank, answer
NAMES = [
    ("Simulium", "Simulium Latreille, 1802", "genus", True),
    ("Aedes aegypti", "Aedes (Isoaedes)", "species", True),
    ("Nereis complana", "Nereis complanum", "species", True),
    ("Nereis complana", "Nereis", "species", True),
    ("Nereis complana", "", "species", True),
    ("Nereis complana", None, "species", True),
    ("123", "Nereis", "species", True),
    ("Euprocitis x", "Euproctis", "species", True),
    ("Daphnia magna", "Dytiscus magna", "species", False),
    ("Abraxas grossulariata", "Abramis brama", "species", None),
    ("Ixodes ricinus", "Ixodes persulcatus Schulze, 1930", "species", False),
    ("Apis mellifera", "Apis melifera", "species", True),
    ("Dog", "Lingula", "genus", False),
]


def test_agreement(spark):
    df = spark.createDataFrame([(i, *n[:3]) for i, n in enumerate(NAMES)], "id int, q string, r string, rank string")
    got = {r.id: r.a for r in df.select("id", hs.name_agrees(F.col("q"), F.col("r"), F.col("rank")).alias("a")).collect()}
    for i, n in enumerate(NAMES):
        assert got[i].agrees is n[3], n
        assert bool(got[i].reason) == (n[3] is not True)
    assert got[9].reason == "genus differs by 2: asked Abraxas, got Abramis"


@pytest.mark.parametrize("text,want", [("Unidentified copepod", True), ("Gregarine in gut", True), ("3 species of shrimp", True), ("THE host", True), ("Thea sinensis", False), ("Éa b", False), ("crab", True), ("", False)])
def test_descriptions(spark, text, want):
    assert spark.range(1).select(hs.is_description(F.lit(text))).first()[0] is want
