import pytest

from sedgeline.operators import gazetteer as gz

WORLD = [("Canada", "CAN"), ("India", "IND"), ("Guinea", "GIN"), ("Guinea-Bissau", "GNB"), ("Russia", "RUS"), ("Georgia", "GEO"), ("South Africa", "ZAF"), ("Siam", "XXX"), (None, "NUL"), ("Nowhere", None), ("Åland", "ALA"), ("Canada", "CAX")]
#: cell, places, seas, unresolved segments
CASES = [
    ("U.S.A. (California)", ["USA"], [], []),
    ("Russia: Lake Baikal", ["RUS"], [], []),
    ("U.S.S.R. (Moldavia)", ["MDA"], [], []),
    ("U.S.S.R.", ["RUS"], [], []),
    ("x; Czechoslovakia (near Chotebor) [Weiser]; Canada, Ontario", ["CZE", "CAN"], [], []),
    ("Canada; Czechoslovakia", ["CAN", "CZE"], [], []),
    ("Canada, Czechoslovakia", ["CAN"], [], []),
    ("Puget Sound; Strait of Georgia", ["USA", "CAN"], [], []),
    ("Georgia", ["GEO"], [], []),
    ("Georgia, U.S.", ["USA"], [], []),
    ("Puget Sound and Georgia", ["USA"], [], []),
    ("Indian Ocean", [], ["Indian Ocean"], []),
    ("Indian Ocean, India", ["IND"], ["Indian Ocean"], []),
    ("South Africa; Gulf of Mexico", ["ZAF"], ["Gulf of Mexico"], []),
    ("Guinea-Bissau", ["GNB"], [], []),
    ("Papua New Guinea", ["PNG"], [], []),
    ("Siam", ["XXX"], [], []),
    ("ÅLAND, Réunion", ["FRA", "ALA"], [], []),
    ("Zurich pond; Canada", ["CAN"], [], ["Zurich pond"]),
    ("unknown lake, 1987", [], [], []),
    ("Canadas", [], [], ["Canadas"]),
    ("new (usa) york", ["USA"], [], []),
    (" ; ;", [], [], []),
    ("", [], [], []),
    (None, [], [], []),
]


@pytest.fixture(scope="module")
def names(spark):
    return gz.gazetteer(spark, spark.createDataFrame(WORLD, "alias string, value string")).cache()


def test_cells(spark, names):
    rows = [(i, c[0], "other") for i, c in enumerate(CASES)]
    got = {r.id: r for r in gz.parse_places(spark.createDataFrame(rows, "id long, cell string, segment string"), names).collect()}
    assert len(got) == len(CASES)
    for i, (cell, places, seas, lost) in enumerate(CASES):
        assert (got[i].places, got[i].seas, got[i].unresolved) == (places, seas, [x for x in lost]), cell
    assert got[4].leftover == "near weiser" and got[4].informative == "weiser"
    assert got[19].leftover == "lake 1987" and got[19].informative == ""


def test_one_value_for_each_name(names):
    aliases = [r.alias for r in names.where("class = 2").collect()]
    assert len(aliases) == len(set(aliases)) and "guinea bissau" in aliases and "nowhere" not in aliases
    assert {r.value for r in names.where("class = 2 AND alias = 'canada'").collect()} == {"CAN"}


def test_repeated_rows_empty_tables_and_long_cells(spark, names):
    kind = "id long, cell string"
    assert gz.parse_places(spark.createDataFrame([], kind), names).collect() == []
    rows = [(i, "India; Lake X") for i in range(300)] + [(1, "India; Lake X"), (None, "Canada"), (900, "word " * 3000 + "india"), (901, "; ".join(["Canada", "India"] * 500))]
    got = {r.id: r for r in gz.parse_places(spark.createDataFrame(rows, kind), names).collect()}
    assert len(got) == 303 and got[1].places == ["IND"] and got[None].places == ["CAN"] and got[900].places == ["IND"] and got[901].places == ["CAN", "IND"]
    none = gz.gazetteer(spark, spark.createDataFrame([], "alias string, value string"), tables=(), weak=(), ambiguous={}, context=(), seas={}, noise=())
    assert none.collect() == []
    assert [r.places for r in gz.parse_places(spark.createDataFrame([(1, "Canada")], kind), none).collect()] == [[]]


def test_water(spark):
    found = spark.createDataFrame([(1, [], ["North Sea", "Black Sea"]), (1, [], ["North Sea"]), (2, ["GBR"], ["North Sea"]), (None, [], ["Lake Y"])], "species long, places array<string>, seas array<string>")
    assert {tuple(r) for r in gz.water_counts(found).collect()} == {("Atlantic Ocean", 1), ("Lake Y", 1)}
    assert {tuple(r) for r in gz.water_counts(found, by_basin=False, everywhere=True).collect()} == {("North Sea", 2), ("Black Sea", 1), ("Lake Y", 1)}
