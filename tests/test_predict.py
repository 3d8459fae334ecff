"""The cascade on a fixture, and close genera against all pairs in plain Python."""

import random

from sedgeline.operators import predict as pr

GROUPS = [("amphipod_fw", "freshwater", ["freshwater"], "Crustacea", "", "high"), ("moth", "terrestrial", ["terrestrial"], "Insecta", "n", "high"), ("fish", "marine", ["marine", "brackish"], "Fish", "", "medium")]
GENERA = [(1, "Abraxas", "moth"), (2, "Euproctis", "moth"), (3, "Coregonus", "moth"), (4, "Abramis", "fish"), (5, "coregonus", "fish"), (6, "Lost", "unlisted"), (7, None, "moth"), (8, "Gadus", "fish")]
CASES = {
    "Abraxas grossulariata": ("terrestrial", "high", "genus table (moth)"),
    "  ABRAXAS": ("terrestrial", "high", "genus table (moth)"),
    "Coregonus lavaretus": ("marine", "medium", "genus table (fish)"),
    "Eogammarus oclairi": ("freshwater", "low", "name pattern (amphipod_fw)"),
    "Cyclops sp.": ("", "none", "genus not in table"),  # its group is in no table
    "Euprocitis x": ("terrestrial", "medium", "fuzzy match to Euproctis (1 edit) - LIKELY MISSPELLING"),
    "Euprocitiz x": ("", "none", "possible misspelling of Euproctis (2 edits) - NOT APPLIED, check manually"),
    "Euprotis x": ("terrestrial", "medium", "fuzzy match to Euproctis (1 edit) - LIKELY MISSPELLING"),
    "Abraxis": ("terrestrial", "medium", "fuzzy match to Abraxas (1 edit) - LIKELY MISSPELLING"),
    "Abrmas": ("", "none", "possible misspelling of Abraxas (2 edits) - NOT APPLIED, check manually"),  # as near to Abramis, which comes later
    "Gadis": ("", "none", "genus not in table"),  # too short
    "Lost": ("", "none", "genus not in table"),
    "Shrimp": ("", "none", "not a taxon name"),
    "A.": ("", "none", "not a taxon name"),
    "Shrimp of rivers": ("", "none", "genus not in table"),
    " ": ("", "none", "no host name parsed"),
    None: ("", "none", "no host name parsed"),
}


def _tables(spark):
    groups = spark.createDataFrame(GROUPS, "grp string, environment string, environments array<string>, host_group string, note string, confidence string")
    return spark.createDataFrame(GENERA, "ord int, genus string, grp string"), groups


def test_cascade_with_repeats_and_clashing_columns(spark):
    genera, groups = _tables(spark)
    rows = [(h, i, "old", "old", "old") for i, h in enumerate([*CASES, "Abraxas grossulariata", None])]
    out = pr.predict(spark.createDataFrame(rows, "host string, id int, basis string, key string, near string"), genera, groups).collect()
    assert len(out) == len(rows) and {r.near for r in out} == {r.key for r in out} == {"old"}
    assert {r.id: r.host for r in out} == {i: h for h, i, *_ in rows}
    assert [(r.host, r.primary_environment, r.confidence, r.basis) for r in out if (r.primary_environment, r.confidence, r.basis) != CASES[r.host]] == []
    assert {r.host_group for r in out if r.confidence == "none"} == {"Unresolved"} and all(r.environments == [] for r in out if r.confidence == "none")


def test_empty_tables(spark):
    genera, groups = _tables(spark)
    hosts = spark.createDataFrame([("Abraxas",)], "host string")
    assert pr.predict(hosts, genera.limit(0), groups).first().basis == "genus not in table"
    assert pr.predict(hosts, genera, groups.limit(0)).first().basis == "genus not in table"
    assert pr.predict(hosts.limit(0), genera, groups).isEmpty()


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_close_genera_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))  # noqa: E731  two letters: many ties and repeated pieces
    known = sorted({word(rng.randint(1, 12)) for _ in range(150)}, key=lambda _: rng.random())
    keys = {word(rng.randint(1, 13)) for _ in range(200)} | {k + "x" for k in known} | {k[1:] for k in known}
    want = set()
    for k in keys:
        near = [(_edits(k, g), i, g) for i, g in enumerate(known) if k and g[0] == k[0] and abs(len(g) - len(k)) <= 2]
        if len(k) >= 6 and near and min(near)[0] <= 2:
            want.add((k, min(near)[2], min(near)[0]))
    got = pr.close_genera(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(i, g, "m") for i, g in enumerate(known)], "ord int, genus string, grp string"))
    got = [(r.key, r.near, r.edits) for r in got.collect()]
    assert len(want) > 100 and len(got) == len(want) and set(got) == want
