import difflib
import random

import pytest
from pyspark.sql import functions as F

from sedgeline.functions import text as tx
from sedgeline.operators.attribution import attribute, close_spellings
from sedgeline.operators.components import canonical_names


def _keys(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


@pytest.mark.parametrize("cutoff,seed", [(0.9, 0), (0.9, 1), (0.8, 2), (0.7, 3)])
def test_close_spellings_equal_all_pairs(spark, cutoff, seed):
    rng = random.Random(seed)
    genera = ["nosema", "encephalitozoonella", "n", "amblyospora"]
    keys = set()
    while len(keys) < 160:
        e = "".join(rng.choice("abcde") for _ in range(rng.choice([1, 2, 3, 5, 8, 13])))
        keys.add(f"{rng.choice(genera)} {e}")
        base = rng.choice(sorted(keys)).split(" ")
        i = rng.randrange(len(base[1]) + 1)
        keys.add(f"{base[0]} {base[1][:i]}{rng.choice('abz')}{base[1][i + rng.randrange(2):]}")
    keys = sorted(keys)
    want = set()
    for k in keys[::2]:
        same = [x for x in keys if x.split()[:1] == k.split()[:1]]
        for place, other in enumerate(difflib.get_close_matches(k, same, n=3, cutoff=cutoff), 1):
            want.add((k, other, place))
    got = close_spellings(_keys(spark, keys[::2] + [None] + keys[:4:2]), _keys(spark, keys + keys[:9]), cutoff).collect()
    assert {(r.key, r.other, r.place) for r in got} == want and len(got) == len(want)


def test_a_genus_with_most_names(spark):
    keys = [f"nosema {''.join(chr(97 + (i // 26**j) % 26) for j in range(3))}formis" for i in range(900)]
    got = close_spellings(_keys(spark, keys[:60]), _keys(spark, keys)).collect()
    want = {(k, o) for k in keys[:60] for o in difflib.get_close_matches(k, keys, n=3, cutoff=0.9)}
    assert {(r.key, r.other) for r in got} == want


CLUSTERS = [
    (1, "Whatever", "mg 100001.2"), (2, "Nosema apis Zander, 1909", ""), (3, "Vairimorpha apis", None), (4, "N. apis", ""), (5, "Nematocida parisii", ""), (6, "Ameson apis", ""), (7, "Nosema bombycis", ""),
    (8, "Nosema sp.", ""), (9, None, None), (10, "Encephalitozoon cuniculi", "XR_552278"), (10, "Encephalitozoon cuniculi", "XR_552278"), (11, "Perezia nelsoni", ""), (None, "Nosema apis", ""),
]
ROWS = [(1, "Nosema apis = Vairimorpha apis", "MG100001"), (2, "Nosema bombyci", ""), (3, "Nosema parisii", "XR552278; AB123456"), (4, "Ameson nelsoni (Perezia nelsoni)", None), (5, "Uncultured thing", ""), (6, None, "XR552278")]
WANT = {
    1: ("existing", "accession", 1, 1), 2: ("existing", "species name", 1, 1), 3: ("existing", "species name", 1, 1), 4: ("existing", "abbreviated genus", 1, 1), 5: ("existing", "abbreviated genus", 1, 3),
    6: ("probable", "same epithet, different genus", 1, 1), 7: ("probable", "close spelling to nosema bombyci", 1, 2), 8: ("new", "", 0, None), 9: ("new", "", 0, None), 10: ("existing", "accession", 2, 3), 11: ("existing", "species name", 1, 4),
}


def test_tiers(spark):
    c, r = spark.createDataFrame(CLUSTERS, "cluster int, name string, accessions string"), spark.createDataFrame(ROWS, "row int, name string, accessions string")
    got = attribute(c, r).collect()
    assert {x.cluster: tuple(x)[1:] for x in got} == WANT and len(got) == len(WANT)
    assert {x.status for x in attribute(c, r.limit(0)).collect()} == {"new"} and attribute(c.limit(0), r).collect() == []


@pytest.mark.parametrize("text,want", [("Ameson nelsoni (Perezia nelsoni)", ["Perezia nelsoni"]), ("A b (siberian isolate) (18S partial) (?)", []), ("Nosema apis = Vairimorpha apis", ["Vairimorpha apis"]), ("Aus bus (syn. Cus dus)", ["Cus dus"]), ("Aus bus syn. Cus sp.", ["Cus sp."]), (None, [])])
def test_other_names(spark, text, want):
    assert spark.range(1).select(tx.other_names(F.lit(text).cast("string"))).first()[0] == want


@pytest.mark.parametrize("text,want", [("Metchnikovella dobrovolskiji sp. nov.", "metchnikovella dobrovolskiji"), ("Aus bus Vávra & Larsson 1994", "aus bus"), ("Aus bus O’Brien, 1901", "aus bus"), ("Aus bus emend. x", "aus bus"), ("Aus bus incertae sedis", "aus bus"), ("Aus cf. bus", "aus bus"), ("Aus bus strain K1", "aus bus"), ("", ""), (None, "")])
def test_keys(spark, text, want):
    assert spark.range(1).select(tx.name_key(F.lit(text).cast("string"))).first()[0] == want


def test_synonyms(spark):
    lines = [["c", "b"], ["b", "a"], ["x", "y", "z"], ["z", "w"], ["q"], ["q", "q"], [None, "", "p"], None, ["m", None, "l"]] + [[f"k{i:03d}", f"k{i + 1:03d}"] for i in range(60)] + [["k060", "k000"]]
    got = canonical_names(spark.createDataFrame([(x,) for x in lines], "names array<string>")).collect()
    want = {"a": "a", "b": "a", "c": "a", "w": "w", "x": "w", "y": "w", "z": "w", "l": "l", "m": "l"} | {f"k{i:03d}": "k000" for i in range(61)}
    assert {r.name: r.canonical for r in got} == want and len(got) == len(want)
    assert canonical_names(spark.createDataFrame([], "names array<string>")).collect() == []


def test_an_accession_that_all_share_makes_no_pairs(spark):
    from pyspark.sql import functions as F

    from sedgeline.operators.attribution import attribute

    from test_resolve import joined_rows

    ids = spark.range(500)
    clusters = ids.select(F.col("id").alias("cluster"), F.lit("Nosema bombycis").alias("name"), F.when(F.col("id") == 0, "XR200003; MG100001.1").otherwise("XR200003").alias("accessions"))
    rows = ids.select(F.col("id").alias("row"), F.lit("Nosema apis").alias("name"), F.concat(F.lit("XR200003.1; MG"), F.col("id") + 100000).alias("accessions"))
    got = attribute(clusters, rows, cutoff=None)
    assert {tuple(r)[1:] for r in got.collect()} == {("existing", "accession", 500, 0)}
    assert joined_rows(got) <= 5000
