"""Rules that hold on rows the generic tables don't have."""

import pytest
from pyspark.sql import functions as F

from sedgeline.functions import text as tx
from sedgeline.operators import curate
from sedgeline.operators.resolve_hosts import looks_like_a_taxon


@pytest.mark.parametrize("text,want", [(" Daphnia magna", True), ("Dap", False), ("Daphnia", True), ("daphnia magna", False), ("Daphnia magna x", False), ("", False), (None, False), ("Daphnia Magna", False)])
def test_taxa(spark, text, want):
    assert spark.range(1).select(looks_like_a_taxon(F.lit(text).cast("string"))).first()[0] is want


def test_union_keeps_one_spelling(spark):
    df = spark.createDataFrame([(["Aa", "bb"], ["Cc dd", "cc dd", "Cc  dd", "AA", "bb"]), ([], ["x"]), (["x", "X"], [])], "a array<string>, b array<string>")
    got = [tuple(r) for r in df.select(*(c.alias(n) for c, n in zip(curate.merged(F.col("a"), F.col("b")), "mn", strict=True))).collect()]
    assert got == [(["Aa", "bb", "Cc dd"], 3), (["x"], 1), (["x"], 0)]


def test_spellings_of_one_name(spark):
    rows = [(1, 1, "Nosema apis", 0), (1, 2, "nosema  apis", 0), (1, 3, "Nosema bombi", 0), (2, 4, None, 2), (2, 5, "Nosema sp.", 1), (3, 6, "", 2)]
    got = {r.k: (r.nm, r.n_names) for r in curate.pick_name(spark.createDataFrame(rows, "k int, o int, nm string, r int"), "k", "nm", "r", "o").collect()}
    assert got == {1: ("Nosema apis", 2), 2: ("Nosema sp.", 1)}


@pytest.mark.parametrize("genus,cluster,want", [("nosema", "42", "Nosema sp. MSP-C0042"), (None, "7", "Microsporidia sp. MSP-C0007"), ("", "12345", "Microsporidia sp. MSP-C12345"), ("Nosema", "c9", "Nosema sp. MSP-Cc9")])
def test_labels(spark, genus, cluster, want):
    assert spark.range(1).select(curate.provisional_label(F.lit(genus).cast("string"), "MSP", F.lit(cluster))).first()[0] == want


@pytest.mark.parametrize("asked,got,want", [("Aedes aegypti", "Aedes aegypti (L., 1758)", False), ("Aedes aegypti", "", False), ("Aedes aegypti", None, False), ("Aedes aegypti", "AEDES AEGYPTI.", False), ("Aedes aegypti", "Ochlerotatus aegypti", True)])
def test_changed_names(spark, asked, got, want):
    assert spark.range(1).select(curate.name_changed(F.lit(asked), F.lit(got).cast("string"))).first()[0] is want


@pytest.mark.parametrize("text,want", [("Énchytræus", "Enchytræus"), ("Ångström Ünal", "Angstrom Unal"), ("Dvořák Łódź", "Dvorak Łodz"), ("Bosnić ŞŢ", "Bosnic ST"), ("é", "e"), ("ǅ", "ǅ"), (None, None), ("ạ̈", "a")])
def test_accents(spark, text, want):
    assert spark.range(1).select(tx.deaccent(F.lit(text).cast("string"))).first()[0] == want
