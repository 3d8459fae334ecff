import pytest

from sedgeline.operators.resolve_hosts import RANKS, resolve_hosts

KIND = "host string, rank string, cand int, ord int, source string, asked string, returned string, match_type string, " + ", ".join(f"`{r}` string" for r in RANKS)


def _answer(host, ord_, phylum, returned=None, cand=0, asked=None, order="", kind="EXACT", kingdom="Animalia", klass="", family="F"):
    return (host, "species", cand, ord_, "ABCD"[ord_], asked or host, returned if returned is not None else host, kind, kingdom, phylum, klass, order, family, host.split()[0], host)


def _resolve(spark, rows, **how):
    got = resolve_hosts(spark.createDataFrame(rows, KIND), **how).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r.host: r for r in got}


def test_majority_and_choice(spark):
    h = "Daphnia magna"
    r = _resolve(spark, [_answer(h, 0, "Chordata"), _answer(h, 1, "Arthropoda", family=""), _answer(h, 2, "Arthropoda", order="Cladocera")])[h]
    assert (r.phylum, r.taxonomy_source, r.phylum_agreement, r.phylum_dispute, r.phylum_tied) == ("Arthropoda", "C", "2/3", "A:Chordata", "")
    assert r.flag == "PHYLUM DISAGREEMENT" and r.sources_found == "A;B;C"
    r = _resolve(spark, [_answer(h, 0, "Chordata"), _answer(h, 1, "Arthropoda"), _answer(h, 2, "Arthropoda")], disputed="exclude")[h]
    assert r.phylum == "" and r.flag.startswith("DISPUTED") and r.sources_found == "A;B;C"


@pytest.mark.parametrize("on_tie,phylum,flag", [("blank", "", "TIE: no majority phylum, lineage withheld; B:Arthropoda"), ("source-order", "Chordata", "TIE broken by source order; PHYLUM DISAGREEMENT")])
def test_ties(spark, on_tie, phylum, flag):
    h = "Daphnia magna"
    r = _resolve(spark, [_answer(h, 0, "Chordata"), _answer(h, 1, "Arthropoda")], on_tie=on_tie)[h]
    assert (r.phylum, r.flag, r.phylum_tied) == (phylum, flag, "yes")


def test_names_of_one_phylum_are_one_vote(spark):
    h = "Lecudina longa"
    r = _resolve(spark, [_answer(h, 0, "Myzozoa", klass="Conoidasida"), _answer(h, 1, "Miozoa", order="Eugregarinida"), _answer(h, 2, "Apicomplexa"), _answer(h, 3, "Miozoa")])[h]
    assert (r.phylum_agreement, r.phylum_dispute) == ("3/4", "D:Miozoa") and r.taxonomy_source == "C"


def test_rejection_corroboration_and_synonyms(spark):
    a, b, c, d, e = "Abraxas grossa", "Euprocitis minor", "Homarus major", "Limnetis brevis", "Gadus morhua"
    rows = [_answer(a, 0, "Chordata", "Abramis grossa")]  # two edits, alone
    rows += [_answer(b, 0, "Arthropoda", "Euproktis minor"), _answer(b, 1, "Arthropoda", "Euproktis minor (L., 1758)")]  # two edits, twice
    rows += [_answer(c, 0, "X", "Other thing"), _answer(c, 0, "Arthropoda", "Astacus major", cand=1, asked="Astacus major"), _answer(c, 1, "Y", "Zeta", cand=2, asked="Zeta")]
    rows += [_answer(d, 0, "Tracheophyta", kingdom="Plantae"), _answer(d, 1, "Arthropoda")]
    rows += [_answer(e, 3, "Chordata", "Pollachius virens", kind="free_text")]
    got = _resolve(spark, rows)
    assert got[a].n_sources_found == 0 and got[a].flag.startswith("all sources rejected: A(Abramis grossa: genus differs by 2")
    assert got[b].phylum == "Arthropoda" and "corroborated" in got[b].flag and got[b].name_changed == "Euproktis minor"
    assert (got[c].matched_name, got[c].sources_found, got[c].phylum) == ("Astacus major", "A", "Arthropoda")
    assert got[d].taxonomy_source == "B" and got[d].sources_rejected == "A(Limnetis brevis: kingdom Plantae is not a microsporidian host)"
    assert got[e].flag.startswith("resolved from a common name") and got[e].phylum == "Chordata"


def test_nulls_repeats_and_empty_tables(spark):
    rows = [_answer("dog", 0, "Brachiopoda"), ("Daphnia magna", None, 0, 0, "A", None, None, None, *[None] * 7)] + [_answer("Apis mellifera", 0, "Arthropoda")] * 3
    got = _resolve(spark, rows)
    assert got["dog"].flag == "not a scientific name; not looked up" and got["dog"].phylum == ""
    assert (got["Daphnia magna"].n_sources_found, got["Daphnia magna"].phylum_agreement, got["Daphnia magna"].n_ranks) == (1, "", 0)
    assert got["Apis mellifera"].phylum_agreement == "1/1"
    assert resolve_hosts(spark.createDataFrame([], KIND)).collect() == []
