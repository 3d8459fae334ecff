import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgeline.llm.ngram_jaccard import ngram_jaccard_join, signatures


def _sets(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n, percent):
    sets = {i: _sets(t, n) for i, t in rows}
    least = {i: i for i in sets}
    ids = sorted(sets)

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                p, q = sorted((top(x), top(y)))
                least[q] = p
    return {i: (len(sets[i]), top(i)) for i in ids}


def texts(seed, n=90):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randrange(40))
    out, bases = [None, "", "  \n\t", "One", "one", "a b", "A  b", "ab"], [[word() for _ in range(k)] for k in (3, 5, 12, 40, 150, 400)]
    while len(out) < n:
        b = list(rng.choice(bases))
        for _ in range(rng.randrange(0, max(2, len(b) // 12))):
            b[rng.randrange(len(b))] = word()
        out.append((" " if rng.random() < 0.8 else "\n").join(b))
    return list(enumerate(out, start=3))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (3, 60)])
def test_against_brute_force(spark, n, percent):
    rows = texts(n * percent)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(df, n, percent).collect()}
    assert got == brute(rows, n, percent)


def test_signatures_cover_every_near_pair():
    rng = np.random.default_rng(5)
    for percent in (60, 80, 90):
        for size in (1, 3, 9, 10, 19, 20, 37, 90, 333, 1200):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            drop = int(size * (100 - percent) / (100 + percent))
            b = np.concatenate([a[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)])
            doc = np.repeat([0, 1], size)
            row, sig = signatures(doc, np.concatenate([a, b]), np.array([size, size]), percent)
            assert not drop or {*sig[row == 0]} & {*sig[row == 1]}


def test_empty_repeated_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard_join(none).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (2, "a b c"), (5, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_jaccard_join(df, 3, 90).collect())
    assert got == [(0, 1, 2), (2, 1, 2), (2, 1, 2), (5, 0, 5)]


def test_open_buckets_and_hot_signatures(spark, monkeypatch):
    """Every bucket that the first hubs leave open goes by its rarest shingles, and sampled signatures to several tasks."""
    from sedgeline.llm import ngram_jaccard as nj

    monkeypatch.setattr(nj, "OPEN", 1)
    monkeypatch.setattr(nj, "HOT", 1)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared, rows = [word() for _ in range(120)], []
    for _ in range(12):  # unlike texts of one passage, each with a near copy of its own
        own = shared + [word() for _ in range(50)]
        rows += [" ".join(own), " ".join([*own[:-1], word()])]
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == brute(rows, 3, 90)


def test_null_ids_link(spark):
    near = [(5, "a b c d e f g h i j k l m"), (None, "a b c d e f g h i j k l n"), (2, "a b c d e f g h i j k o n"), (None, "x y z")]
    got = ngram_jaccard_join(spark.createDataFrame(near, "doc_id long, text string"), 3, 60).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 2), (2, 2), (5, 2)]


def test_only_nodes_of_pairs_have_their_sets_written(spark, monkeypatch):
    from sedgeline.llm import ngram_jaccard as nj

    seen, save = {"sets": set(), "pairs": set()}, nj.Scratch.save

    def saved(self, df, name):
        out = save(self, df, name)
        if name == "pairs":
            seen[name] |= {x for r in out.collect() for x in (r.a, r.b)}
        if "set" in out.columns:
            seen["sets"] |= {r.node for r in out.collect()}
        return out

    monkeypatch.setattr(nj.Scratch, "save", saved)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [word() for _ in range(150)]
    rows = [" ".join(shared + [word() for _ in range(60)]) for _ in range(30)]  # these share signatures, and don't pass
    rows += [rows[0] + " one", rows[1] + " two"]
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == brute(rows, 3, 90)
    assert seen["sets"] and seen["sets"] == seen["pairs"]
