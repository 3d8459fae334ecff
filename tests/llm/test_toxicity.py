import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgeline.llm.toxicity import Index, fit_toxicity, isotonic, score_toxicity


def _index(rng, n=700, m=40):
    rows, t = np.nonzero(rng.random((n, m)) < 0.08)
    tf = rng.integers(1, 5, len(rows)).astype(float)
    idf = rng.random(m) + 1
    return Index.build(np.arange(m, dtype=np.uint64), idf, np.arange(n), rng.integers(0, 2, n), np.ones(n), rows, t, tf), rows, t, tf


@pytest.mark.parametrize("seed", range(3))
def test_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    ix, rows, t, tf = _index(rng)
    dense = np.zeros((700, 40))
    dense[rows, t] = (1 + np.log(tf)) * ix.idf[t]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    for _ in range(50):
        own = np.sort(rng.choice(40, rng.integers(1, 9), replace=False))
        q = Index.vector(ix.idf, own, rng.integers(1, 4, len(own)).astype(float))
        near, cosine = ix.nearest(own, q, 10)
        every = dense[:, own] @ q
        assert np.allclose(np.sort(every[every > 0])[::-1][:10], cosine)
        assert np.allclose(every[near], cosine)


def test_isotonic_steps_never_fall():
    x, v = isotonic(np.array([0.1, 0.2, 0.2, 0.5, 0.9]), np.array([0.0, 1, 0, 0, 1]), np.ones(5))
    assert (np.diff(v) >= 0).all() and (np.diff(x) >= 0).all() and v[-1] == 1


def test_held_out_and_edge_cases(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}x" for i in range(80)]
    rows = []
    for i in range(900):
        w = list(rng.choice(words, 40))
        bad = i % 7 == 0
        if bad:
            w[5] = str(rng.choice(["vilest", "brutish", "grimly-foo"]))
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "Vilest " * 4000)], "doc_id long, text string").withColumn("id", F.lit("x"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    index = fit_toxicity(docs, labels, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r.toxicity for r in score_toxicity(docs, index).collect()}
    assert len(got) == 903
    assert np.mean([(got[i].score >= 0.3) == bool(y) for i, _, y in rows if i % 4 == 2]) > 0.98
    assert got[1000].score < 0.3 and not got[1001].neighbours and got[1002].score > 0.5
    assert all(x.toxic == 1 for x in got[1002].neighbours)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    index = fit_toxicity(docs, labels, F.lit(True))
    assert 0 <= score_toxicity(docs, index).first().toxicity.score <= 1
    assert score_toxicity(docs.limit(0), index).count() == 0


@pytest.mark.parametrize("frequent", [1 << 18, 5])
def test_cosine_is_over_all_words(spark, frequent):
    """Words of a single example count, and words of no example count in the norm, also those joined by shuffle."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice([f"w{j}" for j in range(30)], 12)) + f" {i}own", int(i % 4 == 0)) for i in range(60)]
    asked = [(100, "8own w1 w2 zz1 zz2 zz2"), (101, "w3 w3 w4 zz1 zz3"), (102, "8own w1 w2 zz1 zz2 zz2"), (103, "zz4 zz5")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + asked, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    texts = {i: t.split() for i, t, *_ in rows + asked}
    texts = {i: [x for w in t for x in ((w[:4], w[:6]) if len(w) > 4 else (w,))] for i, t in texts.items()}
    df = {w: sum(w in t for t in texts.values()) for t in texts.values() for w in t}
    v = {i: {w: (1 + np.log(t.count(w))) * (1 + np.log((1 + len(texts)) / (1 + df[w]))) for w in t} for i, t in texts.items()}
    norm = {i: np.sqrt(sum(x * x for x in a.values())) for i, a in v.items()}
    index = fit_toxicity(docs, labels, F.lit(True), k=5, frequent=frequent)
    # votes and their calibration, from the dense vectors of the examples
    toxic, votes = np.array([y for *_, y in rows]), []
    for i, *_ in rows:
        near = sorted(((sum(x * v[j].get(w, 0) for w, x in v[i].items()) / norm[i] / norm[j], -list(index.ids).index(j), y) for j, _, y in rows if j != i), reverse=True)[:5]
        votes.append(sum(y / (1.05 - c) ** 4 for c, _, y in near) / sum(1 / (1.05 - c) ** 4 for c, _, y in near))
    steps = isotonic(np.array(votes), toxic.astype(float), np.ones(60))
    assert np.allclose(np.interp(votes, *steps), np.interp(votes, *index.steps))
    got = {r.doc_id: r.toxicity.neighbours for r in score_toxicity(docs, index, k=5).collect()}
    assert got[100][0].id == 8 and not got[103]
    for i, _ in asked:
        want = sorted((sum(x * v[j].get(w, 0) for w, x in v[i].items()) / norm[i] / norm[j] for j, *_ in rows), reverse=True)
        assert np.allclose([n.cosine for n in got[i]], [x for x in want if x > 0][:5])
