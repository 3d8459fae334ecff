import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sedgeline.llm.style import style_chunks
from sedgeline.llm.quality import Model, Sums, bin_edges, crc_mod, fit_quality, least_share, score_quality, sums


def _rows():
    rng = np.random.default_rng(4)
    words = np.array(["river", "stone", "lamp", "quiet", "table", "under", "seven", "moss", "glass", "north"])
    out = []
    for i in range(600):
        w = rng.choice(words, rng.integers(20, 90))
        good = i % 4 > 0
        out.append((i, " ".join(w).capitalize() + "." if good else " | ".join(w).upper() + "!!", int(good)))
    return out


def test_held_out_accuracy_without_negatives(spark):
    rows = _rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 3] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = fit_quality(docs, labels, crc_mod("doc_id", 5) != 0)
    got = {r.doc_id: r.quality_score.score for r in score_quality(docs, model).collect()}
    assert len(got) == 602 and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.3) == bool(q) for i, _, q in rows]
    assert np.mean(right) > 0.97


def test_risk_and_gradient_against_brute_force():
    rng = np.random.default_rng(0)
    x, positive, prior = rng.normal(0, 1, (300, 3)), rng.random(300) < 0.3, 0.6
    model = Model([bin_edges(np.sort(c), np.ones(300, dtype=int)) for c in x.T], np.zeros(0), prior)
    cols = model.columns(x)
    n = sum(len(e) + 1 for e in model.edges) + 1

    def risk(w):
        """One text after the other, from the definition."""
        g = [sum(w[c] for c in row) + w[-1] for row in cols]
        loss = lambda v: np.log(1 + np.exp(-v))
        p = [v for v, y in zip(g, positive, strict=True) if y]
        part = np.mean([loss(-v) for v in g]) - prior * np.mean([loss(-v) for v in p])
        return prior * np.mean([loss(v) for v in p]) + part, part

    for _ in range(3):
        w = rng.normal(0, 1, n)
        s = Sums.of(sums(cols, positive, w))
        assert abs(s.negative(prior) - risk(w)[1]) < 1e-9
        grad, part = s.grad_u / s.n_u - prior * s.x_p / s.n_p, s.grad_u / s.n_u - prior * s.grad_p / s.n_p
        for i in range(n):
            e = np.zeros(n)
            e[i] = 1e-5
            (a, pa), (b, pb) = risk(w + e), risk(w - e)
            assert abs((a - b) / 2e-5 - grad[i]) < 1e-5 and abs((pa - pb) / 2e-5 - part[i]) < 1e-5
    halves = [Sums.of(sums(cols[h], positive[h], w)) for h in (slice(0, 100), slice(100, 300))]
    assert abs(sum(h.loss_u for h in halves) - s.loss_u) < 1e-9


def test_prior_of_positives_and_unlabelled_texts():
    rng = np.random.default_rng(1)
    cell = lambda p, n: np.bincount(np.clip(rng.normal(p, 60, n), 0, 999).astype(int), minlength=1000)
    for prior in (0.3, 0.6, 0.9):
        assert abs(least_share(cell(700, int(40_000 * prior)) + cell(200, int(40_000 * (1 - prior))), cell(700, 20_000)) - prior) < 0.04
    assert 0 < least_share(np.zeros(5), np.zeros(5)) < 1


def test_no_positives_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = fit_quality(docs, labels, F.lit(True))
    assert score_quality(docs, model).first().quality_score.score > 0.5
    assert score_quality(docs.limit(0), model).count() == 0
    assert fit_quality(docs.limit(0), labels, F.lit(True)).prior == 1.0
    same = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    assert score_quality(docs, fit_quality(docs, same, F.lit(True))).count() == 4


def test_scores_are_those_of_the_bins_that_were_fitted(spark):
    """Values at rounded edges, such as 0.01 and 0.7, have one side only."""
    path = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels, crc_mod("doc_id", 5) != 0)
    got = {r.doc_id: r.quality_score.score for r in score_quality(docs, model).collect()}
    texts = docs.select("doc_id", "text").toPandas()
    for x, rows in zip(style_chunks(pa.array(texts.text)), [texts.doc_id.to_numpy()], strict=True):
        bins = model.columns(x.astype(np.float32).astype(float))
        g = model.weight[bins].sum(1) + model.weight[-1]
        assert np.allclose([got[i] for i in rows], 1 / (1 + np.exp(-g)), atol=1e-6)
