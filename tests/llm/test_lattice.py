import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from sedgeline.llm.lattice import Pieces, marginals, score_texts  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _pieces():
    spelt = [b"\x01", b"\x01a", b"a", b"b", b"ab", b"ba", b"aba", b"\x01ab", b"a"]
    return spelt, Pieces(spelt, np.log(np.full(len(spelt), 1 / len(spelt))))


def _every(word, table):
    """All ways to spell a word, by brute force: (probability, pieces)."""
    if not word:
        yield 1.0, ()
    for p, q in table.items():
        if word.startswith(p):
            for r, rest in _every(word[len(p) :], table):
                yield q * r, (p, *rest)


def test_marginals_and_expected_counts():
    spelt, pieces = _pieces()
    table = Counter()
    for p in spelt:
        table[p] += 1 / len(spelt)
    rng = random.Random(0)
    raw = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 9))) for _ in range(40)] + [b"ab" * 5]
    counts = np.zeros(len(pieces.hash))
    got = marginals(pieces, raw, np.full(len(raw), 2.0), counts)
    want = Counter()
    for w, g in zip(raw, got, strict=True):
        ways = list(_every(b"\x01" + w, table))
        z = sum(p for p, _ in ways)
        assert math.isclose(g, math.log(z), rel_tol=1e-9)
        for p, used in ways:
            for u in used:
                want[u] += 2 * p / z
    for p, i in zip(spelt, pieces.of, strict=True):
        assert math.isclose(counts[i], want[p], rel_tol=1e-9)


def test_long_words_agree_with_short_ones():
    _, pieces = _pieces()
    word = b"ab" * 30
    a, b = np.zeros(len(pieces.hash)), np.zeros(len(pieces.hash))
    one = marginals(pieces, [word], np.ones(1), a)
    from sedgeline.llm import lattice

    two = lattice._long(pieces, lattice._START + word, 1.0, b)
    assert math.isclose(one[0], two) and np.allclose(a, b)


def _low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("frequent", [1 << 18, 3])
def test_base_against_brute_force_and_model_beats_nothing_seen(spark, frequent):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("aeioustrnß") for _ in range(rng.randrange(1, 8))) for _ in range(120)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "Zq " * 3000)] + [(i, rng.choice(" \n\t").join(rng.choice(vocab).title() if rng.random() < 0.2 else rng.choice(vocab) for _ in range(rng.randrange(1, 60)))) for i in range(4, 150)]
    trains = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3)
    out = score_texts(df, PATH, trains, frequent=frequent).collect()
    assert len(out) == len(rows) + 1
    got = {r.doc_id: r for r in out}
    import zlib

    train = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", _low(t)), None] for i, t in rows}
    c = Counter(x for i, _ in rows + rows[:1] if train[i] for x in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, _ in rows:
        r = got[i]
        assert (r.trained, r.n_tokens, r.n_known, r.train_tokens) == (train[i], len(tokens[i]), sum(c[x] > 0 for x in tokens[i]), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens[i]), rel_tol=1e-9)
        assert r.score < 0
    words = [r for r in out if r.n_tokens > 5 and not r.trained]
    assert sum(r.score for r in words) / sum(r.n_tokens for r in words) > -6


def test_no_training_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    [r] = score_texts(df, PATH, F.lit(None).cast("boolean")).collect()
    assert r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0.0 and math.isfinite(r.score)
    assert score_texts(df.limit(0), PATH, F.lit(True)).count() == 0
