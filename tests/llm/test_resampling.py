import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from sedgeline.llm.queries import QUERIES
from sedgeline.llm.resampling import crc32_spans, features, ranked, resample
from sedgeline.scratch import Scratch

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER, DOWN = bytes(range(65, 91)), bytes(range(97, 123))


def _words(text):
    return WORD.findall((text or "").encode().translate(bytes.maketrans(UPPER, DOWN)))


def _plain(docs, bench, run=1, buckets=10_000, least=20, share=(10, 100)):
    """The contract's words in plain Python; rows of doc_id and text."""

    def grams(text):
        w = _words(text)
        return [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, run + 1) for i in range(len(w) - n + 1)]

    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for _, x in docs:
        np.add.at(s, grams(x), 1)
    for x in bench:
        np.add.at(t, grams(x), 1)
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + buckets) / ((int(a) + 1) * (int(t.sum()) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for d, x in docs:
        g = grams(x)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in g)
        out.append([d, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_words(x))])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: len(able) * share[0] // share[1]])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def test_crc_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 300)
    end = start + np.where(rng.random(300) < 0.1, rng.integers(49, 900, 300), rng.integers(0, 49, 300))
    assert crc32_spans(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]


@pytest.mark.parametrize("run", [1, 3])
def test_features_of_rows(run):
    texts = ["One, TWO three-four", "", "é1 x", "lone", "a b"]
    data = "".join(texts).encode()
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    doc, bucket, n = features(np.frombuffer(data, np.uint8), off, run)
    want = sorted((d, zlib.crc32(b" ".join(w[i : i + k])) % 10_000) for d, w in enumerate(map(_words, texts)) for k in range(1, run + 1) for i in range(len(w) - k + 1))
    assert sorted(zip(doc.tolist(), bucket.tolist(), strict=True)) == want and n.tolist() == [4, 0, 2, 1, 2]


def _rows(rng, n=400):
    words = ["the", "of", "Sinter", "öl", "x1", "and", "kiln", "ember", "vale"]
    return [(i, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(n)]


def test_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    docs = [*_rows(rng), (900, None), (901, ""), (902, "!!! ??"), (None, "the kiln " * 30), (903, "ember " * 200_000), (904, "z" * 300_000)]
    bench = ["kiln ember vale " * 4, None, "öl"]
    spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id long, text string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = QUERIES["op12_importance_resampling"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(_plain(docs, bench), key=repr)


def test_longer_runs_and_fewer_buckets(spark):
    docs, bench = _rows(np.random.default_rng(4), 120), ["kiln ember vale kiln"]
    got = resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in bench], "text string"), run=2, buckets=64, least_words=5, share=(1, 3))
    assert sorted(map(tuple, got.collect())) == sorted(_plain(docs, bench, 2, 64, 5, (1, 3)))


@pytest.mark.parametrize("draw", [0, 1, 40, 299, 300, 301, 5000])
def test_ranks_where_a_third_of_all_rows_share_a_score(spark, draw):
    rng = np.random.default_rng(draw)
    rows = [(i, 7 if i % 3 == 0 else int(rng.integers(0, 40)), "r") for i in rng.permutation(900).tolist()]
    scratch = Scratch(spark, "test")
    saved = scratch.save(spark.createDataFrame(rows, "doc_id long, score long, _range string").repartition(7), "rows")
    got = {r.doc_id: r["rank"] for r in ranked(saved, draw, scratch).collect()}
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert len(got) == 900 and got == {r[0]: i + 1 if i < draw else None for i, r in enumerate(want)}


def test_repeated_rows_and_empty_tables(spark):
    kind = "doc_id long, text string, rank int"
    text = "a b c d e f g h i j k l m n o p q r s t"
    target = spark.createDataFrame([], "text string")
    got = resample(spark.createDataFrame([(1, text, 5)] * 20 + [(2, "a", 5)], kind), target, share=(1, 2)).collect()
    assert sorted(r["rank"] or 0 for r in got) == [0] * 11 + list(range(1, 11)) and len(got) == 21
    assert resample(spark.createDataFrame([], kind), target).collect() == []
