import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgeline.llm import language
from sedgeline.llm.language import LEAST, LONGEST, NEAR, Filters, fit_languages, grams, identify, words_of
from sedgeline.llm.queries import QUERIES


def _plain_grams(text):
    words, now = [], ""
    for ch in (text or "") + " ":
        if ch.isalpha():
            now += ch
        elif now:
            words.append(f"\0{now}\0")
            now = ""
    return [w[i : i + n] for w in words for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1) if w[i : i + n] != "\0"]


def _chunk(texts):
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    return np.frombuffer("".join(texts).encode(), np.uint8), off


def test_grams_are_those_of_plain_python():
    texts = ["", "né à", "12 !", "x", "", "中文字 ab", "ab", "é", "the the"]
    w = words_of(*_chunk(texts))
    of, h = (np.concatenate(x) for x in zip(*grams(w), strict=True))
    seen, names = defaultdict(Counter), defaultdict(Counter)
    for d, k, n in zip(w.doc.tolist(), w.word.tolist(), w.times.tolist(), strict=True):
        for g in h[of == k].tolist():
            seen[d][g] += n
    for d, t in enumerate(texts):
        names[d] = Counter(_plain_grams(t))
        assert Counter(seen[d].values()) == Counter(names[d].values()), t
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert len(set(seen[a]) & set(seen[b])) == len(set(names[a]) & set(names[b]))


def _docs():
    rng = np.random.default_rng(2)
    parts = {"aa": "ka lo mi", "bb": "sch tz en", "cc": "ão ção nh", "dd": "да не ст", "": "漢字 仮名 混"}
    rows = []
    for i in range(600):
        lang = [*parts][i % 5]
        own, other = parts[lang].split(), parts[[*parts][(i + 1) % 5]].split()
        text = " ".join("".join(rng.choice(own if rng.random() < 0.85 else other, rng.integers(1, 4))) for _ in range(rng.integers(3, 30)))
        rows.append((i, text.upper() if i % 9 == 0 else text, lang))
    return rows


def test_predictions_equal_those_of_exact_sets(spark):
    """Without a filter: sets of n-grams by the stated rates and plain counts."""
    rows = _docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learns = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    got = {r.doc_id: r.language for r in identify(df, fit_languages(df, learns)).collect()}
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    texts, seen = Counter(), defaultdict(Counter)
    for _, t, lang in train:
        for word in set(t.lower().split()):
            texts[lang] += 1
            for g in _plain_grams(word):
                seen[g][lang] += 1
    sets = {}
    for g, c in seen.items():
        rate = {k: n / texts[k] for k, n in c.items()}
        sets[g] = {k for k, x in rate.items() if x >= LEAST and x >= NEAR * max(rate.values())}
    right = same = held = 0
    for d, t, lang in rows:
        c = Counter(k for g in _plain_grams(t.lower()) for k in sets.get(g, ()))
        same += got[d].lang == min(c, key=lambda k: (-c[k], k))
        assert abs(got[d].score - max(c.values()) / sum(c.values())) < 0.05
        if zlib.crc32(str(d).encode()) % 4 == 2:
            held, right = held + 1, right + (got[d].lang == lang)
    assert same >= 0.99 * len(rows) and right >= 0.98 * held


def test_more_than_64_languages(spark):
    rows = [(i, f"{chr(0x4E00 + i % 70)}{chr(0x5E00 + i % 70)} a", f"l{i % 70:02d}") for i in range(280)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(df, fit_languages(df, F.lit(True))).collect()
    assert all(r.language.lang == r.lang for r in got)


def test_correction_for_false_hits():
    rng = np.random.default_rng(0)
    filled = (rng.random((1 << 12, 1)) < 0.5).astype(np.uint64)
    f = Filters(["x"], filled, np.array([filled.mean()]), 0)
    w = words_of(*_chunk([" ".join("".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 3)) for _ in range(3000))]))
    c, n = f.counts(w, 1)
    assert n[0] == 3000 * 12 and c[0, 0] < 0.02 * n[0]


def test_held_out_accuracy_of_the_query(spark):
    path = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op13_language_id"](spark, path).collect()}
    want = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{path}/documents.parquet'").fetchall())
    held = [d for d in want if zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(got) == len(want) and all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in want)
    assert np.mean([got[d].lang_pred == want[d] for d in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_defined_results(spark, monkeypatch):
    monkeypatch.setattr(language, "HELD", 50)
    monkeypatch.setattr(language, "PIECE", 16)
    kind = "doc_id long, text string, lang string, language string, score int"
    rows = [(i, "ab cd ef", "xx", "o", 1) for i in range(4)] * 2 + [(9, "gh ij", "yy", "o", 1), (10, None, "xx", "o", 1), (11, "12 ?", "xx", "o", 1), (12, "ωω", None, "o", 1), (None, "ab", "xx", "o", 1)]
    rows += [(13, "ab " * 400_000, "xx", "o", 1), (14, "g" * 700_000, None, "o", 1)]
    df = spark.createDataFrame(rows, kind)
    filters = fit_languages(df, F.col("doc_id").isNotNull())
    out = identify(df, filters)
    assert sorted(out.columns) == sorted(df.columns)
    got = {r.doc_id: (r.language.lang, r.language.score > 0.5) for r in out.collect()}
    assert got[0] == ("xx", True) and got[9] == ("yy", True) and got[13] == ("xx", True) and got[None] == ("xx", True)
    assert got[10] == got[11] == ("und", False) and got[12][0] == "xx"
    empty = spark.createDataFrame([], kind)
    assert identify(empty, filters).collect() == []
    none = fit_languages(empty, F.lit(True))
    assert {(r.language.lang, r.language.score) for r in identify(df, none).collect()} == {("und", 0.0)}


@pytest.mark.parametrize("n", [1, 3])
def test_ties_go_to_the_least_value(spark, n):
    df = spark.createDataFrame([(1, "ab", "zz"), (2, "ab", "mm")] * n, "doc_id long, text string, lang string")
    got = identify(df, fit_languages(df, F.lit(True))).collect()
    assert {(r.language.lang, r.language.score) for r in got} == {("mm", 0.5)}
