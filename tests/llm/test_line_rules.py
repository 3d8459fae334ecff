import itertools
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sedgeline.llm.line_rules import N_BINS, Field, apply_rules, base_failed, fit_rules, is_kept, train_field

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = [False] * len(w)
    for i in range(len(w) - 7):
        if wins[tuple(w[i : i + 8])] > 1:
            rep[i : i + 8] = [True] * 8
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(rep)


def test_fixed_rules_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(0, None), (1, ""), (2, "\n\n \n"), (3, "a b\na b\n a b\na b "), (4, "A b\na b"), (5, "é\x0b|| <\r\né"), (6, "w " * 9000)]
    for i in range(7, 120):
        lines = [" ".join(rng.choice("ab é# cß |") for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(1, 30))]
        rows.append((i, rng.choice(["\n", "\r\n"]).join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rules", F.lit("gone"))
    field = Field(np.array([[0.0], [1.0]]).repeat(N_BINS, 1), np.zeros((2, 2)))
    got = {r.doc_id: r for r in apply_rules(df, field).withColumn("bad", base_failed()).withColumn("kept", is_kept()).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r, want = got[i].rules, brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, t)
        assert got[i].bad == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and got[i].kept == (not got[i].bad)
    assert apply_rules(df.limit(0), field).count() == 0


def test_viterbi_against_all_sequences():
    rng = np.random.default_rng(0)
    field = Field(np.zeros((2, N_BINS)), rng.normal(size=(2, 2)))
    sizes = [3, 0, 1, 6, 6, 2]
    doc = np.repeat(np.arange(6), sizes)
    scores = rng.normal(size=(len(doc), 2))
    got = field.decode(scores, doc, 6)
    for d in range(6):
        own = scores[doc == d]
        total = lambda y: sum(own[i, a] for i, a in enumerate(y)) + sum(field.step[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(own)), key=total)
        assert tuple(got[doc == d]) == best


def test_field_learns_chains():
    rng = np.random.default_rng(1)
    label = np.repeat(rng.integers(0, 2, 300), 5)
    bins = np.where(rng.random((1500, 1)) < 0.8, label[:, None], 1 - label[:, None]).repeat(11, 1)
    field = train_field(bins, label, np.arange(1500) // 50)
    alone = (bins[:, 0] == label).mean()  # what lines tell without their neighbours
    assert field.step[0, 0] > field.step[0, 1] and (field.decode(field.scores(bins), np.arange(1500) // 50, 30) == label).mean() > alone + 0.02


def test_keeps_prose_and_drops_junk(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(200):
        lines = [" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(6)]
        if i % 2:
            lines = [lines[0], *(x.upper().replace(" ", " | ") + "!!" for x in lines[1:])]
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(100)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in apply_rules(docs, fit_rules(docs, labels)).select("doc_id", is_kept().alias("kept")).collect()}
    assert all(got[i] == (i % 2 == 0) for i in range(200))
    clash = docs.union(docs).union(spark.createDataFrame([(None, "x"), (777, None), (778, "")], docs.schema)).withColumn("rules", F.lit("clash"))
    again = apply_rules(clash, fit_rules(clash, labels.union(labels), lines=600)).select("doc_id", "rules.n_words", is_kept().alias("kept")).collect()
    assert len(again) == 403 and all(r.kept == (r.doc_id % 2 == 0) for r in again if r.doc_id is not None and r.doc_id < 200)
    assert {(r.n_words, r.kept) for r in again if r.doc_id in (777, 778)} == {(0, False)}
    none = fit_rules(docs, labels.limit(0))
    assert apply_rules(docs, none).where(is_kept()).count() == 200
