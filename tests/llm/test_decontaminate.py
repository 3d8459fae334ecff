import random
import re

import pytest
from pyspark.sql import functions as F

from sedgeline.llm import decontaminate as module
from sedgeline.llm.decontaminate import decontaminate, is_contaminated, without_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def brute(text, items):
    w = WORD.findall(low(text))
    hit, found = [False] * len(w), set()
    for i, t in items:
        x = WORD.findall(low(t))
        n = min(13, len(x))
        wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in wins:
                found.add(str(i))
                hit[k : k + n] = [True] * n
    return len(w), sum(hit), sorted(found)


def case():
    rng = random.Random(8)
    word = lambda: rng.choice("abcdéß7") + rng.choice("xyzXYZ")
    items = [(i, ", ".join(word() for _ in range(rng.choice([2, 5, 13, 14, 40])))) for i in range(12)] + [(50, None), (51, " !"), (52, "aX bY")]
    docs = [(0, None), (1, ""), (2, "..."), (3, "AX-by")]
    for i in range(4, 70):
        t = " ".join(word() for _ in range(rng.choice([3, 60, 400])))
        if i % 2:
            part = rng.choice(items)[1] or ""
            t = t[: len(t) // 2] + " " + part.upper().replace("É", "é").replace("SS", "ß") + "\n" + t[len(t) // 2 :]
        docs.append((i, t))
    return docs, items


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(module, "BLOCK_WINDOWS", most)
    docs, items = case()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1))
    b = spark.createDataFrame(items + items[:3], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate(d, b).withColumn("rest", without_spans()).withColumn("bad", is_contaminated()).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        c = got[i].contamination
        n, hit, found = brute(t, items)
        assert (c.n_words, c.n_hit, list(c["items"])) == (n, hit, found)
        assert got[i].bad == (hit > 0 and 20 * hit >= n)
        if t:
            assert len(WORD.findall(low(got[i].rest))) == n - hit
            assert sum(s.end - s.start for s in c.spans) == len(t) - len(got[i].rest)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).first().contamination.n_hit == 0
    assert decontaminate(docs.limit(0), none).count() == 0


def test_blocks_are_written_one_by_one(spark, monkeypatch):
    """No job holds the tables of several blocks: what is returned scans none of them again."""
    monkeypatch.setattr(module, "BLOCK_WINDOWS", 40)
    docs, items = case()
    out = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert "MapInArrow" not in out._jdf.queryExecution().toString()
    assert out.count() == len(docs)
