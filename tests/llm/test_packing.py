import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from sedgeline.llm.packing import GRID, UNITS, WINDOW, nnls, pack, plan  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, pieces):
    """Every id lies in one piece, checksums fit, and offsets leave no gap; returns the padding."""
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    assert set(by) == {i for i, _ in rows}
    for i, text in rows:
        ids, at = whole(text), 0
        for p in sorted(by[i], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    pad = 0
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= WINDOW
        pad += 0 if at & (at - 1) == 0 else WINDOW - at
    return pad


def test_whole_ids_and_no_gap(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéßñÅ'0,.-<|") for _ in range(rng.randrange(1, 9)))
    rows = [(0, None), (1, ""), (2, " \n "), (3, "a <|endoftext|> b<|STARTOFTEXT|>x y Z é ́ İ don't"), (4, "x " * 7000)]
    rows += [(i, "".join(word() + rng.choice(" \n\t") for _ in range(rng.choice([1, 30, 300, 1500])))) for i in range(5, 120)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH).collect()
    assert check(rows, got) < WINDOW


def test_empty_and_repeated(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = pack(df, PATH).collect()
    assert [(p.length, p.doc_tokens) for p in got] and sum(p.length for p in got) == 8


def test_plan_uses_what_is_there_and_fills_windows():
    rng = np.random.default_rng(1)
    for hist in (rng.integers(0, 5000, UNITS - 1), np.eye(UNITS - 1, dtype=int)[22] * 900, np.zeros(UNITS - 1, int)):
        ways, repeats = plan(hist)
        if len(ways):
            assert ((ways * np.arange(1, UNITS)).sum(1) == UNITS).all()
            assert (repeats @ ways <= hist).all()
    assert GRID * UNITS == WINDOW


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(12, 30)), rng.normal(size=12)
    x = nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope < 1e-6).all() and np.allclose(slope[x > 0], 0, atol=1e-6)
