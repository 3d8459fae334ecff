import hashlib
import random
from collections import Counter

import pytest

from sedgeline.llm.substrings import remove_repeats


def brute(texts, size):
    raw = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + size] for r in raw for i in range(len(r) - size + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - size + 1):
            if n[r[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        left = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß ") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (33, 40, 60, 120, 300)]
    out = [None, "", "short", "a" * 199, "a" * 200, "a" * 460, "ab" * 300, "x" + "ab" * 300, "abc" * 70]
    for i in range(70):
        t = prose(rng.choice([5, 60, 200]))
        for _ in range(i % 4):
            s = rng.choice(shared)
            cut = rng.randrange(len(s) // 3)
            t = t[: rng.randrange(len(t) + 1)] + s[cut : len(s) - rng.randrange(len(s) // 4)] + prose(rng.choice([1, 40]))
        out.append(t)
    near = prose(150)
    out += [near[:k] + "#" + near[k:] for k in (100, 250, 251, 400, 640)]
    return out + out[20:26] + [out[30]] * 9


@pytest.mark.parametrize(("block", "split"), [(1 << 18, 1 << 22), (2500, 2500), (900, 5000)])
def test_against_brute_force(spark, block, split):
    t = texts(block)
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, block=block, split=split).collect()}
    want = brute(t, 200)
    assert len(got) == len(t)
    for i, w in enumerate(want):
        assert got[i] == w, (i, t[i])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).count() == 0


def test_null_repeated_and_clashing(spark, monkeypatch):
    from sedgeline.llm import substrings

    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = prose(400)
    t = [shared + prose(300), prose(300) + shared, prose(500), None]
    ids = [None, 1, 2, 2]
    for most in (1_000, 1):  # then every gram is dealt to several tasks
        monkeypatch.setattr(substrings, "TASK_CONTEXTS", most)
        df = spark.createDataFrame([(i, x, "clash", 0) for i, x in zip(ids, t, strict=True)], "doc_id long, text string, h string, spans int")
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect())
        assert got == Counter((i, *w) for i, w in zip(ids, brute(t, 200), strict=True))
    twice = spark.createDataFrame([(1, t[0]), (1, t[0])], "doc_id long, text string")
    assert [(r.n_removed, r.n_spans) for r in remove_repeats(twice).collect()] == [(700, 1)] * 2


def test_windows_dealt_to_tasks(spark, monkeypatch):
    from sedgeline.llm import substrings

    monkeypatch.setattr(substrings, "TASK_CONTEXTS", 2)
    t = texts(7)
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, split=1500).collect()}
    assert [got[i] for i in range(len(t))] == brute(t, 200)


def test_bytes_decide_where_hashes_meet(monkeypatch):
    import numpy as np

    from sedgeline.llm import substrings

    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 900, dtype=np.uint8)
    data[600:850] = data[:250]
    off = np.array([0, 300, 900])
    want = substrings.repeated(data, off, 200)
    real = substrings.span_hash
    monkeypatch.setattr(substrings, "span_hash", lambda d, s, e, *a: real(d, s, e, *a) % np.uint64(40) if len(s) and e[0] - s[0] == 200 else real(d, s, e, *a))
    assert want.sum() == 102 and (substrings.repeated(data, off, 200) == want).all()


def test_a_dealt_block_gives_each_window_once():
    """Windows that a block repeats leave it once, so that many near copies don't meet as all of their windows."""
    import numpy as np
    import pyarrow as pa

    from sedgeline.llm.substrings import _blocks, _met

    rng = np.random.default_rng(4)
    same = rng.integers(97, 123, 260, dtype=np.uint8).tobytes()
    raw = [same[i:] + bytes([i]) * 3 for i in range(9)]
    for deal, gives in ((0, True), (-1, False)):
        batch = pa.RecordBatch.from_arrays([pa.array([7] * 9, pa.int64()), pa.array([deal] * 9, pa.int64()), pa.array(range(9), pa.int64()), pa.array(raw, pa.binary())], ["h", "deal", "c", "bytes"])
        rows = [r for b in _blocks(200, 1 << 18, 1 << 22)([batch]) for r in b.to_pylist()]
        windows = {r[i : i + 200] for r in raw for i in range(len(r) - 199)}
        told = np.frombuffer(b"".join(r.get("windows") or b"" for r in rows), dtype=np.int64).reshape(-1, 3).tolist()
        own = lambda c, first: raw[c][max(first, -1 - first) :][:200]
        assert (len(told), {own(c, first) for _, c, first in told}) == (len(windows), windows) if gives else not told
        marked = {raw[r["c"]][i : i + 200] for r in rows if r["c"] is not None for i in range(r["first"], r["last"] + 1)}
        assert marked == {w for w in windows if sum(w in r for r in raw) > 1}
        assert {own(c, first) for _, c, first in told if first < 0} == (marked if gives else set())
        # a second block with one of the windows that are single here
        single = next(r for r in told if r[2] >= 0) if gives else None
        if single:
            parts = [np.array(told).tobytes(), np.array([[single[0], 99, -1]]).tobytes()]
            got = next(_met([pa.RecordBatch.from_arrays([pa.array([7, 7]), pa.array([0, 0]), pa.array(parts)], ["h", "piece", "windows"])])).to_pylist()
            assert got == [{"h": 7, "c": single[1], "first": single[2], "last": single[2]}]
