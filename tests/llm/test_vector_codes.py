import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgeline.llm.queries import QUERIES
from sedgeline.llm.vector_codes import VantageTree, bound, decode, encode, fit_codebooks, integers, label_errors, root_down, root_up, squared


def _plain_code(rows, parts=4, entries=256, rounds=4):
    """The contract's words in plain Python over (id, integer vector)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(rows[0][1])
    cut = [(p * d // parts, (p + 1) * d // parts) for p in range(parts)]
    books = [[v[a:b] for _, v in rows[:entries]] for a, b in cut]

    def near(v, book):
        return min((sum((x - y) ** 2 for x, y in zip(v, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            groups = {}
            for _, v in rows:
                groups.setdefault(near(v[a:b], books[p])[1], []).append(v[a:b])
            for i, g in groups.items():
                books[p][i] = [math.floor(sum(c) / 1) // len(g) for c in zip(*g, strict=True)]
    out = []
    for vec_id, v in rows:
        got = [near(v[a:b], books[p]) for p, (a, b) in enumerate(cut)]
        out.append((vec_id, "".join(f"{i:02x}" for _, i in got), sum(e for e, _ in got)))
    return out, books


@pytest.mark.parametrize("seed,spread,m", [(0, 1000, 16), (1, 3, 2), (2, 0, 4), (3, 1 << 26, 16), (4, 50, 1)])
def test_tree_equals_all_distances(seed, spread, m):
    rng = np.random.default_rng(seed)
    e, q = (rng.integers(-spread, spread + 1, (n, m)) for n in (256, 700))
    q[:256] = e
    d = ((q[:, None, :] - e) ** 2).sum(2)
    assert np.array_equal(squared(q, e), d)
    index, best = VantageTree(e).nearest(q)
    assert np.array_equal(index, d.argmin(1)) and np.array_equal(best, d.min(1))


def test_roots_are_rounded_outwards():
    d = np.array([0, 1, 2, 3, 4, 8, 9, 10, (1 << 31) ** 2 - 1, (1 << 31) ** 2, 2**62 - 1])
    assert root_down(d).tolist() == [math.isqrt(x) for x in d.tolist()]
    assert root_up(d).tolist() == [math.isqrt(x - 1) + 1 if x else 0 for x in d.tolist()]


def test_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(420):
        v = [float(np.float32(x)) for x in rng.normal(0, 0.1, 8)]
        rows.append((i, v if i % 7 else [0.25] * 8, None if i % 5 == 0 else int(rng.integers(0, 3)), "x"))
    rows += [(1000, None, 1, "x"), (1001, [0.1] * 7 + [None], 1, "x"), (1002, [0.1] * 7 + [float("nan")], 1, "x"), (1003, [float("-inf")] + [0.1] * 7, 1, "x")]
    rows += [(1004, [0.1] * 7, 1, "x"), rows[3], rows[3], (None, [0.5] * 8, 2, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, error string")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op11_vector_codes"](spark, str(tmp_path)).collect()
    good = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab, _ in rows if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    want, books = _plain_code([r[:2] for r in good])
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=repr) == sorted(want, key=repr)
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}
    label_of = {}
    for (i, _, lab) in good:
        label_of.setdefault(i, lab)
    error = {}
    for i, _, e in want:
        error[label_of[i]] = error.get(label_of[i], 0) + e
    assert all(r.label_error == error[label_of[r.vec_id]] for r in got)


def test_round_trip_and_columns(spark):
    df = spark.createDataFrame([(i, [i / 8.0, 1.0, -i / 4.0, 0.0, 0.5], "e") for i in range(20)], "vec_id long, embedding array<double>, error string")
    books = fit_codebooks(df, entries=32, rounds=0)
    out = decode(encode(df, books), books)
    assert out.columns == ["vec_id", "embedding", "error", "vector_code", "vector"]
    for r in out.collect():  # as many entries as rows: nothing is lost
        assert r.vector == integers(np.array([r.embedding]))[0].tolist() and r.vector_code.error == 0


def test_small_and_empty_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 0)], [(1, [], 0)]):
        df = spark.createDataFrame(rows, kind)
        books = fit_codebooks(df)
        got = label_errors(encode(df, books).select("vec_id", "label", "vector_code.*")).collect()
        assert [(r.code, r.error, r.label_error) for r in got] == [("00000000", 0, 0)] * (rows == [(1, [], 0)])
    huge = spark.createDataFrame([(1, [3e38, -3e38], 0), (2, [0.0, 0.0], 0)], kind)
    books = fit_codebooks(huge, entries=1, rounds=0)
    most = bound(2)
    assert [r.e for r in encode(huge, books).select(F.col("vector_code.error").alias("e")).collect()] == [0, 2 * most * most]
