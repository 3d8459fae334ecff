"""Identities of all pairs of a label, in one block and in several, against plain loops."""

import math
import random

import pytest

from sedgeline.operators import identity


@pytest.mark.parametrize(("block", "tile"), [(16_384, 1_024), (9, 4)])
def test_against_all_pairs(spark, monkeypatch, block, tile):
    monkeypatch.setattr(identity, "BLOCK", block)
    monkeypatch.setattr(identity, "TILE", tile)
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.gauss(0.5, 1) for _ in range(4)]) for i in range(60)]
    rows += [(60, 0, None), (61, 0, [1.0, None, 2.0, 0.0]), (62, 0, [1.0, 2.0]), (5, 2, [1.0, 0.0, 0.0, 0.0]), (None, 1, [1.0] * 4), (63, None, [1.0] * 4), (64, 7, [1.0] * 4)]
    rows += [(70, 8, [1.0, 2.0, 2.0, 0.0]), (71, 8, [math.nan, 1.0, 1.0, 1.0]), (72, 8, [2.0, 4.0, 4.0, 0.0])]
    rows += [(80, 9, [9.0, 0.0, 0.0, 0.0]), (81, 9, [9.0, math.sqrt(100 - 81), 0.0, 0.0])]  # at the limit
    got = {r.label: (r.n_pairs, r.mean, r.lo, r.hi, r.under_90) for r in identity.pair_identity(spark.createDataFrame(rows, "vec_id long, label int, v array<double>"), "label", "vec_id", "v").collect()}
    want = {}
    for i, x, v in rows:
        for j, y, w in rows:
            if x is None or x != y or i is None or j is None or i >= j:
                continue
            ok = v and w and len(v) == len(w) and None not in v + w
            norm = lambda u: math.sqrt(sum(c * c for c in u))
            want.setdefault(x, []).append(sum(a * b for a, b in zip(v, w, strict=True)) / norm(v) / norm(w) * 100 if ok else None)
    assert set(got) == set(want)
    for x, every in want.items():
        s = [c for c in every if c is not None]
        good = [c for c in s if c == c]
        n, mean, lo, hi, under = got[x]
        assert (n, under) == (len(every), sum(c < 90 for c in good))
        assert lo == pytest.approx(min(good), abs=2e-3)
        if len(good) < len(s):
            assert math.isnan(mean) and math.isnan(hi)
        else:
            assert (mean, hi) == (pytest.approx(sum(s) / len(s), abs=2e-3), pytest.approx(max(good), abs=2e-3))


def test_no_join_makes_the_pairs(spark):
    from sedgeline.catalog import QUERIES

    plan = QUERIES["pair_identity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "vec_id" in plan and not [x for x in plan.splitlines() if "Join" in x and "<" in x]
