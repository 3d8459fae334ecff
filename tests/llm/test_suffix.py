import numpy as np

from sedgeline.llm.suffix import suffix_array


def test_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n, k = int(rng.integers(0, 60)), int(rng.integers(1, 6))
        s = rng.integers(0, k, n)
        want = sorted(range(n), key=lambda i: s[i:].tolist())  # noqa: B023
        assert suffix_array(s).tolist() == want


def test_runs_and_periods():
    for s in (np.zeros(500, int), np.tile([1, 0], 200), np.tile([0, 1, 1], 150), np.arange(300), np.arange(300)[::-1]):
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())  # noqa: B023
        assert suffix_array(s).tolist() == want
