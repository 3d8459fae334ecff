"""Pairs with enough letters in common against the usual table, cell by cell."""

import random

import pytest

from sedgeline.operators.prefixes import Prefixes


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("cutoff", [0.0, 0.5, 0.8, 0.9, 1.0])
@pytest.mark.parametrize("seed", range(4))
def test_pairs_equal_the_table(cutoff, seed):
    r = random.Random(seed)
    letters, start = ("ab", "abcdeé")[seed % 2], (0, 3, 9)[seed % 3]
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(0, 14)))
    words, asked = sorted({word() for _ in range(150)}), [word() for _ in range(40)]
    got = zip(*(v.tolist() for v in Prefixes(words, start).near(asked, cutoff)), strict=True)
    pairs = ((i, j, _common(x, w) + start) for i, x in enumerate(asked) for j, w in enumerate(words))
    assert sorted(got) == [(i, j, n) for i, j, n in pairs if 2 * n >= cutoff * (len(asked[i]) + len(words[j]) + 2 * start) - 1e-9]


def test_a_block_with_no_near_word_and_one_with_itself():
    """9,000 words of which none is near, and one of which is the word itself."""
    words = sorted(f"{a}{b}{c}{d}zzzz" for a in "abcdefghi" for b in "0123456789" for c in "0123456789" for d in "0123456789")
    tree = Prefixes(words, 0)
    assert len(tree.near(["qqqqqqqq"], 0.9)[0]) == 0 and len(tree.near(["a123zzzz"], 1.0)[0]) == 1
