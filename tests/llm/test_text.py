"""Hashes of words: equal for equal bytes, and unlike for texts that a power-of-two modulus can't tell apart."""

import numpy as np
import pytest

from sedgeline.llm import text as tx
from sedgeline.llm.decontaminate import decontaminate
from sedgeline.llm.lattice import score_texts
from sedgeline.llm.ngram_jaccard import ngram_jaccard_join
from sedgeline.llm.packing import pack
from sedgeline.llm.queries import tokenizer_path

WORD = "a"
while len(WORD) < 1024:
    WORD += WORD.translate(str.maketrans("ab", "ba"))
OTHER = WORD.translate(str.maketrans("ab", "ba"))


def _spans(words):
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in words])
    return data, end - np.array([len(w.encode()) for w in words]), end


@pytest.mark.parametrize("doublings", [0, 3, 6])
def test_alternating_words_differ(doublings):
    a, b = WORD, OTHER
    for _ in range(doublings):
        a, b = a + b, b + a
    h = tx.span_hash(*_spans([a, b, a, "x", b]))
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_equal_bytes_have_equal_hashes():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcé "), rng.integers(0, 9))) for _ in range(4000)]
    h = tx.span_hash(*_spans(words))
    of = {}
    for w, x in zip(words, h.tolist(), strict=True):
        assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)


def test_long_texts():
    data = np.tile(np.frombuffer(b"abcdefgh" * 4, np.uint8), (1 << 19) + 9)
    start = np.array([0, 32, len(data) - 64, len(data) - 63])
    h = tx.span_hash(data, start, start + 40 - 8)
    assert h[0] == h[1] == h[2] != h[3]


def test_operators_tell_them_apart(spark):
    docs = spark.createDataFrame([(1, WORD), (2, OTHER)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_jaccard_join(docs).collect()} == {1: 1, 2: 2}
    bench = spark.createDataFrame([(7, WORD), (8, OTHER)], "item_id long, text string")
    assert {r.doc_id: r.contamination["items"] for r in decontaminate(docs, bench).collect()} == {1: ["7"], 2: ["8"]}
    from tokenizers import Tokenizer

    path = tokenizer_path()
    own = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in pack(docs, path).where("start = 0").collect()}
    import zlib

    for d, text in ((1, WORD), (2, OTHER)):
        ids = [*own.encode(text, add_special_tokens=False).ids, 1]
        assert got[d].doc_tokens == len(ids) and got[d].ids_crc32 == zlib.crc32(np.array(ids[: got[d].length], dtype="<u4").tobytes())


def test_known_words(spark):
    docs = spark.createDataFrame([(1, WORD), (2, f"{OTHER} {OTHER}")], "doc_id long, text string")
    out = {r.doc_id: r for r in score_texts(docs, tokenizer_path("piece_bpe_32k.model"), docs.doc_id == 1).collect()}
    assert (out[1].n_known, out[2].n_known) == (2, 1)
