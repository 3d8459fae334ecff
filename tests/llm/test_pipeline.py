"""run() on the smallest tables against plain Python versions of its stages."""

import duckdb
import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from test_decontaminate import brute as contamination  # noqa: E402
from test_ngram_jaccard import brute as classes  # noqa: E402
from test_packing import check  # noqa: E402

import corpus_pipeline  # noqa: E402
from sedgeline.llm.quality import crc_mod, fit_quality  # noqa: E402
from sedgeline.llm.secrets import spans  # noqa: E402
from sedgeline.llm.style import style  # noqa: E402

DATA = "/root/testdata/sf0.001"


def redacted(text):
    out, at = [], 0
    for s, e, _ in spans(text):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def test_run_against_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    model = fit_quality(frame, spark.read.parquet(f"{DATA}/labels.parquet"), crc_mod("doc_id", 5) != 0)
    raw = [(t or "").encode() for _, t in docs]
    off = np.cumsum([0, *map(len, raw)])
    score = model.score(style(np.frombuffer(b"".join(raw), dtype=np.uint8), off))
    kept = [d for d, s in zip(docs, score, strict=True) if s >= 0.3]
    least = classes(kept, 5, 80)
    kept = [(i, t) for i, t in kept if least[i][1] == i]
    bad = {i for i, t in kept for n, hit, _ in [contamination(t, items)] if hit and 20 * hit >= n}
    kept = [(i, redacted(t or "")) for i, t in kept if i not in bad]
    got = corpus_pipeline.run(spark, DATA).collect()
    assert check(kept, got) < 2048
    assert len(docs) > len(kept) > len(docs) // 2


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs2 = stage(spark, docs, DATA)
        assert docs2.columns == docs.columns and [f.dataType for f in docs2.schema] == [f.dataType for f in docs.schema]
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DATA).count() == 0
