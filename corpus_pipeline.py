"""The corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.llm.decontaminate import decontaminate, is_contaminated
from sedgeline.llm.ngram_jaccard import ngram_jaccard_join
from sedgeline.llm.packing import pack
from sedgeline.llm.quality import crc_mod, fit_quality, score_quality
from sedgeline.llm.queries import table, tokenizer_path
from sedgeline.scratch import Scratch
from sedgeline.llm.secrets import redacted, scan_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return score_quality(docs, model).where("quality_score.score >= 0.3").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class of five-word shingles at a similarity of 0.8 or more; texts without words link with nothing and stay."""
    classes = ngram_jaccard_join(docs, n=5, percent=80)
    gone = classes.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves alone."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~is_contaminated()).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text."""
    found = scan_secrets(docs)
    changed = F.size("secrets.spans") > 0
    new = {"text": redacted()}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(redacted()).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(new).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a training window."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        before, docs = docs, scratch.save(out, name)
        scratch.drop(before)
    return docs
