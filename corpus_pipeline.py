"""The training-data pipeline: each stage takes what the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of documents.
"""

from __future__ import annotations

from stridewell.llm import decontaminate, mixing, near_dedup, quality, secret_ledger
from stridewell.llm.common import Scratch


def quality_stage(spark, docs, sf_dir):
    """Documents that the hierarchical classifier rejects go; null and repeated
    ids are judged by their own text, source and language, and an empty table
    stays empty, here and in every stage."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark, docs, sf_dir):
    """One document of each group of near-duplicates (five-word shingles,
    similarity 0.8) stays, the one of smallest id; null ids all stay."""
    return near_dedup.keep_one(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold a benchmark window go; null texts hold none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark, docs, sf_dir):
    """Secrets become a mark; every document stays, null texts null."""
    return secret_ledger.redact(docs)


def mixing_stage(spark, docs, sf_dir):
    """Documents drawn by calibrated probabilities, with weight and
    probability."""
    return mixing.sample(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: Trained classifiers and hash signatures have no statement in SQL; the stages
#: are tested one by one against plain versions (tests/llm/test_whole_queries.py).
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, f"{k}-{name}")
            if k:  # what a stage has read is not read again
                scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
