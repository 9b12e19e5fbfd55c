"""The queries of this subpackage and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridewell.llm import (
    decontaminate,
    language_id,
    licences,
    media,
    mixing,
    near_dedup,
    quality,
    secret_ledger,
    substring_dedup,
    toxicity,
)
from stridewell.llm.oracles import ORACLES


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_mixing(spark, sf_dir):
    return mixing.calibrated(_read(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels").where(_remainder(4) != 2)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted")


def op3_media(spark, sf_dir):
    return media.media_features(_read(spark, sf_dir, "documents"))


def op4_secrets(spark, sf_dir):
    """The ledger takes in all documents; a second scan finds every pair of blob
    and rules there and answers from it."""
    docs, ledger = _read(spark, sf_dir, "documents"), secret_ledger.BlobLedger(spark)
    ledger.scan(docs)
    return secret_ledger.digest_columns(ledger.scan(docs))


def op5_decontamination(spark, sf_dir):
    return decontaminate.contamination(
        _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    )


def op6_quality(spark, sf_dir):
    known = quality.forms(_read(spark, sf_dir, "documents"))
    return quality.posterior(known, quality.fit(known, _read(spark, sf_dir, "labels")))


def op7_language(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(docs.where(_remainder(5) != 0))
    named = language_id.predict(docs, model)
    return named.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op8_licences(spark, sf_dir):
    return licences.scan(_read(spark, sf_dir, "documents"))


def op9_substring(spark, sf_dir):
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), with_text=False)


def op10_near(spark, sf_dir):
    return near_dedup.near_duplicates(
        _read(spark, sf_dir, "documents"), shingle=3, percent=85, bands=24
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_toxicity,
        op3_media,
        op4_secrets,
        op5_decontamination,
        op6_quality,
        op7_language,
        op8_licences,
        op9_substring,
        op10_near,
    )
}

__all__ = ["ORACLES", "QUERIES"]
