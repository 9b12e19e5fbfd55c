"""Every operator on nulls in every column, empty and very long texts, repeated
rows, ties, an empty table and columns whose names it uses itself."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
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

CLASH = "_n long, _key long, _id long, _gone long, _blob string, _spans string, _kept string, row long, version long, w string, node long, rank long, key long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def table(spark, rows):
    wide = [(d, t, x, s, None if t is None else len(t), 1, 2, 3, 4, "b", "s", "k", 5, 6, "w", 7, 8, 9) for d, t, x, s in rows]
    return spark.createDataFrame(wide, SCHEMA)


def odd_rows():
    rng = random.Random(12)
    words = [f"wort{i}" for i in range(3000)] + ["token:", "password=abcdefgh12", "AKIAABCDEFGHIJKL9", "a" * 40]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(rng.randrange(1, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(60)]
    long = prose(30_000)
    rows += [(100, long, "en", "a"), (101, long[:150_000] + " end", "en", "a"), (102, "word " * 40_000, "de", None)]
    rows += [(None, None, None, None), (None, "", None, None), (7, None, "en", "b"), (8, " \n\t ", "de", "a"), (9, "…!?", "de", "a")]
    rows += [rows[0], rows[0], (5, prose(30), "en", "a"), (None, prose(60), "en", "b"), (None, rows[1][1], "en", "b")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows()
    return table(spark, rows), rows


BENCH = "item_id long, text string, met int"


def bench(spark, rows):
    items = [(1, " ".join(rows[100 if len(rows) > 100 else 60][1].split()[50:70]), 1), (1, None, None), (None, "wort1 wort2", 0), (3, "", 0)]
    return spark.createDataFrame(items, BENCH), [(d, t) for d, t, _ in items]


def same(df, want, names):
    got = Counter(tuple(r) for r in df.select(*names).collect())
    assert got == Counter(want)


def test_exact_operators(spark, odd):
    docs, rows = odd
    plain = [(d, t) for d, t, _, _ in rows]
    named = [r for r in plain if r[0] is not None]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    same(substring_dedup.remove_repeats(docs), brute.substring(plain), names)
    near = near_dedup.near_duplicates(docs, shingle=3, percent=85, bands=24)
    assert near.count() == len(rows)
    same(near.where("doc_id is not null"), brute.near(named), ["doc_id", "n_shingles", "component_id", "kept"])
    items, listed = bench(spark, rows)
    got = decontaminate.contamination(docs, items)
    want = brute.decontaminate(plain, listed)
    for r, x in zip(sorted(got.collect(), key=str), sorted(want, key=str), strict=True):
        assert (r.doc_id, r.n_words, r.n_hit, r.contaminated) == (*x[:3], x[-1])
    found = secret_ledger.digest_columns(secret_ledger.BlobLedger(spark).scan(docs))
    same(found, brute.secrets(plain), found.columns)
    stored = media.media_features(docs).collect()
    sizes = Counter((d, len((t or "").encode())) for d, t in plain)
    assert Counter((r.doc_id, r.n_bytes) for r in stored) == sizes


def test_models(spark, odd):
    docs, rows = odd
    ids = Counter(d for d, *_ in rows)
    labels = spark.createDataFrame(
        [(i, i % 2, int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None), (4, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    model = language_id.train(docs, per_language=20)
    named = language_id.predict(docs, model).collect()
    assert Counter(r.doc_id for r in named) == ids
    assert {r.lang_pred for r in named if r.doc_id in (8, 9) and r.score == 0} == {"und"}
    none = language_id.predict(docs, language_id.train(docs.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"} and Counter(r.doc_id for r in none) == ids
    only = language_id.train(docs.withColumn("lang", F.lit("en")))
    assert {r.lang_pred for r in language_id.predict(docs, only).collect()} == {"en", "und"}
    good = quality.posterior(docs, quality.fit(docs, labels)).collect()
    assert Counter(r.doc_id for r in good) == ids and all(0 <= r.posterior <= 1 for r in good)
    flat = quality.posterior(docs, quality.fit(docs, labels.limit(0))).collect()
    assert all(r.keep for r in flat)
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert Counter(r.doc_id for r in scored) == ids
    assert Counter(r.doc_id for r in licences.scan(docs).collect()) == ids
    mixed = mixing.calibrated(docs).collect()
    assert Counter(r.doc_id for r in mixed) == ids and all(0 <= r.probability <= 1 for r in mixed)
    # Ties: rows that repeat one another get the same answer everywhere.
    for answers in (named, good, scored, mixed):
        own = {tuple(r) for r in answers if r.doc_id == 0}
        assert len(own) == 1


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, tmp_path, name, stage):
    docs, rows = odd
    items, _ = bench(spark, rows)
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = stage(spark, docs, str(tmp_path))
    assert got.columns[: len(docs.columns)] == docs.columns
    before = Counter((r.doc_id, r.source, r._n, r.w) for r in docs.collect())
    assert not Counter((r.doc_id, r.source, r._n, r.w) for r in got.collect()) - before
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pixel_arrays_of_odd_images(spark):
    rows = [(1, None, 5), (2, b"", 6), (3, b"RIFF", 7)]
    got = media.pixel_arrays(spark.createDataFrame(rows, "doc_id long, media binary, height int")).collect()
    assert [(r.doc_id, r.height, r.pixels, bool(r.error)) for r in got] == [(i, None, None, True) for i in (1, 2, 3)]
    assert np.array_equal([r.width for r in got], [None] * 3)


@pytest.mark.parametrize("most", [4096, 5])
def test_passages_that_most_documents_share(spark, monkeypatch, most):
    """Hot windows go their own way, all of them or only a few."""
    rng = random.Random(21)
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", 8)
    monkeypatch.setattr(substring_dedup, "HOT_MOST", most)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(120):
        own = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(0, 60))]
        cut = passage[rng.randrange(8) :] if i % 3 else []
        at = rng.randrange(len(own) + 1)
        rows.append((1000 - i * 7 % 120, " ".join(own[:at] + cut + own[at:] + (["x"] * 30 if i % 4 == 0 else []))))
    rows += [(None, " ".join(passage)), (5, None), rows[3], (1, " ".join(passage[:13]))]
    got = substring_dedup.remove_repeats(table(spark, [(d, t, "en", "a") for d, t in rows]))
    same(got, brute.substring(rows), ["doc_id", "n_words", "n_removed", "kept_sha256"])


@pytest.mark.parametrize("n", [1, 4, 97])
def test_keys_are_dealt_one_to_a_partition(spark, n):
    from stridewell.llm.common import partition_keys

    keys = partition_keys(spark, n).tolist()
    rows = spark.createDataFrame([(k,) for k in keys], "bucket int").repartition(n, "bucket")
    at = {r.bucket: r.at for r in rows.withColumn("at", F.spark_partition_id()).collect()}
    assert [at[k] for k in keys] == list(range(n))
