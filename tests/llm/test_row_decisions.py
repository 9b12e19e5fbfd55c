"""Pipeline stages on null and repeated ids: decisions are the row's own."""

import random
from collections import Counter

import brute
from stridewell.llm import decontaminate, mixing, near_dedup, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA)


def kept(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def text(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_decontamination_decides_by_row(spark):
    bench = spark.createDataFrame([(1, text(1, 20))], "item_id long, text string")
    bad, good = text(1, 20) + " " + text(2), text(3)
    rows = [(None, bad, "a"), (None, good, "a"), (5, bad, "a"), (5, good, "a"), (None, None, "a"), (6, bad, "a")]
    got = kept(decontaminate.drop_contaminated(table(spark, rows), bench))
    assert got == Counter([(None, good, "a"), (5, good, "a"), (None, None, "a")])


def test_quality_decides_by_row(spark, monkeypatch):
    import numpy as np

    beta = np.random.default_rng(1).normal(size=len(quality.bend(np.zeros((1, quality.N_FEATURES)))[0]))
    monkeypatch.setattr(quality, "fit", lambda docs, labels: beta)
    odd = ["|" * 50 + " $$$ 123 " * 9, text(4), "A B C D", "word " * 80, "$1 " * 40, "", None]
    rows = [(d, t, s) for d in (None, 7) for t in odd for s in ("a", "b")]
    docs = table(spark, rows)
    # Unique ids in place of the null and repeated ones: the same decisions.
    unique = table(spark, [(i, t, s) for i, (_, t, s) in enumerate(rows)])
    stay = {r.doc_id for r in quality.posterior(unique, beta).where("keep").collect()}
    assert 0 < len(stay) < len(rows)
    assert kept(quality.keep_good(docs, None)) == Counter(rows[i] for i in stay)


def test_near_duplicates_under_one_id(spark):
    base = [text(s, 120) for s in range(4)]
    edit = [b + " tail" for b in base]
    rows = [(5, base[0]), (5, base[1]), (3, edit[1]), (9, edit[0]), (5, base[2]), (5, base[2]), (5, edit[2])]
    rows += [(8, None), (8, ""), (None, base[3]), (None, base[3]), (2, edit[3])]
    docs = table(spark, [(d, t, "a") for d, t in rows])
    known = [r for r in rows if r[0] is not None]
    got = near_dedup.near_duplicates(docs).where("doc_id is not null").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.near(known, 5, 80), key=str)
    stay = Counter((d, t) for d, t, _ in kept(near_dedup.keep_one(docs)).elements())
    one = [t for d, t in stay if d == 5 and t in (base[2], edit[2])]
    assert len(one) == 1
    rest = Counter({k: n for k, n in stay.items() if k != (5, one[0]) and k[0] != 8})
    assert rest == Counter([(5, base[0]), (3, edit[1]), (None, base[3]), (None, base[3]), (2, edit[3])])
    assert sum(n for (d, _), n in stay.items() if d == 8) == 1


def test_sample_draws_each_row(spark):
    rows = [(d, text(i, 5 + i % 40) + (" | x" if i % 3 else ""), "abc"[i % 3]) for i, d in enumerate([None, 1, 1, 2, None, *range(60)])]
    rows.append((None, None, None))
    docs = table(spark, rows)
    want = mixing.calibrated(docs, keep_share=0.9).where("sampled")
    got = mixing.sample(docs, keep_share=0.9)
    cells = lambda df: Counter((r.doc_id, r.source or "none", r.topic, round(r.probability, 9)) for r in df.collect())
    assert cells(got) == cells(want)
    assert got.where("doc_id is null").count() > 0
    assert got.columns == [*docs.columns, "topic", "weight", "probability"]


def test_one_large_group_of_edited_copies(spark, monkeypatch):
    """Copies of an absent original: many lie at the threshold to each other,
    buckets are hot, and blocks are small."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(90)]
    rows = []
    for g in range(700):
        copy = list(base)
        for _ in range(rng.choice([2, 3, 3, 4, 4, 5])):
            copy[rng.randrange(90)] = f"e{rng.randrange(100000)}"
        rows.append((1 + (g * 311) % 650, " ".join(copy)))
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 64)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 4000)
    got = near_dedup.near_duplicates(table(spark, [(d, t, "a") for d, t in rows]), shingle=3, percent=85, bands=24)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute.near(rows), key=str)


def test_hubs_and_chains(spark, monkeypatch):
    """Components with hubs that are met by a broadcast, and long chains."""
    from stridewell.llm import components
    from stridewell.llm.common import Scratch

    monkeypatch.setattr(components, "LEAST_HUB", 5)
    rng = random.Random(6)
    edges = [(1000, 1000 + i) for i in range(1, 300)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 1000 + i) for i in range(0, 300, 7)]
    edges += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    near = {x: {x} for e in edges for x in e}
    for a, b in edges:
        whole = near[a] | near[b]
        for x in whole:
            near[x] = whole
    got = components.components(Scratch(spark, "hubs"), spark.createDataFrame(edges, "u long, v long"), "c").collect()
    lone = {a for a, b in edges if a == b and near[a] == {a}}
    assert {tuple(r) for r in got} == {(x, min(s)) for x, s in near.items() if x not in lone}


def test_a_blob_that_two_scans_appended(spark, tmp_path):
    from stridewell.llm import secret_ledger

    ledger = secret_ledger.BlobLedger(spark, str(tmp_path / "ledger"))
    docs = table(spark, [(1, 'token = "abcdefghij"', "a"), (2, "plain", "a")])
    ledger.scan(docs).count()
    ledger.entries().coalesce(1).write.mode("append").parquet(str(tmp_path / "twice"))
    spark.read.parquet(str(tmp_path / "twice")).write.mode("append").parquet(ledger.path)
    assert ledger.entries().count() == 4
    assert sorted((r.doc_id, len(r.spans)) for r in ledger.scan(docs).collect()) == [(1, 1), (2, 0)]
