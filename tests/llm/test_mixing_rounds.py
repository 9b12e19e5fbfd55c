"""Raking in memory and distributed, with the rounds that a query has."""

import math
import os

import pytest

from stridewell.llm import mixing
from stridewell.llm.common import Scratch

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_both_paths_end_at_the_same_answer(spark, monkeypatch, recwarn):
    # Fewer cells, fewer rounds.
    monkeypatch.setattr(mixing.learn_topics, "__defaults__", (3, mixing.SAMPLE))
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "lang", "length(source) as source")
    small = {r.doc_id: r for r in mixing.calibrated(docs).collect()}
    monkeypatch.setattr(mixing, "CELLS_IN_MEMORY", 0)
    large = {r.doc_id: r for r in mixing.calibrated(docs).collect()}
    assert small.keys() == large.keys()
    for d, r in small.items():
        assert math.isclose(r.weight, large[d].weight, rel_tol=1e-9)
        assert math.isclose(r.probability, large[d].probability, rel_tol=1e-9)
    assert not [w for w in recwarn if "residual" in str(w.message)]


def test_a_cap_is_reported_with_its_residual(spark):
    cells = [
        {"source": s, "lang": x, "topic": "p", "tokens": n}
        for s, x, n in (("a", "en", 90), ("a", "de", 10), ("b", "en", 5), ("b", "fr", 70))
    ]
    targets = mixing.tempered(cells)
    with pytest.warns(RuntimeWarning, match="residual"):
        mixing.rake(cells, targets, 2)
    frame = spark.createDataFrame(
        [(c["source"], c["lang"], c["topic"], c["tokens"]) for c in cells],
        "source string, lang string, topic string, tokens long",
    )
    shares = {
        k: spark.createDataFrame(list(v.items()), "value string, share double")
        for k, v in targets.items()
    }
    with pytest.warns(RuntimeWarning, match="residual"):
        mixing.rake_distributed(Scratch(spark, "cap"), frame, shares, 2)


def test_weights_by_hand(spark):
    """Against loops over lists: cells, raking, and the rate by bisection."""
    import random

    rng = random.Random(4)
    vocabulary = {"en": "the of and house tree run".split(), "de": "der und haus baum lauf".split(), None: ["x", "y"]}
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "en", "de", None])
        n = rng.randrange(0, 80)
        rows.append((rng.choice([i, None, 3]), " ".join(rng.choices(vocabulary[lang], k=n)) if n else None, lang, rng.choice("aab") if i % 9 else None))
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, source string, weight double, _row string")
    centres = mixing.learn_topics(docs)
    topic = {(r.doc_id, r.source, r.lang, r.n_tokens): r.topic for r in mixing.with_cells(docs, centres).collect()}
    cell = []
    for d, t, x, s in rows:
        n = len((t or "").split())
        cell.append((s or "none", x or "none", topic[d, s or "none", x or "none", n]))
    tokens = [len((r[1] or "").split()) for r in rows]
    total, factor = sum(tokens), {c: 1.0 for c in cell}
    mass = {}
    for c, n in zip(cell, tokens):
        mass[c] = mass.get(c, 0) + n
    targets = [{}, {}, {}]
    for c, m in mass.items():
        for k in range(3):
            targets[k][c[k]] = targets[k].get(c[k], 0) + m**0.5
    targets = [{v: m / sum(own.values()) for v, m in own.items()} for own in targets]
    for _ in range(3000):
        for k in range(3):
            now = {}
            for c, n in zip(cell, tokens):
                now[c[k]] = now.get(c[k], 0) + n * factor[c]
            for c in factor:
                if now[c[k]]:
                    factor[c] *= total * targets[k][c[k]] / now[c[k]]
    low, high = 0.0, 1e6
    for _ in range(200):
        rate = (low + high) / 2
        part = sum(n * min(1.0, rate * factor[c]) for c, n in zip(cell, tokens))
        low, high = (rate, high) if part < 0.5 * total else (low, rate)
    got = mixing.calibrated(docs).collect()
    used = {c for c, n in zip(cell, tokens) if n}
    assert len(got) == len(rows)
    for r in got:
        c = (r.source, r.lang, r.topic)
        if c in used:
            assert math.isclose(r.weight, factor[c], rel_tol=1e-6)
            assert math.isclose(r.probability, min(1.0, rate * factor[c]), rel_tol=1e-6)
    assert sorted(map(str, docs.columns)) == sorted(x for x in mixing.sample(docs).columns if x not in ("topic", "probability"))
    assert mixing.sample(docs.limit(0)).count() == 0
