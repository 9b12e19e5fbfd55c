"""The contract queries and general operators against plain re-statements."""

import os
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest


from stridewell.llm import (
    components,
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
    webp,
)
from stridewell.llm.common import Scratch

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD = [
    (5000, None),
    (5001, ""),
    (5002, "a b"),
    (5003, "a  B"),
    (5004, 'É𝒳 ToKen="abcdefgh" AKIAABCDEFGHIJKL1 ' + "ab" * 20),
    (5004, "again the same id"),
    (5005, "x token: secret: abcdefghijkl"),
]


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000")
    return [tuple(r) for r in docs.select("doc_id", "text").collect()] + ODD


def frame(spark, rows):
    wide = [(d, t, "clash", 1, None) for d, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, component string, n long, fps string")


def test_substring(spark, texts):
    rows = [*texts, (None, texts[3][1]), (6000, " ".join(["w"] * 40)), (6001, " ".join(["w"] * 14))]
    got = substring_dedup.remove_repeats(frame(spark, rows), with_text=False)
    assert rows_of(got) == sorted(brute.substring(rows), key=str)
    for target in (2, 6, 40):
        got = substring_dedup.remove_repeats(frame(spark, rows), target=target, with_text=False)
        assert rows_of(got) == sorted(brute.substring(rows, target), key=str)


def test_near_duplicates_of_edited_copies(spark, texts):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = [r for r in texts[:80]] + ODD[:4]
    for g in range(50):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 2, 3, 3, 4])):
            copy[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((9000 + (g * 37) % 61, " ".join(copy)))
    got = near_dedup.near_duplicates(frame(spark, rows), shingle=3, percent=85, bands=24)
    assert rows_of(got) == sorted(brute.near(rows), key=str)


def test_secrets_and_increments(spark, texts, tmp_path):
    path = str(tmp_path / "ledger")
    ledger = secret_ledger.BlobLedger(spark, path)
    half = texts[: len(texts) // 2]
    first = ledger.scan(frame(spark, half))
    assert rows_of(secret_ledger.digest_columns(first)) == sorted(brute.secrets(half), key=str)
    before = ledger.entries().count()
    second = ledger.scan(frame(spark, texts))
    assert rows_of(secret_ledger.digest_columns(second)) == sorted(brute.secrets(texts), key=str)
    blobs = ledger.entries().groupBy("blob", "rule_version").count()
    assert blobs.where("count > 1").count() == 0 and ledger.entries().count() > before


def test_redaction(spark):
    rows = [(1, 'a token = "abcdefghij" b'), (2, None), (3, "clean")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in secret_ledger.redact(docs).collect()}
    assert out == {1: 'a [SECRET]" b', 2: None, 3: "clean"}


@pytest.mark.parametrize("rows_broadcast", [500_000, 0])
def test_decontamination(spark, texts, monkeypatch, rows_broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows_broadcast)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "two words"), (901, None), (902, "..")]
    rows = [*texts, (7000, "Two words, " + items[3][1].upper() + " TWO WORDS")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, rows), bench)
    assert rows_of(got) == sorted(brute.decontaminate(rows, items), key=str)
    none = decontaminate.contamination(frame(spark, rows), bench.limit(0))
    assert none.where("n_hit > 0").count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (
        substring_dedup.remove_repeats(empty),
        near_dedup.near_duplicates(empty),
        secret_ledger.BlobLedger(spark).scan(empty),
        decontaminate.contamination(empty, bench),
        media.media_features(empty),
        licences.scan(empty),
        mixing.calibrated(empty),
        quality.posterior(empty, np.zeros(3 * quality.N_FEATURES + 1)),
        language_id.predict(empty, language_id.train(empty)),
    ):
        assert out.count() == 0


def test_webp_round_trips():
    rng = np.random.default_rng(0)
    for _ in range(40):
        h, w = rng.integers(1, 20, 2)
        image = rng.integers(0, rng.choice([2, 4, 9, 256]), (h, w, 4)).astype(np.uint8)
        options = {"cache_bits": int(rng.choice([0, 1, 4, 11])), "repeats": bool(rng.integers(2))}
        if rng.integers(2):
            options["modes"] = [int(x) for x in rng.integers(0, 14, 5)]
        if rng.integers(2):
            options["colour"] = tuple(int(x) for x in rng.integers(0, 256, 3))
        options["subtract_green"] = bool(rng.integers(2))
        options["palette"] = len(np.unique(image.reshape(-1, 4), axis=0)) <= 256 and bool(rng.integers(2))
        assert (webp.decode(webp.encode(image, **options)) == image).all()


def test_webp_refuses_broken_bytes():
    good = webp.encode(np.zeros((3, 3, 4), np.uint8))
    for bad in (b"", b"RIFF", good[:24], b"x" * 40):
        with pytest.raises(webp.BadImage):
            webp.decode(bad)


def test_media_reads_back_what_it_stored(spark, texts):
    import hashlib

    rows = [*texts, (8000, "é" * 70_000)]
    got = {(r.doc_id, r.n_bytes): r for r in media.media_features(frame(spark, rows)).collect()}
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64) or b"\0" * 64
        r = got[d, len(raw)]
        assert (r.payload_bytes, r.payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    images = media.pixel_arrays(media.to_images(frame(spark, rows[:5]))).collect()
    for r, (_, t) in zip(images, rows):
        assert r.pixels[1::4][: r.n_bytes] == t.encode() and r.error is None


def test_a_published_image_decodes():
    """One pixel, stored by another encoder: the lossless sample that web pages
    test a browser's support with."""
    import base64

    image = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert image.shape == (1, 1, 4)


def test_media_uses_the_tools_that_save(spark):
    rng = random.Random(8)
    rows = [
        (0, "".join(rng.choice("ab") for _ in range(4000)), "palette+repeats"),
        (1, " ".join(f"{a}-{a}" for a in ("lorem", "ipsum", "dolor", "quam") for _ in range(200)), "repeats"),
        (2, "".join(chr(33 + (i * 3 + (i % 97) // 96) % 90) for i in range(6000)), None),
        (3, "".join(chr(rng.randrange(32, 127)) for _ in range(3000)), "literals"),
        (4, "".join(chr(32 + int(45 + 45 * np.sin(i / 25))) for i in range(40_000)), None),
        (5, None, None),
    ]
    got = {r.doc_id: r for r in media.media_features(frame(spark, [r[:2] for r in rows])).collect()}
    for d, t, tools in rows:
        assert tools in (None, got[d].tools), got[d].tools
        payload = (t or "").encode()
        payload += b"\0" * (-len(payload) % 64) or (b"" if payload else b"\0" * 64)
        assert zlib.crc32(payload[-64:]) == got[d].tail_crc32 and len(payload) == got[d].payload_bytes
    steps = np.cumsum(np.random.default_rng(2).integers(-2, 3, 64 * 400)).astype(np.uint8)
    images, tools = webp.encode_bytes(steps, np.array([0, len(steps)]))
    assert tools == ["predictor+repeats"] and webp.decode_bytes(images) == [steps.tobytes()]
    few = np.random.default_rng(3).integers(0, 28, 64 * 300).astype(np.uint8) * 9
    few = np.tile(few[:6400], 3)
    images, tools = webp.encode_bytes(few, np.array([0, len(few)]))
    assert "repeats" in tools[0] and webp.decode_bytes(images) == [few.tobytes()]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(5, 5), (None, 3), (1, 2), (1, 2)]
    got = components.components(Scratch(spark, "t"), spark.createDataFrame(edges, "u long, v long"), "c")
    near = {x: {x} for e in edges for x in e if None not in e and e[0] != e[1]}
    for a, b in edges:
        if None not in (a, b) and a != b:
            whole = near[a] | near[b]
            for x in whole:
                near[x] = whole
    assert {tuple(r) for r in got.collect()} == {(x, min(s)) for x, s in near.items()}


def test_raking_meets_marginals():
    rng = random.Random(1)
    cells = [
        {"source": s, "lang": x, "topic": t, "tokens": rng.randrange(1, 500)}
        for s in "abc"
        for x in ("en", "de")
        for t in ("p", "q")
    ]
    targets = {"source": {"a": 0.2, "b": 0.3, "c": 0.5}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"p": 0.5, "q": 0.5}}
    factors = mixing.rake(cells, targets)
    total = sum(c["tokens"] for c in cells)
    for axis, want in targets.items():
        for value, share in want.items():
            mass = sum(f * c["tokens"] for c, f in zip(cells, factors) if c[axis] == value)
            assert abs(mass / total - share) < 1e-6


def test_licences(spark):
    rows = [(1, "Hello\nReleased under the MIT License.\nbye"), (2, None), (3, "Licensed under CC BY-NC 4.0."), (4, "no licence at all here")]
    got = {r.doc_id: (r.licence, r.n_matched) for r in licences.scan(frame(spark, rows)).collect()}
    assert got == {1: ("MIT", 1), 2: (None, 0), 3: ("CC-BY-NC-4.0", 1), 4: (None, 0)}


def labelled(name):
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pandas()
    docs["crc"] = [zlib.crc32(str(d).encode()) for d in docs.doc_id]
    return docs.merge(pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pandas(), how=name, on="doc_id")


def test_language_held_out():
    docs = labelled("left")
    docs = docs[docs.lang.notna()]
    train, held = docs[docs.crc % 5 != 0], docs[docs.crc % 5 == 0]
    model = language_id.Model(train.text.tolist(), train.lang.tolist())
    raw = model.outputs(model._sets(held.text.tolist()))
    assert (np.array(model.langs)[raw.argmax(1)] == held.lang).mean() > 0.97


def crc(column, n):
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def test_toxicity_held_out_and_spoiled_words(spark):
    """Many toxic labels of the tables stand on texts without any insult, so
    recall has a ceiling below one."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(crc("doc_id", 4) != 2))
    held = labels.where(crc("doc_id", 4) == 2).join(toxicity.score(docs, model), "doc_id").toPandas()
    hit = held.predicted == 1
    assert hit[held.toxic == 1].mean() > 0.84 and hit[held.toxic == 0].mean() < 0.01
    tops = model.evidence(pa.array(["an idiot", "an i.d.i.o.t", "an i d i o t", "an idxiot", "the and"]))[:, 0]
    assert (tops[:4] > 0).all() and tops[4] < 0


def test_toxicity_of_odd_tables(spark):
    insult = "you idiot go away now"
    docs = [(i, f"{insult if i % 3 == 0 else 'a calm word'} number {i}") for i in range(40)]
    docs += [(None, insult), (1, "another text of one id"), (7, None), (8, ""), (8, "x " * 50_000)]
    labels = [(i, int(i % 3 == 0)) for i in range(40)] + [(None, 1), (3, None), (1, 0), (7, 1)]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, seg string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    for none in (labels.limit(0), labels.where("toxic = 0")):
        flat = toxicity.score(docs, toxicity.train(docs, none)).collect()
        assert len(flat) == len(got) and not any(r.predicted for r in flat)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_quality_keeps_clean_text():
    docs = labelled("inner")
    train, held = docs[docs.crc % 2 == 0], docs[docs.crc % 2 == 1]
    beta = quality.fit_logistic(quality.bend(quality.form_features(pa.array(train.text))), train.quality.to_numpy(float))
    keep = quality.bend(quality.form_features(pa.array(held.text))) @ beta >= 0
    assert keep[held.quality == 1].mean() > 0.98 and keep[held.quality == 0].mean() < 0.1


def test_quality_posterior_by_hand(spark):
    """Against sums over lists: other rows of a path and host, nested moments."""
    rng = random.Random(9)
    rows = []
    for i in range(300):
        host = rng.choice(["a", "b", "c", None, "rare%d" % (i % 40)])
        good = rng.random() < {"a": 0.9, "b": 0.3}.get(host, 0.6)
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 60))]
        rows.append((rng.choice([None, i, 7]), " ".join(words if good else [words[0] + "!!"] * 30), rng.choice(["x", "y", None]), host))
    rows.append((5, None, None, None))
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, source string, p_host double")
    beta = np.random.default_rng(3).normal(size=3 * quality.N_FEATURES + 1) / 3
    x = quality.bend(quality.form_features(pa.array([r[1] for r in rows], pa.string()))) @ beta
    p = 1 / (1 + np.exp(-x))
    host = [r[3] or "" for r in rows]
    path = [(r[3] or "", r[2] or "") for r in rows]
    n = len(rows)
    of = lambda keys, k: [i for i in range(n) if keys[i] == k]
    hosts, paths = sorted(set(host)), sorted(set(path))
    mean = lambda at: p[at].mean()
    noise = sum(((p[at] - mean(at)) ** 2).sum() for at in (of(path, j) for j in paths)) / (n - len(paths))
    path_spread = sum(len(of(path, j)) * (mean(of(path, j)) - mean(of(host, j[0]))) ** 2 for j in paths)
    own = sum(len(of(path, j)) ** 2 / len(of(host, j[0])) for j in paths)
    tp = max(0, (path_spread - (len(paths) - len(hosts)) * noise) / (n - own))
    host_spread = sum(len(of(host, h)) * (mean(of(host, h)) - p.mean()) ** 2 for h in hosts)
    nn, hh = sum(len(of(path, j)) ** 2 for j in paths), sum(len(of(host, h)) ** 2 for h in hosts)
    th = max(0, (host_spread - (len(hosts) - 1) * noise - tp * (own - nn / n)) / (n - hh / n))
    kh, kp = (min(1e4, max(2, noise / v if v else 1e4)) for v in (th, tp))
    logit = lambda q: np.log(np.clip(q, 1e-6, 1 - 1e-6) / (1 - np.clip(q, 1e-6, 1 - 1e-6)))
    want = []
    for i in range(n):
        others = [j for j in of(host, host[i]) if j != i]
        ph = (p[others].sum() + kh * p.mean()) / (len(others) + kh)
        others = [j for j in of(path, path[i]) if j != i]
        pp = (p[others].sum() + kp * ph) / (len(others) + kp)
        post = 1 / (1 + np.exp(-(logit(p[i]) + logit(pp) - logit(p.mean()))))
        want.append((rows[i][0], host[i], path[i][1], *(round(float(v), 5) for v in (p[i], ph, pp, post))))
    got = [
        (r.doc_id, r.host, r.path, *(round(v, 5) for v in (r.p_doc, r.p_host, r.p_path, r.posterior)))
        for r in quality.posterior(docs, beta).collect()
    ]
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], atol=2e-5)
