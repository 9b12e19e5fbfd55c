"""The registered queries and the pipeline as wholes: against SQL where it can
state them, against the stages' plain versions on a small table otherwise."""

import os
import random
from collections import Counter

import brute
import duckdb
import pytest

import corpus_pipeline
from stridewell.llm import entries, quality

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entries.QUERIES[name](spark, SF)
    rel = con.sql(entries.ORACLES[name])
    names = sorted(got.columns)
    assert sorted(rel.columns) == names
    want = rel.project(", ".join(names)).fetchall()
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want)


@pytest.mark.parametrize("name", ["op1_mixing", "op2_toxicity", "op3_media", "op6_quality", "op7_language", "op8_licences"])
def test_one_row_a_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = entries.QUERIES[name](spark, SF).select("doc_id")
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in docs.select("doc_id").collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta house river stone cloud window garden".split()) + str(rng.randrange(400)) for _ in range(n))


def planted(rng):
    """(id, text, what becomes of it)."""
    exam = prose(rng, 30)
    rows = [(i, prose(rng, rng.randrange(40, 90)), "clean") for i in range(120)]
    for i in range(120, 150):  # near copies of clean documents: the smaller id stays
        words = rows[i - 120][1].split()
        words[7] = "edited"
        rows.append((i, " ".join(words), "copy"))
    rows += [(i, rows[i - 40][1], "copy") for i in range(150, 155)]
    rows += [(i, prose(rng, 20) + " " + exam + " " + prose(rng, 20), "leak") for i in range(155, 160)]
    rows += [(i, f'{prose(rng, 45)} password = "abcdef{i}xyz" {prose(rng, 10)}', "secret") for i in range(160, 170)]
    rows += [(i, " ".join([f"{rng.choice('abc')}$$$ |"] * 60), "junk") for i in range(170, 200)]
    rows += [(None, prose(rng, 50), "clean"), (300, None, "empty"), (301, "", "empty")]
    return rows, exam


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(17)
    rows, exam = planted(rng)
    path = str(tmp_path_factory.mktemp("corpus"))
    table = [(d, t, "en" if (d or 0) % 3 else "de", f"s{(d or 0) % 4}", len(t or "")) for d, t, _ in rows]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, exam)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(d, 0 if w == "junk" else 1, 0) for d, t, w in rows if d is not None and w != "empty"]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, exam


def test_stages_one_by_one(spark, folder):
    """Each stage on what its predecessor kept, against its plain version."""
    path, rows, exam = folder
    kind = {d: w for d, _, w in rows}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    as_rows = lambda df: Counter(map(tuple, df.collect()))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, path)
    beta = quality.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    stay = Counter(r.doc_id for r in quality.posterior(docs, beta).where("keep").collect())
    assert good.columns == names and Counter(r.doc_id for r in good.collect()) == stay
    assert not any(kind[d] == "junk" for d in stay) and all(d in stay for d, _, w in rows if w == "clean")
    one = stages["near_dedup"](spark, good, path)
    known = [(r.doc_id, r.text) for r in good.collect()]
    component = {d: c for d, _, c, _ in brute.near([r for r in known if r[0] is not None], 5, 80)}
    want = Counter(d for d, _ in known if d is None or component[d] == d)
    assert one.columns == names and Counter(r.doc_id for r in one.collect()) == want
    clean = stages["decontamination"](spark, one, path)
    left = [(r.doc_id, r.text) for r in one.collect()]
    hit = [row[-1] for row in brute.decontaminate(left, [(1, exam)])]
    assert clean.columns == names
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for (d, _), h in zip(left, hit) if not h)
    safe = stages["secrets"](spark, clean, path)
    assert safe.columns == names and safe.count() == clean.count()
    for r in safe.collect():
        before = next(t for d, t, _ in rows if d == r.doc_id)
        if kind[r.doc_id] == "secret":
            assert "[SECRET]" in r.text and "password" not in r.text and r.n_chars == len(r.text)
        else:
            assert r.text == before
    mixed = stages["mixing"](spark, safe, path)
    assert as_rows(mixed.select(*names)) - as_rows(safe) == Counter()
    assert 0.3 < mixed.count() / safe.count() < 0.7


def test_run_is_the_stages_in_turn(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    got = corpus_pipeline.run(spark, path)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, docs.collect()))
    kind = {d: w for d, _, w in rows}
    assert not {kind[r.doc_id] for r in got.collect()} & {"junk", "leak"}


def test_stages_of_an_empty_table(spark, folder):
    path = folder[0]
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0
