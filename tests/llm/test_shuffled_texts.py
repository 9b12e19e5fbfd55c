"""What is shuffled where no table is small enough to be broadcast."""

import random

import pytest

from stridewell.llm import common, entries, near_dedup, quality


@pytest.fixture
def shuffles(spark, monkeypatch):
    """A function that gives the columns of each exchange in the plans of the
    tables written so far and of a frame."""
    written, write = [], common.Scratch.table
    monkeypatch.setattr(common.Scratch, "table", lambda self, df, name: written.append(df) or write(self, df, name))

    def columns(node):
        own = []
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            own = [{node.output().apply(i).name() for i in range(node.output().size())}]
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return columns(node.initialPlan())
        kids = node.children()
        return own + [x for i in range(kids.size()) for x in columns(kids.apply(i))]

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield lambda *dfs: [x for df in [*written, *dfs] for x in columns(df._jdf.queryExecution().executedPlan())]
    spark.conf.set(key, before)


def test_quality_shuffles_no_text(spark, shuffles, tmp_path):
    rng = random.Random(4)
    words = ["plain", "words", "of", "text", "||", "X1", "#", "42"]
    rows = [(i % 190 or None, " ".join(rng.choices(words, k=rng.randrange(9))), f"h{i % 3}", "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300, 3)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = entries.op6_quality(spark, str(tmp_path))
    found = shuffles(out)
    assert found and not any("text" in x for x in found)
    beta = quality.fit(docs, labels)
    assert sorted(out.collect(), key=str) == sorted(quality.posterior(docs, beta).collect(), key=str)


def test_near_dedup_deals_whole_rows_once(spark, shuffles, monkeypatch):
    texts = [" ".join(f"w{i % 17}x{k}" for k in range(12)) for i in range(40)]
    rows = [(i, t, f"n{i}") for i, t in enumerate(texts)] + [(None, texts[0], "m"), (None, None, "m"), (99, None, "n")]
    schema = "doc_id long, text string, note string"
    out = near_dedup.keep_one(spark.createDataFrame(rows, schema))
    found = shuffles(out)
    assert sum({"text", "note"} <= x for x in found) == 1
    # Texts of documents that meet no other are not fetched by a shuffle.
    assert sum({"node", "text"} <= x for x in found) == 0
    few = sorted(map(tuple, out.collect()), key=str)
    monkeypatch.setattr(near_dedup, "SENT_IDS", -1)
    assert sorted(map(tuple, near_dedup.keep_one(spark.createDataFrame(rows, schema)).collect()), key=str) == few
    assert sum({"node", "text"} <= x for x in shuffles()) > 0
    want = sorted([*rows[:17], *rows[40:]], key=str)
    assert sorted(map(tuple, out.collect()), key=str) == want
    # Repeated rows, also of ids that go, of which one stays; null ids stay each.
    rows += [(3, texts[3], "n3"), (3, texts[3], "other"), (20, texts[20], "n20"), (99, None, "n"), (None, None, "m")]
    out = sorted(map(tuple, near_dedup.keep_one(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert len(out) == len(want) + 1 and {x[:2] for x in out} == {x[:2] for x in want}
    assert out.count((None, None, "m")) == 2 and sum(x[0] == 3 for x in out) == 1
