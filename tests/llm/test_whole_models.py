"""Models of the pipeline learn from every row, whatever the partitions."""

import random

import numpy as np
import pyarrow as pa

from stridewell.llm import common, mixing, quality


def test_topics_come_from_every_text(spark):
    """Against sums over all texts on the driver: a round moves no centre."""
    rng = random.Random(8)
    pools = [[f"{name}{k}" for k in range(9)] for name in "abcd"]
    texts = [" ".join(rng.choices(pools[min(i % 40, 3)], k=rng.randrange(1, 12))) for i in range(3000)] + ["", None, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    centres = mixing.learn_topics(docs, 4)
    assert (mixing.learn_topics(docs.repartition(7).orderBy("text"), 4) == centres).all()
    x = np.vstack([x[n > 0] for n, x in mixing.word_profiles(pa.array(texts))])
    own = (x @ centres.T).argmax(1)
    means = np.array([x[own == k].mean(0) for k in range(4)])
    assert len(x) == 3000 and np.abs(means / np.linalg.norm(means, axis=1, keepdims=True) - centres).max() < 1e-8


def test_first_centres_are_means_of_equal_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "ADDERS", 2)
    texts = ["one two"] * 50 + ["three four five"] * 30 + ["six"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    blocks = docs.select("text").mapInArrow(mixing._blocks, "ends binary, at binary, value binary")
    got = mixing._first_centres(blocks, 3)
    x = np.vstack([x for _, x in mixing.word_profiles(pa.array(texts))])
    values, directions = np.linalg.eigh(np.cov(x.T))
    line = directions[:, values.argmax()]
    line *= np.sign(line[np.abs(line).argmax()])
    order = np.argsort(np.round(x @ line, 9), kind="stable")
    assert np.abs(got - [x[p].mean(0) for p in np.array_split(order, 3)]).max() < 1e-8
    assert len(mixing._first_centres(blocks.limit(0).union(docs.limit(2).select("text").mapInArrow(mixing._blocks, blocks.schema)), 8)) == 2


def test_quality_learns_from_every_label(spark):
    rng = random.Random(6)
    words = ["plain", "words", "of", "text", "||", "X1", "#", "42"]
    texts = ["a b"] * 20_500 + [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(500)]
    answers = [rng.random() < 0.7 for _ in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, int(a)) for i, a in enumerate(answers)], "doc_id long, quality int")
    x = quality.bend(quality.form_features(pa.array(texts)))
    want = quality.fit_logistic(x, np.array(answers, float))
    assert np.abs(quality.fit(docs, labels) - want).max() < 1e-6
