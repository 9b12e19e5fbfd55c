"""Quality classifier with hierarchical empirical Bayes.

A logistic model on form features gives each document its evidence.  Grouped
aggregation turns evidence into posteriors of hosts and of the paths below
them: a sparse path shrinks toward its host and a sparse host toward the global
rate.  Both strengths are fitted by the moments of a nested analysis of
variance, so that what small groups scatter by chance counts as no spread.  A
document's posterior combines its own evidence with that of the others on its
path; its own counts once.

The documents of the queries have neither host nor path: their source stands for
the host, source and language for the path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridewell.llm.common import (
    NOT_SPACE,
    Scratch,
    byte_class,
    row_key,
    text_slices,
    totals,
    without,
    word_hashes,
    words,
)

LETTER = byte_class((65, 90), (97, 122), (128, 255))
UPPER = byte_class((65, 90))
DIGIT = byte_class((48, 57))
MARK = byte_class((33, 43), (45, 45), (47, 47), (58, 64), (91, 96), (123, 126))
BAR = byte_class((124, 124))
N_FEATURES = 11


def form_features(column: pa.Array) -> np.ndarray:
    """Per text: shares of letters, capitals, digits and marks among the bytes,
    words that carry a mark, bars a word, mean word length, share of repeated
    lines, log length, and share of words that repeat the one before.  Null and
    empty texts give zeros."""
    rows = []
    for lo, hi, data, offsets in text_slices(column):
        starts, ends, first = words(data, offsets, NOT_SPACE)
        sums = [
            np.concatenate([[0], np.cumsum(t[data], dtype=np.int64)])
            for t in (LETTER, UPPER, DIGIT, MARK, BAR)
        ]
        lines = np.flatnonzero(data == 10)
        marked = np.concatenate(
            [[0], np.cumsum((sums[3][ends] - sums[3][starts]) > 0, dtype=np.int64)]
        )
        hashes = word_hashes(data, starts, ends)
        again = np.zeros(len(hashes) + 1, np.int64)
        np.cumsum(hashes[1:] == hashes[:-1], out=again[2:])
        for i in range(hi - lo):
            a, b = offsets[i], offsets[i + 1]
            n, w = b - a, first[i + 1] - first[i]
            if w == 0:
                rows.append(np.zeros(N_FEATURES))
                continue
            letter, upper, digit, mark, bar = (s[b] - s[a] for s in sums)
            own = lines[np.searchsorted(lines, a) : np.searchsorted(lines, b)]
            repeated = 0.0
            if len(own):
                cut = bytes(data[a:b]).split(b"\n")
                repeated = 1 - len(set(cut)) / len(cut)
            rows.append(
                np.array(
                    [
                        letter / n,
                        upper / max(1, letter),
                        digit / n,
                        mark / n,
                        (marked[first[i + 1]] - marked[first[i]]) / w,
                        bar / w,
                        min(n / w, 40) / 10,
                        repeated,
                        np.log1p(w) / 10,
                        1.0 / w,
                        (again[first[i + 1]] - again[first[i] + 1]) / w,
                    ]
                )
            )
    return np.array(rows).reshape(-1, N_FEATURES)


def bend(x: np.ndarray) -> np.ndarray:
    """Features, their roots and squares, and a constant."""
    return np.hstack([x, np.sqrt(x), x * x, np.ones((len(x), 1))])


def slopes(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss, summed over rows."""
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return x.T @ (p - y), (x * (p * (1 - p) + 1e-6)[:, None]).T @ x


def newton(n: int, total: float, one_class: bool, width: int, sums, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps on ``n`` rows whose answers sum
    to ``total``; ``sums`` gives slopes() over them; one class gives its rate."""
    beta = np.zeros(width)
    rate = (total + 0.5) / (n + 1)
    beta[-1] = np.log(rate / (1 - rate))
    if one_class:
        return beta
    penalty = ridge * n * np.eye(width) + 1e-9 * np.eye(width)
    penalty[-1, -1] = 1e-9
    for _ in range(steps):
        grad, curve = sums(beta)
        step = np.linalg.solve(curve + penalty, grad + penalty @ beta)
        beta -= step
        if np.abs(step).max() < 1e-7:
            break
    return beta


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """newton() on rows in memory."""
    one = len(y) == 0 or y.min() == y.max()
    return newton(len(y), y.sum(), one, x.shape[1], lambda beta: slopes(x, y, beta), ridge, steps)


@dataclass(frozen=True)
class Forms:
    """Form features of a table, a row for each of its rows: doc_id, key, host,
    path and x."""

    rows: DataFrame


def _groups(host_col: str | None = "source", path_cols: tuple = ("lang",)) -> tuple:
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")) if host_col else F.lit("")
    path = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in path_cols))
    return host, path


def forms(docs: DataFrame, host_col: str | None = "source", path_cols: tuple = ("lang",)) -> Forms:
    """Features of every row, written once: fit() and posterior() need no text
    any more, so none is shuffled."""
    host, path = _groups(host_col, path_cols)

    def features(batches):
        for batch in batches:
            x = pa.array(form_features(batch.column("text")).ravel())
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * N_FEATURES)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "key", "host", "path")), pa.ListArray.from_arrays(ends, x)],
                ["doc_id", "key", "host", "path", "x"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key(F.col("doc_id"), F.col("text"), host, path).alias("key"),
        host.alias("host"),
        path.alias("path"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(features, "doc_id long, key long, host string, path string, x array<double>")
    return Forms(Scratch(docs.sparkSession, "quality-forms").table(rows, "forms"))


def _x(batch: pa.RecordBatch) -> np.ndarray:
    return bend(np.asarray(batch.column("x").flatten()).reshape(-1, N_FEATURES))


def fit(docs: DataFrame | Forms, labels: DataFrame) -> np.ndarray:
    """Fit on all labelled ids.  Null ids and labels teach nothing, of repeated
    labels the larger counts, and of a repeated id all rows; without labels every
    document has the evidence one half.  Features meet the labels and are written
    once, and each Newton step adds up all of them in tasks."""
    known = labels.where("quality is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    taught = (docs if isinstance(docs, Forms) else forms(docs, None, ())).rows
    scratch = Scratch(taught.sparkSession, "quality-fit")
    rows = scratch.table(taught.select("doc_id", "x").join(known, "doc_id").select("x", "y"), "features")
    n, total, least, most = rows.agg(F.count("y"), F.sum("y"), F.min("y"), F.max("y")).first()
    width = 3 * N_FEATURES + 1

    def sums(beta):
        def count(batch):
            grad, curve = slopes(_x(batch), np.asarray(batch.column("y"), float), beta)
            return np.concatenate([grad, curve.ravel()])

        both = totals(rows, count, float)
        return both[:width], both[width:].reshape(width, width)

    beta = newton(n, total or 0, least == most, width, sums)
    scratch.drop("features")
    return beta


#: Bounds of a prior's strength, in documents.
LEAST, MOST = 2, 10_000
#: Moments: noise of a document about its path, variance of paths about their
#: host and of hosts about the whole; none of them below zero.
STRENGTHS = (
    "greatest(0.0D, coalesce(try_divide(within, total - paths), 0.0D)) as noise",
    "greatest(0.0D, coalesce(try_divide(path_spread - (paths - hosts) * noise, total - own), 0.0D)) as path_variance",
    "greatest(0.0D, coalesce(try_divide(host_spread - (hosts - 1) * noise - path_variance * (own - nn / total),"
    " total - hh / total), 0.0D)) as host_variance",
)


def posterior(
    docs: DataFrame | Forms, beta: np.ndarray, host_col: str = "source", path_cols: tuple = ("lang",)
) -> DataFrame:
    """One row per input row: doc_id, host, path, p_doc, p_host, p_path (the
    posteriors of host and path without the row itself), posterior and keep
    (posterior of good quality at least one half).  Forms have their hosts and
    paths already.

    Null and empty texts have the evidence of zero features; null hosts and
    paths form a group of their own; null ids and repeated rows stay; an empty
    table gives no rows.
    """
    return _posterior(docs if isinstance(docs, Forms) else forms(docs, host_col, path_cols), beta).drop("key")


def _posterior(known: Forms, beta: np.ndarray) -> DataFrame:
    """posterior() with the key of each row."""

    def score(batches):
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(_x(batch) @ beta, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "key", "host", "path")), pa.array(p)],
                ["doc_id", "key", "host", "path", "p_doc"],
            )

    scored = known.rows.mapInArrow(score, "doc_id long, key long, host string, path string, p_doc double")
    scored = Scratch(known.rows.sparkSession, "quality").table(scored, "scored")
    paths = scored.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum("p_doc").alias("s"), F.sum(F.col("p_doc") * F.col("p_doc")).alias("q")
    )
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("hn"),
        F.sum("s").alias("hs"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.count("*").alias("np"),
    )
    prior = hosts.agg(
        F.sum("hn").alias("total"),
        (F.sum("hs") / F.sum("hn")).alias("rate"),
        F.sum("within").alias("within"),
        # Spread of paths about their host and of hosts about the whole.
        F.sum(F.col("between") - F.col("hs") * F.col("hs") / F.col("hn")).alias("path_spread"),
        (F.sum(F.col("hs") * F.col("hs") / F.col("hn")) - F.sum("hs") * F.sum("hs") / F.sum("hn")).alias("host_spread"),
        F.sum("np").alias("paths"),
        F.count("*").alias("hosts"),
        F.sum(F.col("nn") / F.col("hn")).alias("own"),
        F.sum("nn").alias("nn"),
        F.sum(F.col("hn") * F.col("hn")).alias("hh"),
    ).selectExpr("*", *STRENGTHS[:1]).selectExpr("*", *STRENGTHS[1:2]).selectExpr("*", *STRENGTHS[2:3])
    k = "least({most}D, greatest({least}D, coalesce(try_divide(noise, {v}), {most}D)))"
    prior = prior.selectExpr(
        "rate",
        k.format(v="host_variance", most=MOST, least=LEAST) + " as k_host",
        k.format(v="path_variance", most=MOST, least=LEAST) + " as k_path",
    )
    groups = paths.join(hosts.select("host", "hn", "hs"), "host").crossJoin(F.broadcast(prior))  # one row

    def logit(name):
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(name)))
        return F.log(p / (1 - p))

    own = logit("p_doc") + logit("p_path") - logit("rate")
    out = (
        scored.join(groups, ["host", "path"])
        .withColumn("p_host", F.expr("(hs - p_doc + k_host * rate) / (hn - 1 + k_host)"))
        .withColumn("p_path", F.expr("(s - p_doc + k_path * p_host) / (n - 1 + k_path)"))
    )
    out = out.withColumn("posterior", 1 / (1 + F.exp(-own)))
    return out.select(
        "doc_id",
        "key",
        "host",
        "path",
        F.round("p_doc", 6).alias("p_doc"),
        F.round("p_host", 6).alias("p_host"),
        F.round("p_path", 6).alias("p_path"),
        F.round("posterior", 6).alias("posterior"),
        (F.col("posterior") >= 0.5).alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects: all columns; null
    and repeated ids are told apart by text, host and path; without labels every
    row stays; an empty table stays empty."""
    known = forms(docs)
    bad = _posterior(known, fit(known, labels)).where("not keep")
    return without(docs, bad, row_key(F.col("doc_id"), F.col("text"), *_groups()))
