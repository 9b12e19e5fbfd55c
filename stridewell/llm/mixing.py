"""Mixing sources to target weights by iterative proportional fitting.

Token counts are aggregated to cells (source, language, topic).  Raking scales
the cells until the token shares of each marginal are the target's; a
document's probability is its cell's factor, calibrated so that the expected
tokens meet the budget, and a hash of its id decides.

Topics are learned: spherical k-means over the hashed word counts of all texts
gives centres, and every document goes to the nearest one.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stridewell.llm.common import LOWER, NOT_SPACE, Scratch, U, low_ranks, text_slices, totals, word_hashes, words

AXES = ("source", "lang", "topic")
#: Cells above this count are raked by distributed steps instead of in memory.
CELLS_IN_MEMORY = 200_000
#: Topics, hashed features of a text, and texts that topics are learned from (all).
TOPICS, FEATURES, SAMPLE = 8, 256, None
#: Steps of a feature and of a centre in one.  On these grids sums and products
#: are whole numbers that doubles hold exactly, in whatever order they are added.
GRID, FINE = 1 << 15, 1 << 30
#: Rounds of k-means at most.
TOPIC_ROUNDS = 20
#: Raking ends, in memory or distributed, at this residual or after these rounds.
CLOSE = 1e-10
ROUNDS = 1000


def word_profiles(column: pa.Array):
    """Per text: number of words and the roots of its hashed word counts, of
    length one (zero without words), rounded to the grid."""
    for lo, hi, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, ends, first = words(data, offsets, NOT_SPACE)
        at = (word_hashes(data, starts, ends) % U(FEATURES)).astype(np.int64)
        at += np.repeat(np.arange(hi - lo), np.diff(first)) * FEATURES
        x = np.sqrt(np.bincount(at, minlength=(hi - lo) * FEATURES).reshape(-1, FEATURES))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        yield np.diff(first), np.round(x * GRID) / GRID


def _blocks(batches):
    """Texts with words, a row a block: ends of the texts' entries, and the
    entries' features (FEATURES is 256) and values in steps of the grid."""
    for batch in batches:
        for n, x in word_profiles(batch.column("text")):
            x = x[n > 0]
            row, at = np.nonzero(x)
            ends = np.searchsorted(row, np.arange(len(x)), "right").astype(np.int32)
            parts = (ends, at.astype(np.uint8), (x[row, at] * GRID).astype(np.uint16))
            yield pa.RecordBatch.from_pydict(dict(zip(("ends", "at", "value"), ([p.tobytes()] for p in parts))))


def _matrices(batch: pa.RecordBatch):
    """The blocks of a batch as matrices of whole numbers, a row a text."""
    for ends, at, value in zip(*(batch.column(c) for c in ("ends", "at", "value"))):
        ends = np.frombuffer(ends.as_buffer(), np.int32)
        x = np.zeros((len(ends), FEATURES))
        row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        x[row, np.frombuffer(at.as_buffer(), np.uint8)] = np.frombuffer(value.as_buffer(), np.uint16)
        yield x


def _group_sums(blocks: DataFrame, groups: int, of) -> tuple[np.ndarray, np.ndarray]:
    """Texts in each group, and sums of their features in steps of the grid;
    ``of`` gives the groups of a matrix's rows."""

    def count(batch):
        out = np.zeros((groups, FEATURES + 1), np.int64)
        for x in _matrices(batch):
            one = (np.arange(groups)[:, None] == of(x)).astype(float)
            out[:, :-1] += (one @ x).astype(np.int64)
            out[:, -1] += one.sum(1).astype(np.int64)
        return out.ravel()

    sums = totals(blocks, count).reshape(groups, FEATURES + 1)
    return sums[:, -1], sums[:, :-1]


def _fine(centres: np.ndarray) -> np.ndarray:
    return np.round(centres * FINE) / FINE


def _first_centres(blocks: DataFrame, topics: int) -> np.ndarray | None:
    """Means of ``topics`` equal parts of all texts along their first principal
    direction; texts at one place that parts share are shared in proportion.
    None without texts."""
    upper = np.triu_indices(FEATURES)

    def moments(batch):
        out = np.zeros(len(upper[0]) + FEATURES + 1, np.int64)
        for x in _matrices(batch):
            out += np.concatenate([(x.T @ x)[upper], x.sum(0), [len(x)]]).astype(np.int64)
        return out

    sums = totals(blocks, moments)
    if sums is None or not sums[-1]:
        return None
    n, first = int(sums[-1]), sums[-1 - FEATURES : -1] / GRID
    square = np.zeros((FEATURES, FEATURES))
    square[upper] = sums[: len(upper[0])] / GRID**2
    square += np.triu(square, 1).T
    values, directions = np.linalg.eigh(square - np.outer(first, first) / n if n > 1 else np.eye(FEATURES))
    line = directions[:, values.argmax()]
    line = np.round(line * np.sign(line[np.abs(line).argmax()]) * GRID)

    def places(x):
        return (x @ line).astype(np.int64) + (1 << 31)  # below 1 << 32

    k = min(topics, n)
    cut = np.cumsum([0] + [n // k + (j < n % k) for j in range(k)])
    # The place of each part's first text, eleven bits at a time.
    at, below = np.zeros(k - 1, np.int64), np.zeros(k - 1, np.int64)
    for shift in (22, 11, 0) if k > 1 else ():

        def bins(batch, at=at, shift=shift):
            out = np.zeros((k - 1, 1 << 11), np.int64)
            for x in _matrices(batch):
                for j, own in enumerate((places(x)[None, :] - at[:, None]) >> shift):
                    out[j] += np.bincount(own[(own >= 0) & (own < 1 << 11)], minlength=1 << 11)
            return out.ravel()

        up_to = below[:, None] + np.cumsum(totals(blocks, bins).reshape(k - 1, -1), axis=1)
        found = np.array([np.searchsorted(u, c, "right") for u, c in zip(up_to, cut[1:-1])])
        at, below = at + (found << shift), np.where(found > 0, up_to[np.arange(k - 1), found - 1], below)
    at = np.unique(at)
    # Groups: between these places, and on each of them.
    size, features = _group_sums(
        blocks, 2 * len(at) + 1, lambda x: np.searchsorted(at, places(x)) + np.searchsorted(at, places(x), "right")
    )
    end = np.cumsum(size)
    both = np.minimum(cut[1:, None], end) - np.maximum(cut[:-1, None], end - size)
    share = np.maximum(both, 0) / np.maximum(size, 1)
    return _fine(share @ features / GRID / np.diff(cut)[:, None])


def learn_topics(docs: DataFrame, topics: int = TOPICS, most: int | None = SAMPLE) -> np.ndarray:
    """Centres of ``topics`` groups of all texts, or of at most ``most``, those of
    least hash of id and text, where a caller says so.  Texts are hashed once and
    their profiles written; each round, TOPIC_ROUNDS at most, adds up all of them
    in tasks.  Null and wordless texts teach nothing; without any the one centre
    is zero."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    if most is not None:
        known = low_ranks(known, F.xxhash64("doc_id", "text"), most).orderBy("rank", "doc_id").limit(most)
    scratch = Scratch(docs.sparkSession, "topics")
    blocks = scratch.table(known.select("text").mapInArrow(_blocks, "ends binary, at binary, value binary"), "profiles")
    centres = _first_centres(blocks, topics)
    for _ in range(TOPIC_ROUNDS if centres is not None else 0):
        size, sums = _group_sums(blocks, len(centres), lambda x, at=centres.T: (x @ at).argmax(1))
        moved = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None] / GRID, centres)
        moved = _fine(moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12))
        still = np.abs(moved - centres).max() < 1e-9
        centres = moved
        if still:
            break
    scratch.drop("profiles")
    return np.zeros((1, FEATURES)) if centres is None else centres


def with_cells(docs: DataFrame, centres: np.ndarray, *also: str) -> DataFrame:
    """doc_id, source, lang, topic (of the nearest centre, 'none' for texts
    without words) and n_tokens (runs of non-space).  Null keys become the value
    'none'; null texts have no tokens.  ``also``: columns to keep."""
    named = docs.select(
        *also,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("none")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("lang"),
        F.col("text").cast("string").alias("text"),
    )
    kept = [c for c in named.columns if c != "text"]

    def run(batches):
        for batch in batches:
            topic, count = [], []
            for n, x in word_profiles(batch.column("text")):
                best = (x @ centres.T).argmax(1)
                topic += [f"t{k}" if m else "none" for k, m in zip(best.tolist(), n.tolist(), strict=True)]
                count += n.tolist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(topic, pa.string()), pa.array(count, pa.int64())],
                [*kept, "topic", "n_tokens"],
            )

    fields = [f for f in named.schema if f.name != "text"]
    return named.mapInArrow(run, StructType(fields).add("topic", "string").add("n_tokens", "long"))


def tempered(cells: list[dict], power: float = 0.5) -> dict[str, dict[str, float]]:
    """Target marginals that flatten the present mixture: those of the cells'
    tokens ** power, scaled to one.  A mixture of the same cells has them, so
    raking can meet all of them at once, however the axes depend on each other."""
    out = {}
    for axis in AXES:
        mass: dict[str, float] = {}
        for c in cells:
            if c["tokens"] > 0:
                mass[c[axis]] = mass.get(c[axis], 0) + c["tokens"] ** power
        total = sum(mass.values()) or 1.0
        out[axis] = {k: v / total for k, v in mass.items()}
    return out


def _report(what: str, residual: float) -> None:
    """Says that an iteration ended at its cap, and how far off it is."""
    warnings.warn(f"{what} stopped at its cap with a residual of {residual:.3g}", RuntimeWarning, 3)


def rake(
    cells: list[dict],
    targets: dict[str, dict[str, float]],
    rounds: int = ROUNDS,
    close: float = CLOSE,
) -> list[float]:
    """Factor of each cell so that weighted token shares meet each marginal.
    Values without a target, or with target 0, get factor 0; targets of values
    without tokens are spread over the others.  Cells without tokens keep 1.
    Rounds end when no marginal is off by more than ``close`` (largest absolute
    log of a scale); where ``rounds`` do not get there, a warning gives the
    residual."""
    tokens = np.array([c["tokens"] for c in cells], float)
    weight = (tokens > 0).astype(float)
    total = float(tokens.sum())
    axes = []
    for axis in [x for x in AXES if x in targets] if total else ():
        values, at = np.unique(np.array([c[axis] for c in cells], object), return_inverse=True)
        axes.append((axis, np.array([targets[axis].get(v, 0.0) for v in values], float), at))
    worst = 0.0
    for _ in range(rounds if total else 0):
        worst = 0.0
        for axis, want, at in axes:
            mass = np.bincount(at, weight * tokens, len(want))
            share = np.where(mass > 0, want, 0.0)
            whole = share.sum()
            if not whole:
                raise ValueError(f"no target of {axis} has tokens")
            scale = np.divide(total * share / whole, mass, out=np.zeros(len(want)), where=mass > 0)
            worst = max([worst, *np.abs(np.log(scale[scale > 0]))])
            weight = weight * scale[at]
        if worst < close:
            break
    if worst >= close:
        _report("raking", worst)
    return [float(w) if t > 0 else 1.0 for w, t in zip(weight, tokens)]


def rake_distributed(
    scratch: Scratch,
    cells: DataFrame,
    targets: dict[str, DataFrame],
    rounds: int = ROUNDS,
    *,
    close: float = CLOSE,
) -> DataFrame:
    """The same raking, ended by the same rule, as DataFrame steps, for cells
    without a size bound.  ``targets``: (value, share) per axis.  Each round is
    written."""
    now = cells.withColumn("factor", F.when(F.col("tokens") > 0, 1.0).otherwise(0.0))
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    worst = 0.0
    for k in range(rounds if total else 0):
        worst = 0.0
        for axis, shares in targets.items():
            mass = now.groupBy(axis).agg(F.sum(F.col("factor") * F.col("tokens")).alias("m"))
            scale = mass.where("m > 0").join(
                shares.select(F.col("value").alias(axis), "share"), axis
            )
            ratio = F.when(F.col("share") > 0, F.col("share") / F.col("m"))
            whole, least, most = scale.agg(F.sum("share"), F.min(ratio), F.max(ratio)).first()
            if not whole:
                raise ValueError(f"no target of {axis} has tokens")
            worst = max([worst, *(abs(math.log(total * x / whole)) for x in (least, most))])
            scale = scale.select(axis, (F.lit(total) * F.col("share") / F.lit(whole) / F.col("m")).alias("s"))
            now = now.join(scale, axis, "left").select(
                *cells.columns, (F.col("factor") * F.coalesce("s", F.lit(0.0))).alias("factor")
            )
        now = scratch.table(now, f"rake-{k}")
        if k:
            scratch.drop(f"rake-{k - 1}")
        if worst < close:
            break
    if worst >= close:
        _report("raking", worst)
    return now.withColumn("factor", F.when(F.col("tokens") > 0, F.col("factor")).otherwise(1.0))


def calibrated(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    keep_share: float = 0.5,
    seed: int = 1,
) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, n_tokens, weight,
    probability and sampled.

    Expected tokens are ``keep_share`` of all unless probabilities reach one
    first: the rate is solved over cells, so that min(1, rate * factor) meets
    the budget.  Ties of id fall together, as the draw is a hash of the id;
    null ids hash as such; an empty table gives no rows.
    """
    rows, weighted, rate, _ = _weights(docs, targets, keep_share)
    out = rows.join(weighted, list(AXES))
    return out.select(
        "doc_id",
        *AXES,
        "n_tokens",
        F.col("factor").alias("weight"),
        _probability(rate).alias("probability"),
    ).select("*", (_draw(seed) < F.col("probability")).alias("sampled"))


def _probability(rate: float) -> F.Column:
    return F.least(F.lit(1.0), F.col("factor") * F.lit(rate))


def _draw(seed: int) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _weights(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None, keep_share: float
) -> tuple[DataFrame, DataFrame, float, np.ndarray]:
    """Rows with their cells, the factor of each cell, the rate, and the topics'
    centres."""
    scratch = Scratch(docs.sparkSession, "mixing")
    centres = learn_topics(docs)
    rows = scratch.table(with_cells(docs, centres), "rows")
    grouped = rows.groupBy(*AXES).agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")
    )
    grouped = scratch.table(grouped, "cells")
    if grouped.count() <= CELLS_IN_MEMORY:
        cells = [r.asDict() for r in grouped.orderBy(*AXES).collect()]
        factors = rake(cells, targets or tempered(cells))
        kept = [{**c, "factor": f} for c, f in zip(cells, factors)]
        weighted = docs.sparkSession.createDataFrame(
            [(c["source"], c["lang"], c["topic"], float(c["factor"]), int(c["tokens"])) for c in kept],
            "source string, lang string, topic string, factor double, tokens long",
        )
        weighted = F.broadcast(weighted)  # at most CELLS_IN_MEMORY rows

        def sums(rate):
            below = [(f, c["tokens"]) for c, f in zip(cells, factors) if rate * f < 1]
            total = sum(c["tokens"] for c in cells)
            return total, total - sum(t for _, t in below), sum(f * t for f, t in below)
    else:
        shares = {}
        for axis in AXES:
            if targets and axis not in targets:
                continue
            if targets:
                share = docs.sparkSession.createDataFrame(
                    list(targets[axis].items()), "value string, share double"
                )
            else:
                share = grouped.groupBy(F.col(axis).alias("value")).agg(
                    F.sum(F.sqrt("tokens")).alias("share")
                )
            shares[axis] = share
        weighted = rake_distributed(scratch, grouped, shares).select(*AXES, "factor", "tokens")

        def sums(rate):
            below = F.lit(rate) * F.col("factor") < 1
            return weighted.agg(
                F.sum("tokens"),
                F.sum(F.when(below, 0).otherwise(F.col("tokens"))),
                F.sum(F.when(below, F.col("factor") * F.col("tokens")).otherwise(0.0)),
            ).first()
    # The rate by fixed-point steps over cells (sums only): those at one stay.
    rate = keep_share
    for _ in range(ROUNDS):
        total, full, part = sums(rate)
        better = max(0.0, (keep_share * total - full) / part) if part else rate
        moved = abs(better - rate) / max(1.0, rate)
        if moved <= 1e-12:
            break
        rate = better
    else:
        _report("the rate", moved)
    return rows, weighted.drop("tokens"), rate, centres


def sample(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    keep_share: float = 0.5,
    seed: int = 1,
) -> DataFrame:
    """The sampled rows of ``docs`` with topic, weight and probability: each
    row is drawn by its own cell and id, as in calibrated().  Columns of these
    three names are replaced; an empty table stays empty."""
    _, weighted, rate, centres = _weights(docs, targets, keep_share)
    whole = docs.drop("topic", "weight", "probability")
    read = ("doc_id", "source", "lang", "text")
    rows = docs.select(F.struct(*whole.columns).alias("_kept"), *read)
    cells = with_cells(rows, centres, "_kept")
    out = cells.join(weighted, list(AXES)).where(_draw(seed) < _probability(rate))
    return out.select(
        "_kept.*", "topic", F.col("factor").alias("weight"), _probability(rate).alias("probability")
    )
