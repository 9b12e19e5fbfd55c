"""MinHash near-duplicate classes.

Every text becomes the set of its distinct word shingles.  Texts of equal sets
collapse to a class; class representatives get `bands * rows` universal hash
minima and meet in band buckets.  A bucket is not expanded into its pairs: a
pivot (the member that meets most others over all bands, in a group of edited
copies the common original) is compared with the rest.  Buckets that then still
hold several components are compared inside a task: signatures of members of
different components, of which only a star for each group of plausible pairs
leaves the task.  What is connected by plausible pairs meets once more with the
full sets, and a task gives only the confirmed links that join two components.
Pairs already connected need no comparison, so components are those of the full
graph of candidate links.  Buckets and groups above a block's size are dealt as
pairs of blocks, so no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridewell.llm.common import (
    LOWER,
    NOT_SPACE,
    Scratch,
    U,
    among,
    fresh,
    gram_hashes,
    mix,
    partitions_for,
    row_key,
    text_slices,
    without,
    word_hashes,
    words,
)
from stridewell.llm.components import components

SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("node", pa.int64()),
        ("n_shingles", pa.int64()),
        ("s1", pa.int64()),
        ("s2", pa.int64()),
        ("bands", pa.list_(pa.int64())),
    ]
)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, ends, first = words(data, offsets, NOT_SPACE)
        hashes = word_hashes(data, starts, ends)
        grams = gram_hashes(hashes, k)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:  # fewer words: the sequence is the one shingle
                yield gram_hashes(hashes[a:b], int(b - a), seed=100 + int(b - a))
            else:
                yield np.zeros(0, U)


def minima(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each universal hash (multiply, add, shift) over the set."""
    out = np.full(len(a), np.iinfo(np.uint64).max, U)
    x = items & U(0xFFFFFFFF)
    for lo in range(0, len(x), 1024):
        np.minimum(out, ((a[:, None] * x[None, lo : lo + 1024] + b[:, None]) >> U(32)).min(1), out)
    return out


def _signer(k: int, bands: int, rows: int):
    rng = np.random.default_rng(20)
    a = rng.integers(0, 1 << 63, bands * rows, dtype=U) * U(2) + U(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=U)
    factor = rng.integers(0, 1 << 63, rows, dtype=U) | U(1)
    salt = mix(np.arange(1, bands + 1, dtype=U))

    def run(batches):
        for batch in batches:
            size, s1, s2, keys = [], [], [], []
            for items in shingle_sets(batch.column("text"), k):
                size.append(len(items))
                if len(items) == 0:
                    s1.append(0)
                    s2.append(0)
                    keys.append(None)
                    continue
                s1.append(items.sum(dtype=U))
                s2.append(np.bitwise_xor.reduce(mix(items + U(99))))
                low = minima(items, a, b).reshape(bands, rows)
                keys.append(mix((low * factor).sum(1, dtype=U) + salt).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("node"),
                    pa.array(size, pa.int64()),
                    pa.array(np.array(s1, U).view(np.int64)),
                    pa.array(np.array(s2, U).view(np.int64)),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                schema=SIGNED,
            )

    return run


#: Universal hash minima, one byte of each, that a signature has.
SIGNATURE = 256


def _sketcher(k: int):
    rng = np.random.default_rng(21)
    a = rng.integers(0, 1 << 63, SIGNATURE, dtype=U) * U(2) + U(1)
    b = rng.integers(0, 1 << 63, SIGNATURE, dtype=U)

    def run(batches):
        for batch in batches:
            signs = [
                mix(minima(x, a, b)).astype(np.uint8).tobytes()
                for x in shingle_sets(batch.column("text"), k)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(signs, pa.binary())], ["doc_id", "text", "sign"]
            )

    return run


def _plausible(percent: int):
    """Pairs whose signatures agree as often as a pair at the threshold does,
    less six standard deviations (a chance of 1e-9 to lose a link)."""
    p = percent / 100
    least = SIGNATURE * (p - 6 * (p * (1 - p) / SIGNATURE) ** 0.5)

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIGNATURE)
                for c in ("sa", "sb")
            )
            mask = pa.array((x == y).sum(1) >= least)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"]
            )

    return run


def _verifier(k: int, percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            left = shingle_sets(batch.column("ta"), k)
            right = shingle_sets(batch.column("tb"), k)
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], ["u", "v"]
            )

    return run


#: Members of a bucket, and shingles of a group, that one block holds.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20


#: Ids that are broadcast to fetch their texts (8 bytes each, about 50 in memory).
SENT_IDS = 2_000_000


def _root(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _runs(batches, columns: list[str]):
    """Rows of one (key, p, q), gathered over batches sorted by these: for each
    its columns as NumPy arrays or lists."""
    held, last = [], None
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "p", "q")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, n], strict=True):
            now = tuple(keys[:, lo].tolist())
            if now != last and held:
                yield last, pa.Table.from_batches(held).combine_chunks().select(columns)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = now
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks().select(columns)


def _plausible_groups(percent: int):
    """From the members of each bucket: a star (least member, member) for each
    set of members that plausible pairs of different components connect."""
    p = percent / 100
    least = {m: m * (p - 6 * (p * (1 - p) / m) ** 0.5) for m in (32, SIGNATURE)}

    def run(batches):
        for _, rows in _runs(batches, ["rep", "comp", "n", "sign"]):
            rep, comp, size = (rows.column(c).to_numpy() for c in ("rep", "comp", "n"))
            if len(rep) < 2 or (comp == comp[0]).all():
                continue
            order = np.argsort(size, kind="stable")
            rep, comp, size = rep[order], comp[order], size[order]
            sign = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint8)
            sign = sign.reshape(-1, SIGNATURE)[order]
            short = np.ascontiguousarray(sign[:, :32])
            # The last member whose set is not too large for each member's.
            far = np.searchsorted(size * percent, size * 100, side="right")
            parent = {i: i for i in range(len(rep))}
            for i in range(len(rep) - 1):
                to = far[i]
                near = np.flatnonzero(
                    (comp[i + 1 : to] != comp[i])
                    & (np.count_nonzero(short[i + 1 : to] == short[i], axis=1) >= least[32])
                ) + i + 1
                near = near[np.count_nonzero(sign[near] == sign[i], axis=1) >= least[SIGNATURE]]
                for j in near.tolist():
                    parent[_root(parent, j)] = _root(parent, i)
            roots = np.array([_root(parent, i) for i in range(len(rep))])
            low = np.full(len(rep), np.iinfo(np.int64).max)
            np.minimum.at(low, roots, rep)
            u, v = rep, low[roots]
            if (u != v).any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"]
                )

    return run


def _joining_links(k: int, percent: int):
    """From the members of each group with their texts: confirmed links, of
    which each joins two components that were apart until then."""

    def run(batches):
        for _, rows in _runs(batches, ["rep", "comp", "text"]):
            rep, comp = rows.column("rep").to_pylist(), rows.column("comp").to_pylist()
            parent = {c: c for c in comp}
            if len(parent) < 2:
                continue
            sets = list(shingle_sets(rows.column("text").combine_chunks(), k))
            size = np.array([len(x) for x in sets])
            _, code = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(sets)), size)[np.argsort(code, kind="stable")]
            begin = np.concatenate([[0], np.cumsum(np.bincount(code))])
            own = np.split(code, np.cumsum(size)[:-1])
            u, v = [], []
            for i, items in enumerate(own):
                if not len(items):
                    continue
                met = np.concatenate([owner[begin[c] : begin[c + 1]] for c in items.tolist()])
                both = np.bincount(met, minlength=len(sets))
                both[: i + 1] = 0
                for j in np.flatnonzero((both > 0) & (100 * both >= percent * (size + size[i] - both))):
                    a, b = _root(parent, comp[i]), _root(parent, comp[int(j)])
                    if a != b:
                        parent[a] = b
                        u.append(rep[i])
                        v.append(rep[int(j)])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows with (p, q), once for each pair of blocks that holds them; with
    ``blocks`` 1, once."""
    own = F.pmod(F.xxhash64("rep"), blocks)
    return (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
        .withColumn("p", F.least("own", "other"))
        .withColumn("q", F.greatest("own", "other"))
        .drop("own", "other")
    )


def _dealt(rows: DataFrame, to: int) -> DataFrame:
    return rows.repartition(to, "key", "p", "q").sortWithinPartitions("key", "p", "q")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 4,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A pair at the threshold s misses all bands with chance (1 - s^rows)^bands:
    5e-8 for the defaults.  Null and wordless texts have an empty set and are
    linked with nothing.  A null id stays with a null component and is kept.
    Repeated rows stay.  An empty table gives no rows.  Other columns of the
    input are not read.
    """
    found = _components(docs, id_col, text_col, shingle, percent, bands, rows)
    return found.select("doc_id", "n_shingles", "component_id").select(
        "*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def _components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 4,
) -> DataFrame:
    """One row per input row: doc_id, node (key of the id and text),
    n_shingles, component_id and stands (the component's one row of smallest id
    and then node, and any row without component).  Texts are told apart by
    node, so those under one id are compared each."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        row_key(F.col(id_col), F.col(text_col)).alias("node"),
        F.col(text_col).cast("string").alias("text"),
    )
    signed = scratch.table(
        texts.mapInArrow(
            _signer(shingle, bands, rows),
            "doc_id long, node long, n_shingles long, s1 long, s2 long, bands array<long>",
        ),
        "signed",
    )
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("n_shingles", "s1", "s2").agg(
        F.min(F.struct("doc_id", "node")).alias("first")
    )
    classes = classes.withColumn("rep", F.col("first.node"))
    reps = (
        usable.join(classes.select(F.col("rep").alias("node")), "node", "left_semi")
        .dropDuplicates(["node"])
        .select("node", "doc_id", "n_shingles", F.explode("bands").alias("key"))
        .select("key", F.col("node").alias("rep"), (-F.col("doc_id")).alias("low"), F.col("n_shingles").alias("n"))
    )
    full = reps.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    met = reps.join(full, "key")
    score = met.groupBy("rep").agg(F.sum("c").alias("score"))
    members = scratch.table(met.join(score, "rep").select("key", "rep", "low", "n", "score"), "members")
    wanted = scratch.table(members.select(F.col("rep").alias("node")).distinct(), "wanted")
    if wanted.count() <= SENT_IDS:  # no text of others is shuffled
        wanted = F.broadcast(wanted)
    held = scratch.table(  # from here on a node is the doc_id
        texts.join(wanted, "node", "left_semi")
        .where("doc_id is not null")
        .dropDuplicates(["node"])
        .select(F.col("node").alias("doc_id"), "text")
        .mapInArrow(_sketcher(shingle), "doc_id long, text string, sign binary"),
        "held",
    )

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        signs = pairs.join(
            held.select(F.col("doc_id").alias("a"), F.col("sign").alias("sa")), "a"
        ).join(held.select(F.col("doc_id").alias("b"), F.col("sign").alias("sb")), "b")
        near = signs.select("a", "b", "sa", "sb").mapInArrow(_plausible(percent), "a long, b long")
        both = near.join(
            held.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a"
        ).join(held.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        return scratch.table(
            both.select("a", "b", "ta", "tb").mapInArrow(
                _verifier(shingle, percent), "u long, v long"
            ),
            name,
        )

    fits = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    pair = (F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))

    def star(rows: DataFrame) -> DataFrame:
        """Members with the pivot of another component: the member that has
        the highest score in the bucket."""
        best = rows.groupBy("key").agg(
            F.max(
                F.struct(
                    "score", "low", F.col("rep").alias("pivot"), F.col("n").alias("m"), F.col("comp")
                )
            ).alias("p")
        )
        best = best.select(
            "key",
            F.col("p.pivot").alias("pivot"),
            F.col("p.low").alias("first"),
            F.col("p.m").alias("m"),
            F.col("p.comp").alias("other"),
            F.col("p.score").alias("weight"),
        )
        return rows.join(best, "key").where("comp <> other").where(fits)

    def unsettled(name: str) -> DataFrame:
        """Members of buckets that still hold several components."""
        named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
            "key", "rep", "low", "n", "score", F.coalesce("comp", "rep").alias("comp")
        )
        split = named.groupBy("key").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")
        )
        split = split.where("lo < hi").select("key", "c")
        return scratch.table(named.join(split, "key").select("key", "rep", "n", "comp", "c"), name)

    # One pivot for each member: the best over its buckets.
    own = members.withColumn("comp", F.col("rep"))
    first = star(own).groupBy("rep").agg(
        F.max(F.struct("weight", F.col("first"), F.col("pivot"))).alias("p")
    )
    tried = first.select("rep", F.col("p.pivot").alias("pivot")).select(*pair).distinct()
    tried = scratch.table(tried, "tried")
    links = confirm(tried, "links-1")
    labels = components(scratch, links, "c1")

    # Buckets that still hold several components: signatures compared in tasks.
    apart = unsettled("apart")
    signs = apart.join(held.select(F.col("doc_id").alias("rep"), "sign"), "rep")
    blocks = F.ceil(F.col("c") / BLOCK_ROWS).cast("long")
    dealt = _in_blocks(signs, blocks).select("key", "p", "q", "rep", "comp", "n", "sign")
    stars = scratch.table(
        # Buckets that share members give the same stars.
        _dealt(dealt, partitions_for(apart)).mapInArrow(_plausible_groups(percent), "u long, v long").distinct(),
        "plausible",
    )
    scratch.drop("members", "tried")

    # What plausible pairs connect, compared on the full sets.
    groups = components(scratch, stars, "g").withColumnsRenamed({"node": "rep", "comp": "key"})
    named = apart.select("rep", "comp", "n").distinct().join(groups, "rep")
    total = named.groupBy("key").agg(F.sum("n").alias("shingles"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    blocks = F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("long")
    full = named.join(total.where("lo < hi"), "key").join(
        held.select(F.col("doc_id").alias("rep"), "text"), "rep"
    )
    dealt = _in_blocks(full, blocks).select("key", "p", "q", "rep", "comp", "text")
    found = scratch.table(
        _dealt(dealt, partitions_for(held)).mapInArrow(_joining_links(shingle, percent), "u long, v long"),
        "links-2",
    )
    if not found.isEmpty():
        stars = labels.select(F.col("node").alias("u"), F.col("comp").alias("v"))
        labels = components(scratch, stars.union(found), "c2")
    scratch.drop("apart", "held", "plausible")

    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    least = (
        named.where("comp is not null").groupBy("comp").agg(F.min("first").alias("least"))
    )
    named = named.join(least, "comp", "left").select(
        "n_shingles", "s1", "s2", F.coalesce("least", "first").alias("first")
    )
    out = signed.select("doc_id", "node", "n_shingles", "s1", "s2").join(
        named, ["n_shingles", "s1", "s2"], "left"
    )
    return out.select(
        "doc_id",
        "node",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id")).alias(
            "component_id"
        ),
        (
            F.col("doc_id").isNull() | F.col("first").isNull() | (F.col("node") == F.col("first.node"))
        ).alias("stands"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their component: all columns, one
    document (the smallest id) per component, rows of null id kept; of rows
    that repeat one id and text, one stays.

    What is to go, and which ids and texts are repeated, is written first, so
    that whole rows are dealt once, and only repeated ones a second time.
    """
    id_col = options.get("id_col", "doc_id")
    key = row_key(F.col(id_col), F.col(options.get("text_col", "text")))
    found = _components(docs, **options).groupBy("doc_id", F.col("node").alias("key"))
    found = found.agg(F.min("stands").alias("stands"), F.count("*").alias("n"))
    found = found.where("not stands or (n > 1 and doc_id is not null)").select("doc_id", "key", "stands")
    found = Scratch(docs.sparkSession, "near-one").table(found, "found")
    left, again = without(docs, found, key, id_col), found.where("stands")
    if again.isEmpty():
        return left
    same, n = fresh(docs, "_key"), fresh(docs, "_n")
    order = Window.partitionBy(id_col, same).orderBy(F.xxhash64(*docs.columns))
    once = among(docs, again, key, id_col).withColumn(same, key).withColumn(n, F.row_number().over(order))
    return left.union(once.where(F.col(n) == 1).drop(n, same))
