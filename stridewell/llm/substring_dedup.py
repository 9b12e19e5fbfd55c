"""Exact removal of repeated word windows by level-wise doubling.

Level one looks at windows of four words and samples them: of every `target`
words only the short window of least hash is sent, which loses nothing, as equal
target windows hold the same one.  A short window seen in one document alone
ends there.  Around those that repeat, windows of twice the length are formed,
and so on until no candidate is left or the target length is reached, where the
repeated ones decide.  Each level is one shuffle of packed hashes by hash range
and one of its survivors back to their documents; no document is ever expanded
into rows.  The last two levels share a shuffle: a target window is dealt by the
hash of the window of the level before that it begins with, so both levels meet
in one task.

A passage that a great part of all documents share would bring its hashes' rows
to one task each.  Such hashes, a bounded number, are found by a pass without a
shuffle and never sent: short ones count as repeated, and a second such pass
gives the smallest document of each target window among them.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridewell.llm.common import (
    NOT_SPACE,
    U,
    gram_hashes,
    mix,
    partition_keys,
    partitions_for,
    text_slices,
    window_min,
    word_hashes,
    words,
)

PACKED = "bucket int, docs binary, hashes binary, marks binary"
PACKED_ARROW = pa.schema(
    [("bucket", pa.int32()), ("docs", pa.binary()), ("hashes", pa.binary()), ("marks", pa.binary())]
)
#: Rows a bucket's task holds before it folds them into one row per hash.
FOLD = 4_000_000
#: Entries a task gathers before it sends them, one row a bucket.
SEND = 2_000_000


#: A hash is hot if this part of all documents has it, and no fewer than so many;
#: at most so many hot ones are treated apart, the rest go the common way.
HOT_PART, HOT_LEAST, HOT_MOST = 256, 1000, 4096
#: Hashes that a task counts at once, and those that it gives.
COUNTED, GIVEN = 200_000, 2048


def levels(start: int, target: int) -> list[int]:
    out = [start]
    while out[-1] < target:
        out.append(min(2 * out[-1], target))
    return out


def _pack_ids(ids: np.ndarray) -> bytes:
    """Sorted or nearly sorted longs as a first value and small steps."""
    steps = np.diff(ids)
    small = len(steps) == 0 or (steps.min() >= -(1 << 31) and steps.max() < 1 << 31)
    return (b"\1" if small else b"\0") + ids[:1].tobytes() + steps.astype(
        np.int32 if small else np.int64
    ).tobytes()


def _unpack_ids(raw: bytes) -> np.ndarray:
    first = np.frombuffer(raw, np.int64, 1, 1)
    steps = np.frombuffer(raw, np.int32 if raw[0] else np.int64, -1, 9)
    return np.cumsum(np.concatenate([first, steps.astype(np.int64)]))


def _send(ids: list, hashes: list, marks: list, bucket_of, buckets: np.ndarray):
    """Rows of packed triples, one per bucket that gets any; ``buckets`` are the
    keys by which they are dealt."""
    if not ids:
        return
    doc, key, mark = np.concatenate(ids), np.concatenate(hashes), np.concatenate(marks)
    if len(doc) == 0:
        return
    to = bucket_of(doc, key, len(buckets))
    order = np.argsort(to, kind="stable")
    doc, key, mark, to = doc[order], key[order], mark[order], to[order]
    cut = np.flatnonzero(np.diff(to, prepend=-1))
    ends = np.append(cut[1:], len(to))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(buckets[to[cut]], pa.int32()),
            pa.array([_pack_ids(doc[a:b]) for a, b in zip(cut, ends)], pa.binary()),
            pa.array([key[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
            pa.array([mark[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
        ],
        schema=PACKED_ARROW,
    )


def _by_hash(doc, key, buckets):
    return ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int32)


def _by_doc(doc, key, buckets):
    return (mix(doc.view(U)) % U(buckets)).astype(np.int32)


class _Slice:
    """Texts laid end to end: word hashes, and windows that stay in a text."""

    def __init__(self, lo: int, data: np.ndarray, offsets: np.ndarray, target: int):
        self.lo, self.data, self.target = lo, data, target
        self.starts, self.ends, self.first = words(data, offsets, NOT_SPACE)
        self.hashes = word_hashes(data, self.starts, self.ends, 1)
        sizes = np.diff(self.first)
        self.row = np.repeat(np.arange(len(sizes)), sizes)  # text of each word
        n = max(0, len(self.hashes) - target + 1)
        #: Starts of target windows, and their texts.
        self.at = np.flatnonzero(self.row[:n] == self.row[len(self.row) - n :])
        self.own = self.row[self.at]

    def sampled(self, k: int) -> np.ndarray:
        """Of each target window the least hash of the length-k windows in it."""
        return window_min(gram_hashes(self.hashes, k), self.target - k + 1)[self.at]

    def begun(self, k: int) -> np.ndarray:
        """Hash of the length-k window each target window begins with."""
        return gram_hashes(self.hashes, k)[self.at]

    def second(self, k: int) -> np.ndarray:
        two = gram_hashes(word_hashes(self.data, self.starts, self.ends, 2), k, seed=2)
        return (two[self.at] >> U(32)).astype(np.uint32)

    def alive(self, keys: np.ndarray, ids: list, alive: dict) -> np.ndarray:
        """Which target windows' keys are among the survivors of their text."""
        held = [alive.get(ids[self.lo + i]) for i in range(len(self.first) - 1)]
        texts = [i for i, x in enumerate(held) if x]
        if not texts or len(keys) == 0:
            return np.zeros(len(keys), bool)
        parts = [np.concatenate(held[i]) + U(i) * _SPREAD for i in texts]
        known = np.sort(np.concatenate(parts))
        keys = keys + self.own.astype(U) * _SPREAD
        return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


_SPREAD = U(0x9E3779B97F4A7C15)


def _slices(batch, target: int):
    for lo, _, data, offsets in text_slices(batch.column("text")):
        yield _Slice(lo, data, offsets, target)


def _among(hot: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted ``hot``, and at which place."""
    if not len(hot):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
    return hot[at] == keys, at


def _frequent(k: int, target: int):
    """Per task, the hashes of sampled short windows (kind 0) and of target
    windows (kind 1) that are most frequent.  Counts are estimates: what they
    call hot is a matter of cost alone, as a hot hash that does not repeat
    removes nothing."""

    def run(batches):
        kept = [(np.zeros(0, U), np.zeros(0, np.int64)) for _ in range(2)]
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            for x in _slices(batch, target):
                for kind, keys in enumerate((x.sampled(k), x.begun(target))):
                    if not len(keys):
                        continue
                    fresh = np.ones(len(keys), bool)  # neighbours mostly share theirs
                    fresh[1:] = (keys[1:] != keys[:-1]) | (x.own[1:] != x.own[:-1])
                    new, n = np.unique(keys[fresh], return_counts=True)
                    old, m = kept[kind]
                    new, n = new[n > 1], n[n > 1]
                    both, at = np.unique(np.concatenate([old, new]), return_inverse=True)
                    count = np.bincount(at, np.concatenate([m, n]), len(both)).astype(np.int64)
                    if len(both) > COUNTED:
                        top = np.argsort(-count, kind="stable")[: COUNTED // 2]
                        both, count = both[top], count[top]
                    kept[kind] = both, count
        for kind, (key, n) in enumerate(kept):
            top = np.argsort(-n, kind="stable")[:GIVEN]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(top), kind, np.int32)), pa.array(key[top].view(np.int64)), pa.array(n[top])],
                ["kind", "key", "n"],
            )

    return run


def _smallest(target: int, hot: np.ndarray):
    """Per task, the smallest document of each hot target window."""

    def run(batches):
        least = np.full(len(hot), np.iinfo(np.int64).max)
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for x in _slices(batch, target):
                found, at = _among(hot, x.begun(target))
                np.minimum.at(least, at[found], ids[x.lo + x.own[found]])
        some = least < np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays(
            [pa.array(hot[some].view(np.int64)), pa.array(least[some])], ["key", "least"]
        )

    return run


def _hot(texts: DataFrame, k: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hot hashes of short windows, of target windows, and the smallest document
    of each of these.  A hot hash that is missed goes the common way."""
    none = np.zeros(0, U)
    many = max(HOT_LEAST, texts.count() // HOT_PART)
    told = texts.mapInArrow(_frequent(k, target), "kind int, key long, n long")
    told = told.groupBy("kind", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= many)
    rows = told.orderBy(F.desc("n"), "kind", "key").limit(2 * HOT_MOST).collect()
    short, long = (
        np.sort(np.array([r.key for r in rows if r.kind == kind][:HOT_MOST], np.int64).view(U)) for kind in (0, 1)
    )
    if not len(long):
        return short, none, np.zeros(0, np.int64)
    found = texts.mapInArrow(_smallest(target, long), "key long, least long")
    smallest = {r.key: r.least for r in found.groupBy("key").agg(F.min("least").alias("least")).collect()}
    return short, long, np.array([smallest[x] for x in long.view(np.int64).tolist()], np.int64)


def _first_level(k: int, target: int, buckets: np.ndarray, hot: np.ndarray):
    def run(batches):
        for batch in batches:
            known = batch.column("doc_id").is_valid()
            batch = batch.filter(known)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            out: tuple[list, list, list] = ([], [], [])
            for x in _slices(batch, target):
                keys = x.sampled(k)
                new = np.ones(len(keys), bool)  # neighbours mostly share theirs
                new[1:] = (keys[1:] != keys[:-1]) | (x.own[1:] != x.own[:-1])
                new &= ~_among(hot, keys)[0]
                out[0].append(ids[x.lo + x.own[new]])
                out[1].append(keys[new])
                out[2].append(np.zeros(int(new.sum()), np.uint32))
            yield from _send(*out, _by_hash, buckets)

    return run


def _repeated(buckets: np.ndarray, final: bool):
    """Streams the packed rows of hash buckets and sends what repeats to its
    documents: every (document, hash) of a hash in two documents or more, at
    the last level but those of the smallest document.

    At the last level a row's key is the hash of the level before, and its mark
    the target window's, which goes back.  Held are the rows not yet folded and, of folded ones, one row per hash (its
    smallest document), so a hash that a third of all documents share takes one
    entry.
    """

    def run(batches):
        kind = U if final else np.uint32
        held: list[tuple] = [tuple(np.zeros(0, t) for t in (np.int64, U, kind, bool))]
        count = 0

        def fold():
            doc, key, mark, told = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, mark, key))
            doc, key, mark, told = doc[order], key[order], mark[order], told[order]
            head = np.ones(len(key), bool)
            head[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
            group = np.cumsum(head) - 1
            least = doc[head][group]
            if final:
                hit = doc > least
            else:
                several = np.bincount(group, doc > least) > 0
                before = np.bincount(group, told) > 0
                hit = (several | before)[group] & ~told
            lead = told[head]
            if not final:
                lead = lead | several | before
            held[:] = [(doc[head], key[head], mark[head], lead)]
            return [doc[hit]], [mark[hit] if final else key[hit]], [np.zeros(int(hit.sum()), np.uint8)]

        for batch in batches:
            docs, keys, marks = (batch.column(i) for i in (1, 2, 3))
            for i in range(batch.num_rows):
                doc = _unpack_ids(docs[i].as_py())
                held.append(
                    (
                        doc,
                        np.frombuffer(keys[i].as_py(), U),
                        np.frombuffer(marks[i].as_py(), kind),
                        np.zeros(len(doc), bool),
                    )
                )
                count += len(doc)
                if count >= FOLD:
                    yield from _send(*fold(), _by_doc, buckets)
                    count = 0
        if count:
            yield from _send(*fold(), _by_doc, buckets)

    return run


def _packed_texts(buckets: np.ndarray):
    """Texts by bucket of their document, compressed together: they cross the
    shuffle once a level, and pack far better than row by row."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            to = _by_doc(ids, None, len(buckets))
            spread = np.arange(len(ids), dtype=np.int32) % len(buckets)  # null ids meet nothing
            to = np.where(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False), spread, to)
            order = np.argsort(to, kind="stable")
            batch, to = batch.take(pa.array(order)), to[order]
            cut = np.flatnonzero(np.diff(to, prepend=-1))
            bodies = []
            for lo, hi in zip(cut, [*cut[1:], len(to)]):
                sink = pa.BufferOutputStream()
                options = pa.ipc.IpcWriteOptions(compression="zstd")
                with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                    # taken, not sliced: a slice would write the whole buffers
                    out.write_batch(batch.take(pa.array(np.arange(lo, hi))))
                bodies.append(sink.getvalue().to_pybytes())
            none = pa.nulls(len(cut), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets[to[cut]], pa.int32()), none, none, pa.array(bodies, pa.binary())],
                ["bucket", "docs", "hashes", "body"],
            )

    return run


def _with_survivors(batches):
    """(texts, {doc: hashes}) with the packed survivors, which come first in
    their bucket, unpacked."""
    alive: dict[int, list] = defaultdict(list)
    bucket = None
    for batch in batches:
        for here, docs, hashes, body in zip(*(batch.column(c) for c in ("bucket", "docs", "hashes", "body"))):
            if here.as_py() != bucket:
                alive.clear()
                bucket = here.as_py()
            if body.is_valid:
                with pa.ipc.open_stream(body.as_buffer()) as texts:
                    for part in texts:
                        yield part, alive
                continue
            doc, key = _unpack_ids(docs.as_py()), np.frombuffer(hashes.as_py(), U)
            order = np.argsort(doc, kind="stable")
            doc, key = doc[order], key[order]
            cut = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))
            for a, b in zip(cut, [*cut[1:], len(doc)]):
                alive[int(doc[a])].append(key[a:b])


def _next_level(
    k: int, wider: int, first: bool, target: int, buckets: np.ndarray, final: bool, short: np.ndarray, long: np.ndarray
):
    """Around the windows of k words that survived, those of ``wider`` words; at
    the last level with the target window that each begins.  Hot short windows
    survive, hot target windows are not sent."""

    def run(batches):
        out: tuple[list, list, list] = ([], [], [])
        count = 0
        for batch, alive in _with_survivors(batches):
            ids = batch.column("doc_id").to_pylist()
            every = first and len(short) > 0
            batch = batch.filter(pa.array([x is not None and (every or x in alive) for x in ids], pa.bool_()))
            ids = [x for x in ids if x is not None and (every or x in alive)]
            number = np.array(ids, np.int64)
            for x in _slices(batch, target):
                keys = x.sampled(k) if first else x.begun(k)
                live = x.alive(keys, ids, alive)
                if first:
                    live |= _among(short, keys)[0]
                if final:
                    live &= ~_among(long, x.begun(target))[0]
                out[0].append(number[x.lo + x.own[live]])
                out[1].append(x.begun(wider)[live])
                out[2].append(x.begun(target)[live] if final else x.second(wider)[live])
                count += int(live.sum())
            if count >= SEND:  # texts come in small packs: rows in few
                yield from _send(*out, _by_hash, buckets)
                out, count = ([], [], []), 0
        yield from _send(*out, _by_hash, buckets)

    return run


def _remove(target: int, long: np.ndarray, least: np.ndarray):
    def run(batches):
        for batch, alive in _with_survivors(batches):
            ids = batch.column("doc_id").to_pylist()
            lowest = np.iinfo(np.int64).min
            number = np.array([lowest if i is None else i for i in ids], np.int64)
            n_words, n_removed, digests, texts = [], [], [], []
            for x in _slices(batch, target):
                keys = x.begun(target)
                gone = x.alive(keys, ids, alive)
                hot, place = _among(long, keys)
                gone[hot] |= number[x.lo + x.own[hot]] > least[place[hot]]
                hit = x.at[gone]
                n = len(x.starts)
                edge = np.bincount(hit, minlength=n + 1) - np.bincount(
                    hit + target, minlength=n + 1
                )
                keep = np.cumsum(edge[:n]) == 0
                text, sizes = _joined(x.data, x.starts[keep], x.ends[keep])
                kept = np.concatenate([[0], np.cumsum(keep)])[x.first]
                at = np.concatenate([[0], np.cumsum(sizes)])[kept].tolist()
                total = np.diff(x.first)
                n_words.append(total)
                n_removed.append(total - np.diff(kept))
                for a, b in zip(at, at[1:]):
                    own = text[a : max(a, b - 1)]
                    digests.append(hashlib.sha256(own).hexdigest())
                    texts.append(own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.concatenate(n_words or [np.zeros(0, np.int64)])),
                    pa.array(np.concatenate(n_removed or [np.zeros(0, np.int64)])),
                    pa.array(digests, pa.string()),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Each word followed by one space, and the words' sizes with it."""
    sizes = ends - starts + 1
    if len(starts) == 0:
        return b"", sizes
    at = np.cumsum(sizes)
    step = np.ones(int(at[-1]), np.int64)
    step[0] = starts[0]
    step[at[:-1]] = starts[1:] - ends[:-1]
    out = data[np.minimum(np.cumsum(step), len(data) - 1)]
    out[at - 1] = 32
    return out.tobytes(), sizes


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target: int = 13,
    start: int = 4,
    with_text: bool = True,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and
    kept_text (the kept words joined by one space).

    A word goes if a window of ``target`` words over it also starts in a
    document of smaller id; windows are those of the input.  Null and wordless
    texts have no words.  Rows of null id neither remove nor lose words; rows
    that repeat an id do not remove each other's.  An empty table gives no
    rows.  Windows are told apart by 64 bits of a hash, and those of the last
    level by 64 bits more.
    """
    spark = docs.sparkSession
    n = partitions_for(docs, 16 << 20)
    buckets = partition_keys(spark, n)
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    steps = levels(min(start, target), target)
    placed = texts.mapInArrow(
        _packed_texts(buckets), "bucket int, docs binary, hashes binary, body binary"
    )

    def met(survivors: DataFrame) -> DataFrame:
        back = survivors.select("bucket", "docs", "hashes", F.lit(None).cast("binary").alias("body"))
        tagged = back.withColumn("tag", F.lit(0)).union(placed.withColumn("tag", F.lit(1)))
        return tagged.repartition(n, "bucket").sortWithinPartitions("bucket", "tag")

    def reduced(sent: DataFrame, final: bool) -> DataFrame:
        return sent.repartition(n, "bucket").mapInArrow(_repeated(buckets, final), PACKED)

    while len(steps) < 3:  # a short target: its own level is the one before, too
        steps.append(target)
    short, long, least = _hot(texts, steps[0], target)
    now = reduced(texts.mapInArrow(_first_level(steps[0], target, buckets, short), PACKED), False)
    for i, (k, wider) in enumerate(zip(steps, steps[1:-1])):
        final = i == len(steps) - 3
        now = reduced(
            met(now).mapInArrow(_next_level(k, wider, i == 0, target, buckets, final, short, long), PACKED), final
        )
    out = met(now).mapInArrow(
        _remove(target, long, least),
        "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string",
    )
    return out if with_text else out.drop("kept_text")
