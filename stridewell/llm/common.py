"""Shared pieces: the scratch store on the cluster's shared folder, and
vectorised tokenising and hashing of whole Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# scratch tables


class Scratch:
    """Tables written to the shared folder named by ``spark.checkpoint.dir``.

    Writing a table cuts the lineage and survives lost executors.  Where the
    setting is absent a folder of our own is set in local mode (tests in one
    process); on a cluster that is an error, as executors could not read it.
    """

    def __init__(self, spark: SparkSession, label: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="stridewell-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark = spark
        self.root = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing will read any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the scan below ``df``; where it has none
    (rows that come from an RDD), 1 KB a row from a count."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 56 else df.count() << 10


def partitions_for(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Partitions so that each holds about ``bytes_each`` of stored input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(200_000, -(-input_bytes(df) // bytes_each)))


#: Range of the ranks by which samples are drawn, and by how much more rows than
#: wanted pass the threshold.
RANKS, MARGIN = 1 << 40, 4


def low_ranks(df: DataFrame, hash_: Column, most: int) -> DataFrame:
    """Rows of ``df`` with ``rank`` (of the hash), without most of those that are
    not among the ``most`` lowest: the threshold follows from the number of rows.
    So what is sorted afterwards does not grow with the table."""
    share = min(1.0, MARGIN * most / max(1, df.count()))
    ranked = df.withColumn("rank", F.pmod(hash_, F.lit(RANKS)))
    return ranked.where(F.col("rank") < int(share * RANKS))


def partition_keys(spark: SparkSession, n: int) -> np.ndarray:
    """Ints of which the k-th goes to partition k of ``repartition(n, key)``:
    buckets named so are dealt one to a partition, where hashes of their numbers
    would meet in some and miss others."""
    tried = n * (12 + n.bit_length())
    while True:
        ids = spark.range(tried).select(F.col("id").cast("int").alias("key"))
        first = ids.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("at")).agg(F.min("key").alias("key"))
        rows = first.orderBy("at").collect()  # n rows
        if len(rows) == n:
            return np.array([r.key for r in rows], np.int32)
        tried *= 2


#: Tasks among which the sums of all tasks are added, and arrays sent to the driver.
ADDERS = 16


def totals(df: DataFrame, count: Callable[[pa.RecordBatch], np.ndarray], kind: type = np.int64) -> np.ndarray | None:
    """Sum of the arrays (of type ``kind``, one length) that ``count`` makes of
    the Arrow batches of ``df``; None without rows.  Tasks send one array each:
    where they are more than ADDERS, as many tasks add these in the order of
    their numbers first; the driver adds the rest."""

    def own(batches):
        sums = None
        for batch in batches:
            if batch.num_rows:
                part = count(batch).astype(kind)
                sums = part if sums is None else sums + part
        if sums is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"key": [part % ADDERS], "part": [part], "sums": [sums.tobytes()]}, kinds)

    def add(batches):
        sums = None
        for batch in batches:
            for x in batch.column("sums"):
                part = np.frombuffer(x.as_buffer(), kind)
                sums = part if sums is None else sums + part
        if sums is not None:
            yield pa.RecordBatch.from_pydict({"sums": [sums.tobytes()]})

    kinds = pa.schema([("key", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])
    sums = df.mapInArrow(own, "key int, part int, sums binary")
    if df.rdd.getNumPartitions() > ADDERS:
        sums = sums.repartition(ADDERS, "key").sortWithinPartitions("part").mapInArrow(add, "sums binary")
    rows = sums.select("sums").collect()  # ADDERS at most
    return sum(np.frombuffer(bytes(r.sums), kind) for r in rows) if rows else None


# --------------------------------------------------------------------------
# decisions on rows


def row_key(id_: Column, text: Column, *more: Column) -> Column:
    """63-bit hash of a row's id and text (null as empty), and of what else
    decides on it: repeated and null ids are told apart by it."""
    parts = [F.coalesce(x.cast("string"), F.lit("")) for x in (text, *more)]
    return F.shiftrightunsigned(F.xxhash64(id_.cast("long"), F.xxhash64(*parts)), 1)


def _met(docs: DataFrame, rows: DataFrame, key: Column, id_col: str, how: str) -> DataFrame:
    rows = rows.select(F.col("doc_id").alias("_id"), F.col("key").alias("_gone")).distinct()
    same = (key == rows["_gone"]) & docs[id_col].cast("long").eqNullSafe(rows["_id"])
    return docs.join(rows, same, how)


def without(docs: DataFrame, bad: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose id (null-safe) and ``key`` are among the
    (doc_id, key) of ``bad``."""
    return _met(docs, bad, key, id_col, "left_anti")


def among(docs: DataFrame, good: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows that without() takes away."""
    return _met(docs, good, key, id_col, "left_semi")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --------------------------------------------------------------------------
# Arrow text columns as byte arrays


def text_slices(
    column: pa.Array, max_bytes: int = 2 << 20
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) of runs of whole texts of at
    most ``max_bytes`` (one text at least).  Null texts have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table over bytes: true inside the ranges (ends included)."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes of a word `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(
    data: np.ndarray, offsets: np.ndarray, member: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of each text, and the first word of
    each text (one more entry than texts)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = member[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = offsets[1:]
    after[cut[cut > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# --------------------------------------------------------------------------
# hashing

U = np.uint64
_BASE = 0xC2B2AE3D27D4EB4F
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply, a bijection)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=U)


_VALUES = {seed: byte_values(seed) for seed in (1, 2)}


def word_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1
) -> np.ndarray:
    """64-bit hash of every word: a polynomial in random byte values, taken
    from prefix sums, so the cost is a few operations a byte."""
    if len(starts) == 0:
        return np.zeros(0, U)
    up, down = _power(len(data) + 1)
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum(_VALUES[seed][data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def gram_hashes(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    factors = np.random.default_rng(7000 + seed).integers(0, 1 << 63, k, dtype=U) | U(1)
    total = hashes[:n] * factors[0]
    for j in range(1, k):
        total += hashes[j : n + j] * factors[j]
    return mix(total)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w consecutive values (len - w + 1), by doubling."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    span, out = 1, values
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < w:
        out = np.minimum(out[: len(out) - (w - span)], out[w - span :])
    return out
