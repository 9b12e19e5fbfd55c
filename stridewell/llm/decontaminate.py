"""Benchmark decontamination by winnowing.

Of every `window - gram + 1` consecutive word grams the least hash is kept, on
both sides, so any shared span of `window` words shares a fingerprint.  Test
fingerprints meet training fingerprints in an equi-join.  A document that holds
one takes its text along; the places of its hits are looked up again, and each
hit is extended to the windows around it, compared on the words themselves.  All
steps are built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridewell.llm.common import Scratch, without

#: Bytes between words: all ASCII but 0-9 and a-z (after lower-casing A-Z).
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fingerprints and windows of the benchmark up to this count are broadcast
#: and these bytes are broadcast; more meet by a shuffled join.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def _folded() -> F.Column:
    """Lower case for fingerprints, three times as fast as the exact rule.
    Texts equal under the exact rule are equal under it: it works character by
    character once the one letter with a final form is replaced."""
    return F.lower(F.replace(F.col("text"), F.lit("\u03a3"), F.lit("\u03c3")))


def _words(lowered) -> F.Column:
    return F.array_remove(F.split(lowered, BREAKS, -1), "")


def _grams(hashes: str, n: int) -> str:
    parts = ", ".join(f"get({hashes}, i + {j})" for j in range(1, n))
    return f"transform(slice({hashes}, 1, size({hashes}) - {n - 1}), (h, i) -> xxhash64({n}, h{', ' if parts else ''}{parts}))"


def _fingerprints(frame: DataFrame, window: int, gram: int, short: list[int]) -> DataFrame:
    """Adds ``fps``: distinct winnowed gram hashes of ``w``, and all gram
    hashes of the lengths of short items."""
    span = window - gram + 1
    least = ", ".join(["h", *(f"get(grams, i + {j})" for j in range(1, span))])
    picked = f"transform(slice(grams, 1, size(grams) - {span - 1}), (h, i) -> least({least}))"
    out = frame.withColumn("hashes", F.expr("transform(w, x -> xxhash64(x))"))
    out = out.withColumn(
        "grams",
        F.expr(
            f"if(size(w) >= {window}, {_grams('hashes', gram)}, cast(array() as array<bigint>))"
        ),
    )
    lists = [f"if(size(w) >= {window}, {picked}, cast(array() as array<bigint>))"]
    lists += [
        f"if(size(w) >= {n}, {_grams('hashes', n)}, cast(array() as array<bigint>))" for n in short
    ]
    return out.withColumn("fps", F.expr(f"array_distinct(concat({', '.join(lists)}))"))


_PLACED = "array<struct<at:int,n:int,{}>>"


def _windows(n: int) -> str:
    """Every window of n words of ``w``, with its place."""
    return (
        f"if(size(w) >= {n}, transform(sequence(0, size(w) - {n}), i -> named_struct('at', i,"
        f" 'n', {n}, 'text', array_join(slice(w, i + 1, {n}), ' '))),"
        f" cast(array() as {_PLACED.format('text:string')}))"
    )


def _placed(hashes: str, gram: int, n: int) -> str:
    """Every gram's hash with its place, for windows of n words."""
    return (
        f"if(size(w) >= {n}, transform({_grams(hashes, gram)}, (h, i) -> named_struct('at', i, 'n', {n},"
        f" 'fp', h)), cast(array() as {_PLACED.format('fp:bigint')}))"
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 10,
    gram: int = 4,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated.

    An item of fewer than ``window`` words, but not none, is one window.  Null
    texts have no words; null ids, repeated rows and repeated ids (told apart
    by their text) stay; an empty benchmark hits nothing; an empty table gives
    no rows.
    """
    return _contamination(docs, benchmark, id_col, text_col, window, gram).drop("version")


def _contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 10,
    gram: int = 4,
) -> DataFrame:
    """contamination() with ``version``, the hash of each row's text."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    exact = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    items = benchmark.select(
        "item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    items = items.select(
        "item_id", _words(exact).alias("w"), _words(_folded()).alias("folded")
    ).where("size(w) > 0")
    items = scratch.table(items, "items")
    short = sorted(
        r[0] for r in items.where(f"size(w) < {window}").select(F.size("w")).distinct().collect()
    )  # at most window - 1 lengths
    lengths = [window, *short]

    def bounded(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
        """A broadcast if rows and bytes of the table allow it, and whether."""
        df = scratch.table(df, name)
        size = df.agg(F.count("*"), F.sum(sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns)))
        rows, width = size.first()
        small = rows <= BROADCAST_ROWS and (width or 0) <= BROADCAST_BYTES
        return (F.broadcast(df) if small else df), small

    prints, small = bounded(
        _fingerprints(items.select(F.col("folded").alias("w")), window, gram, short)
        # explode would infer a filter that repeats the expression below it in
        # every step of the loops above; explode_outer does not.
        .select(F.explode_outer("fps").alias("fp"))
        .where("fp is not null")
        .distinct()
        .withColumn("met", F.lit(1)),
        "prints",
    )
    own = F.expr(f"if(size(w) < {window}, size(w), {window})")
    spans, _ = bounded(
        items.withColumn("own", own)
        .select("item_id", "own", F.explode_outer(F.expr(f"concat({', '.join(map(_windows, lengths))})")).alias("s"))
        .where("s.n = own")
        .select("item_id", F.col("s.n").alias("n"), F.col("s.text").alias("span"))
        .distinct(),
        "spans",
    )

    raw = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("version", F.xxhash64("text"))
    key = ["doc_id", "version"]
    lane = raw.select(
        F.monotonically_increasing_id().alias("row"), *key, "text", _words(_folded()).alias("w")
    )
    lane = _fingerprints(lane, window, gram, short).select(
        "row", *key, "text", F.size("w").cast("long").alias("n_words"), "fps"
    )
    # A row's first fingerprint stands for the row; the others stay only where
    # they meet the benchmark, and then with the text.
    own_row = ["row", *key, "n_words"]
    met = lane.select(*own_row, "text", F.posexplode_outer("fps").alias("k", "fp"))
    if not small:  # the join is shuffled: texts are fetched afterwards instead
        met = met.withColumn("text", F.lit(None).cast("string"))
    met = met.join(prints, "fp", "left").where("met = 1 or k is null or k = 0")
    scored = scratch.table(
        met.groupBy(*own_row).agg(
            F.max("met").alias("met"), F.first(F.when(F.col("met") == 1, F.col("text")), True).alias("text")
        ),
        "scored",
    )
    held = scored.where("met = 1").select("row", *key, "text")
    if not small:
        whole = raw.dropDuplicates(key)
        same = (held["version"] == whole["version"]) & held["doc_id"].eqNullSafe(whole["doc_id"])
        held = held.drop("text").join(whole, same).select("row", whole["text"])
    # Places of hits, and the windows around them only.
    placed = [_placed("hashes", gram, window), *(_placed("hashes", n, n) for n in short)]
    places = held.select("row", _words(_folded()).alias("w")).withColumn(
        "hashes", F.expr("transform(w, x -> xxhash64(x))")
    )
    places = (
        places.select("row", F.explode_outer(F.expr(f"concat({', '.join(placed)})")).alias("g"))
        .select("row", "g.at", "g.n", F.col("g.fp").alias("fp"))
        .join(prints, "fp")
        .groupBy("row")
        .agg(F.collect_set(F.struct("at", "n")).alias("places"))  # of one document
    )
    near = (
        f"array_distinct(flatten(transform(places, p -> transform(sequence(if(p.n = {window}, greatest(0,"
        f" p.at - {window - gram}), p.at), least(p.at, size(w) - p.n)), i -> named_struct('at', i, 'n', p.n)))))"
    )
    around = (
        held.select("row", _words(exact).alias("w"))
        .join(places, "row")
        .withColumn("near", F.expr(near))
        .select("row", F.expr(
            "transform(near, x -> named_struct('at', x.at, 'n', x.n, 'text', array_join(slice(w, x.at + 1, x.n), ' ')))"
        ).alias("s"))
    )
    hits = (
        around.select("row", F.explode_outer("s").alias("s"))
        .select("row", F.col("s.at").alias("at"), F.col("s.n").alias("n"), F.col("s.text").alias("span"))
        .join(spans, ["span", "n"])
        .select("row", "at", "n", "item_id")
    )
    per = hits.groupBy("row").agg(
        F.collect_set("item_id").alias("items"),
        F.expr("array_sort(collect_set(named_struct('at', at, 'n', n)))").alias("at"),
    )  # a document's own windows: as large as the document
    covered = (
        "aggregate(at, named_struct('hit', 0, 'end', 0), (a, x) -> named_struct("
        "'hit', a.hit + greatest(0, x.at + x.n - greatest(a.end, x.at)),"
        " 'end', greatest(a.end, x.at + x.n)), a -> a.hit)"
    )
    per = per.select(
        "row",
        F.expr(covered).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.expr("array_join(array_sort(transform(items, x -> cast(x as string))), ',')").alias("said"),
    )
    return scored.drop("text").join(per, "row", "left").select(
        "doc_id",
        "version",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("said", F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window."""
    bad = _contamination(docs, benchmark, **options).where("contaminated")
    text = F.coalesce(F.col(options.get("text_col", "text")).cast("string"), F.lit(""))
    bad = bad.withColumnRenamed("version", "key")
    return without(docs, bad, F.xxhash64(text), options.get("id_col", "doc_id"))
