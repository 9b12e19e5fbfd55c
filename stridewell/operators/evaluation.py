"""Predicted against reference boundaries, one to one.

With a tolerance, a source's boundaries fall into islands: where neighbours on
either side are further apart than the tolerance, no pair can cross.  Islands
are solved on their own, so a long source is not one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridewell.operators.change import ADAPTIVE_CUT, ADAPTIVE_SQL, PIXEL_SQL, adaptive, pixel_cuts
from stridewell.registry import query
from stridewell.sources.frames import CHANGES, changes, read

SECONDS = "(max_end - first_pts) / 1000000"
RATES = f"""round(fp * 3600 / ({SECONDS}), 6) AS fp_per_hour, round(fn * 3600 / ({SECONDS}), 6) AS fn_per_hour"""
#: Changes that a second detector reports again, so that there are repeats.
REPEATED = 20000
SPAN = "sp AS (SELECT source_id, min(pts) AS first_pts, max(own) AS max_end FROM m GROUP BY source_id)"


def boundaries(m):
    """(source_id, frame) of predictions, with repeats, and of references."""
    p = pixel_cuts(m).select("source_id", "frame")
    again = pixel_cuts(m).where(F.col("mad") >= REPEATED).select("source_id", "frame")
    return p.union(again), adaptive(m).where(ADAPTIVE_CUT).select("source_id", "frame")


def span(m):
    return m.groupBy("source_id").agg(F.min("pts").alias("first_pts"), F.max("own").alias("max_end"))


def rated(told: DataFrame, m: DataFrame) -> DataFrame:
    """tp, fp, fn with precision, recall, F1 (null without denominator) and
    rates an hour."""
    return told.join(span(m), "source_id").selectExpr(
        *told.columns,
        "round(try_divide(tp, tp + fp), 6) as precision",
        "round(try_divide(tp, tp + fn), 6) as recall",
        "round(try_divide(2 * tp, 2 * tp + fp + fn), 6) as f1",
        f"round(fp * 3600 / ({SECONDS}), 6) as fp_per_hour",
        f"round(fn * 3600 / ({SECONDS}), 6) as fn_per_hour",
    )


BOTH = f"""p0 AS ({PIXEL_SQL}), pp AS (SELECT * FROM p0 UNION ALL SELECT source_id, frame FROM m
 WHERE frame > 0 AND mad >= {REPEATED}), rr AS (SELECT source_id, frame FROM a WHERE {ADAPTIVE_CUT})"""
RATED = f"""round(tp * 1.0 / nullif(tp + fp, 0), 6)::DOUBLE AS precision,
 round(tp * 1.0 / nullif(tp + fn, 0), 6)::DOUBLE AS recall,
 round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6)::DOUBLE AS f1, {RATES}"""


@query(f"""WITH {CHANGES}, {ADAPTIVE_SQL}, {BOTH}, {SPAN},
 i AS (SELECT * FROM pp INTERSECT ALL SELECT * FROM rr), xp AS (SELECT * FROM pp EXCEPT ALL SELECT * FROM rr),
 xr AS (SELECT * FROM rr EXCEPT ALL SELECT * FROM pp), t AS (SELECT source_id,
 (SELECT count(*) FROM i WHERE i.source_id = sp.source_id) AS tp,
 (SELECT count(*) FROM xp WHERE xp.source_id = sp.source_id) AS fp,
 (SELECT count(*) FROM xr WHERE xr.source_id = sp.source_id) AS fn, first_pts, max_end FROM sp)
 SELECT source_id, tp, fp, fn, {RATED} FROM t WHERE tp + fp + fn > 0""")
def q22_exact_match_eval(spark, sf_dir):
    """Multiset intersection and differences of boundaries, counted without
    expanding them: of a frame's counts the smaller is matched."""
    m = changes(spark, sf_dir)
    return rated(counts(*boundaries(m), 0), m)


def islands(predicted: DataFrame, reference: DataFrame, tolerance: int) -> DataFrame:
    """(source_id, island, p, r): the sorted frames of each island."""
    both = predicted.select("source_id", "frame", F.lit(True).alias("mine")).union(
        reference.select("source_id", "frame", F.lit(False))
    )
    order = Window.partitionBy("source_id").orderBy("frame", "mine")
    apart = F.col("frame") - F.lag("frame").over(order) > tolerance
    told = both.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int"))
    told = told.withColumn("island", F.sum("apart").over(order))
    return told.groupBy("source_id", "island").agg(
        F.sort_array(F.collect_list(F.when(F.col("mine"), F.col("frame")))).alias("p"),
        F.sort_array(F.collect_list(F.when(~F.col("mine"), F.col("frame")))).alias("r"),
    )


#: Worth of a pair above any sum of distances.
WORTH = 1 << 32


def pair_up(p: list[int], r: list[int], tolerance: int) -> Iterator[tuple[int, int]]:
    """Pairs of two sorted lists: as many as can be, of these with the least
    total distance, never crossing.  Of several such sets the one that, read
    from the left, pairs earliest; where neither end can be paired in it, the
    prediction is passed over first if that loses nothing."""
    rest = [[0] * (len(r) + 1)]  # worth of what follows, last prediction first
    for a in reversed(p):
        after, row = rest[-1], [0] * (len(r) + 1)
        for j in range(len(r) - 1, -1, -1):
            row[j] = max(after[j], row[j + 1])
            if abs(a - r[j]) <= tolerance:
                row[j] = max(row[j], after[j + 1] + WORTH - abs(a - r[j]))
        rest.append(row)
    rest.reverse()
    i = j = 0
    while i < len(p) and j < len(r):
        gap = abs(p[i] - r[j])
        if gap <= tolerance and rest[i][j] == rest[i + 1][j + 1] + WORTH - gap:
            yield p[i], r[j]
            i, j = i + 1, j + 1
        elif rest[i + 1][j] == rest[i][j]:
            i += 1
        else:
            j += 1


def matched_pairs(predicted: DataFrame, reference: DataFrame, tolerance: int) -> DataFrame:
    """(source_id, predicted, reference, offset) of the pairs of pair_up()."""
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")

    def run(batches):
        for rows in batches:
            out = [
                (s, a, b, a - b)
                for s, p, r in zip(rows.source_id, rows.p, rows.r, strict=True)
                for a, b in pair_up(list(p), list(r), tolerance)
            ]
            yield pd.DataFrame(out, columns=["source_id", "predicted", "reference", "offset"])

    found = islands(predicted, reference, tolerance).where("size(p) > 0 and size(r) > 0")
    kind = "source_id long, predicted long, reference long, offset long"
    return found.select("source_id", "p", "r").mapInPandas(run, kind)


TOLERANCE = 2
#: References moved a little, so that exact frames do not settle it.
MOVED = "frame + frame % 4 - 1"


@query(f"""WITH {CHANGES}, {ADAPTIVE_SQL}, {BOTH}, {SPAN},
 l AS (SELECT sp.*, (SELECT coalesce(list(frame ORDER BY frame), []) FROM pp WHERE pp.source_id = sp.source_id) AS p,
 (SELECT coalesce(list(f ORDER BY f), []) FROM (SELECT source_id, {MOVED} AS f FROM rr) AS x
 WHERE x.source_id = sp.source_id) AS r FROM sp),
 w AS (SELECT *, list_reduce(list_concat([list_transform(range(0, len(r) + 1), lambda j: CAST(0 AS BIGINT))],
 list_transform(p, lambda a: [a])), lambda row, a: list_transform(range(1, len(r) + 2), lambda j: list_max(
 list_transform(range(1, j + 1), lambda h: greatest(row[h], CASE WHEN h > 1 AND abs(a[1] - r[h - 1]) <= {TOLERANCE}
 THEN row[h - 1] + {WORTH} - abs(a[1] - r[h - 1]) ELSE 0 END))))) AS last FROM l),
 v AS (SELECT *, last[len(r) + 1] AS worth FROM w), c AS (SELECT *, (worth + {WORTH - 1}) // {WORTH} AS tp FROM v),
 t AS (SELECT *, len(p) - tp AS fp, len(r) - tp AS fn, tp * {WORTH} - worth AS distance FROM c)
 SELECT source_id, tp, fp, fn, distance, {RATED} FROM t WHERE len(p) + len(r) > 0""")
def q23_tolerant_match_eval(spark, sf_dir):
    """Matches within two frames, as many as can be and then as near as can be:
    a fold over each island's predictions, whose row holds the worth of the
    best matching with the first references.  The SQL solves whole sources."""
    m = changes(spark, sf_dir)
    p, r = boundaries(m)
    r = r.selectExpr("source_id", f"{MOVED} as frame")
    return rated(counts(p, r, TOLERANCE), m)


def counts(p: DataFrame, r: DataFrame, tolerance: int) -> DataFrame:
    """(source_id, tp, fp, fn) of boundaries (source_id, frame), and the total
    distance of the matches where there is a tolerance."""
    if tolerance == 0:
        p = p.groupBy("source_id", "frame").agg(F.count("*").alias("np"))
        r = r.groupBy("source_id", "frame").agg(F.count("*").alias("nr"))
        n = p.join(r, ["source_id", "frame"], "full").na.fill(0, ["np", "nr"])
        return n.groupBy("source_id").agg(
            F.sum(F.least("np", "nr")).alias("tp"),
            F.sum(F.greatest(F.lit(0), F.col("np") - F.col("nr"))).alias("fp"),
            F.sum(F.greatest(F.lit(0), F.col("nr") - F.col("np"))).alias("fn"),
        )
    worth = (
        "element_at(aggregate(p, array_repeat(0L, size(r) + 1), (row, a) -> aggregate(sequence(1, size(r)),"
        " array(0L), (done, j) -> array_append(done, greatest(element_at(done, -1), row[j],"
        f" if(abs(a - r[j - 1]) <= {tolerance}, row[j - 1] + {WORTH} - abs(a - r[j - 1]), 0L))))), -1)"
    )
    some = f"if(size(p) = 0 or size(r) = 0, 0L, {worth})"
    return (
        islands(p, r, tolerance)
        .selectExpr("source_id", "size(p) as np", "size(r) as nr", f"{some} as worth")
        .withColumn("tp", F.expr(f"(worth + {WORTH - 1}) div {WORTH}"))
        .groupBy("source_id")
        .agg(
            F.sum("tp").alias("tp"),
            F.sum(F.col("np") - F.col("tp")).alias("fp"),
            F.sum(F.col("nr") - F.col("tp")).alias("fn"),
            F.sum(F.col("tp") * WORTH - F.col("worth")).alias("distance"),
        )
    )


LABELS = """lb AS (SELECT sha256(text) AS digest, max(quality) AS quality, count(*) AS n_labels FROM documents
 JOIN labels USING (doc_id) WHERE doc_id % 3 <> 1 GROUP BY 1)"""


@query(f"""WITH {LABELS}, d AS (SELECT doc_id, sha256(text) AS digest, count(*) OVER (PARTITION BY sha256(text)) AS n
 FROM documents) SELECT doc_id, CASE WHEN n > 1 THEN 'duplicate' WHEN lb.digest IS NULL THEN 'unlabelled'
 ELSE 'labelled' END AS state, CAST(quality AS BIGINT) AS quality FROM d LEFT JOIN lb USING (digest)""")
def q24_label_join_eval(spark, sf_dir):
    """Labels stored by content digest joined to documents by their digest;
    repeated content and documents without a label are told."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    labels = read(spark, sf_dir, "labels").where("doc_id % 3 <> 1").join(d, "doc_id")
    labels = labels.groupBy("digest").agg(F.max("quality").cast("long").alias("quality"), F.lit(True).alias("known"))
    many = d.groupBy("digest").agg((F.count("*") > 1).alias("many"))
    state = F.expr("case when many then 'duplicate' when known is null then 'unlabelled' else 'labelled' end")
    return d.join(many, "digest").join(labels, "digest", "left").select("doc_id", state.alias("state"), "quality")
