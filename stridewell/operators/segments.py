"""Partition of a source at its cuts into half-open segments, and lookups."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridewell.functions import rational
from stridewell.operators.change import MIN_CHANGE, PIXEL
from stridewell.registry import query
from stridewell.sources.frames import by_frame, CHANGES, FRAMES, changes, frames

CUT = f"frame > 0 and mad >= {PIXEL}"


def numbered(m, cut: str = CUT):
    """Adds ``number``, the 1-based segment of each frame, as a running count
    of cuts; no range join."""
    return m.withColumn("number", F.sum(F.expr(f"if({cut}, 1, 0)")).over(by_frame()) + 1)


NUMBERED = f"""s AS (SELECT *, CAST(1 + sum(CASE WHEN {CUT} THEN 1 ELSE 0 END) OVER
 (PARTITION BY source_id ORDER BY frame) AS BIGINT) AS number FROM m)"""


def segments(m, cut: str = CUT):
    """One row per segment: number, frames [start_frame, end_frame), pts."""
    s = numbered(m, cut).groupBy("source_id", "number").agg(
        F.min("frame").alias("start_frame"),
        (F.max("frame") + 1).alias("end_frame"),
        F.count("*").alias("frame_count"),
        F.min("pts").alias("start_pts"),
        F.max_by("own", "frame").alias("stop"),
    )
    by_number = Window.partitionBy("source_id").orderBy("number")
    return s.withColumn("end_pts", F.coalesce(F.lead("start_pts").over(by_number), F.col("stop")))


SEGMENTS = f"""{NUMBERED}, g0 AS (SELECT source_id, number, min(frame) AS start_frame,
 max(frame) + 1 AS end_frame, count(*) AS frame_count, min(pts) AS start_pts,
 arg_max(own, frame) AS stop FROM s GROUP BY source_id, number), g AS (SELECT g0.*, coalesce(lead(start_pts) OVER
 (PARTITION BY source_id ORDER BY number), stop) AS end_pts FROM g0)"""


@query(f"""WITH {CHANGES}, {SEGMENTS} SELECT source_id, number, start_frame, end_frame,
 end_frame - 1 AS last_frame, frame_count, start_pts, end_pts,
 CAST(start_pts // gcd(start_pts, 1000000) AS VARCHAR) || '/' ||
 CAST(1000000 // gcd(start_pts, 1000000) AS VARCHAR) AS start_time,
 CAST((end_pts - start_pts) // gcd(end_pts - start_pts, 1000000) AS VARCHAR) || '/' ||
 CAST(1000000 // gcd(end_pts - start_pts, 1000000) AS VARCHAR) AS duration FROM g""")
def q14_scene_partition(spark, sf_dir):
    return segments(changes(spark, sf_dir)).selectExpr(
        "source_id",
        "number",
        "start_frame",
        "end_frame",
        "end_frame - 1 as last_frame",
        "frame_count",
        "start_pts",
        "end_pts",
        rational.text("start_pts", "1000000") + " as start_time",
        rational.text("end_pts - start_pts", "1000000") + " as duration",
    )


@query(f"""WITH {CHANGES}, {NUMBERED} SELECT source_id, number, count(*) AS n,
 min(cents) AS low, max(cents) AS high, CAST(sum(cents) AS BIGINT) AS total FROM s
 GROUP BY source_id, number""")
def q16_scene_of_frame(spark, sf_dir):
    return numbered(changes(spark, sf_dir)).groupBy("source_id", "number").agg(
        F.count("*").alias("n"),
        F.min("cents").alias("low"),
        F.max("cents").alias("high"),
        F.sum("cents").alias("total"),
    )


@query(f"""WITH {CHANGES}, {SEGMENTS}, k AS (SELECT source_id, frame AS key FROM f WHERE is_key)
 SELECT g.source_id, g.number, g.start_frame, coalesce(max(k.key), 0) AS key_frame FROM g
 LEFT JOIN k ON k.source_id = g.source_id AND k.key <= g.start_frame
 GROUP BY g.source_id, g.number, g.start_frame""")
def q17_keyframe_asof(spark, sf_dir):
    """Greatest key frame at or before each segment's start, by a window."""
    m = changes(spark, sf_dir).withColumn(
        "key_frame",
        F.coalesce(F.last(F.when(F.col("is_key"), F.col("frame")), True).over(by_frame()), F.lit(0)),
    )
    first = numbered(m).groupBy("source_id", "number").agg(
        F.min(F.struct("frame", "key_frame")).alias("x")
    )
    return first.select(
        "source_id", "number", F.col("x.frame").alias("start_frame"), F.col("x.key_frame").cast("long").alias("key_frame")
    )


@query(f"""WITH {CHANGES}, {SEGMENTS}, n AS (SELECT source_id, count(*) AS n FROM f GROUP BY 1),
 k AS (SELECT source_id, frame FROM f WHERE is_key)
 SELECT g.source_id, g.number, EXISTS (SELECT 1 FROM k WHERE k.source_id = g.source_id AND
 k.frame = g.start_frame) AND (g.end_frame = n.n OR EXISTS (SELECT 1 FROM k WHERE
 k.source_id = g.source_id AND k.frame = g.end_frame)) AS aligned FROM g JOIN n USING (source_id)""")
def q18_keyframe_aligned(spark, sf_dir):
    m = changes(spark, sf_dir).withColumn("next_key", F.coalesce(F.lead("is_key").over(by_frame()), F.lit(True)))
    edge = numbered(m).groupBy("source_id", "number").agg(
        F.min_by("is_key", "frame").alias("a"), F.max_by("next_key", "frame").alias("b")
    )
    return edge.select("source_id", "number", (F.col("a") & F.col("b")).alias("aligned"))


@query(f"""WITH {FRAMES}, w AS (SELECT DISTINCT source_id, x AS frame FROM (SELECT DISTINCT source_id
 FROM f), (SELECT unnest([0, 7, 8, 60, 89]) AS x)) SELECT w.source_id, CAST(w.frame AS BIGINT) AS frame, f.pts,
 f.pts IS NULL AS missing FROM w LEFT JOIN f ON f.source_id = w.source_id AND f.frame = w.frame""")
def q21_sparse_scan(spark, sf_dir):
    """Chosen ordinals of every source, and which of them are missing."""
    wanted = [0, 7, 8, 60, 89]
    f = frames(spark, sf_dir)
    asked = f.select("source_id").distinct().select(
        "source_id", F.explode(F.array(*(F.lit(x).cast("long") for x in wanted))).alias("frame")
    )
    found = f.where(F.col("frame").isin(wanted)).select("source_id", "frame", "pts")
    return asked.join(found, ["source_id", "frame"], "left").withColumn(
        "missing", F.col("pts").isNull()
    )


@query(f"""WITH {CHANGES}, {SEGMENTS} SELECT source_id, sha256('[' || string_agg('[' || start_frame
 || ',' || end_frame || ']', ',' ORDER BY number) || ']') AS digest FROM g GROUP BY source_id""")
def q32_canonical_digest(spark, sf_dir):
    g = segments(changes(spark, sf_dir)).select(
        "source_id", F.struct("number", "start_frame", "end_frame").alias("s")
    )
    said = F.expr(
        "concat('[', array_join(transform(array_sort(collect_list(s)), x -> concat('[',"
        " x.start_frame, ',', x.end_frame, ']')), ','), ']')"
    )
    return g.groupBy("source_id").agg(F.sha2(said, 256).alias("digest"))


@query(f"""WITH {CHANGES}, {SEGMENTS} SELECT source_id, number, CAST(coalesce(sum(frame_count) OVER
 (PARTITION BY source_id ORDER BY number DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
 AS BIGINT) AS at_frame, frame_count FROM g WHERE number % 2 = 1""")
def q44_ordered_concat(spark, sf_dir):
    """Odd segments laid end to end, last first: where each begins."""
    back = Window.partitionBy("source_id").orderBy(F.desc("number")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    g = segments(changes(spark, sf_dir)).where("number % 2 = 1")
    return g.select(
        "source_id",
        "number",
        F.coalesce(F.sum("frame_count").over(back), F.lit(0)).alias("at_frame"),
        "frame_count",
    )


@query(f"""WITH {CHANGES}, {SEGMENTS}, t AS (SELECT source_id, count(*) AS n FROM f GROUP BY 1),
 e AS (SELECT g.*, lag(end_frame) OVER (PARTITION BY source_id ORDER BY number) AS before,
 lead(number) OVER (PARTITION BY source_id ORDER BY number) AS after, n FROM g JOIN t USING (source_id))
 SELECT source_id, number, 'gap' AS violation FROM e WHERE coalesce(before, 0) <> start_frame
 UNION ALL SELECT source_id, number, 'end' FROM e WHERE after IS NULL AND end_frame <> n
 UNION ALL SELECT source_id, number, 'short' FROM e WHERE frame_count < 2""")
def q46_segment_bounds_validate(spark, sf_dir):
    """Rows that break the partition's rules; single frames are told too."""
    w = Window.partitionBy("source_id")
    e = segments(changes(spark, sf_dir)).select(
        "*",
        F.lag("end_frame").over(w.orderBy("number")).alias("before"),
        F.lead("number").over(w.orderBy("number")).alias("after"),
        F.sum("frame_count").over(w).alias("n"),
    )
    rules = F.expr(
        "filter(array(if(coalesce(before, 0) <> start_frame, 'gap', null),"
        " if(after is null and end_frame <> n, 'end', null), if(frame_count < 2, 'short', null)),"
        " x -> x is not null)"
    )
    return e.select("source_id", "number", F.explode(rules).alias("violation"))


@query(f"""WITH {CHANGES}, n AS (SELECT source_id, count(*) AS n FROM f GROUP BY 1)
 SELECT DISTINCT m.source_id, CAST(m.frame + d AS BIGINT) AS frame FROM m JOIN n USING (source_id),
 (SELECT unnest([-2, -1, 0, 1]) AS d) WHERE m.frame > 0 AND m.mad >= {MIN_CHANGE}
 AND m.frame + d BETWEEN 0 AND n.n - 1""")
def q47_thumbnail_requests(spark, sf_dir):
    m = changes(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("source_id")))
    near = m.where((F.col("frame") > 0) & (F.col("mad") >= MIN_CHANGE)).select(
        "source_id", "n", F.explode(F.expr("sequence(frame - 2, frame + 1)")).alias("frame")
    )
    return near.where("frame between 0 and n - 1").select("source_id", "frame").distinct()
