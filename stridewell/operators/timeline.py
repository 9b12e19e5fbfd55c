"""Timelines: summaries, durations, clocks and exact times."""

from pyspark.sql import functions as F

from stridewell.functions import rational
from stridewell.functions.lists import columns
from stridewell.registry import query
from stridewell.sources.frames import FRAMES, by_frame, frames, turns, whole

@query(f"""WITH {FRAMES} SELECT source_id, count(*) AS frame_count, min(pts) AS first_pts,
 max(pts) AS last_pts, arg_max(own, frame) AS end_pts,
 CAST((arg_max(own, frame) - min(pts)) // gcd(arg_max(own, frame) - min(pts), 1000000) AS BIGINT) AS num,
 CAST(1000000 // gcd(arg_max(own, frame) - min(pts), 1000000) AS BIGINT) AS den
 FROM f GROUP BY source_id""")
def q01_timeline_summary(spark, sf_dir):
    f = frames(spark, sf_dir).groupBy("source_id").agg(
        F.count("*").alias("frame_count"),
        F.min("pts").alias("first_pts"),
        F.max("pts").alias("last_pts"),
        F.max_by("own", "frame").alias("end_pts"),
    )
    common = rational.gcd("end_pts - first_pts", "1000000")
    return f.selectExpr(
        "*", f"(end_pts - first_pts) div {common} as num", f"1000000 div {common} as den"
    )


@query(f"""WITH {FRAMES} SELECT source_id, frame, pts,
 coalesce(lead(pts) OVER (PARTITION BY source_id ORDER BY frame), own) - pts AS duration
 FROM f""")
def q02_frame_durations(spark, sf_dir):
    f = frames(spark, sf_dir)
    after = F.coalesce(F.lead("pts").over(by_frame()), F.col("own"))
    return f.select("source_id", "frame", "pts", (after - F.col("pts")).alias("duration"))


@query(f"""WITH {FRAMES}, p AS (SELECT source_id, frame, CASE WHEN frame % 17 = 5 THEN
 lag(pts) OVER (PARTITION BY source_id ORDER BY frame) ELSE pts END AS pts FROM f)
 SELECT source_id, frame, 'pts-not-increasing' AS violation FROM (SELECT *,
 lag(pts) OVER (PARTITION BY source_id ORDER BY frame) AS before FROM p) WHERE pts <= before""")
def q03_timeline_violations(spark, sf_dir):
    f = frames(spark, sf_dir)
    # Perturbed on purpose: some frames take the time of the one before.
    bent = F.when(F.col("frame") % 17 == 5, F.lag("pts").over(by_frame())).otherwise(F.col("pts"))
    f = f.select("source_id", "frame", bent.alias("pts"))
    return (
        f.withColumn("before", F.lag("pts").over(by_frame()))
        .where("pts <= before")
        .select("source_id", "frame", F.lit("pts-not-increasing").alias("violation"))
    )


@query(f"""WITH {FRAMES}, x AS (SELECT source_id, frame, pts - first_value(pts) OVER
 (PARTITION BY source_id ORDER BY frame) - 500 * (frame % 7) AS rel FROM f),
 y AS (SELECT *, CAST(round_even(CAST(abs(rel) AS DECIMAL(20,0)) / 1000, 0) AS BIGINT) AS ms FROM x)
 SELECT source_id, frame, (CASE WHEN rel < 0 THEN '-' ELSE '' END)
 || lpad(CAST(ms // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST(ms // 3600000 AS VARCHAR))) AS INTEGER), '0')
 || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':'
 || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.'
 || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS shown FROM y""")
def q15_display_time(spark, sf_dir):
    f = frames(spark, sf_dir)
    rel = F.col("pts") - F.first("pts").over(by_frame()) - 500 * (F.col("frame") % 7)
    ms = F.expr("cast(bround(cast(abs(rel) as decimal(20,0)) / 1000, 0) as bigint)")
    return f.select("source_id", "frame", rel.alias("rel")).withColumn("ms", ms).selectExpr(
        "source_id",
        "frame",
        "concat(if(rel < 0, '-', ''), lpad(cast(ms div 3600000 as string),"
        " greatest(2, length(cast(ms div 3600000 as string))), '0'), ':',"
        " lpad(cast(ms div 60000 % 60 as string), 2, '0'), ':',"
        " lpad(cast(ms div 1000 % 60 as string), 2, '0'), '.',"
        " lpad(cast(ms % 1000 as string), 3, '0')) as shown",
    )


@query(f"""WITH {FRAMES}, g AS (SELECT source_id, frame, pts, min(pts) OVER w AS p0, max(pts) OVER w
 AS p1, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY source_id))
 SELECT source_id, CASE WHEN bool_and(abs((pts - p0) * (n - 1) - frame * (p1 - p0)) <= n - 1)
 THEN 'constant' ELSE 'variable' END AS timing FROM g GROUP BY source_id""")
def q19_timing_class(spark, sf_dir):
    """Constant if every time is within one tick of its place at the mean rate,
    by cross-multiplication."""
    g = frames(spark, sf_dir).select(
        "source_id",
        "frame",
        "pts",
        F.min("pts").over(whole()).alias("p0"),
        F.max("pts").over(whole()).alias("p1"),
        F.count("*").over(whole()).alias("n"),
    )
    even = F.expr("bool_and(abs((pts - p0) * (n - 1) - frame * (p1 - p0)) <= n - 1)")
    return g.groupBy("source_id").agg(
        F.when(even, "constant").otherwise("variable").alias("timing")
    )


@query(f"""WITH {FRAMES} SELECT source_id, CAST(lcm(any_value(c), 48000) AS BIGINT) AS timescale
 FROM (SELECT source_id, count(*) OVER (PARTITION BY source_id) * 90 AS c FROM f)
 GROUP BY source_id HAVING lcm(any_value(c), 48000) <= 2147483647""")
def q49_lcm_timescale(spark, sf_dir):
    counts = frames(spark, sf_dir).groupBy("source_id").agg((F.count("*") * 90).alias("c"))
    return counts.selectExpr(
        "source_id", rational.lcm("c", "cast(48000 as bigint)") + " as timescale"
    ).where("timescale <= 2147483647")


#: Native properties of each frame, with changes, interlacing and late markers.
NATIVE = """source_id, frame, CASE WHEN source_id % 6 = 1 AND frame > 30 THEN 1280 ELSE 1920 END AS width, 1080 AS height,
 CASE WHEN source_id % 6 = 2 AND k = 7 THEN 'yuv422p' ELSE 'yuv420p' END AS pix_fmt, source_id % 6 = 3 AND k = 11 AS interlaced,
 CASE WHEN source_id % 5 = 0 THEN NULL ELSE 'tv' END AS color_range, 'bt709' AS color_space, 'bt709' AS color_primaries,
 CASE WHEN source_id % 6 = 4 AND frame = 20 THEN 'smpte2084' ELSE 'bt709' END AS color_transfer, CASE WHEN source_id % 12 = 5 AND k = 13
 THEN 'Dynamic HDR' ELSE '' END AS side"""
PROPERTIES = "width, height, pix_fmt, color_range, color_space, color_primaries, color_transfer"
HEADER = "CASE WHEN source_id % 12 = 6 THEN 1279 ELSE 1920 END"


@query(f"""WITH {FRAMES}, na AS (SELECT {NATIVE} FROM f), st AS (SELECT *, concat_ws('|', {", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in PROPERTIES.split(", "))})
 AS said, color_transfer IN ('smpte2084', 'arib-std-b67') OR lower(side) LIKE '%hdr%' AS hdr FROM na),
 fi AS (SELECT *, first_value(said) OVER (PARTITION BY source_id ORDER BY frame) AS first FROM st), g AS (SELECT source_id, count(*) AS audited,
 min(frame) FILTER (hdr) AS first_hdr, min(frame) FILTER (interlaced) AS first_interlaced, min(frame) FILTER (said <> first) AS first_other,
 arg_min(width, frame) AS width, any_value(first) AS first FROM fi GROUP BY source_id) SELECT source_id, audited, first_hdr, first_interlaced,
 first_other, first_hdr IS NULL AND first_interlaced IS NULL AND first_other IS NULL AS constant, width = {HEADER} AS header_agrees, first
 AS properties FROM g""")
def q28_property_constancy(spark, sf_dir):
    """Every frame's native properties against the first one's: the first frame
    that is of high dynamic range, interlaced or otherwise different, and
    whether the header says the same."""
    n = frames(spark, sf_dir).selectExpr(*columns(NATIVE))
    said = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in PROPERTIES.split(", ")))
    hdr = F.expr("color_transfer in ('smpte2084', 'arib-std-b67') or lower(side) like '%hdr%'")
    n = n.select("*", said.alias("said"), hdr.alias("hdr")).withColumn("first", F.first("said").over(by_frame()))
    at = lambda c: F.min(F.when(F.expr(c), F.col("frame")))
    g = n.groupBy("source_id").agg(
        F.count("*").alias("audited"),
        at("hdr").alias("first_hdr"),
        at("interlaced").alias("first_interlaced"),
        at("said <> first").alias("first_other"),
        F.min_by("width", "frame").alias("width"),
        F.min_by("said", "frame").alias("properties"),
    )
    return g.selectExpr(
        "source_id", "audited", "first_hdr", "first_interlaced", "first_other",
        "first_hdr is null and first_interlaced is null and first_other is null as constant",
        f"width = {HEADER} as header_agrees", "properties",
    )


#: The metadata side of a scan, beside the pictures, with faults in some sources.
SIDE = """source_id, frame AS n, pts, CASE WHEN source_id % 7 = 1 AND frame = 9 THEN frame + 1 ELSE frame END AS told,
 CASE WHEN source_id % 7 = 2 AND frame > 12 THEN '1/90000' ELSE '1/1000000' END AS tb"""
SCANNED = """CASE WHEN n IS NULL THEN 'no metadata' WHEN bytes IS NULL THEN 'no picture' WHEN told <> n THEN 'ordinal' WHEN tb <> '1/1000000'
 THEN 'time base' WHEN bytes <> 300 THEN 'truncated' END"""


@query(f"""WITH {FRAMES}, si AS (SELECT {SIDE} FROM f WHERE NOT (source_id % 7 = 3 AND frame = 5)), pi AS (SELECT source_id, frame,
 CASE WHEN source_id % 7 = 4 AND frame = 8 THEN 299 ELSE 300 END AS bytes FROM f WHERE NOT (source_id % 7 = 5 AND frame = 6)),
 j AS (SELECT coalesce(pi.source_id, si.source_id) AS source_id, coalesce(pi.frame, si.n) AS frame, n, told, tb, bytes FROM pi FULL JOIN si
 ON si.source_id = pi.source_id AND si.n = pi.frame), e AS (SELECT *, {SCANNED} AS error FROM j) SELECT source_id, count(n) AS metadata,
 count(bytes) AS pictures, min(frame) FILTER (error IS NOT NULL) AS first_error, arg_min(error, frame) FILTER (error IS NOT NULL) AS error
 FROM e GROUP BY source_id""")
def q108_full_scan(spark, sf_dir):
    """Pictures and their metadata joined by place, none lost on either side:
    how many of each, and the first fault."""
    f = frames(spark, sf_dir)
    side = f.where("not (source_id % 7 = 3 and frame = 5)").selectExpr(*columns(SIDE)).withColumn("frame", F.col("n"))
    pictures = f.where("not (source_id % 7 = 5 and frame = 6)").selectExpr(
        "source_id", "frame", "if(source_id % 7 = 4 and frame = 8, 299, 300) as bytes"
    )
    j = pictures.join(side, ["source_id", "frame"], "full").withColumn("error", F.expr(SCANNED))
    fault = F.when(F.col("error").isNotNull(), F.col("frame"))
    return j.groupBy("source_id").agg(
        F.count("n").alias("metadata"), F.count("bytes").alias("pictures"),
        F.min(fault).alias("first_error"), F.min_by("error", fault).alias("error"),
    )


@query(f"""WITH {FRAMES} SELECT source_id, frame, pts FROM f WHERE frame >= 10 AND frame < 14""")
def q109_frame_range(spark, sf_dir):
    """A half-open range of frames."""
    return frames(spark, sf_dir).where("frame >= 10 and frame < 14").select("source_id", "frame", "pts")


@query("""SELECT conv_id AS source_id, sha256(string_agg(sha256(text), '' ORDER BY turn)) AS digest
 FROM conversations GROUP BY conv_id""")
def q31_ordered_digest(spark, sf_dir):
    t = turns(spark, sf_dir).select("source_id", F.struct("frame", F.sha2("text", 256).alias("h")).alias("s"))
    return t.groupBy("source_id").agg(
        F.sha2(
            F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["h"]), ""), 256
        ).alias("digest")
    )
