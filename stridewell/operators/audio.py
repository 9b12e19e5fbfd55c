"""Decoded sound against the picture's clock.

events stand for decoded audio frames: k + 1 samples each at 48 kHz, times in
samples with a little jitter; each source has tracks that begin late or stop
early.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridewell.functions.lists import columns
from stridewell.operators.segments import SEGMENTS, segments
from stridewell.registry import query
from stridewell.sources.frames import CHANGES, FRAMES, by_frame, changes, frames

RATE = 48000
#: Lines as a decoder writes them; the time is in samples.
LINE = """'[audio] n:' || frame || ' pts:' || (before + 1024 + cents % 3) || ' rate:48000 nb_samples:' || (k + 1)"""
LINES = f"""{FRAMES}, sm AS (SELECT source_id, frame, k, cents, coalesce(sum(k + 1) OVER (PARTITION BY source_id ORDER BY frame
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
 al AS (SELECT source_id, frame, {LINE} AS line FROM sm)"""


def lines(spark, sf_dir):
    before = F.sum(F.col("k") + 1).over(by_frame().rowsBetween(Window.unboundedPreceding, -1))
    f = frames(spark, sf_dir).withColumn("before", F.coalesce(before, F.lit(0)))
    return f.selectExpr("source_id", "frame", f"{LINE} as line")


PARTS = {"n": "n:(\\d+)", "pts": "pts:(-?\\d+)", "rate": "rate:(\\d+)", "samples": "nb_samples:(\\d+)"}
CLOCK = 90000


@query(f"""WITH {LINES}, p AS (SELECT source_id, {", ".join(f"CAST(regexp_extract(line, '{x}', 1) AS BIGINT) AS {n}" for n, x in PARTS.items())}
 FROM al), r AS (SELECT *, first_value(pts) OVER (PARTITION BY source_id ORDER BY n) AS first, coalesce(sum(samples) OVER
 (PARTITION BY source_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
 SELECT source_id, count(*) AS frames, CAST(sum(samples) AS BIGINT) AS samples, CAST(max(abs(pts - first - before)) AS BIGINT) AS jitter,
 CAST(({RATE} + {CLOCK} - 1) // {CLOCK} + 2 AS BIGINT) AS tolerance, max(abs(pts - first - before)) <= ({RATE} + {CLOCK} - 1)
 // {CLOCK} + 2 AS within FROM r GROUP BY source_id""")
def q78_audio_jitter(spark, sf_dir):
    """Decoder lines parsed, times against the running count of samples: the
    largest difference, and whether the container's rounding explains it."""
    p = lines(spark, sf_dir).selectExpr(
        "source_id", *(f"cast(regexp_extract(line, r'{x}', 1) as bigint) as {n}" for n, x in PARTS.items())
    )
    order = Window.partitionBy("source_id").orderBy("n")
    r = p.select(
        "*",
        F.first("pts").over(order).alias("first"),
        F.coalesce(F.sum("samples").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    limit = (RATE + CLOCK - 1) // CLOCK + 2
    return r.groupBy("source_id").agg(
        F.count("*").alias("frames"),
        F.sum("samples").alias("samples"),
        F.max(F.abs(F.col("pts") - F.col("first") - F.col("before"))).alias("jitter"),
    ).selectExpr("*", f"cast({limit} as bigint) as tolerance", f"jitter <= {limit} as within")


#: Two tracks a source: one from before the picture, one late and short.
TRACKS = """track, CASE WHEN track = 0 THEN first - 250000 ELSE first + length // 3 END AS origin,
 CASE WHEN track = 0 THEN (length + 500000) * 48 // 1000 ELSE length // 4 * 48 // 1000 END AS samples"""
#: Shift that makes times positive, so that integer division rounds down.
SHIFT = 10**15
UP = f"(({{}} - origin) * 48 + 999 + {SHIFT}) // 1000 - {SHIFT // 1000}"
SLICES = f"""{SEGMENTS}, tr AS (SELECT source_id, {TRACKS} FROM (SELECT source_id, min(pts) AS first, max(own) - min(pts) AS length
 FROM m GROUP BY source_id), (SELECT unnest([0, 1]) AS track)),
 sl AS (SELECT g.source_id, g.number, tr.track, g.start_pts, tr.origin, tr.samples,
 greatest(0, least(samples, {UP.format("start_pts")})) AS first_sample,
 greatest(0, least(samples, {UP.format("end_pts")})) AS end_sample FROM g JOIN tr ON tr.source_id = g.source_id)"""


def slices(m):
    """Samples of each track inside each segment: bounds rounded up exactly and
    clamped to the track, with the delay of the first one."""
    g = segments(m).select("source_id", "number", "start_pts", "end_pts")
    t = m.groupBy("source_id").agg(
        F.min("pts").alias("first"), (F.max("own") - F.min("pts")).alias("length")
    )
    t = t.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("track"))
    t = t.selectExpr("source_id", *columns(TRACKS.replace("//", "div")))
    bound = "greatest(0, least(samples, cast(ceil(({} - origin) * 48 / cast(1000 as decimal(10,0))) as bigint)))"
    s = g.join(t, "source_id")
    return s.selectExpr(
        "source_id", "number", "track", "start_pts", "origin", "samples",
        f"{bound.format('start_pts')} as first_sample", f"{bound.format('end_pts')} as end_sample",
    )


@query(f"""WITH {CHANGES}, {SLICES} SELECT source_id, number, track, first_sample, end_sample,
 (origin - start_pts) * 48 + first_sample * 1000 AS delay FROM sl WHERE first_sample < end_sample""")
def q27_audio_slice_bounds(spark, sf_dir):
    """Slices with any sample; the delay is in thousandths of a sample."""
    s = slices(changes(spark, sf_dir)).where("first_sample < end_sample")
    return s.selectExpr(
        "source_id", "number", "track", "first_sample", "end_sample",
        "(origin - start_pts) * 48 + first_sample * 1000 as delay",
    )


@query(f"""WITH {CHANGES}, {SLICES} SELECT source_id, number, track FROM sl WHERE first_sample >= end_sample""")
def q79_tracks_without_overlap(spark, sf_dir):
    """Tracks that have no sample in a segment: those that no slice stands for."""
    s = slices(changes(spark, sf_dir))
    some = s.where("first_sample < end_sample").select("source_id", "number", "track")
    return s.select("source_id", "number", "track").join(some, ["source_id", "number", "track"], "left_anti")


#: What an exported track has, with faults in some.
FAULTS = """CASE WHEN source_id % 7 = 1 AND number % 5 = 2 THEN 44100 ELSE 48000 END AS rate,
 CASE WHEN source_id % 7 = 2 AND number % 5 = 3 THEN 'mono' ELSE 'stereo' END AS layout,
 end_sample - first_sample - CASE WHEN source_id % 7 = 3 AND number % 5 = 1 THEN 1 ELSE 0 END AS decoded,
 delay + CASE WHEN source_id % 7 = 4 THEN 1500 * (number % 3) ELSE 0 END AS out_delay"""


@query(f"""WITH {CHANGES}, {SLICES}, o AS (SELECT *, {FAULTS} FROM (SELECT *, (origin - start_pts) * 48 + first_sample * 1000
 AS delay FROM sl WHERE first_sample < end_sample)) SELECT source_id, number, track, CASE WHEN rate <> 48000 THEN 'rate'
 WHEN layout <> 'stereo' THEN 'layout' WHEN decoded <> end_sample - first_sample THEN 'samples'
 WHEN abs(out_delay - delay) > greatest(1000, 1000 * 48000 // 30000) THEN 'sync' ELSE 'equal' END AS verdict FROM o""")
def q80_audio_verification(spark, sf_dir):
    """Rate, layout, number of samples, and synchrony within one tick of the
    coarser of both clocks."""
    s = slices(changes(spark, sf_dir)).where("first_sample < end_sample")
    s = s.selectExpr("*", "(origin - start_pts) * 48 + first_sample * 1000 as delay").selectExpr("*", *columns(FAULTS))
    return s.selectExpr(
        "source_id", "number", "track",
        "case when rate <> 48000 then 'rate' when layout <> 'stereo' then 'layout'"
        " when decoded <> end_sample - first_sample then 'samples'"
        " when abs(out_delay - delay) > greatest(1000, 1000 * 48000 div 30000) then 'sync' else 'equal' end as verdict",
    )
