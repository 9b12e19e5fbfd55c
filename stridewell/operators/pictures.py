"""Metrics of neighbouring images, baselines on them, and flashes."""

from pyspark.sql import functions as F

from stridewell.registry import query
from stridewell.sources.frames import by_frame
from stridewell.sources.images import IMAGES, PIXEL_ROWS, PIXELS, converted, images

# Baselines and bins of the hue-saturation histogram.
RGB, HISTOGRAM = 27, 0.5
HUES, SATURATIONS = 24, 8
CHANNELS = 3 * PIXELS


def total(x: str, kind: str = "bigint") -> str:
    return f"aggregate({x}, cast(0 as {kind}), (t, x) -> t + x)"


def apart(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> abs(x - y))"


def metrics(spark, sf_dir):
    """Six metrics of each frame against the one before; zeros at the first.

    The correlation is exact in integers up to its quotient; of a flat picture
    it is 1 if both are equal, else 0."""
    bins = f"transform(sequence(0, {PIXELS - 1}), i -> h[i] * {HUES} div 180 * {SATURATIONS} + s[i] * {SATURATIONS} div 256)"
    c = converted(images(spark, sf_dir)).withColumn("bins", F.expr(bins))
    names = ("px", "y", "h", "s", "v", "bins")
    c = c.select("source_id", "frame", *names, *(F.lag(x).over(by_frame()).alias(f"{x}0") for x in names))
    c = c.selectExpr(
        "*",
        f"{total(apart('px', 'px0'))} as rgb",
        f"{total(apart('h', 'h0'))} + {total(apart('s', 's0'))} + {total(apart('v', 'v0'))} as hsv",
        f"{total(apart('y', 'y0'))} as luma",
        f"array_max(transform(sequence(0, 6), j -> {total('slice(' + apart('px', 'px0') + ', 9 * j + 1, 9)')})) as block",
        "aggregate(array_distinct(bins), cast(0 as double), (t, x) -> t"
        " + sqrt(size(filter(bins, z -> z = x)) * size(filter(bins0, z -> z = x)))) as shared",
        f"{PIXELS} * {total('zip_with(y, y0, (a, b) -> a * b)')} - {total('y')} * {total('y0')} as cov",
        f"{PIXELS} * {total('transform(y, a -> a * a)')} - {total('y')} * {total('y')} as va",
        f"{PIXELS} * {total('transform(y0, a -> a * a)')} - {total('y0')} * {total('y0')} as vb",
    )
    corr = (
        "case when va = 0 or vb = 0 then if(y = y0, 1.0D, 0.0D)"
        " else greatest(-1.0D, least(1.0D, cov / sqrt(cast(va as double) * vb))) end"
    )
    first = "if(px0 is null, 0.0D, {})"
    return c.selectExpr(
        "source_id",
        "frame",
        f"round({first.format(f'rgb / {CHANNELS}')}, 6) as rgb_mad",
        f"round({first.format(f'hsv / {CHANNELS}')}, 6) as hsv_mad",
        f"round({first.format(f'sqrt(greatest(0.0D, 1 - round(shared / {PIXELS}, 9)))')}, 6) as histogram_distance",
        f"round({first.format(f'1 - ({corr})')}, 6) as structural_change",
        f"round({first.format(f'luma / {PIXELS}')}, 6) as luma_mad",
        f"round({first.format('block / 9')}, 6) as block_peak",
    )


METRICS = f"""{PIXEL_ROWS}, pb AS (SELECT *, h * {HUES} // 180 * {SATURATIONS} + s * {SATURATIONS} // 256 AS bin FROM p),
 pp AS (SELECT n.source_id, n.frame, n.i, abs(n.r - o.r) + abs(n.g - o.g) + abs(n.b - o.b) AS rgb,
 abs(n.h - o.h) + abs(n.s - o.s) + abs(n.v - o.v) AS hsv, abs(n.y - o.y) AS luma, n.y AS y1, o.y AS y0
 FROM pb AS n JOIN pb AS o ON o.source_id = n.source_id AND o.frame = n.frame - 1 AND o.i = n.i),
 pg AS (SELECT source_id, frame, sum(rgb) AS rgb, sum(hsv) AS hsv, sum(luma) AS luma,
 CAST({PIXELS} * sum(y1 * y0) - sum(y1) * sum(y0) AS DOUBLE) AS cov, CAST({PIXELS} * sum(y1 * y1) - sum(y1) * sum(y1)
 AS DOUBLE) AS va, CAST({PIXELS} * sum(y0 * y0) - sum(y0) * sum(y0) AS DOUBLE) AS vb, bool_and(y1 = y0) AS same
 FROM pp GROUP BY source_id, frame),
 bl AS (SELECT source_id, frame, max(t) AS block FROM (SELECT source_id, frame, i // 3 AS j, sum(rgb) AS t FROM pp
 GROUP BY source_id, frame, i // 3) GROUP BY source_id, frame),
 hi AS (SELECT source_id, frame, bin, count(*) AS c FROM pb GROUP BY source_id, frame, bin),
 hd AS (SELECT n.source_id, n.frame, sum(sqrt(n.c * o.c)) AS shared FROM hi AS n JOIN hi AS o ON
 o.source_id = n.source_id AND o.frame = n.frame - 1 AND o.bin = n.bin GROUP BY n.source_id, n.frame),
 mt AS (SELECT im.source_id, im.frame, round(coalesce(rgb / {CHANNELS}, 0), 6)::DOUBLE AS rgb_mad,
 round(coalesce(hsv / {CHANNELS}, 0), 6)::DOUBLE AS hsv_mad, CASE WHEN pg.frame IS NULL THEN 0.0 ELSE
 round(sqrt(greatest(0, 1 - round(coalesce(shared, 0) / {PIXELS}, 9))), 6) END::DOUBLE AS histogram_distance,
 CASE WHEN pg.frame IS NULL THEN 0.0 WHEN va = 0 OR vb = 0 THEN CASE WHEN same THEN 0.0 ELSE 1.0 END ELSE
 round(1 - greatest(-1, least(1, cov / sqrt(va * vb))), 6) END::DOUBLE AS structural_change,
 round(coalesce(luma / {PIXELS}, 0), 6)::DOUBLE AS luma_mad, round(coalesce(block / 9, 0), 6)::DOUBLE AS block_peak
 FROM im LEFT JOIN pg ON pg.source_id = im.source_id AND pg.frame = im.frame
 LEFT JOIN bl ON bl.source_id = im.source_id AND bl.frame = im.frame
 LEFT JOIN hd ON hd.source_id = im.source_id AND hd.frame = im.frame)"""


@query(f"WITH {METRICS} SELECT * FROM mt")
def q11_frame_metrics(spark, sf_dir):
    return metrics(spark, sf_dir)


@query(f"""WITH {METRICS} SELECT source_id, frame, histogram_distance FROM mt
 WHERE frame > 0 AND histogram_distance >= {HISTOGRAM}""")
def q05_histogram_baseline(spark, sf_dir):
    return metrics(spark, sf_dir).where(f"frame > 0 and histogram_distance >= {HISTOGRAM}").select(
        "source_id", "frame", "histogram_distance"
    )


NAMES = ("rgb_mad", "hsv_mad", "histogram_distance", "structural_change", "luma_mad", "block_peak")


@query(f"""WITH {METRICS} SELECT source_id, frame, 'cut' AS decision, baseline || ' comparison baseline' AS reason,
 name, value FROM (SELECT source_id, frame, baseline, unnest([{", ".join(f"'{n}'" for n in NAMES)}]) AS name,
 unnest([{", ".join(NAMES)}]) AS value FROM (SELECT *, 'pixel' AS baseline FROM mt WHERE frame > 0 AND rgb_mad >= {RGB}
 UNION ALL SELECT *, 'histogram' FROM mt WHERE frame > 0 AND histogram_distance >= {HISTOGRAM}))""")
def q54_baseline_records(spark, sf_dir):
    """Every hit of a baseline as a boundary record, its evidence a row a
    metric; one scan of the metrics serves all baselines."""
    hits = F.expr(
        f"filter(array(if(rgb_mad >= {RGB}, 'pixel', null), if(histogram_distance >= {HISTOGRAM}, 'histogram', null)),"
        " x -> x is not null)"
    )
    evidence = F.explode(F.create_map(*(x for n in NAMES for x in (F.lit(n), F.col(n)))))
    m = metrics(spark, sf_dir).where("frame > 0").select("*", F.explode(hits).alias("baseline"))
    return m.select(
        "source_id",
        "frame",
        F.lit("cut").alias("decision"),
        F.concat("baseline", F.lit(" comparison baseline")).alias("reason"),
        evidence.alias("name", "value"),
    )


@query(f"""WITH {PIXEL_ROWS} SELECT source_id, frame, CAST(sum(y * (i + 1)) AS BIGINT) AS grey,
 CAST(sum(h * (i + 1)) AS BIGINT) AS hue, CAST(sum(s * (i + 1)) AS BIGINT) AS saturation,
 CAST(sum(v * (i + 1)) AS BIGINT) AS brightness FROM p GROUP BY source_id, frame""")
def q55_colour_conversion(spark, sf_dir):
    """Grey, hue, saturation and value of every pixel, each weighted by its
    place so that the order counts."""
    weighted = {
        name: total(f"transform({column}, (x, i) -> x * (i + 1))")
        for name, column in (("grey", "y"), ("hue", "h"), ("saturation", "s"), ("brightness", "v"))
    }
    return converted(images(spark, sf_dir)).selectExpr(
        "source_id", "frame", *(f"{e} as {n}" for n, e in weighted.items())
    )


#: Sums over all channels that stand for a mean difference of 8 and of 2.
CHANGED, SAME = 8 * CHANNELS, 2 * CHANNELS


@query(f"""WITH {IMAGES}, w AS (SELECT source_id, frame, px, lag(px) OVER o AS b1, coalesce(lag(px, 2) OVER o, lag(px)
 OVER o) AS b2, coalesce(lead(px) OVER o, px) AS a1 FROM im WINDOW o AS (PARTITION BY source_id ORDER BY frame)),
 u AS (SELECT source_id, frame, abs(px[k] - b1[k]) AS mad, abs(b1[k] - a1[k]) AS across, abs(b2[k] - px[k]) AS back
 FROM (SELECT *, unnest(range(1, {CHANNELS} + 1)) AS k FROM w WHERE b1 IS NOT NULL)),
 d AS (SELECT source_id, frame, sum(mad) AS mad, sum(across) AS across, sum(back) AS back FROM u GROUP BY source_id, frame)
 SELECT source_id, frame, CAST(mad AS BIGINT) AS mad, 10 * across < greatest({10 * SAME}, mad) AS returns_after,
 10 * back < greatest({10 * SAME}, mad) AS returned FROM d WHERE mad > {CHANGED}
 AND (10 * across < greatest({10 * SAME}, mad) OR 10 * back < greatest({10 * SAME}, mad))""")
def q12_flash_return(spark, sf_dir):
    """Changes after which the picture before comes back, or that bring the one
    two before back: a mean difference below 2 or a tenth of the change, which
    is above 8 itself.  At the ends the nearest frame stands in."""
    w = images(spark, sf_dir).select(
        "source_id",
        "frame",
        "px",
        F.lag("px").over(by_frame()).alias("b1"),
        F.coalesce(F.lag("px", 2).over(by_frame()), F.lag("px").over(by_frame())).alias("b2"),
        F.coalesce(F.lead("px").over(by_frame()), F.col("px")).alias("a1"),
    )
    d = w.where("b1 is not null").selectExpr(
        "source_id",
        "frame",
        f"{total(apart('px', 'b1'))} as mad",
        f"{total(apart('b1', 'a1'))} as across",
        f"{total(apart('b2', 'px'))} as back",
    )
    near = f"10 * {{}} < greatest({10 * SAME}, mad)"
    return d.where(f"mad > {CHANGED}").selectExpr(
        "source_id", "frame", "mad", f"{near.format('across')} as returns_after", f"{near.format('back')} as returned"
    ).where("returns_after or returned")


@query(f"""WITH {PIXEL_ROWS}, ce AS (SELECT source_id, frame, i // 7 AS band, sum(y) AS t FROM p GROUP BY source_id, frame, i // 7),
 ed AS (SELECT a.source_id, a.frame, count(*) FILTER (abs(a.y - b.y) > 50) AS edges FROM p AS a JOIN p AS b ON b.source_id = a.source_id
 AND b.frame = a.frame AND b.i = a.i + 1 GROUP BY a.source_id, a.frame) SELECT ce.source_id, ce.frame,
 string_agg(CAST((2 * t + 7) // 14 AS VARCHAR), ',' ORDER BY band) AS reduced, any_value(edges) AS edges FROM ce JOIN ed
 ON ed.source_id = ce.source_id AND ed.frame = ce.frame GROUP BY ce.source_id, ce.frame""")
def q113_reduced_pictures(spark, sf_dir):
    """Grey pictures reduced by averaging areas of seven pixels, halves rounded
    up, and the number of steep steps between neighbours."""
    c = converted(images(spark, sf_dir))
    bands = f"transform(sequence(0, 2), j -> (2 * {total('slice(y, 7 * j + 1, 7)')} + 7) div 14)"
    return c.selectExpr(
        "source_id", "frame", f"array_join(transform({bands}, x -> cast(x as string)), ',') as reduced",
        f"cast(size(filter(sequence(1, {PIXELS - 1}), i -> abs(y[i] - y[i - 1]) > 50)) as bigint) as edges",
    )


@query(f"""WITH {METRICS} SELECT source_id, frame, round(sqrt(greatest(0, 2 * structural_change)), 5)::DOUBLE AS warp_residual FROM mt WHERE frame > 0""")
def q114_warp_residual(spark, sf_dir):
    """What is left after the best alignment, from the correlation; pictures are
    taken as aligned already, as no tracker runs here."""
    m = metrics(spark, sf_dir).where("frame > 0")
    return m.selectExpr("source_id", "frame", "round(sqrt(greatest(0.0D, 2 * structural_change)), 5) as warp_residual")
