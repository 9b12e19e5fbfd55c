"""embeddings as small RGB images in order: 21 pixels a frame, in scenes.

The first 63 parts of a vector are the pixels' channels around middle grey; a
scene's gain makes it a card, a textured card or a picture.  Some frames repeat
the image two before, so that there are flashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridewell.sources.frames import VECTORS, by_frame, vectors

PIXELS = 21
IS_CUT = """frame > 0 AND CASE WHEN source_id % 3 = 0 THEN frame = 40
 ELSE frame % (5 + source_id % 4) = 0 OR frame % 16 = 1 END"""
GAIN = "CASE (source_id + number) % 4 WHEN 0 THEN 4 WHEN 2 THEN 10 ELSE 1000 END"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, frame, number (of the scene) and px, the channels r, g, b of
    each pixel in turn."""
    s = vectors(spark, sf_dir).withColumn(
        "number", 1 + F.sum(F.expr(f"if({IS_CUT}, 1, 0)")).over(by_frame())
    )
    px = F.expr(
        f"transform(slice(v, 1, {3 * PIXELS}), x -> cast(least(255, greatest(0, 128 + round(x * ({GAIN})))) as bigint))"
    )
    s = s.select("source_id", "frame", "number", px.alias("px"))
    again = F.when(F.col("frame") % 16 == 2, F.lag("px", 2).over(by_frame())).otherwise(F.col("px"))
    return s.withColumn("px", again)


IMAGES = f"""{VECTORS}, b1 AS (SELECT *, CAST(1 + sum(CASE WHEN {IS_CUT} THEN 1 ELSE 0 END) OVER
 (PARTITION BY source_id ORDER BY frame) AS BIGINT) AS number FROM b), b2 AS (SELECT source_id, frame, number,
 list_transform(v[1:{3 * PIXELS}], lambda x: CAST(least(255, greatest(0, 128 + round(x * ({GAIN})))) AS BIGINT)) AS px
 FROM b1), im AS (SELECT source_id, frame, number, CASE WHEN frame % 16 = 2 THEN lag(px, 2) OVER (PARTITION BY
 source_id ORDER BY frame) ELSE px END AS px FROM b2)"""

#: A row a pixel, with its conversions, for the statements in SQL.
PIXEL_ROWS = f"""{IMAGES}, p0 AS (SELECT source_id, frame, number, i, px[3 * i + 1] AS r, px[3 * i + 2] AS g,
 px[3 * i + 3] AS b FROM (SELECT *, unnest(range(0, {PIXELS})) AS i FROM im)),
 p1 AS (SELECT *, (4899 * r + 9617 * g + 1868 * b + 8192) // 16384 AS y, greatest(r, g, b) AS v,
 greatest(r, g, b) - least(r, g, b) AS d FROM p0), p2 AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE
 (510 * d + v) // (2 * v) END AS s, CASE WHEN v = r THEN 30 * (g - b) + (CASE WHEN g < b THEN 180 * d ELSE 0 END)
 WHEN v = g THEN 30 * (b - r) + 60 * d ELSE 30 * (r - g) + 120 * d END AS hn FROM p1),
 p AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (2 * hn + d) // (2 * d) % 180 END AS h FROM p2)"""


def converted(im: DataFrame) -> DataFrame:
    """Adds y (grey) and h, s, v of each pixel, in the 8-bit ranges 0-255 and,
    for h, 0-179; halves are rounded up."""
    rgb = "array(px[3 * i], px[3 * i + 1], px[3 * i + 2])"
    # Weights of the grey conversion over 2^14.
    y = "(4899 * px[3 * i] + 9617 * px[3 * i + 1] + 1868 * px[3 * i + 2] + 8192) div 16384"
    each = f"transform(sequence(0, {PIXELS - 1}), i -> {{}})"
    v, low = f"array_max({rgb})", f"array_min({rgb})"
    parts = each.format(
        f"named_struct('r', px[3 * i], 'g', px[3 * i + 1], 'b', px[3 * i + 2], 'v', {v}, 'd', {v} - {low})"
    )
    sector = (
        "case when q.v = q.r then 30 * (q.g - q.b) + if(q.g < q.b, 180 * q.d, 0)"
        " when q.v = q.g then 30 * (q.b - q.r) + 60 * q.d else 30 * (q.r - q.g) + 120 * q.d end"
    )
    return im.selectExpr("*", f"{each.format(y)} as y", f"{parts} as q").selectExpr(
        *im.columns,
        "y",
        f"transform(q, q -> if(q.d = 0, 0, (2 * ({sector}) + q.d) div (2 * q.d) % 180)) as h",
        "transform(q, q -> if(q.v = 0, 0, (510 * q.d + q.v) div (2 * q.v))) as s",
        "transform(q, q -> q.v) as v",
    )
