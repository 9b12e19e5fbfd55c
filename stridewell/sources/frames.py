"""Tables as ordered observations: one row per (source_id, frame)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def whole():
    """All frames of a source."""
    return Window.partitionBy("source_id")


def by_frame():
    """A source's frames in order."""
    return whole().orderBy("frame")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OWN = "pts + case when k > 0 then k * 1000 else 1000000 end"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames: pts in epoch microseconds whatever the session's time
    zone, value in cents, k of the properties, key frames, and ``own``, where the
    frame ends by its decoded duration (k milliseconds) or, without one, by the
    stream's endpoint a second later."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return (
        read(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("source_id"),
            (F.row_number().over(order) - 1).cast("long").alias("frame"),
            F.expr("unix_micros(cast(concat(cast(ts as string), 'Z') as timestamp))").alias("pts"),
            F.expr("cast(round(value * 100) as bigint)").alias("cents"),
            F.expr("cast(regexp_extract(props, '(-?[0-9]+)', 1) as bigint)").alias("k"),
            "event_type",
        )
        .withColumn("is_key", (F.col("event_type") == "signup") | (F.col("frame") == 0))
        .withColumn("own", F.expr(OWN))
    )


FRAMES = f"""f AS (SELECT *, {OWN} AS own FROM (SELECT user_id AS source_id,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
 epoch_us(ts) AS pts, CAST(round(value * 100) AS BIGINT) AS cents,
 CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) AS k, event_type,
 event_type = 'signup' OR row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
 AS is_key FROM events))"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the change from the frame before; zero at the first.  ``hd``
    stands for the histogram distance, in hundredths."""
    before = [F.coalesce(F.lag(c).over(by_frame()), F.col(c)) for c in ("cents", "k", "event_type")]
    return frames(spark, sf_dir).select(
        "*",
        F.abs(F.col("cents") - before[0]).alias("mad"),
        F.abs(F.col("k") - before[1]).alias("kd"),
        (F.col("event_type") != before[2]).alias("other"),
    ).selectExpr("*", "kd div 5 + if(other, 30, 0) as hd").drop("other")


CHANGES = (
    FRAMES
    + """, m AS (SELECT *,
 abs(cents - coalesce(lag(cents) OVER (PARTITION BY source_id ORDER BY frame), cents)) AS mad,
 abs(k - coalesce(lag(k) OVER (PARTITION BY source_id ORDER BY frame), k)) AS kd,
 abs(k - coalesce(lag(k) OVER (PARTITION BY source_id ORDER BY frame), k)) // 5 + CASE WHEN event_type <>
 coalesce(lag(event_type) OVER (PARTITION BY source_id ORDER BY frame), event_type) THEN 30 ELSE 0 END AS hd FROM f)"""
)

#: Vectors of one source; vec_id is the order.
RUN = 64


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as frames of 64-part vectors, 64 frames a source."""
    return read(spark, sf_dir, "embeddings").select(
        F.expr(f"vec_id div {RUN}").alias("source_id"),
        (F.col("vec_id") % RUN).cast("long").alias("frame"),
        F.expr("transform(embedding, x -> cast(x as double))").alias("v"),
        F.col("label").cast("long").alias("label"),
    )


VECTORS = f"""b AS (SELECT vec_id // {RUN} AS source_id, vec_id % {RUN} AS frame,
 list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CAST(label AS BIGINT) AS label
 FROM embeddings)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as frames."""
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("source_id"), F.col("turn").alias("frame"), "role", "text"
    )
