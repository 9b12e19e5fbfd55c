"""The library's entry points, on tables of any source.

Frames are rows (source_id, frame, pts, own, is_key) with the changes of
``sources.frames.changes``: mad, kd and hd.  Each function declares a plan and
returns a DataFrame; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridewell.operators import change, evaluation, segments
from stridewell.sources.jobs import Config

__all__ = ["Config", "detect", "match_cuts", "scenes", "verify"]


def detect(frames: DataFrame, config: Config = Config()) -> DataFrame:
    """(source_id, frame, pts, decision, reason): cuts of a named baseline, or
    the temporal candidates, which evidence still has to decide ('review')."""
    if config.detector == "temporal":
        found = change.candidates(frames, config.context, config.min_change)
        return found.select(
            "source_id", "frame", "pts", F.lit("review").alias("decision"), F.lit("temporal candidate").alias("reason")
        )
    if config.detector == "pixel":
        hits = change.pixel_cuts(frames)
    elif config.detector == "adaptive":
        hits = change.adaptive(frames).where(change.ADAPTIVE_CUT)
    else:
        hits = frames.where((F.col("frame") > 0) & (F.col("hd") >= 50))
    reason = F.lit(f"{config.detector} comparison baseline")
    return hits.select("source_id", "frame", "pts", F.lit("cut").alias("decision"), reason.alias("reason"))


def scenes(frames: DataFrame, cuts: DataFrame) -> DataFrame:
    """Half-open scenes of each source between its cuts (source_id, frame)."""
    marked = cuts.select("source_id", "frame", F.lit(True).alias("is_cut")).distinct()
    at = frames.join(marked, ["source_id", "frame"], "left")
    return segments.segments(at, "frame > 0 and is_cut")


def match_cuts(predicted: DataFrame, reference: DataFrame, frames: DataFrame, tolerance: int = 0) -> DataFrame:
    """Counts, precision, recall, F1 and rates an hour of each source."""
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    return evaluation.rated(evaluation.counts(predicted, reference, tolerance), frames)


def verify(output: DataFrame, source: DataFrame) -> DataFrame:
    """(source_id, frame, fault): frames (source_id, frame, pts, hash) of an
    output that are missing, new, changed or at another time."""
    a = source.select("source_id", "frame", F.col("pts").alias("p0"), F.col("hash").alias("h0"))
    j = a.join(output.select("source_id", "frame", F.col("pts").alias("p1"), F.col("hash").alias("h1")), ["source_id", "frame"], "full")
    fault = F.expr(
        "case when h1 is null then 'missing' when h0 is null then 'new' when h0 <> h1 then 'picture' when p0 <> p1 then 'time' end"
    )
    return j.select("source_id", "frame", fault.alias("fault")).where("fault is not null")
