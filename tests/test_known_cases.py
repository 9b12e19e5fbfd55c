"""Cases whose results are known, on the operators themselves."""

import pytest
from pyspark.sql import functions as F

from stridewell.operators import audio, change, progress, segments


def test_update_ratio_leaves_out_held_frames_and_the_nearest(spark):
    values = [0, 10, 0, 0, 10, 0, 0, 10, 0, 0, 60, 0, 0, 10, 0, 0, 10]
    m = spark.createDataFrame([(1, i, v * 100) for i, v in enumerate(values)], "source_id long, frame long, mad long")
    r = change.update_ratio(m, "mad", F.col("mad") > 50, "base4", 4)
    ratio = {x.frame: 4 * x.mad / x.base4 for x in r.collect()}
    assert ratio[7] == 1 and ratio[10] == 6 and ratio[0] == 0


def test_a_candidate_without_active_frames_sees_the_whole_source(spark):
    rows = [(1, i, i * 10, i * 10 + 10, 0, 0, 40 if i == 2 else 0, 5) for i in range(5)]
    m = spark.createDataFrame(rows, "source_id long, frame long, pts long, own long, mad long, kd long, hd long, cents long")
    m = m.withColumn("mad", F.when(F.col("frame") == 2, 40).otherwise(0))  # changed, but not active
    found = change.candidates(m, min_change=30).select("frame").collect()
    assert [r.frame for r in found] == [2]


EVIDENCE = "corr int, hist int, ratio int, track int, inliers int, warp_residual int, sift_inliers int, sift_cov int, sift_residual int, block_ratio int, block_peak int, within int, flash_return boolean"


@pytest.mark.parametrize(
    "row, decision",
    [
        # same histogram, everything moved
        ((100, 0, 2500, 0, 0, 100, 0, 0, None, 2500, 40, 990, False), "cut"),
        # another exposure of the same structure
        ((999, 80, 1200, 90, 80, 5, 15, 20, None, 1200, 50, 990, False), "continuity"),
        # turned, with features that correspond
        ((100, 70, 1000, 0, 0, 100, 25, 20, 20, 1000, 80, 900, False), "continuity"),
        # an overlay that corresponds, behind it another scene
        ((500, 80, 1000, 0, 0, 100, 40, 90, 100, 1000, 50, 900, False), "cut"),
        ((100, 80, 1000, 0, 0, 100, 0, 0, None, 1000, 50, 900, True), "review"),
        # a local break in an otherwise held frame
        ((950, 0, 100, 90, 80, 5, 0, 0, None, 1700, 13, 990, False), "review"),
    ],
)
def test_ladder(spark, row, decision):
    assert change.decide(spark.createDataFrame([row], EVIDENCE)).first().decision == decision


def test_partition_of_a_variable_rate(spark):
    rows = [(1, i, p, p + d, i == 2) for i, (p, d) in enumerate(zip([1000, 1033, 1067, 1120], [33, 34, 53, 40]))]
    m = spark.createDataFrame(rows, "source_id long, frame long, pts long, own long, is_cut boolean")
    got = segments.segments(m, "is_cut").orderBy("number").select("start_frame", "end_frame", "start_pts", "end_pts").collect()
    assert [tuple(r) for r in got] == [(0, 2, 1000, 1067), (2, 4, 1067, 1160)]
    length = m.agg((F.max_by("own", "frame") - F.min("pts")).alias("x")).first().x
    assert length * 25 == 4 * 1000  # four twenty-fifths of a second


EVENTS = "source_id long, frame long, event string, ends boolean, recovered boolean, reason_code string, phase string, observed_bytes long"


@pytest.mark.parametrize(
    "log, state, recovered",
    [
        ([("job_started", None), ("scene_certified", "recovered"), ("job_finished", None)], "succeeded", 1),
        ([("worker_lost", None)], "failed", 0),
        ([("job_started", None), ("job_finished", None), ("worker_lost", None)], "failed", 0),
        ([("job_started", None), ("job_failed", "interrupted")], "interrupted", 0),
        ([("job_started", None), ("job_failed", "interrupted"), ("worker_lost", None)], "failed", 0),
        ([("job_started", None), ("job_failed", None), ("job_finished", None)], "failed", 0),
        ([("job_started", None)], "active", 0),
        ([], "pending", 0),
    ],
)
def test_job_states(spark, log, state, recovered):
    ends = ("job_finished", "job_failed", "worker_lost")
    rows = [
        (1, i, e, e in ends, x == "recovered", "interrupted" if x == "interrupted" else None, "p", 7 if e in ends else None)
        for i, (e, x) in enumerate(log)
    ]
    jobs = spark.createDataFrame([(1,)], "source_id long")
    got = progress.fold(jobs, spark.createDataFrame(rows, EVENTS)).first()
    assert (got.state, got.recovered) == (state, recovered)
    assert (got.phase is not None) == (state == "active")


def test_sample_bounds_round_up(spark):
    """A track that begins with the picture: frames at 25ths of a second."""
    rows = [(1, i, 40_000 * i, 40_000 * (i + 1), 3000 if i in (1, 14) else 0) for i in range(20)]
    m = spark.createDataFrame(rows, "source_id long, frame long, pts long, own long, mad long")
    s = audio.slices(m).where("track = 0 and number = 2").first()
    # Track 0 begins a quarter of a second before the picture.
    first, last = -(-(40_000 + 250_000) * 48 // 1000), -(-(560_000 + 250_000) * 48 // 1000)
    assert (s.first_sample, s.end_sample) == (first, last)


def test_display_of_times_is_half_even(spark):
    micros = {500: "00:00:00.000", 1500: "00:00:00.002", 2500: "00:00:00.002", 3_600_000_000 * 100: "100:00:00.000"}
    for x, text in micros.items():
        ms = spark.range(1).selectExpr(f"cast(bround(cast({x} as decimal(20,0)) / 1000, 0) as bigint) as ms").first().ms
        hours = str(ms // 3_600_000).zfill(2)
        assert f"{hours}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}" == text
