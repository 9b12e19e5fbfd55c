"""Entry points, configuration, ownership and streams."""

import json
import os
import socket

import pytest
from conftest import SF
from pyspark.sql import functions as F

from stridewell import api
from stridewell.catalog import QUERIES
from stridewell.sources import jobs
from stridewell.sources.frames import changes
from stridewell.streaming import coordinator


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_detect_and_partition(spark):
    m = changes(spark, SF)
    pixel = api.detect(m, jobs.Config("pixel"))
    assert rows(pixel.select("source_id", "frame", "pts")) == rows(QUERIES["q04_pixel_baseline"](spark, SF).drop("mad"))
    names = ["source_id", "number", "start_frame", "end_frame", "start_pts", "end_pts"]
    got = api.scenes(m, pixel.union(pixel)).select(*names)
    assert rows(got) == rows(QUERIES["q14_scene_partition"](spark, SF).select(*names))
    temporal = api.detect(m).select("source_id", "frame")
    assert rows(temporal) == rows(QUERIES["q09_temporal_candidates"](spark, SF).select("source_id", "frame"))
    assert api.detect(m, jobs.Config(min_change=6000)).count() <= temporal.count()
    assert api.detect(m, jobs.Config("histogram")).where("reason <> 'histogram comparison baseline'").isEmpty()


def test_match_cuts(spark):
    m = changes(spark, SF)
    cuts = api.detect(m, jobs.Config("pixel")).select("source_id", "frame")
    for r in api.match_cuts(cuts, cuts, m).collect():
        assert (r.precision, r.recall, r.f1, r.fp, r.fn) == (1.0, 1.0, 1.0, 0, 0)
    moved = cuts.select("source_id", (F.col("frame") + 1).alias("frame"))
    near = api.match_cuts(cuts, moved, m, 1).agg(F.sum("fp"), F.sum("fn")).first()
    assert tuple(near) == (0, 0)
    with pytest.raises(ValueError):
        api.match_cuts(cuts, cuts, m, -1)


def test_verify(spark):
    base = [(1, i, i * 10, f"h{i}") for i in range(5)]
    out = [base[0], (1, 1, 11, "h1"), (1, 2, 20, "other"), base[3], (1, 9, 90, "h9")]
    make = lambda x: spark.createDataFrame(x, "source_id long, frame long, pts long, hash string")
    assert rows(api.verify(make(out), make(base))) == [(1, 1, "time"), (1, 2, "picture"), (1, 4, "missing"), (1, 9, "new")]


def test_configuration(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[detection]\ndetector = "adaptive"\ncontext = 8\n')
    assert jobs.load_config(path, context=None) == jobs.Config("adaptive", 8)
    assert jobs.load_config(path, context=9).context == 9 and jobs.load_config() == jobs.Config()
    assert jobs.Config().digest() != jobs.Config(context=3).digest()
    for bad in ("[other]\nx = 1\n", "[detection]\ncolour = 1\n", '[detection]\ndetector = "magic"\n', "[detection]\ncontext = 0\n"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            jobs.load_config(path)


def test_ownership(tmp_path):
    with jobs.Ownership(tmp_path):
        for resume in (False, True):
            with pytest.raises(FileExistsError):
                jobs.Ownership(tmp_path, resume)
    lock = tmp_path / "owner.json"
    assert not lock.exists()
    lock.write_text(json.dumps({"pid": 2**22 - 3, "host": socket.gethostname(), "token": "t"}))
    with pytest.raises(FileExistsError):
        jobs.Ownership(tmp_path)
    with jobs.Ownership(tmp_path, resume=True):
        assert json.loads(lock.read_text())["pid"] == os.getpid()
    lock.write_text(json.dumps({"pid": 2**22 - 3, "host": "elsewhere", "token": "t"}))
    with pytest.raises(FileExistsError):
        jobs.Ownership(tmp_path, resume=True)


def test_paths_and_fingerprints(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"abc")
    (tmp_path / "in" / "out").symlink_to(tmp_path)
    assert jobs.contained(tmp_path / "in", tmp_path / "in" / "a")
    assert not jobs.contained(tmp_path / "in", tmp_path / "in" / "out" / "x")
    found = jobs.fingerprints(spark, [str(tmp_path / "in" / "a")]).first()
    assert found.length == 3 and found.sha256.startswith("ba7816bf")
    assert jobs.capabilities(spark)["ok"]


def test_rows_are_there_before_they_are_told(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string").write.mode("append").json(str(tmp_path / "in"))
    told = []

    def emit(row):
        told.append((row["id"], spark.read.parquet(str(tmp_path / "out")).where(F.col("id") == row["id"]).count()))

    stream = spark.readStream.schema("id long, x string").json(str(tmp_path / "in"))
    write = coordinator.commit_then_emit(str(tmp_path / "out"), emit, ["id"])
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).start()
    coordinator.drain(query, 30)
    assert sorted(told) == [(1, 1), (2, 1)]


def test_a_failed_stream_is_told(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1,)], "id long").write.mode("append").json(str(tmp_path / "in"))

    def write(batch, number):
        raise OSError("disk full")

    stream = spark.readStream.schema("id long").json(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).start()
    with pytest.raises(Exception, match="disk full"):
        coordinator.drain(query, 30)
