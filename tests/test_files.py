"""Readers and writers on files."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from stridewell.operators.progress import violations
from stridewell.sources import readers, sinks


def test_discovery(spark, tmp_path):
    for name in ("a.MP4", "b.txt", "sub/c.mkv", "out/d.mov", "e.ts"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    names = lambda df: [os.path.basename(r.path) for r in df.collect()]
    assert names(readers.discover(spark, [str(tmp_path)], str(tmp_path / "out"))) == ["a.MP4", "e.ts"]
    deep = readers.discover(spark, [str(tmp_path)], str(tmp_path / "out"), recursive=True)
    assert names(deep) == ["a.MP4", "e.ts", "c.mkv"]
    both = [str(tmp_path), str(tmp_path / "b.txt"), str(tmp_path / "e.ts")]
    assert names(readers.discover(spark, both, str(tmp_path / "out"))) == ["a.MP4", "b.txt", "e.ts"]
    for bad in ([str(tmp_path / "sub")], [str(tmp_path / "sub" / "c.mkv")]):
        with pytest.raises(ValueError):
            readers.discover(spark, bad, str(tmp_path / "sub")).count()


@pytest.mark.parametrize(
    "tail, kept", [("", 2), ('{"n":3}', 3), ('{"n":3', 2), ('{"n":3}\n', 3)]
)
def test_log_tail(spark, tmp_path, tail, kept):
    path = tmp_path / "log.jsonl"
    path.write_text('{"n":1}\n{"n":2}\n' + tail)
    rows = readers.event_log(readers.lines(spark, str(path)))
    assert sorted(r.line for r in rows.collect())[:kept] == [f'{{"n":{i + 1}}}' for i in range(kept)]
    assert rows.count() == kept
    log = sinks.Log(path)
    log.emit({"event": "view", "unit": None, "n": 9})
    log.close()
    said = path.read_text().splitlines()
    assert [json.loads(x) for x in said][-1] == {"event": "view", "n": 9} and len(said) == kept + 1


def test_a_broken_line_inside_is_told(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    good = '{"schema_version":1,"run_id":"r","event":"e","phase":"p","sequence":0}'
    path.write_text(f"{good}\nnonsense\n{good}\n")
    rows = readers.event_log(readers.lines(spark, str(path)))
    found = violations(rows, "place").collect()
    assert [(r.place, r.violation) for r in found] == [(1, "not an object")]


def index(**change):
    value = {
        "schema_version": 1,
        "interval_semantics": "decoded-frames-half-open",
        "timeline": {"time_base": "1/1000", "pts": [1000, 1033, 1067, 1120], "durations": [33, 34, 53, 40], "keyframes": [0]},
        "scenes": [
            {"number": 1, "start_frame": 0, "end_frame": 2, "frame_count": 2, "start_pts": 1000, "end_pts": 1067, "output_file": None},
            {"number": 2, "start_frame": 2, "end_frame": 4, "frame_count": 2, "start_pts": 1067, "end_pts": 1160, "output_file": "a/b.mkv"},
        ],
        "boundaries": [{"frame": 2, "pts": 1067, "decision": "cut"}],
        "source": {"sha256": "a" * 64, "frame_count": 4},
    }
    for path, x in change.items():
        at = value
        *parents, last = path.split("__")
        for p in parents:
            at = at[int(p) if p.isdigit() else p]
        at[int(last) if last.isdigit() else last] = x
    return value


@pytest.mark.parametrize(
    "change, fault",
    [
        ({}, None),
        ({"schema_version": 2}, "version"),
        ({"interval_semantics": "closed"}, "semantics"),
        ({"timeline__pts": [1000, 1000, 1067, 1120]}, "time not increasing"),
        ({"timeline__durations": [33, 34, 53, 0]}, "duration"),
        ({"timeline__durations": [33, 35, 53, 40]}, "duration is not the interval"),
        ({"scenes": []}, "no scenes"),
        ({"scenes__1__start_frame": 3}, "partition"),
        ({"scenes__1__end_pts": 1161}, "scene values"),
        ({"scenes__0__output_file": "../../outside.mov"}, "output path"),
        ({"boundaries__0__pts": 1068}, "boundary"),
        ({"boundaries__0__decision": "review"}, "boundaries and partition"),
        ({"source__sha256": "A" * 64}, "source digest"),
        ({"source__frame_count": 5}, "frame count"),
    ],
)
def test_index(spark, tmp_path, change, fault):
    path = tmp_path / "index.json"
    path.write_text(json.dumps(index(**change), indent=1))
    assert [r.fault for r in readers.read_index(spark, str(path)).collect()] == [fault]


def test_replacing_and_refusing(tmp_path):
    path = tmp_path / "deep" / "state.json"
    sinks.replace_json(path, {"a": 1})
    sinks.replace_json(path, {"a": 2})
    assert json.loads(path.read_text()) == {"a": 2}
    with pytest.raises(ValueError):
        sinks.replace_json(path, {"a": math.nan})
    with pytest.raises(FileExistsError):
        sinks.new_bytes(path, b"x")
    assert json.loads(path.read_text()) == {"a": 2} and os.listdir(path.parent) == ["state.json"]
    sinks.new_bytes(tmp_path / "fresh", b"x")
    link = tmp_path / "link"
    link.symlink_to(path)
    for write in (sinks.replace_bytes, sinks.new_bytes):
        with pytest.raises(FileExistsError):
            write(link, b"x")
    with pytest.raises(FileExistsError):
        sinks.Log(link)


def test_tables_and_report(spark, tmp_path):
    rows = [(2, 2, 4, 3, 2, 1067, 1160, "<edit> & 'x'"), (1, 0, 2, 1, 2, 1000, 1067, "plain")]
    names = [*sinks.SCENES, "reason"]
    df = spark.createDataFrame(rows, names)
    sinks.write_scenes(df, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, inferSchema=True)
    assert back.columns == list(sinks.SCENES) and back.count() == 2
    sinks.write_new(df, str(tmp_path / "new"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_new(df, str(tmp_path / "new"))
    sinks.write_metrics(df, str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 2
    sinks.write_report(df, "<script>alert(1)</script>", tmp_path / "report.html")
    page = (tmp_path / "report.html").read_text()
    assert "<script>" not in page and "&lt;edit> &amp;" in page and page.index("Scene 1") < page.index("Scene 2")
    assert spark.range(1).select(sinks.escaped(F.lit("<a & \"b\"'>"))).first()[0] == "&lt;a &amp; &quot;b&quot;&#x27;&gt;"


def test_several_sinks_close_in_reverse():
    said = []

    class Sink(sinks.Null):
        def __init__(self, name, fails=False):
            self.name, self.fails = name, fails

        def emit(self, event):
            said.append((self.name, event["n"]))

        def close(self, result=None):
            said.append(("closed", self.name))
            if self.fails:
                raise OSError(self.name)

    both = sinks.Several([Sink("a"), Sink("b", True)])
    both.emit({"n": 1})
    with pytest.raises(OSError):
        both.close()
    assert said == [("a", 1), ("b", 1), ("closed", "b"), ("closed", "a")]


def test_views_of_a_stream(spark, tmp_path):
    write = sinks.for_each_batch({"low": lambda b: b.where("id < 3"), "all": lambda b: b}, str(tmp_path))
    write(spark.range(5), 0)
    write(spark.range(5), 0)  # a batch that is repeated
    write(spark.range(2), 1)
    assert spark.read.parquet(str(tmp_path / "low")).count() == 5
    assert spark.read.parquet(str(tmp_path / "all")).count() == 7
