"""Readers of files: discovery, logs with a torn tail, indexes, labels, frame
digests and detector output.  The parsers take lines as rows (key, place, line),
so a reader is the file source and a parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Files that a batch takes.
VIDEO = ("mp4", "m4v", "mov", "mkv", "webm", "avi", "mts", "m2ts", "ts", "mpeg", "mpg")


def discover(spark: SparkSession, inputs: list[str], output: str, recursive: bool = False) -> DataFrame:
    """(path, length) of inputs sorted by path, each once: the videos of folders,
    but for those below ``output``, and files that are named themselves whatever
    their suffix.  Raises where a named file lies below ``output``, and where
    nothing is found."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def is_file(path: str) -> bool:
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf).getFileStatus(at).isFile()

    below = output.rstrip("/") + "/"
    named = [i for i in inputs if is_file(i)]
    folders = [i.rstrip("/") for i in inputs if i not in named]
    if any(i.startswith(below) for i in named):
        raise ValueError("an input lies in the output folder")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    parts = []
    if folders:
        found = reader.load(folders).select("path", "length")
        found = found.where(F.lower(F.element_at(F.split("path", "[.]"), -1)).isin(*VIDEO))
        if not recursive:  # files of the folders themselves
            own = F.regexp_replace("path", "/[^/]*$", "")
            found = found.where(F.exists(F.array(*map(F.lit, folders)), lambda f: own.endswith(f)))
        parts.append(found.where(~F.contains("path", F.lit(below))))
    if named:
        parts.append(reader.load(named).select("path", "length"))
    found = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    found = found.distinct().orderBy("path")
    if found.isEmpty():
        raise ValueError("no input videos")
    return found


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(key, place, line, ended) of text files: the file, the place of a line in
    it, and whether its newline is there.  A file is one row, as places need its
    order; files of logs and indexes are bounded by their job."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("key"), "value")
    cut = whole.select("key", "value", F.posexplode(F.split("value", "\n")).alias("place", "line"))
    last = F.size(F.split("value", "\n")) - 1
    cut = cut.select("key", F.col("place").cast("long").alias("place"), "line", (F.col("place") < last).alias("ended"))
    return cut.where("ended or line <> ''")


def event_log(rows: DataFrame) -> DataFrame:
    """The lines of a log that count: a last line without its end only if it is
    valid JSON.  Any other line stays, valid or not, for the rules to tell."""
    valid = F.json_object_keys("line").isNotNull()
    return rows.where(F.col("ended") | valid).select("key", "place", "line")


INDEX = (
    "schema_version int, interval_semantics string, timeline struct<time_base:string,pts:array<bigint>,"
    "durations:array<bigint>,keyframes:array<bigint>>, scenes array<struct<number:bigint,start_frame:bigint,"
    "end_frame:bigint,frame_count:bigint,start_pts:bigint,end_pts:bigint,output_file:string>>,"
    " boundaries array<struct<frame:bigint,pts:bigint,decision:string>>, source struct<sha256:string,frame_count:bigint>"
)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Scene indexes with ``fault``: the first rule that a document breaks, null
    for a sound one."""
    doc = spark.read.schema(INDEX).json(path, multiLine=True).select(F.input_file_name().alias("path"), "*")
    n = "size(timeline.pts)"
    ends = "concat(timeline.pts, array(element_at(timeline.pts, -1) + element_at(timeline.durations, -1)))"
    starts = "transform(scenes, s -> s.start_frame)"
    rules = (
        ("schema_version is null or schema_version <> 1", "version"),
        ("interval_semantics is null or interval_semantics <> 'decoded-frames-half-open'", "semantics"),
        (f"coalesce({n}, 0) < 1 or {n} <> size(timeline.durations)", "timeline"),
        ("exists(zip_with(slice(timeline.pts, 2, greatest(0, size(timeline.pts) - 1)), slice(timeline.pts, 1,"
         " greatest(0, size(timeline.pts) - 1)), (b, a) -> b <= a), x -> x)", "time not increasing"),
        ("exists(timeline.durations, d -> d <= 0)", "duration"),
        (f"zip_with(slice({ends}, 2, {n}), timeline.pts, (b, a) -> b - a) <> timeline.durations", "duration is not the interval"),
        ("coalesce(size(scenes), 0) < 1", "no scenes"),
        (f"scenes[0].start_frame <> 0 or element_at(scenes, -1).end_frame <> {n} or {starts} <> array_sort(array_distinct({starts}))"
         " or exists(zip_with(slice(scenes, 2, size(scenes) - 1), slice(scenes, 1, size(scenes) - 1), (b, a) ->"
         " b.start_frame <> a.end_frame), x -> x)", "partition"),
        (f"exists(scenes, s -> s.frame_count <> s.end_frame - s.start_frame or s.start_pts <> get({ends}, cast(s.start_frame as int))"
         f" or s.end_pts <> get({ends}, cast(s.end_frame as int)))", "scene values"),
        ("exists(scenes, s -> s.output_file like '/%' or '/' || s.output_file || '/' like '%/../%')", "output path"),
        (f"exists(boundaries, b -> b.frame <= 0 or b.frame >= {n} or b.decision not in ('cut', 'review') or b.pts <>"
         " get(timeline.pts, cast(b.frame as int)))", "boundary"),
        (f"transform(filter(boundaries, b -> b.decision = 'cut'), b -> b.frame) <> slice({starts}, 2, size(scenes) - 1)",
         "boundaries and partition"),
        ("source.sha256 is null or not source.sha256 rlike '^[0-9a-f]{64}$'", "source digest"),
        (f"source.frame_count is null or source.frame_count <> {n}", "frame count"),
    )
    fault = "case " + " ".join(f"when {c} then '{w}'" for c, w in rules) + " end"
    return doc.withColumn("fault", F.expr(fault))


def label_documents(docs: DataFrame) -> DataFrame:
    """(source_sha256, cuts, path) from (path, value): documents that have cuts,
    of several for one digest the last by path."""
    parsed = docs.select("path", F.from_json("value", "source_sha256 string, cuts array<bigint>").alias("d"))
    parsed = parsed.where("d.cuts is not null and d.source_sha256 is not null")
    return parsed.groupBy(F.col("d.source_sha256").alias("source_sha256")).agg(
        F.max_by("d.cuts", "path").alias("cuts"), F.max("path").alias("path")
    )


def frame_hashes(rows: DataFrame, time_base: str) -> DataFrame:
    """(key, pts, duration, size, hash, error) from lines of six fields; a key
    with another number of fields, another time base or no frames gives one row
    with its error and nothing else."""
    told = rows.selectExpr(
        "key", "line like '#%' as head", "nullif(regexp_extract(line, '^#tb 0: *(.*)$', 1), '') as tb", "split(line, ',') as parts"
    )
    state = told.groupBy("key").agg(
        F.max("tb").alias("base"), F.count_if(F.expr("not head and size(parts) <> 6")).alias("odd"), F.count_if(F.expr("not head")).alias("n")
    ).selectExpr(
        "key",
        f"case when odd > 0 then 'unsupported line' when base is null or base <> '{time_base}' then 'time base'"
        " when n = 0 then 'no frames' end as error",
    )
    field = "try_cast(trim(get(parts, {})) as bigint) as {}"
    fine = told.where("not head").join(state.where("error is null").select("key"), "key").selectExpr(
        "key", field.format(2, "pts"), field.format(3, "duration"), field.format(4, "size"), "trim(get(parts, 5)) as hash",
        "cast(null as string) as error",
    )
    none = "cast(null as bigint) as {}"
    return fine.union(
        state.where("error is not null").selectExpr(
            "key", none.format("pts"), none.format("duration"), none.format("size"), "cast(null as string) as hash", "error"
        )
    )


def scene_changes(rows: DataFrame) -> DataFrame:
    """(key, at_frame) of detector lines: a time line is a cut at the frame line
    before it, unless that is frame zero."""
    seen = F.when(F.col("line").like("frame:%"), F.expr("try_cast(regexp_extract(line, '^frame:([0-9]+)', 1) as bigint)"))
    at = F.last(seen, True).over(Window.partitionBy("key").orderBy("place"))
    told = rows.withColumn("at_frame", at)
    return told.where("line like 'lavfi.scd.time=%' and at_frame > 0").select("key", "at_frame")
