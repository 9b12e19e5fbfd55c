"""Timelines and indexes as documents: written, parsed and checked."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridewell.functions.lists import columns
from stridewell.operators.segments import SEGMENTS, numbered, segments
from stridewell.registry import query
from stridewell.sources import readers, sinks
from stridewell.sources.frames import CHANGES, FRAMES, by_frame, changes, frames, read

#: A timeline's columns with faults in some sources.
BENT = """CASE WHEN source_id % 8 = 1 AND frame = 3 THEN before WHEN source_id % 8 = 2 AND frame = 4 THEN NULL ELSE pts END AS pts,
 CASE WHEN source_id % 8 = 3 AND frame = 2 THEN 0 WHEN source_id % 8 = 4 AND frame = 5 THEN duration + 1 ELSE duration END AS duration,
 CASE WHEN source_id % 8 = 5 AND frame = 0 THEN -1 WHEN source_id % 8 = 6 AND frame = 1 THEN 0 WHEN is_key THEN frame END AS key,
 CASE WHEN source_id % 16 = 7 THEN 0 ELSE 1000000 END AS tb_den"""
TIMED = f"""tm AS (SELECT source_id, frame, is_key, pts, lag(pts) OVER (PARTITION BY source_id ORDER BY frame) AS before,
 coalesce(lead(pts) OVER (PARTITION BY source_id ORDER BY frame), own) - pts AS duration FROM f),
 be AS (SELECT source_id, frame, {BENT} FROM tm), ch AS (SELECT *, lag(pts) OVER (PARTITION BY source_id ORDER BY frame) AS p0,
 lead(pts) OVER (PARTITION BY source_id ORDER BY frame) AS p1, max(key) OVER (PARTITION BY source_id ORDER BY frame
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k0, count(*) OVER (PARTITION BY source_id) AS n FROM be)"""
#: Rules of a timeline in the order in which they are told.
RULES = (
    ("tb_den <= 0", "time base"),
    ("pts IS NULL", "no time"),
    ("pts <= p0", "time not increasing"),
    ("duration IS NULL OR duration <= 0", "duration"),
    ("p1 IS NOT NULL AND duration <> p1 - pts", "duration is not the interval"),
    ("key < 0 OR key >= n OR key <= k0", "key frames"),
)
FAULT = "CASE " + " ".join(f"WHEN {c} THEN '{w}'" for c, w in RULES) + " END"


def timeline(spark, sf_dir):
    f = frames(spark, sf_dir).select(
        "source_id", "frame", "is_key", "pts", F.lag("pts").over(by_frame()).alias("before"),
        (F.coalesce(F.lead("pts").over(by_frame()), F.col("own")) - F.col("pts")).alias("duration"),
    )
    return f.selectExpr("source_id", "frame", *columns(BENT))


@query(f"""WITH {FRAMES}, {TIMED} SELECT source_id, frame, {FAULT} AS fault FROM ch WHERE ({FAULT}) IS NOT NULL""")
def q97_timeline_faults(spark, sf_dir):
    """Frames that break a timeline's rules, with the first rule broken."""
    t = timeline(spark, sf_dir).select(
        "*",
        F.lag("pts").over(by_frame()).alias("p0"),
        F.lead("pts").over(by_frame()).alias("p1"),
        F.max("key").over(by_frame().rowsBetween(Window.unboundedPreceding, -1)).alias("k0"),
        F.count("*").over(Window.partitionBy("source_id")).alias("n"),
    )
    return t.selectExpr("source_id", "frame", f"{FAULT} as fault").where("fault is not null")


#: An index's scenes, boundaries and source with faults in some sources.
SCENE = """CASE WHEN source_id % 12 = 1 AND number = 2 THEN start_frame + 1 ELSE start_frame END AS i_start,
 CASE WHEN source_id % 12 = 2 AND number = 1 THEN frame_count + 1 ELSE frame_count END AS i_count,
 CASE WHEN source_id % 12 = 3 AND number = 2 THEN start_pts + 1 ELSE start_pts END AS i_pts,
 CASE WHEN source_id % 12 = 4 AND number = 1 THEN '../x.mkv' ELSE 'scene.mkv' END AS i_path"""
INDEX_RULES = (
    ("source_id % 12 = 5", "version"),
    ("source_id % 12 = 6", "semantics"),
    ("bad_start > 0", "partition: start_frame"),
    ("bad_count > 0", "partition: frame_count"),
    ("bad_pts > 0", "partition: start_pts"),
    ("bad_path > 0", "output path"),
    ("n_boundaries <> n_cuts", "boundaries and partition"),
    ("source_id % 12 = 8", "source digest"),
    ("source_id % 12 = 9", "frame count"),
)
INDEX_FAULT = "CASE " + " ".join(f"WHEN {c} THEN '{w}'" for c, w in INDEX_RULES) + " END"


@query(f"""WITH {CHANGES}, {SEGMENTS}, i AS (SELECT *, {SCENE} FROM g), a AS (SELECT source_id, count(*) - 1 AS n_cuts,
 count(*) FILTER (i_start <> start_frame) AS bad_start, count(*) FILTER (i_count <> frame_count) AS bad_count,
 count(*) FILTER (i_pts <> start_pts) AS bad_pts, count(*) FILTER (i_path LIKE '/%' OR '/' || i_path || '/' LIKE '%/../%') AS bad_path
 FROM i GROUP BY source_id), b AS (SELECT source_id, count(*) FILTER (frame > 0 AND mad >= 2700 AND NOT (source_id % 12 = 7 AND
 frame % 7 = 0)) AS n_boundaries FROM m GROUP BY source_id) SELECT source_id, {INDEX_FAULT} AS fault FROM a JOIN b USING (source_id)
 WHERE ({INDEX_FAULT}) IS NOT NULL""")
def q98_index_faults(spark, sf_dir):
    """Indexes that do not hold what their timeline gives, with the first rule
    broken: scenes are derived again and compared."""
    m = changes(spark, sf_dir)
    i = segments(m).selectExpr("*", *columns(SCENE))
    a = i.groupBy("source_id").agg(
        (F.count("*") - 1).alias("n_cuts"),
        F.count_if(F.expr("i_start <> start_frame")).alias("bad_start"),
        F.count_if(F.expr("i_count <> frame_count")).alias("bad_count"),
        F.count_if(F.expr("i_pts <> start_pts")).alias("bad_pts"),
        F.count_if(F.expr("i_path like '/%' or '/' || i_path || '/' like '%/../%'")).alias("bad_path"),
    )
    b = m.groupBy("source_id").agg(
        F.count_if(F.expr("frame > 0 and mad >= 2700 and not (source_id % 12 = 7 and frame % 7 = 0)")).alias("n_boundaries")
    )
    return a.join(b, "source_id").selectExpr("source_id", f"{INDEX_FAULT} as fault").where("fault is not null")


@query(f"""WITH {FRAMES} SELECT source_id, '{{"durations":[' || string_agg(d, ',' ORDER BY frame) || '],"keyframes":[' ||
 string_agg(CASE WHEN is_key THEN CAST(frame AS VARCHAR) END, ',' ORDER BY frame) || '],"pts":[' || string_agg(CAST(pts AS VARCHAR), ','
 ORDER BY frame) || '],"time_base":"1/1000000"}}' AS document, count(*) AS frames, true AS round_trip FROM (SELECT *,
 CAST(coalesce(lead(pts) OVER (PARTITION BY source_id ORDER BY frame), own) - pts AS VARCHAR) AS d FROM f) GROUP BY source_id""")
def q99_timeline_documents(spark, sf_dir):
    """Timelines as documents of parallel arrays, parsed back into rows and
    compared with what was written."""
    f = frames(spark, sf_dir).select(
        "source_id", "frame", "pts", "is_key",
        (F.coalesce(F.lead("pts").over(by_frame()), F.col("own")) - F.col("pts")).alias("duration"),
    )
    rows = F.array_sort(F.collect_list(F.struct("frame", "pts", "duration", "is_key")))
    doc = f.groupBy("source_id").agg(rows.alias("r")).selectExpr(
        "source_id",
        "r",
        "to_json(named_struct('durations', transform(r, x -> x.duration), 'keyframes', transform(filter(r, x -> x.is_key),"
        " x -> x.frame), 'pts', transform(r, x -> x.pts), 'time_base', '1/1000000')) as document",
    )
    schema = "durations array<bigint>, keyframes array<bigint>, pts array<bigint>, time_base string"
    back = doc.withColumn("t", F.from_json("document", schema, {"mode": "FAILFAST"}))
    same = (
        "t.pts = transform(r, x -> x.pts) and t.durations = transform(r, x -> x.duration) and t.keyframes ="
        " transform(filter(r, x -> x.is_key), x -> x.frame)"
    )
    return back.selectExpr("source_id", "document", "cast(size(r) as bigint) as frames", f"{same} as round_trip")


#: Cuts as a user writes them, of which only interior, increasing ones are whole.
CUTS = ("2", "3,7", "4,4", "9,2", "0", "5,x", "", "100000", "1,2,3")


@query(f"""WITH {FRAMES}, n AS (SELECT source_id, count(*) AS n FROM f GROUP BY source_id), w AS (SELECT place, said, list_transform(
 string_split(said, ','), lambda x: TRY_CAST(x AS BIGINT)) AS cuts FROM (SELECT unnest([{", ".join(f"'{c}'" for c in CUTS)}]) AS said,
 unnest(range(0, {len(CUTS)})) AS place)), j AS (SELECT source_id, n, place, said, cuts, CASE WHEN len(list_filter(cuts, lambda x: x IS NULL)) > 0
 THEN 'no number' WHEN cuts <> list_sort(list_distinct(cuts)) THEN 'not increasing' WHEN list_min(cuts) <= 0 OR list_max(cuts) >= n
 THEN 'not inside' END AS error FROM n CROSS JOIN w) SELECT source_id, place, said, error, CASE WHEN error IS NULL THEN 'cut' END AS decision,
 CASE WHEN error IS NULL THEN CAST(len(cuts) + 1 AS BIGINT) END AS scenes FROM j""")
def q100_explicit_cuts(spark, sf_dir):
    """Cut lists as text against each source: what is wrong with them, or how
    many scenes they give."""
    said = spark.createDataFrame(list(enumerate(CUTS)), "place long, said string").selectExpr(
        "*", "transform(split(said, ','), x -> try_cast(x as bigint)) as cuts"
    )
    n = frames(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n"))
    error = (
        "case when exists(cuts, x -> x is null) then 'no number' when cuts <> array_sort(array_distinct(cuts)) then"
        " 'not increasing' when array_min(cuts) <= 0 or array_max(cuts) >= n then 'not inside' end"
    )
    j = n.join(F.broadcast(said)).withColumn("error", F.expr(error))  # a user's list
    return j.selectExpr(
        "source_id", "place", "said", "error", "if(error is null, 'cut', null) as decision",
        "if(error is null, cast(size(cuts) + 1 as bigint), null) as scenes",
    )


@query(f"""WITH {CHANGES}, {SEGMENTS}, n AS (SELECT source_id, count(*) AS n FROM f GROUP BY source_id),
 c AS (SELECT g.*, n, least(n - 1, end_frame) AS ready_at, greatest(0, start_frame - 1) AS needed_from FROM g JOIN n USING (source_id)
 WHERE frame_count < 30), r AS (SELECT *, coalesce(lead(start_frame) OVER (PARTITION BY source_id ORDER BY number) - 1, ready_at + 1)
 AS keep_from FROM c) SELECT source_id, number, ready_at, keep_from, ready_at - needed_from + 1 AS held, greatest(0, least(ready_at + 1,
 keep_from) - needed_from) AS evicted FROM r""")
def q101_sliding_buffer(spark, sf_dir):
    """Single pass over short scenes with one frame of context on either side:
    when each is complete, how many frames are held then, and how many of them
    go because no later scene needs them."""
    g = segments(changes(spark, sf_dir))
    g = g.withColumn("n", F.sum("frame_count").over(Window.partitionBy("source_id"))).where("frame_count < 30")
    r = g.selectExpr("*", "least(n - 1, end_frame) as ready_at", "greatest(0, start_frame - 1) as needed_from")
    after = F.lead("start_frame").over(Window.partitionBy("source_id").orderBy("number")) - 1
    r = r.withColumn("keep_from", F.coalesce(after, F.col("ready_at") + 1))
    return r.selectExpr(
        "source_id", "number", "ready_at", "keep_from", "ready_at - needed_from + 1 as held",
        "greatest(0, least(ready_at + 1, keep_from) - needed_from) as evicted",
    )


#: Lines of frame digests as a hashing tool writes them, some of them wrong.
HASHED = """CASE WHEN frame = 0 AND source_id % 5 = 1 THEN '#tb 0: 1/90000' WHEN frame = 0 THEN '#tb 0: 1/1000000' WHEN frame = 1 THEN
 '#stream, dts, pts, duration, size, hash' WHEN source_id % 5 = 2 AND frame = 4 THEN '0, 1, 2' ELSE '0, ' || pts || ', ' || pts || ', ' ||
 (k + 1) || ', ' || (1000 + k) || ', ' || {sha} END"""


@query(f"""WITH {FRAMES}, l AS (SELECT source_id, frame, {HASHED.format(sha="sha256(CAST(cents AS VARCHAR))")} AS line FROM f),
 h AS (SELECT source_id, max(regexp_extract(line, '^#tb 0: *(.*)$', 1)) AS tb, count(*) FILTER (line NOT LIKE '#%' AND len(string_split(line, ',')) <> 6)
 AS odd, count(*) FILTER (line NOT LIKE '#%') AS n FROM l GROUP BY source_id), p AS (SELECT source_id, CAST(trim(string_split(line, ',')[3]) AS BIGINT) AS pts,
 CAST(trim(string_split(line, ',')[4]) AS BIGINT) AS duration, CAST(trim(string_split(line, ',')[5]) AS BIGINT) AS size, trim(string_split(line, ',')[6])
 AS hash FROM l JOIN h USING (source_id) WHERE line NOT LIKE '#%' AND tb = '1/1000000' AND odd = 0) SELECT source_id, pts, duration, size, hash, NULL AS error
 FROM p UNION ALL SELECT source_id, NULL, NULL, NULL, NULL, CASE WHEN odd > 0 THEN 'unsupported line' WHEN tb <> '1/1000000' THEN 'time base'
 ELSE 'no frames' END FROM h WHERE odd > 0 OR tb <> '1/1000000' OR n = 0""")
def q102_frame_hash_lines(spark, sf_dir):
    """Frame digests parsed from lines; a source with an odd line or another
    clock gives one error instead of rows."""
    rows = frames(spark, sf_dir).selectExpr(
        "source_id as key", "frame as place", f"{HASHED.format(sha='sha2(cast(cents as string), 256)')} as line"
    )
    return readers.frame_hashes(rows, "1/1000000").withColumnRenamed("key", "source_id")


DETECTED = "CASE WHEN frame % 2 = 0 THEN 'frame:' || (frame // 2) || ' pts:' || pts WHEN k % 3 = 0 THEN 'lavfi.scd.time=' || k ELSE 'lavfi.scd.mafd=' || k END"


@query(f"""WITH {FRAMES}, l AS (SELECT source_id, frame, {DETECTED} AS line FROM f), s AS (SELECT *, last_value(CASE WHEN line LIKE 'frame:%' THEN
 CAST(regexp_extract(line, '^frame:([0-9]+)', 1) AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY frame) AS at_frame FROM l)
 SELECT source_id, at_frame FROM s WHERE line LIKE 'lavfi.scd.time=%' AND at_frame > 0""")
def q103_scene_change_lines(spark, sf_dir):
    """Cuts from a detector's lines: a time line belongs to the frame line
    before it, and frame zero is no cut."""
    line = DETECTED.replace("//", "div")
    rows = frames(spark, sf_dir).selectExpr("source_id as key", "frame as place", f"{line} as line")
    return readers.scene_changes(rows).withColumnRenamed("key", "source_id")


@query("""WITH l AS (SELECT page_id, sha256(CAST(page_id // 3 AS VARCHAR)) AS source_sha256, CASE WHEN page_id % 4 <> 2 THEN page_id % 7 END AS n,
 'labels/' || lpad(CAST(page_id AS VARCHAR), 6, '0') || '.json' AS path FROM pages)
 SELECT source_sha256, arg_max(n, path) AS n_cuts, max(path) AS path FROM l WHERE n IS NOT NULL GROUP BY source_sha256""")
def q104_label_documents(spark, sf_dir):
    """Label documents by the digest of what they label: those with cuts, and
    of several the one that comes last by name."""
    text = (
        "concat('{\"source_sha256\":\"', sha2(cast(page_id div 3 as string), 256), '\"', if(page_id % 4 <> 2,"
        " concat(',\"cuts\":[', array_join(transform(filter(sequence(0, 7), i -> i < page_id % 7), i -> i + 1), ','), ']'), ''), '}')"
    )
    docs = read(spark, sf_dir, "pages").selectExpr(
        "concat('labels/', lpad(cast(page_id as string), 6, '0'), '.json') as path", f"{text} as value"
    )
    return readers.label_documents(docs).selectExpr("source_sha256", "cast(size(cuts) as bigint) as n_cuts", "path")


@query(f"""WITH {CHANGES}, {SEGMENTS} SELECT source_id, number, number || ',' || start_frame || ',' || end_frame || ',' || (end_frame - 1) || ',' ||
 frame_count || ',' || start_pts || ',' || end_pts AS line, '<section><h3>Scene ' || number || '</h3><p>' || replace(replace('<frames> ' ||
 start_frame || ' & on', '&', '&amp;'), '<', '&lt;') || '</p><img src="thumbnails/frame-' || lpad(CAST(start_frame AS VARCHAR), 9, '0') ||
 '.jpg"></section>' AS html FROM g""")
def q105_report_rows(spark, sf_dir):
    """Each segment as a line of the table and a section of the report."""
    g = segments(changes(spark, sf_dir)).withColumn("last_frame", F.col("end_frame") - 1)
    g = g.withColumn("reason", F.expr("concat('<frames> ', start_frame, ' & on')"))
    return g.select("source_id", "number", sinks.csv_line().alias("line"), sinks.section("reason").alias("html"))


@query(f"""WITH {CHANGES}, {SEGMENTS}, a AS (SELECT s.source_id, s.number, s.frame, sha256(cents || '/' || k) AS h FROM s),
 b AS (SELECT source_id, number, frame, CASE WHEN source_id % 6 = 2 AND k % 50 = 7 THEN 'x' ELSE sha256(cents || '/' || k) END AS h FROM s
 WHERE NOT (source_id % 6 = 3 AND frame = 5)) SELECT source_id, count(a.h) AS software, count(b.h) AS hardware, min(frame) FILTER
 (a.h IS DISTINCT FROM b.h) AS first_difference, count(*) FILTER (a.h IS DISTINCT FROM b.h) = 0 AS equal FROM a FULL JOIN b
 USING (source_id, frame) GROUP BY source_id""")
def q106_decoder_comparison(spark, sf_dir):
    """Frame digests of two decoders joined by frame, none lost on either side."""
    s = numbered(changes(spark, sf_dir))
    a = s.select("source_id", "frame", F.expr("sha2(concat(cents, '/', k), 256)").alias("a"))
    b = s.where("not (source_id % 6 = 3 and frame = 5)").selectExpr(
        "source_id", "frame", "if(source_id % 6 = 2 and k % 50 = 7, 'x', sha2(concat(cents, '/', k), 256)) as b"
    )
    j = a.join(b, ["source_id", "frame"], "full").withColumn("other", F.expr("not (a <=> b)"))
    return j.groupBy("source_id").agg(
        F.count("a").alias("software"), F.count("b").alias("hardware"),
        F.min(F.when(F.col("other"), F.col("frame"))).alias("first_difference"), (F.count_if("other") == 0).alias("equal"),
    )


NAMES = ("hard-cut", "permuted-cut", "local-edit", "interstitial", "pan", "shake", "exposure", "flash", "black-frame", "cover",
         "frozen", "dropped", "noise", "blur")
SEED = 6017
#: Value of a pixel of a generated sequence, by rule; sequences change at frame 60.
GENERATED = f"""CASE name WHEN 0 THEN CASE WHEN frame >= 60 THEN 255 - base ELSE base END WHEN 1 THEN CASE WHEN frame >= 60 THEN mirror ELSE base END
 WHEN 2 THEN CASE WHEN frame >= 60 AND x BETWEEN 4 AND 6 THEN 255 - base ELSE base END WHEN 3 THEN CASE WHEN frame BETWEEN 58 AND 62 THEN 210
 WHEN frame > 62 THEN 255 - base ELSE base END WHEN 4 THEN (base + 5 * frame) % 256 WHEN 5 THEN (base + 18 * (frame % 7)) % 256
 WHEN 6 THEN CASE WHEN frame >= 60 THEN base * 55 // 100 + 35 ELSE base END WHEN 7 THEN CASE WHEN frame = 60 THEN 255 ELSE base END
 WHEN 8 THEN CASE WHEN frame = 60 THEN 0 ELSE base END WHEN 9 THEN CASE WHEN frame BETWEEN 45 AND 75 THEN base * abs(frame - 60) // 15 ELSE base END
 WHEN 10 THEN (base + frame // 6 * 6) % 256 WHEN 11 THEN (base + frame + CASE WHEN frame >= 60 THEN 15 ELSE 0 END) % 256
 WHEN 12 THEN (base + (x * 7 + frame * 13) % 19) % 256 ELSE CASE WHEN frame >= 60 THEN (base + mirror) // 2 ELSE base END END"""


@query(f"""WITH g AS (SELECT name, frame, x, (({SEED} + x * 7919) * 31) % 225 + 15 AS base, (({SEED} + (11 - x) * 7919) * 31) % 225 + 15 AS mirror FROM
 (SELECT unnest(range(0, {len(NAMES)})) AS name) AS n, (SELECT unnest(range(0, 120)) AS frame) AS f, (SELECT unnest(range(0, 12)) AS x) AS p),
 v AS (SELECT name, frame, x, {GENERATED} AS v FROM g) SELECT ([{", ".join(f"'{n}'" for n in NAMES)}])[name + 1] AS name, frame,
 CAST(sum(v * (x + 1)) AS BIGINT) AS weighted, min(v) AS low, max(v) AS high FROM v GROUP BY v.name, frame""")
def q107_synthetic_sequences(spark, sf_dir):
    """Fourteen named sequences of 120 small pictures, by rule from a seed."""
    names = ", ".join(f"'{n}'" for n in NAMES)
    g = spark.range(len(NAMES) * 120 * 12).selectExpr(
        "id div 1440 as name", "id div 12 % 120 as frame", "id % 12 as x"
    ).selectExpr(
        "*", f"(({SEED} + x * 7919) * 31) % 225 + 15 as base", f"(({SEED} + (11 - x) * 7919) * 31) % 225 + 15 as mirror"
    )
    v = g.selectExpr("name", "frame", "x", f"{GENERATED.replace('//', 'div')} as v")
    return v.groupBy("name", "frame").agg(
        F.sum(F.col("v") * (F.col("x") + 1)).alias("weighted"), F.min("v").alias("low"), F.max("v").alias("high")
    ).selectExpr(f"array({names})[name] as name", "frame", "weighted", "low", "high")
