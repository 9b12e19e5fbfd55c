"""Export of segments: what may be exported, by which policy, and whether the
output holds the source's frames.

part stands for probed sources: names, brands and sizes give their properties.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridewell.functions import rational
from stridewell.functions.lists import columns
from stridewell.operators.segments import SEGMENTS, numbered, segments
from stridewell.registry import query
from stridewell.sources.frames import CHANGES, changes, read

PROPS = """p_partkey AS id,
 CASE p_partkey % 5 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' WHEN 2 THEN 'ffv1' WHEN 3 THEN 'h264' ELSE 'vp9' END AS codec,
 CASE WHEN p_partkey % 17 = 4 THEN 'smpte2084' WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE 'bt709' END AS transfer,
 CASE WHEN p_partkey % 23 = 5 THEN '[Dolby Vision RPU]' WHEN p_partkey % 23 = 6 THEN '[Mastering display]' ELSE '[]' END AS side,
 CASE WHEN p_partkey % 19 = 3 THEN 'tt' WHEN p_partkey % 19 = 4 THEN 'unknown' ELSE 'progressive' END AS field_order,
 p_partkey % 29 = 7 AS extras, p_partkey % 31 = 8 AS chapters,
 CASE WHEN p_partkey % 37 = 9 THEN 4294967296 WHEN p_partkey % 2 = 0 THEN 1000 ELSE 90000 END AS tb_den,
 p_size * 16 AS width, p_size * 9 + 8 AS height,
 CASE p_partkey % 6 WHEN 0 THEN 's16le' WHEN 1 THEN 's32le' WHEN 2 THEN 'f32le' WHEN 3 THEN 's16le' WHEN 4 THEN 's24le'
 ELSE 'f64le' END AS raw_format, CASE p_partkey % 4 WHEN 0 THEN 'stereo' WHEN 1 THEN 'mono' WHEN 2 THEN 'quad' ELSE '5.1' END
 AS layout, CASE p_partkey % 3 WHEN 0 THEN 'alac-or-pcm' WHEN 1 THEN 'alac' ELSE 'source-lossless' END AS audio_policy,
 CASE p_partkey % 8 WHEN 0 THEN 'review-copy' WHEN 1 THEN 'compact' WHEN 2 THEN 'auto' WHEN 3 THEN 'lossless' WHEN 4 THEN
 'copy-only' WHEN 5 THEN 'compact' WHEN 6 THEN 'auto' ELSE 'fast' END AS mode, p_partkey % 9 = 2 AS whole,
 CASE p_partkey % 3 WHEN 0 THEN '.MKV' WHEN 1 THEN '' ELSE '.mp4' END AS suffix"""
# Transfers and markers of high dynamic range, layouts, codecs.
HDR = """transfer IN ('smpte2084', 'arib-std-b67') OR lower(side) LIKE '%dovi%' OR lower(side) LIKE '%dolby%'
 OR lower(side) LIKE '%mastering%' OR lower(side) LIKE '%content light%' OR lower(side) LIKE '%hdr%'"""
REFUSED = (
    ("extras", "other streams"),
    ("chapters", "chapters"),
    ("field_order NOT IN ('unknown', 'progressive')", "interlaced"),
    ("codec NOT IN ('h264', 'hevc', 'ffv1')", "codec"),
    ("hdr", "high dynamic range"),
    ("codec = 'ffv1' AND tb_den <> 1000", "clock is not milliseconds"),
    ("tb_den > 2147483647", "clock too fine"),
)
REFUSAL = "CASE " + " ".join(f"WHEN {c} THEN '{w}'" for c, w in REFUSED) + " END"
SUFFIX = """CASE WHEN whole AND mode <> 'lossless' THEN CASE WHEN suffix = '' THEN '.mkv' ELSE lower(suffix) END
 WHEN mode = 'review-copy' THEN '.mp4' WHEN codec = 'ffv1' THEN '.mkv' ELSE '.mov' END"""


def sources(spark, sf_dir):
    p = read(spark, sf_dir, "part").selectExpr(*columns(PROPS))
    return p.withColumn("hdr", F.expr(HDR))


SOURCES = f"so AS (SELECT *, {HDR} AS hdr FROM (SELECT {PROPS} FROM part) AS x)"


@query(f"WITH {SOURCES} SELECT id, hdr, {REFUSAL} AS refusal, {SUFFIX} AS output_suffix FROM so")
def q70_export_eligibility(spark, sf_dir):
    """The first reason to refuse an export, and the suffix of its output."""
    return sources(spark, sf_dir).selectExpr(
        "id", "hdr", f"{REFUSAL} as refusal", f"{SUFFIX} as output_suffix"
    )


#: Bounds of analysis pictures, which may be larger than the source, and of
#: transition and thumbnail pictures, which may not.
SIZES = (("analysis", 320, 180, False), ("transition", 128, 96, True), ("thumbnail", 320, 240, True))


def _size(side: str, name: str, w: int, h: int, cap: bool, half_even: str) -> str:
    scale = f"least({w} * 1.0 / width, {h} * 1.0 / height{', 1.0' if cap else ''})"
    return f"CAST(greatest(2, {half_even}(CAST({side} * CAST({scale} AS DOUBLE) AS DECIMAL(18, 6)), 0)) AS BIGINT) AS {name}_{side}"


@query(f"""WITH {SOURCES} SELECT id, {", ".join(_size(s, n, w, h, c, "round_even") for n, w, h, c in SIZES for s in ("width", "height"))}
 FROM so""".replace("* 1.0 / width", "::DOUBLE / width").replace("* 1.0 / height", "::DOUBLE / height").replace(", 1.0)", ", 1.0::DOUBLE)"))
def q71_picture_sizes(spark, sf_dir):
    """Sizes that keep the aspect, halves rounded to even, at least two."""
    parts = [_size(s, n, w, h, c, "bround") for n, w, h, c in SIZES for s in ("width", "height")]
    parts = [p.replace("* 1.0 / ", "* 1.0D / ").replace(", 1.0)", ", 1.0D)") for p in parts]
    return sources(spark, sf_dir).selectExpr("id", *parts)


POLICIES = (
    ("review-copy", None, "review-copy", None, "copy"),
    ("compact", "h264", "compact", "libx264", "alac-or-pcm"),
    ("compact", "hevc", "compact", "libx265", "alac-or-pcm"),
    ("auto", None, "copy-then-lossless", None, "source-lossless"),
    ("lossless", None, "lossless", None, "source-lossless"),
    ("copy-only", None, "copy-only", None, "source-lossless"),
)


def _canonical(q: str) -> str:
    """Keys in order, no blanks; ``q`` quotes a string in SQL."""
    compact = "strategy = 'compact'"
    return (
        "'{\"audio\":{\"codec\":\"' || audio || '\"},\"certificate_schema\":2,\"mode\":\"' || mode || '\",\"schema_version\":1,"
        f"\"video\":{{\"crf\":' || CASE WHEN {compact} THEN '18' ELSE 'null' END || ',\"encoder\":' ||"
        f" CASE WHEN {compact} THEN '\"' || encoder || '\"' ELSE 'null' END || ',\"encoder_build\":null,\"encoder_threads\":' ||"
        f" CASE WHEN {compact} THEN '2' ELSE 'null' END || ',\"preset\":' || CASE WHEN {compact} THEN '\"medium\"' ELSE 'null' END"
        " || ',\"strategy\":\"' || strategy || '\"}}'"
    )


_VALUES = ", ".join(
    "(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in POLICIES
)
UNRESOLVED = """CASE WHEN strategy IS NULL AND mode = 'compact' THEN 'codec' WHEN strategy IS NULL THEN 'mode' END"""


@query(f"""WITH {SOURCES}, po(mode, codec, strategy, encoder, audio) AS (VALUES {_VALUES}),
 j AS (SELECT so.id, so.mode, strategy, encoder, audio FROM so LEFT JOIN po ON po.mode = so.mode
 AND (po.codec IS NULL OR po.codec = so.codec)) SELECT id, strategy, encoder, audio, {UNRESOLVED} AS error,
 CASE WHEN strategy IS NOT NULL THEN sha256({_canonical("")}) END AS policy_digest FROM j""")
def q72_policy_resolution(spark, sf_dir):
    """The policy of mode and codec from a mapping table, with the digest of
    its canonical text; what has none is told."""
    table = spark.createDataFrame(POLICIES, "mode string, only string, strategy string, encoder string, audio string")
    s = sources(spark, sf_dir).select("id", "mode", "codec")
    j = s.join(F.broadcast(table), (s["mode"] == table["mode"]) & F.coalesce(table["only"] == s["codec"], F.lit(True)), "left")
    j = j.select("id", s["mode"], "strategy", "encoder", "audio")
    return j.selectExpr(
        "id", "strategy", "encoder", "audio", f"{UNRESOLVED} as error",
        f"if(strategy is not null, sha2({_canonical('')}, 256), null) as policy_digest",
    )


AUDIO = """CASE WHEN audio_policy IN ('pcm', 'source-lossless') THEN 'native pcm policy'
 WHEN raw_format = 's16le' AND layout IN ('mono', 'stereo', '3.0', '4.0', '5.0', '5.1', '6.1(back)', '7.1(wide)')
 THEN '16-bit integer' WHEN audio_policy = 'alac' THEN 'refused' WHEN raw_format IN ('f32le', 'f64le') THEN 'float'
 WHEN raw_format <> 's16le' THEN 'integer precision' ELSE 'channel layout' END"""
CODEC = f"CASE ({AUDIO}) WHEN '16-bit integer' THEN 'alac' WHEN 'refused' THEN NULL ELSE 'pcm_' || raw_format END"


@query(f"WITH {SOURCES} SELECT id, {CODEC} AS codec, {AUDIO} AS reason FROM so")
def q73_audio_encoding(spark, sf_dir):
    """Integer samples of 16 bits in known layouts are compressed, all else
    stays as it is or, if compression was asked for, is refused."""
    return sources(spark, sf_dir).selectExpr("id", f"{CODEC} as codec", f"{AUDIO} as reason")


#: Properties of a policy's fields as documents might hold them.
SETTINGS = """id, mode, CASE WHEN id % 13 = 1 THEN 'guess' WHEN id % 13 = 2 THEN 'lossless' WHEN mode = 'auto' THEN 'copy-then-lossless'
 ELSE mode END AS strategy, CASE WHEN mode = 'compact' THEN CASE WHEN id % 11 = 3 THEN 'av1' ELSE 'libx264' END
 WHEN id % 11 = 4 THEN 'libx264' END AS encoder, CASE WHEN mode = 'compact' THEN 16 + id % 5 END AS crf,
 CASE WHEN mode = 'compact' THEN id % 70 END AS threads, CASE WHEN mode = 'review-copy' AND id % 3 > 0 OR id % 12 = 6 THEN
 'copy' WHEN id % 10 = 9 THEN 'mp3' ELSE 'pcm' END AS audio, CASE WHEN id % 41 = 0 THEN 3 ELSE 2 END AS certificate_schema"""
BROKEN = (
    ("strategy NOT IN ('copy-then-lossless', 'lossless', 'copy-only', 'compact', 'review-copy')", "strategy"),
    ("strategy = 'compact' AND coalesce(encoder, '') NOT IN ('libx264', 'libx265')", "encoder"),
    ("strategy = 'compact' AND coalesce(crf, 0) NOT IN (16, 18, 20)", "quality"),
    ("strategy = 'compact' AND (threads IS NULL OR threads NOT BETWEEN 1 AND 64)", "threads"),
    ("strategy <> 'compact' AND (encoder IS NOT NULL OR crf IS NOT NULL OR threads IS NOT NULL)", "settings without compact"),
    ("audio NOT IN ('source-lossless', 'alac', 'pcm', 'alac-or-pcm', 'copy')", "audio"),
    ("certificate_schema <> 2", "schema"),
    ("mode NOT IN ('compact', 'auto', 'lossless', 'copy-only', 'review-copy')", "mode"),
    ("strategy <> CASE mode WHEN 'auto' THEN 'copy-then-lossless' ELSE mode END", "mode and strategy"),
    ("(mode = 'review-copy') <> (audio = 'copy')", "audio copy and mode"),
)
BREACH = "CASE " + " ".join(f"WHEN {c} THEN '{w}'" for c, w in BROKEN) + " END"


@query(f"""WITH {SOURCES}, se AS (SELECT {SETTINGS} FROM so) SELECT id, {BREACH} AS breach FROM se WHERE ({BREACH}) IS NOT NULL""")
def q74_policy_breaches(spark, sf_dir):
    """Policies that break a rule within or across fields: the first one."""
    s = sources(spark, sf_dir).selectExpr(*columns(SETTINGS))
    return s.selectExpr("id", f"{BREACH} as breach").where("breach is not null")


#: An output's frames: the source's, but for some sources with faults.
OUT = """source_id, number, frame - start_frame AS place, CASE WHEN source_id % 5 = 1 AND k % 40 = 0 THEN 'changed'
 ELSE sha256(CAST(cents AS VARCHAR) || ':' || k) END AS hash, pts - start_pts + CASE WHEN source_id % 5 = 2 AND k % 40 = 0
 THEN 1 ELSE 0 END AS out_pts"""
LOST = "source_id % 5 = 3 AND frame = end_frame - 1 AND number % 4 = 0"


@query(f"""WITH {CHANGES}, {SEGMENTS}, sf AS (SELECT s.*, g.start_frame, g.end_frame, g.start_pts, g.end_pts
 FROM s JOIN g ON g.source_id = s.source_id AND g.number = s.number),
 o AS (SELECT {OUT} FROM sf WHERE NOT ({LOST})),
 j AS (SELECT sf.source_id, sf.number, sf.frame, sha256(CAST(cents AS VARCHAR) || ':' || k) AS want, o.hash,
 pts - start_pts AS want_pts, o.out_pts, o.place FROM sf LEFT JOIN o ON o.source_id = sf.source_id AND o.number = sf.number
 AND o.place = sf.frame - sf.start_frame)
 SELECT source_id, number, count(*) AS expected, count(place) AS decoded,
 min(frame) FILTER (hash <> want) AS first_pixels, min(frame) FILTER (out_pts <> want_pts) AS first_time,
 CASE WHEN count(*) <> count(place) THEN 'count' WHEN coalesce(min(frame) FILTER (hash <> want), 1000000000) <=
 coalesce(min(frame) FILTER (out_pts <> want_pts), 1000000000) AND count(*) FILTER (hash <> want) > 0 THEN 'pixels'
 WHEN count(*) FILTER (out_pts <> want_pts) > 0 THEN 'time' ELSE 'equal' END AS verdict,
 sha256(coalesce(string_agg(hash, '' ORDER BY frame), '')) AS digest FROM j GROUP BY source_id, number""")
def q75_exact_verification(spark, sf_dir):
    """Frames of each output against the source's by their place: equal number,
    the first frame whose picture or time differs, and the ordered digest."""
    m = changes(spark, sf_dir)
    g = segments(m).select("source_id", "number", "start_frame", "end_frame", "start_pts")
    sf = numbered(m).join(g, ["source_id", "number"])
    out = OUT.replace("sha256(", "sha2(").replace("|| k)", "|| k, 256)").replace("VARCHAR", "STRING")
    o = sf.where(f"not ({LOST})").selectExpr(*columns(out))
    want = sf.selectExpr(
        "source_id", "number", "frame", "frame - start_frame as place",
        "sha2(concat(cents, ':', k), 256) as want", "pts - start_pts as want_pts", "true as asked",
    )
    j = want.join(o.withColumn("there", F.lit(True)), ["source_id", "number", "place"], "full")
    per = j.groupBy("source_id", "number").agg(
        F.count("asked").alias("expected"),
        F.count("there").alias("decoded"),
        F.min(F.when(F.col("hash") != F.col("want"), F.col("frame"))).alias("first_pixels"),
        F.min(F.when(F.col("out_pts") != F.col("want_pts"), F.col("frame"))).alias("first_time"),
        F.expr(
            "sha2(array_join(transform(array_sort(collect_list(if(hash is not null, struct(frame, hash), null))),"
            " x -> x.hash), ''), 256)"
        ).alias("digest"),
    )
    verdict = (
        "case when expected <> decoded then 'count' when first_pixels is not null and first_pixels <="
        " coalesce(first_time, 1000000000) then 'pixels' when first_time is not null then 'time' else 'equal' end"
    )
    return per.withColumn("verdict", F.expr(verdict))


ATTRIBUTES = ("codec", "width", "height", "pixels", "aspect", "colours", "space", "transfer", "primaries", "place")
LISTED = """id, codec AS codec, CAST(width AS VARCHAR) AS width, CAST(height AS VARCHAR) AS height,
 CASE id % 4 WHEN 0 THEN 'unknown' ELSE 'yuv420p' END AS pixels, '1:1' AS aspect, CASE id % 6 WHEN 1 THEN 'tv' END AS colours,
 CASE id % 5 WHEN 2 THEN 'N/A' ELSE 'bt709' END AS space, transfer AS transfer, 'bt709' AS primaries,
 CASE id % 3 WHEN 1 THEN 'unspecified' ELSE 'left' END AS place"""
CHANGED = "CASE WHEN (id * 7 + {i}) % 29 = 3 THEN 'other' WHEN (id * 5 + {i}) % 43 = 2 THEN NULL ELSE {c} END"
UNKNOWN = "('', 'unknown', 'N/A', 'unspecified')"


@query(f"""WITH {SOURCES}, l AS (SELECT {LISTED}, CASE WHEN id % 8 = 1 THEN 90 END AS turned FROM so),
 o AS (SELECT id, {", ".join(f"{CHANGED.format(i=i, c=c)} AS {c}" for i, c in enumerate(ATTRIBUTES))},
 CASE WHEN id % 24 = 1 THEN NULL ELSE turned END AS turned FROM l),
 u AS ({" UNION ALL ".join(f"SELECT l.id, '{c}' AS attribute, l.{c} AS source, o.{c} AS output FROM l JOIN o USING (id)" for c in ATTRIBUTES)})
 SELECT * FROM u WHERE source IS NOT NULL AND source NOT IN {UNKNOWN} AND source IS DISTINCT FROM output
 UNION ALL SELECT l.id, 'rotation', CAST(l.turned AS VARCHAR), CAST(o.turned AS VARCHAR) FROM l JOIN o USING (id)
 WHERE l.turned IS DISTINCT FROM o.turned""")
def q29_property_compare(spark, sf_dir):
    """Ten attributes and the rotation of source and output: what the source
    does not know is skipped, what differs is told."""
    s = sources(spark, sf_dir).selectExpr(
        *columns(LISTED.replace("VARCHAR", "STRING")),
        "case when id % 8 = 1 then 90 end as turned",
    )
    o = s.selectExpr(
        "id",
        *(f"{CHANGED.format(i=i, c=c)} as out_{c}" for i, c in enumerate(ATTRIBUTES)),
        "case when id % 24 = 1 then null else turned end as out_turned",
    )
    pairs = ", ".join(f"struct('{c}' as attribute, {c} as source, out_{c} as output)" for c in ATTRIBUTES)
    turned = "struct('rotation' as attribute, cast(turned as string) as source, cast(out_turned as string) as output)"
    both = s.join(o, "id").selectExpr("id", f"inline(array({pairs}, {turned}))")
    told = f"attribute = 'rotation' or (source is not null and source not in {UNKNOWN})"
    return both.where(f"({told}) and not (source <=> output)")


#: Streams of a packet copy against the source's, in order.
STREAMS = """list_transform(range(0, CAST(id % 4 AS BIGINT)), lambda i: CASE WHEN (id + i) % 3 = 0 THEN 'aac' ELSE 'opus' END || '/' || CASE WHEN
 (id + i) % 2 = 0 THEN 48000 ELSE 44100 END || '/' || (1 + (id + i) % 6))"""


@query(f"""WITH {SOURCES}, a AS (SELECT id, codec, {STREAMS} AS streams FROM so), b AS (SELECT id, CASE WHEN id % 31 = 2 THEN 'copy'
 ELSE codec END AS codec, CASE WHEN id % 17 = 3 THEN streams[1:len(streams) - 1] WHEN id % 13 = 5 THEN
 list_transform(streams, lambda s: replace(s, '48000', '44100')) ELSE streams END AS streams FROM a)
 SELECT a.id, CASE WHEN a.codec <> b.codec THEN 'video codec' WHEN len(a.streams) <> len(b.streams) THEN 'stream count'
 WHEN a.streams <> b.streams THEN 'audio fields' ELSE 'equal' END AS inventory, CAST(len(a.streams) AS BIGINT) AS n_streams
 FROM a JOIN b USING (id)""")
def q76_packet_inventory(spark, sf_dir):
    """Stream inventories in order: codec, number of streams, their fields."""
    streams = (
        "transform(sequence(1, 4), i -> if(i > id % 4, null, concat(if((id + i - 1) % 3 = 0, 'aac', 'opus'), '/',"
        " if((id + i - 1) % 2 = 0, 48000, 44100), '/', 1 + (id + i - 1) % 6)))"
    )
    a = sources(spark, sf_dir).selectExpr("id", "codec", f"filter({streams}, s -> s is not null) as streams")
    b = a.selectExpr(
        "id",
        "if(id % 31 = 2, 'copy', codec) as out_codec",
        "case when id % 17 = 3 then slice(streams, 1, greatest(0, size(streams) - 1)) when id % 13 = 5 then"
        " transform(streams, s -> replace(s, '48000', '44100')) else streams end as outs",
    )
    return a.join(b, "id").selectExpr(
        "id",
        "case when codec <> out_codec then 'video codec' when size(streams) <> size(outs) then 'stream count'"
        " when exists(arrays_zip(streams, outs), z -> z.streams <> z.outs) then 'audio fields' else 'equal' end as inventory",
        "cast(size(streams) as bigint) as n_streams",
    )


@query(f"""WITH {CHANGES}, {SEGMENTS}, x AS (SELECT g.*, n FROM g JOIN (SELECT source_id, count(*) AS n FROM f GROUP BY source_id) AS t
 USING (source_id)), o AS (SELECT *, CASE WHEN source_id % 3 = 0 THEN NULL ELSE (SELECT min(pts) FROM f WHERE f.source_id = x.source_id)
 - 40000 * (source_id % 3) END AS container FROM x)
 SELECT source_id, number, start_frame = 0 AND end_frame = n AS whole, CAST((end_pts - start_pts) //
 gcd(end_pts - start_pts, 1000000) AS VARCHAR) || '/' || CAST(1000000 // gcd(end_pts - start_pts, 1000000) AS VARCHAR) AS duration,
 CAST((start_pts - coalesce(container, (SELECT min(pts) FROM f WHERE f.source_id = o.source_id))) //
 gcd(start_pts - coalesce(container, (SELECT min(pts) FROM f WHERE f.source_id = o.source_id)), 1000000) AS VARCHAR) || '/' ||
 CAST(1000000 // gcd(start_pts - coalesce(container, (SELECT min(pts) FROM f WHERE f.source_id = o.source_id)), 1000000) AS VARCHAR) AS seek,
 'scene-' || lpad(CAST(number AS VARCHAR), 4, '0') || '.mkv' AS output_file,
 'thumbnails/frame-' || lpad(CAST(start_frame AS VARCHAR), 9, '0') || '.jpg' AS thumbnail FROM o""")
def q77_intended_range(spark, sf_dir):
    """Each segment's exact length, its seek from the container's origin (the
    first time where the container has none), and its files' names."""
    w = Window.partitionBy("source_id")
    g = segments(changes(spark, sf_dir)).select(
        "*", F.min("start_pts").over(w).alias("first"), F.sum("frame_count").over(w).alias("n")
    )
    g = g.withColumn("origin", F.expr("coalesce(if(source_id % 3 = 0, null, first - 40000 * (source_id % 3)), first)"))
    return g.selectExpr(
        "source_id",
        "number",
        "start_frame = 0 and end_frame = n as whole",
        rational.text("end_pts - start_pts", "1000000") + " as duration",
        rational.text("start_pts - origin", "1000000") + " as seek",
        "concat('scene-', lpad(cast(number as string), 4, '0'), '.mkv') as output_file",
        "concat('thumbnails/frame-', lpad(cast(start_frame as string), 9, '0'), '.jpg') as thumbnail",
    )


#: What each way of export gives for a segment; a way counts if all its checks hold.
WAYS = """CASE WHEN number % 3 = 0 THEN true ELSE false END AS aligned, number = 1 AND end_frame = n AS whole, (source_id + number) % 4 <> 1
 AS copy_equal, (source_id + 2 * number) % 5 <> 2 AS seek_equal, (source_id * 3 + number) % 11 <> 3 AS full_equal"""
WAY = """CASE WHEN whole THEN 'whole copy' WHEN aligned AND copy_equal THEN 'stream copy' WHEN seek_equal THEN 'seek and encode'
 WHEN full_equal THEN 'full encode' END"""
TRIED = """CASE WHEN whole THEN 1 ELSE (CASE WHEN aligned THEN 1 ELSE 0 END) + CASE WHEN aligned AND copy_equal THEN 0 WHEN seek_equal THEN 1 ELSE 2 END END"""


@query(f"""WITH {CHANGES}, {SEGMENTS}, w AS (SELECT source_id, number, {WAYS} FROM g JOIN (SELECT source_id, count(*) AS n FROM f GROUP BY source_id)
 AS t USING (source_id)) SELECT source_id, number, {WAY} AS method, {TRIED} AS attempts, ({WAY}) IS NULL AS failed FROM w""")
def q110_export_method(spark, sf_dir):
    """Ways of export from the cheapest on, each verified before it is
    published: the first that holds, and how many were tried."""
    w = Window.partitionBy("source_id")
    g = segments(changes(spark, sf_dir)).withColumn("n", F.sum("frame_count").over(w)).selectExpr("source_id", "number", *columns(WAYS))
    return g.selectExpr("source_id", "number", f"{WAY} as method", f"{TRIED} as attempts", f"({WAY}) is null as failed")


#: Reference frames decoded anew, and the quality measured, of compact outputs.
COMPACT = """source_id, number, count(*) AS frames, count(*) FILTER (WHERE source_id % 5 = 1 AND k % 45 = 9) AS other_hashes,
 count(*) FILTER (WHERE source_id % 5 = 2 AND k % 45 = 8) AS other_times, min(900 + k) AS least_ssim, count(*) FILTER (WHERE source_id % 5 = 3
 AND k % 45 = 7) AS unmeasured"""
CERTIFIED = """CASE WHEN other_times > 0 THEN 'times' WHEN other_hashes > 0 THEN 'reference' WHEN unmeasured > 0 THEN 'quality count'
 WHEN least_ssim < 902 THEN 'quality' ELSE 'verified' END"""


@query(f"""WITH {CHANGES}, {SEGMENTS}, c AS (SELECT {COMPACT} FROM s GROUP BY source_id, number) SELECT source_id, number, frames, least_ssim,
 {CERTIFIED} AS verdict FROM c""")
def q111_compact_verification(spark, sf_dir):
    """Compact outputs: exact times, digests of a reference encoded anew, and a
    quality for each frame that is high enough."""
    s = numbered(changes(spark, sf_dir))
    c = s.groupBy("source_id", "number").agg(
        F.count("*").alias("frames"),
        F.count_if(F.expr("source_id % 5 = 1 and k % 45 = 9")).alias("other_hashes"),
        F.count_if(F.expr("source_id % 5 = 2 and k % 45 = 8")).alias("other_times"),
        (F.min("k") + 900).alias("least_ssim"),
        F.count_if(F.expr("source_id % 5 = 3 and k % 45 = 7")).alias("unmeasured"),
    )
    return c.selectExpr("source_id", "number", "frames", "least_ssim", f"{CERTIFIED} as verdict")


FLAGS = ("default", "dub", "forced", "original")


@query(f"""WITH {SOURCES}, d AS (SELECT id, CASE WHEN id % 4 = 1 THEN NULL ELSE 'l' || (id % 3) END AS language, CASE WHEN id % 5 = 2 THEN
 'commentary' END AS title, list_filter([{", ".join(f"'{x}'" for x in FLAGS)}], lambda x: (id * length(x)) % 3 = 1) AS flags, 44100 + id % 2 * 3900 AS rate,
 layout FROM so) SELECT id, sha256(coalesce(language, '') || '/' || coalesce(title, '') || '/' || array_to_string(list_sort(flags), ',') || '/' || rate ||
 '/' || layout) AS identity, array_to_string(list_sort(flags), ',') AS dispositions FROM d""")
def q112_audio_identity(spark, sf_dir):
    """What makes two sound tracks the same: language, title and the sorted
    names of the flags that are set, with rate and layout."""
    entries = ", ".join(f"'{x}', cast((id * length('{x}')) % 3 = 1 as boolean)" for x in FLAGS)
    d = sources(spark, sf_dir).selectExpr(
        "id", "if(id % 4 = 1, null, concat('l', id % 3)) as language", "if(id % 5 = 2, 'commentary', null) as title",
        f"array_join(array_sort(map_keys(map_filter(map({entries}), (k, v) -> v))), ',') as dispositions",
        "44100 + id % 2 * 3900 as rate", "layout",
    )
    said = "concat(coalesce(language, ''), '/', coalesce(title, ''), '/', dispositions, '/', rate, '/', layout)"
    return d.selectExpr("id", f"sha2({said}, 256) as identity", "dispositions")
