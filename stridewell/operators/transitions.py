"""Classes of short scenes by evidence over all their pictures, and the
editorial decisions on them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridewell.operators.pictures import CHANNELS, apart, total
from stridewell.registry import query
from stridewell.sources.frames import by_frame, read
from stridewell.sources.images import PIXEL_ROWS, PIXELS, converted, images

# What a neutral card must meet.
MICRO = 30
CARD = "10 * gray_min >= 9 * {p}"
CLEAR = (
    "100 * uniform_min >= 98 * {p} and 2 * temporal <= 3 * {c} and mean_max - mean_min <= 2 * {p}"
    " and texture <= 9 * {p} * {p} and edges = 0"
)
CARD, CLEAR = (x.format(p=PIXELS, c=CHANNELS) for x in (CARD, CLEAR))
LOUD, CONTEXT = 0.0001, 10 * CHANNELS
#: Peak of the scene's sound; null where it could not be measured.
AUDIO = "CASE (source_id + 2 * number) % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.01 ELSE 0.0 END"
#: Reasons in the order in which they count.
AMBIGUOUS = (
    (f"NOT ({CLEAR})", "uniform scene with changes or overlay"),
    ("frames = 1", "single frame"),
    ("audio IS NULL", "sound unknown"),
    (f"audio > {LOUD}", "sound present"),
    (f"before IS NULL OR after IS NULL OR least(before, after) <= {CONTEXT}", "no contrast on both sides"),
)
LADDER = (
    [(f"frames >= {MICRO}", "ordinary", "not a short scene"), (f"NOT ({CARD})", "ordinary", "ordinary content")]
    + [(c, "ambiguous", r) for c, r in AMBIGUOUS]
)
CLASS = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, k, _ in LADDER) + " ELSE 'candidate' END"
REASON = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in LADDER) + " ELSE 'quiet card between contents' END"
EVIDENCE = "gray_min, uniform_min, temporal, texture, mean_min, mean_max, edges, before, after"

EXTREMES = f"""{PIXEL_ROWS}, md AS (SELECT source_id, frame, median(y) AS mid FROM p GROUP BY source_id, frame),
 fr AS (SELECT p.source_id, p.number, p.frame, count(*) FILTER (d <= 6 AND y BETWEEN 40 AND 215) AS gray,
 count(*) FILTER (abs(y - mid) <= 2) AS uniform, sum(y) AS ysum, {PIXELS} * sum(y * y) - sum(y) * sum(y) AS var
 FROM p JOIN md ON md.source_id = p.source_id AND md.frame = p.frame GROUP BY p.source_id, p.number, p.frame),
 eg AS (SELECT a.source_id, a.frame, count(*) FILTER (abs(a.y - b.y) > 50) AS edge FROM p AS a JOIN p AS b
 ON b.source_id = a.source_id AND b.frame = a.frame AND b.i = a.i + 1 GROUP BY a.source_id, a.frame),
 ad AS (SELECT n.source_id, n.frame, sum(abs(n.r - o.r) + abs(n.g - o.g) + abs(n.b - o.b)) AS moved,
 any_value(n.number) <> any_value(o.number) AS fresh FROM p AS n JOIN p AS o ON o.source_id = n.source_id
 AND o.frame = n.frame - 1 AND o.i = n.i GROUP BY n.source_id, n.frame),
 sc AS (SELECT fr.source_id, fr.number, min(fr.frame) AS start_frame, count(*) AS frames, min(gray) AS gray_min,
 min(uniform) AS uniform_min, CAST(max(var) AS BIGINT) AS texture, CAST(min(ysum) AS BIGINT) AS mean_min,
 CAST(max(ysum) AS BIGINT) AS mean_max, max(edge) AS edges,
 CAST(coalesce(max(moved) FILTER (NOT fresh), 0) AS BIGINT) AS temporal, CAST(max(moved) FILTER (fresh) AS BIGINT) AS before
 FROM fr JOIN eg ON eg.source_id = fr.source_id AND eg.frame = fr.frame LEFT JOIN ad ON ad.source_id = fr.source_id
 AND ad.frame = fr.frame GROUP BY fr.source_id, fr.number),
 ex AS (SELECT *, lead(before) OVER (PARTITION BY source_id ORDER BY number) AS after, {AUDIO} AS audio FROM sc),
 tr AS (SELECT source_id, number, start_frame, frames, {EVIDENCE}, {CLASS} AS class, {REASON} AS reason FROM ex)"""


def extremes(spark, sf_dir):
    """One row a scene: extremes over its frames of neutral and uniform pixels,
    luma, texture and edges (in sums of pixels, so all is exact), the largest
    change inside it, and its contrast to the pictures before and after."""
    c = converted(images(spark, sf_dir))
    spread = (
        f"transform(sequence(0, {PIXELS - 1}), i -> array_max(slice(px, 3 * i + 1, 3)) - array_min(slice(px, 3 * i + 1, 3)))"
    )
    before = c.withColumns({"p0": F.lag("px").over(by_frame()), "n0": F.lag("number").over(by_frame())})
    f = before.selectExpr(
        "source_id",
        "number",
        "frame",
        f"size(filter(zip_with({spread}, y, (d, x) -> d <= 6 and x between 40 and 215), x -> x)) as gray",
        f"size(filter(y, x -> abs(x - element_at(array_sort(y), {PIXELS // 2 + 1})) <= 2)) as uniform",
        f"{total('y')} as ysum",
        f"{PIXELS} * {total('transform(y, x -> x * x)')} - {total('y')} * {total('y')} as var",
        f"size(filter(sequence(1, {PIXELS - 1}), i -> abs(y[i] - y[i - 1]) > 50)) as edge",
        f"{total(apart('px', 'p0'))} as moved",
        "number <> n0 as fresh",
    )
    scene = f.groupBy("source_id", "number").agg(
        F.min("frame").alias("start_frame"),
        F.count("*").alias("frames"),
        F.min("gray").cast("long").alias("gray_min"),
        F.min("uniform").cast("long").alias("uniform_min"),
        F.max("var").alias("texture"),
        F.min("ysum").alias("mean_min"),
        F.max("ysum").alias("mean_max"),
        F.max("edge").cast("long").alias("edges"),
        F.coalesce(F.max(F.when(~F.col("fresh"), F.col("moved"))), F.lit(0)).alias("temporal"),
        F.max(F.when(F.col("fresh"), F.col("moved"))).alias("before"),
    )
    after = F.lead("before").over(Window.partitionBy("source_id").orderBy("number"))
    return scene.select("*", after.alias("after"), F.expr(AUDIO).alias("audio"))


def classified(spark, sf_dir):
    e = extremes(spark, sf_dir)
    return e.selectExpr(
        "source_id", "number", "start_frame", "frames", *EVIDENCE.split(", "), f"{CLASS} as class", f"{REASON} as reason"
    )


@query(f"WITH {EXTREMES} SELECT * FROM tr")
def q25_transition_class(spark, sf_dir):
    """Class and reason of each scene by the ladder, with its evidence."""
    return classified(spark, sf_dir)


@query(f"""WITH {EXTREMES} SELECT im.source_id, im.frame, tr.class, tr.reason FROM im JOIN tr
 ON tr.source_id = im.source_id AND im.frame >= tr.start_frame AND im.frame < tr.start_frame + tr.frames
 WHERE tr.class <> 'ordinary'""")
def q57_annotated_frames(spark, sf_dir):
    """Frames with the class of the scene that holds them, by its number."""
    named = classified(spark, sf_dir).where("class <> 'ordinary'").select("source_id", "number", "class", "reason")
    return images(spark, sf_dir).select("source_id", "number", "frame").join(named, ["source_id", "number"]).drop("number")


#: Decisions that a user wrote for every source.
OVERRIDES = ("2=omit", "3=collapse", "3=keep", "x=keep", "5=drop", "7", "900=omit", "4=keep", "9=omit")
WRITTEN = f"""ov AS (SELECT pos, said, len(string_split(said, '=')) = 2 AND regexp_full_match(string_split(said, '=')[1],
 '[0-9]+') AND string_split(said, '=')[2] IN ('keep', 'collapse', 'omit') AS ok, TRY_CAST(string_split(said, '=')[1] AS
 BIGINT) AS number, string_split(said, '=')[2] AS action FROM (SELECT unnest([{", ".join(f"'{x}'" for x in OVERRIDES)}])
 AS said, unnest(range(0, {len(OVERRIDES)})) AS pos)),
 on1 AS (SELECT *, row_number() OVER (PARTITION BY ok, number ORDER BY pos) AS nth FROM ov),
 so AS (SELECT DISTINCT source_id FROM tr), st AS (SELECT so.source_id, pos, said, on1.number, action,
 CASE WHEN NOT ok THEN 'not a decision' WHEN nth > 1 THEN 'decided twice' WHEN tr.number IS NULL OR tr.class = 'ordinary'
 THEN 'no candidate' END AS error FROM so CROSS JOIN on1 LEFT JOIN tr ON tr.source_id = so.source_id
 AND tr.number = on1.number AND ok)"""


def overrides(spark, classes):
    """What was written, for every source: scene, action, and what is wrong."""
    said = spark.createDataFrame(list(enumerate(OVERRIDES)), "pos long, said string")
    parts = F.split("said", "=")
    valid = (F.size(parts) == 2) & parts[0].rlike("^[0-9]+$") & F.get(parts, F.lit(1)).isin("keep", "collapse", "omit")
    said = said.select(
        "pos",
        "said",
        valid.alias("ok"),
        F.expr("try_cast(split(said, '=')[0] as bigint)").alias("number"),
        F.get(parts, F.lit(1)).alias("action"),
    )
    nth = F.row_number().over(Window.partitionBy("ok", "number").orderBy("pos"))
    said = F.broadcast(said.withColumn("nth", nth))  # a user's list
    every = classes.select("source_id").distinct().join(said)
    known = classes.select("source_id", "number", "class").withColumn("ok", F.lit(True))
    error = F.expr(
        "case when not ok then 'not a decision' when nth > 1 then 'decided twice'"
        " when class is null or class = 'ordinary' then 'no candidate' end"
    )
    return every.join(known, ["source_id", "number", "ok"], "left").withColumn("error", error)


@query(f"""WITH {EXTREMES}, {WRITTEN} SELECT tr.source_id, tr.number, coalesce(st.action, 'keep') AS action,
 st.said IS NOT NULL AS overridden FROM tr LEFT JOIN st ON st.source_id = tr.source_id AND st.number = tr.number
 AND st.error IS NULL WHERE tr.class <> 'ordinary'""")
def q26_transition_decisions(spark, sf_dir):
    """Scenes to review are kept unless a valid decision says otherwise."""
    c = classified(spark, sf_dir)
    valid = overrides(spark, c).where("error is null").select("source_id", "number", "action", F.lit(True).alias("given"))
    return c.where("class <> 'ordinary'").join(valid, ["source_id", "number"], "left").select(
        "source_id",
        "number",
        F.coalesce("action", F.lit("keep")).alias("action"),
        F.coalesce("given", F.lit(False)).alias("overridden"),
    )


#: What a plan does with scenes to review: collapse every other one.
PLANNED = "CASE WHEN class = 'ordinary' THEN 'keep' WHEN number % 2 = 0 THEN 'collapse' WHEN number % 3 = 0 THEN 'omit' ELSE 'keep' END"


@query(f"""WITH {EXTREMES}, ac AS (SELECT source_id, number, start_frame, start_frame + frames AS end_frame, {PLANNED} AS action,
 lag(number) OVER w AS before, lead(number) OVER w AS after FROM tr WINDOW w AS (PARTITION BY source_id ORDER BY number)),
 co AS (SELECT *, action = 'collapse' AND before IS NOT NULL AND after IS NOT NULL AS gone FROM ac),
 nb AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY source_id ORDER BY number), false) AS gone_before FROM co),
 bo AS (SELECT source_id, start_frame AS cut FROM nb WHERE NOT gone AND NOT gone_before UNION SELECT source_id, (start_frame + end_frame) // 2
 FROM nb WHERE gone), en AS (SELECT source_id, max(end_frame) AS n FROM nb GROUP BY source_id),
 pc AS (SELECT source_id, cut AS start_frame, coalesce(lead(cut) OVER (PARTITION BY source_id ORDER BY cut), n) AS end_frame FROM bo JOIN en
 USING (source_id)) SELECT * FROM pc WHERE NOT EXISTS (SELECT 1 FROM nb WHERE nb.source_id = pc.source_id AND action = 'omit'
 AND nb.start_frame >= pc.start_frame AND nb.start_frame < pc.end_frame)""")
def q50_editorial_plan(spark, sf_dir):
    """The ranges that an editorial plan keeps.  A collapsed scene between two
    others loses both its boundaries and gets one in its middle; an omitted one
    goes, with what a collapsed neighbour left it.  Ranges that are not omitted
    cover the source exactly."""
    w = Window.partitionBy("source_id").orderBy("number")
    c = classified(spark, sf_dir).selectExpr(
        "source_id", "number", "start_frame", "start_frame + frames as end_frame", f"{PLANNED} as action"
    )
    inner = F.lag("number").over(w).isNotNull() & F.lead("number").over(w).isNotNull()
    c = c.withColumn("gone", (F.col("action") == "collapse") & inner)
    c = c.withColumn("gone_before", F.coalesce(F.lag("gone").over(w), F.lit(False)))
    c = c.withColumn("n", F.max("end_frame").over(Window.partitionBy("source_id")))
    marks = F.expr(
        "filter(array(if(gone, struct((start_frame + end_frame) div 2 as at, 0 as kind), if(gone_before, null,"
        " struct(start_frame as at, 0 as kind))), if(action = 'omit', struct(start_frame as at, 1 as kind), null)), x -> x is not null)"
    )
    m = c.select("source_id", "n", F.explode(marks).alias("m")).select("source_id", "n", "m.at", "m.kind")
    order = Window.partitionBy("source_id").orderBy("at", "kind")
    m = m.withColumn("piece", F.sum(1 - F.col("kind")).over(order))
    pieces = m.groupBy("source_id", "piece", "n").agg(F.min("at").alias("start_frame"), F.max("kind").alias("omitted"))
    after = F.lead("start_frame").over(Window.partitionBy("source_id").orderBy("piece"))
    pieces = pieces.withColumn("end_frame", F.coalesce(after, F.col("n")))
    return pieces.where("omitted = 0").select("source_id", "start_frame", "end_frame")


@query(f"WITH {EXTREMES}, {WRITTEN} SELECT source_id, pos, said, error FROM st WHERE error IS NOT NULL")
def q58_override_errors(spark, sf_dir):
    return overrides(spark, classified(spark, sf_dir)).where("error is not null").select(
        "source_id", "pos", "said", "error"
    )


#: Sound levels as a meter writes them, one stream a row of events.
METER = """'RMS level dB: ' || CASE WHEN k % 10 = 3 THEN '-inf' WHEN k % 10 = 4 THEN 'nan'
 ELSE '-' || k || '.5' END || CASE WHEN k % 10 = 5 THEN ' Number of samples: 0' ELSE '' END"""


@query(f"""WITH m AS (SELECT user_id AS source_id, regexp_extract(line, 'RMS level dB: (-?inf|nan|[-+.0-9]+)', 1) AS level,
 regexp_matches(line, 'Number of samples: 0') AS silent FROM (SELECT user_id, {METER} AS line FROM (SELECT user_id,
 CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) AS k FROM events))),
 v AS (SELECT source_id, silent, CASE WHEN level = '-inf' THEN 0.0 WHEN level <> 'nan' THEN
 pow(10, CAST(level AS DOUBLE) / 20) END AS a FROM m)
 SELECT source_id, CASE WHEN count(a) > 0 THEN round(max(a), 9) WHEN bool_or(silent) THEN 0.0 END::DOUBLE AS peak,
 count(a) AS measured FROM v GROUP BY source_id""")
def q59_peak_rms(spark, sf_dir):
    """Largest amplitude of a source's streams from their levels in decibels:
    zero where all are empty, null where nothing was measured."""
    k = "cast(regexp_extract(props, '(-?[0-9]+)', 1) as bigint)"
    line = read(spark, sf_dir, "events").selectExpr("user_id as source_id", f"{k} as k").selectExpr(
        "source_id", f"{METER} as line"
    )
    v = line.selectExpr(
        "source_id",
        "regexp_extract(line, 'RMS level dB: (-?inf|nan|[-+.0-9]+)', 1) as level",
        "line like '%Number of samples: 0%' as silent",
    ).selectExpr(
        "source_id",
        "silent",
        "case when level = '-inf' then 0.0D when level <> 'nan' then pow(10, try_cast(level as double) / 20) end as a",
    )
    return v.groupBy("source_id").agg(
        F.expr("case when count(a) > 0 then round(max(a), 9) when bool_or(silent) then 0.0D end").alias("peak"),
        F.count("a").alias("measured"),
    )
