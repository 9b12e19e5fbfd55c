"""Change scores of frames and the baselines that call a change a boundary."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridewell.functions.lists import columns
from stridewell.registry import query
from stridewell.sources.frames import CHANGES, by_frame, changes, read, whole

# Thresholds of the rules (changes are in cents).
PIXEL, ADAPTIVE, ADAPTIVE_RATIO, REACH = 2700, 800, 3, 5
MIN_CHANGE, PEAK, RATIO, BLOCK_RATIO = 3000, 40, 2, 4
ACTIVE = 50
HISTOGRAM = 35
CONTEXT = 12


def pixel_cuts(m):
    return m.where((F.col("frame") > 0) & (F.col("mad") >= PIXEL))


PIXEL_SQL = f"SELECT source_id, frame FROM m WHERE frame > 0 AND mad >= {PIXEL}"


@query(f"""WITH {CHANGES} SELECT source_id, frame, pts, mad FROM m
 WHERE frame > 0 AND mad >= {PIXEL}""")
def q04_pixel_baseline(spark, sf_dir):
    return pixel_cuts(changes(spark, sf_dir)).select("source_id", "frame", "pts", "mad")


def adaptive(m):
    """Ten times the mean of the ten neighbours, ends repeated, as a sum."""
    near = Window.partitionBy("source_id").orderBy("frame").rowsBetween(-REACH, REACH)
    ends = whole().orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low = F.greatest(F.lit(0), REACH - F.col("frame"))
    high = F.greatest(F.lit(0), REACH - (F.col("n") - 1 - F.col("frame")))
    return m.withColumn("n", F.count("*").over(whole())).select(
        "*",
        (
            F.sum("mad").over(near)
            + low * F.first("mad").over(ends)
            + high * F.last("mad").over(ends)
            - F.col("mad")
        ).alias("around"),
    )


ADAPTIVE_SQL = f"""a AS (SELECT *, CAST(sum(mad) OVER (PARTITION BY source_id ORDER BY frame
 ROWS BETWEEN {REACH} PRECEDING AND {REACH} FOLLOWING)
 + greatest(0, {REACH} - frame) * first_value(mad) OVER w
 + greatest(0, {REACH} - (count(*) OVER (PARTITION BY source_id) - 1 - frame))
 * last_value(mad) OVER w - mad AS BIGINT) AS around FROM m WINDOW w AS (PARTITION BY source_id
 ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
ADAPTIVE_CUT = f"frame > 0 AND mad >= {ADAPTIVE} AND 10 * mad >= {ADAPTIVE_RATIO} * greatest(around, 1000)"


@query(f"""WITH {CHANGES}, {ADAPTIVE_SQL} SELECT source_id, frame, mad, around FROM a
 WHERE {ADAPTIVE_CUT}""")
def q06_adaptive_baseline(spark, sf_dir):
    return adaptive(changes(spark, sf_dir)).where(ADAPTIVE_CUT).select(
        "source_id", "frame", "mad", "around"
    )


def update_ratio(m, value: str, active, name: str, context: int = CONTEXT, floor: int = 100):
    """Adds ``name``: four times the baseline of a frame among the active
    ones: the upper quartile (linear) of up to ``context`` neighbours on either
    side without itself and the nearest, at least ``floor``; ``floor`` where
    the frame is not active or has no neighbour.  Scaled by four it is exact.

    Active frames are a window partition of their own, so one exchange by
    source serves every baseline."""
    order = Window.partitionBy("source_id", "active").orderBy("frame")
    left, right = order.rowsBetween(-context, -2), order.rowsBetween(2, context)
    near = m.withColumn("active", active).withColumn(
        "near",
        F.when(
            F.col("active"),
            F.array_sort(F.concat(F.collect_list(value).over(left), F.collect_list(value).over(right))),
        ),
    )
    low = "(3 * (size(near) - 1)) div 4"
    part = "(3 * (size(near) - 1)) % 4"
    quartile = (
        f"4 * element_at(near, cast({low} as int) + 1) + ({part}) * (element_at(near,"
        f" cast(least({low} + 1, size(near) - 1) as int) + 1) - element_at(near, cast({low} as int) + 1))"
    )
    base = f"if(near is null or size(near) = 0, {4 * floor}, greatest({4 * floor}, {quartile}))"
    return near.withColumn(name, F.expr(base).cast("long")).drop("near", "active")


def ratio_sql(value: str, active: str, name: str, floor: int = 100) -> str:
    return f"""{name}_n AS (SELECT source_id, frame, list_sort(list_concat(coalesce(list({value}) OVER
 (PARTITION BY source_id ORDER BY frame ROWS BETWEEN {CONTEXT} PRECEDING AND 2 PRECEDING), []),
 coalesce(list({value}) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN 2 FOLLOWING
 AND {CONTEXT} FOLLOWING), []))) AS near FROM m WHERE {active}),
 {name} AS (SELECT m.source_id, m.frame, CAST(CASE WHEN near IS NULL OR len(near) = 0 THEN {4 * floor}
 ELSE greatest({4 * floor}, round(4 * list_aggregate(near, 'quantile_cont', 0.75))) END AS BIGINT)
 AS base4 FROM m LEFT JOIN {name}_n USING (source_id, frame))"""


RATIO_SQL = ratio_sql("mad", f"mad > {ACTIVE}", "r")
BLOCK_ACTIVE = f"mad > {ACTIVE} OR kd > 20"
BLOCK_SQL = ratio_sql("kd", BLOCK_ACTIVE, "rb", 1)


@query(f"WITH {CHANGES}, {RATIO_SQL} SELECT source_id, frame, base4 FROM r")
def q07_update_ratio(spark, sf_dir):
    m = changes(spark, sf_dir)
    return update_ratio(m, "mad", F.col("mad") > ACTIVE, "base4").select("source_id", "frame", "base4")


@query(f"WITH {CHANGES}, {BLOCK_SQL} SELECT source_id, frame, base4 FROM rb")
def q08_block_update_ratio(spark, sf_dir):
    m = changes(spark, sf_dir)
    base = update_ratio(m, "kd", F.expr(BLOCK_ACTIVE), "base4", floor=1)
    return base.select("source_id", "frame", "base4")


CANDIDATE = f"""frame > 0 AND (mad >= {MIN_CHANGE} OR kd >= {PEAK})
 AND (4 * mad >= {RATIO} * r4 OR 4 * kd >= {BLOCK_RATIO} * b4 OR hd >= {HISTOGRAM})"""


def candidates(m, context: int = CONTEXT, min_change: int = MIN_CHANGE):
    r = update_ratio(m, "mad", F.col("mad") > ACTIVE, "r4", context)
    r = update_ratio(r, "kd", F.expr(BLOCK_ACTIVE), "b4", context, floor=1)
    return r.where(CANDIDATE.replace(str(MIN_CHANGE), str(min_change)))


CANDIDATES_SQL = f"""{RATIO_SQL}, {BLOCK_SQL}, c AS (SELECT * FROM (SELECT m.*, r.base4 AS r4,
 rb.base4 AS b4 FROM m JOIN r USING (source_id, frame) JOIN rb USING (source_id, frame))
 WHERE {CANDIDATE})"""


@query(f"WITH {CHANGES}, {CANDIDATES_SQL} SELECT source_id, frame, mad, kd, hd, r4, b4 FROM c")
def q09_temporal_candidates(spark, sf_dir):
    return candidates(changes(spark, sf_dir)).select(
        "source_id", "frame", "mad", "kd", "hd", "r4", "b4"
    )


#: Frames before and after in the active set that a candidate is compared over.
SIDE = 3


def slots(m):
    """Candidates with the six frames that their evidence is taken from: context
    before, the frame before, itself, context after, two before, one after.  A
    candidate's rank among active frames is its insertion point, so it need not
    be active itself; without any active frame the context is the whole source."""
    before = by_frame().rowsBetween(Window.unboundedPreceding, -1)
    ranked = m.withColumn("hit", F.expr(f"if({BLOCK_ACTIVE}, 1, 0)")).select(
        "*",
        F.coalesce(F.sum("hit").over(before), F.lit(0)).alias("j"),
        F.sum("hit").over(whole()).alias("n_active"),
        F.count("*").over(whole()).alias("n"),
    )
    active = ranked.where("hit = 1").select("source_id", F.col("j").alias("r"), F.col("frame").alias("at"))
    c = candidates(ranked).select(
        "source_id",
        F.col("frame").alias("candidate"),
        "n",
        F.greatest(F.lit(0), F.col("j") - SIDE).alias("low"),
        F.least(F.col("n_active") - 1, F.col("j") + SIDE).alias("high"),
    )
    for name in ("low", "high"):
        side = active.select("source_id", F.col("r").alias(name), F.col("at").alias(f"{name}_at"))
        c = c.join(side, ["source_id", name], "left")
    return c.selectExpr(
        "source_id",
        "candidate",
        "posexplode(array(greatest(0, coalesce(low_at, 0) - 1), candidate - 1, candidate,"
        " greatest(candidate, coalesce(high_at, n - 1)), greatest(0, candidate - 2),"
        " least(n - 1, candidate + 1))) as (slot, frame)",
    )


SLOTS_SQL = f"""{CANDIDATES_SQL}, act AS (SELECT source_id, list(frame ORDER BY frame) AS act FROM m
 WHERE {BLOCK_ACTIVE} GROUP BY source_id), n AS (SELECT source_id, count(*) AS n FROM m GROUP BY source_id),
 cj AS (SELECT c.source_id, c.frame AS candidate, n.n, act, (SELECT count(*) FROM m WHERE
 m.source_id = c.source_id AND m.frame < c.frame AND ({BLOCK_ACTIVE})) AS j
 FROM c JOIN n USING (source_id) LEFT JOIN act USING (source_id)),
 w AS (SELECT source_id, candidate, unnest([0, 1, 2, 3, 4, 5]) AS slot, unnest([greatest(0, coalesce(
 act[greatest(0, j - {SIDE}) + 1], 0) - 1), candidate - 1, candidate, greatest(candidate, coalesce(
 act[least(len(act) - 1, j + {SIDE}) + 1], n - 1)), greatest(0, candidate - 2),
 least(n - 1, candidate + 1)]) AS frame FROM cj)"""


@query(f"""WITH {CHANGES}, {SLOTS_SQL} SELECT w.source_id, candidate, slot, w.frame, cents FROM w
 JOIN m ON m.source_id = w.source_id AND m.frame = w.frame""")
def q10_candidate_slots(spark, sf_dir):
    """One row for each candidate and slot, with the requested frame's value."""
    m = changes(spark, sf_dir)
    return slots(m).join(m.select("source_id", "frame", "cents"), ["source_id", "frame"])


@query(f"""WITH {CHANGES}, {SLOTS_SQL}, v AS (SELECT w.source_id, candidate, slot, w.frame, cents FROM w JOIN m
 ON m.source_id = w.source_id AND m.frame = w.frame) SELECT source_id, candidate,
 {", ".join(f"max(CASE WHEN slot = {i} THEN cents END) AS s{i}" for i in range(6))},
 max(frame) AS ready_at FROM v GROUP BY source_id, candidate""")
def q51_candidate_windows(spark, sf_dir):
    """Each candidate's six values side by side, and the frame with which the
    last of them is there."""
    wide = q10_candidate_slots(spark, sf_dir).groupBy("source_id", "candidate")
    return wide.agg(
        *(F.max(F.when(F.col("slot") == i, F.col("cents"))).alias(f"s{i}") for i in range(6)),
        F.max("frame").alias("ready_at"),
    )


@query(f"""WITH {CHANGES}, {SLOTS_SQL}, last AS (SELECT source_id, max(frame) AS last_frame, count(DISTINCT frame)
 AS kept FROM w GROUP BY source_id) SELECT last.source_id, last_frame, kept, count(*) AS scanned FROM last
 JOIN m ON m.source_id = last.source_id AND m.frame <= last_frame GROUP BY last.source_id, last_frame, kept""")
def q52_scan_stop(spark, sf_dir):
    """How far the second pass must read: a source is left after the last frame
    that any candidate asks for, and frames that none asks for are not kept."""
    m = changes(spark, sf_dir)
    asked = slots(m).groupBy("source_id").agg(
        F.max("frame").alias("last_frame"), F.count_distinct("frame").alias("kept")
    )
    scanned = m.select("source_id", "frame").join(asked, "source_id").where("frame <= last_frame")
    return scanned.groupBy("source_id", "last_frame", "kept").agg(F.count("*").alias("scanned"))


# The decision ladder, first match wins; reasons are our own words.
LADDER = (
    ("flash_return", "review", "scene returns after the change"),
    ("corr > 985", "continuity", "nearly the same picture"),
    ("geometric AND NOT local_break", "continuity", "one geometry explains both"),
    ("broken AND hist >= 50 AND ratio >= 200", "cut", "tracking lost, colours changed"),
    ("broken AND ratio >= 800 AND corr < 300 AND within > 850", "cut", "tracking lost, strong update"),
    ("local_break", "review", "local break in a held frame"),
    ("broken AND ((hist >= 35 AND ratio >= 200) OR (ratio >= 500 AND corr < 700))", "review", "weak break"),
)
DECISION = "CASE " + " ".join(f"WHEN {c} THEN '{d}'" for c, d, _ in LADDER) + " ELSE 'continuity' END"
REASON = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in LADDER) + " ELSE 'no break' END"
#: Evidence, each field from columns of its own; shares in thousandths, ratios
#: and distances in hundredths.
EVIDENCE = """l_orderkey, l_partkey, l_suppkey, l_linenumber,
 CAST(l_partkey * 7 % 1000 AS BIGINT) AS corr, CAST(round(l_discount * 1000) AS BIGINT) AS hist,
 CAST(l_orderkey * 13 % 1200 AS BIGINT) AS ratio, CAST(l_suppkey * 11 % 50 AS BIGINT) AS track,
 CAST(l_partkey * 3 % 90 AS BIGINT) AS inliers, CAST(l_orderkey * 17 % 110 AS BIGINT) AS warp_residual,
 CAST(l_quantity AS BIGINT) % 16 AS sift_inliers, CAST(l_suppkey * 3 % 10 AS BIGINT) AS sift_cov,
 CASE WHEN l_linenumber = 4 THEN 100 ELSE CAST(l_orderkey * 5 % 120 AS BIGINT) END AS sift_residual,
 CAST(l_partkey * 11 % 2400 AS BIGINT) AS block_ratio, CAST(l_suppkey * 7 % 20 AS BIGINT) AS block_peak,
 CAST(800 + l_orderkey * 7 % 200 AS BIGINT) AS within, l_returnflag = 'R' AND l_linenumber = 1 AS flash_return"""
RULES = """(inliers >= 40 AND warp_residual < 55) OR (sift_inliers >= 8 AND sift_cov >= 4 AND sift_residual < 60)
 AS geometric, block_ratio > 1600 AND block_peak > 12 AND within > 980 AND corr < 960 AS local_break"""
DECIDED = f"""d AS (SELECT *, {DECISION} AS decision, {REASON} AS reason FROM (SELECT *, track < 20 OR local_break
 AS broken FROM (SELECT *, {RULES} FROM (SELECT {EVIDENCE} FROM lineitem) AS e) AS g) AS b)"""


def decide(evidence):
    """Adds decision and reason by the ladder to rows of evidence.  A residual
    that is not known counts as 1."""
    known = evidence.withColumn("sift_residual", F.coalesce("sift_residual", F.lit(100)))
    e = known.selectExpr("*", *columns(RULES)).withColumn("broken", F.expr("track < 20 or local_break"))
    return e.withColumns({"decision": F.expr(DECISION), "reason": F.expr(REASON)})


def decided(spark, sf_dir):
    return decide(read(spark, sf_dir, "lineitem").selectExpr(*columns(EVIDENCE)))


@query(f"""WITH {DECIDED} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, decision, reason FROM d
 WHERE decision <> 'continuity'""")
def q13_decide_ladder(spark, sf_dir):
    """Decision and reason of each boundary; continuity gives no row."""
    return decided(spark, sf_dir).where("decision <> 'continuity'").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "decision", "reason"
    )


@query(f"""WITH {DECIDED} SELECT l_suppkey, count(*) FILTER (decision = 'cut') AS cuts,
 count(*) FILTER (decision = 'review') AS reviews, CAST(coalesce(sum(l_partkey) FILTER (decision = 'cut'), 0)
 AS BIGINT) AS cut_parts FROM d GROUP BY l_suppkey""")
def q53_accepted_and_review(spark, sf_dir):
    """Accepted cuts and boundaries left to review, by supplier."""
    return decided(spark, sf_dir).groupBy("l_suppkey").agg(
        F.count_if(F.col("decision") == "cut").alias("cuts"),
        F.count_if(F.col("decision") == "review").alias("reviews"),
        F.coalesce(F.sum(F.when(F.col("decision") == "cut", F.col("l_partkey"))), F.lit(0)).alias("cut_parts"),
    )


@query(f"""WITH {CHANGES}, i AS (SELECT source_id, frame, frame - row_number() OVER
 (PARTITION BY source_id ORDER BY frame) AS g FROM m WHERE frame > 0 AND mad >= {MIN_CHANGE})
 SELECT source_id, min(frame) AS first_frame, max(frame) AS last_frame FROM i GROUP BY source_id, g""")
def q20_ordinal_runs(spark, sf_dir):
    hit = changes(spark, sf_dir).where((F.col("frame") > 0) & (F.col("mad") >= MIN_CHANGE))
    hit = hit.select("source_id", "frame", (F.col("frame") - F.row_number().over(by_frame())).alias("g"))
    return hit.groupBy("source_id", "g").agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame")
    ).drop("g")
