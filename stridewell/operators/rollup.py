"""Rollups: profiles, weighted means, counters, budgets, property compares."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridewell.functions import rational
from stridewell.operators.segments import SEGMENTS, segments
from stridewell.registry import query
from stridewell.sources.frames import CHANGES, changes, read


@query("""SELECT l_returnflag || '-' || l_linestatus AS profile, count(*) AS runs,
 count(*) FILTER (l_discount < 0.05) AS passes, count(*) FILTER (l_discount >= 0.05) AS failures,
 CAST(sum(CASE WHEN l_discount < 0.05 THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS passed_quantity,
 round(CAST(sum(CASE WHEN l_discount < 0.05 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END) AS DOUBLE)
 / nullif(sum(CASE WHEN l_discount < 0.05 THEN CAST(l_quantity AS BIGINT) END), 0) / 100, 4) AS unit_price
 FROM lineitem GROUP BY 1""")
def q33_profile_rollup(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("profile"),
        (F.col("l_discount") < 0.05).alias("ok"),
        F.col("l_quantity").cast("long").alias("q"),
        F.expr("cast(round(l_extendedprice * 100) as bigint)").alias("price"),
    )
    return x.groupBy("profile").agg(
        F.count("*").alias("runs"),
        F.count_if("ok").alias("passes"),
        F.count_if(~F.col("ok")).alias("failures"),
        F.sum(F.when(F.col("ok"), F.col("q"))).alias("passed_quantity"),
        F.expr("round(try_divide(cast(sum(if(ok, price, null)) as double), sum(if(ok, q, null))) / 100, 4)").alias("unit_price"),
    )


@query("""SELECT CAST(l_linenumber AS BIGINT) AS profile, bool_or(infinite) AS infinite, CASE WHEN bool_or(infinite) THEN NULL ELSE
 round(CAST(sum(v * w) AS DOUBLE) / CAST(sum(w) AS DOUBLE), 6) END AS mean, min(CASE WHEN NOT infinite THEN v END) AS least
 FROM (SELECT l_linenumber, CAST(round(l_tax * 100) AS BIGINT) AS v, CAST(l_quantity AS BIGINT) - 5 AS w,
 l_orderkey % 1000 = 7 AND l_linenumber = 7 AS infinite, l_discount FROM lineitem) WHERE w > 0 AND l_discount > 0.0 GROUP BY 1""")
def q34_weighted_quality(spark, sf_dir):
    """Mean weighted by frames over runs that have a quality and a positive
    weight; one run without any loss makes the mean infinite, not the least."""
    x = read(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_linenumber as bigint) as profile",
        "cast(round(l_tax * 100) as bigint) as v",
        "cast(l_quantity as bigint) - 5 as w",
        "l_orderkey % 1000 = 7 and l_linenumber = 7 as infinite",
        "l_discount",
    )
    return x.where("w > 0 and l_discount > 0.0").groupBy("profile").agg(
        F.bool_or("infinite").alias("infinite"),
        F.expr("if(bool_or(infinite), null, round(cast(sum(v * w) as double) / sum(w), 6))").alias("mean"),
        F.min(F.when(~F.col("infinite"), F.col("v"))).alias("least"),
    )


@query("""SELECT o_orderpriority AS priority, string_agg(k || '=' || n, ',' ORDER BY k) AS counters FROM
 (SELECT o_orderpriority, l_returnflag || l_linestatus AS k, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey
 WHERE o_orderstatus <> 'P' GROUP BY 1, 2) GROUP BY 1""")
def q35_counter_merge(spark, sf_dir):
    """Each run has a map of counts; the maps of passed runs are added up key by
    key and given in order of the keys."""
    runs = read(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("o_orderkey"), F.concat("l_returnflag", "l_linestatus").alias("k")
    ).agg(F.count("*").alias("n"))
    runs = runs.groupBy("o_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("counts"))
    x = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").join(runs, "o_orderkey")
    merged = x.select(F.col("o_orderpriority").alias("priority"), F.explode("counts").alias("k", "n"))
    merged = merged.groupBy("priority", "k").agg(F.sum("n").alias("n"))
    said = "array_join(transform(array_sort(collect_list(struct(k, n))), s -> concat(s.k, '=', s.n)), ',')"
    return merged.groupBy("priority").agg(F.expr(said).alias("counters"))


@query("""SELECT l_shipdate AS day, count(*) AS corpus FROM lineitem GROUP BY l_shipdate""")
def q81_corpus_counts(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("day")).agg(F.count("*").alias("corpus"))


#: Lines of a quality meter; some without a number.
METER = """'n:' || l_linenumber || ' ssim:' || CASE WHEN l_partkey % 97 = 5 THEN 'nan' WHEN l_partkey % 89 = 6 THEN 'inf'
 WHEN l_partkey % 83 = 7 THEN '' ELSE '0.' || (900 + l_partkey % 100) END"""
SERIES = """CASE WHEN bad > 0 THEN 'no number' WHEN lines <> expected THEN 'count' ELSE 'measured' END"""


@query(f"""WITH m AS (SELECT l_orderkey, regexp_extract({METER}, 'ssim:([^ ]*)', 1) AS said FROM lineitem),
 v AS (SELECT l_orderkey, CASE WHEN said IN ('nan', 'inf', '') THEN NULL ELSE CAST(said AS DOUBLE) END AS v FROM m),
 g AS (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (v IS NULL) AS bad, CAST(round(sum(round(v * 1000))) AS BIGINT) AS s,
 min(v) AS minimum FROM v GROUP BY l_orderkey), e AS (SELECT *, lines + CASE WHEN l_orderkey % 50 = 9 THEN 1 ELSE 0 END
 AS expected FROM g) SELECT l_orderkey, {SERIES} AS state, CASE WHEN ({SERIES}) = 'measured' THEN round(s / 1000.0 / lines, 6)::DOUBLE END
 AS mean, CASE WHEN ({SERIES}) = 'measured' THEN minimum END AS minimum FROM e""")
def q82_metric_series(spark, sf_dir):
    """Mean and least of a metric's lines; a line without a finite number, or
    another number of lines than frames, is an error of the whole series."""
    m = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", f"regexp_extract({METER}, 'ssim:([^ ]*)', 1) as said")
    v = m.selectExpr("l_orderkey", "if(said in ('nan', 'inf', ''), null, try_cast(said as double)) as v")
    g = v.groupBy("l_orderkey").agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("v").isNull()).alias("bad"),
        F.sum(F.expr("cast(round(v * 1000) as bigint)")).alias("s"),
        F.min("v").alias("minimum"),
    )
    e = g.withColumn("expected", F.expr("lines + if(l_orderkey % 50 = 9, 1, 0)")).withColumn("state", F.expr(SERIES))
    return e.selectExpr(
        "l_orderkey", "state",
        "if(state = 'measured', round(s / 1000.0D / lines, 6), null) as mean",
        "if(state = 'measured', minimum, null) as minimum",
    )


@query("""SELECT l_orderkey AS job, count(DISTINCT sha256(l_returnflag || l_linestatus)) AS policies,
 count(DISTINCT sha256(l_returnflag || l_linestatus)) = 1 AS agreed, CAST(sum(CAST(l_quantity AS BIGINT) * 188) AS BIGINT)
 AS packet_bytes FROM lineitem GROUP BY 1""")
def q83_policy_and_packets(spark, sf_dir):
    """Whether all outputs of a job were made by one policy, and their packets'
    bytes."""
    x = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(
        F.count_distinct(F.sha2(F.concat("l_returnflag", "l_linestatus"), 256)).alias("policies"),
        F.sum(F.col("l_quantity").cast("long") * 188).alias("packet_bytes"),
    )
    return x.selectExpr("job", "policies", "policies = 1 as agreed", "packet_bytes")


@query("""SELECT CAST(sum(n) AS BIGINT) * 3 // 2 AS budget, CAST(sum(least(1048576, n * 3 // 2 // 8)) AS BIGINT) AS reserve,
 count(*) AS paths FROM (SELECT url, max(strlen(html)) AS n FROM pages GROUP BY url)""")
def q45_distinct_path_budget(spark, sf_dir):
    """Half as much again as the bytes of the different paths, and what is
    reserved of it for each."""
    p = read(spark, sf_dir, "pages").groupBy("url").agg(F.max(F.octet_length("html")).cast("long").alias("n"))
    return p.agg(
        F.expr("sum(n) * 3 div 2").alias("budget"),
        F.expr("sum(least(1048576, n * 3 div 2 div 8))").alias("reserve"),
        F.count("*").alias("paths"),
    )


#: Selections as written, job:scene by 1-based job.
PICKED = ("1:2", "3:1", "1:2", "2:900", "99999999:1", "4", "x:1", "5:3", "2:4", "0:1")
CHOSEN = """CASE WHEN NOT ok THEN 'not a selection' WHEN source_id IS NULL THEN 'no such job' WHEN number IS NULL THEN
 'no such scene' WHEN number % 4 = 0 THEN 'not exported' END"""


@query(f"""WITH {CHANGES}, {SEGMENTS}, jb AS (SELECT source_id, row_number() OVER (ORDER BY source_id) AS job FROM (SELECT DISTINCT
 source_id FROM f)), se AS (SELECT place, said, len(string_split(said, ':')) = 2 AND TRY_CAST(string_split(said, ':')[1] AS BIGINT)
 IS NOT NULL AND TRY_CAST(string_split(said, ':')[2] AS BIGINT) IS NOT NULL AS ok, TRY_CAST(string_split(said, ':')[1] AS BIGINT) AS job,
 TRY_CAST(string_split(said, ':')[2] AS BIGINT) AS scene FROM (SELECT unnest([{", ".join(f"'{x}'" for x in PICKED)}]) AS said,
 unnest(range(0, {len(PICKED)})) AS place)), j AS (SELECT se.*, jb.source_id, g.number, g.frame_count, g.end_pts - g.start_pts AS length
 FROM se LEFT JOIN jb ON jb.job = se.job LEFT JOIN g ON g.source_id = jb.source_id AND g.number = se.scene),
 e AS (SELECT *, {CHOSEN} AS error FROM j) SELECT place, said, error, CASE WHEN error IS NULL THEN frame_count END AS frame_count,
 CAST(sum(CASE WHEN error IS NULL THEN frame_count ELSE 0 END) OVER (ORDER BY place) AS BIGINT) AS frames_so_far,
 CAST(sum(CASE WHEN error IS NULL THEN length ELSE 0 END) OVER (ORDER BY place) AS BIGINT) AS micros_so_far FROM e""")
def q84_selection_lookup(spark, sf_dir):
    """Selections in the order written, repeats and all, looked up by job and
    scene; what is wrong is told; running totals of frames and exact time."""
    g = segments(changes(spark, sf_dir)).select(
        "source_id", "number", "frame_count", (F.col("end_pts") - F.col("start_pts")).alias("length")
    )
    said = spark.createDataFrame(list(enumerate(PICKED)), "place long, said string").selectExpr(
        "place", "said", "try_cast(split(said, ':')[0] as bigint) as job",
        "try_cast(get(split(said, ':'), 1) as bigint) as scene", "size(split(said, ':')) = 2 as two",
    ).selectExpr("*", "two and job is not null and scene is not null as ok")
    jobs = g.select("source_id").distinct().withColumn("job", F.row_number().over(Window.orderBy("source_id")))
    named = F.broadcast(said).join(jobs, "job", "left")  # a user's list
    j = named.join(g.withColumnRenamed("number", "scene").withColumn("number", F.col("scene")), ["source_id", "scene"], "left")
    e = j.withColumn("error", F.expr(CHOSEN))
    so_far = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    fine = F.col("error").isNull()
    return e.select(
        "place",
        "said",
        "error",
        F.when(fine, F.col("frame_count")).alias("frame_count"),
        F.sum(F.when(fine, F.col("frame_count")).otherwise(0)).over(so_far).alias("frames_so_far"),
        F.sum(F.when(fine, F.col("length")).otherwise(0)).over(so_far).alias("micros_so_far"),
    )


#: Shapes of calibration clips: codec, sound, bits, variable rate.
SHAPES = (("h264", "aac", 8, False), ("h264", "pcm", 8, False), ("hevc", "aac", 8, False), ("hevc", "none", 10, False),
          ("ffv1", "pcm", 10, False), ("h264", "aac", 8, True))
_SHAPES = ", ".join(f"('{c}', '{a}', {b}, {str(v).lower()})" for c, a, b, v in SHAPES)


@query(f"""WITH sh(codec, audio, bits, variable) AS (VALUES {_SHAPES}), r AS (SELECT s_suppkey AS source, codec, audio, bits, variable,
 crf, s_suppkey * 31 % 7 = 3 AND codec = 'hevc' AS failed, abs(CAST(round(s_acctbal * 100) AS BIGINT)) AS bytes FROM supplier, sh,
 (SELECT unnest([16, 18, 20]) AS crf)) SELECT source, codec || '-crf' || crf AS profile, audio, bits, variable,
 CASE WHEN failed THEN 'failed' ELSE 'passed' END AS structural, CASE WHEN failed THEN NULL ELSE bytes // (crf - 10) END
 AS output_bytes FROM r""")
def q85_calibration_runs(spark, sf_dir):
    """Every source with every clip shape and quality: a row a run, failures as
    rows too."""
    shapes = spark.createDataFrame(SHAPES, "codec string, audio string, bits int, variable boolean")
    crf = spark.createDataFrame([(x,) for x in (16, 18, 20)], "crf int")
    grid = F.broadcast(shapes.crossJoin(crf))  # eighteen rows
    s = read(spark, sf_dir, "supplier").selectExpr("s_suppkey as source", "abs(cast(round(s_acctbal * 100) as bigint)) as bytes")
    r = s.crossJoin(grid).withColumn("failed", F.expr("source * 31 % 7 = 3 and codec = 'hevc'"))
    return r.selectExpr(
        "source", "concat(codec, '-crf', crf) as profile", "audio", "bits", "variable",
        "if(failed, 'failed', 'passed') as structural", "if(failed, null, bytes div (crf - 10)) as output_bytes",
    )


@query(f"""WITH {CHANGES}, {SEGMENTS}, t AS (SELECT source_id, count(*) AS n, CAST(sum(frame_count) AS BIGINT) AS requested, CAST(sum(end_pts -
 start_pts) AS BIGINT) AS length FROM g WHERE number % 2 = 1 GROUP BY source_id), o AS (SELECT *, requested - CASE WHEN source_id % 9
 = 4 THEN 1 ELSE 0 END AS decoded, length - CASE source_id % 5 WHEN 1 THEN n * 11 WHEN 2 THEN n * 200 ELSE 0 END AS span,
 greatest(n, n * (1000000 // 90000)) AS tolerance FROM t) SELECT source_id, requested, CASE WHEN decoded <> requested THEN 'frames'
 WHEN span < length - tolerance THEN 'span' ELSE 'covered' END AS verdict FROM o""")
def q86_assembly_coverage(spark, sf_dir):
    """Chosen segments against the assembled output: as many frames, and a span
    short by no more than a tick or a microsecond for each piece."""
    g = segments(changes(spark, sf_dir)).where("number % 2 = 1")
    t = g.groupBy("source_id").agg(
        F.count("*").alias("n"),
        F.sum("frame_count").alias("requested"),
        F.sum(F.col("end_pts") - F.col("start_pts")).alias("length"),
    )
    o = t.selectExpr(
        "*",
        "requested - if(source_id % 9 = 4, 1, 0) as decoded",
        "length - case source_id % 5 when 1 then n * 11 when 2 then n * 200 else 0 end as span",
        "greatest(n, n * (1000000 div 90000)) as tolerance",
    )
    return o.selectExpr(
        "source_id", "requested",
        "case when decoded <> requested then 'frames' when span < length - tolerance then 'span' else 'covered' end as verdict",
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, greatest(1, (num * 1000000 + den - 1) // den) AS micros, abs(num * 3 - den) * 90000
 <= greatest(90000 // den, 3) AS within_tick, printf('%.12f', CAST(num AS DOUBLE) / den) AS decimal_text FROM (SELECT l_orderkey,
 l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) - 1 AS num, CAST(l_suppkey * 3 + 1 AS BIGINT) AS den FROM lineitem)""")
def q87_exact_arithmetic(spark, sf_dir):
    """Microseconds rounded up and at least one, closeness within a tick by
    cross-multiplication, and decimal text for hints only."""
    x = read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "cast(rint(l_quantity) as bigint) - 1 as num",
        "cast(l_suppkey * 3 + 1 as bigint) as den",
    )
    return rational.with_text(x, "cast(num as double) / den", "decimal_text").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey",
        f"greatest(1, {rational.ceil_div('num * 1000000', 'den')}) as micros",
        "abs(num * 3 - den) * 90000 <= greatest(90000 div den, 3) as within_tick",
        "decimal_text",
    )
