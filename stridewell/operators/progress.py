"""Event logs folded to the state of jobs and batches.

events stand for a batch's log: a user is a job, its first event starts it (but
for some, whose worker is lost before), view and click are progress and
certified scenes, purchase ends it well and error badly (interrupted for small
k, a lost worker for large k).  Some jobs have no end at all.  A lost worker
overrides an earlier success or interruption; otherwise the first end stays.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridewell.functions.lists import columns
from stridewell.registry import query
from stridewell.sources.frames import FRAMES, by_frame, frames, read

EVENT = """CASE WHEN event_type = 'purchase' THEN 'job_finished' WHEN event_type = 'error' AND k >= 98 THEN 'worker_lost'
 WHEN event_type = 'error' THEN 'job_failed' WHEN frame = 0 THEN 'job_started' WHEN event_type = 'click' THEN 'scene_certified'
 ELSE 'analysis_progress' END"""
ENDS = "('job_finished', 'job_failed', 'worker_lost')"
#: Jobs that never start, and jobs whose log has no end.
LOGGED = f"""NOT (source_id % 6 = 5 AND event NOT IN {ENDS}) AND NOT (source_id % 7 = 3 AND event IN {ENDS})"""
FIELDS = f"""event IN {ENDS} AS ends, event = 'scene_certified' AND k % 2 = 0 AS recovered,
 CASE WHEN event = 'job_failed' AND k < 50 THEN 'interrupted' END AS reason_code,
 CASE WHEN event = 'scene_certified' THEN 'exporting' WHEN k % 3 = 0 THEN 'probing' ELSE 'analyzing' END AS phase,
 CASE WHEN event IN {ENDS} THEN abs(cents) END AS observed_bytes"""
LOG = f"""{FRAMES}, e0 AS (SELECT *, {EVENT} AS event FROM f),
 lg AS (SELECT source_id, frame, pts, k, event, {FIELDS} FROM e0 WHERE {LOGGED})"""
#: The state that one end gives, and the state of a job.
OUTCOME = "CASE WHEN event = 'job_finished' THEN 'succeeded' WHEN reason_code = 'interrupted' THEN 'interrupted' ELSE 'failed' END"
STATE = """CASE WHEN lost THEN 'failed' WHEN first_end IS NOT NULL THEN first_end WHEN n_events > 0 THEN 'active'
 ELSE 'pending' END"""


def log(f):
    """Frames as a job's events with their fields."""
    e = f.withColumn("event", F.expr(EVENT)).where(LOGGED)
    return e.selectExpr("source_id", "frame", "pts", "k", "event", *columns(FIELDS))


def states(f):
    """One row a job, of all jobs: what its log adds up to.  Aggregates that do
    not depend on the order of rows: the first end and the last phase are the
    least and greatest by frame."""
    return fold(f.select("source_id").distinct(), log(f))


def fold(jobs, events):
    """The state of each of ``jobs`` by rows of its log (source_id, frame,
    event, ends, recovered, reason_code, phase, observed_bytes)."""
    e = events.withColumn("outcome", F.when(F.col("ends"), F.expr(OUTCOME)))
    folded = e.groupBy("source_id").agg(
        F.count("*").alias("n_events"),
        F.count_if("recovered").alias("recovered"),
        F.count_if("ends").alias("n_ends"),
        F.max(F.col("event") == "worker_lost").alias("lost"),
        F.min_by("outcome", F.when(F.col("ends"), F.col("frame"))).alias("first_end"),
        F.max_by("phase", F.when(~F.col("ends"), F.col("frame"))).alias("phase"),
        F.max("observed_bytes").alias("peak_bytes"),
    )
    folded = jobs.join(folded, "source_id", "left").na.fill(0, ["n_events", "recovered", "n_ends"])
    return folded.na.fill(False, ["lost"]).selectExpr(
        "source_id",
        "n_events",
        "recovered",
        "n_ends",
        f"{STATE} as state",
        f"if(({STATE}) = 'active', phase, null) as phase",
        "peak_bytes",
    )


STATES = f"""{LOG}, lo AS (SELECT *, CASE WHEN ends THEN {OUTCOME} END AS outcome FROM lg),
 fo AS (SELECT source_id, count(*) AS n_events, count(*) FILTER (recovered) AS recovered, count(*) FILTER (ends) AS n_ends,
 bool_or(event = 'worker_lost') AS lost, arg_min(outcome, frame) FILTER (ends) AS first_end,
 arg_max(phase, frame) FILTER (NOT ends) AS phase, max(observed_bytes) AS peak_bytes FROM lo GROUP BY source_id),
 s0 AS (SELECT j.source_id, coalesce(n_events, 0) AS n_events, coalesce(recovered, 0) AS recovered,
 coalesce(n_ends, 0) AS n_ends, coalesce(lost, false) AS lost, first_end, phase, peak_bytes FROM (SELECT DISTINCT source_id
 FROM f) AS j LEFT JOIN fo ON fo.source_id = j.source_id),
 st AS (SELECT source_id, n_events, recovered, n_ends, {STATE} AS state, CASE WHEN ({STATE}) = 'active' THEN phase END
 AS phase, peak_bytes FROM s0)"""
COUNTS = ("pending", "active", "succeeded", "failed", "interrupted")
SUMMARY = (
    "count(*) AS total, "
    + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in COUNTS)
    + ", CAST(sum(recovered) AS BIGINT) AS recovered_fallbacks, max(peak_bytes) AS peak_bytes"
)


@query(f"WITH {STATES} SELECT * FROM st")
def q36_event_state_fold(spark, sf_dir):
    return states(frames(spark, sf_dir))


@query(f"""WITH {STATES}, ph AS (SELECT string_agg(source_id || ':' || phase, ',' ORDER BY source_id) AS active_phases
 FROM st WHERE state = 'active'), lb AS (SELECT arg_max(observed_bytes, pts * 4096 + source_id) AS current_bytes FROM lg
 WHERE ends) SELECT {SUMMARY}, any_value(active_phases) AS active_phases, any_value(current_bytes) AS current_bytes
 FROM st, ph, lb""")
def q37_batch_status(spark, sf_dir):
    """One row: jobs by state, fallbacks, the phases of active jobs by job, the
    bytes last observed and their peak."""
    f = frames(spark, sf_dir)
    s = states(f)
    phases = (
        "array_join(transform(array_sort(collect_list(case when state = 'active' then struct(source_id, phase) end)),"
        " x -> concat(x.source_id, ':', x.phase)), ',')"
    )
    last = log(f).where("ends").agg(F.max_by("observed_bytes", F.struct("pts", "source_id")).alias("current_bytes"))
    whole = s.selectExpr("*").agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col("state") == x).alias(x) for x in COUNTS),
        F.sum("recovered").alias("recovered_fallbacks"),
        F.max("peak_bytes").alias("peak_bytes"),
        F.expr(phases).alias("active_phases"),
    )
    return whole.crossJoin(F.broadcast(last))  # one row each


@query(f"""WITH {STATES}, en AS (SELECT source_id, event, reason_code, observed_bytes, false AS synthesised FROM lg WHERE ends
 UNION ALL SELECT source_id, 'worker_lost', NULL, NULL, true FROM st WHERE n_ends = 0)
 SELECT source_id, event, reason_code, observed_bytes, synthesised FROM en""")
def q60_closed_log(spark, sf_dir):
    """The ends of all jobs; a job without one gets a lost worker."""
    f = frames(spark, sf_dir)
    ends = log(f).where("ends").select(
        "source_id", "event", "reason_code", "observed_bytes", F.lit(False).alias("synthesised")
    )
    none = f.select("source_id").distinct().join(ends.select("source_id"), "source_id", "left_anti")
    return ends.unionByName(
        none.selectExpr(
            "source_id",
            "'worker_lost' as event",
            "cast(null as string) as reason_code",
            "cast(null as bigint) as observed_bytes",
            "true as synthesised",
        )
    )


@query(f"""WITH {LOG}, n AS (SELECT source_id, frame, event, row_number() OVER (PARTITION BY source_id ORDER BY frame) AS nth
 FROM lg WHERE ends) SELECT source_id, frame, event, nth FROM n WHERE nth > 1""")
def q61_repeated_ends(spark, sf_dir):
    """Ends after a job's first one, which must not be there."""
    ends = log(frames(spark, sf_dir)).where("ends")
    nth = ends.withColumn("nth", F.row_number().over(by_frame()).cast("long"))
    return nth.where("nth > 1").select("source_id", "frame", "event", "nth")


@query(f"""WITH {STATES} SELECT source_id, state = 'succeeded' AS ok, CASE state WHEN 'succeeded' THEN NULL
 WHEN 'interrupted' THEN 'Interrupted' WHEN 'failed' THEN 'Failed' ELSE 'WorkerLost' END AS error_type,
 'job-' || lpad(CAST(source_id AS VARCHAR), 6, '0') AS output,
 CASE WHEN state = 'succeeded' THEN NULL ELSE 'job ' || source_id || ' is ' || state END AS error FROM st""")
def q62_batch_outcomes(spark, sf_dir):
    """A row for each job in order of its name, failures as rows of their own
    kind; the batch's list of files."""
    s = states(frames(spark, sf_dir)).selectExpr(
        "source_id",
        "state = 'succeeded' as ok",
        "case state when 'succeeded' then null when 'interrupted' then 'Interrupted' when 'failed' then 'Failed'"
        " else 'WorkerLost' end as error_type",
        "concat('job-', lpad(cast(source_id as string), 6, '0')) as output",
        "if(state = 'succeeded', null, concat('job ', source_id, ' is ', state)) as error",
    )
    return s.orderBy("output")


@query(f"""WITH {FRAMES}, s AS (SELECT source_id, frame FROM f WHERE k % 10 <> 0) SELECT source_id, before, frame FROM
 (SELECT *, coalesce(lag(frame) OVER (PARTITION BY source_id ORDER BY frame), -1) AS before FROM s) WHERE frame <> before + 1""")
def q38_sequence_gaps(spark, sf_dir):
    s = frames(spark, sf_dir).where("k % 10 <> 0")
    before = F.coalesce(F.lag("frame").over(by_frame()), F.lit(-1))
    return s.select("source_id", before.cast("long").alias("before"), "frame").where("frame <> before + 1")


@query(f"""WITH {FRAMES} SELECT source_id, frame, max(cents) OVER (PARTITION BY source_id ORDER BY frame) AS peak FROM f""")
def q39_peak_running_max(spark, sf_dir):
    return frames(spark, sf_dir).select("source_id", "frame", F.max("cents").over(by_frame()).alias("peak"))


#: Lines of a log as they might be on disk, some of them wrong.
LINE = """'{"schema_version":' || CASE WHEN k = 52 THEN '2' ELSE '1' END || ',"run_id":"' || CASE WHEN k = 41 THEN '' ELSE 'r' END
 || '","event":"' || event_type || '","phase":"p","sequence":' || CASE WHEN k = 13 THEN -1 ELSE frame END
 || CASE WHEN k % 5 = 0 THEN '' ELSE ',"completed":' || k END || ',"total":80'
 || CASE WHEN k = 42 THEN ',"job_id":""' ELSE ',"job_id":"j' || source_id || '"' END
 || CASE WHEN k = 22 THEN ',"elapsed_seconds":-0.5' ELSE ',"elapsed_seconds":1.5' END
 || CASE WHEN k = 31 THEN ',"diagnostics":"/var/log"' WHEN k = 32 THEN ',"diagnostics":"a/../b"' WHEN k = 33 THEN
 ',"diagnostics":""' ELSE '' END || CASE WHEN k = 43 THEN ',"observed_bytes":-7' ELSE '' END
 || CASE WHEN k = 51 THEN ',"colour":"red"' ELSE '' END || CASE WHEN k = 61 THEN '' ELSE '}' END"""
ALLOWED = (
    "schema_version run_id event phase sequence job_id scene_id attempt_id completed total unit elapsed_seconds outcome"
    " reason_code diagnostics recovered observed_bytes peak_bytes free_bytes"
).split()
#: Rules of an event in the order in which they are told.
WRONG = (
    ("version IS NULL OR version <> '1'", "unsupported schema"),
    ("stranger", "unknown field"),
    ("coalesce(run_id, '') = '' OR coalesce(event, '') = '' OR coalesce(phase, '') = ''", "empty name"),
    ("sequence IS NULL OR sequence < 0", "sequence"),
    ("job_id = ''", "empty job"),
    ("completed < 0 OR total < 0 OR observed_bytes < 0", "negative count"),
    ("completed > total", "completed beyond total"),
    ("elapsed < 0", "elapsed time"),
    ("diagnostics = '' OR diagnostics LIKE '/%' OR '/' || diagnostics || '/' LIKE '%/../%'", "diagnostics path"),
)
VIOLATION = "CASE " + " ".join(f"WHEN {c} THEN '{w}'" for c, w in WRONG) + " END"
NAMES = ("run_id", "event", "phase", "job_id", "diagnostics")
NUMBERS = ("sequence", "completed", "total", "observed_bytes")


@query(f"""WITH {FRAMES}, li AS (SELECT source_id, frame, {LINE} AS line FROM f),
 pa AS (SELECT source_id, frame, line, json_valid(line) AS valid FROM li), va AS (SELECT source_id, frame,
 json_extract_string(line, '$.schema_version') AS version,
 len(list_filter(json_keys(line), lambda x: NOT list_contains([{", ".join(f"'{a}'" for a in ALLOWED)}], x))) > 0 AS stranger,
 {", ".join(f"json_extract_string(line, '$.{n}') AS {n}" for n in NAMES)},
 {", ".join(f"TRY_CAST(json_extract_string(line, '$.{n}') AS BIGINT) AS {n}" for n in NUMBERS)},
 TRY_CAST(json_extract_string(line, '$.elapsed_seconds') AS DOUBLE) AS elapsed FROM pa WHERE valid)
 SELECT source_id, frame, {VIOLATION} AS violation FROM va WHERE ({VIOLATION}) IS NOT NULL
 UNION ALL SELECT source_id, frame, 'not an object' FROM pa WHERE NOT valid""")
def q63_event_violations(spark, sf_dir):
    """Log lines that break a rule, with the first rule broken; unknown fields
    count as well as wrong values."""
    lines = frames(spark, sf_dir).selectExpr("source_id", "frame", f"{LINE} as line")
    return violations(lines, "source_id", "frame")


def violations(lines, *keys: str):
    """Rows of ``lines`` (with ``line``) that are no valid event."""
    known = ", ".join(f"'{a}'" for a in ALLOWED)
    v = lines.withColumn("keys", F.json_object_keys("line")).selectExpr(
        *keys,
        "keys is null as broken",
        "get_json_object(line, '$.schema_version') as version",
        f"size(array_except(keys, array({known}))) > 0 as stranger",
        *(f"get_json_object(line, '$.{n}') as {n}" for n in NAMES),
        *(f"try_cast(get_json_object(line, '$.{n}') as bigint) as {n}" for n in NUMBERS),
        "try_cast(get_json_object(line, '$.elapsed_seconds') as double) as elapsed",
    )
    v = v.selectExpr(*keys, f"if(broken, 'not an object', {VIOLATION}) as violation")
    return v.where("violation is not null")


#: How a log's last line was left: cut in the middle, whole without its end, or ended.
LEFT = "CASE WHEN nth > 1 THEN line || chr(10) WHEN source_id % 3 = 0 THEN substr(line, 1, 40) WHEN source_id % 3 = 1 THEN line ELSE line || chr(10) END"


@query(f"""WITH {FRAMES}, li AS (SELECT source_id, frame, '{{"n":' || frame || ',"text":"' || event_type || ' ' || k ||
 '","more":"0123456789"}}' AS line, row_number() OVER (PARTITION BY source_id ORDER BY frame DESC) AS nth FROM f),
 wr AS (SELECT *, {LEFT} AS written FROM li), ok AS (SELECT *, nth = 1 AND right(written, 1) <> chr(10) AS open,
 json_valid(written) AS whole FROM wr) SELECT source_id, count(*) FILTER (NOT (open AND NOT whole)) AS lines,
 bool_or(open AND NOT whole) AS truncated, bool_or(open AND whole) AS completed,
 CAST(sum(strlen(written)) FILTER (NOT (open AND NOT whole)) + count(*) FILTER (open AND whole) AS BIGINT) AS bytes
 FROM ok GROUP BY source_id""")
def q64_log_tail_repair(spark, sf_dir):
    """Logs opened again: a last line without its end stays, ended, if it is
    valid, and goes if it was cut."""
    order = Window.partitionBy("source_id").orderBy(F.desc("frame"))
    text = "concat('{\"n\":', frame, ',\"text\":\"', event_type, ' ', k, '\",\"more\":\"0123456789\"}')"
    li = frames(spark, sf_dir).selectExpr("source_id", "frame", f"{text} as line")
    li = li.withColumn("nth", F.row_number().over(order)).withColumn("written", F.expr(LEFT))
    ok = li.selectExpr(
        "source_id",
        "written",
        "nth = 1 and right(written, 1) <> chr(10) as open",
        "json_object_keys(written) is not null as whole",
    )
    return ok.groupBy("source_id").agg(
        F.count_if(F.expr("not (open and not whole)")).alias("lines"),
        F.bool_or(F.expr("open and not whole")).alias("truncated"),
        F.bool_or(F.expr("open and whole")).alias("completed"),
        F.expr("sum(if(open and not whole, 0, octet_length(written))) + count_if(open and whole)").alias("bytes"),
    )


LIMIT = 60_000
#: A reservation's change in bytes: growth before a write, and what ends give back.
DELTA = "CASE WHEN event_type = 'error' THEN -least(cents, 9000) ELSE abs(cents) END"


@query(f"""WITH {FRAMES}, l AS (SELECT source_id, list({DELTA} ORDER BY frame) AS d FROM f GROUP BY source_id),
 r AS (SELECT source_id, list_reduce(list_concat([[CAST(0 AS BIGINT), 0, 0]], list_transform(d, lambda x: [x, 0, 0])),
 lambda s, x: CASE WHEN s[1] + x[1] > {LIMIT} THEN [s[1], s[2], s[3] + 1] ELSE [greatest(0, s[1] + x[1]),
 greatest(s[2], s[1] + x[1]), s[3]] END) AS s FROM l)
 SELECT source_id, s[1] AS held, s[2] AS peak, s[3] AS refused FROM r""")
def q65_budget_reservation(spark, sf_dir):
    """Reservations in order under a limit: one that would exceed it is refused
    and changes nothing; what is held at the end, the peak, and the refusals."""
    f = frames(spark, sf_dir).select("source_id", F.struct("frame", F.expr(DELTA).alias("d")).alias("s"))
    fold = (
        "aggregate(array_sort(collect_list(s)), named_struct('held', 0L, 'peak', 0L, 'refused', 0L), (a, x) ->"
        f" if(a.held + x.d > {LIMIT}, named_struct('held', a.held, 'peak', a.peak, 'refused', a.refused + 1),"
        " named_struct('held', greatest(0L, a.held + x.d), 'peak', greatest(a.peak, a.held + x.d), 'refused', a.refused)))"
    )
    return f.groupBy("source_id").agg(F.expr(fold).alias("s")).select("source_id", "s.held", "s.peak", "s.refused")


@query(f"""WITH {FRAMES}, t AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY frame DESC) AS nth FROM f)
 SELECT source_id, string_agg(event_type || ' ' || k, '|' ORDER BY frame) AS tail FROM t WHERE nth <= 20 GROUP BY source_id""")
def q66_log_tails(spark, sf_dir):
    """The last twenty lines of each log, as an error report shows them."""
    order = Window.partitionBy("source_id").orderBy(F.desc("frame"))
    t = frames(spark, sf_dir).withColumn("nth", F.row_number().over(order)).where("nth <= 20")
    said = "array_join(transform(array_sort(collect_list(struct(frame, concat(event_type, ' ', k) as said))), x -> x.said), '|')"
    return t.groupBy("source_id").agg(F.expr(said).alias("tail"))


@query("""WITH p AS (SELECT page_id, strlen(html) AS size, page_id % 10 = 0 AS link FROM pages)
 SELECT page_id, CAST(CASE WHEN link THEN 0 ELSE size END AS BIGINT) AS size, CAST(sum(CASE WHEN link THEN 0 ELSE size END)
 OVER (ORDER BY page_id) AS BIGINT) AS current_bytes FROM p""")
def q67_directory_bytes(spark, sf_dir):
    """Bytes of a folder as files arrive; links count nothing."""
    p = read(spark, sf_dir, "pages").selectExpr(
        "page_id", "cast(if(page_id % 10 = 0, 0, octet_length(html)) as bigint) as size", f"page_id div {CHUNK} as chunk"
    )
    # Sums of chunks first, so that no task holds all files.
    totals = p.groupBy("chunk").agg(F.sum("size").alias("t"))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select("chunk", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"))
    own = F.sum("size").over(Window.partitionBy("chunk").orderBy("page_id"))
    return p.join(start, "chunk").select("page_id", "size", (own + F.col("start")).alias("current_bytes"))


#: Files whose running total one task takes.
CHUNK = 4096


WIDTH = 44


@query(f"""WITH {STATES}, l AS (SELECT source_id, lpad(CAST(n_events * 7 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n_events * 7 % 60 AS VARCHAR), 2, '0')
 AS elapsed, state, n_events || ' events' AS a, recovered || ' recovered' AS b FROM st) SELECT source_id, CASE WHEN length(elapsed || ' ' || state || ' · ' ||
 a || ' · ' || b) <= {WIDTH} THEN elapsed || ' ' || state || ' · ' || a || ' · ' || b WHEN length(elapsed || ' ' || state || ' · ' || a) <= {WIDTH} THEN
 elapsed || ' ' || state || ' · ' || a ELSE elapsed || ' ' || state END AS line FROM l""")
def q115_status_lines(spark, sf_dir):
    """A job's line for a terminal: time, state, and what else fits."""
    long = "concat(elapsed, ' ', state, ' · ', a, ' · ', b)"
    mid = "concat(elapsed, ' ', state, ' · ', a)"
    return states(frames(spark, sf_dir)).selectExpr(
        "source_id", "state",
        "concat(lpad(cast(n_events * 7 div 60 as string), 2, '0'), ':', lpad(cast(n_events * 7 % 60 as string), 2, '0')) as elapsed",
        "concat(n_events, ' events') as a", "concat(recovered, ' recovered') as b",
    ).selectExpr(
        "source_id",
        f"case when length({long}) <= {WIDTH} then {long} when length({mid}) <= {WIDTH} then {mid} else concat(elapsed, ' ', state) end as line",
    )
