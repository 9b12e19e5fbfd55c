"""Digests, names, escapes, path rules, incremental reuse."""

from pyspark.sql import functions as F

from stridewell.functions.lists import columns
from stridewell.operators.segments import SEGMENTS, segments
from stridewell.registry import query
from stridewell.sources.frames import CHANGES, changes, read


#: What a finished job wrote down, as columns of its manifest, some of it stale.
MANIFEST = """doc_id, CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE digest END AS m_source, CASE WHEN doc_id % 11 = 1 THEN 'compact'
 ELSE 'auto' END AS m_request, CASE WHEN doc_id % 4 = 1 THEN 'build-1' ELSE 'build-2' END AS m_build,
 CASE WHEN doc_id % 13 = 2 THEN 'other' ELSE segments END AS m_segments, CASE WHEN doc_id % 17 = 3 THEN 'other' ELSE transitions END
 AS m_transitions, CASE WHEN doc_id % 19 = 4 THEN 'other' ELSE output END AS m_output, CASE WHEN doc_id % 23 = 5 THEN 'other'
 ELSE certificate END AS m_certificate, CASE WHEN doc_id % 3 = 0 THEN 'stream-copy' ELSE 're-encode' END AS m_method"""
NOW = """doc_id, sha256(text) AS digest, 'auto' AS request, 'build-2' AS build, sha256('s' || n_chars) AS segments,
 sha256('t' || n_chars) AS transitions, sha256('o' || text) AS output, sha256('c' || text) AS certificate"""
REASON = """CASE WHEN m_source IS NULL THEN 'new' WHEN m_source <> digest THEN 'source' WHEN m_request <> request THEN 'request'
 WHEN m_build <> build AND m_method <> 'stream-copy' THEN 'encoder' WHEN m_segments <> segments THEN 'segments'
 WHEN m_transitions <> transitions THEN 'transitions' WHEN m_output <> output THEN 'output' WHEN m_certificate <> certificate
 THEN 'certificate' END"""
RESUME = f"nw AS (SELECT {NOW} FROM documents), mf AS (SELECT {MANIFEST} FROM nw WHERE doc_id % 7 <> 3)"


def resume(spark, sf_dir):
    now = read(spark, sf_dir, "documents").selectExpr(*columns(NOW.replace("sha256(text)", "sha2(text, 256)").replace(
        "sha256('s' || n_chars)", "sha2('s' || n_chars, 256)").replace("sha256('t' || n_chars)", "sha2('t' || n_chars, 256)").replace(
        "sha256('o' || text)", "sha2('o' || text, 256)").replace("sha256('c' || text)", "sha2('c' || text, 256)")))
    old = now.where("doc_id % 7 <> 3").selectExpr(*columns(MANIFEST))
    return now.join(old, "doc_id", "left")


@query(f"""WITH {RESUME} SELECT doc_id, {REASON} AS reason FROM nw LEFT JOIN mf USING (doc_id) WHERE ({REASON}) IS NOT NULL""")
def q40_resume_manifest(spark, sf_dir):
    """What has to be done again and the first reason: everything the manifest
    binds must be as it is now.  An output that is a plain copy does not depend
    on the encoder's build."""
    return resume(spark, sf_dir).selectExpr("doc_id", f"{REASON} as reason").where("reason is not null")


@query(f"""WITH {RESUME}, j AS (SELECT *, ({REASON}) IS NULL AS reused FROM nw LEFT JOIN mf USING (doc_id))
 SELECT doc_id, m_method AS method, m_build <> build AS other_build FROM j WHERE reused""")
def q88_reused_outputs(spark, sf_dir):
    """Outputs that stay, copies made with another build of the encoder too."""
    j = resume(spark, sf_dir).where(f"({REASON}) is null")
    return j.selectExpr("doc_id", "m_method as method", "m_build <> build as other_build")


#: A job's index, its state of completed outputs, and certificates, some at odds.
ANCHORS = """source_id, number, 'scene-' || number AS path, 'cert-' || number AS certificate, sha256('o' || source_id || '/' || number)
 AS output_sha, sha256('c' || source_id || '/' || number) AS certificate_sha"""
STATED = """source_id, number, CASE WHEN number % 11 = 4 THEN 'elsewhere' ELSE path END AS s_path, certificate AS s_certificate,
 CASE WHEN number % 13 = 5 THEN 'other' ELSE output_sha END AS s_output, CASE WHEN number % 17 = 6 THEN 'other' ELSE certificate_sha
 END AS s_certificate_sha"""
CERTIFIED = """source_id, number, CASE WHEN number % 19 = 7 THEN 'other' ELSE output_sha END AS c_output, CASE WHEN number % 23 = 8
 THEN start_frame + 1 ELSE start_frame END AS c_first, end_frame - 1 AS c_last, CASE WHEN number % 29 = 9 THEN 'equal'
 ELSE 'not_applicable' END AS c_pixels"""
ODD = """CASE WHEN s_path IS NULL THEN 'not completed' WHEN s_path <> path OR s_certificate <> certificate THEN 'paths'
 WHEN s_output <> output_sha OR s_certificate_sha <> certificate_sha THEN 'digest' WHEN c_output IS NULL THEN 'no certificate'
 WHEN c_output <> output_sha THEN 'certified another output' WHEN c_first <> start_frame OR c_last <> end_frame - 1 THEN 'range'
 WHEN c_pixels = 'equal' THEN 'claims equal pixels' END"""
ANCHORED = f"""{SEGMENTS}, ix AS (SELECT *, {ANCHORS.replace("source_id, number, ", "", 1)} FROM g), sta AS (SELECT {STATED} FROM ix WHERE
 number % 7 <> 2), ce AS (SELECT {CERTIFIED} FROM ix WHERE number % 31 <> 10)"""


@query(f"""WITH {CHANGES}, {ANCHORED}, j AS (SELECT ix.source_id, ix.number, {ODD} AS fault FROM ix
 LEFT JOIN sta ON sta.source_id = ix.source_id AND sta.number = ix.number
 LEFT JOIN ce ON ce.source_id = ix.source_id AND ce.number = ix.number) SELECT * FROM j WHERE fault IS NOT NULL""")
def q89_record_integrity(spark, sf_dir):
    """Index, completed state and certificate of each segment joined on their
    key: the first of their disagreements."""
    sha = lambda x: x.replace("sha256('o' || source_id || '/' || number)", "sha2('o' || source_id || '/' || number, 256)").replace(
        "sha256('c' || source_id || '/' || number)", "sha2('c' || source_id || '/' || number, 256)")
    ix = segments(changes(spark, sf_dir)).selectExpr("start_frame", "end_frame", *columns(sha(ANCHORS)))
    st = ix.where("number % 7 <> 2").selectExpr(*columns(STATED))
    ce = ix.where("number % 31 <> 10").selectExpr(*columns(CERTIFIED))
    j = ix.join(st, ["source_id", "number"], "left").join(ce, ["source_id", "number"], "left")
    return j.selectExpr("source_id", "number", f"{ODD} as fault").where("fault is not null")


@query(f"""WITH {CHANGES}, {SEGMENTS}, want AS (SELECT source_id, number FROM g), done AS (SELECT source_id, number +
 CASE WHEN source_id % 4 = 1 THEN number % 2 ELSE 0 END AS number FROM g WHERE NOT (source_id % 3 = 1 AND number = 2))
 SELECT source_id, number, 'missing' AS kind FROM (SELECT * FROM want EXCEPT SELECT * FROM done)
 UNION ALL SELECT source_id, number, 'unexpected' FROM (SELECT * FROM done EXCEPT SELECT * FROM want)""")
def q90_completeness(spark, sf_dir):
    """Completed keys against expected ones, both ways."""
    want = segments(changes(spark, sf_dir)).select("source_id", "number")
    done = want.where("not (source_id % 3 = 1 and number = 2)").selectExpr(
        "source_id", "number + if(source_id % 4 = 1, number % 2, 0) as number"
    )
    missing = want.exceptAll(done).distinct().withColumn("kind", F.lit("missing"))
    extra = done.join(want, ["source_id", "number"], "left_anti").distinct().withColumn("kind", F.lit("unexpected"))
    return missing.join(done, ["source_id", "number"], "left_anti").union(extra)


@query(r"""SELECT page_id, CASE WHEN slug = '' THEN 'video' ELSE slug END || '-' || substr(sha256(url), 1, 12) AS name
 FROM (SELECT page_id, url, substr(trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g'), '.-'), 1, 70) AS slug FROM pages)""")
def q41_slug_names(spark, sf_dir):
    slug = F.expr(r"substr(trim(both '.-' from regexp_replace(url, '[^A-Za-z0-9_.-]+', '-')), 1, 70)")
    p = read(spark, sf_dir, "pages").select("page_id", "url", slug.alias("slug"))
    return p.select(
        "page_id",
        F.concat(F.when(F.col("slug") == "", "video").otherwise(F.col("slug")), F.lit("-"), F.sha2("url", 256).substr(1, 12)).alias("name"),
    )


@query("""SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'),
 '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;')) AS escaped FROM pages""")
def q42_html_escape(spark, sf_dir):
    x = F.col("html")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(mark), F.lit(name))
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(x, 256).alias("escaped"))


PATHS = """CASE WHEN page_id % 9 = 0 THEN '/' WHEN page_id % 9 = 1 THEN '../' WHEN page_id % 9 = 2 THEN 'C:' WHEN page_id % 9 = 3
 THEN 'a' || chr(92) ELSE '' END || {host}"""


@query(f"""WITH p AS (SELECT page_id, {PATHS.format(host="regexp_replace(url, '^[a-z]+://', '')")} AS path FROM pages),
 c AS (SELECT *, NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..') AS contained FROM p)
 SELECT page_id, path, contained, contained AND strpos(path, ':') = 0 AND strpos(path, chr(92)) = 0 AS asset FROM c""")
def q43_path_containment(spark, sf_dir):
    """Relative paths without a step up, and the stricter form of a report's
    assets."""
    p = read(spark, sf_dir, "pages").selectExpr(
        "page_id", f"{PATHS.format(host=HOST)} as path"
    )
    c = p.withColumn("contained", F.expr("not startswith(path, '/') and not array_contains(split(path, '/'), '..')"))
    return c.selectExpr("*", "contained and instr(path, ':') = 0 and instr(path, chr(92)) = 0 as asset")


HOST = "regexp_replace(url, '^[a-z]+://', '')"
# What a release must not hold, and files that batches take.
SUFFIXES = ".mkv .mp4 .mov .avi .webm .jpg .jpeg .png .gif .rgb .npy .npz .wav .flac .pth .pt .onnx .safetensors .pem .key".split()
PARTS = "private work-private .venv __pycache__ node_modules".split()
VIDEO = ".mp4 .m4v .mov .mkv .webm .avi .mts .m2ts .ts .mpeg .mpg".split()
ENDINGS = ("", ".py", ".MP4", ".json", ".pem", "/private/x.txt", "/benchmarks/annotations/a.json", "/benchmarks/results/own.json",
           "/benchmarks/results/synthetic.json", "/../y", ".mkv", ".m2ts")


def _quoted(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


FILES = "CASE WHEN page_id % 17 = 3 THEN '/' ELSE '' END || {host} || {at}"
TAIL = "lower(coalesce(regexp_extract(path, '([.][^./]+)$', 1), ''))"
BANNED = f"""CASE WHEN path LIKE '/%' THEN 'absolute' WHEN '/' || path || '/' LIKE '%/../%' THEN 'step up' WHEN tail IN ({_quoted(SUFFIXES)})
 THEN 'suffix' WHEN {" OR ".join(f"'/' || path || '/' LIKE '%/{p.replace('_', chr(92) + '_')}/%'" for p in PARTS if "__" not in p)} OR
 strpos('/' || path || '/', '/__pycache__/') > 0 THEN 'part' WHEN path LIKE '%/benchmarks/annotations/%' THEN 'annotations'
 WHEN path LIKE '%/benchmarks/results/%' AND NOT (path LIKE '%/benchmarks/results/synthetic.json' OR
 path LIKE '%/benchmarks/results/compact-export.json') THEN 'results' END"""


@query(f"""WITH p AS (SELECT page_id, {FILES.format(host="regexp_replace(url, '^[a-z]+://', '')",
 at=f"([{_quoted(ENDINGS)}])[page_id % {len(ENDINGS)} + 1]")} AS path FROM pages), t AS (SELECT *, {TAIL} AS tail FROM p)
 SELECT page_id, path, {BANNED} AS breach FROM t WHERE ({BANNED}) IS NOT NULL""")
def q91_release_audit(spark, sf_dir):
    """Names that a release must not hold, with the first reason."""
    p = read(spark, sf_dir, "pages").selectExpr(
        "page_id", f"{FILES.format(host=HOST, at=f'array({_quoted(ENDINGS)})[page_id % {len(ENDINGS)}]')} as path"
    )
    t = p.withColumn("tail", F.expr(TAIL))
    return t.selectExpr("page_id", "path", f"{BANNED.replace('strpos', 'instr')} as breach").where("breach is not null")


@query(f"""WITH p AS (SELECT page_id, '/in/' || (page_id % 40) || '/' || CASE WHEN page_id % 5 = 4 THEN 'out/' ELSE '' END ||
 (page_id // 3) || ([{_quoted(ENDINGS)}])[page_id % {len(ENDINGS)} + 1] AS path FROM pages)
 SELECT DISTINCT path FROM p WHERE lower(regexp_extract(path, '([.][^./]+)$', 1)) IN ({_quoted(VIDEO)})
 AND path NOT LIKE '/in/%/out/%'""")
def q92_file_discovery(spark, sf_dir):
    """Paths of the kinds that a batch takes, without those below its output,
    each once."""
    at = f"array({_quoted(ENDINGS)})[page_id % {len(ENDINGS)}]"
    p = read(spark, sf_dir, "pages").selectExpr(
        f"concat('/in/', page_id % 40, '/', if(page_id % 5 = 4, 'out/', ''), page_id div 3, {at}) as path"
    )
    kept = p.where(f"lower(regexp_extract(path, '([.][^./]+)$', 1)) in ({_quoted(VIDEO)})")
    return kept.where("path not like '/in/%/out/%'").distinct()


#: Fields that a document must have; it may have no other.
FIELDS = "mode video audio schema_version certificate_schema".split()


@query(f"""WITH d AS (SELECT page_id, list_concat(list_filter([{_quoted(FIELDS)}], lambda x: (page_id + length(x)) % 7 <> 0),
 CASE WHEN page_id % 4 = 1 THEN ['colour', 'a' || page_id] ELSE [] END) AS given FROM pages)
 SELECT page_id, array_to_string(list_sort(list_filter(given, lambda x: NOT list_contains([{_quoted(FIELDS)}], x))), ',') AS unknown,
 array_to_string(list_sort(list_filter([{_quoted(FIELDS)}], lambda x: NOT list_contains(given, x))), ',') AS missing,
 len(list_filter([{_quoted(FIELDS)}], lambda x: NOT list_contains(given, x))) = 0 AS complete FROM d""")
def q93_field_sets(spark, sf_dir):
    """Unknown and missing fields of each document, sorted, and whether all that
    is required is there."""
    known = f"array({_quoted(FIELDS)})"
    d = read(spark, sf_dir, "pages").selectExpr(
        "page_id",
        f"concat(filter({known}, x -> (page_id + length(x)) % 7 <> 0), if(page_id % 4 = 1,"
        " array('colour', concat('a', page_id)), cast(array() as array<string>))) as given",
    )
    return d.selectExpr(
        "page_id",
        f"array_join(array_sort(array_except(given, {known})), ',') as unknown",
        f"array_join(array_sort(array_except({known}, given)), ',') as missing",
        f"size(array_except({known}, given)) = 0 as complete",
    )


@query("""SELECT doc_id, sha256('{"analysis_height": 180, "analysis_width": 320, "detector": "' || source || '", "threads": ' ||
 (n_chars % 8 + 1) || '}') AS config_digest, '{"run_id":"r' || doc_id || '","event":"view"' || CASE WHEN lang = 'de' THEN '' ELSE
 ',"unit":"frames"' END || CASE WHEN n_chars % 2 = 0 THEN ',"completed":' || n_chars ELSE '' END || '}' AS event_json FROM documents""")
def q94_canonical_json(spark, sf_dir):
    """The digest of a configuration's canonical text, and events whose empty
    fields are left out."""
    said = (
        "'{\"analysis_height\": 180, \"analysis_width\": 320, \"detector\": \"' || source || '\", \"threads\": '"
        " || (n_chars % 8 + 1) || '}'"
    )
    event = F.to_json(
        F.struct(
            F.concat(F.lit("r"), "doc_id").alias("run_id"),
            F.lit("view").alias("event"),
            F.when(F.col("lang") == "de", None).otherwise("frames").alias("unit"),
            F.when(F.col("n_chars") % 2 == 0, F.col("n_chars")).alias("completed"),
        )
    )
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.expr(f"sha2({said}, 256)").alias("config_digest"), event.alias("event_json")
    )


#: Certificates of two schemas, some with claims that their mode cannot make.
CERTIFICATE = """doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 1 WHEN doc_id % 9 = 1 THEN 3 ELSE 2 END AS schema,
 CASE doc_id % 4 WHEN 0 THEN 'compact' WHEN 1 THEN 'review-copy' WHEN 2 THEN 'auto' ELSE 'lossless' END AS mode,
 doc_id % 13 <> 5 AS digest_agrees, doc_id % 7 = 2 AS pixels_equal, doc_id % 11 = 3 AS samples_equal, doc_id % 17 = 4 AS counts_frames"""
JUDGED = """CASE WHEN schema = 1 THEN 'auto' WHEN schema <> 2 THEN 'unsupported schema' WHEN NOT digest_agrees THEN 'digest differs'
 WHEN mode IN ('compact', 'review-copy') AND pixels_equal THEN 'claims equal pixels' WHEN mode = 'review-copy' AND samples_equal
 THEN 'claims equal samples' WHEN mode = 'review-copy' AND counts_frames THEN 'claims verified frames' ELSE mode END"""
CHECKS = """CASE policy WHEN 'auto' THEN 'frames,times,properties,audio' WHEN 'lossless' THEN 'frames,times,properties,audio'
 WHEN 'compact' THEN 'times,reference,quality,audio' WHEN 'review-copy' THEN 'inventory,range' END"""


@query(f"""WITH c AS (SELECT {CERTIFICATE} FROM documents), j AS (SELECT id, {JUDGED} AS policy FROM c)
 SELECT id, CASE WHEN ({CHECKS}) IS NOT NULL THEN policy END AS policy, CASE WHEN ({CHECKS}) IS NULL THEN policy END AS fault,
 {CHECKS} AS checks FROM j""")
def q95_certificate_policy(spark, sf_dir):
    """The policy that a certificate binds, or what is wrong with it, and the
    checks that its outputs have to pass."""
    c = read(spark, sf_dir, "documents").selectExpr(*columns(CERTIFICATE)).selectExpr("id", f"{JUDGED} as policy")
    return c.selectExpr(
        "id", f"if(({CHECKS}) is not null, policy, null) as policy", f"if(({CHECKS}) is null, policy, null) as fault",
        f"{CHECKS} as checks",
    )


@query("""SELECT doc_id, sha256(text) <> CASE WHEN doc_id % 6 = 1 THEN sha256(text || ' ') ELSE sha256(text) END AS changed FROM documents""")
def q96_source_unchanged(spark, sf_dir):
    """Sources whose content is not what it was at the start."""
    d = read(spark, sf_dir, "documents").select(
        "doc_id", F.sha2("text", 256).alias("now"),
        F.sha2(F.when(F.col("doc_id") % 6 == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("then"),
    )
    return d.select("doc_id", (F.col("now") != F.col("then")).alias("changed"))
