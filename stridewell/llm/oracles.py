"""Contracts of the queries as DuckDB SQL, stated without any of the methods:
every window, pair or match is formed.  For tables of a few thousand rows."""

from stridewell.llm import licences

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS = "d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS rid, doc_id, coalesce(text, '') AS text FROM documents)"
SPACED = r"[^\x20\x09-\x0D]+"
BROKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _secrets() -> str:
    # The patterns of the contract.
    kinds = (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", "AKIA[A-Z0-9]{12,}", 0, 16),
        ("hex", "[0-9a-f]{32,}", 0, 32),
    )
    found = " UNION ALL ".join(
        f"SELECT rid, text, {rank} AS rank, '{kind}' AS kind, {least} AS least,"
        f" regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS v FROM d"
        for rank, (kind, p, group, least) in enumerate(kinds)
    )
    counts = ", ".join(
        f"(SELECT count(*) FROM s WHERE s.rid = d.rid AND kind = '{k}') AS n_{k}" for k, *_ in kinds
    )
    return f"""WITH RECURSIVE {ROWS}, f AS ({found}),
 p(rid, rank, kind, least, text, m, v, k, start, fin) AS (SELECT rid, rank, kind, least, text, m, v, CAST(0 AS BIGINT),
 CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM f WHERE len(m) > 0 UNION ALL SELECT rid, rank, kind, least, text, m, v, k + 1,
 fin + instr(substr(text, fin + 1), m[k + 1]) - 1, fin + instr(substr(text, fin + 1), m[k + 1]) - 1 + length(m[k + 1])
 FROM p WHERE k < len(m)),
 s AS (SELECT rid, rank, kind, start, kind || ':' || start || ':' || fin AS said FROM p WHERE k > 0 AND length(v[k]) >= least),
 g AS (SELECT rid, string_agg(said, ',' ORDER BY start, rank) AS spans FROM s GROUP BY rid)
 SELECT d.doc_id, {counts}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
 FROM d LEFT JOIN g ON g.rid = d.rid"""


DECONTAMINATION = f"""WITH {ROWS}, dw AS (SELECT rid, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{BROKEN}')
 AS w FROM d), iw AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(
 translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BROKEN}') AS w FROM benchmark) WHERE len(w) > 0),
 sp AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS span FROM (SELECT item_id, w, n,
 unnest(range(1, len(w) - n + 2)) AS i FROM iw)),
 x AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS span FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2))
 AS i FROM dw, (SELECT DISTINCT n FROM sp) AS ns WHERE len(w) >= n)),
 h AS (SELECT rid, i, n, item_id FROM x JOIN sp USING (span, n)),
 c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, i + unnest(range(0, n)) AS pos FROM h) GROUP BY rid),
 t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid,
 CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM dw LEFT JOIN c ON c.rid = dw.rid LEFT JOIN t ON t.rid = dw.rid"""

SUBSTRING = f"""WITH {ROWS}, dw AS (SELECT rid, doc_id, regexp_extract_all(text, '{SPACED}') AS w FROM d),
 x AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS span FROM (SELECT rid, doc_id, w,
 unnest(range(1, len(w) - 11)) AS i FROM dw WHERE doc_id IS NOT NULL AND len(w) >= 13)),
 f AS (SELECT span, min(doc_id) AS first FROM x GROUP BY span),
 g AS (SELECT DISTINCT rid, i + unnest(range(0, 13)) AS i FROM x JOIN f USING (span) WHERE first < doc_id),
 k AS (SELECT o.rid, count(*) FILTER (g.i IS NOT NULL) AS n_removed,
 string_agg(o.word, ' ' ORDER BY o.i) FILTER (g.i IS NULL) AS kept
 FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM dw) AS o
 LEFT JOIN g ON g.rid = o.rid AND g.i = o.i GROUP BY o.rid)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
 sha256(coalesce(kept, '')) AS kept_sha256 FROM dw LEFT JOIN k ON k.rid = dw.rid"""

NEAR = f"""WITH RECURSIVE {ROWS}, dw AS (SELECT rid, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{SPACED}')
 AS w FROM d), st AS (SELECT rid, doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1),
 lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM dw),
 sh AS (SELECT rid, len(s) AS n, unnest(s) AS g FROM st),
 e AS (SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS shared
 FROM sh AS x JOIN sh AS y ON y.g = x.g AND y.rid <> x.rid GROUP BY x.rid, y.rid)
 WHERE 100 * shared >= 85 * (na + nb - shared)),
 r(a, b) AS (SELECT rid, rid FROM st UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
 c AS (SELECT r.a AS rid, min(st.doc_id) AS component_id FROM r JOIN st ON st.rid = r.b GROUP BY r.a)
 SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
 FROM st JOIN c ON c.rid = st.rid"""



def _licences() -> str:
    listed = ", ".join(
        f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(licences.TEMPLATES)
    )
    words = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    low = licences.CUT - licences.SLACK
    return f"""WITH {ROWS}, t0(k, licence, body) AS (VALUES {listed}),
 tw AS (SELECT k, licence, {words.format("body")} AS w FROM t0),
 tg AS (SELECT DISTINCT k, w[i] || ' ' || w[i + 1] AS g FROM (SELECT k, w, unnest(range(1, len(w))) AS i FROM tw)),
 t AS (SELECT tw.k, any_value(licence) AS licence, any_value(len(w)) - 1 AS m, count(*) AS size,
 greatest(1, ceil(count(*) * {low} / {2 - low} - 1e-9)) AS need FROM tw JOIN tg ON tg.k = tw.k GROUP BY tw.k),
 dl AS (SELECT rid, doc_id, CASE WHEN text = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM d),
 lw AS (SELECT rid, j, {words.format("lines[j]")} AS w FROM (SELECT rid, lines, unnest(range(1, len(lines) + 1)) AS j FROM dl)),
 la AS (SELECT rid, j, len(w) AS c, coalesce(sum(len(w)) OVER (PARTITION BY rid ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND
 1 PRECEDING), 0) AS first FROM lw),
 wo AS (SELECT lw.rid, first + i AS pos, w[i] AS word FROM (SELECT rid, j, w, unnest(range(1, len(w) + 1)) AS i FROM lw) AS lw
 JOIN la ON la.rid = lw.rid AND la.j = lw.j),
 b AS (SELECT rid, pos - 1 AS pos, word || ' ' || after AS g FROM (SELECT *, lead(word) OVER (PARTITION BY rid ORDER BY pos) AS after
 FROM wo) WHERE after IS NOT NULL), bn AS (SELECT rid, count(*) AS n FROM b GROUP BY rid),
 near AS (SELECT b.rid, tg.k FROM b JOIN tg USING (g) JOIN t ON t.k = tg.k GROUP BY b.rid, tg.k, t.need HAVING count(DISTINCT g) >= t.need),
 u AS (SELECT near.rid, k, 0 AS s, n FROM near JOIN bn USING (rid) UNION SELECT near.rid, k, first, c - 1 FROM near JOIN la USING (rid)
 WHERE c >= 2 UNION SELECT rid, k, unnest(range(0, n - m + 1)), m FROM near JOIN bn USING (rid) JOIN t USING (k) WHERE n >= m),
 x AS (SELECT u.rid, u.k, u.s, u.s + u.n AS e, count(DISTINCT b.g) AS own, count(DISTINCT tg.g) AS shared FROM u JOIN b ON b.rid = u.rid
 AND b.pos >= u.s AND b.pos < u.s + u.n LEFT JOIN tg ON tg.k = u.k AND tg.g = b.g GROUP BY u.rid, u.k, u.s, u.n),
 h AS (SELECT rid, s, e, round(2.0::DOUBLE * shared / (own + size), 6) AS dice, k, licence FROM x JOIN t USING (k)
 WHERE round(2.0::DOUBLE * shared / (own + size), 6) >= {licences.CUT}),
 f AS (SELECT rid, list_reduce(list_concat([[0.0::DOUBLE, -1, 0]], list([s::DOUBLE, e, dice] ORDER BY s, e, dice, k)), lambda a, y:
 CASE WHEN len(a) = 0 THEN a WHEN y[1] > a[2] THEN [a[1] + 1, y[2], y[3]] WHEN y[3] > a[3] OR (y[3] = a[3] AND y[2] > a[2])
 THEN [a[1], y[2], y[3]] ELSE a END) AS r, arg_max(licence, dice * 1000000 - k / 1000.0) AS licence, max(dice) AS dice,
 array_to_string(list_sort(list_distinct(list(licence))), ',') AS licences FROM h GROUP BY rid)
 SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(CAST(r[1] AS BIGINT), 0) AS n_matched, licence, dice,
 coalesce(licences, '') AS licences FROM dl LEFT JOIN f ON f.rid = dl.rid"""


ORACLES = {
    "op8_licences": _licences(),
    "op4_secrets": _secrets(),
    "op5_decontamination": DECONTAMINATION,
    "op9_substring": SUBSTRING,
    "op10_near": NEAR,
}
