"""Secret scanning over an incremental blob ledger.

Texts are content-addressed by SHA-256.  The ledger has one row per (blob, rule
version) with the spans found; a scan runs the rules only on pairs that are not
there, appends them, and joins the findings back to every path (row) that holds
the blob.  Everything is a built-in expression: the position of a match comes
from the lengths of what ``split`` leaves between matches.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridewell.llm.common import Scratch, fresh


@dataclass(frozen=True)
class Rule:
    """A kind of secret: Java pattern, group whose length counts, least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The rules of the query's contract, in its order.  Where a
# match is a whole run of one class, the least length is in the pattern.
RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

#: Matches of one rule that are placed together.
BLOCK = 256
SPAN = "struct<kind:string,rank:int,start:int,end:int>"


def rule_version(rules=RULES) -> str:
    """Digest of the rules: another pattern is another version."""
    said = "\n".join(f"{r.kind}\t{r.pattern}\t{r.group}\t{r.least}" for r in rules)
    return hashlib.sha256(said.encode()).hexdigest()[:16]


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(rule: Rule, rank: int) -> str:
    """SQL: array of spans of one rule in ``text``, in code points."""
    q = _quoted(rule.pattern)
    found = f"regexp_extract_all(text, {q}, 0)"
    value = f"regexp_extract_all(text, {q}, {rule.group})"
    # Matches in blocks: sums over blocks give where each begins, so the cost of
    # the growing arrays is bounded by the block, not by a text's matches.
    pieces = f"arrays_zip(slice(split(text, {q}, -1), 1, size({found})), {found}, {value})"
    long = "length(x.`0`) + length(x.`1`)"
    step = (
        f"aggregate(p, named_struct('at', s, 'out', cast(array() as array<{SPAN}>)),"
        f" (a, x) -> named_struct('at', a.at + {long}, 'out',"
        f" if(length(x.`2`) >= {rule.least}, array_append(a.out, named_struct("
        f"'kind', '{rule.kind}', 'rank', {rank}, 'start', a.at + length(x.`0`),"
        f" 'end', a.at + {long})), a.out)), a -> a.out)"
    )

    def let(name: str, value: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    blocks = f"transform(sequence(0, (size(m) - 1) div {BLOCK}), b -> slice(m, b * {BLOCK} + 1, {BLOCK}))"
    begun = (
        "slice(aggregate(ps, array(0), (a, p) -> array_append(a, element_at(a, -1)"
        f" + aggregate(p, 0, (t, x) -> t + {long}))), 1, size(ps))"
    )
    walk = let("m", pieces, let("ps", blocks, f"flatten(zip_with({begun}, ps, (s, p) -> {step}))"))
    return f"if(text rlike {q}, {walk}, cast(array() as array<{SPAN}>))"


def find_spans(texts: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``spans`` (sorted by start, then rule order) to rows with ``text``."""
    each = ", ".join(_spans(r, i) for i, r in enumerate(rules))
    return texts.withColumn(
        "spans",
        F.expr(
            f"transform(array_sort(transform(concat({each}), s -> named_struct('start', s.start,"
            " 'rank', s.rank, 'end', s.end, 'kind', s.kind))), s -> named_struct("
            "'kind', s.kind, 'start', s.start, 'end', s.end))"
        ),
    )


class BlobLedger:
    """The scanned (blob, rule version) pairs under ``path``; without a path a
    new ledger in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{Scratch(spark, 'ledger').root}/entries"

    SCHEMA = (
        "blob string, spans array<struct<kind:string,start:int,end:int>>, rule_version string"
    )

    def entries(self) -> DataFrame:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def scan(
        self, docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text"
    ) -> DataFrame:
        """One row per input row: id, blob and spans (array of kind, start,
        end; code points, end exclusive).  Null text counts as empty; empty
        texts have no spans; null ids and repeated rows stay; an empty table
        gives no rows.

        A blob that two scans at once both find unseen is appended twice and
        read once.  Without any unseen blob no text is moved."""
        version = rule_version(rules)
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        paths = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn(
            "blob", F.sha2("text", 256)
        )
        if self.entries().limit(1).count():
            seen = self.entries().where(F.col("rule_version") == version)
            todo = paths.select("blob").distinct().join(seen.select("blob"), "blob", "left_anti")
            todo = Scratch(self.spark, "ledger").table(todo, "unseen")
            unseen = None if todo.isEmpty() else paths.select("blob", "text").join(todo, "blob", "left_semi")
        else:
            unseen = paths.select("blob", "text")
        if unseen is not None:
            fresh = find_spans(unseen.dropDuplicates(["blob"]), rules)
            fresh.select("blob", "spans", F.lit(version).alias("rule_version")).write.mode(
                "append"
            ).parquet(self.path)
        known = self.entries().where(F.col("rule_version") == version).select("blob", "spans")
        # Only where two scans have met; a plain join may split a blob of many paths.
        if not known.groupBy("blob").count().where("count > 1").isEmpty():
            known = known.dropDuplicates(["blob"])
        return paths.select("id", "blob").join(known.select("blob", "spans"), "blob").select(
            F.col("id").alias(id_col), "blob", "spans"
        )


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the base kinds from a scan's spans."""
    said = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = "filter(spans, s -> s.kind in ('assign', 'access', 'hex'))"
    count = "cast(size(filter(spans, s -> s.kind = '{}')) as bigint)"
    return found.select(
        F.col(id_col).alias("doc_id"),
        *(F.expr(count.format(k)).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(F.expr(said.format(base)), 256).alias("base_sha256"),
        F.expr(said.format("spans")).alias("spans"),
    )


def redact(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``[SECRET]``, n_chars with it.
    Overlapping spans become one mark.  Columns and rows stay; null texts stay
    null."""
    found = BlobLedger(docs.sparkSession, path).scan(docs)
    blob, spans = fresh(docs, "_blob"), fresh(docs, "_spans")
    hits = found.where("size(spans) > 0").select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    cut = (
        f"aggregate({spans}, named_struct('at', 0, 'out', ''), (a, s) -> named_struct("
        "'at', greatest(a.at, s.end), 'out', if(s.start < a.at, a.out, concat(a.out,"
        " substring(text, a.at + 1, s.start - a.at), '[SECRET]'))),"
        " a -> concat(a.out, substring(text, a.at + 1)))"
    )
    out = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256)).join(hits.dropDuplicates([blob]), blob, "left")
    out = out.withColumn("text", F.expr(f"if({spans} is null, text, {cut})"))
    if "n_chars" in docs.columns:
        out = out.withColumn(
            "n_chars",
            F.expr(f"if({spans} is null, n_chars, length(text))").cast(docs.schema["n_chars"].dataType),
        )
    return out.select(*docs.columns)
