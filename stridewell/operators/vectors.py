"""Vectors of a source: changes of label, mutual nearest neighbours."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridewell.registry import query
from stridewell.sources.frames import VECTORS, by_frame, vectors


@query(f"""WITH {VECTORS}, c AS (SELECT *, lag(label) OVER (PARTITION BY source_id ORDER BY frame) AS before
 FROM b) SELECT label, before, count(*) AS n FROM c WHERE before IS NOT NULL AND before <> label
 GROUP BY label, before""")
def q56_label_transitions(spark, sf_dir):
    c = vectors(spark, sf_dir).withColumn("before", F.lag("label").over(by_frame()))
    return c.where("before <> label").groupBy("label", "before").agg(F.count("*").alias("n"))


# Fixed value: a nearest neighbour must be this much nearer than the next one.
RATIO = 0.72
OTHER = """list_transform(range(0, 64), lambda i: CASE WHEN frame % 3 = 0 THEN v[64 - i] WHEN i % 8 = frame % 8
 THEN -v[i + 1] ELSE v[i + 1] END)"""


@query(f"""WITH {VECTORS}, o AS (SELECT source_id, frame AS other, {OTHER} AS w FROM b),
 x AS (SELECT b.source_id, frame, other, sum((v[k] - w[k]) * (v[k] - w[k])) AS d FROM b JOIN o USING (source_id),
 (SELECT unnest(range(1, 65)) AS k) GROUP BY b.source_id, frame, other),
 r AS (SELECT *, row_number() OVER (PARTITION BY source_id, frame ORDER BY d, other) AS fr,
 lead(d) OVER (PARTITION BY source_id, frame ORDER BY d, other) AS fd,
 row_number() OVER (PARTITION BY source_id, other ORDER BY d, frame) AS orank,
 lead(d) OVER (PARTITION BY source_id, other ORDER BY d, frame) AS od FROM x)
 SELECT source_id, frame, other, round(sqrt(d), 5) AS distance FROM r WHERE fr = 1 AND orank = 1
 AND sqrt(d) < {RATIO} * sqrt(fd) AND sqrt(d) < {RATIO} * sqrt(od)""")
def q30_mutual_match(spark, sf_dir):
    """Pairs of a source's vectors and their altered copies that are each the
    other's nearest, by the ratio test both ways.  A source has 64 of each, so
    its pairs are bounded; ties go to the lower frame."""
    b = vectors(spark, sf_dir)
    altered = (
        "transform(sequence(0, 63), i -> case when frame % 3 = 0 then v[63 - i]"
        " when i % 8 = frame % 8 then -v[i] else v[i] end)"
    )
    o = b.select("source_id", F.col("frame").alias("other"), F.expr(altered).alias("w"))
    d = F.expr("aggregate(zip_with(v, w, (x, y) -> (x - y) * (x - y)), cast(0 as double), (s, x) -> s + x)")
    x = b.join(o, "source_id").select("source_id", "frame", "other", d.alias("d"))
    mine = Window.partitionBy("source_id", "frame").orderBy("d", "other")
    theirs = Window.partitionBy("source_id", "other").orderBy("d", "frame")
    ranked = x.select(
        "*",
        F.row_number().over(mine).alias("fr"),
        F.lead("d").over(mine).alias("fd"),
        F.row_number().over(theirs).alias("orank"),
        F.lead("d").over(theirs).alias("od"),
    )
    test = f"fr = 1 and orank = 1 and sqrt(d) < {RATIO} * sqrt(fd) and sqrt(d) < {RATIO} * sqrt(od)"
    return ranked.where(test).select("source_id", "frame", "other", F.round(F.sqrt("d"), 5).alias("distance"))
