"""The job fold over a stream: aggregates that do not depend on order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridewell.operators.progress import ENDS, LOGGED, OUTCOME, STATE
from stridewell.registry import query
from stridewell.sources.frames import read
from stridewell.sources.store import shared_folder

#: An event's kind without its place in the log, which a stream does not know.
KIND = """CASE WHEN event_type = 'purchase' THEN 'job_finished' WHEN event_type = 'error' AND k >= 98 THEN 'worker_lost'
 WHEN event_type = 'error' THEN 'job_failed' WHEN event_type = 'click' THEN 'scene_certified' ELSE 'analysis_progress' END"""


def fold(events: DataFrame) -> DataFrame:
    """Batch or stream of events to one row per job: the state of the batch
    fold, kept as running aggregates.  What depends on an event's place is told
    by its time and id: the first event starts the job and certifies nothing."""
    e = events.select(
        F.col("user_id").alias("source_id"),
        F.struct("ts", "event_id").alias("at"),
        "event_type",
        F.expr("cast(regexp_extract(props, '(-?[0-9]+)', 1) as bigint)").alias("k"),
        F.expr("abs(cast(round(value * 100) as bigint))").alias("bytes"),
    ).withColumn("event", F.expr(KIND))
    e = e.withColumn("logged", F.expr(LOGGED)).withColumn("ends", F.expr(f"logged and event in {ENDS}"))
    e = e.withColumn("reason_code", F.expr("case when event = 'job_failed' and k < 50 then 'interrupted' end"))
    progress = F.expr("logged and not ends")
    certified = F.expr("logged and event = 'scene_certified' and k % 2 = 0")
    g = e.groupBy("source_id").agg(
        F.count_if("logged").alias("n_events"),
        F.count_if(certified).alias("certified"),
        F.min(F.struct("at", certified.alias("certified"))).alias("start"),
        F.count_if("ends").alias("n_ends"),
        F.max(F.expr("ends and event = 'worker_lost'")).alias("lost"),
        F.min(F.when(F.col("ends"), F.struct("at", F.expr(OUTCOME).alias("outcome")))).alias("end"),
        F.max(F.when(progress, F.struct("at", "event", "k"))).alias("last"),
        F.max(F.when(F.col("ends"), F.col("bytes"))).alias("peak_bytes"),
    )
    g = g.withColumn("first_end", F.col("end.outcome")).selectExpr(
        "source_id",
        "n_events",
        "certified - if(start.certified, 1, 0) as recovered",
        "n_ends",
        f"{STATE} as state",
        "case when last.event = 'scene_certified' and last.at > start.at then 'exporting'"
        " when last.k % 3 = 0 then 'probing' else 'analyzing' end as phase",
        "peak_bytes",
    )
    return g.withColumn("phase", F.expr("if(state = 'active', phase, null)"))


@query()
def q48_streaming_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file read as a stream and folded; each micro-batch commits
    the jobs' states to a table in the shared folder, and the last is returned.
    The stream's checkpoint lies there as well, so that it survives its driver."""
    folder = shared_folder(spark, "status")
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

    run = fold(stream).writeStream.outputMode("complete").foreachBatch(commit)
    run = run.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    states = spark.read.parquet(f"{folder}/states")
    last = states.agg(F.max("batch")).first()[0]
    return states.where(F.col("batch") == last).drop("batch")
