"""Events of running jobs taken in as a stream: rows are on disk before what
they mean is told, and a failure reaches whoever waits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def commit_then_emit(path: str, emit: Callable[[dict], None], keys: list[str]):
    """A function for foreachBatch: writes a micro-batch's certified rows and
    only then tells each key.  A batch that is repeated replaces its rows and
    tells again, so the teller must not mind repeats; certified rows of one
    batch are one job's scenes."""

    def write(batch: DataFrame, number: int) -> None:
        at = f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        for row in batch.sparkSession.read.parquet(at).select(*keys).toLocalIterator():
            emit(row.asDict())

    return write


def drain(query: StreamingQuery, timeout: int = 5) -> None:
    """Takes in what there is and stops; raises the stream's own error, or an
    error where it does not end in ``timeout`` seconds."""
    if query.isActive:
        query.processAllAvailable()
        query.stop()
        if not query.awaitTermination(timeout):
            raise RuntimeError(f"the stream did not end in {timeout} seconds; its state is not whole")
    error = query.exception()
    if error is not None:
        raise error
