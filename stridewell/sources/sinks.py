"""Writers: tables that replace or refuse to, logs that only grow, reports.

A job's small documents (status, manifest, report) are written by the driver:
their rows are one job's summary.  Tables go through Spark's commit protocol.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the scene table, in order.
SCENES = ("number", "start_frame", "end_frame", "last_frame", "frame_count", "start_pts", "end_pts")
#: Sections that one report holds.
SECTIONS = 10_000


def _whole(path: Path, content: bytes, place: Callable[[str, Path], None]) -> None:
    """Writes beside ``path`` and lets ``place`` move the file there."""
    if path.is_symlink():
        raise FileExistsError(f"{path} is a link")
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(content)
            out.flush()
            os.fsync(out.fileno())
        place(name, path)
    finally:
        Path(name).unlink(missing_ok=True)


def replace_bytes(path, content: bytes) -> None:
    """The file is either the old one or the new one, never a part."""
    _whole(Path(path), content, os.replace)


def replace_json(path, value) -> None:
    """JSON with NaN refused."""
    replace_bytes(path, (json.dumps(value, indent=2, allow_nan=False, ensure_ascii=False) + "\n").encode())


def new_bytes(path, content: bytes) -> None:
    """As replace_bytes(), but an existing target is an error and stays."""
    _whole(Path(path), content, os.link)


def write_new(df: DataFrame, path: str) -> None:
    """A table at a path where there must be none."""
    df.write.mode("errorifexists").parquet(path)


def write_scenes(df: DataFrame, path: str) -> None:
    """The scene table as CSV with a header; other columns are left out."""
    df.select(*SCENES).write.mode("overwrite").csv(path, header=True)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metrics, compressed by column."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def csv_line() -> Column:
    """A scene as a line of the table."""
    return F.concat_ws(",", *(F.col(c).cast("string") for c in SCENES))


def escaped(x: Column) -> Column:
    """Text for HTML; the ampersand goes first."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(mark), F.lit(name))
    return x


def section(reason: str) -> Column:
    """A scene as a section of the report."""
    thumbnail = F.concat(F.lit("thumbnails/frame-"), F.lpad(F.col("start_frame").cast("string"), 9, "0"), F.lit(".jpg"))
    return F.concat(
        F.lit("<section><h3>Scene "), F.col("number").cast("string"), F.lit("</h3><p>"),
        F.replace(F.replace(F.col(reason), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
        F.lit('</p><img src="'), thumbnail, F.lit('"></section>'),
    )


def write_report(df: DataFrame, title: str, path, reason: str = "reason") -> None:
    """One source's scenes as a page without scripts or remote parts; more than
    SECTIONS of them are an error, as the page is built on the driver."""
    import html

    rows = df.orderBy("number").select(section(reason)).limit(SECTIONS + 1).collect()
    if len(rows) > SECTIONS:
        raise ValueError("too many scenes for one report")
    policy = "default-src 'none'; img-src 'self'"  # nothing runs, nothing is fetched
    head = f'<!doctype html><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{policy}">'
    page = [head, f"<title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>", *(r[0] for r in rows)]
    replace_bytes(path, "\n".join(page).encode())


class Log:
    """A log of events, one JSON object a line, that only grows.  Opening it
    ends a last line that is whole and drops one that was cut."""

    def __init__(self, path):
        self.path = Path(path)
        if self.path.is_symlink():
            raise FileExistsError(f"{self.path} is a link")
        if self.path.exists():
            self._mend()
        self.out = open(self.path, "ab")

    def _mend(self) -> None:
        with open(self.path, "r+b") as log:
            size = at = log.seek(0, os.SEEK_END)
            tail = b""
            while at > 0 and b"\n" not in tail:
                at = max(0, at - (1 << 16))
                log.seek(at)
                tail = log.read(size - at)
            tail = tail[tail.rfind(b"\n") + 1 :]
            if not tail:
                return
            try:
                json.loads(tail)
            except ValueError:
                log.truncate(size - len(tail))
            else:
                log.seek(0, os.SEEK_END)
                log.write(b"\n")

    def emit(self, event: dict) -> None:
        """Fields without a value are left out; an end is on disk when this
        returns."""
        known = {k: v for k, v in event.items() if v is not None}
        self.out.write((json.dumps(known, ensure_ascii=False, allow_nan=False, separators=(",", ":")) + "\n").encode())
        self.out.flush()
        if event.get("event") in ("job_finished", "job_failed", "worker_lost"):
            os.fsync(self.out.fileno())

    def close(self, result: dict | None = None) -> None:
        self.out.close()


class Null:
    """Takes events and keeps none."""

    def emit(self, event: dict) -> None:
        pass

    def close(self, result: dict | None = None) -> None:
        pass


class Several:
    """Gives each event to all of its sinks in order, and closes them from the
    last to the first, all of them even if one fails."""

    def __init__(self, sinks: Iterable):
        self.sinks = tuple(sinks)

    def emit(self, event: dict) -> None:
        for sink in self.sinks:
            sink.emit(event)

    def close(self, result: dict | None = None) -> None:
        error = None
        for sink in reversed(self.sinks):
            try:
                sink.close(result)
            except Exception as why:  # the others are closed first
                error = error or why
        if error:
            raise error


def for_each_batch(tables: dict[str, Callable[[DataFrame], DataFrame]], folder: str):
    """A function for foreachBatch that writes several views of a micro-batch,
    each to a path of its batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        for name, view in tables.items():
            view(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return write
