"""What a job's driver needs beside tables: its configuration, who owns its
folder, paths that stay in it, sources by content, and what is installed."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import socket
import tomllib
import uuid
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Settings of detection; changes are in hundredths, as in the queries."""

    detector: str = "temporal"
    context: int = 12
    min_change: int = 3000
    tolerance: int = 0

    def __post_init__(self):
        if self.detector not in ("temporal", "pixel", "histogram", "adaptive"):
            raise ValueError(f"no such detector: {self.detector}")
        if self.context < 2 or self.min_change < 1 or self.tolerance < 0:
            raise ValueError("a setting is out of its range")

    def digest(self) -> str:
        """Digest of the settings in order of their names."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def load_config(path=None, **overrides) -> Config:
    """Settings from the one table ``detection`` of a TOML file; any other table
    or name is an error; overrides that are not None win."""
    found = {}
    if path is not None:
        with open(path, "rb") as file:
            document = tomllib.load(file)
        if set(document) - {"detection"}:
            raise ValueError(f"unknown tables: {sorted(set(document) - {'detection'})}")
        found = document.get("detection", {})
    unknown = set(found) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return replace(Config(**found), **{k: v for k, v in overrides.items() if v is not None})


def contained(root, path) -> bool:
    """Whether a path, its links followed, lies in ``root``."""
    return Path(path).resolve().is_relative_to(Path(root).resolve())


def fingerprints(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """(path, length, sha256) of files, hashed by the executors."""
    files = spark.read.format("binaryFile").load(inputs)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


class Ownership:
    """One driver at a time works in a folder.  A lock names process, machine and
    a token; one whose process is gone from this machine may be taken over with
    ``resume``, any other may not.  Only the owner's token removes it."""

    def __init__(self, folder, resume: bool = False):
        self.path, self.token = Path(folder) / "owner.json", uuid.uuid4().hex
        self.path.parent.mkdir(parents=True, exist_ok=True)
        mine = {"pid": os.getpid(), "host": socket.gethostname(), "token": self.token}
        while True:
            try:
                with open(self.path, "x") as lock:
                    json.dump(mine, lock)
                return
            except FileExistsError:
                if not (resume and self._dead()):
                    raise
                self.path.unlink(missing_ok=True)

    def _dead(self) -> bool:
        try:
            other = json.loads(self.path.read_text())
        except (OSError, ValueError):
            return False  # being written just now
        if other.get("host") != socket.gethostname():
            return False
        try:
            os.kill(int(other["pid"]), 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            return False
        return False

    def release(self) -> None:
        try:
            own = json.loads(self.path.read_text()).get("token") == self.token
        except (OSError, ValueError):
            own = False
        if own:
            self.path.unlink(missing_ok=True)

    def __enter__(self):
        return self

    def __exit__(self, *error):
        self.release()


def capabilities(spark: SparkSession) -> dict:
    """Versions that results depend on, and whether what is needed is there."""
    found = {
        "python": platform.python_version(),
        "spark": spark.version,
        "java": spark._jvm.System.getProperty("java.version"),
        "adaptive": spark.conf.get("spark.sql.adaptive.enabled"),
        "shared_folder": spark.conf.get("spark.checkpoint.dir", None),
    }
    found["ok"] = int(found["spark"].split(".")[0]) >= 4 and found["adaptive"] == "true"
    return found
