"""All queries by name, and their statements in DuckDB SQL."""

from stridewell.operators import (  # noqa: F401  (importing registers)
    audio,
    change,
    documents,
    evaluation,
    export,
    integrity,
    pictures,
    progress,
    rollup,
    segments,
    timeline,
    transitions,
    vectors,
)
from stridewell.registry import ORACLES, QUERIES
from stridewell.streaming import status  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
