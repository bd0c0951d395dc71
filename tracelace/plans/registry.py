"""Queries by name: each a function of the tracks in a folder, with DuckDB SQL beside it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelace.sources import tracks
from tracelace.sources.tracks import Tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True) -> Callable:
    """Registers a function of Tracks under its name. ``sql`` follows the shared table expressions, unless it stands alone."""

    def keep(f: Callable[[Tracks], DataFrame]) -> Callable[[Tracks], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tracks(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = f"{tracks.SQL}{sql}" if base else sql
        return f

    return keep


def r6(c: Column | str) -> Column:
    """Rounded to six places, so that sums in another order agree."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6)
