"""All queries over the driver's tables by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelace.operators import scoring
from tracelace.plans import q_audits, q_fields, q_more, q_recovery, q_registration, q_scores, q_sisters, q_stages, q_stores, q_tables, q_training, q_volumes
from tracelace.plans.registry import ORACLES, QUERIES
from tracelace.sources.tracks import Tracks

_MODULES = (q_tables, q_scores, q_stages, q_more, q_audits, q_fields, q_recovery, q_volumes, q_training, q_stores, q_registration, q_sisters)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated candidates, nearest parents, and their edge counts by dataset."""
    k = Tracks(spark, sf_dir)
    return scoring.edge_counts(scoring.charged_links(k.links, k.nodes, k.truth_edges, k.match), k.truth_edges)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
