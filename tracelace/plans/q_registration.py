"""Where each dataset's longest detected chain runs inside the public tracks, the users' whole tracks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelace.operators import registration
from tracelace.plans.q_scores import _CHN, _truth_pred
from tracelace.plans.registry import query, r6
from tracelace.sources.tracks import Tracks

#: Micrometres that a step may be off: detections are moved by two voxels at most at either end. Least nodes of a chain.
_OFF, _LEAST = 1.75, 12

_NEEDLE = (
    ", de AS (SELECT te.dataset, te.source_id + 10000000 AS source_id, te.target_id + 10000000 AS target_id FROM te WHERE te.source_id % 17 <> 0 AND te.target_id % 17 <> 0)"
    + re.sub(r"\btn\b", "pn", re.sub(r"\bte\b", "de", _CHN))
    + f""", lo AS (SELECT dataset, chain_id, n_nodes FROM (SELECT dataset, chain_id, count(*) AS n_nodes FROM cn GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n_nodes DESC, chain_id) = 1),
nd AS (SELECT sp.dataset, pos, step, count(*) OVER (PARTITION BY sp.dataset) + 1 AS n_nodes, max(step) OVER (PARTITION BY sp.dataset) - min(step) OVER (PARTITION BY sp.dataset) AS spread FROM sp JOIN lo USING (dataset, chain_id)),
te2 AS (SELECT * FROM nd WHERE n_nodes >= {_LEAST} AND spread > 2 * {_OFF}::DOUBLE),
pu AS (SELECT user_id AS track_id, t, sqrt((b.uz - a.uz) * (b.uz - a.uz) + (b.uy - a.uy) * (b.uy - a.uy) + (b.ux - a.ux) * (b.ux - a.ux)) AS step FROM (SELECT pt.user_id, tn.* FROM tn JOIN pt USING (dataset, node_id)) a JOIN (SELECT pt.user_id AS u, tn.t AS bt, uz, uy, ux FROM tn JOIN pt USING (dataset, node_id)) b ON u = user_id AND bt = a.t + 1),
hi AS (SELECT te2.dataset, n_nodes, track_id, t - pos AS t FROM te2 JOIN pu ON abs(te2.step - pu.step) <= {_OFF}::DOUBLE GROUP BY te2.dataset, n_nodes, track_id, t - pos HAVING count(*) = n_nodes - 1)"""
)


def _found(k: Tracks) -> DataFrame:
    return registration.with_power(registration.needles(k.nodes, _truth_pred(k)), _OFF, _LEAST)


def _placed(k: Tracks, found: DataFrame) -> DataFrame:
    public = k.truth.join(k.points.select("dataset", "node_id", F.col("user_id").alias("track_id")), ["dataset", "node_id"])
    return registration.placed(found.filter("tested"), registration.runs(public), _OFF)


@query(_NEEDLE + " SELECT dataset, track_id, t::INTEGER AS t FROM hi")
def q32_registered_places(k: Tracks) -> DataFrame:
    return _placed(k, _found(k)).withColumn("t", F.col("t").cast("int"))


@query(_NEEDLE + f", hc AS (SELECT dataset, count(*) AS n_places, count(DISTINCT track_id) AS n_tracks FROM hi GROUP BY dataset) SELECT nd.dataset, any_value(n_nodes)::INTEGER AS n_nodes, round(any_value(spread), 6) AS spread, any_value(n_nodes) >= {_LEAST} AND any_value(spread) > 2 * {_OFF}::DOUBLE AS tested, coalesce(any_value(n_places), 0)::BIGINT AS n_places, coalesce(any_value(n_tracks), 0)::BIGINT AS n_tracks FROM nd LEFT JOIN hc USING (dataset) GROUP BY nd.dataset")
def q32_registration(k: Tracks) -> DataFrame:
    found = _found(k)
    n = _placed(k, found).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_places"), F.count_distinct("track_id").alias("n_tracks"))
    return found.join(n, "dataset", "left").fillna(0, ["n_places", "n_tracks"]).select("dataset", "n_nodes", r6("spread").alias("spread"), "tested", "n_places", "n_tracks")
