"""Windows of a sparse annotation, and scalar functions that other queries only use inside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelace.functions import geometry as g
from tracelace.operators import costs, joins, repair, sampling
from tracelace.plans.q_scores import _ROOT
from tracelace.plans.registry import query, r6
from tracelace.sources.tracks import Tracks

#: Two users of five are annotated, whole tracks with their daughters'; a detection stands for the nearest annotated point within the gate.
_NEAR = 4.0
_SPARSE = f""", ga AS (SELECT tn.* FROM tn JOIN pt USING (dataset, node_id) WHERE user_id % 5 IN (0, 4)),
ge AS (SELECT te.* FROM te JOIN ga a ON a.dataset = te.dataset AND a.node_id = source_id JOIN ga b ON b.dataset = te.dataset AND b.node_id = target_id){_ROOT.replace("FROM pn", "FROM ga").replace("pe", "ge")},
nm AS (SELECT a.dataset, a.node_id, b.node_id AS gt_id FROM pn a JOIN ga b ON a.dataset = b.dataset AND a.t = b.t WHERE sqrt((a.uz - b.uz) * (a.uz - b.uz) + (a.uy - b.uy) * (a.uy - b.uy) + (a.ux - b.ux) * (a.ux - b.ux)) <= {_NEAR}::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY a.dataset, a.node_id ORDER BY sqrt((a.uz - b.uz) * (a.uz - b.uz) + (a.uy - b.uy) * (a.uy - b.uy) + (a.ux - b.ux) * (a.ux - b.ux)), b.node_id) = 1),
lb AS (SELECT pn.dataset, pn.t, pn.node_id, component, e.value AS score FROM pn JOIN events e ON e.event_id = pn.node_id - 10000000 LEFT JOIN nm ON nm.dataset = pn.dataset AND nm.node_id = pn.node_id LEFT JOIN co ON co.dataset = nm.dataset AND co.node_id = nm.gt_id),
tr AS (SELECT dataset, component, count(*) AS n, sha256('7:' || dataset || ':' || component) AS h FROM lb WHERE component IS NOT NULL GROUP BY ALL),
ca2 AS (SELECT tr.dataset, component, row_number() OVER w AS k, sum(n) OVER w AS s, crowd FROM tr JOIN (SELECT dataset, count(*) FILTER (WHERE component IS NULL) AS crowd FROM lb GROUP BY dataset) USING (dataset) WINDOW w AS (PARTITION BY dataset ORDER BY h, component ROWS UNBOUNDED PRECEDING)),
cd AS (SELECT dataset, component FROM ca2 WHERE k = 1 OR s <= 0.3::DOUBLE * crowd)"""


def _labelled(k: Tracks) -> DataFrame:
    own = k.truth.join(k.points.select("dataset", "node_id", "user_id"), ["dataset", "node_id"]).filter("user_id % 5 in (0, 4)").drop("user_id")
    ids = own.select("dataset", "node_id")
    edges = k.truth_edges.join(ids.withColumnRenamed("node_id", "source_id"), ["dataset", "source_id"], "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), ["dataset", "target_id"], "left_semi")
    tracks = repair.labelled(own, edges).withColumnRenamed("node_id", "gt_id")
    near = joins.nearest(k.nodes, own, within=_NEAR).select("dataset", "node_id", F.col("nearest_id").alias("gt_id"))
    score = k.table("events").select((F.col("event_id") + 10_000_000).alias("node_id"), F.col("value").alias("score"))
    return k.nodes.select("dataset", "t", "node_id").join(score, "node_id").join(near, ["dataset", "node_id"], "left").join(tracks, ["dataset", "gt_id"], "left").select("dataset", "t", "node_id", "component", "score")


@query(_SPARSE + " SELECT dataset, component FROM cd")
def n4_carried_tracks(k: Tracks) -> DataFrame:
    return sampling.carried_tracks(_labelled(k), 0.3, 7)


@query(_SPARSE + """, ow AS (SELECT lb.*, cd.component IS NOT NULL AS own FROM lb LEFT JOIN cd USING (dataset, component) WHERE cd.component IS NOT NULL OR lb.component IS NULL),
rk AS (SELECT *, count(*) FILTER (WHERE own) OVER (PARTITION BY dataset, t) AS p, row_number() OVER (PARTITION BY dataset, t ORDER BY own, score DESC, node_id) AS k FROM ow)
SELECT dataset, t, node_id, component FROM rk WHERE own OR k <= greatest(0, 16 - p)""")
def n4_ratio_matched_windows(k: Tracks) -> DataFrame:
    rows = _labelled(k)
    return sampling.ratio_matched(rows, sampling.carried_tracks(rows, 0.3, 7), 16)


@query(" SELECT dataset, node_id, round(uz / 1.625::DOUBLE, 6) AS z, round(uy / 0.40625::DOUBLE, 6) AS y, round(ux / 0.40625::DOUBLE, 6) AS x, round((1 + t % 7) / 1.625::DOUBLE, 6) AS rz, round((1 + t % 7) / 0.40625::DOUBLE, 6) AS rx FROM pn")
def p2_p3_voxels_and_radii(k: Tracks) -> DataFrame:
    n = g.to_voxels(k.nodes.drop("z", "y", "x"), k.spacing).withColumn("r", g.radius_voxels((1 + F.col("t") % 7).cast("double"), k.spacing))
    return n.select("dataset", "node_id", *[r6(a).alias(a) for a in "zyx"], r6("r.z").alias("rz"), r6("r.x").alias("rx"))


@query("SELECT event_id, round(least(greatest((value - 5) / (40 - 5), 0), 1), 6) AS shown, value >= ln(0.6 / 0.4) AS above FROM events", base=False)
def p5_p15_normalised_and_floored(k: Tracks) -> DataFrame:
    e = k.table("events")
    return e.select("event_id", r6(g.normalised(F.col("value"), F.lit(5.0), F.lit(40.0))).alias("shown"), (F.col("value") >= g.logit_floor(0.6)).alias("above"))


@query(" SELECT dataset, source_id, target_id, round(d - 12 * p, 6) AS cost FROM af")
def l2_probability_bonus(k: Tracks) -> DataFrame:
    return costs.bonus_cost(k.affinity, 12.0).select("dataset", "source_id", "target_id", r6("cost").alias("cost"))
