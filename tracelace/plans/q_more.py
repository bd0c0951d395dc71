"""Features, rivals, strata and further diagnoses over the track tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.functions import geometry as g
from tracelace.operators import diagnose, features, joins, motion, repair
from tracelace.plans.q_scores import _ACT, _CHN, _FT, _ROOT, _chains, _truth_pred
from tracelace.plans.q_tables import _NEAR
from tracelace.plans.registry import query, r6
from tracelace.sources.tracks import RULER, Tracks

_XYZ = ("uz", "uy", "ux")

_FEAT = f""", cr AS (SELECT dataset, node_id, (SELECT count(*) FROM pn b WHERE b.dataset = a.dataset AND b.t = a.t AND b.node_id <> a.node_id AND {_NEAR} <= 7.0) AS n_near FROM pn a),
fe AS (SELECT af.dataset, af.source_id, af.target_id, b.uz - a.uz AS dz, b.uy - a.uy AS dy, b.ux - a.ux AS dx, d, t_n AS t_norm, p,
  row_number() OVER (PARTITION BY af.dataset, af.source_id ORDER BY d, af.target_id) AS d_rank, count(*) OVER (PARTITION BY af.dataset, af.source_id) AS n_candidates,
  row_number() OVER (PARTITION BY af.dataset, af.target_id ORDER BY d, af.source_id) AS t_rank, count(*) OVER (PARTITION BY af.dataset, af.target_id) AS n_sources,
  max(p) OVER (PARTITION BY af.dataset, af.source_id) AS best_out, max(p) OVER (PARTITION BY af.dataset, af.target_id) AS best_in, cs.n_near AS near_source, ct.n_near AS near_target
  FROM (SELECT af.*, af.t / m.last AS t_n FROM af JOIN (SELECT dataset, max(t) AS last FROM pn GROUP BY dataset) m USING (dataset)) af JOIN pn a ON a.dataset = af.dataset AND a.node_id = af.source_id JOIN pn b ON b.dataset = af.dataset AND b.node_id = af.target_id
  JOIN cr cs ON cs.dataset = af.dataset AND cs.node_id = af.source_id JOIN cr ct ON ct.dataset = af.dataset AND ct.node_id = af.target_id)"""
_KEPT = ("dz", "dy", "dx", "d", "t_norm", "d_rank", "n_candidates", "t_rank", "n_sources", "p", "best_out", "best_in", "near_source", "near_target")


def _features(k: Tracks) -> DataFrame:
    return features.of_pairs(k.nodes, k.affinity, RULER)


@query(_FEAT + " SELECT dataset, source_id, target_id, " + ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in _KEPT) + " FROM fe")
def e7_association_features(k: Tracks) -> DataFrame:
    return _features(k).select("dataset", "source_id", "target_id", *[r6(c).alias(c) for c in _KEPT])


@query(_FEAT + ", mo AS (SELECT f, dataset = 'd0' AS tr, v FROM (SELECT dataset, unnest(['d', 'p', 'd_rank']) AS f, unnest([d::DOUBLE, p::DOUBLE, d_rank::DOUBLE]) AS v FROM fe)), a AS (SELECT f, avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS s FROM mo WHERE tr GROUP BY f), b AS (SELECT f, avg(v) AS m, stddev_pop(v) AS s FROM mo WHERE NOT tr GROUP BY f) SELECT f AS feature, round(abs(b.m - a.m) / a.s, 6) AS shift, round(b.s / a.s, 6) AS spread, abs(b.m - a.m) / a.s > 1.0 AS drifted FROM a JOIN b USING (f)")
def q12_feature_drift(k: Tracks) -> DataFrame:
    f, names = _features(k), ("d", "p", "d_rank")
    out = features.drift(features.moments(f.filter("dataset != 'd0'"), names), features.moments(f.filter("dataset = 'd0'"), names))
    return out.select("feature", r6("shift").alias("shift"), r6("spread").alias("spread"), "drifted")


@query()
def e7_network_scores(k: Tracks) -> DataFrame:
    import numpy as np

    n, rng = len(features.NAMES), np.random.default_rng(7)
    layers = [(rng.normal(size=(n, 8)) / 4, np.zeros(8)), (rng.normal(size=(8, 8)) / 3, np.zeros(8)), (rng.normal(size=(8, 1)) / 3, np.zeros(1))]
    return features.scored(_features(k), features.network(layers, (np.ones(8), np.zeros(8)), np.zeros(n), np.ones(n)))


@query(_ACT + ", y AS (SELECT af.*, EXISTS (SELECT 1 FROM tr WHERE tr.dataset = af.dataset AND tr.source_id = af.source_id AND tr.target_id = af.target_id) AS y FROM af), s AS (SELECT dataset, source_id, arg_min(y, d * 1e9::DOUBLE + target_id % 1000000) AS first_true, bool_or(y) AS has FROM y GROUP BY ALL) SELECT dataset, count(*) AS n, count(*) FILTER (WHERE NOT first_true) AS hard FROM s WHERE has GROUP BY dataset")
def q24_hard_fraction(k: Tracks) -> DataFrame:
    y = joins.in_set(k.affinity, _truth_pred(k), "source_id", "target_id", "_y")
    s = y.groupBy("dataset", "source_id").agg(F.min_by("_y", F.col("d") * 1e9 + F.col("target_id") % 1_000_000).alias("_first"), F.bool_or("_y").alias("_has")).filter("_has")
    return s.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_first")).alias("hard"))


@query(_ACT + ", y AS (SELECT af.*, EXISTS (SELECT 1 FROM tr WHERE tr.dataset = af.dataset AND tr.source_id = af.source_id AND tr.target_id = af.target_id) AS y FROM af), m AS (SELECT *, max(p) FILTER (WHERE y) OVER (PARTITION BY dataset, target_id) AS pt FROM y), r AS (SELECT dataset, target_id, sum((p > pt)::INTEGER) AS rank FROM m WHERE pt IS NOT NULL GROUP BY ALL) SELECT least(rank, 3)::BIGINT AS rank, count(*) AS n FROM r GROUP BY ALL")
def q33_rank_of_truth(k: Tracks) -> DataFrame:
    y = joins.in_set(k.affinity, _truth_pred(k), "source_id", "target_id", "_y")
    m = y.withColumn("_pt", F.max(F.when(F.col("_y"), F.col("p"))).over(W.partitionBy("dataset", "target_id"))).filter("_pt is not null")
    r = m.groupBy("dataset", "target_id").agg(F.sum((F.col("p") > F.col("_pt")).cast("long")).alias("rank"))
    return r.groupBy(F.least("rank", F.lit(3)).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@query(f", a0 AS (SELECT a.dataset, a.node_id, min({_NEAR}) AS d FROM tn a JOIN pn b ON a.dataset = b.dataset AND a.t = b.t GROUP BY ALL), s AS (SELECT * REPLACE ((t + 20) % (SELECT max(t) + 1 FROM tn) AS t) FROM tn), b0 AS (SELECT a.dataset, a.node_id, min({_NEAR}) AS d FROM s a JOIN pn b ON a.dataset = b.dataset AND a.t = b.t GROUP BY ALL) SELECT tn.dataset, count(*) AS n, count(*) FILTER (WHERE a0.d <= 2.0) AS found, count(*) FILTER (WHERE b0.d <= 2.0) AS by_chance FROM tn LEFT JOIN a0 USING (dataset, node_id) LEFT JOIN b0 USING (dataset, node_id) GROUP BY tn.dataset")
def m24_detection_against_chance(k: Tracks) -> DataFrame:
    real = joins.nearest(k.truth, k.nodes, within=2.0).select("dataset", "node_id", F.col("d").alias("_r"))
    null = joins.shifted_null(k.truth, k.nodes, 20, k.frames, 2.0).select("dataset", "node_id", F.col("d").alias("_n"))
    return real.join(null, ["dataset", "node_id"]).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("_r").alias("found"), F.count("_n").alias("by_chance"))


@query(f", o AS (SELECT pn.dataset, pn.node_id, sqrt((pn.uz - tn.uz) * (pn.uz - tn.uz) + (pn.uy - tn.uy) * (pn.uy - tn.uy) + (pn.ux - tn.ux) * (pn.ux - tn.ux)) AS o, (SELECT count(*) FROM pn b WHERE b.dataset = pn.dataset AND b.t = pn.t AND b.node_id <> pn.node_id AND {_NEAR.replace('a.', 'pn.')} <= 7.0) AS c FROM pn JOIN tn ON tn.dataset = pn.dataset AND tn.node_id = pn.node_id - 10000000) SELECT CASE WHEN c >= 4 THEN 2 WHEN c >= 2 THEN 1 ELSE 0 END AS stratum, count(*) AS n, round(avg(o), 6) AS mean_offset FROM o GROUP BY ALL")
def q26_offset_strata(k: Tracks) -> DataFrame:
    t = k.truth.select("dataset", F.col("node_id").alias("gt_id"), *[F.col(c).alias(f"b_{c}") for c in _XYZ])
    j = k.nodes.select("dataset", "node_id", *[F.col(c).alias(f"a_{c}") for c in _XYZ]).join(k.match.withColumnRenamed("pred_id", "node_id"), ["dataset", "node_id"]).join(t, ["dataset", "gt_id"]).join(joins.crowding(k.nodes, RULER), ["dataset", "node_id"])
    return j.withColumn("stratum", motion.banded(F.col("n_near"), (2, 4))).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(g.distance("a_", "b_"))).alias("mean_offset"))


@query(
    _FT
    + """, x AS (SELECT ft.*, (SELECT count(*) FROM te WHERE te.dataset = ft.dataset AND te.source_id = ft.source_id) > 1 AS fork, b.t - a.t AS dt,
  EXISTS (SELECT 1 FROM pe WHERE pe.dataset = ft.dataset AND pe.source_id = pred_source) AS so, EXISTS (SELECT 1 FROM pe WHERE pe.dataset = ft.dataset AND pe.target_id = pred_target) AS ti
  FROM ft JOIN tn a ON a.dataset = ft.dataset AND a.node_id = ft.source_id JOIN tn b ON b.dataset = ft.dataset AND b.node_id = ft.target_id WHERE fate <> 'CORRECT')
SELECT CASE WHEN pred_source IS NULL AND pred_target IS NULL THEN 'both_missing' WHEN pred_source IS NULL THEN 'source_missing' WHEN pred_target IS NULL THEN 'target_missing'
  WHEN fork THEN 'division_parent' WHEN dt <> 1 THEN 'frame_gap' WHEN so AND ti THEN 'swapped' WHEN so THEN 'source_taken' WHEN ti THEN 'target_taken' ELSE 'unlinked' END AS shape, count(*) AS n FROM x GROUP BY ALL"""
)
def m14_broken_edge_shapes(k: Tracks) -> DataFrame:
    return diagnose.broken_shapes(diagnose.fates(k.truth_edges, k.match, k.links), k.truth, k.truth_edges, k.links).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


@query(
    _ROOT
    + f""", tt AS (SELECT * FROM tn WHERE node_id % 3 <> 0), un AS (SELECT co.dataset, co.component, co.node_id,
  NOT EXISTS (SELECT 1 FROM tt JOIN pn q ON q.dataset = co.dataset AND q.node_id = co.node_id WHERE tt.dataset = co.dataset AND tt.t = q.t AND {_NEAR.replace("a.", "tt.").replace("b.", "q.")} <= 1.0) AS far FROM co),
u AS (SELECT dataset, component, avg(far::INTEGER::DOUBLE) AS share FROM un GROUP BY ALL)
SELECT dataset, CASE WHEN share >= 0.999 THEN 'all' WHEN share >= 0.5 THEN 'most' ELSE 'few' END AS band, count(*) AS n FROM u GROUP BY ALL"""
)
def m22_fork_unique_tracks(k: Tracks) -> DataFrame:
    """Tracks of which all, most or few detections lie further than the ruler from a sparser annotation."""
    near = joins.nearest(k.nodes, k.truth.filter("node_id % 3 != 0"), within=1.0).select("dataset", "node_id", F.col("d").isNull().alias("_far"))
    u = repair.labelled(k.nodes, k.links).join(near, ["dataset", "node_id"]).groupBy("dataset", "component").agg(F.avg(F.col("_far").cast("int")).alias("_s"))
    band = F.when(F.col("_s") >= 0.999, "all").when(F.col("_s") >= 0.5, "most").otherwise("few")
    return u.groupBy("dataset", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f", ms AS (SELECT a.dataset, a.node_id AS gt, b.node_id AS pr FROM tn a JOIN pn b ON a.dataset = b.dataset AND a.t = b.t WHERE {_NEAR} <= 3.0) SELECT te.dataset, count(DISTINCT te.source_id * 100000000 + te.target_id) AS n_edges FROM te JOIN ms s ON s.dataset = te.dataset AND s.gt = te.source_id JOIN ms e ON e.dataset = te.dataset AND e.gt = te.target_id JOIN pe ON pe.dataset = te.dataset AND pe.source_id = s.pr AND pe.target_id = e.pr GROUP BY te.dataset")
def m26_representative_alternates(k: Tracks) -> DataFrame:
    slim = ("dataset", "node_id", "t", *_XYZ)
    near = joins.gated(k.truth.select(*slim), k.nodes.select(*slim), 3.0).select(F.col("a_dataset").alias("dataset"), F.col("a_node_id").alias("gt"), F.col("b_node_id").alias("pr"))
    e = k.truth_edges.select("dataset", "source_id", "target_id").join(near.withColumnsRenamed({"gt": "source_id", "pr": "_s"}), ["dataset", "source_id"]).join(near.withColumnsRenamed({"gt": "target_id", "pr": "_t"}), ["dataset", "target_id"])
    held = e.join(k.links.select("dataset", F.col("source_id").alias("_s"), F.col("target_id").alias("_t")), ["dataset", "_s", "_t"], "left_semi")
    return held.select("dataset", "source_id", "target_id").distinct().groupBy("dataset").agg(F.count(F.lit(1)).alias("n_edges"))


@query(_CHN + ", x AS (SELECT a.dataset, sqrt((a.uz - b.uz) * (a.uz - b.uz) + (a.uy - b.uy) * (a.uy - b.uy) + (a.ux - b.ux) * (a.ux - b.ux)) AS d, (a.vz * b.vz + a.vy * b.vy + a.vx * b.vx) / (a.step * b.step) AS c FROM sp a JOIN sp b ON a.dataset = b.dataset AND a.t = b.t AND a.node_id < b.node_id WHERE a.step > 0 AND b.step > 0) SELECT CASE WHEN d >= 10.0 THEN 2 WHEN d >= 5.0 THEN 1 ELSE 0 END AS band, count(*) AS n, round(avg(c), 6) AS coupling FROM x WHERE d <= 15.0 GROUP BY ALL")
def q4_neighbour_coupling(k: Tracks) -> DataFrame:
    s = motion.steps(_chains(k)).filter("step > 0").select("dataset", "node_id", "t", *_XYZ, "vz", "vy", "vx", "step")
    p = joins.gated(s, s, 15.0).filter("a_node_id < b_node_id")
    c = (F.col("a_vz") * F.col("b_vz") + F.col("a_vy") * F.col("b_vy") + F.col("a_vx") * F.col("b_vx")) / (F.col("a_step") * F.col("b_step"))
    return p.withColumn("band", motion.banded(F.col("d"), (5.0, 10.0))).groupBy("band").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(c)).alias("coupling"))


@query(_CHN + " SELECT dataset, node_id, count(*) OVER (PARTITION BY dataset, chain_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS frames_ahead FROM cn")
def w7_frames_ahead(k: Tracks) -> DataFrame:
    w = W.partitionBy("dataset", "chain_id").orderBy("pos").rowsBetween(W.currentRow, W.unboundedFollowing)
    return _chains(k).select("dataset", "node_id", F.count(F.lit(1)).over(w).alias("frames_ahead"))


@query(
    """, pr AS (SELECT dataset, target_id AS node_id, min(source_id) AS prev FROM pe GROUP BY ALL HAVING count(*) = 1),
w0 AS (SELECT dataset, node_id AS start, node_id, 0 AS steps FROM pn UNION ALL SELECT w0.dataset, start, prev, steps + 1 FROM w0 JOIN pr ON pr.dataset = w0.dataset AND pr.node_id = w0.node_id WHERE steps < 3),
w1 AS (SELECT dataset, start, arg_max(node_id, steps) AS last FROM w0 GROUP BY ALL)
SELECT a.dataset, a.node_id, a.t - b.t AS span, CASE WHEN a.t > b.t THEN round((a.uz - b.uz) / (a.t - b.t), 6) ELSE 0 END AS vz, CASE WHEN a.t > b.t THEN round((a.uy - b.uy) / (a.t - b.t), 6) ELSE 0 END AS vy,
  CASE WHEN a.t > b.t THEN round((a.ux - b.ux) / (a.t - b.t), 6) ELSE 0 END AS vx FROM w1 JOIN pn a ON a.dataset = w1.dataset AND a.node_id = start JOIN pn b ON b.dataset = w1.dataset AND b.node_id = last"""
)
def g19_walk_back_velocity(k: Tracks) -> DataFrame:
    v = motion.walk_back(k.nodes, k.links, 3)
    return v.select("dataset", "node_id", "span", *[r6(f"v{a}").alias(f"v{a}") for a in "zyx"])


@query(
    """, ed AS (SELECT l_orderkey AS a, 1000000000 + l_partkey AS b FROM lineitem UNION SELECT 1000000000 + l_partkey, l_orderkey FROM lineitem),
f1 AS (SELECT DISTINCT b AS node FROM ed WHERE a = (SELECT min(l_orderkey) FROM lineitem)), f2 AS (SELECT DISTINCT b AS node FROM f1 JOIN ed ON a = node),
f3 AS (SELECT DISTINCT b AS node FROM f2 JOIN ed ON a = node), f4 AS (SELECT DISTINCT b AS node FROM f3 JOIN ed ON a = node),
re AS (SELECT min(l_orderkey) AS node, 0 AS hops FROM lineitem UNION ALL SELECT node, 1 FROM f1 UNION ALL SELECT node, 2 FROM f2 UNION ALL SELECT node, 3 FROM f3 UNION ALL SELECT node, 4 FROM f4)
SELECT node, min(hops)::INTEGER AS hops FROM re GROUP BY node""",
)
def q35_reachability(k: Tracks) -> DataFrame:
    """Orders and parts within four steps of the first order, over the whole lineitem table."""
    r = k.table("lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 1_000_000_000).alias("b"))
    return features.reachable(r.union(r.select("b", "a")), r.agg(F.min("a").alias("node")), "a", "b", most=4)
