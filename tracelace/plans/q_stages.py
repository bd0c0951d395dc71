"""Assignment, linkers, lineage stages, voxels, sources and streams over the track tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.functions import geometry as g
from tracelace.operators import assign, costs, diagnose, divisions, joins, linkers, motion, repair, scoring, settings, stages, voxels
from tracelace.plans.q_scores import _ACT, _FT, _truth_pred
from tracelace.plans.q_tables import _NEAR
from tracelace.plans.registry import query, r6
from tracelace.sources import submission
from tracelace.sources.tracks import GATE, RULER, Tracks
from tracelace.storage import shared_dir
from tracelace.streaming import frames

_XYZ = ("uz", "uy", "ux")


def _counts(links: DataFrame) -> DataFrame:
    return links.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("sources"), F.count_distinct("target_id").alias("targets"))


@query()
def g1_node_matching(k: Tracks) -> DataFrame:
    slim = ("dataset", "node_id", "t", *_XYZ)
    near = joins.gated(k.nodes.select(*slim), k.truth.select(*slim), RULER)
    pairs = near.select(F.col("a_dataset").alias("dataset"), F.col("a_t").alias("t"), F.col("a_node_id").alias("source_id"), F.col("b_node_id").alias("target_id"), "d")
    return assign.match_nodes(pairs, sizes=assign.frame_sizes(k.nodes, k.truth))


@query(", x AS (SELECT *, count(*) OVER (PARTITION BY dataset, source_id) AS a, count(*) OVER (PARTITION BY dataset, target_id) AS b FROM ca) SELECT dataset, source_id, target_id FROM x WHERE a = 1 AND b = 1")
def g2_pairs_without_rivals_are_linked(k: Tracks) -> DataFrame:
    w = lambda c: F.count(F.lit(1)).over(W.partitionBy("dataset", c))
    alone = k.candidates.withColumn("_a", w("source_id")).withColumn("_b", w("target_id")).filter("_a = 1 and _b = 1")
    return linkers.nearest_neighbour(k.nodes, GATE).join(alone, ["dataset", "source_id", "target_id"], "left_semi").select("dataset", "source_id", "target_id")


@query()
def g2_nearest_neighbour_linker(k: Tracks) -> DataFrame:
    return linkers.nearest_neighbour(k.nodes, GATE)


@query()
def g3_assignment_linker(k: Tracks) -> DataFrame:
    return linkers.assignment(k.affinity, 20.0, 5.0)


@query()
def g4_motion_linker(k: Tracks) -> DataFrame:
    return linkers.motion(k.nodes)


@query()
def g5_faithful_motion_linker(k: Tracks) -> DataFrame:
    return linkers.motion(k.nodes, linkers.Motion(faithful=True))


@query()
def g6_min_cost_flow_linker(k: Tracks) -> DataFrame:
    return linkers.min_cost_flow(k.nodes, k.affinity.filter("d <= 6"), 3.0, 12.0)


@query()
def g6_flow_with_divisions(k: Tracks) -> DataFrame:
    """A second child is let in where it is worth an appearance and half a micrometre."""
    return linkers.min_cost_flow(k.nodes, k.affinity, 3.0, 20.0, 0.5)


@query()
def g8_division_ilp_linker(k: Tracks) -> DataFrame:
    return linkers.integer_program(k.affinity, 20.0)


@query()
def g9_division_aware_linker(k: Tracks) -> DataFrame:
    return linkers.division_aware(k.nodes, GATE)


@query()
def g14_termination_cost_sweep(k: Tracks) -> DataFrame:
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    priced = k.affinity.withColumn("cost", -F.ln(p))
    out = None
    for stop in (0.5, 1.0, 2.0):
        part = _counts(assign.with_skips(priced, "cost", stop)).withColumn("stop", F.lit(stop))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def m5_division_scoring(k: Tracks) -> DataFrame:
    return divisions.division_counts(k.nodes, k.links, k.truth, k.truth_edges)


@query()
def m7_split_score(k: Tracks) -> DataFrame:
    n = k.nodes.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_pred"))
    e = scoring.edge_counts(scoring.charged_links(k.links, k.nodes, k.truth_edges, k.match), k.truth_edges)
    return scoring.split_score(scoring.video_metrics(e, n, k.video, divisions.division_counts(k.nodes, k.links, k.truth, k.truth_edges)))


_BRIDGE = """, ep0 AS (SELECT dataset, target_id AS node_id, arg_min(source_id, edge_seq) AS par FROM pe GROUP BY ALL),
ve AS (SELECT pn.*, coalesce(pn.uz - q.uz, 0.0::DOUBLE) AS vz, coalesce(pn.uy - q.uy, 0.0::DOUBLE) AS vy, coalesce(pn.ux - q.ux, 0.0::DOUBLE) AS vx FROM pn LEFT JOIN ep0 USING (dataset, node_id) LEFT JOIN pn q ON q.dataset = pn.dataset AND q.node_id = par),
nn AS (SELECT a.dataset, a.node_id, min({near}) AS d FROM pn a JOIN pn b ON a.dataset = b.dataset AND a.t = b.t WHERE {near} > 0 AND {near} <= 10.0 GROUP BY ALL),
la AS (SELECT dataset, max(t) AS last FROM pn GROUP BY dataset),
en AS (SELECT ve.*, least(5.0, coalesce(d / 2, 5.0)) AS r FROM ve JOIN la USING (dataset) LEFT JOIN nn USING (dataset, node_id) WHERE t < last - 1 AND NOT EXISTS (SELECT 1 FROM pe WHERE pe.dataset = ve.dataset AND pe.source_id = ve.node_id)),
st AS (SELECT * FROM pn WHERE NOT EXISTS (SELECT 1 FROM pe WHERE pe.dataset = pn.dataset AND pe.target_id = pn.node_id)),
mp AS (SELECT * FROM (SELECT a.dataset, a.node_id AS end_id, b.node_id AS start_id, sqrt((a.uz + 2 * a.vz - b.uz) * (a.uz + 2 * a.vz - b.uz) + (a.uy + 2 * a.vy - b.uy) * (a.uy + 2 * a.vy - b.uy) + (a.ux + 2 * a.vx - b.ux) * (a.ux + 2 * a.vx - b.ux)) AS cost, a.r FROM en a JOIN st b ON a.dataset = b.dataset AND b.t = a.t + 2) WHERE cost <= r)""".replace("{near}", _NEAR)


@query(_BRIDGE + " SELECT dataset, 1 AS missing, end_id, start_id, round(cost, 6) AS cost FROM mp QUALIFY count(*) OVER (PARTITION BY dataset, end_id) = 1")
def r6_bridge_proposals(k: Tracks) -> DataFrame:
    return stages.bridge_proposals(k.nodes, k.links, 5.0).withColumn("cost", r6("cost"))


@query()
def r6_density_gap_bridge(k: Tracks) -> DataFrame:
    return _counts(stages.density_gap_bridge(k.nodes, k.links, 5.0)[1])


@query()
def r5_gap_closer(k: Tracks) -> DataFrame:
    return _counts(stages.close_gaps(k.nodes, k.links, 14.0, 4.0)[1])


_DIV = """, si AS (SELECT dataset, source_id, min(target_id) AS kept FROM pe GROUP BY ALL HAVING count(*) = 1),
dc AS (SELECT * FROM (SELECT a.dataset, a.t, a.node_id AS parent_id, b.node_id AS child_id, kept AS kept_id, {near} AS d_parent,
  sqrt((q.uz - b.uz) * (q.uz - b.uz) + (q.uy - b.uy) * (q.uy - b.uy) + (q.ux - b.ux) * (q.ux - b.ux)) AS d_sister FROM pn a JOIN si ON si.dataset = a.dataset AND si.source_id = a.node_id JOIN pn q ON q.dataset = a.dataset AND q.node_id = kept
  JOIN pn b ON b.dataset = a.dataset AND b.t = a.t + 1 WHERE NOT EXISTS (SELECT 1 FROM pe WHERE pe.dataset = b.dataset AND pe.target_id = b.node_id)) WHERE d_parent <= {gp} AND d_sister <= {gs})""".replace("{near}", _NEAR)


@query(", tl AS (SELECT * FROM pe WHERE target_id % 4 <> 0), pe2 AS (SELECT 1)" + _DIV.replace("pe ", "tl ").replace("pe.", "tl.").replace("{gp}", "10.0").replace("{gs}", "14.0") + " SELECT dataset, t, parent_id, child_id, kept_id, round(d_parent + 0.15 * d_sister, 6) AS score FROM dc")
def r7_division_candidates(k: Tracks) -> DataFrame:
    c = stages.division_candidates(k.nodes, k.links.filter("target_id % 4 != 0"), 10.0, 14.0)
    return c.select("dataset", "t", "parent_id", "child_id", "kept_id", r6("score").alias("score"))


@query()
def r7_geometric_division_recovery(k: Tracks) -> DataFrame:
    return stages.geometric_divisions(k.nodes, k.links.filter("target_id % 4 != 0"), 10.0, 14.0, 14.0)


@query(", tl AS (SELECT * FROM pe WHERE target_id % 4 <> 0)" + _DIV.replace("pe ", "tl ").replace("pe.", "tl.").replace("{gp}", "10.0").replace("{gs}", "14.0") + """, rp AS (SELECT dc.*, p, row_number() OVER (PARTITION BY dc.dataset, dc.child_id ORDER BY -p, dc.parent_id) AS r FROM dc JOIN af ON af.dataset = dc.dataset AND af.source_id = dc.parent_id AND af.target_id = dc.child_id),
pp AS (SELECT *, row_number() OVER (PARTITION BY dataset, parent_id ORDER BY -p, child_id) AS q FROM rp WHERE r = 1), gg AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY -p, parent_id, child_id) AS g FROM pp WHERE q = 1), bu AS (SELECT dataset, round_even(count(*) * 0.02, 0) AS b FROM pn GROUP BY dataset) SELECT dataset, parent_id AS source_id, child_id AS target_id FROM gg JOIN bu USING (dataset) WHERE g <= b""")
def r8_affinity_division_recovery(k: Tracks) -> DataFrame:
    return stages.affinity_divisions(k.nodes, k.links.filter("target_id % 4 != 0"), k.affinity, budget_share=0.02).select("dataset", "source_id", "target_id")


@query()
def r4_linefit_smoother(k: Tracks) -> DataFrame:
    return stages.smoothed(k.nodes, k.links, repair.labelled(k.nodes, k.links))


@query()
def r15_adaptive_rescue(k: Tracks) -> DataFrame:
    e = k.links.join(k.affinity.select("dataset", "source_id", "target_id", "p"), ["dataset", "source_id", "target_id"])
    s = repair.tracks_summary(k.nodes, e, repair.labelled(k.nodes, k.links)).filter("size < 6 and n_edges > 0")
    cap = k.nodes.groupBy("dataset").agg(F.floor(F.count(F.lit(1)) * 0.01).cast("int").alias("cap"))
    return stages.rescued_by_budget(s, cap)


@query()
def m29_constraint_safe_merge(k: Tracks) -> DataFrame:
    return _counts(stages.merged(k.links.filter("target_id % 3 != 0"), linkers.nearest_neighbour(k.nodes, GATE)))


@query(_FT + ", a AS (SELECT ft.dataset, fate, sqrt((b.uz - a.uz) * (b.uz - a.uz) + (b.uy - a.uy) * (b.uy - a.uy) + (b.ux - a.ux) * (b.ux - a.ux)) AS d FROM ft JOIN tn a ON a.dataset = ft.dataset AND a.node_id = source_id JOIN tn b ON b.dataset = ft.dataset AND b.node_id = target_id) SELECT fate, count(*) AS n, round(median(d), 6) AS step_median, round(avg(d), 6) AS step_mean FROM a GROUP BY fate")
def q15_step_by_fate(k: Tracks) -> DataFrame:
    f = diagnose.fates(k.truth_edges, k.match, k.links)
    at = k.truth.select("dataset", "node_id", *_XYZ)
    j = f.join(at.withColumnsRenamed({"node_id": "source_id"} | {c: f"a_{c}" for c in _XYZ}), ["dataset", "source_id"]).join(at.withColumnsRenamed({"node_id": "target_id"} | {c: f"b_{c}" for c in _XYZ}), ["dataset", "target_id"])
    d = g.distance("a_", "b_")
    return j.groupBy("fate").agg(F.count(F.lit(1)).alias("n"), r6(F.median(d)).alias("step_median"), r6(F.avg(d)).alias("step_mean"))


@query(", o AS (SELECT pn.dataset, abs(pn.uz - tn.uz) AS oz, abs(pn.uy - tn.uy) AS oy, abs(pn.ux - tn.ux) AS ox, sqrt((pn.uz - tn.uz) * (pn.uz - tn.uz) + (pn.uy - tn.uy) * (pn.uy - tn.uy) + (pn.ux - tn.ux) * (pn.ux - tn.ux)) AS o FROM pn JOIN tn ON tn.dataset = pn.dataset AND tn.node_id = pn.node_id - 10000000) SELECT dataset, round(median(o), 6) AS mid, round(quantile_cont(o, 0.75) - quantile_cont(o, 0.25), 6) AS iqr, round(median(oz), 6) AS mz, round(median(oy), 6) AS my, round(median(ox), 6) AS mx FROM o GROUP BY dataset")
def q8_localisation_offsets(k: Tracks) -> DataFrame:
    t = k.truth.select("dataset", F.col("node_id").alias("gt_id"), *[F.col(c).alias(f"b_{c}") for c in _XYZ])
    j = k.nodes.select("dataset", F.col("node_id").alias("pred_id"), *[F.col(c).alias(f"a_{c}") for c in _XYZ]).join(k.match, ["dataset", "pred_id"]).join(t, ["dataset", "gt_id"]).withColumn("o", g.distance("a_", "b_"))
    q = lambda p: F.percentile("o", F.lit(p))
    return j.groupBy("dataset").agg(r6(F.median("o")).alias("mid"), r6(q(0.75) - q(0.25)).alias("iqr"), *[r6(F.median(F.abs(F.col(f"a_u{a}") - F.col(f"b_u{a}")))).alias(f"m{a}") for a in "zyx"])


@query(", d AS (SELECT pn.dataset, node_id, t, min(t) OVER (PARTITION BY pn.dataset) AS t0, max(t) OVER (PARTITION BY pn.dataset) AS t1 FROM pn), s AS (SELECT dataset, node_id, t > t0 AND NOT EXISTS (SELECT 1 FROM pe WHERE pe.dataset = d.dataset AND pe.target_id = d.node_id) AS birth, t < t1 AND NOT EXISTS (SELECT 1 FROM pe WHERE pe.dataset = d.dataset AND pe.source_id = d.node_id) AS death FROM d) SELECT dataset, count(*) FILTER (WHERE birth) AS births, count(*) FILTER (WHERE death) AS deaths FROM s GROUP BY dataset")
def q14_boundary_census(k: Tracks) -> DataFrame:
    d = scoring.degrees(k.nodes, k.links).join(k.nodes.select("dataset", "node_id", "t"), ["dataset", "node_id"])
    frame = k.nodes.groupBy("dataset").agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    j = d.join(frame, "dataset")
    return j.groupBy("dataset").agg(F.count_if((F.col("in_degree") == 0) & (F.col("t") > F.col("_t0"))).alias("births"), F.count_if((F.col("out_degree") == 0) & (F.col("t") < F.col("_t1"))).alias("deaths"))


@query(_ACT + ", b AS (SELECT *, ntile(5) OVER (PARTITION BY dataset ORDER BY d, source_id, target_id) AS band FROM ac), r AS (SELECT dataset, band, is_true, rank() OVER (PARTITION BY dataset, band ORDER BY p) + (count(*) OVER (PARTITION BY dataset, band, p) - 1) / 2.0 AS rk FROM b) SELECT dataset, band, count(*) FILTER (WHERE is_true) AS n_pos, count(*) FILTER (WHERE NOT is_true) AS n_neg, round((sum(rk) FILTER (WHERE is_true) - count(*) FILTER (WHERE is_true) * (count(*) FILTER (WHERE is_true) + 1) / 2.0) / nullif(count(*) FILTER (WHERE is_true) * count(*) FILTER (WHERE NOT is_true), 0), 9) AS auc FROM r GROUP BY ALL")
def q10_banded_auc(k: Tracks) -> DataFrame:
    a = scoring.active_pairs(k.affinity, _truth_pred(k)).withColumn("band", F.ntile(5).over(W.partitionBy("dataset").orderBy("d", "source_id", "target_id")))
    out = scoring.auc(a, "p", "is_true", ("dataset", "band"))
    return out.withColumn("auc", F.round("auc", 9))


@query(", s AS (SELECT pt.dataset, user_id, pt.t, pt.node_id, uz, uy, ux FROM pt JOIN tn ON tn.node_id = pt.node_id AND tn.dataset = pt.dataset), l AS (SELECT *, uz - lag(uz) OVER w AS vz, uy - lag(uy) OVER w AS vy, ux - lag(ux) OVER w AS vx, lead(uz) OVER w AS nz, lead(uy) OVER w AS ny, lead(ux) OVER w AS nx FROM s WINDOW w AS (PARTITION BY dataset, user_id ORDER BY t)) SELECT dataset, count(*) AS n, round(avg(sqrt((nz - uz - vz) * (nz - uz - vz) + (ny - uy - vy) * (ny - uy - vy) + (nx - ux - vx) * (nx - ux - vx))), 6) AS error, round(avg(sqrt((nz - uz) * (nz - uz) + (ny - uy) * (ny - uy) + (nx - ux) * (nx - ux))), 6) AS still FROM l WHERE vz IS NOT NULL AND nz IS NOT NULL GROUP BY dataset")
def q16_trajectory_prediction(k: Tracks) -> DataFrame:
    w = W.partitionBy("dataset", "user_id").orderBy("t")
    s = g.to_um(k.points)
    l = s.withColumns({f"v{a}": F.col(f"u{a}") - F.lag(f"u{a}").over(w) for a in "zyx"} | {f"n{a}": F.lead(f"u{a}").over(w) for a in "zyx"}).filter("vz is not null and nz is not null")  # noqa: E741
    e = g.norm(*[F.col(f"n{a}") - F.col(f"u{a}") - F.col(f"v{a}") for a in "zyx"])
    return l.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(e)).alias("error"), r6(F.avg(g.norm(*[F.col(f"n{a}") - F.col(f"u{a}") for a in "zyx"]))).alias("still"))


@query("SELECT event_id, (props->>'k')::INTEGER AS k, CASE WHEN value >= 0 AND value <= 1 THEN round(value, 6) ELSE round(1 / (1 + exp(-least(greatest(value, -20.0), 20.0))), 6) END AS guarded, greatest(round_even(value, 0), 0)::INTEGER AS voxel, split_part(event_type, '_', 1) AS prefix FROM events", base=False)
def p_scalar_functions(k: Tracks) -> DataFrame:
    e = k.table("events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), r6(g.guarded_probability(F.col("value"))).alias("guarded"), g.whole_voxel(F.col("value")).alias("voxel"), g.prefix_of(F.col("event_type")).alias("prefix"))


@query("SELECT a.vec_id, b.vec_id AS other_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", base=False)
def f_array_cosine(k: Tracks) -> DataFrame:
    e = k.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    total = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("e").alias("o")), "vec_id")
    return j.select("vec_id", "other_id", F.round(total("e", "o") / F.sqrt(total("e", "e") * total("o", "o")), 5).alias("cosine"))


@query(", l AS (SELECT dataset, t, source_id, target_id, ln(sum(exp(-d)) OVER (PARTITION BY dataset, t, source_id)) + d AS nll FROM ca), tr AS (SELECT dataset, source_id + 10000000 AS source_id, target_id + 10000000 AS target_id FROM te) SELECT dataset, count(*) AS n, round(avg(nll), 6) AS loss FROM l WHERE EXISTS (SELECT 1 FROM tr WHERE tr.dataset = l.dataset AND tr.source_id = l.source_id AND tr.target_id = l.target_id) GROUP BY dataset")
def loss_info_nce(k: Tracks) -> DataFrame:
    nll = F.ln(F.sum(F.exp(-F.col("d"))).over(costs.by_source())) + F.col("d")
    return k.candidates.withColumn("nll", nll).join(_truth_pred(k), ["dataset", "source_id", "target_id"], "left_semi").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("nll")).alias("loss"))


@query(_ACT + " SELECT dataset, round(avg(CASE WHEN is_true THEN -power(1 - p, 2) * ln(greatest(p, 1e-12)) ELSE -power(p, 2) * ln(greatest(1 - p, 1e-12)) END), 6) AS focal, round((avg(-ln(greatest(p, 1e-12))) FILTER (WHERE is_true) + avg(-ln(greatest(1 - p, 1e-12))) FILTER (WHERE NOT is_true)) / 2, 6) AS balanced FROM ac GROUP BY dataset")
def loss_focal_and_balanced(k: Tracks) -> DataFrame:
    a = scoring.active_pairs(k.affinity, _truth_pred(k))
    yes, no = -F.ln(F.greatest("p", F.lit(1e-12))), -F.ln(F.greatest(1 - F.col("p"), F.lit(1e-12)))
    focal = F.when(F.col("is_true"), F.pow(1 - F.col("p"), 2) * yes).otherwise(F.pow("p", 2) * no)
    return a.groupBy("dataset").agg(r6(F.avg(focal)).alias("focal"), r6((F.avg(F.when(F.col("is_true"), yes)) + F.avg(F.when(~F.col("is_true"), no))) / 2).alias("balanced"))


@query()
def q3_furth_fit(k: Tracks) -> DataFrame:
    curve = [(r.lag, r.msd) for r in motion.msd(motion.chains(k.truth, k.truth_edges), 8).collect()]
    return k.spark.createDataFrame([motion.furth_fit(sorted(curve))], "speed double, persistence double, noise double")


@query("SELECT user_id::VARCHAR AS run, max(CASE WHEN event_type = 'view' THEN floor(value)::INTEGER END) AS last_epoch, CASE WHEN bool_or(event_type = 'purchase') THEN 'done' WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'running' END AS state FROM events GROUP BY user_id", base=False)
def q22_run_states(k: Tracks) -> DataFrame:
    e = k.table("events")
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("epoch "), F.floor("value").cast("string"))).when(F.col("event_type") == "purchase", "finished").when(F.col("event_type") == "error", "Error").otherwise("idle")
    return settings.run_states(e.select(F.col("user_id").cast("string").alias("run"), line.alias("line"))).select("run", "last_epoch", "state")


@query(" , nx AS (SELECT row_type, dataset, node_id, t, z, y, x, source_id, target_id FROM (SELECT 'node' AS row_type, dataset, node_id, t, z, greatest(y, 0) AS y, x, -1 AS source_id, -1 AS target_id, 0 AS k FROM pn UNION ALL SELECT 'edge', dataset, -1, -1, -1, -1, -1, source_id, target_id, 1 FROM pe)) SELECT row_number() OVER (ORDER BY dataset, row_type DESC, node_id, source_id, target_id) - 1 AS id, dataset, row_type, node_id::BIGINT AS node_id, t::BIGINT AS t, z::BIGINT AS z, y::BIGINT AS y, x::BIGINT AS x, source_id::BIGINT AS source_id, target_id::BIGINT AS target_id FROM nx")
def s9_submission_table(k: Tracks) -> DataFrame:
    return submission.combined(k.nodes, k.links)


@query(" SELECT dataset, count(*) AS n_nodes, sum(z)::BIGINT AS sz, sum(greatest(y, 0))::BIGINT AS sy, (SELECT count(*) FROM pe WHERE pe.dataset = pn.dataset) AS n_edges FROM pn GROUP BY dataset")
def s7_submission_round_trip(k: Tracks) -> DataFrame:
    import uuid

    path = f"{shared_dir(k.spark)}/tracelace/submission-{uuid.uuid4().hex}"
    submission.write_csv(submission.combined(k.nodes, k.links), path)
    n, e = submission.read_csv(k.spark, path)
    return n.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("z").alias("sz"), F.sum("y").alias("sy")).join(e.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_edges")), "dataset")


#: Every voxel that a detection can lie in, moves along y by up to two included.
_GRID = (16, 104, 104)


@query()
def g15_voxel_peaks(k: Tracks) -> DataFrame:
    return voxels.peaks(voxels.Drawn(k.nodes, _GRID, 1.2), (1, 2, 2), 0.5)


@query()
def g17_blob_response_peaks(k: Tracks) -> DataFrame:
    return voxels.dog_peaks(voxels.Drawn(k.nodes, _GRID, 1.2), (1.0, 1.5, 1.5), (1, 2, 2), 0.05)


@query()
def g17_laplacian_peaks(k: Tracks) -> DataFrame:
    response = voxels.mapped(voxels.Drawn(k.nodes, _GRID, 1.2), lambda a: voxels.log_response(a, (1.0, 1.5, 1.5)))
    return voxels.peaks(response, (1, 2, 2), 0.2)


@query()
def p6_frame_normalisation(k: Tracks) -> DataFrame:
    frame = voxels.mapped(voxels.Drawn(k.nodes, _GRID, 1.2), lambda a: voxels.pooled(voxels.per_slice(a), 2))
    mass = voxels.each(frame, lambda dataset, t, a, _: [(dataset, t, list(a.shape), float(np.cumsum(a, dtype=float)[-1]))], "dataset string, t int, shape array<int>, mass double")
    return mass.withColumn("mass", r6("mass"))


def _stream(k: Tracks) -> DataFrame:
    schema = k.table("events").schema
    events = k.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(k.sf_dir)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(trunc(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL", base=False)
def z4_windowed_stream(k: Tracks) -> DataFrame:
    out = frames.windowed_counts(_stream(k), "1 hour", "1 hour", "10 minutes")
    return frames.drained(out, "stream-windows", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def z2_streaming_motion_linker(k: Tracks) -> DataFrame:
    import uuid

    path = f"{shared_dir(k.spark)}/tracelace/points-{uuid.uuid4().hex}"
    slim = k.nodes.select("dataset", "node_id", "t", *_XYZ)
    # a point two frames after the last one closes every real frame
    close = slim.groupBy("dataset").agg(F.lit(-1).cast("long").alias("node_id"), (F.max("t") + 2).cast("int").alias("t"), *[F.lit(0.0).alias(c) for c in _XYZ])
    slim.unionByName(close).write.parquet(path)
    stream = k.spark.readStream.schema(k.spark.read.parquet(path).schema).parquet(path)
    return frames.drained(frames.linked(stream), "stream-links")
