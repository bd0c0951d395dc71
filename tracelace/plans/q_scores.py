"""Scores, error decomposition, link costs, fusion and motion over the track tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.operators import costs, diagnose, joins, motion, repair, sampling, scoring
from tracelace.plans.q_tables import _TWO, _second
from tracelace.plans.registry import query, r6
from tracelace.sources.tracks import RULER, Tracks

_XYZ = ("uz", "uy", "ux")

#: Charged links as table expressions: equal links once, next frame, merged pairs, two a source, countable.
_CH = """, c1 AS (SELECT pe.dataset, pe.source_id, pe.target_id, min(edge_seq) AS edge_seq FROM pe JOIN pn a ON a.dataset = pe.dataset AND a.node_id = pe.source_id JOIN pn b ON b.dataset = pe.dataset AND b.node_id = pe.target_id WHERE b.t - a.t = 1 GROUP BY ALL),
c2 AS (SELECT c1.*, a.gt_id AS gs, b.gt_id AS gt FROM c1 LEFT JOIN mt a ON a.dataset = c1.dataset AND a.pred_id = c1.source_id LEFT JOIN mt b ON b.dataset = c1.dataset AND b.pred_id = c1.target_id),
c3 AS (SELECT *, CASE WHEN gs IS NOT NULL AND gt IS NOT NULL THEN row_number() OVER (PARTITION BY dataset, gs, gt ORDER BY edge_seq, source_id) ELSE 1 END AS r FROM c2),
c4 AS (SELECT *, row_number() OVER (PARTITION BY dataset, source_id ORDER BY edge_seq, target_id) AS q FROM c3 WHERE r = 1),
ch AS (SELECT dataset, source_id, target_id, gs AS gt_source, gt AS gt_target, EXISTS (SELECT 1 FROM te WHERE te.dataset = c4.dataset AND te.source_id = gs AND te.target_id = gt) AS is_true FROM c4
  WHERE q <= 2 AND (EXISTS (SELECT 1 FROM te WHERE te.dataset = c4.dataset AND te.source_id = gs) OR EXISTS (SELECT 1 FROM te WHERE te.dataset = c4.dataset AND te.target_id = gt))),
ec AS (SELECT dataset, coalesce(tp, 0)::BIGINT AS tp, coalesce(fp, 0)::BIGINT AS fp, n - coalesce(tp, 0)::BIGINT AS fn FROM (SELECT dataset, count(*) AS n FROM (SELECT DISTINCT dataset, source_id, target_id FROM te) GROUP BY dataset) LEFT JOIN (SELECT dataset, sum(is_true::INTEGER) AS tp, sum((NOT is_true)::INTEGER) AS fp FROM ch GROUP BY dataset) USING (dataset))"""


def _charged(k: Tracks) -> DataFrame:
    return scoring.charged_links(k.links, k.nodes, k.truth_edges, k.match)


@query(_CH + " SELECT * FROM ch")
def m3_charged_links(k: Tracks) -> DataFrame:
    return _charged(k).select("dataset", "source_id", "target_id", "gt_source", "gt_target", "is_true")


@query(_CH + " SELECT *, tp / (tp + fp + fn) AS jaccard FROM ec")
def m4_edge_confusion(k: Tracks) -> DataFrame:
    return scoring.edge_counts(_charged(k), k.truth_edges)


@query(", g AS (SELECT dataset, count(*) AS n_gt FROM tn GROUP BY ALL), p AS (SELECT dataset, count(*) AS n_pred FROM pn GROUP BY ALL), m AS (SELECT dataset, count(DISTINCT gt_id) AS covered, count(*) AS matched FROM mt GROUP BY ALL) SELECT dataset, n_gt, n_pred, covered, matched, matched / n_pred AS precision, covered / n_gt AS recall, 2 * (matched / n_pred) * (covered / n_gt) / (matched / n_pred + covered / n_gt) AS f1 FROM g JOIN p USING (dataset) JOIN m USING (dataset)")
def m1_node_metrics(k: Tracks) -> DataFrame:
    return scoring.node_counts(k.nodes, k.truth, k.match)


@query(", r AS (SELECT a.dataset, a.node_id, min(sqrt((a.uz - b.uz) * (a.uz - b.uz) + (a.uy - b.uy) * (a.uy - b.uy) + (a.ux - b.ux) * (a.ux - b.ux))) AS d FROM tn a JOIN pn b ON a.dataset = b.dataset AND a.t = b.t GROUP BY ALL) SELECT tn.dataset, count(*) AS n, count(d) FILTER (WHERE d <= 7.0) AS covered, count(d) FILTER (WHERE d <= 7.0) / count(*) AS share FROM tn LEFT JOIN r USING (dataset, node_id) GROUP BY tn.dataset")
def m2_candidate_coverage(k: Tracks) -> DataFrame:
    near = joins.nearest(k.truth, k.nodes, within=RULER)
    return near.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("d").alias("covered")).withColumn("share", F.col("covered") / F.col("n"))


_VM = _CH + """, np AS (SELECT dataset, count(*) AS n_pred FROM pn GROUP BY ALL), vm AS (SELECT ec.*, n_pred, estimated_nodes, (n_pred - estimated_nodes) / estimated_nodes AS node_ratio, tp / (tp + fp + fn) AS jaccard, tp + fp + fn AS weight FROM ec JOIN np USING (dataset) JOIN vi USING (dataset))"""


def _metrics(k: Tracks) -> DataFrame:
    n = k.nodes.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_pred"))
    return scoring.video_metrics(scoring.edge_counts(_charged(k), k.truth_edges), n, k.video)


@query(_VM + " SELECT dataset, tp, fp, fn, weight, n_pred, estimated_nodes, round(node_ratio, 6) AS node_ratio, round(greatest(0.0::DOUBLE, jaccard * (1 - 0.1::DOUBLE * node_ratio)), 6) AS adjusted, round(greatest(0.0::DOUBLE, jaccard * least(1.0::DOUBLE, 1 - 0.1::DOUBLE * node_ratio)), 6) AS clamped FROM vm")
def m7_video_metrics(k: Tracks) -> DataFrame:
    return _metrics(k).select("dataset", "tp", "fp", "fn", "weight", "n_pred", "estimated_nodes", r6("node_ratio").alias("node_ratio"), r6("adjusted").alias("adjusted"), r6("clamped").alias("clamped"))


@query(_VM + " SELECT round(sum(weight * greatest(0.0::DOUBLE, jaccard * (1 - 0.1::DOUBLE * node_ratio))) / sum(weight), 6) AS adjusted, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tp) / sum(tp + fp + fn) AS micro FROM vm")
def m8_pooled_score(k: Tracks) -> DataFrame:
    m = _metrics(k)
    return m.agg(r6(scoring.weighted_mean(F.col("adjusted"), F.col("weight"))).alias("adjusted"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn("micro", scoring.jaccard(F.col("tp"), F.col("fp"), F.col("fn")))


@query(_CH + " SELECT substr(dataset, 1, 1) AS prefix, dataset, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tp) / sum(tp + fp + fn) AS jaccard FROM ec GROUP BY ROLLUP (substr(dataset, 1, 1), dataset)")
def a4_acquisition_rollup(k: Tracks) -> DataFrame:
    return scoring.acquisition_rollup(scoring.edge_counts(_charged(k), k.truth_edges))


_ACT = ", tr AS (SELECT dataset, source_id + 10000000 AS source_id, target_id + 10000000 AS target_id FROM te), ac AS (SELECT af.*, EXISTS (SELECT 1 FROM tr WHERE tr.dataset = af.dataset AND tr.source_id = af.source_id AND tr.target_id = af.target_id) AS is_true FROM af WHERE EXISTS (SELECT 1 FROM tr WHERE tr.dataset = af.dataset AND tr.source_id = af.source_id) OR EXISTS (SELECT 1 FROM tr WHERE tr.dataset = af.dataset AND tr.target_id = af.target_id))"


def _truth_pred(k: Tracks) -> DataFrame:
    return k.truth_edges.select("dataset", (F.col("source_id") + 10_000_000).alias("source_id"), (F.col("target_id") + 10_000_000).alias("target_id"))


@query(_ACT + ", r AS (SELECT dataset, is_true, rank() OVER (PARTITION BY dataset ORDER BY p) + (count(*) OVER (PARTITION BY dataset, p) - 1) / 2.0 AS rk FROM ac), s AS (SELECT dataset, sum(rk) FILTER (WHERE is_true) AS rs, count(*) FILTER (WHERE is_true) AS n_pos, count(*) FILTER (WHERE NOT is_true) AS n_neg FROM r GROUP BY dataset) SELECT dataset, n_pos, n_neg, round((rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 9) AS auc FROM s")
def m9_edge_auc(k: Tracks) -> DataFrame:
    out = scoring.auc(scoring.active_pairs(k.affinity, _truth_pred(k)), "p", "is_true", ("dataset",))
    return out.withColumn("auc", F.round("auc", 9))


@query(_ACT + ", r AS (SELECT dataset, is_true::INTEGER AS y, row_number() OVER w AS k, sum(is_true::INTEGER) OVER (PARTITION BY dataset ORDER BY p DESC, target_id * 1000000000 + source_id DESC ROWS UNBOUNDED PRECEDING) AS tp FROM ac WINDOW w AS (PARTITION BY dataset ORDER BY p DESC, target_id * 1000000000 + source_id DESC)) SELECT dataset, sum(y)::BIGINT AS n_pos, round(sum(tp / k) FILTER (WHERE y = 1) / sum(y), 6) AS ap FROM r GROUP BY dataset")
def a24_average_precision(k: Tracks) -> DataFrame:
    a = scoring.active_pairs(k.affinity, _truth_pred(k)).withColumn("_o", F.col("target_id") * 1_000_000_000 + F.col("source_id"))
    return scoring.average_precision(a, "p", "is_true", "_o", ("dataset",)).withColumn("ap", r6("ap"))


_FT = """, mx AS (SELECT dataset, gt_id, min(pred_id) AS pred_id FROM mt GROUP BY ALL),
ft AS (SELECT te.dataset, te.source_id, te.target_id, a.pred_id AS pred_source, b.pred_id AS pred_target,
  CASE WHEN a.pred_id IS NULL OR b.pred_id IS NULL THEN 'ENDPOINT_MISSING' WHEN EXISTS (SELECT 1 FROM pe WHERE pe.dataset = te.dataset AND pe.source_id = a.pred_id AND pe.target_id = b.pred_id) THEN 'CORRECT'
  WHEN EXISTS (SELECT 1 FROM pe WHERE pe.dataset = te.dataset AND pe.target_id = b.pred_id) THEN 'MISLINK_CONFLICT' WHEN EXISTS (SELECT 1 FROM pe WHERE pe.dataset = te.dataset AND pe.source_id = a.pred_id) THEN 'MISLINK_FREE' ELSE 'SKIP' END AS fate
  FROM te LEFT JOIN mx a ON a.dataset = te.dataset AND a.gt_id = te.source_id LEFT JOIN mx b ON b.dataset = te.dataset AND b.gt_id = te.target_id)"""


@query(_FT + " SELECT d.dataset, f.fate, count(ft.source_id) AS n FROM (SELECT DISTINCT dataset FROM te) d CROSS JOIN (SELECT unnest(['CORRECT', 'MISLINK_CONFLICT', 'MISLINK_FREE', 'SKIP', 'ENDPOINT_MISSING']) AS fate) f LEFT JOIN ft ON ft.dataset = d.dataset AND ft.fate = f.fate GROUP BY ALL")
def m10_edge_fates(k: Tracks) -> DataFrame:
    return diagnose.fate_counts(diagnose.fates(k.truth_edges, k.match, k.links))


@query(_CH + ", x AS (SELECT *, max(is_true) OVER (PARTITION BY dataset, source_id) AS any_true, EXISTS (SELECT 1 FROM te WHERE te.dataset = ch.dataset AND te.source_id = gt_source) AS c, EXISTS (SELECT 1 FROM te WHERE te.dataset = ch.dataset AND te.target_id = gt_target) AS p FROM ch) SELECT dataset, CASE WHEN NOT is_true AND any_true THEN 'EXTRA_CHILD' WHEN NOT is_true AND c AND p THEN 'MISLINK' WHEN gt_source IS NOT NULL AND NOT c THEN 'SOURCE_ENDS' WHEN NOT is_true THEN 'TARGET_ORPHAN' ELSE 'TRUE' END AS charge, count(*) AS n FROM x GROUP BY ALL")
def m11_link_charges(k: Tracks) -> DataFrame:
    return diagnose.charges(_charged(k), k.truth_edges, k.nodes).groupBy("dataset", "charge").agg(F.count(F.lit(1)).alias("n"))


@query(_FT + """, ms AS (SELECT * FROM ft WHERE fate IN ('MISLINK_CONFLICT', 'MISLINK_FREE')), su AS (SELECT dataset, source_id, arg_min(target_id, edge_seq) AS succ FROM pe GROUP BY ALL)
SELECT ms.dataset, ms.source_id, ms.target_id, ms.fate, a.p AS p_true, b.p AS p_chosen, CASE WHEN a.p IS NOT NULL THEN (SELECT count(*) FROM af x WHERE x.dataset = ms.dataset AND x.source_id = ms.pred_source AND x.p > a.p) END AS rank, coalesce(b.p > a.p, false) AS inverted
FROM ms LEFT JOIN af a ON a.dataset = ms.dataset AND a.source_id = ms.pred_source AND a.target_id = ms.pred_target LEFT JOIN su ON su.dataset = ms.dataset AND su.source_id = ms.pred_source LEFT JOIN af b ON b.dataset = ms.dataset AND b.source_id = ms.pred_source AND b.target_id = su.succ""")
def m12_mislink_signal(k: Tracks) -> DataFrame:
    return diagnose.mislink_signal(diagnose.fates(k.truth_edges, k.match, k.links), k.links, k.affinity)


@query(", x AS (SELECT te.dataset, te.source_id, te.target_id, a.pred_id AS s, b.pred_id AS t FROM te LEFT JOIN mt a ON a.dataset = te.dataset AND a.gt_id = te.source_id LEFT JOIN mt b ON b.dataset = te.dataset AND b.gt_id = te.target_id) SELECT dataset, CASE WHEN s IS NULL OR t IS NULL THEN 'unaligned' WHEN EXISTS (SELECT 1 FROM pe WHERE pe.dataset = x.dataset AND pe.source_id = s AND pe.target_id = t) THEN 'redundant' WHEN EXISTS (SELECT 1 FROM pe WHERE pe.dataset = x.dataset AND (pe.target_id = t OR pe.source_id = s)) THEN 'contested' ELSE 'clean' END AS kind, count(*) AS n FROM x GROUP BY ALL")
def m28_edge_transfer(k: Tracks) -> DataFrame:
    return diagnose.transfer_classes(k.truth_edges, k.links, k.match).groupBy("dataset", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(", r AS (SELECT a.dataset, a.node_id, min(sqrt((a.uz - b.uz) * (a.uz - b.uz) + (a.uy - b.uy) * (a.uy - b.uy) + (a.ux - b.ux) * (a.ux - b.ux))) AS d FROM tn a JOIN pn b ON a.dataset = b.dataset AND a.t = b.t GROUP BY ALL), b AS (SELECT tn.dataset, tn.node_id, radius::DOUBLE AS radius, (d IS NULL OR d > 7.0 OR d > radius)::INTEGER AS blind FROM tn LEFT JOIN r USING (dataset, node_id) CROSS JOIN (SELECT unnest([0.5, 2.87, 5.0, 7.0]) AS radius)), n AS (SELECT dataset, radius, sum(blind)::BIGINT AS blind_nodes FROM b GROUP BY ALL), e AS (SELECT te.dataset, s.radius, sum(greatest(s.blind, t.blind))::BIGINT AS dead_edges, count(*) AS n_edges FROM te JOIN b s ON s.dataset = te.dataset AND s.node_id = te.source_id JOIN b t ON t.dataset = te.dataset AND t.node_id = te.target_id AND t.radius = s.radius GROUP BY ALL) SELECT * FROM n JOIN e USING (dataset, radius)")
def m25_edge_loss_by_ruler(k: Tracks) -> DataFrame:
    return diagnose.ruler_loss(k.truth, k.truth_edges, joins.nearest(k.truth, k.nodes, within=RULER), (0.5, 2.87, 5.0, 7.0))


@query(_ACT + ", f AS (SELECT af.*, EXISTS (SELECT 1 FROM tr WHERE tr.dataset = af.dataset AND tr.source_id = af.source_id AND tr.target_id = af.target_id) AS y FROM af), b AS (SELECT *, max(d) FILTER (WHERE y) OVER w AS td, max(-p) FILTER (WHERE y) OVER w AS tp FROM f WINDOW w AS (PARTITION BY dataset, source_id)), x AS (SELECT dataset, source_id, sum((d < td)::INTEGER) AS ad, sum((-p < tp)::INTEGER) AS ap FROM b WHERE td IS NOT NULL GROUP BY ALL) SELECT 'd' AS cue, count(*) AS n, count(*) FILTER (WHERE ad = 0) AS n_first FROM x UNION ALL SELECT 'p', count(*), count(*) FILTER (WHERE ap = 0) FROM x")
def m23_cue_ranks(k: Tracks) -> DataFrame:
    return diagnose.cue_ranks(k.affinity, _truth_pred(k), {"d": True, "p": False})


@query(", x AS (SELECT *, max(p) OVER (PARTITION BY dataset, source_id) AS ms, max(p) OVER (PARTITION BY dataset, target_id) AS mt FROM af) SELECT dataset, source_id, target_id, p FROM x WHERE p >= x.ms AND p >= x.mt")
def m19_mutual_best(k: Tracks) -> DataFrame:
    return diagnose.mutual_best(k.affinity).select("dataset", "source_id", "target_id", "p")


#: Components of predicted links by recursion over each node's single parent: the root is its first ancestor.
_ROOT = ", up AS (SELECT dataset, node_id, node_id AS cur FROM pn UNION ALL SELECT up.dataset, up.node_id, pe.source_id FROM up JOIN pe ON pe.dataset = up.dataset AND pe.target_id = up.cur), ro AS (SELECT dataset, node_id, cur AS root FROM up WHERE NOT EXISTS (SELECT 1 FROM pe WHERE pe.dataset = up.dataset AND pe.target_id = up.cur)), co AS (SELECT dataset, node_id, min(node_id) OVER (PARTITION BY dataset, root) AS component FROM ro)"


@query(_ROOT + " SELECT dataset, node_id, component FROM co")
def g11_components(k: Tracks) -> DataFrame:
    return repair.labelled(k.nodes, k.links)


@query(_ROOT + ", sz AS (SELECT dataset, component, count(*) AS size FROM co GROUP BY ALL) SELECT dataset, component, size FROM sz")
def a7_component_size(k: Tracks) -> DataFrame:
    return repair.labelled(k.nodes, k.links).groupBy("dataset", "component").agg(F.count(F.lit(1)).alias("size"))


_EP = _ROOT + ", ep AS (SELECT pe.*, af.p FROM pe JOIN af USING (dataset, source_id, target_id)), ce AS (SELECT co.dataset, co.component, count(*) AS n_edges, sum(p) / count(*) AS mean_p, sum(ep.d) / count(*) AS mean_d FROM ep JOIN co ON co.dataset = ep.dataset AND co.node_id = ep.source_id GROUP BY ALL), fk AS (SELECT DISTINCT co.dataset, co.component FROM (SELECT dataset, source_id FROM pe GROUP BY ALL HAVING count(*) > 1) f JOIN co ON co.dataset = f.dataset AND co.node_id = f.source_id), cs AS (SELECT co.dataset, co.component, count(*) AS size, min(t) AS t0, max(t) AS t1 FROM co JOIN pn USING (dataset, node_id) GROUP BY ALL)"


def _edges_p(k: Tracks) -> DataFrame:
    return k.links.join(k.affinity.select("dataset", "source_id", "target_id", "p"), ["dataset", "source_id", "target_id"])


@query(_EP + " SELECT dataset, component, size, t0 AS t_first, t1 AS t_last, coalesce(n_edges, 0) AS n_edges, round(mean_p, 6) AS mean_p, round(mean_d, 6) AS mean_d FROM cs LEFT JOIN ce USING (dataset, component)")
def a8_component_summary(k: Tracks) -> DataFrame:
    s = repair.tracks_summary(k.nodes, _edges_p(k), repair.labelled(k.nodes, k.links))
    return s.select("dataset", "component", "size", "t_first", "t_last", "n_edges", r6("mean_p").alias("mean_p"), r6("mean_d").alias("mean_d"))


@query(_EP + " SELECT co.dataset, co.node_id FROM co JOIN cs USING (dataset, component) WHERE size >= 6 OR EXISTS (SELECT 1 FROM fk WHERE fk.dataset = co.dataset AND fk.component = co.component)")
def r2_short_track_filter(k: Tracks) -> DataFrame:
    labels = repair.labelled(k.nodes, k.links)
    return repair.of_components(k.nodes, k.links, labels, repair.short_tracks(k.nodes, k.links, labels))[0].select("dataset", "node_id")


@query(_EP + ", f AS (SELECT cs.dataset, cs.component, row_number() OVER (PARTITION BY cs.dataset ORDER BY mean_p DESC, cs.component DESC) AS r FROM cs JOIN ce USING (dataset, component) WHERE size < 6 AND size <= 5 AND mean_p >= 0.2 AND mean_d <= 6.0 AND NOT EXISTS (SELECT 1 FROM fk WHERE fk.dataset = cs.dataset AND fk.component = cs.component)), n AS (SELECT dataset, least(floor(count(*) * 0.006::DOUBLE), 60) AS b FROM pn GROUP BY dataset) SELECT cs.dataset, cs.component FROM cs WHERE size >= 6 OR EXISTS (SELECT 1 FROM fk WHERE fk.dataset = cs.dataset AND fk.component = cs.component) OR EXISTS (SELECT 1 FROM f JOIN n USING (dataset) WHERE f.dataset = cs.dataset AND f.component = cs.component AND f.r <= n.b)")
def r3_short_track_rescue(k: Tracks) -> DataFrame:
    labels = repair.labelled(k.nodes, k.links)
    return repair.short_tracks(k.nodes, _edges_p(k), labels, rescue=True, rescue_p=0.2, rescue_d=6.0)


@query(_TWO + ", e AS (SELECT pb.dataset, pb.source_id, pb.target_id, ca.d FROM pb JOIN ca USING (dataset, source_id, target_id) WHERE d <= 5.0), r AS (SELECT *, row_number() OVER (PARTITION BY dataset, target_id ORDER BY d, target_id * 100000000 + source_id) AS k FROM e) SELECT dataset, source_id, target_id, d FROM r WHERE k = 1")
def r1_topology_repair(k: Tracks) -> DataFrame:
    edges = _second(k).withColumn("edge_seq", F.col("target_id") * 100_000_000 + F.col("source_id"))
    return repair.topology_repair(k.nodes, edges, 5.0)[1].select("dataset", "source_id", "target_id", "d")


@query(_ROOT + ", s AS (SELECT dataset, component, count(*) AS size FROM co GROUP BY ALL) SELECT cut, sum(CASE WHEN size < cut THEN 0 ELSE 0 END)::BIGINT AS false_nodes, coalesce(sum(size) FILTER (WHERE size < cut), 0)::BIGINT AS true_nodes FROM s CROSS JOIN (SELECT unnest([2, 3, 5, 8, 12])::INTEGER AS cut) GROUP BY cut")
def m21_component_prune_price(k: Tracks) -> DataFrame:
    return diagnose.component_prune_price(repair.labelled(k.nodes, k.links), k.match, (2, 3, 5, 8, 12))


@query(", x AS (SELECT *, CASE WHEN d <= 5.0 THEN p ELSE 0.0 END AS q FROM af), y AS (SELECT *, sum(q) OVER (PARTITION BY dataset, t, target_id) AS m FROM x) SELECT dataset, source_id, target_id, round(CASE WHEN m > 0 THEN q / m ELSE p END, 6) AS p FROM y")
def l4_admissible_affinity(k: Tracks) -> DataFrame:
    return costs.admissible(k.affinity, "p", 5.0).select("dataset", "source_id", "target_id", r6("p").alias("p"))


@query(", x AS (SELECT *, avg(d) FILTER (WHERE d <= 7.0) OVER (PARTITION BY dataset, t) AS m FROM af) SELECT dataset, source_id, target_id, round(d - 20.0::DOUBLE * (CASE WHEN m > 0 THEN greatest(0.0::DOUBLE, 1 + 0.5::DOUBLE * (d / m - 1)) ELSE 1.0 END) * p, 6) AS cost FROM x")
def l3_evidence_ramp_cost(k: Tracks) -> DataFrame:
    priced = costs.bonus_cost(costs.evidence_ramp(k.affinity, 7.0, 0.5), 20.0, "weight")
    return priced.select("dataset", "source_id", "target_id", r6("cost").alias("cost"))


@query(", m AS (SELECT dataset, t, source_id, target_id, p FROM af WHERE t % 2 = 0 AND p >= 0.1) SELECT dataset, source_id, target_id FROM af WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.dataset = af.dataset AND m.t = af.t) OR EXISTS (SELECT 1 FROM m WHERE m.dataset = af.dataset AND m.source_id = af.source_id AND m.target_id = af.target_id AND m.p >= 0.3)")
def l1_agreement_gate(k: Tracks) -> DataFrame:
    mutual = k.affinity.filter("t % 2 = 0 and p >= 0.1")
    return costs.agreement_gate(k.affinity, mutual, 0.3).select("dataset", "source_id", "target_id")


@query(", b AS (SELECT dataset, min(t) AS t0, max(t) AS t1, min(uz) AS z0, max(uz) AS z1, min(uy) AS y0, max(uy) AS y1, min(ux) AS x0, max(ux) AS x1 FROM pn GROUP BY dataset) SELECT pn.dataset, node_id, CASE WHEN least(uz - z0, z1 - uz) <= 3.0 OR least(uy - y0, y1 - uy) <= 3.0 OR least(ux - x0, x1 - ux) <= 3.0 OR t = t0 OR t = t1 THEN 0 ELSE 1 END AS factor FROM pn JOIN b USING (dataset)")
def l5_boundary_prior(k: Tracks) -> DataFrame:
    return costs.boundary_factor(k.nodes, 3.0).select("dataset", "node_id", "factor")


@query(", m AS (SELECT pn.dataset, pn.node_id, pn.t, coalesce(sum(p), 0.0::DOUBLE) AS m FROM pn LEFT JOIN af ON af.dataset = pn.dataset AND af.target_id = pn.node_id GROUP BY ALL), a AS (SELECT *, avg(m) OVER (PARTITION BY dataset, t) AS a, min(t) OVER (PARTITION BY dataset) AS t0 FROM m) SELECT dataset, node_id, round(CASE WHEN a > 0 AND t > t0 THEN m / a ELSE 1.0 END, 6) AS factor FROM a")
def l6_evidence_prior(k: Tracks) -> DataFrame:
    return costs.evidence_factor(k.nodes, k.affinity).select("dataset", "node_id", r6("factor").alias("factor"))


@query(" SELECT af.dataset, target_id AS node_id, round(0.5 * sum(p * (b.uz - a.uz)) / sum(p), 6) AS vz, round(0.5 * sum(p * (b.uy - a.uy)) / sum(p), 6) AS vy, round(0.5 * sum(p * (b.ux - a.ux)) / sum(p), 6) AS vx FROM af JOIN pn a ON a.dataset = af.dataset AND a.node_id = af.source_id JOIN pn b ON b.dataset = af.dataset AND b.node_id = af.target_id GROUP BY ALL")
def l7_expected_incoming_step(k: Tracks) -> DataFrame:
    return costs.expected_step(k.nodes, k.affinity).select("dataset", "node_id", *[r6(f"v{a}").alias(f"v{a}") for a in "zyx"])


@query(" SELECT dataset, source_id, target_id, round(-(ln(greatest(p, 1e-12)) - d * d / (2 * 3.0 * 3.0)), 6) AS cost FROM af")
def l8_product_of_experts(k: Tracks) -> DataFrame:
    return costs.expert_cost(k.affinity, 3.0).select("dataset", "source_id", "target_id", r6("cost").alias("cost"))


_SEED = ", sd AS (SELECT dataset, t, source_id, target_id, 1 AS seed, -d / 2 AS logit FROM ca UNION ALL SELECT dataset, t, source_id, target_id, 2, -d / 3 + (source_id % 3) / 10 FROM ca)"


def _seeds(k: Tracks) -> DataFrame:
    c = k.candidates.select("dataset", "t", "source_id", "target_id", "d")
    one = c.withColumn("seed", F.lit(1)).withColumn("logit", -F.col("d") / 2)
    two = c.withColumn("seed", F.lit(2)).withColumn("logit", -F.col("d") / 3 + (F.col("source_id") % 3) / 10)
    return one.unionByName(two)


@query(_SEED + ", b AS (SELECT dataset, t, source_id, target_id, sum(CASE seed WHEN 1 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END * logit) AS l FROM sd GROUP BY ALL), e AS (SELECT *, exp(l - max(l) OVER w) AS e FROM b WINDOW w AS (PARTITION BY dataset, t, target_id)) SELECT dataset, source_id, target_id, round(l, 6) AS logit, round(e / sum(e) OVER (PARTITION BY dataset, t, target_id), 6) AS p FROM e")
def e1_seed_blend(k: Tracks) -> DataFrame:
    return costs.blended(_seeds(k), {1: 0.6, 2: 0.4}).select("dataset", "source_id", "target_id", r6("logit").alias("logit"), r6("p").alias("p"))


@query(", l AS (SELECT *, -d / 2 AS l FROM ca), e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY dataset, t, target_id)) AS f, exp(l - max(l) OVER (PARTITION BY dataset, t, source_id)) AS r FROM l), n AS (SELECT *, f / sum(f) OVER (PARTITION BY dataset, t, target_id) AS fw, r / sum(r) OVER (PARTITION BY dataset, t, source_id) AS rv FROM e) SELECT dataset, source_id, target_id, round(fw, 6) AS forward, round(rv, 6) AS reverse, round(fw * rv / greatest(0.7 * rv + 0.3 * fw, 1e-12), 6) AS fused FROM n")
def e2_bidirectional_fuse(k: Tracks) -> DataFrame:
    b = costs.bidirectional(k.candidates.withColumn("logit", -F.col("d") / 2), 0.3)
    return b.select("dataset", "source_id", "target_id", *[r6(c).alias(c) for c in ("forward", "reverse", "fused")])


_VIEW = _SEED + ", vx AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY seed, dataset, t, target_id)) AS e FROM sd), vw AS (SELECT *, e / sum(e) OVER (PARTITION BY seed, dataset, t, target_id) AS p FROM vx)"


def _views(k: Tracks) -> DataFrame:
    w = W.partitionBy("seed", "dataset", "t", "target_id")
    return _seeds(k).withColumn("p", costs.softmax(F.col("logit"), w)).withColumnRenamed("seed", "view")


@query(_VIEW + ", m AS (SELECT *, avg(p) OVER (PARTITION BY dataset, t, target_id, source_id) AS a FROM vw), j AS (SELECT seed, dataset, t, target_id, sum(CASE WHEN p > 0 THEN p * ln(p / ((p + a) / 2)) ELSE 0 END / 2 + CASE WHEN a > 0 THEN a * ln(a / ((p + a) / 2)) ELSE 0 END / 2) AS js FROM m GROUP BY ALL), md AS (SELECT dataset, t, target_id, min(js) AS md FROM j GROUP BY ALL), w AS (SELECT j.*, CASE WHEN md > 0 THEN 1 / (1 + js / md) ELSE 1.0 END AS w FROM j JOIN md USING (dataset, t, target_id)), q AS (SELECT vw.dataset, vw.t, vw.target_id, vw.source_id, sum(w * ln(greatest(p, 1e-12))) / sum(w) AS l FROM vw JOIN w USING (seed, dataset, t, target_id) GROUP BY ALL), e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY dataset, t, target_id)) AS e FROM q) SELECT dataset, source_id, target_id, round(e / sum(e) OVER (PARTITION BY dataset, t, target_id), 4) AS p FROM e")
def e3_js_log_pool(k: Tracks) -> DataFrame:
    return costs.js_pool(_views(k)).select("dataset", "source_id", "target_id", F.round("p", 4).alias("p"))


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY dataset, t, target_id ORDER BY p DESC, source_id) AS k FROM af) SELECT dataset, target_id, max(source_id) FILTER (WHERE k = 1) AS best_source, count(*) AS n_sources, coalesce(max(p) FILTER (WHERE k = 1) - max(p) FILTER (WHERE k = 2), 1.0) AS margin FROM r GROUP BY dataset, t, target_id")
def w15_top_two_margin(k: Tracks) -> DataFrame:
    return costs.margins(k.affinity).select("dataset", "target_id", "best_source", "n_sources", "margin")


@query(_VIEW + """, a AS (SELECT * FROM vw WHERE seed = 1), b AS (SELECT * FROM vw WHERE seed = 2),
ra AS (SELECT *, row_number() OVER (PARTITION BY dataset, t, target_id ORDER BY p DESC, source_id) AS k FROM a), rb AS (SELECT *, row_number() OVER (PARTITION BY dataset, t, target_id ORDER BY p DESC, source_id) AS k FROM b),
ma AS (SELECT dataset, t, target_id, max(source_id) FILTER (WHERE k = 1) AS s, coalesce(max(p) FILTER (WHERE k = 1) - max(p) FILTER (WHERE k = 2), 1.0) AS m FROM ra GROUP BY ALL), mb AS (SELECT dataset, t, target_id, max(source_id) FILTER (WHERE k = 1) AS s FROM rb GROUP BY ALL),
f AS (SELECT a.dataset, a.t, a.source_id, a.target_id, a.p, CASE WHEN ma.m < 0.35 AND ma.s = mb.s THEN 0.85 * a.p + 0.15 * b.p ELSE a.p END AS f FROM a JOIN b USING (dataset, t, source_id, target_id) JOIN ma USING (dataset, t, target_id) JOIN mb USING (dataset, t, target_id)),
g AS (SELECT *, sum((p >= 0.48)::INTEGER) OVER (PARTITION BY dataset, t) AS n, sum((f >= 0.48)::INTEGER) OVER (PARTITION BY dataset, t) AS m FROM f) SELECT dataset, source_id, target_id, round(CASE WHEN m >= 0.9 * n THEN f ELSE p END, 6) AS p FROM g""")
def e4_calibrated_fusion(k: Tracks) -> DataFrame:
    v = _views(k)
    out = costs.calibrated(v.filter("view = 1").drop("view"), v.filter("view = 2").drop("view"))
    return out.select("dataset", "source_id", "target_id", r6("p").alias("p"))


@query(_SEED + " SELECT dataset, seed, count(*) AS n, round(avg(logit), 6) AS mean, round(stddev_pop(logit), 6) AS std FROM sd GROUP BY ALL")
def e5_seed_moments(k: Tracks) -> DataFrame:
    return _seeds(k).groupBy("dataset", "seed").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("logit")).alias("mean"), r6(F.stddev_pop("logit")).alias("std"))


@query(_SEED + ", x AS (SELECT a.dataset, a.t, a.source_id, a.target_id, a.logit, b.logit AS ref FROM sd a JOIN sd b USING (dataset, t, source_id, target_id) WHERE a.seed = 2 AND b.seed = 1), m AS (SELECT *, avg(logit) OVER w AS ml, avg(ref) OVER w AS mr, stddev_pop(logit) OVER w AS sl, stddev_pop(ref) OVER w AS sr FROM x WINDOW w AS (PARTITION BY dataset, t)) SELECT dataset, source_id, target_id, CASE WHEN v = 0 THEN 0.0::DOUBLE ELSE v END AS aligned FROM (SELECT *, round((logit - ml) * least(greatest(sr / greatest(sl, 1e-4), 0.5), 2.0) + mr, 6) AS v FROM m)")
def w14_moment_alignment(k: Tracks) -> DataFrame:
    s = _seeds(k)
    keys = ["dataset", "t", "source_id", "target_id"]
    x = s.filter("seed = 2").select(*keys, "logit").join(s.filter("seed = 1").select(*keys, F.col("logit").alias("ref")), keys)
    v = x.select("dataset", "source_id", "target_id", r6(costs.moment_aligned(x, "logit", "ref", W.partitionBy("dataset", "t"))).alias("_v"))
    return v.select("dataset", "source_id", "target_id", F.when(F.col("_v") == 0, F.lit(0.0)).otherwise(F.col("_v")).alias("aligned"))  # no negative zero


#: Chains of the truth as table expressions: single links, the chain named by its least id.
_CHN = """, od AS (SELECT dataset, source_id, count(*) AS n FROM te GROUP BY ALL), si AS (SELECT te.* FROM te JOIN od USING (dataset, source_id) JOIN tn a ON a.dataset = te.dataset AND a.node_id = te.source_id JOIN tn b ON b.dataset = te.dataset AND b.node_id = te.target_id WHERE n = 1 AND b.t - a.t = 1),
sr AS (SELECT dataset, source_id AS node_id, source_id AS root FROM si WHERE NOT EXISTS (SELECT 1 FROM si x WHERE x.dataset = si.dataset AND x.target_id = si.source_id) UNION ALL SELECT si.dataset, si.target_id, sr.root FROM sr JOIN si ON si.dataset = sr.dataset AND si.source_id = sr.node_id),
cn AS (SELECT sr.dataset, min(sr.node_id) OVER (PARTITION BY sr.dataset, root) AS chain_id, row_number() OVER (PARTITION BY sr.dataset, root ORDER BY t) - 1 AS pos, sr.node_id, t, uz, uy, ux FROM sr JOIN tn ON tn.dataset = sr.dataset AND tn.node_id = sr.node_id),
sp AS (SELECT *, sqrt(vz * vz + vy * vy + vx * vx) AS step FROM (SELECT *, lead(uz) OVER w - uz AS vz, lead(uy) OVER w - uy AS vy, lead(ux) OVER w - ux AS vx FROM cn WINDOW w AS (PARTITION BY dataset, chain_id ORDER BY pos)) WHERE vz IS NOT NULL)"""


def _chains(k: Tracks) -> DataFrame:
    return motion.chains(k.truth, k.truth_edges)


@query(_CHN + " SELECT dataset, chain_id, pos::BIGINT AS pos, node_id, t FROM cn")
def g12_chains(k: Tracks) -> DataFrame:
    return _chains(k).select("dataset", "chain_id", F.col("pos").cast("long").alias("pos"), "node_id", "t")


@query(_CHN + " SELECT dataset, count(*) AS n, round(quantile_cont(step, 0.25), 6) AS p25, round(median(step), 6) AS p50, round(quantile_cont(step, 0.75), 6) AS p75, round(avg((step < 2.369)::INTEGER), 6) AS stationary FROM sp GROUP BY dataset")
def q1_step_statistics(k: Tracks) -> DataFrame:
    q = F.percentile("step", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = motion.steps(_chains(k)).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), q.alias("q"), r6(F.avg((F.col("step") < 2.369).cast("int"))).alias("stationary"))
    return s.select("dataset", "n", *[r6(F.col("q")[i]).alias(c) for i, c in enumerate(("p25", "p50", "p75"))], "stationary")


@query(_CHN + ", tu AS (SELECT *, lead(vz) OVER w AS nz, lead(vy) OVER w AS ny, lead(vx) OVER w AS nx FROM sp WINDOW w AS (PARTITION BY dataset, chain_id ORDER BY pos)), c AS (SELECT dataset, step, (vz * nz + vy * ny + vx * nx) / (sqrt(vz * vz + vy * vy + vx * vx) * sqrt(nz * nz + ny * ny + nx * nx)) AS c FROM tu WHERE nz IS NOT NULL AND vz * vz + vy * vy + vx * vx > 0 AND nz * nz + ny * ny + nx * nx > 0) SELECT CASE WHEN step >= 5.0 THEN 2 WHEN step >= 2.0 THEN 1 ELSE 0 END AS band, count(*) AS n, round(avg(c), 6) AS mean_cosine FROM c GROUP BY ALL")
def q2_turn_persistence(k: Tracks) -> DataFrame:
    t = motion.turns(motion.steps(_chains(k))).withColumn("band", motion.banded(F.col("step"), (2.0, 5.0)))
    return t.groupBy("band").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("cosine")).alias("mean_cosine"))


@query(_CHN + " SELECT k AS lag, count(*) AS n, round(avg((b.uz - a.uz) * (b.uz - a.uz) + (b.uy - a.uy) * (b.uy - a.uy) + (b.ux - a.ux) * (b.ux - a.ux)), 6) AS msd FROM (SELECT unnest(range(1, 6))::INTEGER AS k) JOIN cn a ON true JOIN cn b ON a.dataset = b.dataset AND a.chain_id = b.chain_id AND b.pos = a.pos + k GROUP BY k")
def q3_mean_squared_displacement(k: Tracks) -> DataFrame:
    return motion.msd(_chains(k), 5).select("lag", "n", r6("msd").alias("msd"))


@query(_CHN + ", m AS (SELECT k, avg((b.uz - a.uz) * (b.uz - a.uz) + (b.uy - a.uy) * (b.uy - a.uy) + (b.ux - a.ux) * (b.ux - a.ux)) AS msd FROM (SELECT unnest(range(2, 7)) AS k) JOIN cn a ON true JOIN cn b ON a.dataset = b.dataset AND a.chain_id = b.chain_id AND b.pos = a.pos + k GROUP BY k) SELECT count(*) AS n_lags, round(regr_slope(ln(msd), ln(k)), 6) AS exponent FROM m")
def a14_msd_exponent(k: Tracks) -> DataFrame:
    return motion.msd_exponent(motion.msd(_chains(k), 6)).select("n_lags", r6("exponent").alias("exponent"))


@query(_CHN + " SELECT dataset, t, count(*) AS n, round(sqrt(avg(vz) * avg(vz) + avg(vy) * avg(vy) + avg(vx) * avg(vx)) / avg(step), 6) AS share FROM sp GROUP BY ALL HAVING count(*) >= 3")
def q5_frame_drift_share(k: Tracks) -> DataFrame:
    return motion.drift_share(motion.steps(_chains(k))).select("dataset", "t", "n", r6("share").alias("share"))


@query(_CHN + ", m AS (SELECT dataset, t, avg(vz) AS mz, avg(vy) AS my, avg(vx) AS mx FROM sp GROUP BY ALL), f AS (SELECT c.dataset, c.t, coalesce(mz, 0) AS mz, coalesce(my, 0) AS my, coalesce(mx, 0) AS mx FROM (SELECT DISTINCT dataset, t FROM cn) c LEFT JOIN m USING (dataset, t)), o AS (SELECT dataset, t, coalesce(sum(mz) OVER w, 0) AS oz, coalesce(sum(my) OVER w, 0) AS oy, coalesce(sum(mx) OVER w, 0) AS ox FROM f WINDOW w AS (PARTITION BY dataset ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT dataset, node_id, round(uz - oz, 5) AS uz, round(uy - oy, 5) AS uy, round(ux - ox, 5) AS ux FROM cn JOIN o USING (dataset, t)")
def a30_comoving_frame(k: Tracks) -> DataFrame:
    c = _chains(k)
    return motion.comoving(c, motion.steps(c)).select("dataset", "node_id", *[F.round(a, 5).alias(a) for a in _XYZ])


_DISP = ", dv AS (SELECT ca.dataset, ca.t, floor((b.uz - a.uz) / 0.8125 + 0.5)::INTEGER AS bz, floor((b.uy - a.uy) / 0.8125 + 0.5)::INTEGER AS bj, floor((b.ux - a.ux) / 0.8125 + 0.5)::INTEGER AS bx FROM ca JOIN pn a ON a.dataset = ca.dataset AND a.node_id = ca.source_id JOIN pn b ON b.dataset = ca.dataset AND b.node_id = ca.target_id)"


@query(_DISP + ", v AS (SELECT dataset, t, bz, bj, bx, count(*) AS n FROM dv GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY dataset, t ORDER BY n DESC, bz, bj, bx) AS k, sum(n) OVER (PARTITION BY dataset, t) AS total FROM v) SELECT dataset, t, bz * 0.8125::DOUBLE AS vz, bj * 0.8125::DOUBLE AS vy, bx * 0.8125::DOUBLE AS vx, n / total AS sharpness FROM r WHERE k = 1")
def q6_drift_field_peak(k: Tracks) -> DataFrame:
    at = k.nodes.select("dataset", "node_id", *_XYZ)
    j = k.candidates.join(at.withColumnsRenamed({"node_id": "source_id"} | {c: f"a_{c}" for c in _XYZ}), ["dataset", "source_id"]).join(at.withColumnsRenamed({"node_id": "target_id"} | {c: f"b_{c}" for c in _XYZ}), ["dataset", "target_id"])
    pairs = j.select("dataset", "t", *[(F.col(f"b_u{a}") - F.col(f"a_u{a}")).alias(f"d{a}") for a in "zyx"])
    return motion.drift_peak(motion.displacement_votes(pairs, 0.8125), 0.8125)


@query(_CHN + ", w AS (SELECT dataset, chain_id, pos, step, lead(step, 1) OVER x AS s1, lead(step, 2) OVER x AS s2 FROM sp WINDOW x AS (PARTITION BY dataset, chain_id ORDER BY pos)) SELECT dataset, chain_id, pos::BIGINT AS pos FROM w WHERE abs(step - 2.0) <= 1.5 AND abs(s1 - 2.0) <= 1.5 AND abs(s2 - 2.5) <= 1.5")
def j17_subsequence_match(k: Tracks) -> DataFrame:
    s = motion.steps(_chains(k))
    return joins.windows_matching([2.0, 2.0, 2.5], s, 1.5).select("dataset", "chain_id", F.col("pos").cast("long").alias("pos"))


@query(", a AS (SELECT dataset, t, list(node_id ORDER BY node_id) AS ids FROM tn GROUP BY ALL), i AS (SELECT dataset, node_id, t, row_number() OVER (PARTITION BY dataset, t ORDER BY node_id) - 1 AS i FROM tn), l AS (SELECT te.dataset, x.t, count(*) AS n, sum(x.i * 1000 + y.i)::BIGINT AS code FROM te JOIN i x ON x.dataset = te.dataset AND x.node_id = te.source_id JOIN i y ON y.dataset = te.dataset AND y.node_id = te.target_id WHERE y.t = x.t + 1 GROUP BY ALL) SELECT a.dataset, a.t, len(a.ids)::INTEGER AS n_source, len(b.ids)::INTEGER AS n_target, coalesce(n, 0)::INTEGER AS n_links, coalesce(code, 0) AS code FROM a JOIN a b ON b.dataset = a.dataset AND b.t = a.t + 1 LEFT JOIN l ON l.dataset = a.dataset AND l.t = a.t")
def n1_truth_pairs(k: Tracks) -> DataFrame:
    p = sampling.truth_pairs(k.truth, k.truth_edges)
    code = F.aggregate("links", F.lit(0).cast("long"), lambda acc, x: acc + x["i"] * 1000 + x["j"])
    return p.select("dataset", "t", F.size("source").alias("n_source"), F.size("target").alias("n_target"), F.size("links").alias("n_links"), code.alias("code"))


@query(_ACT + ", o AS (SELECT dataset, source_id, any_value(target_id) AS tr FROM tr GROUP BY ALL HAVING count(*) = 1) SELECT ca.dataset, ca.source_id, ca.target_id, dense_rank() OVER (PARTITION BY ca.dataset, ca.t ORDER BY ca.target_id) - 1 AS col, ca.target_id = o.tr AS is_true FROM ca JOIN o USING (dataset, source_id)")
def n2_detected_pairs(k: Tracks) -> DataFrame:
    return sampling.detected_pairs(k.candidates, _truth_pred(k)).select("dataset", "source_id", "target_id", F.col("col").cast("long").alias("col"), "is_true")


@query(", f AS (SELECT dataset, t, count(*) AS n FROM tn GROUP BY ALL), w AS (SELECT dataset, t, count(*) OVER x AS k, sum(n) OVER x AS n_points FROM f WINDOW x AS (PARTITION BY dataset ORDER BY t RANGE BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT dataset, t, n_points::BIGINT AS n_points FROM w WHERE k = 4")
def n5_complete_windows(k: Tracks) -> DataFrame:
    return sampling.windows_of_frames(k.truth, 4)


@query(", f AS (SELECT dataset, t, count(*) AS n FROM tn GROUP BY ALL) SELECT dataset, t, round(0.5 * n / sum(n) OVER (PARTITION BY dataset) + 0.5 / count(*) OVER (PARTITION BY dataset), 6) AS weight FROM f")
def n8_difficulty_weights(k: Tracks) -> DataFrame:
    f = k.truth.groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n"))
    return sampling.difficulty_weights(f, "n").select("dataset", "t", r6("weight").alias("weight"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) ORDER BY k, source LIMIT 50", base=False)
def n10_round_robin(k: Tracks) -> DataFrame:
    return sampling.round_robin(k.table("documents").select("source", "doc_id"), "source", "doc_id", 50)


@query(", x AS (SELECT dataset, t, node_id, (row_number() OVER (PARTITION BY dataset ORDER BY t, node_id) - 1) % 3 AS shard FROM pn) SELECT dataset, shard::INTEGER AS shard, count(*) AS n, min(node_id) AS first FROM x GROUP BY ALL")
def n15_round_robin_shards(k: Tracks) -> DataFrame:
    d = sampling.dealt(k.nodes.withColumn("_o", F.struct("t", "node_id")), "_o", 3, "dataset")
    return d.groupBy("dataset", F.col("shard").cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first"))
