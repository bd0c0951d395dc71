"""Audits of links, grids of settings, and stored candidates over the track tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelace.operators import audits, diagnose, joins, repair, sampling, scoring
from tracelace.plans.q_scores import _ACT, _CHN, _FT, _ROOT, _chains, _seeds, _truth_pred
from tracelace.plans.registry import query, r6
from tracelace.sources.tracks import GATE, Tracks
from tracelace.storage import written

_Y = _ACT + ", y AS (SELECT af.*, EXISTS (SELECT 1 FROM tr WHERE tr.dataset = af.dataset AND tr.source_id = af.source_id AND tr.target_id = af.target_id) AS y FROM af)"
_RECALLS, _COLLATERALS = (0.25, 0.5, 0.75, 0.9, 0.99), (0.0, 0.02, 0.05)
_GRID = [(r, c) for r in _RECALLS for c in _COLLATERALS]
_CELLS = ", ".join(f"({i}, {r}::DOUBLE, {c}::DOUBLE)" for i, (r, c) in enumerate(_GRID))


def _some(k: Tracks) -> DataFrame:
    """Matches of two thirds of the truth, as sparse annotation has them."""
    return k.match.filter(F.col("gt_id") % 3 != 0)


@query(_Y + ", tt AS (SELECT * FROM y WHERE y QUALIFY row_number() OVER (PARTITION BY dataset, source_id ORDER BY d, target_id) = 1), rv AS (SELECT * FROM y WHERE NOT y QUALIFY row_number() OVER (PARTITION BY dataset, source_id ORDER BY d, target_id) = 1) SELECT tt.dataset, tt.source_id, tt.target_id AS true_id, rv.target_id AS rival_id, round(tt.d, 6) AS d_true, round(rv.d, 6) AS d_rival, EXISTS (SELECT 1 FROM pe WHERE pe.dataset = tt.dataset AND pe.source_id = tt.source_id AND pe.target_id = rv.target_id) AND NOT EXISTS (SELECT 1 FROM pe WHERE pe.dataset = tt.dataset AND pe.source_id = tt.source_id AND pe.target_id = tt.target_id) AS mislinked FROM tt JOIN rv USING (dataset, source_id)")
def q9_candidate_triples(k: Tracks) -> DataFrame:
    out = audits.candidate_triples(k.candidates, _truth_pred(k), k.links)
    return out.withColumn("d_true", r6("d_true")).withColumn("d_rival", r6("d_rival"))


@query(_ROOT + _FT + ", sz AS (SELECT dataset, node_id, count(*) OVER (PARTITION BY dataset, component) AS size FROM co), th AS (SELECT dataset, target_id, min(source_id) AS thief FROM pe GROUP BY ALL) SELECT ft.dataset, ft.source_id, ft.target_id, thief, size FROM ft JOIN th ON th.dataset = ft.dataset AND th.target_id = ft.pred_target LEFT JOIN sz ON sz.dataset = ft.dataset AND sz.node_id = thief WHERE fate = 'MISLINK_CONFLICT'")
def m15_thieves(k: Tracks) -> DataFrame:
    return audits.thieves(diagnose.fates(k.truth_edges, k.match, k.links), k.links, repair.labelled(k.nodes, k.links))


@query(_FT + ", dv AS (SELECT *, count(*) OVER w AS n, count(pred_target) OVER w AS m FROM ft WINDOW w AS (PARTITION BY dataset, source_id)) SELECT dv.dataset, pred_source AS parent, pred_target AS daughter, (SELECT arg_min(source_id, edge_seq) FROM pe WHERE pe.dataset = dv.dataset AND pe.target_id = dv.pred_target) AS claimed_by FROM dv WHERE n >= 2 AND m = n AND pred_source IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pe WHERE pe.dataset = dv.dataset AND pe.source_id = pred_source AND pe.target_id = pred_target)")
def m18_reparent_plan(k: Tracks) -> DataFrame:
    return audits.reparent_plan(k.truth_edges, k.match, k.links)


@query(", sm AS (SELECT * FROM mt WHERE gt_id % 3 <> 0), fk AS (SELECT pe.dataset, pe.source_id, pe.target_id, edge_seq, p, pe.target_id IN (SELECT pred_id FROM sm) AS m, EXISTS (SELECT 1 FROM sm JOIN te ON te.dataset = sm.dataset AND te.source_id = sm.gt_id WHERE sm.dataset = pe.dataset AND sm.pred_id = pe.source_id GROUP BY sm.gt_id HAVING count(DISTINCT te.target_id) >= 2) AS whole, count(*) OVER (PARTITION BY pe.dataset, pe.source_id) AS n FROM pe JOIN af USING (dataset, source_id, target_id)), r AS (SELECT *, row_number() OVER (PARTITION BY dataset, source_id ORDER BY p + CASE WHEN m THEN 1000 ELSE 0 END DESC, edge_seq, target_id) AS o, row_number() OVER (PARTITION BY dataset, source_id ORDER BY p DESC, edge_seq, target_id) AS b FROM fk WHERE n >= 2) SELECT 'oracle' AS arm, dataset, source_id AS parent, target_id AS dropped_id FROM r WHERE o > 1 AND NOT whole UNION ALL SELECT 'blind', dataset, source_id, target_id FROM r WHERE b > 1")
def m18_fork_cull(k: Tracks) -> DataFrame:
    arm = lambda blind: audits.fork_cull(k.links, _some(k), k.truth_edges, k.affinity, blind).withColumn("arm", F.lit("blind" if blind else "oracle"))
    return arm(False).unionByName(arm(True))


@query(_Y + f", ce AS (SELECT * FROM (VALUES {_CELLS}) v(cell, recall, collateral)), al AS (SELECT pn.dataset, pn.node_id, cell, recall, collateral, ((pn.node_id * 48271 + cell * 40692) % 999983) / 999983.0::DOUBLE >= CASE WHEN (pn.node_id - 10000000) % 3 <> 0 THEN collateral ELSE recall END AS a FROM pn CROSS JOIN ce), bo AS (SELECT y.*, s.cell, s.recall, s.collateral, s.a AND t.a AS live FROM y JOIN al s ON s.dataset = y.dataset AND s.node_id = y.source_id JOIN al t ON t.dataset = y.dataset AND t.node_id = y.target_id AND t.cell = s.cell), be AS (SELECT *, max(p) FILTER (WHERE live) OVER (PARTITION BY dataset, cell, source_id) AS bs, max(p) FILTER (WHERE live) OVER (PARTITION BY dataset, cell, target_id) AS bt FROM bo) SELECT recall, collateral, count(*) FILTER (WHERE live AND p >= bs AND p >= bt) AS kept, count(*) FILTER (WHERE NOT live) AS destroyed, count(*) AS total FROM be WHERE y GROUP BY ALL")
def m20_prune_price(k: Tracks) -> DataFrame:
    return audits.prune_grid(k.affinity, _truth_pred(k), k.nodes, _some(k).withColumnRenamed("pred_id", "node_id"), _GRID)


@query(_Y + ", ga AS (SELECT y.*, gate FROM y CROSS JOIN (SELECT unnest([4.0, 7.0, 10.0])::DOUBLE AS gate) WHERE d <= gate), b AS (SELECT * FROM ga QUALIFY row_number() OVER (PARTITION BY dataset, gate, target_id ORDER BY p DESC, source_id) = 1) SELECT dataset, threshold, gate, count(*) FILTER (WHERE p >= threshold AND y) AS tp, count(*) FILTER (WHERE p >= threshold AND NOT y) AS fp FROM b CROSS JOIN (SELECT unnest([0.0, 0.2, 0.4, 0.6])::DOUBLE AS threshold) GROUP BY ALL")
def m32_operating_points(k: Tracks) -> DataFrame:
    return audits.operating_points(k.affinity, _truth_pred(k), (0.0, 0.2, 0.4, 0.6), (4.0, 7.0, 10.0))


@query(_CHN + ", n AS (SELECT dataset, chain_id, count(*) AS n_nodes FROM cn GROUP BY ALL) SELECT dataset, chain_id, n_nodes FROM n QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n_nodes DESC, chain_id) = 1")
def g20_longest_chain(k: Tracks) -> DataFrame:
    return audits.longest_chain(_chains(k))


@query(", f AS (SELECT dataset, t, count(*) AS n FROM pn GROUP BY ALL), b AS (SELECT dataset, t, CASE WHEN coalesce(n > max(n) OVER (PARTITION BY dataset ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b FROM f) SELECT dataset, count(*)::INTEGER AS windows, round(list_reduce(list_prepend(1.0::DOUBLE, list(b ORDER BY t)), lambda s, x: 0.9::DOUBLE * s + 0.1::DOUBLE * x), 6) AS difficulty FROM b GROUP BY dataset")
def n9_paced_difficulty(k: Tracks) -> DataFrame:
    per_frame = k.nodes.groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n"))
    return audits.paced_difficulty(per_frame, "t", "n").withColumn("difficulty", r6("difficulty"))


@query(_Y + ", tl AS (SELECT dataset, source_id, min(-d) AS l FROM y WHERE y GROUP BY ALL), dc AS (SELECT y.dataset, y.source_id, -y.d AS l FROM y JOIN (SELECT DISTINCT dataset, source_id FROM tr) USING (dataset, source_id) WHERE NOT y QUALIFY row_number() OVER (PARTITION BY y.dataset, y.source_id ORDER BY y.d, y.target_id) <= 3) SELECT dataset, count(*) AS n, round(avg(ln(1 + exp(least(dc.l - tl.l, 50.0::DOUBLE)))), 6) AS loss FROM dc JOIN tl USING (dataset, source_id) GROUP BY dataset")
def loss_decoy_margin(k: Tracks) -> DataFrame:
    decoys = sampling.hard_negatives(k.candidates, _truth_pred(k), 3)
    return audits.decoy_margin(k.candidates.withColumn("logit", -F.col("d")), decoys, _truth_pred(k), "logit").withColumn("loss", r6("loss"))


@query(f", tc AS (SELECT * FROM (SELECT a.dataset, a.node_id AS source_id, b.node_id AS target_id, sqrt((a.uz - b.uz) * (a.uz - b.uz) + (a.uy - b.uy) * (a.uy - b.uy) + (a.ux - b.ux) * (a.ux - b.ux)) AS d FROM tn a JOIN tn b ON a.dataset = b.dataset AND b.t = a.t + 1) WHERE d <= {GATE} QUALIFY row_number() OVER (PARTITION BY dataset, target_id ORDER BY d, source_id) = 1), h AS (SELECT tc.*, EXISTS (SELECT 1 FROM te WHERE te.dataset = tc.dataset AND te.source_id = tc.source_id AND te.target_id = tc.target_id) AS y, row_number() OVER (PARTITION BY dataset, source_id ORDER BY target_id) AS r FROM tc WHERE EXISTS (SELECT 1 FROM te WHERE te.dataset = tc.dataset AND te.source_id = tc.source_id) OR EXISTS (SELECT 1 FROM te WHERE te.dataset = tc.dataset AND te.target_id = tc.target_id)), n AS (SELECT dataset, count(*) AS n FROM te GROUP BY ALL), q AS (SELECT dataset, count(*) FILTER (WHERE y) AS tp, count(*) FILTER (WHERE NOT y) AS fp FROM h WHERE r <= 2 GROUP BY ALL) SELECT dataset, tp, fp, n - tp AS fn, tp / (fp + n) AS jaccard FROM q JOIN n USING (dataset)")
def m31_score_ceiling(k: Tracks) -> DataFrame:
    """The linker's score on the truth's own points: what no detector can lift it above."""
    links = repair.nearest_parent(joins.candidates(k.truth, GATE))
    own = k.truth.select("dataset", F.col("node_id").alias("pred_id"), F.col("node_id").alias("gt_id"))
    return scoring.edge_counts(scoring.charged_links(links, k.truth, k.truth_edges, own), k.truth_edges)


@query(_FT + ", s1 AS (SELECT dataset, source_id, target_id, abs(-d / 2 - (-d / 3 + (source_id % 3) / 10)) AS spread FROM ca) SELECT fate, count(*) AS n, round(avg(spread), 6) AS mean_spread, round(quantile_cont(spread, 0.5), 6) AS median_spread FROM ft JOIN s1 ON s1.dataset = ft.dataset AND s1.source_id = ft.pred_source AND s1.target_id = ft.pred_target GROUP BY fate")
def q11_seed_dispersion_by_fate(k: Tracks) -> DataFrame:
    spread = _seeds(k).groupBy("dataset", F.col("source_id").alias("pred_source"), F.col("target_id").alias("pred_target")).agg((F.max("logit") - F.min("logit")).alias("spread"))
    found = diagnose.fates(k.truth_edges, k.match, k.links).join(spread, ["dataset", "pred_source", "pred_target"])
    return found.groupBy("fate").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("spread")).alias("mean_spread"), r6(F.percentile("spread", 0.5)).alias("median_spread"))


@query(", s AS (SELECT dataset, target_id, count(*) AS c, max(p) AS top FROM af GROUP BY ALL) SELECT dataset, count(*) AS targets, round(quantile_cont(c, 0.5), 6) AS median_competitors, round(quantile_cont(c, 0.9), 6) AS p90_competitors, round(quantile_cont(top, 0.5), 6) AS median_top FROM s GROUP BY dataset")
def q13_softmax_population(k: Tracks) -> DataFrame:
    s = k.affinity.groupBy("dataset", "target_id").agg(F.count(F.lit(1)).alias("c"), F.max("p").alias("top"))
    return s.groupBy("dataset").agg(F.count(F.lit(1)).alias("targets"), r6(F.percentile("c", 0.5)).alias("median_competitors"), r6(F.percentile("c", 0.9)).alias("p90_competitors"), r6(F.percentile("top", 0.5)).alias("median_top"))


@query(f", pop AS (SELECT 'detected' AS population, dataset, node_id, t, uz, uy, ux FROM pn UNION ALL SELECT 'annotated', dataset, node_id, t, uz, uy, ux FROM tn UNION ALL SELECT 'matched', dataset, node_id, t, uz, uy, ux FROM pn WHERE (node_id - 10000000) % 3 <> 0), c AS (SELECT a.population, a.node_id, count(*) AS c FROM pop a JOIN pop b ON a.population = b.population AND a.dataset = b.dataset AND b.t = a.t + 1 AND sqrt((a.uz - b.uz) * (a.uz - b.uz) + (a.uy - b.uy) * (a.uy - b.uy) + (a.ux - b.ux) * (a.ux - b.ux)) <= {GATE} GROUP BY ALL) SELECT population, count(*) AS n_sources, round(avg(c), 6) AS mean_candidates, round(avg((c > 1)::INTEGER), 6) AS with_rival FROM c GROUP BY population")
def q25_corpus_audit(k: Tracks) -> DataFrame:
    def of(nodes: DataFrame, name: str) -> DataFrame:
        c = joins.candidates(nodes, GATE).groupBy("dataset", "source_id").agg(F.count(F.lit(1)).alias("c"))
        return c.agg(F.count(F.lit(1)).alias("n_sources"), r6(F.avg("c")).alias("mean_candidates"), r6(F.avg((F.col("c") > 1).cast("int"))).alias("with_rival")).withColumn("population", F.lit(name))

    matched = k.nodes.join(_some(k).select("dataset", F.col("pred_id").alias("node_id")), ["dataset", "node_id"], "left_semi")
    return of(k.nodes, "detected").unionByName(of(k.truth, "annotated")).unionByName(of(matched, "matched"))


@query(" SELECT dataset, t, source_id, target_id, round(d, 6) AS distance_um, round(p, 6) AS affinity FROM af")
def s10_candidate_store(k: Tracks) -> DataFrame:
    """Candidates written as a table and read back."""
    stored = written(k.affinity.select("dataset", "t", "source_id", "target_id", F.col("p").alias("affinity"), F.col("d").alias("distance_um")), "candidates")
    return stored.select("dataset", "t", "source_id", "target_id", r6("distance_um").alias("distance_um"), r6("affinity").alias("affinity"))
