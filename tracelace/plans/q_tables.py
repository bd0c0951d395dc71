"""Joins, aggregations, windows, sorts and set operations over the track tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.functions import geometry as g
from tracelace.operators import diagnose, joins, motion, repair, scoring
from tracelace.plans.registry import query, r6
from tracelace.sources.tracks import GATE, RULER, Tracks

_XYZ = ("uz", "uy", "ux")


@query(" SELECT dataset, t, count(*) AS n, min(d) AS d_min, max(d) AS d_max, count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets FROM ca GROUP BY dataset, t")
def j1_gated_frame_gap(k: Tracks) -> DataFrame:
    return k.candidates.groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d_min"), F.max("d").alias("d_max"), F.count_distinct("source_id").alias("sources"), F.count_distinct("target_id").alias("targets"))


@query(" SELECT dataset, node_id, (SELECT count(*) FROM pn b WHERE b.dataset = a.dataset AND b.t = a.t AND b.node_id <> a.node_id AND sqrt((a.uz - b.uz) * (a.uz - b.uz) + (a.uy - b.uy) * (a.uy - b.uy) + (a.ux - b.ux) * (a.ux - b.ux)) <= 7.0) AS n_near FROM pn a")
def j3_same_frame_crowding(k: Tracks) -> DataFrame:
    return joins.crowding(k.nodes, RULER)


_NEAR = "sqrt((a.uz - b.uz) * (a.uz - b.uz) + (a.uy - b.uy) * (a.uy - b.uy) + (a.ux - b.ux) * (a.ux - b.ux))"


@query(f", p AS (SELECT a.dataset, a.node_id, b.node_id AS nid, {_NEAR} AS d FROM tn a JOIN pn b ON a.dataset = b.dataset AND a.t = b.t), r AS (SELECT *, row_number() OVER (PARTITION BY dataset, node_id ORDER BY d, nid) AS k FROM p) SELECT tn.dataset, tn.node_id, nid AS nearest_id, d FROM tn LEFT JOIN r ON r.dataset = tn.dataset AND r.node_id = tn.node_id AND k = 1")
def j4_nearest_in_frame(k: Tracks) -> DataFrame:
    return joins.nearest(k.truth, k.nodes)


@query(f", r AS (SELECT a.dataset, a.node_id, min({_NEAR}) AS d FROM pn a JOIN pn b ON a.dataset = b.dataset AND a.t = b.t AND a.node_id <> b.node_id GROUP BY a.dataset, a.node_id) SELECT pn.dataset, pn.node_id, d FROM pn LEFT JOIN r USING (dataset, node_id)")
def j5_second_nearest(k: Tracks) -> DataFrame:
    return joins.nearest(k.nodes, k.nodes, others=True).select("dataset", "node_id", "d")


@query(f", b AS (SELECT a.dataset, a.node_id, min({_NEAR}) AS d FROM pn a JOIN pn b ON a.dataset = b.dataset AND b.t = a.t - 1 GROUP BY ALL), f AS (SELECT a.dataset, a.node_id, min({_NEAR}) AS d FROM pn a JOIN pn b ON a.dataset = b.dataset AND b.t = a.t + 1 GROUP BY ALL) SELECT pn.dataset, pn.node_id, coalesce(1 / (1 + b.d), 0.0::DOUBLE) AS before, coalesce(1 / (1 + f.d), 0.0::DOUBLE) AS after FROM pn LEFT JOIN b USING (dataset, node_id) LEFT JOIN f USING (dataset, node_id)")
def j6_support_before_after(k: Tracks) -> DataFrame:
    b = joins.nearest(k.nodes, k.nodes, -1).select("dataset", "node_id", F.coalesce(1 / (1 + F.col("d")), F.lit(0.0)).alias("before"))
    f = joins.nearest(k.nodes, k.nodes, 1).select("dataset", "node_id", F.coalesce(1 / (1 + F.col("d")), F.lit(0.0)).alias("after"))
    return b.join(f, ["dataset", "node_id"])


@query(f", s AS (SELECT * REPLACE ((t + 20) % (SELECT max(t) + 1 FROM tn) AS t) FROM tn), r AS (SELECT a.dataset, a.node_id, min({_NEAR}) AS d FROM s a JOIN pn b ON a.dataset = b.dataset AND a.t = b.t GROUP BY ALL HAVING min({_NEAR}) <= 7.0) SELECT tn.dataset, count(*) AS n, count(r.d) AS found FROM tn LEFT JOIN r USING (dataset, node_id) GROUP BY tn.dataset")
def j7_shifted_frame_null(k: Tracks) -> DataFrame:
    return joins.shifted_null(k.truth, k.nodes, 20, k.frames, RULER).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("d").alias("found"))


@query(" SELECT pe.dataset, pe.source_id, pe.target_id, a.gt_id AS gt_source, b.gt_id AS gt_target, EXISTS (SELECT 1 FROM te WHERE te.dataset = pe.dataset AND te.source_id = a.gt_id AND te.target_id = b.gt_id) AS is_true FROM pe LEFT JOIN mt a ON a.dataset = pe.dataset AND a.pred_id = pe.source_id LEFT JOIN mt b ON b.dataset = pe.dataset AND b.pred_id = pe.target_id")
def j10_translate_and_test_edges(k: Tracks) -> DataFrame:
    out = joins.in_set(joins.translated(k.links, k.match), k.truth_edges, "gt_source", "gt_target", "is_true")
    return out.select("dataset", "source_id", "target_id", "gt_source", "gt_target", "is_true")


@query(" SELECT dataset, node_id, t FROM pn WHERE NOT EXISTS (SELECT 1 FROM pe WHERE pe.dataset = pn.dataset AND (pe.source_id = pn.node_id OR pe.target_id = pn.node_id))")
def j12_isolated_nodes(k: Tracks) -> DataFrame:
    return k.nodes.join(repair.without_isolated(k.nodes, k.links).select("dataset", "node_id"), ["dataset", "node_id"], "left_anti").select("dataset", "node_id", "t")


@query(" SELECT a.dataset, a.source_id, c.target_id FROM pe a JOIN pe b ON a.dataset = b.dataset AND a.target_id = b.source_id JOIN pe c ON b.dataset = c.dataset AND b.target_id = c.source_id")
def j13_three_hops(k: Tracks) -> DataFrame:
    return joins.hops(k.links, 3)


_ES = ", en AS (SELECT * FROM pn WHERE NOT EXISTS (SELECT 1 FROM pe WHERE pe.dataset = pn.dataset AND pe.source_id = pn.node_id)), st AS (SELECT * FROM pn WHERE NOT EXISTS (SELECT 1 FROM pe WHERE pe.dataset = pn.dataset AND pe.target_id = pn.node_id))"


@query(f"{_ES} SELECT a.dataset, k AS span, a.node_id AS end_id, b.node_id AS start_id, {_NEAR} AS d FROM (SELECT unnest([2, 3]) AS k) JOIN en a ON true JOIN st b ON a.dataset = b.dataset AND b.t = a.t + k WHERE {_NEAR} <= 7.0 * k")
def j14_gap_proposals(k: Tracks) -> DataFrame:
    return joins.gaps(k.nodes, k.links, (2, 3), RULER)


@query(" SELECT dataset, node_id, (SELECT count(*) FROM pe WHERE pe.dataset = pn.dataset AND pe.source_id = pn.node_id) AS out_degree, (SELECT count(*) FROM pe WHERE pe.dataset = pn.dataset AND pe.target_id = pn.node_id) AS in_degree FROM pn")
def a1_degrees(k: Tracks) -> DataFrame:
    return scoring.degrees(k.nodes, k.links)


@query(" SELECT dataset, source_id AS node_id, count(*) AS n_out FROM te GROUP BY ALL HAVING count(*) >= 2")
def a2_divisions(k: Tracks) -> DataFrame:
    return scoring.divisions(k.truth_edges)


@query(f", s AS (SELECT te.dataset, {_NEAR} AS d FROM te JOIN tn a ON a.dataset = te.dataset AND a.node_id = te.source_id JOIN tn b ON b.dataset = te.dataset AND b.node_id = te.target_id), v AS (SELECT dataset, count(*) AS n_steps, median(d) AS step_median, quantile_cont(d, 0.95) AS step_tail, avg((d > 7.0)::INTEGER::DOUBLE) AS beyond FROM s GROUP BY dataset), f AS (SELECT dataset, count(*) AS n_forks FROM (SELECT dataset, source_id FROM te GROUP BY ALL HAVING count(*) > 1) GROUP BY dataset), n AS (SELECT dataset, count(*) AS n_nodes FROM tn GROUP BY dataset) SELECT n.dataset, n_nodes, estimated_nodes, round(n_nodes / estimated_nodes, 6) AS annotated, coalesce(n_forks, 0) AS n_forks, n_steps, round(step_median, 6) AS step_median, round(step_tail, 6) AS step_tail, round(beyond, 6) AS beyond FROM n JOIN vi USING (dataset) JOIN v USING (dataset) LEFT JOIN f USING (dataset)")
def a9_video_summary(k: Tracks) -> DataFrame:
    at = k.truth.select("dataset", "node_id", *_XYZ)
    e = k.truth_edges.join(at.withColumnsRenamed({"node_id": "source_id"} | {c: f"a_{c}" for c in _XYZ}), ["dataset", "source_id"]).join(at.withColumnsRenamed({"node_id": "target_id"} | {c: f"b_{c}" for c in _XYZ}), ["dataset", "target_id"])
    d = g.distance("a_", "b_")
    s = e.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_steps"), r6(F.median(d)).alias("step_median"), r6(F.percentile(d, F.lit(0.95))).alias("step_tail"), r6(F.avg((d > 7.0).cast("int"))).alias("beyond"))
    f = scoring.divisions(k.truth_edges).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_forks"))
    n = k.truth.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_nodes"))
    return n.join(k.video, "dataset").join(s, "dataset").join(f, "dataset", "left").fillna(0, ["n_forks"]).select("dataset", "n_nodes", "estimated_nodes", r6(F.col("n_nodes") / F.col("estimated_nodes")).alias("annotated"), "n_forks", "n_steps", "step_median", "step_tail", "beyond")


@query(" SELECT dataset, count(*) AS n, round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.25), 6) AS p25, round(median(d), 6) AS p50, round(quantile_cont(d, 0.9), 6) AS p90, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std_pop, round(stddev_samp(d), 6) AS std_samp FROM ca GROUP BY dataset")
def a10_exact_percentiles_and_moments(k: Tracks) -> DataFrame:
    q = F.percentile("d", F.array(F.lit(0.1), F.lit(0.25), F.lit(0.5), F.lit(0.9)))
    return k.candidates.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), q.alias("q"), r6(F.avg("d")).alias("mean"), r6(F.stddev_pop("d")).alias("std_pop"), r6(F.stddev_samp("d")).alias("std_samp")).select("dataset", "n", *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p90"))], "mean", "std_pop", "std_samp")


@query(" SELECT dataset, count(*) AS n, round(corr(d, p), 6) AS corr_dp, round(regr_slope(p, d), 6) AS slope FROM af GROUP BY dataset")
def a13_correlation(k: Tracks) -> DataFrame:
    return k.affinity.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("d", "p")).alias("corr_dp"), r6(F.regr_slope("p", "d")).alias("slope"))


@query(" SELECT dataset, CASE WHEN d >= 7.5 THEN 3 WHEN d >= 5.0 THEN 2 WHEN d >= 2.5 THEN 1 ELSE 0 END AS band, count(*) AS n, round(avg(p), 6) AS mean_p FROM af GROUP BY ALL")
def a18_banded_means(k: Tracks) -> DataFrame:
    return k.affinity.withColumn("band", motion.banded(F.col("d"), (2.5, 5.0, 7.5))).groupBy("dataset", "band").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p")).alias("mean_p"))


@query(", o AS (SELECT dataset, source_id AS node_id, max(p) AS best_out FROM af GROUP BY ALL), i AS (SELECT dataset, target_id AS node_id, max(p) AS best_in, sum(p) AS mass FROM af GROUP BY ALL) SELECT dataset, node_id, best_out, best_in, round(mass, 6) AS mass FROM o FULL JOIN i USING (dataset, node_id)")
def a19_scatter_max(k: Tracks) -> DataFrame:
    o = k.affinity.groupBy("dataset", F.col("source_id").alias("node_id")).agg(F.max("p").alias("best_out"))
    i = k.affinity.groupBy("dataset", F.col("target_id").alias("node_id")).agg(F.max("p").alias("best_in"), r6(F.sum("p")).alias("mass"))
    return o.join(i, ["dataset", "node_id"], "full_outer").select("dataset", "node_id", "best_out", "best_in", "mass")


@query(", s AS (SELECT dataset, target_id, count(*) AS competitors, sum(p) FILTER (WHERE d <= 5.0) AS mass FROM af GROUP BY ALL) SELECT dataset, count(*) AS targets, round(avg(competitors), 6) AS competitors, round(avg(coalesce(mass, 0)), 6) AS mass_in_gate FROM s GROUP BY dataset")
def a22_softmax_mass(k: Tracks) -> DataFrame:
    s = k.affinity.groupBy("dataset", "target_id").agg(F.count(F.lit(1)).alias("competitors"), F.coalesce(F.sum(F.when(F.col("d") <= 5.0, F.col("p"))), F.lit(0.0)).alias("mass"))
    return s.groupBy("dataset").agg(F.count(F.lit(1)).alias("targets"), r6(F.avg("competitors")).alias("competitors"), r6(F.avg("mass")).alias("mass_in_gate"))


@query(", e AS (SELECT dataset, t, count(*) AS n FROM tn GROUP BY ALL), q AS (SELECT dataset, n / sum(n) OVER (PARTITION BY dataset) AS p, count(*) OVER (PARTITION BY dataset) AS k FROM e) SELECT dataset, count(*) AS n_frames, round(-sum(p * ln(p)) / ln(any_value(k)), 6) AS evenness FROM q GROUP BY dataset")
def a25_sampling_entropy(k: Tracks) -> DataFrame:
    e = k.truth.groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy("dataset"))
    return e.withColumn("p", p).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_frames"), r6(-F.sum(F.col("p") * F.ln("p")) / F.ln(F.count(F.lit(1)))).alias("evenness"))


@query(f", s AS (SELECT te.dataset, a.t, b.uz - a.uz AS z, b.uy - a.uy AS y, b.ux - a.ux AS x FROM te JOIN tn a ON a.dataset = te.dataset AND a.node_id = te.source_id JOIN tn b ON b.dataset = te.dataset AND b.node_id = te.target_id) SELECT dataset, t, count(*) AS n, median(z) AS mz, median(y) AS my, median(x) AS mx FROM s GROUP BY ALL HAVING count(*) >= 3")
def a31_common_mode_drift(k: Tracks) -> DataFrame:
    at = k.truth.select("dataset", "node_id", "t", *_XYZ)
    e = k.truth_edges.join(at.withColumnsRenamed({"node_id": "source_id"} | {c: f"a_{c}" for c in _XYZ}), ["dataset", "source_id"]).join(at.drop("t").withColumnsRenamed({"node_id": "target_id"} | {c: f"b_{c}" for c in _XYZ}), ["dataset", "target_id"])
    return e.groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n"), *[F.median(F.col(f"b_u{a}") - F.col(f"a_u{a}")).alias(f"m{a}") for a in "zyx"]).filter("n >= 3")


@query(", l AS (SELECT dataset, user_id, t, count(*) AS n FROM pt GROUP BY ALL), c AS (SELECT dataset, t, count(*) AS n FROM pt GROUP BY ALL), a AS (SELECT dataset, t, sum(n) OVER (PARTITION BY dataset ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM c), o AS (SELECT dataset, user_id, t, sum(n) OVER (PARTITION BY dataset, user_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS own FROM l) SELECT o.dataset, o.user_id, o.t, (coalesce(after, 0) - coalesce(own, 0))::BIGINT AS others FROM o JOIN a USING (dataset, t)")
def a32_others_annotated_after(k: Tracks) -> DataFrame:
    after = lambda *by: W.partitionBy(*by).orderBy("t").rowsBetween(1, W.unboundedFollowing)
    c = k.points.groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("_n")).select("dataset", "t", F.coalesce(F.sum("_n").over(after("dataset")), F.lit(0)).alias("_after"))
    own = k.points.groupBy("dataset", "user_id", "t").agg(F.count(F.lit(1)).alias("_n")).withColumn("_own", F.coalesce(F.sum("_n").over(after("dataset", "user_id")), F.lit(0)))
    return own.join(c, ["dataset", "t"]).select("dataset", "user_id", "t", (F.col("_after") - F.col("_own")).alias("others"))


@query(", o AS (SELECT pn.dataset, pn.z - tn.z AS z, pn.y - tn.y AS y, pn.x - tn.x AS x FROM pn JOIN tn ON tn.dataset = pn.dataset AND tn.node_id = pn.node_id - 10000000) SELECT 'z' AS axis, z AS off, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT 'y', y, count(*) FROM o GROUP BY ALL UNION ALL SELECT 'x', x, count(*) FROM o GROUP BY ALL")
def a33_offset_histogram(k: Tracks) -> DataFrame:
    t = k.truth.select("dataset", F.col("node_id").alias("gt_id"), *[F.col(a).alias(f"g{a}") for a in "zyx"])
    j = k.nodes.join(k.match.withColumnRenamed("pred_id", "node_id"), ["dataset", "node_id"]).join(t, ["dataset", "gt_id"])
    return j.select(F.expr("stack(3, 'z', z - gz, 'y', y - gy, 'x', x - gx) as (axis, off)")).groupBy("axis", "off").agg(F.count(F.lit(1)).alias("n"))


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY dataset, source_id ORDER BY d, target_id) AS d_rank, count(*) OVER (PARTITION BY dataset, source_id) AS n_cand FROM ca) SELECT dataset, source_id, target_id, d_rank, n_cand FROM r")
def w5_distance_rank(k: Tracks) -> DataFrame:
    w = W.partitionBy("dataset", "source_id")
    return k.candidates.select("dataset", "source_id", "target_id", F.row_number().over(w.orderBy("d", "target_id")).alias("d_rank"), F.count(F.lit(1)).over(w).alias("n_cand"))


@query(" SELECT dataset, node_id, row_number() OVER (PARTITION BY dataset, t ORDER BY node_id) - 1 AS row_in_frame, count(*) OVER (PARTITION BY dataset, t) AS n_in_frame FROM pn")
def w6_row_in_frame(k: Tracks) -> DataFrame:
    w = W.partitionBy("dataset", "t")
    return k.nodes.select("dataset", "node_id", (F.row_number().over(w.orderBy("node_id")) - 1).alias("row_in_frame"), F.count(F.lit(1)).over(w).alias("n_in_frame"))


@query(" SELECT dataset, source_id, target_id, ntile(5) OVER (PARTITION BY dataset ORDER BY d, source_id, target_id) AS band FROM ca")
def w17_equal_count_bands(k: Tracks) -> DataFrame:
    return k.candidates.select("dataset", "source_id", "target_id", F.ntile(5).over(W.partitionBy("dataset").orderBy("d", "source_id", "target_id")).alias("band"))


@query(" SELECT user_id, event_id, value, round((rank() OVER (PARTITION BY user_id ORDER BY value) - 1 + 0.5 * count(*) OVER (PARTITION BY user_id, value)) / count(*) OVER (PARTITION BY user_id), 6) AS pct FROM events")
def w20_percentile_of_value(k: Tracks) -> DataFrame:
    u = W.partitionBy("user_id")
    below = F.rank().over(u.orderBy("value")) - 1
    return k.table("events").select("user_id", "event_id", "value", r6((below + 0.5 * F.count(F.lit(1)).over(W.partitionBy("user_id", "value"))) / F.count(F.lit(1)).over(u)).alias("pct"))


@query(", f AS (SELECT dataset, user_id, t, node_id, y, lag(y, 3) OVER w AS y3, t - lag(t, 3) OVER w AS span FROM pt WINDOW w AS (PARTITION BY dataset, user_id ORDER BY t)) SELECT dataset, user_id, node_id, y - y3 AS dy FROM f WHERE span = 3")
def w9_lag_with_exact_spacing(k: Tracks) -> DataFrame:
    w = W.partitionBy("dataset", "user_id").orderBy("t")
    return k.points.withColumn("_y", F.lag("y", 3).over(w)).withColumn("_s", F.col("t") - F.lag("t", 3).over(w)).filter("_s = 3").select("dataset", "user_id", "node_id", (F.col("y") - F.col("_y")).alias("dy"))


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY dataset, t ORDER BY v DESC, node_id) AS k FROM (SELECT pt.dataset, pt.t, pt.node_id, e.value AS v FROM pt JOIN events e ON e.event_id = pt.node_id)) SELECT dataset, t, node_id, v FROM r WHERE k <= 3")
def t1_strongest_per_frame(k: Tracks) -> DataFrame:
    v = k.points.join(k.table("events").select(F.col("event_id").alias("node_id"), F.col("value").alias("v")), "node_id")
    return v.withColumn("_k", F.row_number().over(W.partitionBy("dataset", "t").orderBy(F.desc("v"), "node_id"))).filter("_k <= 3").select("dataset", "t", "node_id", "v")


@query(" SELECT dataset, source_id, target_id, d FROM pe")
def t3_nearest_single_parent(k: Tracks) -> DataFrame:
    return k.links.select("dataset", "source_id", "target_id", "d")


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY dataset, source_id ORDER BY p DESC, target_id) AS k FROM af) SELECT dataset, source_id, max(target_id) FILTER (WHERE k = 1) AS best, max(target_id) FILTER (WHERE k = 2) AS runner_up FROM r GROUP BY ALL")
def t5_best_and_runner_up(k: Tracks) -> DataFrame:
    r = k.affinity.withColumn("_k", F.row_number().over(W.partitionBy("dataset", "source_id").orderBy(F.desc("p"), "target_id")))
    return r.groupBy("dataset", "source_id").agg(F.max(F.when(F.col("_k") == 1, F.col("target_id"))).alias("best"), F.max(F.when(F.col("_k") == 2, F.col("target_id"))).alias("runner_up"))


@query(", x AS (SELECT dataset, source_id, target_id, d FROM ca WHERE EXISTS (SELECT 1 FROM te WHERE te.dataset = ca.dataset AND te.source_id = ca.source_id - 10000000) AND NOT EXISTS (SELECT 1 FROM te WHERE te.dataset = ca.dataset AND te.source_id = ca.source_id - 10000000 AND te.target_id = ca.target_id - 10000000)), r AS (SELECT *, row_number() OVER (PARTITION BY dataset, source_id ORDER BY d, target_id) AS k FROM x) SELECT dataset, source_id, target_id, k FROM r WHERE k <= 2")
def t7_hard_negatives(k: Tracks) -> DataFrame:
    from tracelace.operators.sampling import hard_negatives

    truth = k.truth_edges.select("dataset", (F.col("source_id") + 10_000_000).alias("source_id"), (F.col("target_id") + 10_000_000).alias("target_id"))
    return hard_negatives(k.candidates, truth, 2).select("dataset", "source_id", "target_id", "k")


@query(", d AS (SELECT dataset, count(*) AS n FROM (SELECT dataset, source_id FROM te GROUP BY ALL HAVING count(*) > 1) GROUP BY dataset) SELECT prefix, dataset, n FROM (SELECT substr(dataset, 1, 1) AS prefix, dataset, n, row_number() OVER (PARTITION BY substr(dataset, 1, 1) ORDER BY n DESC, dataset) AS k FROM d) WHERE k <= 2")
def t10_division_rich(k: Tracks) -> DataFrame:
    d = scoring.divisions(k.truth_edges).groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).withColumn("prefix", F.substring("dataset", 1, 1))
    return d.withColumn("_k", F.row_number().over(W.partitionBy("prefix").orderBy(F.desc("n"), "dataset"))).filter("_k <= 2").select("prefix", "dataset", "n")


@query("SELECT source, doc_id, CASE WHEN k <= 2 THEN 'test' WHEN k <= 5 THEN 'val' ELSE 'train' END AS split FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) AS k FROM documents)", base=False)
def t11_stratified_split(k: Tracks) -> DataFrame:
    from tracelace.operators.sampling import stratified_split

    return stratified_split(k.table("documents").select("source", "doc_id"), "source", "doc_id").select("source", "doc_id", "split")


@query("SELECT user_id, event_id, max(value) OVER w AS best, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)", base=False)
def t14_running_best(k: Tracks) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return k.table("events").select("user_id", "event_id", F.max("value").over(w).alias("best"), F.count(F.lit(1)).over(w).alias("n"))


_TWO = ", pb AS (SELECT dataset, source_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset, source_id ORDER BY d, target_id) AS r FROM ca) WHERE r = 1)"


def _second(k: Tracks) -> DataFrame:
    best = k.candidates.groupBy("dataset", "source_id").agg(F.min(F.struct("d", "target_id")).alias("m"))
    return best.select("dataset", "source_id", F.col("m.target_id").alias("target_id"))


@query(_TWO + ", u AS (SELECT dataset, source_id, target_id, max(a) AS a, max(b) AS b FROM (SELECT dataset, source_id, target_id, 1 AS a, 0 AS b FROM pe UNION ALL SELECT dataset, source_id, target_id, 0, 1 FROM pb) GROUP BY ALL) SELECT dataset, sum(a * b)::BIGINT AS n_both, sum(a * (1 - b))::BIGINT AS n_only_a, sum(b * (1 - a))::BIGINT AS n_only_b, sum(a * b) / count(*) AS jaccard FROM u GROUP BY dataset")
def u3_agreement(k: Tracks) -> DataFrame:
    return diagnose.agreement(k.links, _second(k))


_TAG = _TWO + ", tg AS (SELECT 'a' AS tracker, dataset, source_id, target_id FROM pe UNION ALL SELECT 'b', dataset, source_id, target_id FROM pb UNION ALL SELECT 'c', dataset, source_id + 10000000, target_id + 10000000 FROM te)"


def _tagged(k: Tracks) -> DataFrame:
    c = k.truth_edges.select("dataset", (F.col("source_id") + 10_000_000).alias("source_id"), (F.col("target_id") + 10_000_000).alias("target_id"))
    keys = ("tracker", "dataset", "source_id", "target_id")
    parts = [x.withColumn("tracker", F.lit(n)).select(*keys) for n, x in (("a", k.links), ("b", _second(k)), ("c", c))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_TAG + ", v AS (SELECT dataset, source_id, target_id, count(DISTINCT tracker) AS n FROM tg GROUP BY ALL) SELECT dataset, n AS n_trackers, count(*) AS n_links FROM v GROUP BY ALL")
def u4_votes(k: Tracks) -> DataFrame:
    return diagnose.votes(_tagged(k)).groupBy("dataset", "n_trackers").agg(F.count(F.lit(1)).alias("n_links"))


@query(_TAG + ", s AS (SELECT dataset, tracker, count(*) AS n FROM tg GROUP BY ALL), b AS (SELECT x.dataset, x.tracker, y.tracker AS other, count(*) AS n FROM tg x JOIN tg y ON x.dataset = y.dataset AND x.source_id = y.source_id AND x.target_id = y.target_id AND x.tracker < y.tracker GROUP BY ALL) SELECT p.dataset, p.tracker, q.tracker AS other, coalesce(b.n, 0) AS n_both, coalesce(b.n, 0) / (p.n + q.n - coalesce(b.n, 0)) AS jaccard FROM s p JOIN s q ON p.dataset = q.dataset AND p.tracker < q.tracker LEFT JOIN b ON b.dataset = p.dataset AND b.tracker = p.tracker AND b.other = q.tracker")
def u5_decorrelation(k: Tracks) -> DataFrame:
    return diagnose.decorrelation(_tagged(k))


@query("SELECT coalesce(a.k, b.k) AS name, a.v AS left_value, b.v AS right_value, CASE WHEN a.k IS NULL THEN 'only_right' WHEN b.k IS NULL THEN 'only_left' WHEN a.v = b.v THEN 'same' ELSE 'different' END AS state FROM (SELECT user_id AS k, count(*) AS v FROM events WHERE event_type = 'click' GROUP BY ALL) a FULL JOIN (SELECT user_id AS k, count(*) AS v FROM events WHERE event_type = 'view' GROUP BY ALL) b ON a.k = b.k", base=False)
def u8_three_way_difference(k: Tracks) -> DataFrame:
    from tracelace.operators.settings import difference

    e = k.table("events")
    side = lambda kind: e.filter(F.col("event_type") == kind).groupBy(F.col("user_id").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return difference(side("click"), side("view"))


@query(f" SELECT dataset, count(*) AS n_sources, round(avg(c), 6) AS mean_candidates, round(avg((c > 1)::INTEGER), 6) AS with_rival FROM (SELECT dataset, source_id, count(*) AS c FROM ca WHERE d <= {GATE} GROUP BY ALL) GROUP BY dataset")
def q23_candidate_density(k: Tracks) -> DataFrame:
    c = k.candidates.groupBy("dataset", "source_id").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_sources"), r6(F.avg("c")).alias("mean_candidates"), r6(F.avg((F.col("c") > 1).cast("int"))).alias("with_rival"))
