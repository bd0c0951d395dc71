"""Drift fields, forks, placing, losses and streams over the track tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.operators import costs, drift, forks, joins, losses, placing, repair, sampling, scoring, stages
from tracelace.plans.q_scores import _ACT, _ROOT, _truth_pred
from tracelace.plans.q_stages import _DIV, _stream
from tracelace.plans.q_tables import _NEAR, _TWO, _second
from tracelace.plans.registry import query, r6
from tracelace.sources.tracks import EXTENT, GATE, Tracks
from tracelace.streaming import frames

#: The drift field's sigma and the spacing of its anchors; the volume in voxels, moves along y included.
SIGMA, SPACING = 12.0, 20.0
VOLUME = (16, EXTENT + 10, EXTENT + 10)
_XYZ = ("uz", "uy", "ux")


def _norm(parts: list[str]) -> str:
    return "sqrt(" + " + ".join(f"({p}) * ({p})" for p in parts) + ")"


_AV = _norm([f"a{c} - v.u{c}" for c in "zyx"])
_DB = _norm([f"dd.d{c} - pk.bn{c} * {drift.BIN}" for c in "zyx"])
_FIELD = f""", vo AS (SELECT ca.dataset, ca.t, a.uz, a.uy, a.ux, b.uz - a.uz AS dz, b.uy - a.uy AS dy, b.ux - a.ux AS dx
  FROM ca JOIN pn a ON a.dataset = ca.dataset AND a.node_id = ca.source_id JOIN pn b ON b.dataset = ca.dataset AND b.node_id = ca.target_id),
ex AS (SELECT dataset, min(uz) AS lz, max(uz) AS hz, min(uy) AS ly, max(uy) AS hy, min(ux) AS lx, max(ux) AS hx FROM pn GROUP BY dataset),
az AS (SELECT dataset, unnest(range(0, ceil((hz + {SPACING} - lz) / {SPACING})::INTEGER)) AS i, lz FROM ex),
ay AS (SELECT dataset, unnest(range(0, ceil((hy + {SPACING} - ly) / {SPACING})::INTEGER)) AS i, ly FROM ex),
ax AS (SELECT dataset, unnest(range(0, ceil((hx + {SPACING} - lx) / {SPACING})::INTEGER)) AS i, lx FROM ex),
an AS (SELECT az.dataset, lz + az.i * {SPACING}::DOUBLE AS az, ly + ay.i * {SPACING}::DOUBLE AS ay, lx + ax.i * {SPACING}::DOUBLE AS ax FROM az JOIN ay USING (dataset) JOIN ax USING (dataset)),
dd AS (SELECT v.dataset, v.t, az, ay, ax, dz, dy, dx, sum(exp(-0.5 * ({_AV} / {SIGMA}) * ({_AV} / {SIGMA}))) AS w FROM an JOIN vo v ON v.dataset = an.dataset WHERE {_AV} <= {drift.REACH * SIGMA} GROUP BY ALL),
ms AS (SELECT dataset, t, az, ay, ax, round_even(dz / {drift.BIN}, 0) AS bnz, round_even(dy / {drift.BIN}, 0) AS bny, round_even(dx / {drift.BIN}, 0) AS bnx, sum(w) AS m FROM dd GROUP BY ALL),
pk AS (SELECT *, sum(m) OVER (PARTITION BY dataset, t, az, ay, ax) AS every FROM ms QUALIFY row_number() OVER (PARTITION BY dataset, t, az, ay, ax ORDER BY round(m, 9) DESC, bnz, bny, bnx) = 1),
fe AS (SELECT pk.dataset, pk.t, pk.az, pk.ay, pk.ax, pk.bnz, pk.bny, pk.bnx, m / greatest(every, {drift.FLOOR}) AS sharpness,
  sum(w) FILTER (WHERE {_DB} <= {drift.BIN}) AS ws, sum(w * dz) FILTER (WHERE {_DB} <= {drift.BIN}) AS sz, sum(w * dy) FILTER (WHERE {_DB} <= {drift.BIN}) AS sy, sum(w * dx) FILTER (WHERE {_DB} <= {drift.BIN}) AS sx
  FROM pk JOIN dd ON dd.dataset = pk.dataset AND dd.t = pk.t AND dd.az = pk.az AND dd.ay = pk.ay AND dd.ax = pk.ax GROUP BY ALL),
fi AS (SELECT dataset, t, az, ay, ax, sharpness, CASE WHEN ws > 0 THEN sz / greatest(ws, {drift.FLOOR}) ELSE bnz * {drift.BIN} END AS vz,
  CASE WHEN ws > 0 THEN sy / greatest(ws, {drift.FLOOR}) ELSE bny * {drift.BIN} END AS vy, CASE WHEN ws > 0 THEN sx / greatest(ws, {drift.FLOOR}) ELSE bnx * {drift.BIN} END AS vx FROM fe)"""


def _field(k: Tracks) -> DataFrame:
    return drift.field(drift.votes(k.candidates, k.nodes), drift.anchors(k.nodes, SPACING), SIGMA)


@query(_FIELD + " SELECT dataset, t, round(az, 6) AS az, round(ay, 6) AS ay, round(ax, 6) AS ax, round(vz, 6) AS vz, round(vy, 6) AS vy, round(vx, 6) AS vx, round(sharpness, 6) AS sharpness FROM fi")
def q6_drift_field(k: Tracks) -> DataFrame:
    return _field(k).select("dataset", "t", *[r6(c).alias(c) for c in ("az", "ay", "ax", "vz", "vy", "vx", "sharpness")])


@query(_FIELD + " SELECT dataset, t, count(*) AS n_anchors, round(avg(vz), 6) AS vz, round(avg(vy), 6) AS vy, round(avg(vx), 6) AS vx FROM fi GROUP BY ALL")
def q6_global_drift(k: Tracks) -> DataFrame:
    # means that lie half way between two places are rounded alike, whatever the order of the sum
    return _field(k).groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n_anchors"), *[r6(F.round(F.avg(f"v{c}"), 9)).alias(f"v{c}") for c in "zyx"])


def _at(points: str) -> str:
    return f""", fp AS (SELECT v.dataset, v.node_id, {", ".join(f"sum(exp(-0.5 * ({_AV} / {SIGMA}) * ({_AV} / {SIGMA})) * v{c}) / greatest(sum(exp(-0.5 * ({_AV} / {SIGMA}) * ({_AV} / {SIGMA}))), {drift.FLOOR}) AS f{c}" for c in "zyx")}
  FROM {points} v JOIN fi ON fi.dataset = v.dataset AND fi.t = v.t WHERE {_AV} <= {drift.REACH * SIGMA} GROUP BY ALL)"""


@query(_FIELD + _at("pn") + " SELECT pn.dataset, pn.node_id, round(coalesce(fz, 0), 6) AS fz, round(coalesce(fy, 0), 6) AS fy, round(coalesce(fx, 0), 6) AS fx FROM pn LEFT JOIN fp USING (dataset, node_id)")
def j16_field_at_points(k: Tracks) -> DataFrame:
    return drift.at_points(k.nodes, _field(k), SIGMA).select("dataset", "node_id", *[r6(f"f{c}").alias(f"f{c}") for c in "zyx"])


@query(
    _FIELD
    + _at("tn")
    + """, re AS (SELECT te.dataset, b.uz - a.uz AS z, b.uy - a.uy AS y, b.ux - a.ux AS x, coalesce(fz, 0) AS fz, coalesce(fy, 0) AS fy, coalesce(fx, 0) AS fx
  FROM te JOIN tn a ON a.dataset = te.dataset AND a.node_id = te.source_id JOIN tn b ON b.dataset = te.dataset AND b.node_id = te.target_id LEFT JOIN fp ON fp.dataset = te.dataset AND fp.node_id = te.source_id)
SELECT dataset, count(*) AS n, round(1 - sum((z - fz) * (z - fz) + (y - fy) * (y - fy) + (x - fx) * (x - fx)) / sum(z * z + y * y + x * x), 6) AS explained FROM re GROUP BY dataset"""
)
def q7_residual_explained(k: Tracks) -> DataFrame:
    f = drift.at_points(k.truth, _field(k), SIGMA).withColumnRenamed("node_id", "source_id")
    at = lambda key, p: k.truth.select("dataset", F.col("node_id").alias(key), *[F.col(c).alias(f"{p}{c}") for c in _XYZ])
    e = k.truth_edges.select("dataset", "source_id", "target_id").join(at("source_id", "a_"), ["dataset", "source_id"]).join(at("target_id", "b_"), ["dataset", "target_id"]).join(f, ["dataset", "source_id"])
    sq = lambda part: sum((part(c) * part(c) for c in "yx"), part("z") * part("z"))
    step = lambda c: F.col(f"b_u{c}") - F.col(f"a_u{c}")
    return e.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), r6(1 - F.sum(sq(lambda c: step(c) - F.col(f"f{c}"))) / F.sum(sq(step))).alias("explained"))


_GAPS = _norm([f"q.u{c} - s.u{c}" for c in "zyx"]), _norm([f"r.u{c} - s.u{c}" for c in "zyx"]), _norm([f"q.u{c} - s.u{c} - coalesce(f{c}, 0)" for c in "zyx"]), _norm([f"r.u{c} - s.u{c} - coalesce(f{c}, 0)" for c in "zyx"])


@query(
    _FIELD
    + _at("pn")
    + f""", y AS (SELECT ca.*, EXISTS (SELECT 1 FROM te WHERE te.dataset = ca.dataset AND te.source_id + 10000000 = ca.source_id AND te.target_id + 10000000 = ca.target_id) AS y FROM ca),
o AS (SELECT dataset, source_id, min({{'d': d, 'i': target_id}}) FILTER (WHERE y) AS tt, min({{'d': d, 'i': target_id}}) FILTER (WHERE NOT y) AS rr FROM y GROUP BY ALL),
g AS (SELECT o.dataset, {_GAPS[0]} - {_GAPS[1]} AS raw, {_GAPS[2]} - {_GAPS[3]} AS cor FROM o JOIN pn s ON s.dataset = o.dataset AND s.node_id = o.source_id JOIN pn q ON q.dataset = o.dataset AND q.node_id = tt.i JOIN pn r ON r.dataset = o.dataset AND r.node_id = rr.i
  LEFT JOIN fp ON fp.dataset = o.dataset AND fp.node_id = o.source_id WHERE tt IS NOT NULL AND rr IS NOT NULL)
SELECT dataset, count(*) AS n, count(*) FILTER (WHERE round(raw, 6) > 0 AND round(cor, 6) < 0) AS rescued, count(*) FILTER (WHERE round(raw, 6) < 0 AND round(cor, 6) > 0) AS broken FROM g GROUP BY dataset"""
)
def q7_candidates_reordered(k: Tracks) -> DataFrame:
    g = drift.reordered(k.candidates, _truth_pred(k), k.nodes, drift.at_points(k.nodes, _field(k), SIGMA))
    raw, cor = r6("raw_gap"), r6("corrected_gap")
    return g.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if((raw > 0) & (cor < 0)).alias("rescued"), F.count_if((raw < 0) & (cor > 0)).alias("broken"))


_AHEAD = """, dn AS (SELECT dataset, node_id, node_id AS at FROM pn UNION ALL SELECT dn.dataset, dn.node_id, LK.target_id FROM dn JOIN LK ON LK.dataset = dn.dataset AND LK.source_id = dn.at),
ah AS (SELECT dn.dataset, dn.node_id, max(b.t) - any_value(a.t) + 1 AS ahead FROM dn JOIN pn b ON b.dataset = dn.dataset AND b.node_id = dn.at JOIN pn a ON a.dataset = dn.dataset AND a.node_id = dn.node_id GROUP BY ALL)"""


@query(_AHEAD.replace("LK", "pe") + " SELECT dataset, node_id, ahead FROM ah")
def w7_longest_way_ahead(k: Tracks) -> DataFrame:
    return forks.frames_ahead(k.nodes, k.links)


#: Links without every fourth target, the second daughters proposed for them, and their cues.
_CUES = (
    ", tl AS (SELECT * FROM pe WHERE target_id % 4 <> 0)"
    + _DIV.replace("pe ", "tl ").replace("pe.", "tl.").replace("{gp}", "10.0").replace("{gs}", "14.0")
    + _AHEAD.replace("LK", "tl")
    + f""", fs AS (SELECT dataset, source_id, min(target_id) AS nx FROM tl GROUP BY ALL),
cu AS (SELECT dc.*, d_parent + 0.15 * d_sister AS score, ahead AS child_frames,
  CASE WHEN {_norm([f"k.u{c} - p.u{c}" for c in "zyx"])} + d_parent = 0 THEN 0 ELSE {_norm([f"k.u{c} - p.u{c} + c.u{c} - p.u{c}" for c in "zyx"])} / ({_norm([f"k.u{c} - p.u{c}" for c in "zyx"])} + d_parent) END AS imbalance,
  {_norm([f"k.u{c} - p.u{c}" for c in "zyx"])} AS d_kept, {_norm([f"a.u{c} - b.u{c}" for c in "zyx"])} - d_sister AS divergence
  FROM dc JOIN pn p ON p.dataset = dc.dataset AND p.node_id = parent_id JOIN pn k ON k.dataset = dc.dataset AND k.node_id = kept_id JOIN pn c ON c.dataset = dc.dataset AND c.node_id = child_id
  JOIN ah ON ah.dataset = dc.dataset AND ah.node_id = child_id LEFT JOIN fs f1 ON f1.dataset = dc.dataset AND f1.source_id = kept_id LEFT JOIN fs f2 ON f2.dataset = dc.dataset AND f2.source_id = child_id
  LEFT JOIN pn a ON a.dataset = dc.dataset AND a.node_id = f1.nx LEFT JOIN pn b ON b.dataset = dc.dataset AND b.node_id = f2.nx),
cf AS (SELECT *, CASE WHEN greatest(d_sister, d_sister + divergence) = 0 THEN 0 ELSE divergence / greatest(d_sister, d_sister + divergence) END AS fraction FROM cu)"""
)


def _thinned(k: Tracks) -> DataFrame:
    return k.links.filter("target_id % 4 != 0")


def _cues(k: Tracks) -> DataFrame:
    links = _thinned(k)
    return forks.cues(stages.division_candidates(k.nodes, links, 10.0, 14.0), k.nodes, links)


@query(
    _CUES
    + """ SELECT dataset, parent_id, kept_id, child_id, round(d_parent + 0.15 * d_sister, 6) AS geometry, round(d_parent / 10.0 + imbalance, 6) AS symmetry,
  round(d_parent / 10.0 + imbalance + coalesce(CASE WHEN divergence IS NULL THEN NULL ELSE 1 - greatest(fraction, 0) END, 1.0), 6) AS diverging,
  round(d_parent / 10.0 + imbalance + (6 - least(child_frames, 6)) / 5.0, 6) AS surviving FROM cf"""
)
def r9_fork_rankings(k: Tracks) -> DataFrame:
    c, base = _cues(k), forks.symmetry(10.0)
    return c.select("dataset", "parent_id", "kept_id", "child_id", r6(forks.geometry()).alias("geometry"), r6(base).alias("symmetry"), r6(forks.diverging(base)).alias("diverging"), r6(forks.surviving(base, 6)).alias("surviving"))


@query(
    _CUES
    + f""", oo AS (SELECT * FROM pn WHERE NOT EXISTS (SELECT 1 FROM tl WHERE tl.dataset = pn.dataset AND tl.target_id = pn.node_id)),
ne AS (SELECT q.dataset, q.kept_id, arg_min(o.node_id, {{'d': {_norm([f"p.u{c} - o.u{c}" for c in "zyx"])}, 'i': o.node_id}}) AS child_id FROM (SELECT DISTINCT dataset, kept_id FROM cf) q JOIN pn p ON p.dataset = q.dataset AND p.node_id = q.kept_id
  JOIN oo o ON o.dataset = p.dataset AND o.t = p.t WHERE {_norm([f"p.u{c} - o.u{c}" for c in "zyx"])} <= 14.0 GROUP BY ALL),
sg AS (SELECT dataset, source_id FROM tl GROUP BY ALL HAVING count(*) = 1), np AS (SELECT a.dataset, a.t, count(*) AS n FROM sg JOIN pn a ON a.dataset = sg.dataset AND a.node_id = sg.source_id GROUP BY ALL),
ok AS (SELECT cf.* FROM cf JOIN ne USING (dataset, kept_id, child_id) JOIN sg s1 ON s1.dataset = cf.dataset AND s1.source_id = cf.kept_id JOIN sg s2 ON s2.dataset = cf.dataset AND s2.source_id = cf.child_id
  WHERE EXISTS (SELECT 1 FROM tl WHERE tl.dataset = cf.dataset AND tl.target_id = cf.parent_id) AND d_kept <= 9.0 AND divergence >= 0.0),
o1 AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY dataset, child_id ORDER BY score, parent_id) = 1),
o2 AS (SELECT o1.* FROM o1 JOIN np ON np.dataset = o1.dataset AND np.t = o1.t QUALIFY row_number() OVER (PARTITION BY o1.dataset, o1.t ORDER BY score, parent_id) <= greatest(1, round_even(n * 0.1, 0))),
cp AS (SELECT dataset, greatest(1, round_even(count(*) * 0.02, 0)) AS cap FROM tl GROUP BY dataset)
SELECT o2.dataset, t, parent_id AS source_id, child_id AS target_id FROM o2 JOIN cp ON cp.dataset = o2.dataset QUALIFY row_number() OVER (PARTITION BY o2.dataset ORDER BY t, score, parent_id) <= cap"""
)
def r12_safe_divisions(k: Tracks) -> DataFrame:
    links = _thinned(k)
    orphans = k.nodes.join(links.select("dataset", F.col("target_id").alias("node_id")), ["dataset", "node_id"], "left_anti")
    return forks.safe_divisions(_cues(k), orphans, k.nodes, links, 9.0, 14.0, 0.0, 0.1, 0.02)


_BRANCH = """, nb AS (SELECT dataset, source_id FROM pe GROUP BY ALL HAVING count(*) > 1),
br AS (SELECT pe.dataset, pe.source_id AS parent_id, pe.target_id AS child_id, row_number() OVER (PARTITION BY pe.dataset, pe.source_id ORDER BY p DESC, pe.target_id) AS branch, p, af.d,
  EXISTS (SELECT 1 FROM te WHERE te.dataset = pe.dataset AND te.source_id + 10000000 = pe.source_id AND te.target_id + 10000000 = pe.target_id) AS is_edge,
  (SELECT count(*) FROM te WHERE te.dataset = pe.dataset AND te.source_id + 10000000 = pe.source_id) > 1 AS divides
  FROM pe JOIN nb USING (dataset, source_id) JOIN af ON af.dataset = pe.dataset AND af.source_id = pe.source_id AND af.target_id = pe.target_id)"""


def _branches(k: Tracks) -> DataFrame:
    return forks.branches(k.links, k.affinity, k.truth_edges, k.match)


@query(
    _BRANCH
    + """, tf AS (SELECT dataset, count(*) AS tot FROM (SELECT dataset, source_id FROM te GROUP BY ALL HAVING count(*) > 1) GROUP BY dataset),
rk AS (SELECT *, is_edge AND divides AS is_true, row_number() OVER w - 1 AS rnk, sum((is_edge AND divides)::INTEGER) OVER (w ROWS UNBOUNDED PRECEDING) AS kk, sum((NOT (is_edge AND divides))::INTEGER) OVER (w ROWS UNBOUNDED PRECEDING) AS mm
  FROM br WHERE branch > 1 WINDOW w AS (PARTITION BY dataset ORDER BY -p, parent_id, branch)),
vv AS (SELECT rk.*, kk / (tot + mm) AS v FROM rk JOIN tf USING (dataset))
SELECT dataset, count(*) AS total, count(*) FILTER (WHERE is_true) AS n_true, coalesce(max(rnk) FILTER (WHERE is_true), -1)::BIGINT AS worst_rank,
  coalesce(min_by(rnk, (-v, rnk)) FILTER (WHERE is_true) + 1, 0)::BIGINT AS best_budget, round(coalesce(max(v) FILTER (WHERE is_true), 0), 6) AS best_jaccard FROM vv GROUP BY dataset"""
)
def m17_fork_rank_report(k: Tracks) -> DataFrame:
    true = scoring.divisions(k.truth_edges).groupBy("dataset").agg(F.count(F.lit(1)).alias("T"))
    out = forks.rank_report(_branches(k).filter("branch > 1"), -F.col("p"), true)
    return out.select("dataset", "total", "n_true", F.col("worst_rank").cast("long").alias("worst_rank"), F.col("best_budget").cast("long").alias("best_budget"), r6("best_jaccard").alias("best_jaccard"))


@query(
    _BRANCH
    + """, gr AS (SELECT * FROM br QUALIFY sum(is_edge::INTEGER) OVER (PARTITION BY dataset, parent_id) = 1)
SELECT dataset, rule, count(*) AS decided, count(*) FILTER (WHERE is_edge) AS correct FROM (
  SELECT dataset, 'probability' AS rule, is_edge FROM gr QUALIFY row_number() OVER (PARTITION BY dataset, parent_id ORDER BY p DESC, branch) = 1
  UNION ALL SELECT dataset, 'distance', is_edge FROM gr QUALIFY row_number() OVER (PARTITION BY dataset, parent_id ORDER BY d, branch) = 1) GROUP BY ALL"""
)
def m17_branch_accuracy(k: Tracks) -> DataFrame:
    return forks.branch_accuracy(_branches(k), {"probability": F.col("p"), "distance": -F.col("d")})


@query(
    """, hit AS (SELECT pe.dataset, pe.source_id - 10000000 AS s, pe.target_id - 10000000 AS t FROM pe),
p AS (SELECT hit.*, EXISTS (SELECT 1 FROM te WHERE te.dataset = hit.dataset AND te.source_id = s AND te.target_id = hit.t) AS ok,
  EXISTS (SELECT 1 FROM te WHERE te.dataset = hit.dataset AND te.target_id = hit.t) OR EXISTS (SELECT 1 FROM te WHERE te.dataset = hit.dataset AND te.source_id = s) AS charged FROM hit),
g AS (SELECT te.dataset, EXISTS (SELECT 1 FROM hit WHERE hit.dataset = te.dataset AND s = te.source_id AND hit.t = te.target_id) AS ok,
  NOT EXISTS (SELECT 1 FROM pn WHERE pn.dataset = te.dataset AND pn.node_id = te.source_id + 10000000) OR NOT EXISTS (SELECT 1 FROM pn WHERE pn.dataset = te.dataset AND pn.node_id = te.target_id + 10000000) AS lost FROM te)
SELECT * FROM (SELECT dataset, count(*) FILTER (WHERE ok) AS tp, count(*) FILTER (WHERE NOT ok AND charged) AS fp, count(*) FILTER (WHERE NOT ok AND NOT charged) AS invisible, count(*) FILTER (WHERE NOT ok) AS wrong FROM p GROUP BY dataset)
JOIN (SELECT dataset, count(*) FILTER (WHERE NOT ok) AS fn, count(*) FILTER (WHERE ok) AS recovered, count(*) FILTER (WHERE NOT ok AND NOT lost) AS fragmented, count(*) FILTER (WHERE lost) AS lost FROM g GROUP BY dataset) USING (dataset)"""
)
def m13_simplified_counts(k: Tracks) -> DataFrame:
    return placing.simplified_counts(k.links, k.truth_edges, k.match)


@query(
    _TWO
    + """, pa AS (SELECT dataset, source_id, target_id FROM af QUALIFY row_number() OVER (PARTITION BY dataset, target_id ORDER BY p DESC, source_id DESC) = 1),
lo AS (SELECT dataset, source_id, target_id FROM te WHERE NOT EXISTS (SELECT 1 FROM pe WHERE pe.dataset = te.dataset AND pe.source_id = te.source_id + 10000000 AND pe.target_id = te.target_id + 10000000)),
rv AS (SELECT DISTINCT 1 AS r, dataset, source_id, target_id FROM pb UNION ALL SELECT DISTINCT 2, dataset, source_id, target_id FROM pa),
rs AS (SELECT lo.dataset, lo.source_id, lo.target_id, count(*) AS n FROM lo JOIN rv ON rv.dataset = lo.dataset AND rv.source_id = lo.source_id + 10000000 AND rv.target_id = lo.target_id + 10000000 GROUP BY ALL)
SELECT dataset, count(*) AS by_any, count(*) FILTER (WHERE n = 2) AS by_every FROM rs GROUP BY dataset"""
)
def u7_rescued_by_rivals(k: Tracks) -> DataFrame:
    back = lambda e: e.select("dataset", (F.col("source_id") - 10_000_000).alias("source_id"), (F.col("target_id") - 10_000_000).alias("target_id"))
    likely = k.affinity.withColumn("_k", F.row_number().over(W.partitionBy("dataset", "target_id").orderBy(F.desc("p"), F.desc("source_id")))).filter("_k = 1")
    r = placing.rescued(k.truth_edges, back(k.links), {"nearest": back(_second(k)), "likely": back(likely)})
    return r.groupBy("dataset").agg(F.count(F.lit(1)).alias("by_any"), F.count_if(F.col("n_rivals") == 2).alias("by_every"))


@query(", he AS (SELECT pt.dataset, pt.t, z, y, x, e.value AS v FROM pt JOIN events e ON e.event_id = pt.node_id WHERE pt.node_id % 3 <> 0) SELECT pn.dataset, pn.node_id, coalesce((SELECT max(v) FROM he WHERE he.dataset = pn.dataset AND he.t = pn.t AND abs(he.z - pn.z) <= 1 AND abs(he.y - pn.y) <= 3 AND abs(he.x - pn.x) <= 3) >= 20.0, true) AS confirmed FROM pn")
def p21_confirmed_centres(k: Tracks) -> DataFrame:
    v = k.table("events").select(F.col("event_id").alias("node_id"), F.col("value").alias("v"))
    heat = k.points.filter("node_id % 3 != 0").join(v, "node_id").select("dataset", "t", "z", "y", "x", "v")
    return placing.confirmed(k.nodes, heat, (1, 3, 3), 20.0).select("dataset", "node_id", "confirmed")


@query(" SELECT dataset, t, (z // 4)::INTEGER AS cz, floor(y / 24)::INTEGER AS cy, floor(x / 24)::INTEGER AS cx, count(*) AS n FROM pn GROUP BY ALL HAVING count(*) > 1")
def p27_lattice_collisions(k: Tracks) -> DataFrame:
    return placing.collisions(k.nodes, (4, 24, 24))


_SHRINK = "round_even(pn.y + f * (tn.y - pn.y), 0)"


@query(" SELECT f AS share, pn.dataset, sum(round_even(pn.z + f * (tn.z - pn.z), 0))::BIGINT AS sz, sum(round_even(pn.y + f * (tn.y - pn.y), 0))::BIGINT AS sy, sum(abs(round_even(pn.y + f * (tn.y - pn.y), 0) - tn.y))::BIGINT AS off FROM pn JOIN tn ON tn.dataset = pn.dataset AND tn.node_id = pn.node_id - 10000000, (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS f) GROUP BY ALL")
def p28_shrunk_to_truth(k: Tracks) -> DataFrame:
    t = k.truth.select("dataset", F.col("node_id").alias("_id"), F.col("y").alias("_y"))
    out = None
    for f in (0.0, 0.5, 1.0):
        s = placing.shrunk(k.nodes, k.truth, k.match, f).withColumn("_id", F.col("node_id") - 10_000_000).join(t, ["dataset", "_id"])
        part = s.groupBy(F.lit(f).alias("share"), "dataset").agg(F.sum("z").alias("sz"), F.sum("y").alias("sy"), F.sum(F.abs(F.col("y") - F.col("_y"))).cast("long").alias("off"))
        out = part if out is None else out.unionByName(part)
    return out


_ARM = """ar AS (SELECT f, pn.dataset, pn.t, pn.node_id, round_even(pn.z + f * (tn.z - pn.z), 0) * 1.625 AS uz, round_even(pn.y + f * (tn.y - pn.y), 0) * 0.40625 AS uy, round_even(pn.x + f * (tn.x - pn.x), 0) * 0.40625 AS ux
  FROM pn JOIN tn ON tn.dataset = pn.dataset AND tn.node_id = pn.node_id - 10000000, (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS f))"""


@query(f", {_ARM}, lk AS (SELECT a.f, a.dataset, a.node_id AS s, b.node_id AS e, {_NEAR} AS d FROM ar a JOIN ar b ON a.f = b.f AND a.dataset = b.dataset AND b.t = a.t + 1 WHERE {_NEAR} <= {GATE} QUALIFY row_number() OVER (PARTITION BY a.f, b.dataset, b.node_id ORDER BY {_NEAR}, a.node_id) = 1) SELECT f AS share, dataset, count(*) AS n_links, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM te WHERE te.dataset = lk.dataset AND te.source_id + 10000000 = s AND te.target_id + 10000000 = e)) AS n_true FROM lk GROUP BY ALL")
def m30_resolved_after_shrinking(k: Tracks) -> DataFrame:
    """Nearest parents after detections were moved to their truth by a share: what localisation costs."""
    from tracelace.functions.geometry import to_um

    out = None
    for f in (0.0, 0.5, 1.0):
        links = repair.nearest_parent(joins.candidates(to_um(placing.shrunk(k.nodes, k.truth, k.match, f)), GATE))
        flag = joins.in_set(links, _truth_pred(k), "source_id", "target_id", "_y")
        part = flag.groupBy(F.lit(f).alias("share"), "dataset").agg(F.count(F.lit(1)).alias("n_links"), F.count_if("_y").alias("n_true"))
        out = part if out is None else out.unionByName(part)
    return out


@query(", e AS (SELECT *, min(uz) OVER (PARTITION BY dataset) AS lo, max(uz) OVER (PARTITION BY dataset) AS hi FROM pn) SELECT dataset, node_id, round(ux + 4.0 * (uz - lo) / (hi - lo), 6) AS ux FROM e")
def p29_sheared(k: Tracks) -> DataFrame:
    return placing.sheared(k.nodes, 4.0).select("dataset", "node_id", r6("ux").alias("ux"))


@query(" SELECT dataset, node_id, (CASE WHEN t % 2 = 0 THEN 15 - z ELSE z END)::INTEGER AS z, (CASE WHEN t % 3 = 0 THEN 105 - y ELSE y END)::INTEGER AS y FROM pt")
def p30_mirrored_by_frame(k: Tracks) -> DataFrame:
    return placing.mirrored(k.points, VOLUME, {"z": F.col("t") % 2 == 0, "y": F.col("t") % 3 == 0}).select("dataset", "node_id", "z", "y")


@query(" SELECT a.dataset, a.node_id AS source_id, b.node_id AS target_id, (('0x' || substr(md5(a.node_id::VARCHAR), 1, 1))::INTEGER % 2 = 1) AS flip, (CASE WHEN ('0x' || substr(md5(a.node_id::VARCHAR), 1, 1))::INTEGER % 2 = 1 THEN 105 - a.y ELSE a.y END)::INTEGER AS ay, (CASE WHEN ('0x' || substr(md5(a.node_id::VARCHAR), 1, 1))::INTEGER % 2 = 1 THEN 105 - b.y ELSE b.y END)::INTEGER AS by FROM te JOIN pt a ON a.dataset = te.dataset AND a.node_id = te.source_id JOIN pt b ON b.dataset = te.dataset AND b.node_id = te.target_id")
def n14_pairs_flipped_alike(k: Tracks) -> DataFrame:
    """Both ends of a pair share the flip that the source's hash draws."""
    p = k.points.select("dataset", "node_id", "y")
    e = k.truth_edges.select("dataset", "source_id", "target_id").join(p.withColumnsRenamed({"node_id": "source_id", "y": "ay"}), ["dataset", "source_id"]).join(p.withColumnsRenamed({"node_id": "target_id", "y": "by"}), ["dataset", "target_id"])
    e = e.withColumn("flip", F.conv(F.substring(F.md5(F.col("source_id").cast("string").cast("binary")), 1, 1), 16, 10).cast("int") % 2 == 1)
    side = lambda c: F.when(F.col("flip"), VOLUME[1] - 1 - F.col(c)).otherwise(F.col(c)).cast("int").alias(c)
    return e.select("dataset", "source_id", "target_id", "flip", side("ay"), side("by"))


@query(", la AS (SELECT dataset, max(t) AS last FROM pt GROUP BY dataset) SELECT pt.dataset, node_id, greatest(0, least(t - 2, last - 4))::INTEGER AS t0, greatest(0, least(z + (node_id * 7) % 5 - 2 - 4, 8))::INTEGER AS z0, greatest(0, least(y + (node_id * 11) % 5 - 2 - 16, 74))::INTEGER AS y0, greatest(0, least(x + (node_id * 13) % 5 - 2 - 16, 74))::INTEGER AS x0 FROM pt JOIN la USING (dataset)")
def n6_crops(k: Tracks) -> DataFrame:
    return placing.crops(k.points.withColumn("_last", F.max("t").over(W.partitionBy("dataset"))), (8, 32, 32), VOLUME, 5, F.col("_last"), 2)


_OFFS = f""", bx AS (SELECT pt.dataset, t, node_id, pt.z + oz AS z, pt.y + oy AS y, pt.x + ox AS x, oz * 1.625 AS mz, oy * 0.40625 AS my, ox * 0.40625 AS mx FROM pt, (SELECT unnest(range(-1, 2)) AS oz), (SELECT unnest(range(-2, 3)) AS oy), (SELECT unnest(range(-2, 3)) AS ox)),
ow AS (SELECT * FROM bx WHERE z BETWEEN 0 AND 15 AND y BETWEEN 0 AND 105 AND x BETWEEN 0 AND 105 QUALIFY row_number() OVER (PARTITION BY dataset, t, z, y, x ORDER BY sqrt(mz * mz + my * my + mx * mx), node_id) = 1)"""


@query(_OFFS + ", e AS (SELECT dataset, t, avg(abs(mz) + abs(my) + abs(mx)) AS e, count(*) AS n FROM ow GROUP BY ALL) SELECT dataset, count(*) AS n_frames, sum(n)::BIGINT AS n_voxels, round(avg(e), 6) AS loss FROM e GROUP BY dataset")
def n13_offset_target_and_loss(k: Tracks) -> DataFrame:
    """The offset target of every voxel near a point, and what a prediction of no offset loses against it."""
    target = losses.offset_targets(k.points, (1, 2, 2), VOLUME, (1.625, 0.40625, 0.40625))
    none = target.select("dataset", "t", "z", "y", "x", *[F.lit(0.0).alias(f"p{c}") for c in "zyx"]).filter("false")
    return losses.offset_loss(target, none).select("dataset", "n_frames", "n_voxels", r6("loss").alias("loss"))


@query(
    f""", d AS (SELECT pn.*, min(t) OVER (PARTITION BY dataset) AS t0, max(t) OVER (PARTITION BY dataset) AS t1, least(uz, 24.375 - uz, uy, 42.65625 - uy, ux, 42.65625 - ux) AS face FROM pn),
s AS (SELECT d.*, NOT EXISTS (SELECT 1 FROM pe WHERE pe.dataset = d.dataset AND pe.target_id = d.node_id) AS birth, NOT EXISTS (SELECT 1 FROM pe WHERE pe.dataset = d.dataset AND pe.source_id = d.node_id) AS death FROM d)
SELECT dataset, count(*) FILTER (WHERE birth) AS births, count(*) FILTER (WHERE death) AS deaths, round(avg((t = t0 OR face <= 3.0)::INTEGER) FILTER (WHERE birth), 6) AS birth_explained, round(avg((t = t0)::INTEGER) FILTER (WHERE birth), 6) AS birth_first_frame,
  round(avg((t = t1 OR face <= 3.0)::INTEGER) FILTER (WHERE death), 6) AS death_explained, round(avg((t = t1)::INTEGER) FILTER (WHERE death), 6) AS death_last_frame, round(median((face - 3.0) / 3.0) FILTER (WHERE birth AND NOT (t = t0 OR face <= 3.0)), 6) AS interior_depth FROM s GROUP BY dataset"""
)
def q14_boundaries_explained(k: Tracks) -> DataFrame:
    out = placing.boundary_census(k.nodes, k.links, (15 * 1.625, 105 * 0.40625, 105 * 0.40625), 3.0)
    return out.select("dataset", "births", "deaths", *[r6(c).alias(c) for c in out.columns[3:]])


@query(
    """, o1 AS (SELECT dataset, source_id, min(target_id) AS nx FROM pe GROUP BY ALL HAVING count(*) = 1), i1 AS (SELECT dataset, target_id, min(source_id) AS pv FROM pe GROUP BY ALL HAVING count(*) = 1),
wf AS (SELECT dataset, node_id, node_id AS at, 0 AS dt FROM pn UNION ALL SELECT wf.dataset, wf.node_id, nx, dt + 1 FROM wf JOIN o1 ON o1.dataset = wf.dataset AND o1.source_id = wf.at WHERE dt < 3),
wb AS (SELECT dataset, node_id, node_id AS at, 0 AS dt FROM pn UNION ALL SELECT wb.dataset, wb.node_id, pv, dt - 1 FROM wb JOIN i1 ON i1.dataset = wb.dataset AND i1.target_id = wb.at WHERE dt > -3),
w0 AS (SELECT * FROM wf UNION ALL SELECT * FROM wb WHERE dt < 0),
fi AS (SELECT w0.dataset, w0.node_id, count(*) AS n, regr_intercept(b.z::DOUBLE, dt::DOUBLE) AS fz, regr_intercept(b.y::DOUBLE, dt::DOUBLE) AS fy, regr_intercept(b.x::DOUBLE, dt::DOUBLE) AS fx FROM w0 JOIN pn b ON b.dataset = w0.dataset AND b.node_id = w0.at GROUP BY ALL)
SELECT pn.dataset, pn.node_id, round(CASE WHEN n >= 3 THEN 0.4 * pn.z + 0.6 * fz ELSE pn.z END, 6) AS z, round(CASE WHEN n >= 3 THEN 0.4 * pn.y + 0.6 * fy ELSE pn.y END, 6) AS y, round(CASE WHEN n >= 3 THEN 0.4 * pn.x + 0.6 * fx ELSE pn.x END, 6) AS x FROM pn JOIN fi USING (dataset, node_id)"""
)
def w22_line_fitted(k: Tracks) -> DataFrame:
    return placing.line_fitted(k.nodes, k.links, 3, 0.6).select("dataset", "node_id", *[r6(c).alias(c) for c in "zyx"])


@query(" SELECT dataset, round(quantile_cont(p, 0.1), 6) AS p10, round(median(p), 6) AS p50, round(quantile_cont(p, 0.9), 6) AS p90, round(avg((p >= 0.5)::INTEGER), 6) AS decisive FROM af GROUP BY dataset")
def a27_ranker_distribution(k: Tracks) -> DataFrame:
    q = F.percentile("p", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return k.affinity.groupBy("dataset").agg(q.alias("q"), r6(F.avg((F.col("p") >= 0.5).cast("int"))).alias("decisive")).select("dataset", *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(("p10", "p50", "p90"))], "decisive")


@query(_ROOT + ", v AS (SELECT dataset, component, count(*)::DOUBLE AS v FROM co GROUP BY ALL), m AS (SELECT *, median(v) OVER (PARTITION BY dataset) AS v0 FROM v) SELECT dataset, CASE WHEN v < 0.5 * v0 THEN 'fragment' WHEN v <= 1.5 * v0 THEN 'single' ELSE 'merged' END AS band, count(*) AS n, round(sum(v) / any_value(tot), 6) AS share FROM m JOIN (SELECT dataset, sum(v) AS tot FROM v GROUP BY dataset) USING (dataset) GROUP BY ALL")
def a36_mass_by_volume_band(k: Tracks) -> DataFrame:
    v = repair.labelled(k.nodes, k.links).groupBy("dataset", "component").agg(F.count(F.lit(1)).cast("double").alias("v"))
    mid = v.groupBy("dataset").agg(F.median("v").alias("_v0"), F.sum("v").alias("_all"))
    band = F.when(F.col("v") < 0.5 * F.col("_v0"), "fragment").when(F.col("v") <= 1.5 * F.col("_v0"), "single").otherwise("merged")
    return v.join(mid, "dataset").groupBy("dataset", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("v") / F.first("_all")).alias("share"))


@query(", s AS (SELECT pn.dataset, pn.t, pn.node_id, e.value AS score, pn.node_id % 5 <> 0 AS matched FROM pn JOIN events e ON e.event_id = pn.node_id - 10000000), r AS (SELECT *, row_number() OVER (PARTITION BY dataset, t ORDER BY matched DESC, score DESC, node_id) AS k FROM s) SELECT dataset, t, node_id, matched FROM r WHERE matched OR k <= 30")
def t6_hardest_unmatched(k: Tracks) -> DataFrame:
    score = k.table("events").select((F.col("event_id") + 10_000_000).alias("node_id"), F.col("value").alias("score"))
    match = k.match.filter("pred_id % 5 != 0")
    return sampling.hardest(k.nodes.select("dataset", "t", "node_id").join(score, "node_id"), match, 30).select("dataset", "t", "node_id", "matched")


@query("SELECT user_id, arg_max(event_id, {'v': value, 'e': event_id}) AS best, max(value) AS value FROM events GROUP BY user_id", base=False)
def t13_best_checkpoint(k: Tracks) -> DataFrame:
    m = F.max(F.struct("value", "event_id"))
    return k.table("events").groupBy("user_id").agg(m.alias("m")).select("user_id", F.col("m.event_id").alias("best"), F.col("m.value").alias("value"))


_EMB = """, em AS (SELECT pn.dataset, pn.t, pn.node_id, list_transform(v.embedding, lambda z: z::DOUBLE / greatest(sqrt(list_sum(list_transform(v.embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12)) AS e FROM pn JOIN embeddings v ON v.vec_id = pn.node_id % (SELECT count(*) FROM embeddings)),
si AS (SELECT a.dataset, a.t, a.node_id AS source_id, b.node_id AS target_id, list_dot_product(a.e, b.e) / 0.1 AS s FROM em a JOIN em b ON b.dataset = a.dataset AND b.t = a.t + 1),
tr AS (SELECT DISTINCT dataset, source_id + 10000000 AS source_id, target_id + 10000000 AS target_id FROM te),
sy AS (SELECT si.*, tr.source_id IS NOT NULL AS y FROM si LEFT JOIN tr USING (dataset, source_id, target_id)),
lp AS (SELECT *, s - ln(sum(exp(s)) OVER (PARTITION BY dataset, source_id)) AS l FROM sy),
nc AS (SELECT dataset, count(*) AS n, avg(x) AS loss FROM (SELECT dataset, source_id, avg(-l) FILTER (WHERE y) AS x FROM lp GROUP BY ALL) WHERE x IS NOT NULL GROUP BY dataset)"""


def _embedded(k: Tracks) -> DataFrame:
    e = k.table("embeddings")
    n = e.count()
    at = k.nodes.select("dataset", "node_id", "t", (F.col("node_id") % n).alias("vec_id"))
    return at.join(e.select("vec_id", F.col("embedding").alias("e")), "vec_id").select("dataset", "node_id", "t", "e")


@query(_EMB + " SELECT dataset, n, round(loss, 5) AS loss FROM nc")
def loss_info_nce_on_embeddings(k: Tracks) -> DataFrame:
    return losses.info_nce(_embedded(k), _truth_pred(k), 0.1).withColumn("loss", F.round("loss", 5))


_DECOY = """, dx AS (SELECT dataset, source_id, target_id, row_number() OVER (PARTITION BY dataset, source_id ORDER BY d, target_id) AS k FROM ca WHERE EXISTS (SELECT 1 FROM tr WHERE tr.dataset = ca.dataset AND tr.source_id = ca.source_id) AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.dataset = ca.dataset AND tr.source_id = ca.source_id AND tr.target_id = ca.target_id)),
ot AS (SELECT dataset, source_id, max(s) AS st FROM sy WHERE y GROUP BY ALL),
mg AS (SELECT dataset, avg(greatest(s - st, 0) + ln(1 + exp(-abs(s - st)))) AS margin FROM dx JOIN si USING (dataset, source_id, target_id) JOIN ot USING (dataset, source_id) WHERE k <= 2 GROUP BY dataset)"""


@query(_EMB + _DECOY + " SELECT dataset, n, round(loss, 5) AS nce, round(margin, 5) AS margin FROM nc LEFT JOIN mg USING (dataset)")
def loss_centre_contrastive(k: Tracks) -> DataFrame:
    decoys = sampling.hard_negatives(k.candidates, _truth_pred(k), 2)
    out = losses.contrastive(_embedded(k), _truth_pred(k), decoys, 0.1)
    return out.select("dataset", "n", F.round("nce", 5).alias("nce"), F.round("margin", 5).alias("margin"))


@query(
    _ACT.replace(", ac AS", ", unused AS")
    + """, lg AS (SELECT ca.dataset, ca.source_id, ca.target_id, -d AS s, tr.source_id IS NOT NULL AS y FROM ca LEFT JOIN (SELECT DISTINCT * FROM tr) tr USING (dataset, source_id, target_id)), sl AS (SELECT dataset, avg(s) AS slack FROM lg GROUP BY dataset),
pr AS (SELECT lg.dataset, y, slack, exp(s) / (sum(exp(s)) OVER (PARTITION BY lg.dataset, target_id) + exp(slack)) AS p FROM lg JOIN sl USING (dataset))
SELECT dataset, round(any_value(slack), 6) AS slack, round(avg(CASE WHEN y THEN -power(1 - p, 2) * ln(greatest(p, 1e-12)) ELSE -power(p, 2) * ln(greatest(1 - p, 1e-12)) END), 6) AS loss FROM pr GROUP BY dataset"""
)
def loss_slack_row(k: Tracks) -> DataFrame:
    out = losses.slack_row(k.candidates.select("dataset", "source_id", "target_id", (-F.col("d")).alias("s")), _truth_pred(k))
    return out.select("dataset", r6("slack").alias("slack"), r6("loss").alias("loss"))


_PHI = "3.8832220774509332"


@query(
    f"""WITH v AS (SELECT a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
k AS (SELECT unnest(range(1, 9)) AS k), dr AS (SELECT k, list_transform(range(1, 65), lambda i: cos(i * k * {_PHI}::DOUBLE)) AS r FROM k), dn AS (SELECT k, list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS u FROM dr),
e AS (SELECT a AS e FROM v UNION ALL SELECT b FROM v), p AS (SELECT k, list_dot_product(list_transform(e, lambda x: x::DOUBLE), u) AS p FROM e, dn), f AS (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS f),
c AS (SELECT k, f, avg(cos(p * f)) AS re, avg(sin(p * f)) AS im FROM p, f GROUP BY ALL), g AS (SELECT avg((re - exp(-0.5 * f * f)) * (re - exp(-0.5 * f * f)) + im * im) AS gaussianity FROM c),
i AS (SELECT avg(list_sum(list_transform(list_zip(a, b), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS invariance FROM v)
SELECT round(invariance, 5) AS invariance, round(gaussianity, 5) AS gaussianity, round(invariance + 0.1 * gaussianity, 5) AS total FROM i, g""",
    base=False,
)
def loss_sigreg(k: Tracks) -> DataFrame:
    e = k.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    views = e.filter("vec_id % 2 = 0").select("vec_id", F.col("e").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("b")), "vec_id")
    return losses.sigreg(views.select("a", "b"), 8, (0.5, 1.0, 2.0), 0.1).select(*[F.round(c, 5).alias(c) for c in ("invariance", "gaussianity", "total")])


@query(
    _ACT.replace(", ac AS", ", unused AS")
    + """, y AS (SELECT ca.dataset, t, source_id, tr.source_id IS NOT NULL AS y, row_number() OVER (PARTITION BY ca.dataset, source_id ORDER BY d, target_id) AS k FROM ca LEFT JOIN (SELECT DISTINCT * FROM tr) tr USING (dataset, source_id, target_id)),
o AS (SELECT dataset, t, source_id, bool_or(y AND k = 1) AS first FROM y GROUP BY ALL HAVING bool_or(y)) SELECT dataset, t, count(*) AS n_sources, round(avg((NOT first)::INTEGER), 6) AS difficulty FROM o GROUP BY ALL"""
)
def loss_pair_difficulty(k: Tracks) -> DataFrame:
    return losses.pair_difficulty(k.candidates, _truth_pred(k)).withColumn("difficulty", r6("difficulty"))


@query(
    """, s AS (SELECT pt.dataset, user_id, pt.t, pt.node_id, uz, uy, ux FROM pt JOIN tn ON tn.node_id = pt.node_id AND tn.dataset = pt.dataset),
l AS (SELECT *, uz - lag(uz) OVER w AS z1, uy - lag(uy) OVER w AS y1, ux - lag(ux) OVER w AS x1, lag(uz) OVER w - lag(uz, 2) OVER w AS z2, lag(uy) OVER w - lag(uy, 2) OVER w AS y2, lag(ux) OVER w - lag(ux, 2) OVER w AS x2,
  lag(uz, 2) OVER w - lag(uz, 3) OVER w AS z3, lag(uy, 2) OVER w - lag(uy, 3) OVER w AS y3, lag(ux, 2) OVER w - lag(ux, 3) OVER w AS x3, lead(uz) OVER w AS nz, lead(uy) OVER w AS ny, lead(ux) OVER w AS nx FROM s WINDOW w AS (PARTITION BY dataset, user_id ORDER BY t)),
m AS (SELECT dataset, nz - uz AS dz, ny - uy AS dy, nx - ux AS dx, (z1 + coalesce(z2, 0) + coalesce(z3, 0)) / (1 + (z2 IS NOT NULL)::INTEGER + (z3 IS NOT NULL)::INTEGER) AS vz, (y1 + coalesce(y2, 0) + coalesce(y3, 0)) / (1 + (z2 IS NOT NULL)::INTEGER + (z3 IS NOT NULL)::INTEGER) AS vy,
  (x1 + coalesce(x2, 0) + coalesce(x3, 0)) / (1 + (z2 IS NOT NULL)::INTEGER + (z3 IS NOT NULL)::INTEGER) AS vx FROM l WHERE z1 IS NOT NULL AND nz IS NOT NULL)
SELECT dataset, count(*) AS n, round(avg(sqrt((dz - vz) * (dz - vz) + (dy - vy) * (dy - vy) + (dx - vx) * (dx - vx))), 6) AS error FROM m GROUP BY dataset"""
)
def q16_three_step_prediction(k: Tracks) -> DataFrame:
    """The next step foretold by the mean of up to three steps before."""
    from tracelace.functions.geometry import norm, to_um

    w = W.partitionBy("dataset", "user_id").orderBy("t")
    s = to_um(k.points)
    lagged = {f"{a}{i}": F.lag(f"u{a}", i - 1).over(w) - F.lag(f"u{a}", i).over(w) if i > 1 else F.col(f"u{a}") - F.lag(f"u{a}").over(w) for a in "zyx" for i in (1, 2, 3)}
    m = s.withColumns(lagged | {f"n{a}": F.lead(f"u{a}").over(w) for a in "zyx"}).filter("z1 is not null and nz is not null")
    n = 1 + F.col("z2").isNotNull().cast("int") + F.col("z3").isNotNull().cast("int")
    v = {a: (F.col(f"{a}1") + F.coalesce(f"{a}2", F.lit(0.0)) + F.coalesce(f"{a}3", F.lit(0.0))) / n for a in "zyx"}
    return m.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(norm(*[F.col(f"n{a}") - F.col(f"u{a}") - v[a] for a in "zyx"]))).alias("error"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 2 HOUR)::TIMESTAMP AS "end", count(*) AS n FROM n GROUP BY user_id, k""",
    base=False,
)
def z5_sessions(k: Tracks) -> DataFrame:
    out = frames.drained(frames.sessions(_stream(k), "2 hours", "10 minutes"), "stream-sessions", "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT (w + INTERVAL (30 * i) MINUTE)::TIMESTAMP AS start, event_type, count(*) AS n, sum(trunc(value * 100)::BIGINT)::BIGINT AS cents FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts::TIMESTAMP) - INTERVAL 30 MINUTE AS w FROM events), (SELECT unnest([0, 1]) AS i) GROUP BY ALL", base=False)
def z4_sliding_windows(k: Tracks) -> DataFrame:
    out = frames.windowed_counts(_stream(k), "1 hour", "30 minutes", "10 minutes")
    return frames.drained(out, "stream-sliding", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(" SELECT dataset, min(t) AS first, max(t) AS last, count(*) AS n FROM pn WHERE t BETWEEN 10 AND 19 AND z BETWEEN 4 AND 11 AND y BETWEEN 20 AND 83 AND x BETWEEN 20 AND 83 GROUP BY dataset")
def s3_sub_volume(k: Tracks) -> DataFrame:
    """Points of a window of frames and a box of voxels: the predicates reach the scan of the written points."""
    held = k.nodes.filter("t between 10 and 19 and z between 4 and 11 and y between 20 and 83 and x between 20 and 83")
    return held.groupBy("dataset").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))
