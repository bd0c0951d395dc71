"""Gap closing, cytokinesis and the output chain over the track tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelace.operators import joins, recovery
from tracelace.plans.registry import query, r6
from tracelace.sources.tracks import Tracks

GAPS = recovery.GapClose(base=4.0, gain=0.25, most_delta=1.0)
STRICT = recovery.StrictGap(most_share=0.02, frame_share=0.3)
PARTING = recovery.Cytokinesis(least_nodes=10, parent_gate=9.0, least_sister=3.0, most_sister=13.5, border=(2.0, 90.0), least_track=4, least_divergence=-1.0, least_angle=70.0)


def _length(parts: list[str]) -> str:
    return "sqrt(" + " + ".join(f"({p}) * ({p})" for p in parts) + ")"


def _dot(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"({x}) * ({y})" for x, y in zip(a, b, strict=True)) + ")"


def _apart(a: str, b: str) -> str:
    return _length([f"{a}.u{c} - {b}.u{c}" for c in "zyx"])


_LINKS = ", tl AS (SELECT * FROM pe WHERE target_id % 4 <> 0)"
_OPEN = "NOT EXISTS (SELECT 1 FROM tl WHERE tl.dataset = a.dataset AND tl.source_id = a.node_id) AND NOT EXISTS (SELECT 1 FROM tl WHERE tl.dataset = b.dataset AND tl.target_id = b.node_id)"
_LOCAL = f""", nb AS (SELECT a.dataset, a.node_id, {_apart("a", "b")} AS d, b.node_id AS other_id FROM pn a JOIN pn b ON a.dataset = b.dataset AND a.t = b.t AND a.node_id <> b.node_id),
kn AS (SELECT *, row_number() OVER (PARTITION BY dataset, node_id ORDER BY d, other_id) AS rank FROM nb QUALIFY rank <= {GAPS.neighbours}),
lo AS (SELECT dataset, node_id, list(d ORDER BY d) AS l FROM kn GROUP BY ALL),
ls AS (SELECT pn.*, coalesce((l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2, {GAPS.reference}::DOUBLE) AS local FROM pn LEFT JOIN lo USING (dataset, node_id))"""
_GAPS = f"""{_LINKS}{_LOCAL}, gp AS (SELECT a.dataset, a.t, a.node_id AS end_id, b.node_id AS start_id, {_apart("a", "b")} AS d,
  2 * {GAPS.base}::DOUBLE + 2 * greatest({-GAPS.most_delta}::DOUBLE, least({GAPS.most_delta}::DOUBLE, {GAPS.gain}::DOUBLE * (0.5::DOUBLE * (a.local + b.local) - {GAPS.reference}::DOUBLE))) AS gate
  FROM ls a JOIN ls b ON a.dataset = b.dataset AND b.t = a.t + 2 WHERE {_OPEN}),
gg AS (SELECT *, d <= 2 * {GAPS.base}::DOUBLE AS in_base, d <= gate AS allowed FROM gp WHERE d <= 2 * ({GAPS.base}::DOUBLE + {GAPS.most_delta}::DOUBLE))"""


def _links(k: Tracks) -> DataFrame:
    return k.links.filter("target_id % 4 != 0")


@query(_LOCAL + " SELECT dataset, node_id, rank::INTEGER AS rank, other_id, round(d, 6) AS d FROM kn")
def j3_three_nearest(k: Tracks) -> DataFrame:
    return joins.k_nearest(k.nodes, GAPS.neighbours).withColumn("d", r6("d"))


@query(_LOCAL + " SELECT dataset, node_id, round(local, 6) AS local FROM ls")
def r11_local_spacing(k: Tracks) -> DataFrame:
    return recovery.local_spacing(k.nodes, GAPS.neighbours, GAPS.reference).withColumn("local", r6("local"))


@query(_GAPS + " SELECT dataset, t, end_id, start_id, round(d, 6) AS d, round(gate, 6) AS gate, in_base, allowed FROM gg")
def r11_gap_proposals(k: Tracks) -> DataFrame:
    return recovery.gap_proposals(k.nodes, _links(k), GAPS).withColumns({"d": r6("d"), "gate": r6("gate")})


@query(_GAPS + " SELECT dataset, count(*) FILTER (WHERE allowed) AS n_allowed, count(*) FILTER (WHERE allowed AND NOT in_base) AS n_expanded, count(*) FILTER (WHERE in_base AND NOT allowed) AS n_restricted FROM gg GROUP BY dataset")
def r11_gates_moved(k: Tracks) -> DataFrame:
    p = recovery.gap_proposals(k.nodes, _links(k), GAPS)
    return p.groupBy("dataset").agg(F.count_if("allowed").alias("n_allowed"), F.count_if(F.expr("allowed and not in_base")).alias("n_expanded"), F.count_if(F.expr("in_base and not allowed")).alias("n_restricted"))


@query()
def r11_gap_closer(k: Tracks) -> DataFrame:
    return recovery.close_gaps(k.nodes, _links(k), GAPS).edges


@query()
def r11_gap_counters(k: Tracks) -> DataFrame:
    return recovery.close_gaps(k.nodes, _links(k), GAPS).counters()


_P, _S, _STEP = [f"a.u{c} - p.u{c}" for c in "zyx"], [f"s.u{c} - b.u{c}" for c in "zyx"], [f"(b.u{c} - a.u{c}) / 3" for c in "zyx"]


def _side(move: list[str], name: str) -> str:
    change = _length([f"({m}) - ({x})" for m, x in zip(move, _STEP, strict=True)])
    return f"{_dot(move, _STEP)} / ({_length(move)} * {_length(_STEP)} + 1e-9) AS cos_{name}, {change} AS change_{name}, {_length(move)} <= 0.01::DOUBLE OR {_length(_STEP)} <= 0.01::DOUBLE AS still_{name}"


def _fits(name: str) -> str:
    return f"coalesce(still_{name} OR (cos_{name} > {STRICT.least_cosine}::DOUBLE AND change_{name} <= {STRICT.most_change}::DOUBLE), false)"


def _short(name: str) -> str:
    return f"coalesce(CASE WHEN still_{name} THEN 0 ELSE greatest(0, 0.25::DOUBLE - cos_{name}) END, 0)"


_STRICT = f"""{_LINKS}, bf AS (SELECT tl.dataset, target_id AS node_id, pn.uz, pn.uy, pn.ux FROM (SELECT dataset, target_id, min(source_id) AS o FROM tl GROUP BY ALL HAVING count(*) = 1) tl JOIN pn ON pn.dataset = tl.dataset AND pn.node_id = o),
af2 AS (SELECT tl.dataset, source_id AS node_id, pn.uz, pn.uy, pn.ux FROM (SELECT dataset, source_id, min(target_id) AS o FROM tl GROUP BY ALL HAVING count(*) = 1) tl JOIN pn ON pn.dataset = tl.dataset AND pn.node_id = o),
en AS (SELECT dataset, t, count(*) AS n FROM pn a WHERE NOT EXISTS (SELECT 1 FROM tl WHERE tl.dataset = a.dataset AND tl.source_id = a.node_id) GROUP BY ALL),
ec AS (SELECT dataset, least({STRICT.most_links}, greatest(1, round_even(count(*) * {STRICT.most_share}::DOUBLE, 0)::INTEGER)) AS cap FROM tl GROUP BY dataset),
sp AS (SELECT a.dataset, a.t, a.node_id AS end_id, b.node_id AS start_id, {_apart("a", "b")} AS d, {_side(_P, "p")}, {_side(_S, "s")}
  FROM pn a JOIN pn b ON a.dataset = b.dataset AND b.t = a.t + 3 LEFT JOIN bf p ON p.dataset = a.dataset AND p.node_id = a.node_id LEFT JOIN af2 s ON s.dataset = b.dataset AND s.node_id = b.node_id WHERE {_OPEN}),
st AS (SELECT dataset, t, end_id, start_id, d, {_short("p")} + {_short("s")} AS penalty FROM sp WHERE d <= {STRICT.most_total}::DOUBLE AND d / 3 <= {STRICT.most_step}::DOUBLE AND ({_fits("p")} OR {_fits("s")}))"""


@query(_STRICT + f" SELECT dataset, t, end_id, start_id, round(d, 6) AS d, round(penalty, 6) AS penalty, round(d + 2 * penalty, 6) AS score, greatest(1, round_even(n * {STRICT.frame_share}::DOUBLE, 0)::INTEGER) AS frame_cap, cap FROM st JOIN en USING (dataset, t) JOIN ec USING (dataset)")
def r10_strict_proposals(k: Tracks) -> DataFrame:
    return recovery.strict_proposals(k.nodes, _links(k), STRICT).withColumns({c: r6(c) for c in ("d", "penalty", "score")})


@query()
def r10_strict_gap2(k: Tracks) -> DataFrame:
    return recovery.strict_gaps(k.nodes, _links(k), STRICT).edges


_C = PARTING
_V1, _V2 = [f"b.u{c} - a.u{c}" for c in "zyx"], [f"c.u{c} - a.u{c}" for c in "zyx"]
_CYTO = f"""{_LINKS}, si AS (SELECT dataset, source_id AS node_id, min(target_id) AS nxt FROM tl GROUP BY ALL HAVING count(*) = 1),
l1 AS (SELECT dataset, node_id, nxt FROM si), l2 AS (SELECT x.dataset, x.node_id, y.nxt FROM l1 x JOIN si y ON x.dataset = y.dataset AND y.node_id = x.nxt),
l3 AS (SELECT x.dataset, x.node_id, y.nxt FROM l2 x JOIN si y ON x.dataset = y.dataset AND y.node_id = x.nxt),
og AS (SELECT * FROM pn a WHERE NOT EXISTS (SELECT 1 FROM tl WHERE tl.dataset = a.dataset AND tl.target_id = a.node_id)),
nr AS (SELECT b.dataset, b.node_id AS kept_id, c.node_id AS target_id, {_apart("b", "c")} AS sister FROM (SELECT DISTINCT dataset, nxt FROM si) k JOIN pn b ON b.dataset = k.dataset AND b.node_id = k.nxt JOIN og c ON c.dataset = b.dataset AND c.t = b.t
  QUALIFY row_number() OVER (PARTITION BY b.dataset, b.node_id ORDER BY {_apart("b", "c")}, c.node_id) = 1),
cy AS (SELECT a.dataset, a.t, a.node_id AS source_id, kept_id, target_id, sister, degrees(acos(greatest(-1, least(1, {_dot(_V1, _V2)} / ({_length(_V1)} * {_length(_V2)} + 1e-6))))) AS angle,
  {_apart("m", "n")} - sister AS parted, {_length(_V1)} AS d1, {_length(_V2)} AS d2, greatest(a.y, b.y, c.y, a.x, b.x, c.x) AS high, least(a.y, b.y, c.y, a.x, b.x, c.x) AS low
  FROM pn a JOIN si ON si.dataset = a.dataset AND si.node_id = a.node_id JOIN nr ON nr.dataset = a.dataset AND nr.kept_id = si.nxt JOIN pn b ON b.dataset = a.dataset AND b.node_id = kept_id JOIN pn c ON c.dataset = a.dataset AND c.node_id = target_id
  JOIN l3 x ON x.dataset = a.dataset AND x.node_id = kept_id JOIN l3 y ON y.dataset = a.dataset AND y.node_id = target_id JOIN si p ON p.dataset = a.dataset AND p.node_id = kept_id JOIN si q ON q.dataset = a.dataset AND q.node_id = target_id
  JOIN pn m ON m.dataset = a.dataset AND m.node_id = p.nxt JOIN pn n ON n.dataset = a.dataset AND n.node_id = q.nxt
  WHERE b.t = a.t + 1 AND c.t = a.t + 1 AND (SELECT count(*) FROM pn z WHERE z.dataset = a.dataset) >= {_C.least_nodes})"""


@query(_CYTO + f" SELECT dataset, t, source_id, kept_id, target_id, round(sister, 6) AS sister, round(angle, 6) AS angle FROM cy WHERE greatest(d1, d2) <= {_C.parent_gate}::DOUBLE AND sister BETWEEN {_C.least_sister}::DOUBLE AND {_C.most_sister}::DOUBLE AND low >= {_C.border[0]} AND high <= {_C.border[1]} AND parted >= {_C.least_divergence}::DOUBLE AND angle >= {_C.least_angle}::DOUBLE")
def r14_cytokinesis_rescue(k: Tracks) -> DataFrame:
    return recovery.cytokinesis(k.nodes, _links(k), PARTING).withColumns({"sister": r6("sister"), "angle": r6("angle")})


_FORK = f""", fk AS (SELECT pe.dataset, pe.source_id, pe.target_id, pe.d, p, row_number() OVER (PARTITION BY pe.dataset, pe.source_id ORDER BY p DESC, pe.d, pe.edge_seq) AS r, b.uz, b.uy, b.ux
  FROM pe JOIN af ON af.dataset = pe.dataset AND af.source_id = pe.source_id AND af.target_id = pe.target_id JOIN pn b ON b.dataset = pe.dataset AND b.node_id = pe.target_id),
fv AS (SELECT a.dataset, a.source_id, greatest(a.d, b.d) <= 6 AND {_apart("a", "b")} <= 7 AS good FROM fk a JOIN fk b ON a.dataset = b.dataset AND a.source_id = b.source_id AND a.r = 1 AND b.r = 2)"""


@query(_FORK + " SELECT fk.dataset, source_id, target_id FROM fk LEFT JOIN fv USING (dataset, source_id) WHERE r <= CASE WHEN good THEN 2 ELSE 1 END")
def r13_fork_geometry(k: Tracks) -> DataFrame:
    e = k.links.join(k.affinity.select("dataset", "source_id", "target_id", "p"), ["dataset", "source_id", "target_id"])
    return recovery.fork_geometry(k.nodes, e, 6.0, 7.0).select("dataset", "source_id", "target_id")


@query()
def r13_output_counters(k: Tracks) -> DataFrame:
    """The whole chain over links with their probabilities, a quarter of which is missing."""
    e = _links(k).join(k.affinity.select("dataset", "source_id", "target_id", "p"), ["dataset", "source_id", "target_id"])
    knobs = recovery.OutputFilter(longest=9.0, gaps=GAPS, strict=STRICT, safe=(10.0, 14.0, 14.0, -2.0, 0.2, 0.02), fork=(9.0, 8.0))
    return recovery.output_filter(k.nodes, e, knobs).counters()
