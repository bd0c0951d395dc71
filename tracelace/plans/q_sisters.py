"""Second daughters by affinity: the runner-up, every orphan, and those that another parent holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelace.operators import forks, sisters
from tracelace.plans.registry import query, r6
from tracelace.sources.tracks import Tracks

#: Gates in micrometres of parent, sister and kept child, the margin of a steal, forks as a share of edges.
_GATES, _MARGIN, _SHARE = (10.0, 14.0, 10.0), -0.2, 0.02

_AT = "sqrt(({0}.uz - {1}.uz) * ({0}.uz - {1}.uz) + ({0}.uy - {1}.uy) * ({0}.uy - {1}.uy) + ({0}.ux - {1}.ux) * ({0}.ux - {1}.ux))"


def _sql(offered: str, cost: str, links: str, more: str = "") -> str:
    """Offered forks (dataset, parent_id, kept_id, child_id, p, taken_from) within the gates, each child once, up to the cap."""
    return f""", sg AS (SELECT dataset, source_id AS parent_id, min(target_id) AS kept_id FROM {links} GROUP BY ALL HAVING count(*) = 1), ofr AS ({offered}),
gt AS (SELECT o.*, a.t, {_AT.format("a", "b")} AS d_parent, {_AT.format("q", "b")} AS d_sister, {_AT.format("a", "q")} AS d_kept FROM ofr o JOIN pn a ON a.dataset = o.dataset AND a.node_id = parent_id JOIN pn q ON q.dataset = o.dataset AND q.node_id = kept_id JOIN pn b ON b.dataset = o.dataset AND b.node_id = child_id AND b.t = a.t + 1),
co AS (SELECT *, {cost} AS cost FROM gt WHERE d_parent <= {_GATES[0]} AND d_sister <= {_GATES[1]} AND d_kept <= {_GATES[2]}),
o1 AS (SELECT * FROM co QUALIFY row_number() OVER (PARTITION BY dataset, child_id ORDER BY cost, parent_id) = 1),
cp AS (SELECT dataset, least(n, round_even(e * {_SHARE}::DOUBLE, 0)::BIGINT) AS cap FROM (SELECT dataset, 40::BIGINT AS n FROM pn GROUP BY dataset) JOIN (SELECT dataset, count(*) AS e FROM {links} GROUP BY dataset) USING (dataset))
SELECT dataset, t, parent_id, kept_id, child_id{more}, rank::INTEGER AS rank, round(cost, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY cost, parent_id, child_id) AS rank FROM o1) JOIN cp USING (dataset) WHERE rank <= cap"""


def _taken(k: Tracks, links: DataFrame, candidacy: str, cost, **settings) -> DataFrame:
    found = sisters.proposals(k.nodes, links, k.affinity, candidacy, *_GATES, **settings)
    taken = sisters.admitted(found, cost, sisters.budget(k.nodes, links, 40, _SHARE))
    return taken.select("dataset", "t", "parent_id", "kept_id", "child_id", "taken_from", "rank", r6("cost").alias("cost"))


_TL = ", tl AS (SELECT * FROM pe WHERE target_id % 4 <> 0)"
_RUNNER = """SELECT dataset, parent_id, kept_id, child_id, p, NULL::BIGINT AS taken_from FROM (SELECT dataset, source_id AS parent_id, target_id AS child_id, p, row_number() OVER w AS r, first_value(target_id) OVER w AS top, first_value(p) OVER w AS tp FROM af WINDOW w AS (PARTITION BY dataset, source_id ORDER BY p DESC, target_id)) JOIN sg USING (dataset, parent_id)
  WHERE r = 2 AND top = kept_id AND tp >= 0.3::DOUBLE AND p >= 0.1::DOUBLE AND NOT EXISTS (SELECT 1 FROM tl WHERE tl.dataset = sg.dataset AND tl.target_id = child_id)"""
_ORPHANS = """SELECT sg.dataset, parent_id, kept_id, b.node_id AS child_id, coalesce(p, 0) AS p, NULL::BIGINT AS taken_from FROM sg JOIN pn x ON x.dataset = sg.dataset AND x.node_id = parent_id JOIN pn b ON b.dataset = sg.dataset AND b.t = x.t + 1 LEFT JOIN af ON af.dataset = sg.dataset AND af.source_id = parent_id AND af.target_id = b.node_id WHERE NOT EXISTS (SELECT 1 FROM tl WHERE tl.dataset = b.dataset AND tl.target_id = b.node_id)"""
_HELD = f"""SELECT af.dataset, parent_id, kept_id, af.target_id AS child_id, af.p, h.source_id AS taken_from FROM sg JOIN af ON af.dataset = sg.dataset AND af.source_id = parent_id JOIN pe h ON h.dataset = af.dataset AND h.target_id = af.target_id LEFT JOIN af c ON c.dataset = h.dataset AND c.source_id = h.source_id AND c.target_id = h.target_id WHERE af.target_id <> kept_id AND h.source_id <> parent_id AND af.p - coalesce(c.p, 0) > {_MARGIN}::DOUBLE"""


@query(_TL + _sql(_RUNNER, "-p", "tl"))
def r8_runner_up_daughters(k: Tracks) -> DataFrame:
    return _taken(k, k.links.filter("target_id % 4 != 0"), "runner_up", -F.col("p"), least_kept=0.3, least_second=0.1).drop("taken_from")


@query(_TL + _sql(_ORPHANS, "d_parent + 0.15::DOUBLE * d_sister", "tl"))
def r8_geometric_daughters(k: Tracks) -> DataFrame:
    return _taken(k, k.links.filter("target_id % 4 != 0"), "geometric", forks.geometry(0.15)).drop("taken_from")


@query(_sql(_HELD, "-p", "pe", ", taken_from"))
def r8_stolen_daughters(k: Tracks) -> DataFrame:
    return _taken(k, k.links, "steal", -F.col("p"), margin=_MARGIN)
