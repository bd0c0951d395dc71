"""Lineage stages after linking: bridges, recovered divisions, smoothing, budgets.

Candidates are joins and windows over all rows, and what a pass in a fixed order would admit comes from rounds
(``admission``). Only the smoother's fold and budgets that pass over what doesn't fit go through a lineage's or a dataset's
rows in Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.functions.geometry import AXES, Spacing, norm, to_um
from tracelace.operators import assign, joins
from tracelace.operators.admission import admit
from tracelace.operators.scoring import degrees
from tracelace.operators.groups import spread

XYZ = ("uz", "uy", "ux")


def velocities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with vz, vy, vx: the step from the first parent (by edge_seq), 0 without one."""
    first = edges.groupBy("dataset", F.col("target_id").alias("node_id")).agg(F.min_by("source_id", F.struct("edge_seq", "source_id")).alias("_p"))
    parent = nodes.select("dataset", F.col("node_id").alias("_p"), *[F.col(a).alias(f"_{a}") for a in XYZ])
    j = nodes.join(first, ["dataset", "node_id"], "left").join(parent, ["dataset", "_p"], "left")
    return j.select(*nodes.columns, *[F.coalesce(F.col(a) - F.col(f"_{a}"), F.lit(0.0)).alias(f"v{a[1]}") for a in XYZ])


def bridge_proposals(nodes: DataFrame, edges: DataFrame, reach: float, max_gap: int = 1) -> DataFrame:
    """Ends whose motion points at exactly one start: dataset, missing, end_id, start_id, cost.

    The radius is half the distance to the nearest other point of the end's frame (points at the same place don't count),
    ``reach`` at most; an end in the last frames has nowhere to go.
    """
    slim = velocities(nodes.select("dataset", "node_id", "t", *XYZ), edges)
    ends, starts = joins.ends_and_starts(slim, edges)
    apart = joins.neighbours(nodes, 2 * reach).filter("d > 0").groupBy("dataset", "node_id").agg(F.min("d").alias("_near"))
    last = nodes.groupBy("dataset").agg(F.max("t").alias("_last"))
    ends = ends.join(apart, ["dataset", "node_id"], "left").join(last, "dataset").withColumn("_r", F.least(F.lit(float(reach)), F.coalesce(F.col("_near") / 2, F.lit(float(reach)))))
    out = None
    for missing in range(1, max_gap + 1):
        moved = ends.filter(F.col("t") < F.col("_last") - missing).withColumns({a: F.col(a) + (missing + 1) * F.col(f"v{a[1]}") for a in XYZ})
        met = joins.gated(moved.select("dataset", "node_id", "t", *XYZ, "_r"), starts.select("dataset", "node_id", "t", *XYZ), reach, missing + 1).filter("d <= a__r")
        one = met.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("a_dataset", "a_node_id"))).filter("_n = 1")
        part = one.select(F.col("a_dataset").alias("dataset"), F.lit(missing).alias("missing"), F.col("a_node_id").alias("end_id"), F.col("b_node_id").alias("start_id"), F.col("d").alias("cost"))
        out = part if out is None else out.unionByName(part)
    return out


def accept_tightest(proposals: DataFrame, budget: DataFrame, max_gap: int = 1) -> DataFrame:
    """Proposals by cost (then missing, end, start), each end and start once, until ``cap`` nodes are used up.

    ``budget`` has a cap for each dataset. Bridges of one node each are admitted in rounds and cut at the cap; with longer
    ones, one that doesn't fit is passed over and frees its ends, so a dataset's proposals are gone through in order.
    """
    order = ["cost", "missing", "end_id", "start_id"]
    if max_gap == 1:
        got = admit(proposals, order, [(("dataset", "end_id"), 1), (("dataset", "start_id"), 1)])
        ranked = got.withColumn("rank", F.row_number().over(W.partitionBy("dataset").orderBy(*order)).cast("long") - 1)
        return ranked.join(budget, "dataset").filter("rank < cap").select("dataset", "missing", "end_id", "start_id", "cost", "rank")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[tuple[str, int]] = set()
        left, keep = int(pdf["cap"].iloc[0]), []
        pdf = pdf.sort_values(order)
        for i, (e, s, n) in enumerate(zip(pdf["end_id"], pdf["start_id"], pdf["missing"], strict=True)):
            if n <= left and not used & {("e", e), ("s", s)}:
                used |= {("e", e), ("s", s)}
                left -= n
                keep.append(i)
        out = pdf.iloc[keep].drop(columns="cap")
        return out.assign(rank=np.arange(len(out)))

    return proposals.join(budget, "dataset").transform(spread("dataset")).groupBy("dataset").applyInPandas(run, "dataset string, missing int, end_id long, start_id long, cost double, rank long")


def density_gap_bridge(nodes: DataFrame, edges: DataFrame, reach: float, most_added: float = 0.05, max_gap: int = 1, spacing: Spacing = Spacing()) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the accepted bridges: synthetic points along the motion, clipped to the graph's bounds, with
    new ids in the order of acceptance, and the edges through them."""
    cap = nodes.groupBy("dataset").agg(F.floor(F.count(F.lit(1)) * most_added).cast("int").alias("cap"))
    got = accept_tightest(bridge_proposals(nodes, edges, reach, max_gap), cap, max_gap)
    bounds = nodes.groupBy("dataset").agg(F.max("node_id").alias("_top"), *[F.max(a).alias(f"_max_{a}") for a in AXES])
    at = velocities(nodes.select("dataset", "node_id", "t", *XYZ), edges).withColumnRenamed("node_id", "end_id")
    before = F.coalesce(F.sum("missing").over(W.partitionBy("dataset").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = got.withColumn("_base", before).join(bounds, "dataset").join(at, ["dataset", "end_id"])
    chain = placed.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("missing"))))
    voxel = [F.least(F.greatest(F.rint((F.col(f"u{a}") + F.col("_k") * F.col(f"v{a}")) / getattr(spacing, a)), F.lit(0.0)), F.col(f"_max_{a}")).cast("int").alias(a) for a in AXES]
    new = chain.select("dataset", (F.col("_top") + F.col("_base") + F.col("_k")).cast("long").alias("node_id"), (F.col("t") + F.col("_k")).cast("int").alias("t"), *voxel)
    way = placed.select("dataset", F.explode(F.expr("transform(sequence(0, missing), k -> struct(if(k = 0, end_id, _top + _base + k) as source_id, if(k = missing, start_id, _top + _base + k + 1) as target_id))")).alias("e"))
    links = way.select("dataset", F.col("e.source_id").cast("long").alias("source_id"), F.col("e.target_id").cast("long").alias("target_id")).withColumn("edge_seq", F.col("target_id"))
    slim = ["dataset", "node_id", "t", *AXES]
    return to_um(nodes.select(*slim).unionByName(new), spacing), edges.select("dataset", "source_id", "target_id", "edge_seq").unionByName(links)


def close_gaps(nodes: DataFrame, edges: DataFrame, reach: float, reuse: float, most_edges: float = 0.05, spacing: Spacing = Spacing()) -> tuple[DataFrame, DataFrame]:
    """One-frame gaps between ends and starts, one-to-one by distance: through the nearest isolated point within ``reuse`` of
    the midpoint, else through a new point there; the nearest pairs first, up to a share of the edges."""
    p = joins.gaps(nodes, edges, (2,), reach / 2)
    t = nodes.select("dataset", F.col("node_id").alias("end_id"), "t", *[F.col(a).alias(f"_e{a}") for a in XYZ])
    pairs = p.join(t.select("dataset", "end_id", "t"), ["dataset", "end_id"]).withColumnsRenamed({"end_id": "source_id", "start_id": "target_id"})
    one = assign.gated_hungarian(pairs).withColumnsRenamed({"source_id": "end_id", "target_id": "start_id"}).join(p, ["dataset", "end_id", "start_id"])
    cap = edges.groupBy("dataset").agg(F.floor(F.count(F.lit(1)) * most_edges).alias("_cap"))
    rank = F.row_number().over(W.partitionBy("dataset").orderBy("d", "end_id"))
    kept = one.join(cap, "dataset").withColumn("rank", rank).filter("rank * 2 <= _cap")
    s = nodes.select("dataset", F.col("node_id").alias("start_id"), *[F.col(a).alias(f"_s{a}") for a in XYZ])
    middle = kept.select("dataset", "end_id", "start_id", "rank").join(t, ["dataset", "end_id"]).join(s, ["dataset", "start_id"])
    middle = middle.select("dataset", "end_id", "start_id", "rank", (F.col("t") + 1).alias("t"), *[((F.col(f"_e{a}") + F.col(f"_s{a}")) / 2).alias(a) for a in XYZ])
    touched = edges.select("dataset", F.col("source_id").alias("node_id")).union(edges.select("dataset", F.col("target_id").alias("node_id")))
    alone = nodes.join(touched, ["dataset", "node_id"], "left_anti").select("dataset", "node_id", "t", *XYZ)
    found = joins.gated(middle.withColumn("node_id", F.col("end_id")), alone, reuse)
    free = found.groupBy(F.col("a_dataset").alias("dataset"), F.col("a_end_id").alias("end_id")).agg(F.min(F.struct("d", F.col("b_node_id").alias("id"))).alias("m"))
    once = free.withColumn("_r", F.row_number().over(W.partitionBy("dataset", "m.id").orderBy("m.d", "end_id"))).filter("_r = 1").select("dataset", "end_id", F.col("m.id").alias("_reused"))
    top = nodes.groupBy("dataset").agg(F.max("node_id").alias("_top"))
    via = middle.join(once, ["dataset", "end_id"], "left").join(top, "dataset").withColumn("_via", F.coalesce(F.col("_reused"), F.col("_top") + F.col("rank")))
    new = via.filter("_reused is null").select("dataset", F.col("_via").alias("node_id"), F.col("t").cast("int").alias("t"), *[F.greatest(F.rint(F.col(f"u{a}") / getattr(spacing, a)), F.lit(0.0)).cast("int").alias(a) for a in AXES])
    links = via.select("dataset", F.explode(F.array(F.struct(F.col("end_id").alias("s"), F.col("_via").alias("e")), F.struct(F.col("_via").alias("s"), F.col("start_id").alias("e")))).alias("l"))
    links = links.select("dataset", F.col("l.s").alias("source_id"), F.col("l.e").alias("target_id")).withColumn("edge_seq", F.col("target_id"))
    return to_um(nodes.select("dataset", "node_id", "t", *AXES).unionByName(new), spacing), edges.select("dataset", "source_id", "target_id", "edge_seq").unionByName(links)


def division_candidates(nodes: DataFrame, edges: DataFrame, parent_gate: float, sister_gate: float, child_gate: float = float("inf")) -> DataFrame:
    """Second daughters: orphans near a parent with one child: dataset, t, parent_id, child_id, kept_id, d_parent, d_sister, n_parents
    (single-child parents of the frame) and score d_parent + 0.15 d_sister."""
    deg = degrees(nodes, edges)
    t = nodes.select("dataset", "node_id", "t", *XYZ)
    kept = edges.groupBy("dataset", F.col("source_id").alias("node_id")).agg(F.min("target_id").alias("kept_id"))
    sister = t.select("dataset", F.col("node_id").alias("kept_id"), *[F.col(a).alias(f"k_{a}") for a in XYZ])
    single = t.join(deg.filter("out_degree = 1").select("dataset", "node_id"), ["dataset", "node_id"]).join(kept, ["dataset", "node_id"])
    single = single.withColumn("n_parents", F.count(F.lit(1)).over(W.partitionBy("dataset", "t"))).join(sister, ["dataset", "kept_id"])
    single = single.filter(norm(*[F.col(a) - F.col(f"k_{a}") for a in XYZ]) <= child_gate)
    orphan = t.join(deg.filter("in_degree = 0").select("dataset", "node_id"), ["dataset", "node_id"])
    g = joins.gated(single, orphan, parent_gate, 1)
    ds = norm(*[F.col(f"a_k_{a}") - F.col(f"b_{a}") for a in XYZ])
    out = g.select(F.col("a_dataset").alias("dataset"), F.col("a_t").alias("t"), F.col("a_node_id").alias("parent_id"), F.col("b_node_id").alias("child_id"), F.col("a_kept_id").alias("kept_id"), F.col("d").alias("d_parent"), ds.alias("d_sister"), F.col("a_n_parents").alias("n_parents"))
    return out.filter(F.col("d_sister") <= sister_gate).withColumn("score", F.col("d_parent") + 0.15 * F.col("d_sister"))


def geometric_divisions(nodes: DataFrame, edges: DataFrame, parent_gate: float = 4.7, sister_gate: float = 7.2, child_gate: float = 7.8, frame_share: float = 1.0, most_added: float = 0.05) -> DataFrame:
    """Recovered daughters (dataset, source_id, target_id, edge_seq): orphans in order of id take their cheapest parent that
    none has taken yet; then the cheapest of each frame and, by frame, of all, up to the caps."""
    c = division_candidates(nodes, edges, parent_gate, sister_gate, child_gate)
    one = admit(c.select("dataset", "t", "parent_id", "child_id", "score", "n_parents"), ["child_id", "score", "parent_id"], [(("dataset", "child_id"), 1), (("dataset", "parent_id"), 1)])
    return capped(one, edges, frame_share, most_added)


def capped(found: DataFrame, edges: DataFrame, frame_share: float, most_added: float) -> DataFrame:
    """The best of each frame (max(1, half-even share of single-child parents)), then frames in order up to a share of the edges."""
    cap = edges.groupBy("dataset").agg(F.floor(F.count(F.lit(1)) * most_added).alias("_cap"))
    order = ["score", "parent_id", "child_id"]
    r = found.withColumn("_r", F.row_number().over(W.partitionBy("dataset", "t").orderBy(*order)))
    r = r.filter(F.col("_r") <= F.greatest(F.lit(1), F.bround(F.col("n_parents") * frame_share))).join(cap, "dataset")
    r = r.withColumn("_g", F.row_number().over(W.partitionBy("dataset").orderBy("t", *order))).filter("_g <= _cap")
    return r.select("dataset", F.col("parent_id").alias("source_id"), F.col("child_id").alias("target_id"), F.col("child_id").alias("edge_seq"))


#: Rankings of fork candidates by name: lower is better.
RANKINGS = {
    "probability": lambda: -F.col("p"),
    "geometry": lambda: F.col("score"),
    "symmetry": lambda: F.abs(F.col("d_parent") - F.col("d_kept")) / F.greatest(F.col("d_parent") + F.col("d_kept"), F.lit(1e-12)),
}


def affinity_divisions(nodes: DataFrame, edges: DataFrame, affinity: DataFrame, ranking: str = "probability", least_p: float = 0.0, budget_share: float = 0.00113, parent_gate: float = 10.0, sister_gate: float = 14.0) -> DataFrame:
    """Second daughters by affinity: each orphan's cheapest proposal, and of those the cheapest (cost, parent, child) up to
    a share of the nodes, half to even. A child proposes once, so the minimum by child is what a greedy pass would take."""
    c = division_candidates(nodes, edges, parent_gate, sister_gate).join(affinity.select("dataset", F.col("source_id").alias("parent_id"), F.col("target_id").alias("child_id"), "p"), ["dataset", "parent_id", "child_id"]).filter(F.col("p") >= least_p)
    at = nodes.select("dataset", "node_id", *XYZ)
    c = c.join(at.withColumnsRenamed({"node_id": "parent_id"} | {a: f"p_{a}" for a in XYZ}), ["dataset", "parent_id"]).join(at.withColumnsRenamed({"node_id": "kept_id"} | {a: f"q_{a}" for a in XYZ}), ["dataset", "kept_id"])
    c = c.withColumn("d_kept", norm(*[F.col(f"p_{a}") - F.col(f"q_{a}") for a in XYZ])).withColumn("cost", RANKINGS[ranking]())
    one = c.withColumn("_r", F.row_number().over(W.partitionBy("dataset", "child_id").orderBy("cost", "parent_id"))).filter("_r = 1")
    per_parent = one.withColumn("_r", F.row_number().over(W.partitionBy("dataset", "parent_id").orderBy("cost", "child_id"))).filter("_r = 1")
    budget = nodes.groupBy("dataset").agg(F.bround(F.count(F.lit(1)) * budget_share).alias("_cap"))
    r = per_parent.join(budget, "dataset").withColumn("_g", F.row_number().over(W.partitionBy("dataset").orderBy("cost", "parent_id", "child_id"))).filter("_g <= _cap")
    return r.select("dataset", F.col("parent_id").alias("source_id"), F.col("child_id").alias("target_id"), F.col("child_id").alias("edge_seq"))


def smoothed(nodes: DataFrame, edges: DataFrame, labels: DataFrame, strength: float = 0.8) -> DataFrame:
    """Nodes with one parent and one child drawn towards the middle of the two, in order of id within their lineage.

    Neighbours that come earlier are already drawn, and a node's own place is the original one; so this is a fold over the
    lineage's nodes. Voxels are rounded half to even and are 0 at least.
    """
    deg = degrees(nodes, edges).filter("out_degree = 1 and in_degree = 1").select("dataset", "node_id").withColumn("_inner", F.lit(True))
    up = edges.select("dataset", F.col("target_id").alias("node_id"), F.col("source_id").alias("_up"))
    down = edges.select("dataset", F.col("source_id").alias("node_id"), F.col("target_id").alias("_down"))
    inner = deg.join(up, ["dataset", "node_id"]).join(down, ["dataset", "node_id"])
    rows = nodes.select("dataset", "node_id", "t", *AXES).join(labels, ["dataset", "node_id"]).join(inner, ["dataset", "node_id"], "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id").reset_index(drop=True)
        row = {i: k for k, i in enumerate(pdf["node_id"])}
        own = pdf[list(AXES)].to_numpy(float)
        now = own.copy()
        for k in np.flatnonzero(pdf["_inner"].notna().to_numpy()):
            middle = (now[row[int(pdf["_up"][k])]] + now[row[int(pdf["_down"][k])]]) / 2
            now[k] = (1 - strength) * own[k] + strength * middle
        out = pdf[["dataset", "node_id", "t"]].copy()
        for i, a in enumerate(AXES):
            out[a] = np.clip(np.rint(now[:, i]), 0, None).astype("int32")
        return out

    return rows.transform(spread("dataset", "component")).groupBy("dataset", "component").applyInPandas(fold, "dataset string, node_id long, t int, z int, y int, x int")


def rescued_by_budget(summary: DataFrame, budget: DataFrame) -> DataFrame:
    """Components by score downwards while their nodes fit the dataset's budget; one that doesn't fit is passed over."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, keep = int(pdf["cap"].iloc[0]), []
        for row in pdf.sort_values(["score", "component"], ascending=[False, True]).itertuples(index=False):
            if row.size <= left:
                left -= row.size
                keep.append((row.dataset, row.component))
        return pd.DataFrame(keep, columns=["dataset", "component"])

    rows = summary.withColumn("score", F.col("mean_p") - 0.02 * F.col("mean_d") + 0.004 * F.col("size")).join(budget, "dataset")
    return rows.select("dataset", "component", F.col("size").cast("long").alias("size"), "score", "cap").transform(spread("dataset")).groupBy("dataset").applyInPandas(run, "dataset string, component long")


def merged(own: DataFrame, donor: DataFrame, order: str = "edge_seq") -> DataFrame:
    """``own`` edges and the donor's that keep one parent and two children at most, in the donor's order: both share ids.

    The donor's come after all own ones in edge_seq.
    """
    parents = own.select("dataset", "target_id").distinct().withColumn("_parents", F.lit(1))
    children = own.groupBy("dataset", "source_id").agg(F.count(F.lit(1)).alias("_children"))
    last = own.groupBy("dataset").agg(F.max("edge_seq").alias("_last"))
    offered = donor.select("dataset", "source_id", "target_id", F.col(order).alias("_o"))
    offered = offered.join(parents, ["dataset", "target_id"], "left").join(children, ["dataset", "source_id"], "left").fillna(0, ["_parents", "_children"])
    got = admit(offered, ["_o", "source_id", "target_id"], [(("dataset", "target_id"), 1 - F.col("_parents")), (("dataset", "source_id"), 2 - F.col("_children"))])
    new = got.join(last, "dataset", "left").select("dataset", "source_id", "target_id", (F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("_o")).cast("long").alias("edge_seq"))
    return own.select("dataset", "source_id", "target_id", "edge_seq").unionByName(new)
