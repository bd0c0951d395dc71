"""Second daughters proposed by an affinity: who may be proposed, which triangles may be divisions, and the cheapest within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.functions.geometry import norm
from tracelace.operators import forks, joins
from tracelace.operators.scoring import degrees

XYZ = ("uz", "uy", "ux")
#: Divisions a node that the budget expects.
RATE = 0.00113


def _single(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Parents with one child: dataset, t, parent_id, kept_id (places _p..., _k...), d_kept."""
    one = degrees(nodes, edges).filter("out_degree = 1").select("dataset", F.col("node_id").alias("parent_id"))
    kept = edges.groupBy("dataset", F.col("source_id").alias("parent_id")).agg(F.min("target_id").alias("kept_id"))
    at = nodes.select("dataset", "node_id", "t", *XYZ)
    p = at.withColumnsRenamed({"node_id": "parent_id"} | {a: f"_p{a}" for a in XYZ})
    k = at.drop("t").withColumnsRenamed({"node_id": "kept_id"} | {a: f"_k{a}" for a in XYZ})
    rows = one.join(kept, ["dataset", "parent_id"]).join(p, ["dataset", "parent_id"]).join(k, ["dataset", "kept_id"])
    return rows.withColumn("d_kept", norm(*[F.col(f"_p{a}") - F.col(f"_k{a}") for a in XYZ]))


def _claims(edges: DataFrame, affinity: DataFrame) -> DataFrame:
    """The standing parent of each child, the first of several, and its p (0 where it has none): dataset, child_id, taken_from, claim."""
    first = edges.groupBy("dataset", F.col("target_id").alias("child_id")).agg(F.min_by("source_id", F.struct("edge_seq", "source_id")).alias("taken_from"))
    p = affinity.select("dataset", F.col("source_id").alias("taken_from"), F.col("target_id").alias("child_id"), F.col("p").alias("_q"))
    return first.join(p, ["dataset", "taken_from", "child_id"], "left").select("dataset", "child_id", "taken_from", F.coalesce("_q", F.lit(0.0)).alias("claim"))


def _mutual(rows: DataFrame, nodes: DataFrame, edges: DataFrame, sister_gate: float) -> DataFrame:
    """Rows whose child is the orphan nearest to the kept one (the least id of equals), with no orphan as near to the child as the kept one is."""
    started = edges.select("dataset", F.col("target_id").alias("node_id")).distinct()
    orphans = nodes.select("dataset", "node_id", "t", *XYZ).join(started, ["dataset", "node_id"], "left_anti")

    def nearest(key: str) -> DataFrame:
        asked = rows.select("dataset", F.col(key).alias("node_id")).distinct().join(nodes.select("dataset", "node_id", "t", *XYZ), ["dataset", "node_id"])
        near = joins.gated(asked, orphans, sister_gate).filter("a_node_id != b_node_id")
        return near.groupBy(F.col("a_dataset").alias("dataset"), F.col("a_node_id").alias(key)).agg(F.min(F.struct("d", F.col("b_node_id").alias("id"))).alias(f"_near_{key}"))

    own = orphans.select("dataset", F.col("node_id").alias("child_id"))
    both = rows.join(own, ["dataset", "child_id"], "left_semi").join(nearest("kept_id"), ["dataset", "kept_id"]).join(nearest("child_id"), ["dataset", "child_id"], "left")
    held = (F.col("_near_kept_id.id") == F.col("child_id")) & (F.col("_near_child_id").isNull() | (F.col("_near_child_id.d") > F.col("d_sister")))
    return both.filter(held).select(*rows.columns)


def proposals(nodes: DataFrame, edges: DataFrame, affinity: DataFrame, candidacy: str = "runner_up", parent_gate: float = 10.0, sister_gate: float = 20.0, child_gate: float = 10.0, least_kept: float = 0.0, least_second: float = 0.0, margin: float = 0.0, mutual: bool = False, divergence: float | None = None) -> DataFrame:
    """Forks that may be: dataset, t, parent_id, kept_id, child_id, p, taken_from, d_parent, d_sister, d_kept and the cues of ``forks.cues``.

    A parent has one child, the kept one. ``candidacy``:
    'runner_up': the parent's likeliest target is the kept child (p of ``least_kept`` at least), its second likeliest (of
    equals the least id) an orphan of ``least_second`` at least;
    'geometric': every orphan of the next frame within the gates, its p 0 where the affinity has none;
    'steal': a target that another parent holds, whose p from here exceeds that from there by more than ``margin``;
    ``taken_from`` is that parent, null otherwise.
    Distances are at most their gates. ``mutual``: the daughters are each other's nearest among the frame's orphans.
    ``divergence``: both daughters go on, and are further apart then by that much at least.
    """
    single = _single(nodes, edges).filter(F.col("d_kept") <= child_gate)
    claims = _claims(edges, affinity)
    lit = affinity.select("dataset", F.col("source_id").alias("parent_id"), F.col("target_id").alias("child_id"), "p")
    child = nodes.select("dataset", F.col("node_id").alias("child_id"), F.col("t").alias("_ct"), *[F.col(a).alias(f"_c{a}") for a in XYZ])
    if candidacy == "geometric":
        orphans = nodes.select("dataset", "node_id", "t", *XYZ).join(claims.select("dataset", F.col("child_id").alias("node_id")), ["dataset", "node_id"], "left_anti")
        near = joins.gated(single.select("dataset", "t", F.col("parent_id").alias("node_id"), *[F.col(f"_p{a}").alias(a) for a in XYZ]), orphans, parent_gate, 1)
        pairs = near.select(F.col("a_dataset").alias("dataset"), F.col("a_node_id").alias("parent_id"), F.col("b_node_id").alias("child_id"))
        rows = pairs.join(lit, ["dataset", "parent_id", "child_id"], "left").fillna(0.0, ["p"]).join(single, ["dataset", "parent_id"]).withColumn("taken_from", F.lit(None).cast("long"))
    elif candidacy == "runner_up":
        order = W.partitionBy("dataset", "parent_id").orderBy(F.desc("p"), "child_id")
        ranked = lit.withColumns({"_r": F.row_number().over(order), "_top": F.first("child_id").over(order), "_top_p": F.first("p").over(order)}).filter("_r = 2")
        rows = ranked.join(single, ["dataset", "parent_id"]).filter((F.col("_top") == F.col("kept_id")) & (F.col("_top_p") >= least_kept) & (F.col("p") >= least_second))
        rows = rows.join(claims.select("dataset", "child_id"), ["dataset", "child_id"], "left_anti").withColumn("taken_from", F.lit(None).cast("long"))
    elif candidacy == "steal":
        rows = lit.join(single, ["dataset", "parent_id"]).join(claims, ["dataset", "child_id"]).filter((F.col("child_id") != F.col("kept_id")) & (F.col("taken_from") != F.col("parent_id")) & (F.col("p") - F.col("claim") > margin))
    else:
        raise ValueError(f"no candidacy {candidacy}")
    rows = rows.join(child, ["dataset", "child_id"]).filter(F.col("_ct") == F.col("t") + 1)
    apart = lambda p, q: norm(*[F.col(f"{p}{a}") - F.col(f"{q}{a}") for a in XYZ])
    rows = rows.withColumns({"d_parent": apart("_p", "_c"), "d_sister": apart("_k", "_c")}).filter((F.col("d_parent") <= parent_gate) & (F.col("d_sister") <= sister_gate))
    rows = rows.select("dataset", "t", "parent_id", "kept_id", "child_id", "p", "taken_from", "d_parent", "d_sister", "d_kept")
    if mutual:
        rows = _mutual(rows, nodes, edges, sister_gate)
    told = forks.cues(rows, nodes, edges)
    return told if divergence is None else told.filter(F.col("divergence") >= divergence)


def budget(nodes: DataFrame, edges: DataFrame, most: int | None = None, edge_share: float | None = None) -> DataFrame:
    """dataset, cap: forks that a dataset may gain: ``most``, or the rate by its nodes, half to even; no more than a share of its edges."""
    n = nodes.groupBy("dataset").agg((F.lit(most).cast("long") if most is not None else F.bround(F.count(F.lit(1)) * RATE).cast("long")).alias("cap"))
    if edge_share is None:
        return n
    e = edges.groupBy("dataset").agg(F.bround(F.count(F.lit(1)) * edge_share).cast("long").alias("_e"))
    return n.join(e, "dataset", "left").select("dataset", F.least("cap", F.coalesce("_e", F.lit(0))).alias("cap"))


def admitted(proposed: DataFrame, cost: Column, caps: DataFrame) -> DataFrame:
    """The cheapest proposals (cost, parent_id, child_id) up to the dataset's cap, each child by one parent.

    A child's cheapest proposal is the one that a pass in this order would admit, whatever the others are.
    """
    one = proposed.withColumn("cost", cost).withColumn("_r", F.row_number().over(W.partitionBy("dataset", "child_id").orderBy("cost", "parent_id"))).filter("_r = 1").drop("_r")
    order = F.row_number().over(W.partitionBy("dataset").orderBy("cost", "parent_id", "child_id"))
    return one.join(caps, "dataset").withColumn("rank", order).filter("rank <= cap").drop("cap")


def edited(edges: DataFrame, taken: DataFrame) -> DataFrame:
    """``edges`` without those that the admitted forks displace, and the forks' own, by rank after all others in edge_seq."""
    gone = taken.filter("taken_from is not null").select("dataset", F.col("taken_from").alias("source_id"), F.col("child_id").alias("target_id"))
    last = edges.groupBy("dataset").agg(F.max("edge_seq").alias("_last"))
    new = taken.join(last, "dataset").select("dataset", F.col("parent_id").alias("source_id"), F.col("child_id").alias("target_id"), (F.col("_last") + F.col("rank")).cast("long").alias("edge_seq"))
    return edges.select("dataset", "source_id", "target_id", "edge_seq").join(gone, ["dataset", "source_id", "target_id"], "left_anti").unionByName(new)
