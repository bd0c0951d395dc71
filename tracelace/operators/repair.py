"""Graph repair stages that are plain relational algebra."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.operators.components import components
from tracelace.storage import written

#: Frames of a block in which a task labels components.
BLOCK = 32


def nearest_parent(pairs: DataFrame) -> DataFrame:
    """One parent for each target: the nearest, equal distances to the smaller id; edges with edge_seq and d."""
    best = pairs.groupBy("dataset", "target_id").agg(F.min(F.struct("d", "source_id")).alias("m"))
    return best.select("dataset", F.col("m.source_id").alias("source_id"), "target_id", F.col("target_id").alias("edge_seq"), F.col("m.d").alias("d"))


def topology_repair(nodes: DataFrame, edges: DataFrame, longest: float = 14.0) -> tuple[DataFrame, DataFrame]:
    """Edges to the next frame of at most ``longest`` micrometres, one nearest parent each (then by edge_seq), and the nodes they touch."""
    ends = nodes.select("dataset", "node_id", "t", "uz", "uy", "ux")
    s = ends.select("dataset", F.col("node_id").alias("source_id"), *[F.col(c).alias(f"s_{c}") for c in ("t", "uz", "uy", "ux")])
    t = ends.select("dataset", F.col("node_id").alias("target_id"), *[F.col(c).alias(f"t_{c}") for c in ("t", "uz", "uy", "ux")])
    placed = edges.select("dataset", "source_id", "target_id", "edge_seq").join(s, ["dataset", "source_id"]).join(t, ["dataset", "target_id"])
    d = F.sqrt(sum(((F.col(f"s_u{a}") - F.col(f"t_u{a}")) * (F.col(f"s_u{a}") - F.col(f"t_u{a}")) for a in "yx"), (F.col("s_uz") - F.col("t_uz")) * (F.col("s_uz") - F.col("t_uz"))))
    near = placed.withColumn("d", d).filter((F.col("t_t") - F.col("s_t") == 1) & (F.col("d") <= longest))
    best = near.withColumn("_r", F.row_number().over(W.partitionBy("dataset", "target_id").orderBy("d", "edge_seq"))).filter("_r = 1")
    kept = best.select("dataset", "source_id", "target_id", "edge_seq", "d")
    return without_isolated(nodes, kept), kept


def without_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    touched = edges.select("dataset", F.col("source_id").alias("node_id")).union(edges.select("dataset", F.col("target_id").alias("node_id")))
    return nodes.join(touched, ["dataset", "node_id"], "left_semi")


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """dataset, node_id, component: the least id of its weakly connected component; a node without edges is its own.

    Components are labelled within blocks of ``BLOCK`` frames, each in a task; only what edges between blocks join goes
    through rounds, a row for each such edge.
    """
    own = nodes.groupBy("dataset", "node_id").agg(F.floor(F.min("t") / BLOCK).alias("_at"))
    block = lambda key, name: own.select("dataset", F.col("node_id").alias(key), F.col("_at").alias(name))
    pairs = edges.select("dataset", F.col("source_id").cast("long").alias("source_id"), F.col("target_id").cast("long").alias("target_id")).filter("source_id != target_id")
    # an end that isn't among the nodes joins edges all the same, in a block of its own
    placed = pairs.join(block("source_id", "_a"), ["dataset", "source_id"], "left").join(block("target_id", "_b"), ["dataset", "target_id"], "left").fillna(-1, ["_a", "_b"])
    dealt = placed.withColumn("_block", F.explode(F.when(F.col("_a") == F.col("_b"), F.array("_a")).otherwise(F.array("_a", "_b"))))
    schema = f"dataset {dict(edges.dtypes)['dataset']}, node_id long, _root long, _border boolean"
    rows = written(dealt.groupBy("dataset", "_block").applyInArrow(_in_block, schema), "label-blocks")
    crossing = components(rows.filter("_border"), "node_id", "_root", ("dataset",)).select("dataset", F.col("node").alias("_root"), F.col("root").alias("_whole"))
    found = rows.filter("not _border").join(crossing, ["dataset", "_root"], "left").select("dataset", "node_id", F.coalesce("_whole", "_root").alias("root"))
    return nodes.select("dataset", "node_id").join(found, ["dataset", "node_id"], "left").select("dataset", "node_id", F.coalesce("root", "node_id").alias("component"))


def _in_block(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
    """The block's own nodes with the least id that they are joined to in it; and with it (``_border``) the targets of the
    edges that leave or enter the block, by which the blocks' components are joined."""
    source, target, a, b = (block.column(c).to_numpy() for c in ("source_id", "target_id", "_a", "_b"))
    here, there = a == key[1].as_py(), b != key[1].as_py()
    ids, at = np.unique(np.concatenate([source[here], target]), return_inverse=True)
    u, v = at[: here.sum()], at[here.sum() :][here]
    root = np.arange(len(ids))
    while (root[u] != root[v]).any():
        least = np.minimum(root[u], root[v])
        for end in (root[u], root[v]):
            np.minimum.at(root, end, least)
        while (root[root] != root).any():
            root = root[root]
    met = at[here.sum() :]
    foreign = np.zeros(len(ids), bool)
    foreign[met[there]] = True
    border = np.unique(met[there | ~here])
    rows = np.concatenate([np.flatnonzero(~foreign), border])
    columns = {"node_id": ids[rows], "_root": ids[root[rows]], "_border": np.arange(len(rows)) >= len(rows) - len(border)}
    dataset = block.column("dataset")
    return pa.table({"dataset": pa.array([dataset[0].as_py()] * len(rows), dataset.type)} | columns)


def tracks_summary(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each component: size, n_edges, forks, first and last frame, mean p and mean d of its edges where they have them."""
    by_node = nodes.select("dataset", "node_id", "t").join(labels, ["dataset", "node_id"])
    per = by_node.groupBy("dataset", "component").agg(F.count(F.lit(1)).alias("size"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))
    e = edges.join(labels.withColumnRenamed("node_id", "source_id"), ["dataset", "source_id"])
    by_source = e.groupBy("dataset", "component", "source_id").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{c}") for c in ("p", "d") if c in edges.columns])
    per_edge = by_source.groupBy("dataset", "component").agg(F.sum("_n").alias("n_edges"), F.sum((F.col("_n") >= 2).cast("long")).alias("forks"), *[(F.sum(f"_{c}") / F.sum("_n")).alias(f"mean_{c}") for c in ("p", "d") if c in edges.columns])
    return per.join(per_edge, ["dataset", "component"], "left").fillna(0, ["n_edges", "forks"])


def short_tracks(nodes: DataFrame, edges: DataFrame, labels: DataFrame, least: int = 6, spare_boundary: bool = False, rescue: bool = False, rescue_length: int = 5, rescue_p: float = 0.90, rescue_d: float = 2.75, rescue_share: float = 0.006, rescue_most: int = 60) -> DataFrame:
    """The components to keep: (dataset, component).

    Kept are those of ``least`` nodes, those with a fork, with ``spare_boundary`` those that touch the dataset's first or
    last frame, and with ``rescue`` the best of the short ones with edges: by mean p (then larger label), as many as the
    share of nodes and the limit allow.
    """
    info = tracks_summary(nodes, edges, labels)
    frame = nodes.groupBy("dataset").agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"), F.count(F.lit(1)).alias("_n"))
    info = info.join(frame, "dataset")
    keep = (F.col("size") >= least) | (F.col("forks") > 0)
    if spare_boundary:
        keep = keep | (F.col("t_first") == F.col("_t0")) | (F.col("t_last") == F.col("_t1"))
    out = info.withColumn("_keep", keep)
    if rescue:
        fit = ~F.col("_keep") & (F.col("n_edges") > 0) & (F.col("size") <= rescue_length) & (F.col("mean_p") >= rescue_p) & (F.col("mean_d") <= rescue_d)
        rank = F.row_number().over(W.partitionBy("dataset", "_fit").orderBy(F.desc("mean_p"), F.desc("component")))
        budget = F.least(F.floor(F.col("_n") * rescue_share), F.lit(rescue_most))
        out = out.withColumn("_fit", fit).withColumn("_r", rank).withColumn("_keep", F.col("_keep") | (F.col("_fit") & (F.col("_r") <= budget)))
    return out.filter("_keep").select("dataset", "component")


def of_components(nodes: DataFrame, edges: DataFrame, labels: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the kept components."""
    ids = labels.join(kept, ["dataset", "component"], "left_semi")
    n = nodes.join(ids, ["dataset", "node_id"], "left_semi")
    e = edges.join(ids.withColumnRenamed("node_id", "source_id"), ["dataset", "source_id"], "left_semi")
    return n, e
