"""Training pairs, splits and samplers as windows and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def hard_negatives(pairs: DataFrame, truth: DataFrame, most: int) -> DataFrame:
    """For each source with a true target its ``most`` nearest wrong targets, with their rank k."""
    wrong = pairs.join(truth.select("dataset", "source_id").distinct(), ["dataset", "source_id"], "left_semi").join(truth.select("dataset", "source_id", "target_id"), ["dataset", "source_id", "target_id"], "left_anti")
    return wrong.withColumn("k", F.row_number().over(W.partitionBy("dataset", "source_id").orderBy("d", "target_id"))).filter(F.col("k") <= most)


def stratified_split(rows: DataFrame, stratum: str, ident: str, test: int = 2, val: int = 3) -> DataFrame:
    """Rows with ``split``: within a stratum, by a hash of the id, the first go to test, the next to val, the rest to train."""
    k = F.row_number().over(W.partitionBy(stratum).orderBy(F.sha2(F.col(ident).cast("string").cast("binary"), 256)))
    return rows.withColumn("_k", k).withColumn("split", F.when(F.col("_k") <= test, "test").when(F.col("_k") <= test + val, "val").otherwise("train")).drop("_k")


def held_out(rows: DataFrame, excluded: DataFrame, ident: str) -> DataFrame:
    return rows.join(excluded.select(ident), ident, "left_anti")


def truth_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each two frames in a row: sorted ids of both and the links between them as index pairs (0-based)."""
    frame = nodes.groupBy("dataset", "t").agg(F.sort_array(F.collect_list("node_id")).alias("ids"))
    a = frame.select("dataset", "t", F.col("ids").alias("source"))
    b = frame.select("dataset", (F.col("t") - 1).alias("t"), F.col("ids").alias("target"))
    t = nodes.select("dataset", "node_id", "t", (F.row_number().over(W.partitionBy("dataset", "t").orderBy("node_id")) - 1).alias("i"))
    e = edges.join(t.withColumnsRenamed({"node_id": "source_id"}), ["dataset", "source_id"]).join(t.select("dataset", F.col("node_id").alias("target_id"), (F.col("t") - 1).alias("t"), F.col("i").alias("j")), ["dataset", "target_id", "t"])
    links = e.groupBy("dataset", "t").agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("links"))
    return a.join(b, ["dataset", "t"]).join(links, ["dataset", "t"], "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<i:int,j:int>>")))


def detected_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidates of sources with exactly one true target, columns renumbered from 0 within the gap, the true one flagged."""
    one = truth.groupBy("dataset", "source_id").agg(F.count(F.lit(1)).alias("_n"), F.first("target_id").alias("_true")).filter("_n = 1").drop("_n")
    kept = pairs.join(one, ["dataset", "source_id"])
    column = F.dense_rank().over(W.partitionBy("dataset", "t").orderBy("target_id")) - 1
    return kept.withColumn("col", column).withColumn("is_true", F.col("target_id") == F.col("_true")).drop("_true")


def windows_of_frames(nodes: DataFrame, width: int) -> DataFrame:
    """Starts of windows of ``width`` frames that are all there, with the number of points in them."""
    frames = nodes.groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("dataset").orderBy("t").rangeBetween(0, width - 1)
    return frames.select("dataset", "t", F.count(F.lit(1)).over(w).alias("_k"), F.sum("n").over(w).alias("n_points")).filter(F.col("_k") == width).drop("_k")


def difficulty_weights(items: DataFrame, difficulty: str) -> DataFrame:
    """Half proportional to difficulty and half uniform: ``weight`` sums to 1 within a dataset."""
    w = W.partitionBy("dataset")
    total, n = F.sum(difficulty).over(w), F.count(F.lit(1)).over(w)
    return items.withColumn("weight", 0.5 * F.when(total > 0, F.col(difficulty) / total).otherwise(1 / n) + 0.5 / n)


def round_robin(items: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first ``most`` items dealt from the groups in turn."""
    return items.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy(order))).orderBy("_k", group).limit(most).drop("_k")


def dealt(items: DataFrame, order: str, shards: int, within: str) -> DataFrame:
    """Items with the shard that they are dealt to in turn within a group."""
    return items.withColumn("shard", F.pmod(F.row_number().over(W.partitionBy(within).orderBy(order)) - 1, F.lit(shards)))


def hardest(pairs: DataFrame, match: DataFrame, most: int) -> DataFrame:
    """All matched detections of a frame and its hardest unmatched ones, by score, ``most`` in all."""
    m = match.select("dataset", F.col("pred_id").alias("node_id"), F.col("gt_id").isNotNull().alias("matched"))
    j = pairs.join(m, ["dataset", "node_id"], "left").fillna(False, ["matched"])
    k = F.row_number().over(W.partitionBy("dataset", "t").orderBy(F.desc("matched"), F.desc("score"), "node_id"))
    return j.withColumn("_k", k).filter(F.col("matched") | (F.col("_k") <= most)).drop("_k")


def carried_tracks(labelled: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """dataset, component: whole tracks in the order of a seeded hash while their detections stay within ``ratio`` of the unmatched ones; the first always.

    ``labelled``: detections with the component that they stand for, null for none. The order depends on the names of the
    dataset and of the track alone, so a rebuild carries the same tracks.
    """
    per = labelled.filter("component is not null").groupBy("dataset", "component").agg(F.count(F.lit(1)).alias("_n"))
    crowd = labelled.groupBy("dataset").agg(F.count_if(F.col("component").isNull()).alias("_crowd"))
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), "dataset", F.col("component").cast("string")).cast("binary"), 256)
    w = W.partitionBy("dataset").orderBy("_h", "component")
    ranked = per.withColumn("_h", order).withColumns({"_k": F.row_number().over(w), "_sum": F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0))}).join(crowd, "dataset")
    return ranked.filter((F.col("_k") == 1) | (F.col("_sum") <= ratio * F.col("_crowd"))).select("dataset", "component")


def ratio_matched(labelled: DataFrame, carried: DataFrame, keep: int) -> DataFrame:
    """dataset, t, node_id, component of a frame's carried detections and its best-scored unmatched ones, ``keep`` in all unless the carried are more.

    Detections of tracks that aren't carried go: they are cells, and no negatives. ``labelled`` has t and score.
    """
    own = labelled.join(carried.withColumn("_own", F.lit(True)), ["dataset", "component"], "left").filter(F.col("_own") | F.col("component").isNull())
    w = W.partitionBy("dataset", "t")
    rows = own.withColumn("_p", F.count("_own").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.col("_own").isNotNull(), F.desc("score"), "node_id")))
    return rows.filter(F.col("_own") | (F.col("_k") <= F.greatest(F.lit(0), keep - F.col("_p")))).select("dataset", "t", "node_id", "component")
