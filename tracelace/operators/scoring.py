"""Scores of predicted lineages: charged links, confusion counts, ratios, ranking scores. Undefined ratios are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.functions.geometry import scaled_jaccard
from tracelace.operators.joins import in_set, translated


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """dataset, node_id, out_degree, in_degree of every node, over edges as they are."""
    out = edges.groupBy("dataset", F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy("dataset", F.col("target_id").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.select("dataset", "node_id").join(out, ["dataset", "node_id"], "left").join(into, ["dataset", "node_id"], "left").fillna(0, ["out_degree", "in_degree"])


def divisions(edges: DataFrame) -> DataFrame:
    """dataset, node_id, n_out of the sources with two targets or more."""
    return edges.groupBy("dataset", F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_out")).filter("n_out >= 2")


def charged_links(edges: DataFrame, nodes: DataFrame, truth_edges: DataFrame, match: DataFrame) -> DataFrame:
    """Predicted links as the scorer charges them: dataset, source_id, target_id, gt_source, gt_target, is_true.

    In this order: equal links count once (the least edge_seq); only links to the next frame; of links that land on one
    matched pair the first; two links out of a source at most; and only those with a matched end whose truth has links on
    that side.
    """
    t = nodes.select("dataset", "node_id", "t")
    e = edges.groupBy("dataset", "source_id", "target_id").agg(F.min("edge_seq").alias("edge_seq"))
    e = e.join(t.withColumnsRenamed({"node_id": "source_id", "t": "_ts"}), ["dataset", "source_id"]).join(t.withColumnsRenamed({"node_id": "target_id", "t": "_tt"}), ["dataset", "target_id"])
    e = translated(e.filter("_tt - _ts = 1").drop("_ts", "_tt"), match)
    both = F.col("gt_source").isNotNull() & F.col("gt_target").isNotNull()
    first = F.row_number().over(W.partitionBy("dataset", "gt_source", "gt_target").orderBy("edge_seq", "source_id"))
    merged = e.filter(both).withColumn("_r", first).filter("_r = 1").drop("_r").unionByName(e.filter(~both))
    capped = merged.withColumn("_r", F.row_number().over(W.partitionBy("dataset", "source_id").orderBy("edge_seq", "target_id"))).filter("_r <= 2").drop("_r")
    sources = truth_edges.select("dataset", F.col("source_id").alias("gt_source")).distinct().withColumn("_s", F.lit(True))
    targets = truth_edges.select("dataset", F.col("target_id").alias("gt_target")).distinct().withColumn("_t", F.lit(True))
    counted = capped.join(sources, ["dataset", "gt_source"], "left").join(targets, ["dataset", "gt_target"], "left").filter("_s or _t").drop("_s", "_t")
    return in_set(counted, truth_edges, "gt_source", "gt_target", "is_true")


def edge_counts(charged: DataFrame, truth_edges: DataFrame) -> DataFrame:
    """A row for each dataset with truth: tp, fp, fn and jaccard (null without any of them)."""
    truth = truth_edges.select("dataset", "source_id", "target_id").distinct().groupBy("dataset").agg(F.count(F.lit(1)).alias("n_truth"))
    got = charged.groupBy("dataset").agg(F.sum(F.col("is_true").cast("long")).alias("tp"), F.sum((~F.col("is_true")).cast("long")).alias("fp"))
    out = truth.join(got, "dataset", "full_outer").fillna(0, ["n_truth", "tp", "fp"]).withColumn("fn", F.col("n_truth") - F.col("tp"))
    return out.select("dataset", "tp", "fp", "fn", jaccard(F.col("tp"), F.col("fp"), F.col("fn")).alias("jaccard"))


def jaccard(tp: Column, fp: Column, fn: Column) -> Column:
    return F.try_divide(tp.cast("double"), tp + fp + fn)


def node_counts(nodes: DataFrame, truth: DataFrame, match: DataFrame) -> DataFrame:
    """A row for each dataset: n_pred, n_gt, covered (truth points matched, each once), precision, recall and f1 (0 where either is 0)."""
    p = nodes.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_pred"))
    g = truth.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_gt"))
    m = match.filter("gt_id is not null").groupBy("dataset").agg(F.count_distinct("gt_id").alias("covered"), F.count(F.lit(1)).alias("matched"))
    out = g.join(p, "dataset", "left").join(m, "dataset", "left").fillna(0, ["n_pred", "covered", "matched"])
    out = out.withColumn("precision", F.try_divide(F.col("matched").cast("double"), F.col("n_pred"))).withColumn("recall", F.try_divide(F.col("covered").cast("double"), F.col("n_gt")))
    f1 = F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1)


def video_metrics(edges: DataFrame, n_pred: DataFrame, video: DataFrame, division_counts: DataFrame | None = None) -> DataFrame:
    """A row for each dataset: counts, node_ratio ((n - estimated) / estimated), adjusted and clamped Jaccard, division Jaccard and weight."""
    out = edges.join(n_pred.select("dataset", "n_pred"), "dataset").join(video, "dataset")
    out = out.withColumn("node_ratio", F.try_divide((F.col("n_pred") - F.col("estimated_nodes")).cast("double"), F.col("estimated_nodes")))
    out = out.withColumn("adjusted", F.when(F.col("jaccard").isNotNull(), scaled_jaccard(F.col("jaccard"), F.col("node_ratio"))))
    out = out.withColumn("clamped", F.when(F.col("jaccard").isNotNull(), scaled_jaccard(F.col("jaccard"), F.col("node_ratio"), True))).withColumn("weight", F.col("tp") + F.col("fp") + F.col("fn"))
    if division_counts is not None:
        out = out.join(division_counts.select("dataset", "div_tp", "div_fp", "div_fn"), "dataset", "left").fillna(0, ["div_tp", "div_fp", "div_fn"])
        out = out.withColumn("div_jaccard", jaccard(F.col("div_tp"), F.col("div_fp"), F.col("div_fn")))
    return out


def weighted_mean(value: Column, weight: Column) -> Column:
    """The mean of defined values; null without weight."""
    return F.try_divide(F.sum(F.when(value.isNotNull(), value * weight)), F.sum(F.when(value.isNotNull(), weight)).cast("double"))


def split_score(metrics: DataFrame) -> DataFrame:
    """One row: weighted adjusted Jaccard, plus a tenth of the weighted division Jaccard where that is defined."""
    w = F.col("weight")
    div = F.col("div_tp") + F.col("div_fp") + F.col("div_fn")
    out = metrics.agg(weighted_mean(F.col("adjusted"), w).alias("adjusted"), weighted_mean(F.col("clamped"), w).alias("clamped"), weighted_mean(F.col("div_jaccard"), div).alias("division"))
    return out.withColumn("score", F.col("adjusted") + F.coalesce(0.1 * F.col("division"), F.lit(0.0)))


def micro(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts summed, then the ratio; ``by`` pools within groups."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    out = counts.groupBy(*by).agg(*sums) if by else counts.agg(*sums)
    return out.withColumn("jaccard", jaccard(F.col("tp"), F.col("fp"), F.col("fn")))


def acquisition_rollup(counts: DataFrame) -> DataFrame:
    """Counts by prefix and dataset, by prefix, and pooled."""
    out = counts.withColumn("prefix", F.substring("dataset", 1, 1)).rollup("prefix", "dataset").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return out.withColumn("jaccard", jaccard(F.col("tp"), F.col("fp"), F.col("fn")))


def auc(scored: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank AUC with ties at one half, null where a class is missing, and the classes' sizes.

    Scores are first counted, so ranks come from one row a score; a group's window holds its distinct scores.
    """
    yes = F.col(label).cast("long")
    per = scored.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(yes).alias("_p"), F.count(F.lit(1)).alias("_n"))
    below = W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    ranked = per.withColumn("_rank2", 2 * F.coalesce(F.sum("_n").over(below), F.lit(0)) + F.col("_n") + 1)
    sums = [F.sum(F.col("_rank2") * F.col("_p")).alias("_r2"), F.sum("_p").alias("n_pos"), (F.sum("_n") - F.sum("_p")).alias("n_neg")]
    out = ranked.groupBy(*by).agg(*sums) if by else ranked.agg(*sums)
    u2 = F.col("_r2") - F.col("n_pos") * (F.col("n_pos") + 1)
    return out.select(*by, "n_pos", "n_neg", F.try_divide(u2.cast("double"), 2 * F.col("n_pos") * F.col("n_neg")).alias("auc"))


def average_precision(scored: DataFrame, score: str, label: str, order: str, by: tuple[str, ...]) -> DataFrame:
    """Area under precision over recall steps, by score downwards, equal scores by ``order`` downwards; one window a group."""
    w = W.partitionBy(*by).orderBy(F.desc(score), F.desc(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    yes = F.col(label).cast("long")
    ran = scored.withColumn("_tp", F.sum(yes).over(w)).withColumn("_k", F.count(F.lit(1)).over(w)).withColumn("_y", yes)
    return ran.groupBy(*by).agg(F.sum("_y").alias("n_pos"), F.try_divide(F.sum(F.when(F.col("_y") == 1, F.col("_tp") / F.col("_k"))), F.sum("_y").cast("double")).alias("ap"))


def active_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs whose source or target is in a true pair, with ``is_true``."""
    flagged = in_set(pairs, truth, "source_id", "target_id", "is_true")
    s = truth.select("dataset", "source_id").distinct().withColumn("_s", F.lit(True))
    t = truth.select("dataset", "target_id").distinct().withColumn("_t", F.lit(True))
    return flagged.join(s, ["dataset", "source_id"], "left").join(t, ["dataset", "target_id"], "left").filter("_s or _t").drop("_s", "_t")
