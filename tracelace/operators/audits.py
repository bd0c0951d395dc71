"""Audits of predicted links: rivals, thieves, oracle plans for forks, pruning and operating-point grids, paced difficulty."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.operators.diagnose import matched_truth
from tracelace.operators.joins import in_set


def candidate_triples(pairs: DataFrame, truth: DataFrame, links: DataFrame) -> DataFrame:
    """For each source with a true and a wrong candidate, the nearest of each: dataset, source_id, true_id, rival_id, d_true,
    d_rival, and mislinked if the link goes to the rival and not to the truth. Of equal distances the lesser id counts."""
    flagged = in_set(pairs.select("dataset", "source_id", "target_id", "d"), truth, "source_id", "target_id", "_y")
    at = F.struct("d", F.col("target_id").alias("id"))
    one = flagged.groupBy("dataset", "source_id").agg(F.min(F.when(F.col("_y"), at)).alias("_t"), F.min(F.when(~F.col("_y"), at)).alias("_r")).filter("_t is not null and _r is not null")
    one = one.select("dataset", "source_id", F.col("_t.id").alias("true_id"), F.col("_r.id").alias("rival_id"), F.col("_t.d").alias("d_true"), F.col("_r.d").alias("d_rival"))
    got = in_set(in_set(one, links, "source_id", "rival_id", "_wrong"), links, "source_id", "true_id", "_right")
    return got.withColumn("mislinked", F.col("_wrong") & ~F.col("_right")).drop("_wrong", "_right")


def thieves(found: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """For truth edges that lost their target to another parent: the thief (the least id) and the size of its component."""
    lost = found.filter("fate = 'MISLINK_CONFLICT'").select("dataset", "source_id", "target_id", "pred_target")
    parent = links.groupBy("dataset", F.col("target_id").alias("pred_target")).agg(F.min("source_id").alias("thief"))
    size = labels.groupBy("dataset", "component").agg(F.count(F.lit(1)).alias("size"))
    of = labels.join(size, ["dataset", "component"]).select("dataset", F.col("node_id").alias("thief"), "size")
    return lost.join(parent, ["dataset", "pred_target"]).join(of, ["dataset", "thief"], "left").select("dataset", "source_id", "target_id", "thief", "size")


def reparent_plan(truth_edges: DataFrame, match: DataFrame, links: DataFrame) -> DataFrame:
    """Moves that put every matched daughter under her matched parent: dataset, parent, daughter, claimed_by (null if none).

    Only divisions whose parent and daughters, two at least, are all matched; a daughter already there doesn't move.
    """
    e = matched_truth(truth_edges.select("dataset", "source_id", "target_id"), match)
    w = W.partitionBy("dataset", "source_id")
    e = e.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_m", F.count("pred_target").over(w)).filter("_n >= 2 and _m = _n and pred_source is not null")
    e = in_set(e, links, "pred_source", "pred_target", "_there").filter("not _there")
    held = links.groupBy("dataset", F.col("target_id").alias("pred_target")).agg(F.min_by("source_id", "edge_seq").alias("claimed_by"))
    return e.join(held, ["dataset", "pred_target"], "left").select("dataset", F.col("pred_source").alias("parent"), F.col("pred_target").alias("daughter"), "claimed_by")


def fork_cull(links: DataFrame, match: DataFrame, truth_edges: DataFrame, affinity: DataFrame, blind: bool = False) -> DataFrame:
    """Branches to drop (dataset, parent, dropped_id): each fork keeps its best branch, by 1000 for a match and p.

    Forks whose matched truth divides stay whole. The blind arm knows no matches: it cuts every fork and ranks by p. Of equal
    branches the earlier stays.
    """
    w = W.partitionBy("dataset", "source_id")
    forks = links.select("dataset", "source_id", "target_id", "edge_seq").withColumn("_n", F.count(F.lit(1)).over(w)).filter("_n >= 2").drop("_n")
    forks = forks.join(affinity.select("dataset", "source_id", "target_id", "p"), ["dataset", "source_id", "target_id"], "left")
    rank: Column = F.coalesce("p", F.lit(0.0))
    if not blind:
        m = match.filter("gt_id is not null").select("dataset", "pred_id", "gt_id")
        divides = truth_edges.groupBy("dataset", F.col("source_id").alias("gt_id")).agg(F.count_distinct("target_id").alias("_k")).filter("_k >= 2")
        whole = m.join(divides, ["dataset", "gt_id"]).select("dataset", F.col("pred_id").alias("source_id"))
        child = m.select("dataset", F.col("pred_id").alias("target_id")).distinct().withColumn("_m", F.lit(1000.0))
        forks = forks.join(whole, ["dataset", "source_id"], "left_anti").join(child, ["dataset", "target_id"], "left")
        rank = rank + F.coalesce("_m", F.lit(0.0))
    order = F.row_number().over(w.orderBy(rank.desc(), "edge_seq", "target_id"))
    return forks.withColumn("_r", order).filter("_r > 1").select("dataset", F.col("source_id").alias("parent"), F.col("target_id").alias("dropped_id"))


def drawn(ident: Column, salt: Column) -> Column:
    """A number in [0, 1) from an id and a salt, the same in every run and engine."""
    return F.pmod(ident * 48271 + salt * 40692, F.lit(999983)) / 999983.0


#: Cells of a grid that a mask has a bit for.
MOST_CELLS = 60


def prune_grid(affinity: DataFrame, truth: DataFrame, nodes: DataFrame, real: DataFrame, grid: Sequence[tuple[float, float]]) -> DataFrame:
    """For each (recall, collateral): how many true candidates stand and are the best of both ends (kept), and how many lost
    an end (destroyed), after a pruner takes false detections with the chance ``recall`` and real ones with ``collateral``.

    A candidate is one row for all cells: what stands in a cell, and what is best there, are bits of a number.
    """
    parts = [_pruned(affinity, truth, nodes, real, list(enumerate(grid))[i : i + MOST_CELLS]) for i in range(0, len(grid), MOST_CELLS)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("recall", "collateral").agg(*[F.sum(c).alias(c) for c in ("kept", "destroyed", "total")])


def _pruned(affinity: DataFrame, truth: DataFrame, nodes: DataFrame, real: DataFrame, cells: Sequence[tuple[int, tuple[float, float]]]) -> DataFrame:
    def mask(of: Callable[[int], Column]) -> Column:
        return reduce(Column.bitwiseOR, [F.when(of(i), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(len(cells))])

    def has(bits: str, i: int) -> Column:
        return F.col(bits).bitwiseAND(F.lit(1 << i).cast("long")) != 0

    chance = lambda i: F.when(F.col("_real"), F.lit(float(cells[i][1][1]))).otherwise(F.lit(float(cells[i][1][0])))
    n = nodes.select("dataset", "node_id").join(real.select("dataset", "node_id").distinct().withColumn("_real", F.lit(True)), ["dataset", "node_id"], "left")
    n = n.select("dataset", "node_id", mask(lambda i: drawn(F.col("node_id"), F.lit(cells[i][0])) >= chance(i)).alias("_alive"))
    end = lambda key, flag: n.select("dataset", F.col("node_id").alias(key), F.col("_alive").alias(flag)).hint("merge")
    flagged = in_set(affinity.select("dataset", "source_id", "target_id", "p"), truth, "source_id", "target_id", "_y")
    # the join with sources comes last, so that it deals candidates as their best ones are sought
    both = flagged.join(end("target_id", "_t"), ["dataset", "target_id"]).join(end("source_id", "_s"), ["dataset", "source_id"])
    both = both.select("dataset", "source_id", "target_id", "p", "_y", F.col("_s").bitwiseAND(F.col("_t")).alias("_best"), F.col("_s").bitwiseAND(F.col("_t")).alias("_live"))
    for key in ("source_id", "target_id"):
        w = W.partitionBy("dataset", key)
        top = both.select("*", *[F.max(F.when(has("_live", i), F.col("p"))).over(w).alias(f"_m{i}") for i in range(len(cells))])
        both = top.withColumn("_best", F.col("_best").bitwiseAND(mask(lambda i: F.col("p") >= F.col(f"_m{i}")))).select(*both.columns)
    counts = both.filter("_y").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(has("_best", i)).alias(f"_k{i}") for i in range(len(cells))], *[F.count_if(~has("_live", i)).alias(f"_d{i}") for i in range(len(cells))])
    rows = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("recall"), F.lit(float(c)).alias("collateral"), F.col(f"_k{i}").alias("kept"), F.col(f"_d{i}").alias("destroyed")) for i, (_, (r, c)) in enumerate(cells)])).alias("_c")
    return counts.filter("total > 0").select(rows, "total").select("_c.*", "total")


def operating_points(affinity: DataFrame, truth: DataFrame, thresholds: Sequence[float], gates: Sequence[float]) -> DataFrame:
    """Counts of the best parent of each target at every threshold of p and gate of d: dataset, threshold, gate, tp, fp.

    The best parent within a gate doesn't depend on the threshold, so only gates multiply the pairs.
    """
    flagged = in_set(affinity.select("dataset", "source_id", "target_id", "d", "p"), truth, "source_id", "target_id", "_y")
    gated = flagged.withColumn("gate", F.explode(F.array(*[F.lit(float(g)) for g in gates]))).filter("d <= gate")
    best = gated.groupBy("dataset", "gate", "target_id").agg(F.max(F.struct("p", (-F.col("source_id")).alias("_s"), "_y")).alias("_b"))
    at = best.select("dataset", "gate", "_b.p", "_b._y", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    kept = F.col("p") >= F.col("threshold")
    return at.groupBy("dataset", "threshold", "gate").agg(F.count_if(kept & F.col("_y")).alias("tp"), F.count_if(kept & ~F.col("_y")).alias("fp"))


def longest_chain(chained: DataFrame) -> DataFrame:
    """The longest chain of each dataset, of equal ones the least: dataset, chain_id, n_nodes."""
    n = chained.groupBy("dataset", "chain_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return n.groupBy("dataset").agg(F.max(F.struct("n_nodes", (-F.col("chain_id")).alias("c"))).alias("m")).select("dataset", (-F.col("m.c")).alias("chain_id"), "m.n_nodes")


def paced_difficulty(scores: DataFrame, order: str, score: str, rate: float = 0.1, start: float = 1.0) -> DataFrame:
    """For each dataset the difficulty after its scores in order: each step moves it by ``rate`` to 1 where the score is a new
    best and to 0 where not. An exponential mean is a fold over the ordered scores; a dataset has one score a window."""
    seen = W.partitionBy("dataset").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    best = F.max(score).over(seen)
    better = F.when(best.isNull() | (F.col(score) > best), 1.0).otherwise(0.0)
    run = scores.select("dataset", F.col(order).alias("_o"), better.alias("_b")).groupBy("dataset").agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_b"))), lambda x: x["_b"]).alias("_a"))
    folded = F.aggregate("_a", F.lit(float(start)), lambda s, x: (1 - rate) * s + rate * x)
    return run.select("dataset", F.size("_a").alias("windows"), folded.alias("difficulty"))


def decoy_margin(pairs: DataFrame, decoys: DataFrame, truth: DataFrame, logit: str, most: float = 50.0) -> DataFrame:
    """The mean of softplus(decoy's logit - the least true logit) over a dataset's decoys, the difference held at ``most``."""
    lit = pairs.select("dataset", "source_id", "target_id", F.col(logit).alias("_l"))
    true = lit.join(truth.select("dataset", "source_id", "target_id"), ["dataset", "source_id", "target_id"], "left_semi").groupBy("dataset", "source_id").agg(F.min("_l").alias("_true"))
    margin = F.least(F.col("_l") - F.col("_true"), F.lit(float(most)))
    got = decoys.select("dataset", "source_id", "target_id").join(lit, ["dataset", "source_id", "target_id"]).join(true, ["dataset", "source_id"])
    return got.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg(F.log1p(F.exp(margin))).alias("loss"))
