"""Features of candidate links and of detections, and a small network over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.operators.joins import crowding

XYZ = ("uz", "uy", "ux")
#: The features in the order in which a network takes them.
NAMES = ("dz", "dy", "dx", "d", "xy", "abs_z", "t_norm", "d_rank", "n_candidates", "t_rank", "n_sources", "p", "best_out", "best_in", "margin_out", "margin_in", "near_source", "near_target")


def of_pairs(nodes: DataFrame, affinity: DataFrame, radius: float) -> DataFrame:
    """dataset, source_id, target_id and NAMES: displacement, place in time, ranks and counts within both ends' candidates,
    the best p of either end and how far this one is from it, and how crowded the ends are."""
    at = nodes.select("dataset", "node_id", "t", *XYZ).join(crowding(nodes, radius), ["dataset", "node_id"])
    last = nodes.groupBy("dataset").agg(F.max("t").alias("_last"))
    s = at.select("dataset", F.col("node_id").alias("source_id"), *[F.col(c).alias(f"s_{c}") for c in XYZ], F.col("n_near").alias("near_source"))
    t = at.select("dataset", F.col("node_id").alias("target_id"), *[F.col(c).alias(f"t_{c}") for c in XYZ], F.col("n_near").alias("near_target"))
    j = affinity.join(s, ["dataset", "source_id"]).join(t, ["dataset", "target_id"]).join(last, "dataset")
    j = j.withColumns({f"d{a[1]}": F.col(f"t_{a}") - F.col(f"s_{a}") for a in XYZ})
    out, into = W.partitionBy("dataset", "source_id"), W.partitionBy("dataset", "target_id")
    j = j.withColumns(
        {
            "xy": F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")),
            "abs_z": F.abs("dz"),
            "t_norm": F.when(F.col("_last") > 0, F.col("t") / F.col("_last")).otherwise(0.0),
            "d_rank": F.row_number().over(out.orderBy("d", "target_id")),
            "n_candidates": F.count(F.lit(1)).over(out),
            "t_rank": F.row_number().over(into.orderBy("d", "source_id")),
            "n_sources": F.count(F.lit(1)).over(into),
            "best_out": F.max("p").over(out),
            "best_in": F.max("p").over(into),
        }
    )
    j = j.withColumn("margin_out", F.col("best_out") - F.col("p")).withColumn("margin_in", F.col("best_in") - F.col("p"))
    return j.select("dataset", "source_id", "target_id", *[F.col(n).cast("double").alias(n) for n in NAMES])


def moments(features: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """feature, mean and population deviation, a row for each feature."""
    aggs = [f(n).alias(f"{n}_{k}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    one = features.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"{n}_m").alias("mean"), F.col(f"{n}_s").alias("std")) for n in names])).alias("x")).select("x.*")


def drift(live: DataFrame, training: DataFrame, far: float = 1.0) -> DataFrame:
    """How far each feature's mean has moved in training deviations, the ratio of deviations, and whether it is far."""
    t = training.select("feature", F.col("mean").alias("_m"), F.greatest("std", F.lit(1e-6)).alias("_s"))
    j = live.join(t, "feature").withColumn("shift", F.abs(F.col("mean") - F.col("_m")) / F.col("_s")).withColumn("spread", F.col("std") / F.col("_s"))
    return j.select("feature", "shift", "spread", (F.col("shift") > far).alias("drifted"))


def network(weights: list[tuple[np.ndarray, np.ndarray]], norm: tuple[np.ndarray, np.ndarray], mean: np.ndarray, std: np.ndarray):
    """A function of a feature matrix: standardised, linear, layer-normed, rectified, then linear layers with rectifiers between and a sigmoid."""

    def score(x: np.ndarray) -> np.ndarray:
        h = (x - mean) / np.maximum(std, 1e-6) @ weights[0][0] + weights[0][1]
        h = (h - h.mean(axis=1, keepdims=True)) / np.sqrt(h.var(axis=1, keepdims=True) + 1e-5) * norm[0] + norm[1]
        for w, b in weights[1:]:
            h = np.maximum(h, 0) @ w + b
        return 1 / (1 + np.exp(-h[:, 0]))

    return score


def scored(features: DataFrame, score, names: tuple[str, ...] = NAMES) -> DataFrame:
    """Features with ``ranker``, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["dataset", "source_id", "target_id"]].assign(ranker=score(pdf[list(names)].to_numpy(float)))

    return features.mapInPandas(run, "dataset string, source_id long, target_id long, ranker double")


def reachable(edges: DataFrame, starts: DataFrame, a: str, b: str, most: int | None = None) -> DataFrame:
    """(node, hops): what the starts reach along edges and in how many steps at least, ``most`` steps where given; a written frontier a round."""
    from tracelace.storage import written

    step = written(edges.select(F.col(a).alias("node"), F.col(b).alias("_next")).distinct(), "reach-steps")
    front = written(starts.select("node").distinct().withColumn("hops", F.lit(0)), "reached")
    seen, k = front, 0
    while most is None or k < most:
        k += 1
        found = front.join(step, "node").select(F.col("_next").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(k))
        front = written(found, "reached-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
