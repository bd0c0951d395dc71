"""Link costs, evidence weights and fusion of seeds, as windows and projections over candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

GAP = ("dataset", "t")


def softmax(value: Column, over: W) -> Column:
    """Stable softmax of a column over a window."""
    e = F.exp(value - F.max(value).over(over))
    return e / F.sum(e).over(over)


def by_target() -> W:
    return W.partitionBy(*GAP, "target_id")


def by_source() -> W:
    return W.partitionBy(*GAP, "source_id")


def admissible(pairs: DataFrame, p: str, gate: float) -> DataFrame:
    """p renormalised over the parents within the gate; unchanged where those have no mass."""
    inside = F.when(F.col("d") <= gate, F.col(p)).otherwise(0.0)
    mass = F.sum(inside).over(by_target())
    return pairs.withColumn("_mass", mass).withColumn(p, F.when(F.col("_mass") > 0, inside / F.col("_mass")).otherwise(F.col(p))).drop("_mass")


def evidence_ramp(pairs: DataFrame, gate: float, slope: float) -> DataFrame:
    """With ``weight`` max(0, 1 + slope (d / mean in-gate d - 1)); 1 where the gap's mean isn't positive."""
    mean = F.avg(F.when(F.col("d") <= gate, F.col("d"))).over(W.partitionBy(*GAP))
    return pairs.withColumn("_mean", mean).withColumn("weight", F.when(F.col("_mean") > 0, F.greatest(F.lit(0.0), 1 + slope * (F.col("d") / F.col("_mean") - 1))).otherwise(1.0)).drop("_mean")


def bonus_cost(pairs: DataFrame, bonus: float, weight: str | None = None) -> DataFrame:
    """With ``cost`` d - bonus * weight * p."""
    w = F.col(weight) if weight else F.lit(1.0)
    return pairs.withColumn("cost", F.col("d") - bonus * w * F.col("p"))


def agreement_gate(pairs: DataFrame, mutual: DataFrame, floor: float) -> DataFrame:
    """Pairs whose mutual probability reaches the floor; gaps that weren't scored keep all of theirs."""
    scored = mutual.select(*GAP).distinct().withColumn("_scored", F.lit(True))
    m = mutual.select("dataset", "source_id", "target_id", F.col("p").alias("_mutual"))
    j = pairs.join(scored, list(GAP), "left").join(m, ["dataset", "source_id", "target_id"], "left")
    return j.filter(F.col("_scored").isNull() | (F.coalesce("_mutual", F.lit(0.0)) >= floor)).drop("_scored", "_mutual")


def boundary_factor(nodes: DataFrame, margin: float) -> DataFrame:
    """Nodes with ``factor``: 0 within the margin of a face of the points' box or in the first or last frame, else 1."""
    axes = ("uz", "uy", "ux")
    box = nodes.groupBy("dataset").agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"), *[f(a).alias(f"_{n}{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))])
    j = nodes.join(box, "dataset")
    face = F.lit(False)
    for a in axes:
        face = face | (F.least(F.col(a) - F.col(f"_lo{a}"), F.col(f"_hi{a}") - F.col(a)) <= margin)
    explained = face | (F.col("t") == F.col("_t0")) | (F.col("t") == F.col("_t1"))
    return j.select("dataset", "node_id", "t", F.when(explained, 0).otherwise(1).alias("factor"))


def evidence_factor(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes with ``factor``: incoming in-gate mass over its mean in the frame, 1 where that isn't positive or in the first frame."""
    mass = pairs.groupBy("dataset", F.col("target_id").alias("node_id")).agg(F.sum("p").alias("_m"))
    j = nodes.select("dataset", "node_id", "t").join(mass, ["dataset", "node_id"], "left").fillna(0.0, ["_m"])
    mean = F.avg("_m").over(W.partitionBy(*GAP))
    first = F.min("t").over(W.partitionBy("dataset"))
    return j.withColumn("_mean", mean).withColumn("_first", first).select("dataset", "node_id", "t", F.when((F.col("_mean") > 0) & (F.col("t") > F.col("_first")), F.col("_m") / F.col("_mean")).otherwise(1.0).alias("factor"))


def expert_cost(pairs: DataFrame, sigma: float, motion_weight: float = 1.0) -> DataFrame:
    """Product of experts: with ``cost`` -(ln p + weight * motion log-likelihood)."""
    ln_p = F.ln(F.greatest(F.col("p"), F.lit(1e-12)))
    return pairs.withColumn("cost", -(ln_p + motion_weight * (-(F.col("d") * F.col("d")) / (2 * sigma * sigma))))


def blended(seeds: DataFrame, weights: dict[int, float]) -> DataFrame:
    """Seeds' logits (dataset, t, source_id, target_id, seed, logit) blended, and p by softmax over a target's sources."""
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights of seeds must sum to 1")
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("seed"))
    one = seeds.groupBy(*GAP, "source_id", "target_id").agg(F.sum(w * F.col("logit")).alias("logit"))
    return one.withColumn("p", softmax(F.col("logit"), by_target()))


def bidirectional(pairs: DataFrame, weight: float) -> DataFrame:
    """With forward (over sources), reverse (over targets) and fused probabilities of ``logit``."""
    fwd, rev = softmax(F.col("logit"), by_target()), softmax(F.col("logit"), by_source())
    fused = F.col("forward") * F.col("reverse") / F.greatest((1 - weight) * F.col("reverse") + weight * F.col("forward"), F.lit(1e-12))
    return pairs.withColumn("forward", fwd).withColumn("reverse", rev).withColumn("fused", fused)


def moment_aligned(pairs: DataFrame, logit: str, reference: str, over: W, low: float = 0.5, high: float = 2.0, least_std: float = 1e-4) -> Column:
    """A column's logits moved to the reference's mean and spread within the window; the ratio of spreads is clamped."""
    mean, ref_mean = F.avg(logit).over(over), F.avg(reference).over(over)
    ratio = F.stddev_pop(reference).over(over) / F.greatest(F.stddev_pop(logit).over(over), F.lit(least_std))
    return (F.col(logit) - mean) * F.least(F.greatest(ratio, F.lit(low)), F.lit(high)) + ref_mean


def js_pool(views: DataFrame) -> DataFrame:
    """Log-opinion pool of views (view, dataset, t, source_id, target_id, p): views far from their mean in Jensen-Shannon
    divergence weigh 1 / (1 + divergence / lower median divergence) for each target."""
    keys = [*GAP, "target_id"]
    mean = F.avg("p").over(W.partitionBy(*keys, "source_id"))
    kl = lambda p, q: F.when(p > 0, p * F.ln(p / q)).otherwise(0.0)
    m = (F.col("p") + F.col("_mean")) / 2
    js = views.withColumn("_mean", mean).groupBy("view", *keys).agg(F.sum(kl(F.col("p"), m) / 2 + kl(F.col("_mean"), m) / 2).alias("_js"))
    mid = F.percentile_disc(0.5, "_js") if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.5) within group (order by _js)")
    median = js.groupBy(*keys).agg(mid.alias("_med"))
    weighed = js.join(median, keys).withColumn("_w", F.when(F.col("_med") > 0, 1 / (1 + F.col("_js") / F.col("_med"))).otherwise(1.0))
    pooled = views.join(weighed.select("view", *keys, "_w"), ["view", *keys]).groupBy(*keys, "source_id").agg((F.sum(F.col("_w") * F.ln(F.greatest("p", F.lit(1e-12)))) / F.sum("_w")).alias("logit"))
    return pooled.withColumn("p", softmax(F.col("logit"), by_target()))


def margins(pairs: DataFrame) -> DataFrame:
    """For each target the gap between its two best p (1 with one source), its best source and the number of sources."""
    r = F.row_number().over(W.partitionBy(*GAP, "target_id").orderBy(F.desc("p"), "source_id"))
    top = pairs.withColumn("_r", r).groupBy(*GAP, "target_id").agg(F.max(F.when(F.col("_r") == 1, F.col("p"))).alias("_a"), F.max(F.when(F.col("_r") == 2, F.col("p"))).alias("_b"), F.max(F.when(F.col("_r") == 1, F.col("source_id"))).alias("best_source"), F.count(F.lit(1)).alias("n_sources"))
    return top.select(*GAP, "target_id", "best_source", "n_sources", F.coalesce(F.col("_a") - F.col("_b"), F.lit(1.0)).alias("margin"))


def calibrated(primary: DataFrame, second: DataFrame, margin: float = 0.35, weight: float = 0.15, candidate: float = 0.48, retention: float = 0.90) -> DataFrame:
    """Fusion where it is safe: targets whose primary margin is under ``margin`` and whose two best sources agree take
    (1 - weight) p + weight q; a gap that would lose over a tenth of its pairs at the candidate level keeps its primary."""
    keys = [*GAP, "source_id", "target_id"]
    a, b = margins(primary), margins(second).select(*GAP, "target_id", F.col("best_source").alias("_other"))
    safe = a.join(b, [*GAP, "target_id"]).select(*GAP, "target_id", ((F.col("margin") < margin) & (F.col("best_source") == F.col("_other"))).alias("_safe"))
    j = primary.select(*keys, "p").join(second.select(*keys, F.col("p").alias("_q")), keys, "left").join(safe, [*GAP, "target_id"], "left")
    j = j.withColumn("_f", F.when(F.coalesce("_safe", F.lit(False)) & F.col("_q").isNotNull(), (1 - weight) * F.col("p") + weight * F.col("_q")).otherwise(F.col("p")))
    gap = W.partitionBy(*GAP)
    before, after = F.sum((F.col("p") >= candidate).cast("long")).over(gap), F.sum((F.col("_f") >= candidate).cast("long")).over(gap)
    return j.withColumn("_b", before).withColumn("_a", after).select(*keys, F.when(F.col("_a") >= retention * F.col("_b"), F.col("_f")).otherwise(F.col("p")).alias("p"))


def expected_step(nodes: DataFrame, affinity: DataFrame, damping: float = 0.5) -> DataFrame:
    """For each node the p-weighted mean of its incoming displacements times the damping: dataset, node_id, vz, vy, vx."""
    xyz = ("uz", "uy", "ux")
    s = nodes.select("dataset", F.col("node_id").alias("source_id"), *[F.col(a).alias(f"s_{a}") for a in xyz])
    t = nodes.select("dataset", F.col("node_id").alias("target_id"), *[F.col(a).alias(f"t_{a}") for a in xyz])
    j = affinity.join(s, ["dataset", "source_id"]).join(t, ["dataset", "target_id"])
    return j.groupBy("dataset", F.col("target_id").alias("node_id")).agg(*[(damping * F.sum(F.col("p") * (F.col(f"t_{a}") - F.col(f"s_{a}"))) / F.sum("p")).alias(f"v{a[1]}") for a in xyz])
