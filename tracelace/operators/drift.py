"""Drift fields: weighted votes of displacements around anchors, read back at points by Gaussian interpolation.

Anchors of a dataset are as many as its volume holds at their spacing, whatever the number of points. Votes and anchors
meet within four sigmas; what an anchor receives is summed by displacement before anything is ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.functions.geometry import norm
from tracelace.storage import written

#: Side of a bin of displacements, and the least sum of weights that a mean is divided by.
BIN, FLOOR = 0.8125, 1e-3
#: Weights beyond so many sigmas (3e-4 and less) are left out.
REACH = 4.0
#: Votes or points in a part: with some 48 anchors each, a million rows.
PART = 20_000


def votes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """dataset, t, the origin uz, uy, ux and the displacement dz, dy, dx of every pair."""
    a = nodes.select("dataset", F.col("node_id").alias("source_id"), "uz", "uy", "ux")
    b = nodes.select("dataset", F.col("node_id").alias("target_id"), *[F.col(f"u{c}").alias(f"_{c}") for c in "zyx"])
    both = pairs.select("dataset", "t", "source_id", "target_id").join(a, ["dataset", "source_id"]).join(b, ["dataset", "target_id"])
    return both.select("dataset", "t", "uz", "uy", "ux", *[(F.col(f"_{c}") - F.col(f"u{c}")).alias(f"d{c}") for c in "zyx"])


def anchors(nodes: DataFrame, spacing: float) -> DataFrame:
    """dataset and az, ay, ax of a regular grid from a dataset's least coordinates to beyond its largest."""
    span = nodes.groupBy("dataset").agg(*[f(f"u{c}").alias(f"_{n}{c}") for c in "zyx" for n, f in (("lo", F.min), ("hi", F.max))])
    for c in "zyx":
        steps = F.ceil((F.col(f"_hi{c}") + spacing - F.col(f"_lo{c}")) / spacing).cast("int")
        span = span.withColumn(f"_i{c}", F.explode(F.sequence(F.lit(0), steps - 1)))
    return span.select("dataset", *[(F.col(f"_lo{c}") + F.col(f"_i{c}") * spacing).alias(f"a{c}") for c in "zyx"])


def _weight(sigma: float) -> tuple[Column, Column]:
    d = norm(*[F.col(f"a{c}") - F.col(f"u{c}") for c in "zyx"])
    return d <= REACH * sigma, F.exp(-0.5 * (d / sigma) * (d / sigma))


def _dealt(rows: DataFrame, held: DataFrame) -> DataFrame:
    """``rows`` by gap in as many parts as ``held`` has ``PART`` rows, so that a task's groups don't grow with the table."""
    return rows.repartition(max(1, math.ceil(held.count() / PART)), "dataset", "t")


def field(cast: DataFrame, at: DataFrame, sigma: float) -> DataFrame:
    """dataset, t, az, ay, ax, vz, vy, vx, sharpness at every anchor that a vote of the gap reaches.

    The vector is the weighted mean of the displacements within a bin's side of the heaviest bin's centre (equal masses:
    the least bin), and the sharpness that bin's share of the weights. Votes and anchors meet by gap, and all that follows
    stays in the gap's part.
    """
    near, w = _weight(sigma)
    key = ["dataset", "t", "az", "ay", "ax"]
    cast = written(cast, "votes")
    gaps = cast.select("dataset", "t").distinct().join(at, "dataset")
    held = _dealt(cast, cast).join(gaps.hint("merge"), ["dataset", "t"]).filter(near).groupBy(*key, "dz", "dy", "dx").agg(F.sum(w).alias("w"))
    bins = ["bz", "by", "bx"]
    mass = held.withColumns({f"b{c}": F.rint(F.col(f"d{c}") / BIN) for c in "zyx"}).withColumn("m", F.sum("w").over(W.partitionBy(*key, *bins)))
    here = W.partitionBy(*key)
    by_peak = mass.select(*key, "dz", "dy", "dx", "w", F.min(F.struct((-F.round("m", 9)).alias("r"), *bins, "m")).over(here).alias("_p"), F.sum("w").over(here).alias("_all")).select(*key, "dz", "dy", "dx", "w", "_all", "_p.*")
    close = norm(*[F.col(f"d{c}") - F.col(f"b{c}") * BIN for c in "zyx"]) <= BIN
    one = [F.first(c).alias(c) for c in (*bins, "m", "_all")]
    sums = by_peak.groupBy(*key).agg(*one, F.sum(F.when(close, F.col("w"))).alias("_w"), *[F.sum(F.when(close, F.col("w") * F.col(f"d{c}"))).alias(f"_{c}") for c in "zyx"])
    mean = lambda c: F.when(F.col("_w") > 0, F.col(f"_{c}") / F.greatest("_w", F.lit(FLOOR))).otherwise(F.col(f"b{c}") * BIN)
    return sums.select(*key, *[mean(c).alias(f"v{c}") for c in "zyx"], (F.col("m") / F.greatest("_all", F.lit(FLOOR))).alias("sharpness"))


def at_points(points: DataFrame, fields: DataFrame, sigma: float) -> DataFrame:
    """dataset, node_id and fz, fy, fx: the field of the points' own gap, weighted over the anchors around them; 0 without any."""
    near, w = _weight(sigma)
    slim = points.select("dataset", "t", "node_id", "uz", "uy", "ux")
    met = _dealt(slim, slim).join(fields.drop("sharpness").hint("merge"), ["dataset", "t"], "left").withColumn("w", F.when(near, w))
    sums = met.groupBy("dataset", "t", "node_id").agg(F.sum("w").alias("_w"), *[F.sum(F.col("w") * F.col(f"v{c}")).alias(f"_{c}") for c in "zyx"])
    mean = lambda c: F.coalesce(F.col(f"_{c}") / F.greatest("_w", F.lit(FLOOR)), F.lit(0.0))
    return sums.select("dataset", "node_id", *[mean(c).alias(f"f{c}") for c in "zyx"])


def reordered(pairs: DataFrame, true: DataFrame, nodes: DataFrame, drift: DataFrame) -> DataFrame:
    """For sources with a true candidate and a rival (the nearest other one): raw_gap and corrected_gap, d(true) - d(rival)
    from the source and from where the drift takes it."""
    flag = pairs.select("dataset", "source_id", "target_id", "d").join(true.select("dataset", "source_id", "target_id").distinct().withColumn("_y", F.lit(True)), ["dataset", "source_id", "target_id"], "left")
    one = flag.groupBy("dataset", "source_id").agg(F.min(F.when(F.col("_y"), F.struct("d", "target_id"))).alias("_t"), F.min(F.when(F.col("_y").isNull(), F.struct("d", "target_id"))).alias("_r")).filter("_t is not null and _r is not null")
    at = nodes.select("dataset", F.col("node_id"), "uz", "uy", "ux")
    place = lambda df, key, p: df.join(at.select("dataset", F.col("node_id").alias(key), *[F.col(f"u{c}").alias(f"{p}{c}") for c in "zyx"]), ["dataset", key])
    rows = one.select("dataset", "source_id", F.col("_t.target_id").alias("true_id"), F.col("_r.target_id").alias("rival_id"))
    rows = place(place(place(rows, "source_id", "s"), "true_id", "t"), "rival_id", "r").join(drift.withColumnRenamed("node_id", "source_id"), ["dataset", "source_id"])
    gap = lambda o: norm(*[F.col(f"t{c}") - o(c) for c in "zyx"]) - norm(*[F.col(f"r{c}") - o(c) for c in "zyx"])
    return rows.select("dataset", "source_id", gap(lambda c: F.col(f"s{c}")).alias("raw_gap"), gap(lambda c: F.col(f"s{c}") + F.col(f"f{c}")).alias("corrected_gap"))
