"""Operators on single points: confirmation, lattice collisions, shrinking, shears and mirrors, crops, census, linear fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.functions.geometry import AXES, norm


def confirmed(points: DataFrame, heat: DataFrame, window: tuple[int, int, int], floor: float) -> DataFrame:
    """``points`` with ``confirmed``: the largest heat (dataset, t, z, y, x, v) in the window around reaches the floor; true where there is none.

    A point goes to the cells of the window's size that its window touches, 8 at most, so no frame is compared with itself
    whole. Emitted points are more than Spark reckons from the table's size, so they are never broadcast.
    """
    cell = lambda at, n: F.floor(at / (2 * n + 1)).cast("long")
    a = points.select("dataset", "t", "node_id", *AXES)
    for c, n in zip(AXES, window, strict=True):
        reach = n * (1 + 1e-9)
        a = a.withColumn(f"_c{c}", F.explode(F.sequence(cell(F.col(c) - reach, n), cell(F.col(c) + reach, n))))
    b = heat.select("dataset", "t", *[F.col(c).alias(f"_h{c}") for c in AXES], "v").withColumns({f"_c{c}": cell(F.col(f"_h{c}"), n) for c, n in zip(AXES, window, strict=True)})
    met = a.hint("merge").join(b, ["dataset", "t", *[f"_c{c}" for c in AXES]])
    for c, n in zip(AXES, window, strict=True):
        met = met.filter(F.abs(F.col(c) - F.col(f"_h{c}")) <= n)
    best = met.groupBy("dataset", "node_id").agg(F.max("v").alias("_v"))
    return points.join(best.hint("merge"), ["dataset", "node_id"], "left").withColumn("confirmed", F.coalesce(F.col("_v") >= floor, F.lit(True))).drop("_v")


def collisions(points: DataFrame, factor: tuple[int, int, int]) -> DataFrame:
    """dataset, t, cz, cy, cx, n: cells of a lattice of whole factors that hold two points and more."""
    cells = [F.floor(F.col(c) / k).cast("int").alias(f"c{c}") for c, k in zip(AXES, factor, strict=True)]
    return points.groupBy("dataset", "t", *cells).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def shrunk(nodes: DataFrame, truth: DataFrame, match: DataFrame, share: float) -> DataFrame:
    """``nodes`` whose voxels are moved by a share of the way to their truth, rounded half to even; unmatched ones stay."""
    t = truth.select("dataset", F.col("node_id").alias("gt_id"), *[F.col(c).alias(f"_g{c}") for c in AXES])
    m = match.select("dataset", F.col("pred_id").alias("node_id"), "gt_id")
    j = nodes.select("dataset", "node_id", "t", *AXES).join(m, ["dataset", "node_id"], "left").join(t, ["dataset", "gt_id"], "left")
    return j.select("dataset", "node_id", "t", *[F.coalesce(F.rint(F.col(c) + share * (F.col(f"_g{c}") - F.col(c))).cast("int"), F.col(c)).alias(c) for c in AXES])


def sheared(nodes: DataFrame, amplitude: float) -> DataFrame:
    """``nodes`` with ux moved in proportion to the depth within the dataset, ``amplitude`` at the bottom."""
    w = W.partitionBy("dataset")
    low, high = F.min("uz").over(w), F.max("uz").over(w)
    return nodes.withColumn("ux", F.col("ux") + F.when(high > low, amplitude * (F.col("uz") - low) / (high - low)).otherwise(F.lit(0.0)))


def mirrored(points: DataFrame, extent: tuple[int, int, int], flips: dict[str, Column]) -> DataFrame:
    """``points`` with the flipped axes' coordinates counted from the other side of the grid."""
    size = dict(zip(AXES, extent, strict=True))
    return points.withColumns({c: F.when(f, size[c] - 1 - F.col(c)).otherwise(F.col(c)).cast("int") for c, f in flips.items()})


def crops(points: DataFrame, size: tuple[int, int, int], extent: tuple[int, int, int], frames: int, last: Column, jitter: int) -> DataFrame:
    """dataset, node_id, t0, z0, y0, x0: a window of frames and a box around each point, moved by a jitter of its id and clamped inside."""
    move = lambda k: F.pmod(F.col("node_id") * k, F.lit(2 * jitter + 1)) - jitter
    start = F.greatest(F.lit(0), F.least(F.col("t") - frames // 2, last - (frames - 1)))
    inside = lambda c, n, e, k: F.greatest(F.lit(0), F.least(F.col(c) + move(k) - n // 2, F.lit(e - n))).cast("int").alias(f"{c}0")
    return points.select("dataset", "node_id", start.cast("int").alias("t0"), *[inside(c, n, e, k) for c, n, e, k in zip(AXES, size, extent, (7, 11, 13), strict=True)])


def boundary_census(nodes: DataFrame, edges: DataFrame, extent_um: tuple[float, float, float], margin: float) -> DataFrame:
    """Births and deaths of each dataset and what explains them: the first or last frame, or a face of the volume within the margin.

    ``interior_depth``: the median of how far past the margin other births lie, in margins.
    """
    first, last = F.min("t").over(W.partitionBy("dataset")), F.max("t").over(W.partitionBy("dataset"))
    face = F.least(*[F.least(F.col(f"u{c}"), F.lit(e) - F.col(f"u{c}")) for c, e in zip(AXES, extent_um, strict=True)])
    at = nodes.select("dataset", "node_id", "t", first.alias("_t0"), last.alias("_t1"), face.alias("_face"))
    parents = edges.select("dataset", F.col("target_id").alias("node_id")).distinct().withColumn("_in", F.lit(True))
    children = edges.select("dataset", F.col("source_id").alias("node_id")).distinct().withColumn("_out", F.lit(True))
    j = at.join(parents, ["dataset", "node_id"], "left").join(children, ["dataset", "node_id"], "left")
    birth, death, near = F.col("_in").isNull(), F.col("_out").isNull(), F.col("_face") <= margin
    opens, closes = F.col("t") == F.col("_t0"), F.col("t") == F.col("_t1")
    share = lambda what, of: F.avg(F.when(of, what.cast("int")))
    return j.groupBy("dataset").agg(
        F.count_if(birth).alias("births"),
        F.count_if(death).alias("deaths"),
        share(opens | near, birth).alias("birth_explained"),
        share(opens, birth).alias("birth_first_frame"),
        share(closes | near, death).alias("death_explained"),
        share(closes, death).alias("death_last_frame"),
        F.median(F.when(birth & ~(opens | near), (F.col("_face") - margin) / margin)).alias("interior_depth"),
    )


def line_fitted(nodes: DataFrame, edges: DataFrame, reach: int, weight: float) -> DataFrame:
    """``nodes`` drawn towards a straight line through up to ``reach`` nodes before and after, as long as there is one of them.

    The line is fitted by least squares over the steps; nodes with fewer than three places stay.
    """
    t = nodes.select("dataset", "node_id", "t")
    e = edges.select("dataset", "source_id", "target_id").join(t.withColumnsRenamed({"node_id": "source_id", "t": "_a"}), ["dataset", "source_id"]).join(t.withColumnsRenamed({"node_id": "target_id", "t": "_b"}), ["dataset", "target_id"]).filter("_b = _a + 1")
    only = lambda key, other: e.groupBy("dataset", F.col(key).alias("_at")).agg(F.min(other).alias("_next"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    places = nodes.select("dataset", "node_id", F.col("node_id").alias("_at"), F.lit(0).alias("_dt"))
    out = places
    for sign, step in ((-1, only("target_id", "source_id")), (1, only("source_id", "target_id"))):
        front = places
        for k in range(1, reach + 1):
            front = front.join(step, ["dataset", "_at"]).select("dataset", "node_id", F.col("_next").alias("_at"), F.lit(sign * k).alias("_dt"))
            out = out.unionByName(front)
    at = nodes.select("dataset", F.col("node_id").alias("_at"), *[F.col(c).alias(f"_{c}") for c in AXES])
    fit = out.join(at, ["dataset", "_at"]).groupBy("dataset", "node_id").agg(F.count(F.lit(1)).alias("_n"), *[F.regr_intercept(F.col(f"_{c}").cast("double"), F.col("_dt").cast("double")).alias(f"_f{c}") for c in AXES])
    drawn = lambda c: F.when((F.col("_n") >= 3) & F.col(f"_f{c}").isNotNull(), (1 - weight) * F.col(c) + weight * F.col(f"_f{c}")).otherwise(F.col(c).cast("double"))
    return nodes.join(fit, ["dataset", "node_id"]).select("dataset", "node_id", "t", *[drawn(c).alias(c) for c in AXES])


def simplified_counts(edges: DataFrame, truth_edges: DataFrame, match: DataFrame) -> DataFrame:
    """A scorer without repairs, by dataset: tp, fp (an end that truth has edges for), invisible, fn; and of the true edges
    recovered, fragmented, lost, and of the predicted ones wrong."""
    m = match.filter("gt_id is not null")
    key = lambda a, b: m.select("dataset", F.col("pred_id").alias(a), F.col("gt_id").alias(b))
    te = truth_edges.select("dataset", F.col("source_id").alias("_s"), F.col("target_id").alias("_t")).distinct()
    outs, ins = te.select("dataset", "_s").distinct().withColumn("_o", F.lit(True)), te.select("dataset", "_t").distinct().withColumn("_i", F.lit(True))
    p = edges.select("dataset", "source_id", "target_id").distinct().join(key("source_id", "_s"), ["dataset", "source_id"], "left").join(key("target_id", "_t"), ["dataset", "target_id"], "left")
    p = p.join(te.withColumn("_hit", F.lit(True)), ["dataset", "_s", "_t"], "left").join(outs, ["dataset", "_s"], "left").join(ins, ["dataset", "_t"], "left")
    hit, charged = F.col("_hit").isNotNull(), F.col("_i").isNotNull() | F.col("_o").isNotNull()
    wrong = F.col("_s").isNotNull() & F.col("_t").isNotNull() & ~hit
    pred = p.groupBy("dataset").agg(F.count_if(hit).alias("tp"), F.count_if(~hit & charged).alias("fp"), F.count_if(~hit & ~charged).alias("invisible"), F.count_if(wrong).alias("wrong"), F.count_distinct(F.when(hit, F.struct("_s", "_t"))).alias("_hits"))
    back = lambda a, b: m.groupBy("dataset", F.col("gt_id").alias(a)).agg(F.max("pred_id").alias(b))
    held = edges.select("dataset", F.col("source_id").alias("_ps"), F.col("target_id").alias("_pt")).distinct().withColumn("_e", F.lit(True))
    t = te.join(back("_s", "_ps"), ["dataset", "_s"], "left").join(back("_t", "_pt"), ["dataset", "_t"], "left").join(held, ["dataset", "_ps", "_pt"], "left")
    lost = F.col("_ps").isNull() | F.col("_pt").isNull()
    true = t.groupBy("dataset").agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("_e").isNotNull()).alias("recovered"), F.count_if(~lost & F.col("_e").isNull()).alias("fragmented"), F.count_if(lost).alias("lost"))
    return pred.join(true, "dataset").select("dataset", "tp", "fp", (F.col("_all") - F.col("_hits")).alias("fn"), "invisible", "recovered", "fragmented", "lost", "wrong")


def rescued(truth_edges: DataFrame, ours: DataFrame, rivals: dict[str, DataFrame]) -> DataFrame:
    """True edges (dataset, source_id, target_id) that our links lack and a rival has, with the number of rivals; links are in truth's ids."""
    key = ["dataset", "source_id", "target_id"]
    lost = truth_edges.select(*key).distinct().join(ours.select(*key), key, "left_anti")
    parts = [x.select(*key).distinct() for x in rivals.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return lost.join(out, key).groupBy(*key).agg(F.count(F.lit(1)).alias("n_rivals"))
