"""Spatial joins between frames, planned as equi-joins on grid cells with the distance as a residual condition.

A gated join cuts space into cubes whose side is four times the gate and emits a point of one side to the cubes that its
gate reaches, 8 at most and 3.4 on the average, so each pair within the gate meets once, in the other point's cube. No pair
of cubes further apart is compared. Cubes of twice the gate would nearly always take 8 copies of a point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.functions.geometry import AXES, distance
from tracelace.storage import written

#: The side of a gated join's cubes, in gates.
SIDE = 4.0


def _prefixed(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in columns])


def emitted(points: DataFrame, prefix: str, gate: float) -> DataFrame:
    """A row for each cube (_bz, _by, _bx) that a point's gate reaches."""
    side, reach = F.lit(SIDE * gate), F.lit(gate * (1 + 1e-9))
    for c in AXES:
        low, high = ((F.col(f"{prefix}u{c}") + x) / side for x in (-reach, reach))
        points = points.withColumn(f"_b{c}", F.explode(F.sequence(F.floor(low).cast("long"), F.floor(high).cast("long"))))
    return points


def gated(left: DataFrame, right: DataFrame, gate: float, dt: int = 0, keys: tuple[str, ...] = ("dataset",), how: str = "inner") -> DataFrame:
    """Pairs (a_..., b_..., d) of points with equal keys, t(b) = t(a) + dt and a distance of at most ``gate``, inclusive.

    ``how``: 'inner', or 'left' to keep points of ``left`` that have no pair. The right side is the one that is emitted.
    """
    a = _prefixed(left, "a_", left.columns).withColumn("_t", F.col("a_t") + dt)
    # emitted rows are many more than Spark reckons from the table's size, so they are never broadcast
    b = emitted(_prefixed(right, "b_", right.columns), "b_", gate).hint("merge")
    on = (F.col("_t") == F.col("b_t")) & (distance("a_", "b_") <= F.lit(float(gate)))
    for k in keys:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    for c in AXES:
        a = a.withColumn(f"_a{c}", F.floor(F.col(f"a_u{c}") / F.lit(SIDE * gate)).cast("long"))
        on = on & (F.col(f"_a{c}") == F.col(f"_b{c}"))
    kept = [f"a_{c}" for c in left.columns] + [f"b_{c}" for c in right.columns]
    return a.join(b, on, how).select(*kept, F.when(F.col("b_t").isNotNull(), distance("a_", "b_")).alias("d"))


def candidates(nodes: DataFrame, gate: float) -> DataFrame:
    """dataset, t, source_id, target_id, d of all pairs of consecutive frames within the gate."""
    slim = nodes.select("dataset", "node_id", "t", "uz", "uy", "ux")
    return gated(slim, slim, gate, 1).select(F.col("a_dataset").alias("dataset"), F.col("a_t").alias("t"), F.col("a_node_id").alias("source_id"), F.col("b_node_id").alias("target_id"), "d")


def neighbours(nodes: DataFrame, radius: float) -> DataFrame:
    """Pairs of different points of one frame within the radius, both ways: dataset, t, node_id, other_id, d."""
    slim = nodes.select("dataset", "node_id", "t", "uz", "uy", "ux")
    return gated(slim, slim, radius).filter("a_node_id != b_node_id").select(F.col("a_dataset").alias("dataset"), F.col("a_t").alias("t"), F.col("a_node_id").alias("node_id"), F.col("b_node_id").alias("other_id"), "d")


def crowding(nodes: DataFrame, radius: float) -> DataFrame:
    """dataset, node_id and how many other points of its frame lie within the radius."""
    n = neighbours(nodes, radius).groupBy("dataset", "node_id").agg(F.count(F.lit(1)).alias("n_near"))
    return nodes.select("dataset", "node_id").join(n, ["dataset", "node_id"], "left").select("dataset", "node_id", F.coalesce("n_near", F.lit(0)).alias("n_near"))


def _least(pairs: DataFrame) -> DataFrame:
    best = pairs.groupBy(F.col("a_dataset").alias("dataset"), F.col("a_node_id").alias("node_id")).agg(F.min(F.struct("d", F.col("b_node_id").alias("id"))).alias("m"))
    return best.select("dataset", "node_id", F.col("m.id").alias("nearest_id"), F.col("m.d").alias("d"))


def nearest(left: DataFrame, right: DataFrame, dt: int = 0, within: float | None = None, others: bool = False, start: float = 8.0) -> DataFrame:
    """For each point of ``left`` the nearest of ``right`` in frame t + dt: dataset, node_id, nearest_id, d; null without one.

    Equal distances go to the smaller id. ``others``: a point isn't its own neighbour. Without ``within`` the gate widens:
    what is found within it is the nearest, and only points that found none are looked for in twice the gate, until it
    spans the volume. So no frame is compared with all of another unless its points lie that far apart.
    """
    slim = ["dataset", "node_id", "t", "uz", "uy", "ux"]
    a, b = left.select(*slim), right.select(*slim)

    def met(points: DataFrame, gate: float) -> DataFrame:
        pairs = gated(points, b, gate, dt)
        return _least(pairs.filter("a_node_id != b_node_id") if others else pairs)

    if within is not None:
        best = met(a, within)
    else:
        ends = a.unionByName(b).agg(*[f(c) for c in slim[3:] for f in (F.min, F.max)]).first()
        span = sum((ends[2 * i + 1] - ends[2 * i]) ** 2 for i in range(3)) ** 0.5 if ends[0] is not None else 0.0
        gate = start
        best = written(met(a, gate), "nearest")
        while gate < span:
            gate *= 2
            open_points = written(a.join(best.select("dataset", "node_id"), ["dataset", "node_id"], "left_anti"), "nearest-open")
            if open_points.isEmpty():
                break
            best = best.unionByName(written(met(open_points, gate), "nearest"))
    return left.select("dataset", "node_id").join(best, ["dataset", "node_id"], "left")


def k_nearest(points: DataFrame, k: int, start: float = 8.0) -> DataFrame:
    """dataset, node_id, rank, other_id, d: the ``k`` nearest other points of each point's frame, all if there are fewer.

    Equal distances go to the smaller id. Points that have ``k`` others within the gate are done; the rest are looked for in
    twice the gate, until it spans the volume.
    """
    slim = points.select("dataset", "node_id", "t", "uz", "uy", "ux")
    ends = slim.agg(*[f(c) for c in ("uz", "uy", "ux") for f in (F.min, F.max)]).first()
    span = sum((ends[2 * i + 1] - ends[2 * i]) ** 2 for i in range(3)) ** 0.5 if ends[0] is not None else 0.0
    open_points, gate, parts = slim, start, []
    key = ["dataset", "node_id"]
    while True:
        # the points still open are the fewer, so they are emitted
        pairs = gated(slim, open_points, gate).filter("a_node_id != b_node_id")
        pairs = pairs.select(F.col("b_dataset").alias("dataset"), F.col("b_node_id").alias("node_id"), F.col("a_node_id").alias("other_id"), "d")
        ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy("d", "other_id"))).filter(F.col("rank") <= k)
        found = written(ranked.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*key))), "k-nearest")
        if gate > span:
            parts.append(found)
            break
        parts.append(found.filter(F.col("_n") == k))
        open_points = written(open_points.join(parts[-1].select(*key).distinct(), key, "left_anti"), "k-nearest-open")
        if open_points.isEmpty():
            break
        gate *= 2
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*key, "rank", "other_id", "d")


def shifted_null(left: DataFrame, right: DataFrame, shift: int, frames: int, within: float) -> DataFrame:
    """``nearest`` against frame (t + shift) mod frames: what chance alone would find."""
    moved = left.withColumn("t", F.pmod(F.col("t") + shift, F.lit(frames)))
    return nearest(moved, right, within=within)


def successors(edges: DataFrame) -> DataFrame:
    """dataset, node_id, first successor by edge_seq and the number of successors."""
    return edges.groupBy("dataset", F.col("source_id").alias("node_id")).agg(F.min_by("target_id", F.struct("edge_seq", "target_id")).alias("successor_id"), F.count(F.lit(1)).alias("n_out"))


def hops(edges: DataFrame, k: int) -> DataFrame:
    """dataset, source_id, target_id: nodes that ``k`` edges lead to."""
    out = edges.select("dataset", "source_id", "target_id")
    for _ in range(k - 1):
        step = edges.select("dataset", F.col("source_id").alias("target_id"), F.col("target_id").alias("_next"))
        out = out.join(step, ["dataset", "target_id"]).select("dataset", "source_id", F.col("_next").alias("target_id"))
    return out


def translated(edges: DataFrame, match: DataFrame) -> DataFrame:
    """Edges with gt_source and gt_target, null where an end isn't matched."""
    s = match.select("dataset", F.col("pred_id").alias("source_id"), F.col("gt_id").alias("gt_source"))
    t = match.select("dataset", F.col("pred_id").alias("target_id"), F.col("gt_id").alias("gt_target"))
    return edges.join(s, ["dataset", "source_id"], "left").join(t, ["dataset", "target_id"], "left")


def in_set(edges: DataFrame, members: DataFrame, source: str, target: str, flag: str) -> DataFrame:
    """``edges`` with a flag: (source, target) is an edge of ``members``."""
    m = members.select("dataset", F.col("source_id").alias(source), F.col("target_id").alias(target)).distinct().withColumn(flag, F.lit(True))
    return edges.join(m, ["dataset", source, target], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def ends_and_starts(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without a successor, and nodes without a predecessor."""
    ends = nodes.join(edges.select("dataset", F.col("source_id").alias("node_id")), ["dataset", "node_id"], "left_anti")
    starts = nodes.join(edges.select("dataset", F.col("target_id").alias("node_id")), ["dataset", "node_id"], "left_anti")
    return ends, starts


def gaps(nodes: DataFrame, edges: DataFrame, spans: tuple[int, ...], reach: float) -> DataFrame:
    """Track ends and the track starts ``span`` frames later within ``reach`` micrometres a frame: dataset, span, end_id, start_id, d."""
    ends, starts = ends_and_starts(nodes, edges)
    out = None
    for k in spans:
        part = gated(ends, starts, reach * k, k).select(F.col("a_dataset").alias("dataset"), F.lit(k).alias("span"), F.col("a_node_id").alias("end_id"), F.col("b_node_id").alias("start_id"), "d")
        out = part if out is None else out.unionByName(part)
    return out


def windows_matching(needle: list[float], chains: DataFrame, tolerance: float) -> DataFrame:
    """Places (dataset, chain_id, pos) where a run of step lengths agrees with the needle within the tolerance."""
    n = len(needle)
    w = W.partitionBy("dataset", "chain_id").orderBy("pos").rowsBetween(0, n - 1)
    run = chains.withColumn("_run", F.collect_list("step").over(w)).filter(F.size("_run") == n)
    fits = F.forall(F.zip_with("_run", F.array(*[F.lit(x) for x in needle]), lambda a, b: F.abs(a - b) <= tolerance), lambda x: x)
    return run.filter(fits).select("dataset", "chain_id", "pos")
