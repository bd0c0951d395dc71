"""Weakly connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelace.storage import scratch, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("_u", "_v"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node, root) for every node that has an edge to another; root is the least node of its component.

    ``keys`` (dataset, say) keep apart what only looks alike. Each round points every node and its larger neighbours to
    its least neighbour; rounds grow with the logarithm of the longest path and are written to the shared folder,
    each removed when the next is there. A
    node's least neighbour is a partial aggregate and comes back by a join that Spark can split where a node is hot. Null
    ends have no edge. The driver sees a count and a checksum a round.
    """
    u, v = F.col(a), F.col(b)
    with scratch(edges.sparkSession) as keep:
        state = keep(edges.filter(u.isNotNull() & v.isNotNull() & (u != v)).select(*keys, F.greatest(u, v).alias("_u"), F.least(u, v).alias("_v")).distinct(), "0")
        seen, number = _state(state), 0
        while seen[0]:
            number += 1
            state = keep(_starred(state, keys), str(number))
            keep.drop(str(number - 1))
            now = _state(state)
            if now == seen:
                break
            seen = now
        members = state.select(*keys, F.col("_u").alias("node"), F.col("_v").alias("root"))
        return written(members.union(state.select(*keys, F.col("_v").alias("node"), F.col("_v").alias("root"))).distinct(), "components")


def _starred(state: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One large star, then one small star."""
    both = state.select(*keys, F.col("_u").alias("_x"), F.col("_v").alias("_y")).union(state.select(*keys, F.col("_v").alias("_x"), F.col("_u").alias("_y")))
    least = both.groupBy(*keys, "_x").agg(F.min("_y").alias("_m"))
    large = both.filter("_y > _x").join(least, [*keys, "_x"]).select(*keys, F.col("_y").alias("_u"), F.least("_m", "_x").alias("_v")).distinct()
    down = state.select(*keys, "_u", "_v").join(least.select(*keys, F.col("_x").alias("_u"), "_m"), [*keys, "_u"]).filter("_m < _u")
    large = large.union(down.select(*keys, "_u", F.col("_m").alias("_v"))).distinct()
    lowest = large.groupBy(*keys, "_u").agg(F.min("_v").alias("_m"))
    near = large.join(lowest, [*keys, "_u"])
    return near.filter("_v != _m").select(*keys, F.col("_v").alias("_u"), F.col("_m").alias("_v")).union(lowest.select(*keys, "_u", F.col("_m").alias("_v"))).distinct()


def forest_roots(edges: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame | None:
    """(keys, node, root) for edges from ``a`` down to ``b`` where every node has one parent at most: the topmost node above each.

    Each round lets a node point at what its pointer points at, so rounds grow with the logarithm of the deepest tree; None
    if a node has two parents or a round changes nothing more than a cycle would.
    """
    with scratch(edges.sparkSession) as keep:
        e = keep(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(*keys, F.col(b).alias("node"), F.col(a).alias("root")).distinct(), "edges")
        if not e.groupBy(*keys, "node").count().filter("count > 1").isEmpty():
            return None
        tops = e.select(*keys, F.col("root").alias("node")).distinct().join(e.select(*keys, "node"), [*keys, "node"], "left_anti").withColumn("root", F.col("node"))
        state = keep(e.unionByName(tops), "0")
        for number in range(1, 64):
            up = state.select(*keys, F.col("node").alias("root"), F.col("root").alias("_above"))
            state = keep(state.join(up, [*keys, "root"]).select(*keys, "node", F.col("_above").alias("root"), (F.col("_above") != F.col("root")).alias("_moved")), str(number))
            keep.drop(str(number - 1))
            moved = not state.filter("_moved").isEmpty()
            state = state.drop("_moved")
            if not moved:
                return written(state, "forest-roots")
        return None
