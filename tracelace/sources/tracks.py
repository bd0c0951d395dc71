"""Track tables from the events table: a user's events in time order are a track, and its n-th event lies in frame n.

Every event is a point. Forty users share a dataset and its volume, so that a frame is as dense whatever the table's size
and the number of datasets grows with it.

The coordinates are whole-number mixes, so that every engine makes the same ones, and distances in micrometres come out
the same to the last bit.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.functions.geometry import Spacing, to_um
from tracelace.operators import joins, repair
from tracelace.storage import written

#: Users of a dataset, the extents y and x of its volume, the gate for links and the ruler for matches.
USERS, EXTENT, GATE, RULER = 40, 96, 10.0, 7.0
#: Every fifteenth user, but a dataset's first four, starts in this frame, as a daughter of the user four below.
LATE = 5


@dataclass
class Tracks:
    """Truth, detections, links, affinities and matches over the tables in one folder."""

    spark: SparkSession
    sf_dir: str
    spacing: Spacing = field(default_factory=Spacing)
    extent: int = EXTENT

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @staticmethod
    def late(user):
        return (user % 15 == 0) & (user % USERS >= 4)

    @cached_property
    def points(self) -> DataFrame:
        """dataset, node_id, user_id, t and the voxel of every event; written once, as most operators read it more than once."""
        w = W.partitionBy("user_id").orderBy("ts", "event_id")
        first = F.when(self.late(F.col("user_id")), F.lit(LATE)).otherwise(F.lit(0))
        e = self.table("events").select("event_id", "user_id", F.floor("value").cast("long").alias("v"), (F.row_number().over(w) - 1 + first).alias("t"))
        u, t = F.col("user_id"), F.col("t")
        return written(
            e.select(
                F.concat(F.lit("d"), F.floor(u / USERS).cast("long").cast("string")).alias("dataset"),
                F.col("event_id").alias("node_id"),
                "user_id",
                t.cast("int").alias("t"),
                ((u * 7) % 16).cast("int").alias("z"),
                ((u * 37 + 3 * t) % self.extent + F.col("v") % 5).cast("int").alias("y"),
                ((u * 53) % self.extent + F.col("v") % 7).cast("int").alias("x"),
            ),
            "points",
        )

    @cached_property
    def frames(self) -> int:
        """The number of frames: one more than the last frame's number."""
        return (self.points.agg(F.max("t")).first()[0] or 0) + 1

    @cached_property
    def truth(self) -> DataFrame:
        return to_um(self.points.drop("user_id"), self.spacing)

    @cached_property
    def truth_edges(self) -> DataFrame:
        """Each point to the user's next; and to a late user's first from the point before it of the user four below."""
        p = self.points.select("dataset", "user_id", "t", "node_id")
        nxt = F.lead("node_id").over(W.partitionBy("dataset", "user_id").orderBy("t"))
        along = p.select("dataset", F.col("node_id").alias("source_id"), nxt.alias("target_id")).filter("target_id is not null")
        born = p.filter(self.late(F.col("user_id")) & (F.col("t") == LATE))
        parent = p.select("dataset", (F.col("user_id") + 4).alias("user_id"), (F.col("t") + 1).alias("t"), F.col("node_id").alias("source_id"))
        forks = born.join(parent, ["dataset", "user_id", "t"]).select("dataset", "source_id", F.col("node_id").alias("target_id"))
        return along.union(forks).withColumn("edge_seq", F.col("target_id"))

    @cached_property
    def nodes(self) -> DataFrame:
        """Detections: the truth without every seventeenth point, moved along y, under ids of their own."""
        p = self.points.filter(F.col("node_id") % 17 != 0).drop("user_id")
        moved = p.withColumn("y", (F.col("y") + F.col("node_id") % 5 - 2).cast("int")).withColumn("node_id", F.col("node_id") + 10_000_000)
        return to_um(moved, self.spacing)

    @cached_property
    def candidates(self) -> DataFrame:
        """dataset, t, source_id, target_id, d: all pairs of consecutive frames within the gate."""
        return written(joins.candidates(self.nodes, GATE), "candidates")

    @cached_property
    def links(self) -> DataFrame:
        """The nearest parent of each detection: edges with edge_seq and d."""
        return repair.nearest_parent(self.candidates)

    @cached_property
    def affinity(self) -> DataFrame:
        """Candidates with p, the share of 1 / (1 + d) among a target's sources, from whole millionths."""
        w = F.rint(1e6 / (1 + F.col("d"))).cast("long")
        return self.candidates.withColumn("w", w).withColumn("p", F.col("w") / F.sum("w").over(W.partitionBy("dataset", "t", "target_id"))).drop("w")

    @cached_property
    def match(self) -> DataFrame:
        """pred_id with the truth point that it was made from."""
        return self.nodes.select("dataset", F.col("node_id").alias("pred_id"), (F.col("node_id") - 10_000_000).alias("gt_id"))

    @cached_property
    def video(self) -> DataFrame:
        return self.truth.groupBy("dataset").agg((F.count(F.lit(1)) + 10).alias("estimated_nodes"))


_UM = "z * 1.625::DOUBLE AS uz, y * 0.40625::DOUBLE AS uy, x * 0.40625::DOUBLE AS ux"
_D = "sqrt((a.uz - b.uz) * (a.uz - b.uz) + (a.uy - b.uy) * (a.uy - b.uy) + (a.ux - b.ux) * (a.ux - b.ux))"

#: The same tables as DuckDB's common table expressions.
SQL = f"""WITH RECURSIVE ev AS (SELECT event_id, user_id, floor(value)::BIGINT AS v,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 + CASE WHEN user_id % 15 = 0 AND user_id % {USERS} >= 4 THEN {LATE} ELSE 0 END AS t FROM events),
pt AS (SELECT 'd' || (user_id // {USERS})::VARCHAR AS dataset, event_id AS node_id, user_id, t::INTEGER AS t, ((user_id * 7) % 16)::INTEGER AS z,
  ((user_id * 37 + 3 * t) % {EXTENT} + v % 5)::INTEGER AS y, ((user_id * 53) % {EXTENT} + v % 7)::INTEGER AS x FROM ev),
tn AS (SELECT dataset, node_id, t, z, y, x, {_UM} FROM pt),
te AS (SELECT dataset, source_id, target_id, target_id AS edge_seq FROM (
  SELECT dataset, node_id AS source_id, lead(node_id) OVER (PARTITION BY dataset, user_id ORDER BY t) AS target_id FROM pt
  UNION ALL SELECT b.dataset, a.node_id, b.node_id FROM pt b JOIN pt a ON a.dataset = b.dataset AND a.user_id + 4 = b.user_id AND a.t = {LATE - 1}
  WHERE b.user_id % 15 = 0 AND b.user_id % {USERS} >= 4 AND b.t = {LATE}) WHERE target_id IS NOT NULL),
pn AS (SELECT *, {_UM} FROM (SELECT dataset, node_id + 10000000 AS node_id, t, z, (y + node_id % 5 - 2)::INTEGER AS y, x FROM pt WHERE node_id % 17 <> 0)),
ca AS (SELECT * FROM (SELECT a.dataset, a.t, a.node_id AS source_id, b.node_id AS target_id, {_D} AS d FROM pn a JOIN pn b ON a.dataset = b.dataset AND b.t = a.t + 1) WHERE d <= {GATE}),
pe AS (SELECT dataset, source_id, target_id, target_id AS edge_seq, d FROM (SELECT *, row_number() OVER (PARTITION BY dataset, target_id ORDER BY d, source_id) AS r FROM ca) WHERE r = 1),
af AS (SELECT dataset, t, source_id, target_id, d, w::DOUBLE / sum(w) OVER (PARTITION BY dataset, t, target_id) AS p FROM (SELECT *, round_even(1e6::DOUBLE / (1 + d), 0)::BIGINT AS w FROM ca)),
mt AS (SELECT dataset, node_id AS pred_id, node_id - 10000000 AS gt_id FROM pn),
vi AS (SELECT dataset, count(*) + 10 AS estimated_nodes FROM tn GROUP BY dataset)"""
