"""The submission table: node rows and edge rows of all datasets in one, -1 where a column doesn't apply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelace.schema import SUBMISSION

_FILLED = ("node_id", "t", "z", "y", "x", "source_id", "target_id")


def combined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows numbered from 0 by dataset, nodes before edges, in order of id.

    The numbers come from the rows before a dataset's part (one small row each) and a window inside the part, so no task
    orders the whole table.
    """
    from pyspark.sql import Window as W

    n = nodes.select("dataset", F.lit("node").alias("row_type"), "node_id", *[F.greatest(F.rint(c), F.lit(0.0)).cast("long").alias(c) if c != "t" else F.col(c).cast("long").alias(c) for c in ("t", "z", "y", "x")], *[F.lit(None).cast("long").alias(c) for c in ("source_id", "target_id")])
    e = edges.select("dataset", F.lit("edge").alias("row_type"), *[F.lit(None).cast("long").alias(c) for c in ("node_id", "t", "z", "y", "x")], "source_id", "target_id")
    both = n.unionByName(e).withColumn("_k", (F.col("row_type") == "edge").cast("int"))
    sizes = both.groupBy("dataset", "_k").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("dataset", "_k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = both.join(sizes.select("dataset", "_k", before.alias("_before")), ["dataset", "_k"])
    ident = F.col("_before") + F.row_number().over(W.partitionBy("dataset", "_k").orderBy("node_id", "source_id", "target_id")) - 1
    return numbered.select(ident.cast("long").alias("id"), "dataset", "row_type", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in _FILLED])


def write_csv(table: DataFrame, path: str) -> None:
    table.repartitionByRange("id").sortWithinPartitions("id").write.csv(path, header=True, mode="overwrite")


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a submission; edge_seq is the row's id."""
    rows = spark.read.schema(SUBMISSION).csv(path, header=True)
    nodes = rows.filter("row_type = 'node'").select("dataset", "node_id", *[F.col(c).cast("int").alias(c) for c in ("t", "z", "y", "x")])
    edges = rows.filter("row_type = 'edge'").select("dataset", "source_id", "target_id", F.col("id").alias("edge_seq"))
    return nodes, edges
