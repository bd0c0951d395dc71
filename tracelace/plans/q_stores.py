"""Round trips of track graphs and candidate dumps through chunked stores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelace.plans.registry import query
from tracelace.sources import stores
from tracelace.sources.tracks import Tracks
from tracelace.storage import shared_dir


def _folder(k: Tracks, name: str) -> str:
    return f"{shared_dir(k.spark)}/tracelace/{name}-{uuid.uuid4().hex}"


@query(", o AS (SELECT dataset, source_id AS node_id, count(*) AS n_out, sum(edge_seq)::BIGINT AS seq FROM (SELECT dataset, source_id, row_number() OVER (PARTITION BY dataset ORDER BY edge_seq, source_id, target_id) - 1 AS edge_seq FROM te) GROUP BY ALL) SELECT dataset, node_id, t, z, y, x, coalesce(n_out, 0)::BIGINT AS n_out, coalesce(seq, 0)::BIGINT AS seq, estimated_nodes FROM tn LEFT JOIN o USING (dataset, node_id) JOIN vi USING (dataset) WHERE t >= 2 AND t < 12")
def s5_graph_stores(k: Tracks) -> DataFrame:
    """Truth written as a store a dataset, in chunks of 256 rows; a range of its frames read back with edges and attributes."""
    root = _folder(k, "graphs")
    stores.write_graphs(k.truth, k.truth_edges, k.video, root, rows=256)
    out = stores.graph_edges(k.spark, root).groupBy("dataset", F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_out"), F.sum("edge_seq").alias("seq"))
    n = stores.graph_nodes(k.spark, root, 2, 12).join(out, ["dataset", "node_id"], "left").fillna(0, ["n_out", "seq"])
    return n.join(stores.estimates(k.spark, root), "dataset")


@query(", h AS (SELECT DISTINCT a.dataset, a.node_id FROM tn a JOIN pn b ON a.dataset = b.dataset AND a.t = b.t WHERE sqrt((a.uz - b.uz) * (a.uz - b.uz) + (a.uy - b.uy) * (a.uy - b.uy) + (a.ux - b.ux) * (a.ux - b.ux)) <= 1.0), c AS (SELECT dataset, count(*) AS covered FROM h GROUP BY ALL) SELECT dataset, count(*) AS gt_cells, coalesce(any_value(covered), 0)::BIGINT AS covered FROM tn LEFT JOIN c USING (dataset) GROUP BY dataset")
def s11_candidate_coverage(k: Tracks) -> DataFrame:
    """Detections written as dumps in voxels and read back in micrometres: how many truth points have one within a micrometre."""
    root = _folder(k, "dumps")
    stores.write_dumps(k.nodes, (k.spacing.z, k.spacing.y, k.spacing.x), root)
    return stores.coverage(k.truth, stores.dumped(k.spark, root), 1.0)
