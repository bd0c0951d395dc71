"""Column types of the tables that operators exchange. Ids are arbitrary; coordinates are voxels in t, z, y, x order."""

from pyspark.sql import types as T


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


NODES = _schema(dataset=T.StringType(), node_id=T.LongType(), t=T.IntegerType(), z=T.IntegerType(), y=T.IntegerType(), x=T.IntegerType())
EDGES = _schema(dataset=T.StringType(), source_id=T.LongType(), target_id=T.LongType(), edge_seq=T.LongType())
VIDEO = _schema(dataset=T.StringType(), estimated_nodes=T.LongType(), sz=T.DoubleType(), sy=T.DoubleType(), sx=T.DoubleType())
AFFINITY = _schema(dataset=T.StringType(), t=T.IntegerType(), source_id=T.LongType(), target_id=T.LongType(), p=T.DoubleType())
MATCH = _schema(dataset=T.StringType(), pred_id=T.LongType(), gt_id=T.LongType())
SUBMISSION = _schema(id=T.LongType(), dataset=T.StringType(), row_type=T.StringType(), node_id=T.LongType(), t=T.LongType(), z=T.LongType(), y=T.LongType(), x=T.LongType(), source_id=T.LongType(), target_id=T.LongType())
