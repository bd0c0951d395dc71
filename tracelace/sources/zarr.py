"""Videos in chunked array stores (Zarr, version 3), read by Spark's own file source.

The chunks of a store are files; each becomes a row as Spark lists and reads it, so a store may lie wherever Spark reads,
and a filter on the frame prunes rows before their bytes are decoded.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelace.operators.voxels import FRAME


def metadata(spark: SparkSession, store: str) -> dict:
    """The store's zarr.json."""
    text = spark.read.text(f"{store}/zarr.json", wholetext=True).first()
    return json.loads(text[0])


def decoded(data: bytes, meta: dict) -> np.ndarray:
    """A chunk's array: bytes in either order, gzip or zstd around them."""
    kind = np.dtype(meta["data_type"])
    for codec in reversed(meta.get("codecs", [])):
        name, conf = codec["name"], codec.get("configuration", {})
        if name == "gzip":
            data = gzip.decompress(data)
        elif name == "zstd":
            import zstandard

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif name == "bytes":
            kind = kind.newbyteorder(">" if conf.get("endian") == "big" else "<")
        else:
            raise ValueError(f"codec {name} isn't read")
    return np.frombuffer(data, kind).reshape(meta["chunk_grid"]["configuration"]["chunk_shape"])


def frames(spark: SparkSession, store: str, dataset: str) -> DataFrame:
    """Frames of a (t, z, y, x) array with one chunk for each t; chunks that aren't there are frames of the fill value."""
    meta = metadata(spark, store)
    shape = meta["shape"]
    if meta["chunk_grid"]["configuration"]["chunk_shape"] != [1, *shape[1:]]:
        raise ValueError("a chunk must hold one frame")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "0").load(f"{store}/c")
    at = F.regexp_extract("path", r"/c/(\d+)/0/0/0$", 1)
    rows = files.select(at.alias("_t"), "content").filter("_t != ''").select(F.col("_t").cast("int").alias("t"), "content")
    every = spark.range(shape[0]).select(F.col("id").cast("int").alias("t")).join(rows, "t", "left")
    fill = float(meta.get("fill_value") or 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                a = np.full(shape[1:], fill, np.float32) if row.content is None else decoded(row.content, meta)[0]
                out.append((dataset, row.t, list(a.shape), a.astype(np.float32).ravel()))
            yield pd.DataFrame(out, columns=["dataset", "t", "shape", "voxels"])

    return every.mapInPandas(run, FRAME)


def video(spark: SparkSession, store: str, dataset: str) -> DataFrame:
    """One row: dataset, spacing, and intensity by quantile, from the attributes of the store."""
    attributes = metadata(spark, store).get("attributes", {})
    scale = attributes.get("scale", [1.0, 1.0, 1.0])
    quantiles = {float(k): float(v) for k, v in attributes.get("quantiles", {}).items()}
    return spark.createDataFrame([(dataset, *map(float, scale[-3:]), quantiles)], "dataset string, sz double, sy double, sx double, quantiles map<double,double>")


def tracks(spark: SparkSession, store: str, dataset: str) -> tuple[DataFrame, DataFrame, int | None]:
    """Nodes, edges and the estimated number of nodes of a graph store: arrays nodes/ids, nodes/props/{t,z,y,x}/values and
    edges/ids, each in one chunk. A graph's arrays are small; Spark reads the files."""

    def array(name: str) -> np.ndarray:
        meta = metadata(spark, f"{store}/{name}")
        tail = "/".join("0" for _ in meta["shape"])
        data = spark.read.format("binaryFile").load(f"{store}/{name}/c/{tail}").select("content").first()
        return decoded(bytes(data[0]), meta)

    ids = array("nodes/ids")
    cols = [array(f"nodes/props/{a}/values") for a in ("t", "z", "y", "x")]
    n = spark.createDataFrame(pd.DataFrame({"dataset": dataset, "node_id": ids.astype("int64"), **{a: c.astype("int32") for a, c in zip(("t", "z", "y", "x"), cols, strict=True)}}))
    links = array("edges/ids").astype("int64").reshape(-1, 2)
    e = spark.createDataFrame(pd.DataFrame({"dataset": dataset, "source_id": links[:, 0], "target_id": links[:, 1], "edge_seq": np.arange(len(links), dtype="int64")}))
    extra = metadata(spark, store).get("attributes", {}).get("geff", {}).get("extra", {})
    return n, e, extra.get("estimated_number_of_nodes")
