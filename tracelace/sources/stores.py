"""Folders of stores: track graphs and candidate dumps, a dataset each, that executors write and read chunk by chunk.

A graph store ``<dataset>.geff`` holds the arrays ``nodes/ids``, ``nodes/props/{t,z,y,x}/values`` and ``edges/ids`` in
chunks of rows, and the estimated number of nodes in its attributes. All stores of a folder are read by one scan; a chunk is
a row, the chunks of a dataset's five node arrays meet by their number, and only a chunk with a frame that is asked for has
its other arrays decoded. No array passes through the driver.

An empty graph has arrays without chunks and gives no rows. A chunk that isn't there holds the fill value. Arrays of a graph
must agree in their lengths and chunks, else the reading task raises an error. Datasets may have any name: names are
percent-encoded in paths.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.sources.zarr import decoded

AXES = ("t", "z", "y", "x")
_NODE_ARRAYS = ("ids", *[f"props/{a}/values" for a in AXES])
NODES = "dataset string, node_id long, t int, z int, y int, x int"
EDGES = "dataset string, source_id long, target_id long, edge_seq long"


def save(path: str, data: bytes) -> None:
    """Writes a file under a name of its own and moves it to its place, so that a task that runs twice leaves one whole file."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, at)


def _array(shape: list[int], chunk: list[int], kind: str) -> bytes:
    meta = {"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": kind, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}},
            "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "attributes": {},
            "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 0}}]}
    return json.dumps(meta).encode()


def _packed(values: np.ndarray, rows: int, kind: str) -> bytes:
    """A chunk's bytes; the last chunk is filled up to the length of all."""
    import zstandard

    full = np.zeros((rows, *values.shape[1:]), kind)
    full[: len(values)] = values
    return zstandard.ZstdCompressor().compress(full.tobytes())


def _each(rows: DataFrame, keys: tuple[str, ...], write: Callable[[pd.DataFrame], int]) -> None:
    """Runs ``write`` on each group and waits for all; what comes back is one number a partition."""
    rows.groupBy(*keys).applyInPandas(lambda pdf: pd.DataFrame({"n": [write(pdf)]}), "n long").agg(F.sum("n")).collect()


def write_graphs(nodes: DataFrame, edges: DataFrame, estimated: DataFrame, root: str, rows: int = 65536) -> None:
    """A store a dataset of ``estimated`` (dataset, estimated_nodes): nodes by id, edges by edge_seq, in chunks of ``rows``.

    A group that a task works on is a chunk. Nodes or edges of datasets that ``estimated`` lacks aren't written.
    """
    known = estimated.select("dataset")
    place = lambda df, *order: df.join(known, "dataset", "left_semi").withColumn("_c", F.floor((F.row_number().over(W.partitionBy("dataset").orderBy(*order)) - 1) / rows))

    def save_nodes(pdf: pd.DataFrame) -> int:
        at, c = f"{root}/{quote(pdf['dataset'].iloc[0], safe='')}.geff/nodes", int(pdf["_c"].iloc[0])
        pdf = pdf.sort_values("node_id")
        save(f"{at}/ids/c/{c}", _packed(pdf["node_id"].to_numpy(), rows, "<i8"))
        for a in AXES:
            save(f"{at}/props/{a}/values/c/{c}", _packed(pdf[a].to_numpy(), rows, "<i4"))
        return len(pdf)

    def save_edges(pdf: pd.DataFrame) -> int:
        at, c = f"{root}/{quote(pdf['dataset'].iloc[0], safe='')}.geff/edges/ids/c", int(pdf["_c"].iloc[0])
        pdf = pdf.sort_values(["edge_seq", "source_id", "target_id"])
        save(f"{at}/{c}/0", _packed(pdf[["source_id", "target_id"]].to_numpy(), rows, "<i8"))
        return len(pdf)

    def save_meta(pdf: pd.DataFrame) -> int:
        for r in pdf.itertuples(index=False):
            at = f"{root}/{quote(r.dataset, safe='')}.geff"
            extra = {} if pd.isna(r.estimated_nodes) else {"estimated_number_of_nodes": int(r.estimated_nodes)}
            save(f"{at}/zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"geff": {"extra": extra}}}).encode())
            for a in _NODE_ARRAYS:
                save(f"{at}/nodes/{a}/zarr.json", _array([int(r.n_nodes)], [rows], "int64" if a == "ids" else "int32"))
            save(f"{at}/edges/ids/zarr.json", _array([int(r.n_edges), 2], [rows, 2], "int64"))
        return len(pdf)

    _each(place(nodes.select("dataset", "node_id", *AXES), "node_id"), ("dataset", "_c"), save_nodes)
    _each(place(edges.select("dataset", "source_id", "target_id", "edge_seq"), "edge_seq", "source_id", "target_id"), ("dataset", "_c"), save_edges)
    count = lambda df, name: df.groupBy("dataset").agg(F.count(F.lit(1)).alias(name))
    sizes = estimated.select("dataset", "estimated_nodes").join(count(nodes, "n_nodes"), "dataset", "left").join(count(edges, "n_edges"), "dataset", "left").fillna(0, ["n_nodes", "n_edges"])
    _each(sizes, ("dataset",), save_meta)


def _files(spark: SparkSession, path: str, names: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path)


def _name(suffix: str):
    return F.url_decode(F.regexp_extract("path", rf"/([^/]*)\.{suffix}(?:/|$)", 1))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """dataset, video, graph: the paths of a folder's ``.zarr`` videos, and of the ``.geff`` graph beside each where there is one.

    Only paths are listed; no file is read. A folder without videos raises Spark's error of a path that isn't there.
    """
    at = lambda suffix: F.regexp_extract("path", rf"^(.*/[^/]*\.{suffix})/zarr\.json$", 1)
    some = lambda suffix: spark.read.format("binaryFile").load(f"{root}/*.{suffix}/zarr.json").select(_name(suffix).alias("dataset"), at(suffix).alias(suffix))
    return some("zarr").join(some("geff"), "dataset", "left").select("dataset", F.col("zarr").alias("video"), F.col("geff").alias("graph"))


def estimates(spark: SparkSession, root: str) -> DataFrame:
    """dataset, estimated_nodes of every graph store; null where a store doesn't tell."""
    text = F.col("content").cast("string")
    files = spark.read.format("binaryFile").load(f"{root}/*.geff/zarr.json")
    return files.select(_name("geff").alias("dataset"), F.get_json_object(text, "$.attributes.geff.extra.estimated_number_of_nodes").cast("long").alias("estimated_nodes"))


def _chunks(spark: SparkSession, root: str, part: str, first: str) -> DataFrame:
    """dataset, chunk, start, length, meta, data: for each chunk of the arrays under ``part`` maps from array to zarr.json and to bytes.

    The chunks that there must be follow from the first array's shape.
    """
    at, inside = f"{root}/*.geff/{part}", rf"\.geff/{part}/(.*?)"
    meta = _files(spark, at, "zarr.json").select(_name("geff").alias("dataset"), F.regexp_extract("path", inside + r"/zarr\.json$", 1).alias("array"), F.col("content").cast("string").alias("text")).filter("array != ''")
    metas = meta.groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("array", "text"))).alias("meta"))
    head = F.element_at("meta", F.lit(first))
    n, c = (F.get_json_object(head, p).cast("long") for p in ("$.shape[0]", "$.chunk_grid.configuration.chunk_shape[0]"))
    every = metas.withColumn("_n", n).withColumn("_l", c).filter("_n > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.col("_l")))))
    every = every.select("dataset", "chunk", (F.col("chunk") * F.col("_l")).alias("start"), F.least("_l", F.col("_n") - F.col("chunk") * F.col("_l")).alias("length"), "meta")
    tail = r"/c/(\d+)(?:/0)*$"
    found = _files(spark, at, "[0-9]*").select(_name("geff").alias("dataset"), F.regexp_extract("path", inside + tail, 1).alias("array"), F.regexp_extract("path", tail, 1).cast("long").alias("chunk"), "content").filter("array != ''")
    data = found.groupBy("dataset", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("array", "content"))).alias("data"))
    return every.join(data, ["dataset", "chunk"], "left")


def _values(row, array: str) -> np.ndarray:
    """The rows of an array in this chunk, those past the array's end left off."""
    meta, data = json.loads(dict(row.meta)[array]), None if row.data is None else dict(row.data).get(array)
    shape = meta["chunk_grid"]["configuration"]["chunk_shape"]
    if not row.start + row.length <= meta["shape"][0] or (row.length < shape[0] and row.start + row.length != meta["shape"][0]) or row.start % shape[0] or row.length > shape[0]:
        raise ValueError(f"the arrays of graph {row.dataset} differ in their chunks")
    full = np.full(shape, meta.get("fill_value") or 0, meta["data_type"]) if data is None else decoded(bytes(data), meta)
    return full[: row.length]


def graph_nodes(spark: SparkSession, root: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Nodes of every graph store with low <= t < high. The frames of a chunk are decoded first; a chunk without a frame in the range isn't decoded further."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                t = _values(row, "props/t/values")
                keep = (t >= (t.min() if low is None else low)) & (t <= t.max() if high is None else t < high)
                if keep.any():
                    at = {a: _values(row, f"props/{a}/values")[keep].astype("int32") for a in AXES[1:]}
                    yield pd.DataFrame({"dataset": row.dataset, "node_id": _values(row, "ids")[keep].astype("int64"), "t": t[keep].astype("int32"), **at})

    return _chunks(spark, root, "nodes", "ids").mapInPandas(run, NODES)


def graph_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges of every graph store; edge_seq is an edge's row in its array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                e = _values(row, "ids").astype("int64").reshape(-1, 2)
                yield pd.DataFrame({"dataset": row.dataset, "source_id": e[:, 0], "target_id": e[:, 1], "edge_seq": np.arange(row.start, row.start + len(e), dtype="int64")})

    return _chunks(spark, root, "edges", "ids").mapInPandas(run, EDGES)


def write_dumps(nodes: DataFrame, voxel: tuple[float, float, float], root: str) -> None:
    """A candidate dump ``<dataset>.npz`` each: coords (rows of t, z, y, x in voxels, by t and node_id) and voxel_size in micrometres.

    The format is a file a dataset, so a group is a dataset.
    """

    def write(pdf: pd.DataFrame) -> int:
        out = io.BytesIO()
        np.savez_compressed(out, coords=pdf.sort_values(["t", "node_id"])[list(AXES)].to_numpy("float64"), voxel_size=np.array(voxel))
        save(f"{root}/{quote(pdf['dataset'].iloc[0], safe='')}.npz", out.getvalue())
        return len(pdf)

    _each(nodes.select("dataset", "node_id", *AXES), ("dataset",), write)


def dumped(spark: SparkSession, root: str) -> DataFrame:
    """dataset, node_id, t, uz, uy, ux of all candidate dumps in a folder; node_id is a candidate's row in its dump.

    Coordinates become micrometres by the dump's voxel_size, its last three numbers. A dump without candidates gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                with np.load(io.BytesIO(bytes(row.content)), allow_pickle=False) as dump:
                    at, size = dump["coords"].astype("float64").reshape(-1, 4), dump["voxel_size"].astype("float64").reshape(-1)[-3:]
                um = at[:, 1:] * size
                yield pd.DataFrame({"dataset": row.dataset, "node_id": np.arange(len(at), dtype="int64"), "t": at[:, 0].astype("int32"), "uz": um[:, 0], "uy": um[:, 1], "ux": um[:, 2]})

    files = spark.read.format("binaryFile").load(f"{root}/*.npz").select(_name("npz").alias("dataset"), "content")
    return files.mapInPandas(run, "dataset string, node_id long, t int, uz double, uy double, ux double")


def coverage(truth: DataFrame, candidates: DataFrame, reach: float = 7.0) -> DataFrame:
    """dataset, gt_cells, covered: how many truth points have a candidate of the same frame within ``reach`` micrometres."""
    from tracelace.operators import joins

    slim = ["dataset", "node_id", "t", "uz", "uy", "ux"]
    near = joins.gated(truth.select(*slim), candidates.select(*slim), reach)
    hit = near.select(F.col("a_dataset").alias("dataset"), F.col("a_node_id").alias("node_id")).distinct().groupBy("dataset").agg(F.count(F.lit(1)).alias("covered"))
    return truth.groupBy("dataset").agg(F.count(F.lit(1)).alias("gt_cells")).join(hit, "dataset", "left").fillna(0, ["covered"])
