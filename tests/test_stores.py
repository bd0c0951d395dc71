"""Stores of graphs and dumps: round trips, chunks that are missing, empty graphs, names that paths can't hold."""

import json

import numpy as np
import pytest

from tracelace.sources import stores

NAME = "a b/c%é"


@pytest.fixture(scope="module")
def graphs(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stores"))
    nodes = [(NAME, 100 + i, i // 3, i % 5, i, 2 * i) for i in range(23)] + [("b", 7, 4, 1, 2, 3)]
    edges = [(NAME, 100 + i, 103 + i, 50 - i) for i in range(20)]
    estimated = spark.createDataFrame([(NAME, 99), ("b", None), ("empty", 5)], "dataset string, estimated_nodes long")
    n = spark.createDataFrame(nodes, "dataset string, node_id long, t int, z int, y int, x int")
    e = spark.createDataFrame(edges, "dataset string, source_id long, target_id long, edge_seq long")
    stores.write_graphs(n, e, estimated, root, rows=4)
    return root, nodes, edges


def test_graphs_round_trip(spark, graphs):
    root, nodes, edges = graphs
    assert sorted(map(tuple, stores.graph_nodes(spark, root).collect())) == sorted(nodes)
    want = [(d, s, t, i) for i, (d, s, t, _) in enumerate(sorted(edges, key=lambda e: e[3]))]
    assert sorted(map(tuple, stores.graph_edges(spark, root).collect())) == sorted(want)
    assert {r.dataset: r.estimated_nodes for r in stores.estimates(spark, root).collect()} == {NAME: 99, "b": None, "empty": 5}


@pytest.mark.parametrize(("low", "high"), [(2, 4), (None, 1), (4, None), (50, None), (3, 3)])
def test_range_of_frames(spark, graphs, low, high):
    root, nodes, _ = graphs
    want = [n for n in nodes if (low is None or n[2] >= low) and (high is None or n[2] < high)]
    assert sorted(map(tuple, stores.graph_nodes(spark, root, low, high).collect())) == sorted(want)


def test_missing_chunks_hold_the_fill_value_and_unequal_arrays_are_errors(spark, tmp_path):
    n = spark.createDataFrame([("g", i, i, 1, 2, 3) for i in range(6)], "dataset string, node_id long, t int, z int, y int, x int")
    e = spark.createDataFrame([], "dataset string, source_id long, target_id long, edge_seq long")
    stores.write_graphs(n, e, spark.createDataFrame([("g", 1)], "dataset string, estimated_nodes long"), str(tmp_path), rows=4)
    (tmp_path / "g.geff/nodes/props/z/values/c/1").unlink()
    assert {r.node_id: r.z for r in stores.graph_nodes(spark, str(tmp_path)).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0}
    at = tmp_path / "g.geff/nodes/props/y/values/zarr.json"
    meta = json.loads(at.read_text())
    at.write_text(json.dumps(meta | {"shape": [5]}))
    with pytest.raises(Exception, match="differ in their chunks"):
        stores.graph_nodes(spark, str(tmp_path)).collect()


def test_listing_joins_videos_with_the_graphs_beside_them(spark, tmp_path):
    for name in ("a.zarr", "a.geff", "b.zarr", "c.geff"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "zarr.json").write_text("{}")
    got = {r.dataset: (r.video.rsplit("/", 1)[1], r.graph and r.graph.rsplit("/", 1)[1]) for r in stores.listing(spark, str(tmp_path)).collect()}
    assert got == {"a": ("a.zarr", "a.geff"), "b": ("b.zarr", None)}


def test_dumps_and_coverage(spark, tmp_path):
    schema = "dataset string, node_id long, t int, z int, y int, x int"
    stores.write_dumps(spark.createDataFrame([("a", 9, 1, 4, 0, 0), ("a", 8, 0, 1, 2, 3)], schema), (2.0, 0.5, 0.5), str(tmp_path))
    np.savez(tmp_path / "none.npz", coords=np.zeros((0, 4)), voxel_size=np.ones(4))
    got = stores.dumped(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("a", 0, 0, 2.0, 1.0, 1.5), ("a", 1, 1, 8.0, 0.0, 0.0)]
    truth = spark.createDataFrame([("a", 1, 0, 2.0, 1.0, 2.5), ("a", 2, 1, 2.0, 1.0, 1.5), ("q", 3, 0, 0.0, 0.0, 0.0)], "dataset string, node_id long, t int, uz double, uy double, ux double")
    assert {tuple(r) for r in stores.coverage(truth, got, 1.0).collect()} == {("a", 2, 1), ("q", 1, 0)}


def test_paths_may_name_the_local_file_system(tmp_path):
    for i, start in enumerate(("", "file:", "file://")):
        stores.save(f"{start}{tmp_path}/d/{i}", b"x")
        stores.save(f"{start}{tmp_path}/d/{i}", b"y")
        assert (tmp_path / f"d/{i}").read_bytes() == b"y"
    assert len(list((tmp_path / "d").iterdir())) == 3
