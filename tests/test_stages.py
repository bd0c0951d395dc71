import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelace.functions.geometry import to_um
from tracelace.operators import linkers, repair, stages, voxels
from tracelace.operators.components import components
from tracelace.sources import zarr
from tracelace.streaming import frames


def graph(spark, nodes, edges):
    n = to_um(spark.createDataFrame([("a", *x) for x in nodes], "dataset string, node_id long, t int, z int, y int, x int"))
    e = spark.createDataFrame([("a", s, t, i) for i, (s, t) in enumerate(edges)], "dataset string, source_id long, target_id long, edge_seq long")
    return n, e


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(i, i + 1) for i in range(200, 240)] + [(500, 500)]
    at = {x: x for e in edges for x in e}
    for _ in at:
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    df = spark.createDataFrame([("k", *e) for e in edges] + [("other", 1, 2), ("other", None, 3)], "k string, a long, b long")
    got = {(r.k, r.node): r.root for r in components(df, "a", "b", ("k",)).collect()}
    want = {("k", x): r for x, r in at.items() if x != 500} | {("other", 1): 1, ("other", 2): 1}
    lone = {("k", a) for a, b in edges if a == b} - set(got)
    assert got == {k: v for k, v in want.items() if k not in lone}


def test_lineages_and_other_graphs_are_labelled_alike(spark):
    rng = np.random.default_rng(7)
    tree = [(int(rng.integers(max(0, i - 5), i)), i) for i in range(1, 120) if i % 9]
    for edges in (tree, [*tree, (3, 60)]):
        nodes, e = graph(spark, [(i, i, 0, 0, 0) for i in range(120)], edges)
        at = list(range(120))
        for _ in at:
            for a, b in edges:
                at[a] = at[b] = min(at[a], at[b])
        assert {r.node_id: r.component for r in repair.labelled(nodes, e).collect()} == dict(enumerate(at))


def test_smoothing_is_a_fold_in_order_of_ids(spark):
    nodes, edges = graph(spark, [(i, i, 0, y, 0) for i, y in enumerate([0, 10, 0, 10, 0])], [(i, i + 1) for i in range(4)])
    got = {r.node_id: r.y for r in stages.smoothed(nodes, edges, repair.labelled(nodes, edges)).collect()}
    own, now = [0, 10, 0, 10, 0], [0.0, 10.0, 0.0, 10.0, 0.0]
    for i in (1, 2, 3):
        now[i] = 0.2 * own[i] + 0.8 * (now[i - 1] + now[i + 1]) / 2
    assert got == {i: int(np.rint(v)) for i, v in enumerate(now)}


def test_a_bridge_inserts_the_missing_point(spark):
    nodes, edges = graph(spark, [(1, 0, 5, 10, 10), (2, 1, 5, 12, 10), (3, 3, 5, 16, 10), (4, 4, 5, 18, 10), (9, 4, 5, 90, 90)], [(1, 2), (3, 4)])
    n, e = stages.density_gap_bridge(nodes, edges, 5.0, most_added=0.5)
    new = {(r.node_id, r.t, r.z, r.y, r.x) for r in n.collect()} - {(r.node_id, r.t, r.z, r.y, r.x) for r in nodes.collect()}
    assert new == {(10, 2, 5, 14, 10)}
    assert {(r.source_id, r.target_id) for r in e.collect()} == {(1, 2), (3, 4), (2, 10), (10, 3)}
    assert stages.density_gap_bridge(nodes, edges, 5.0, most_added=0.1)[1].count() == 2  # the cap is int(0.5) = 0


def test_a_gap_is_closed_through_an_isolated_point(spark):
    nodes, edges = graph(spark, [(1, 0, 5, 10, 10), (2, 1, 5, 12, 10), (7, 2, 5, 14, 11), (3, 3, 5, 16, 10), (4, 4, 5, 18, 10)], [(1, 2), (3, 4)])
    n, e = stages.close_gaps(nodes, edges, 10.0, 3.0, most_edges=1.0)
    assert n.count() == 5 and {(r.source_id, r.target_id) for r in e.collect()} == {(1, 2), (3, 4), (2, 7), (7, 3)}
    n, e = stages.close_gaps(nodes.filter("node_id != 7"), edges, 10.0, 3.0, most_edges=1.0)
    assert {(r.source_id, r.target_id) for r in e.collect()} == {(1, 2), (3, 4), (2, 5), (5, 3)} and n.count() == 5


def test_a_second_daughter_is_recovered(spark):
    nodes, edges = graph(spark, [(1, 0, 5, 10, 10), (2, 1, 5, 12, 10), (3, 1, 5, 8, 10), (4, 1, 5, 80, 80)], [(1, 2)])
    got = [(r.source_id, r.target_id) for r in stages.geometric_divisions(nodes, edges, most_added=1.0).collect()]
    assert got == [(1, 3)]


def test_merging_keeps_one_parent_and_two_children(spark):
    own = spark.createDataFrame([("a", 1, 10, 0), ("a", 1, 11, 1)], "dataset string, source_id long, target_id long, edge_seq long")
    donor = spark.createDataFrame([("a", 1, 12, 0), ("a", 2, 10, 1), ("a", 2, 13, 2), ("a", 3, 13, 3)], "dataset string, source_id long, target_id long, edge_seq long")
    assert {(r.source_id, r.target_id) for r in stages.merged(own, donor).collect()} == {(1, 10), (1, 11), (2, 13)}


def test_greedy_budget_passes_over_what_does_not_fit(spark):
    s = spark.createDataFrame([("a", 1, 5, 0.9, 1.0), ("a", 2, 4, 0.8, 1.0), ("a", 3, 2, 0.7, 1.0)], "dataset string, component long, size long, mean_p double, mean_d double")
    cap = spark.createDataFrame([("a", 7)], "dataset string, cap int")
    assert {r.component for r in stages.rescued_by_budget(s, cap).collect()} == {1, 3}


def test_peaks_and_plateaus():
    a = np.zeros((3, 9, 9), np.float32)
    a[1, 2, 2], a[1, 2, 3], a[1, 6, 6] = 5, 5, 3
    assert voxels.peaks_of(a, (1, 2, 2), 1.0) == [(1, 2, 2, 5.0), (1, 6, 6, 3.0)]
    assert voxels.peaks_of(a, (1, 2, 2), 3.0) == [(1, 2, 2, 5.0)]
    assert voxels.pooled(np.arange(2 * 5 * 5, dtype=float).reshape(2, 5, 5), 2).shape == (2, 2, 2)
    assert voxels.dog(a, (0.0, 1.0, 1.0))[1, 6, 6] > 0


@pytest.mark.parametrize("codec", ["none", "gzip", "zstd"])
def test_chunked_store(spark, tmp_path, codec):
    import zstandard

    video = np.arange(3 * 2 * 4 * 5, dtype="<u2").reshape(3, 2, 4, 5)
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": codec, "configuration": {}}] if codec != "none" else [])
    meta = {"shape": [3, 2, 4, 5], "data_type": "uint16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [1, 2, 4, 5]}}, "codecs": codecs, "fill_value": 7, "attributes": {"scale": [1.0, 1.625, 0.4, 0.4], "quantiles": {"0.5": 3}}}
    (tmp_path / "zarr.json").write_text(json.dumps(meta))
    pack = {"none": lambda b: b, "gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress}[codec]
    for t in (0, 2):
        at = tmp_path / f"c/{t}/0/0"
        at.mkdir(parents=True)
        (at / "0").write_bytes(pack(video[t].tobytes()))
    got = {r.t: np.array(r.voxels).reshape(r.shape) for r in zarr.frames(spark, str(tmp_path), "v").collect()}
    assert (got[0] == video[0]).all() and (got[2] == video[2]).all() and (got[1] == 7).all()
    assert zarr.video(spark, str(tmp_path), "v").first().quantiles == {0.5: 3.0}


def test_stream_links_as_the_batch_does_and_tells_late_points(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [("a", 100 * t + i, t, *(float(x) for x in rng.uniform(0, 20, 3))) for t in range(6) for i in range(5)]
    schema = "dataset string, node_id long, t int, uz double, uy double, ux double"
    points = spark.createDataFrame(rows, schema)
    for k, part in enumerate((points.filter("t <= 2"), points.filter("t > 2").unionByName(spark.createDataFrame([("a", 999, 0, 1.0, 1.0, 1.0)], schema)))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    out = frames.drained(frames.linked(stream), "test-stream").collect()
    batch = {(r.source_id, r.target_id) for r in linkers.motion(points).collect()}
    closed = {(s, e) for s, e in batch if e < 500}
    assert {(r.source_id, r.target_id) for r in out if r.kind == "link"} == closed
    assert [r.source_id for r in out if r.kind == "late"] == [999]
    assert points.groupBy("t").agg(F.count("*")).count() == 6
