"""Chains placed in public tracks: against a comparison of every chain with every place, and planted crops."""

import numpy as np
import pytest

from tracelace.operators import registration

TRACK = "track_id long, t int, uz double, uy double, ux double"


def plain(chain, tracks, tolerance, stride):
    out = set()
    for ident, points in tracks.items():
        for t in points:
            ts = [t + stride * i for i in range(len(chain) + 1)]
            if all(x in points for x in ts):
                walk = np.array([points[x] for x in ts])
                if (np.abs(np.linalg.norm(np.diff(walk, axis=0), axis=1) - chain) <= tolerance).all():
                    out.add((ident, t))
    return out


@pytest.mark.parametrize(("tolerance", "stride"), [(0.5, 1), (1.5, 1), (0.7, 2)])
def test_places_equal_those_of_all_pairs(spark, tolerance, stride):
    rng = np.random.default_rng(int(tolerance * 10) + stride)
    tracks = {i: {t: np.cumsum(rng.normal(0, 1.2, (40, 3)), axis=0)[t] for t in range(40) if rng.random() > 0.05} for i in range(12)}
    chains = {}
    for d in range(8):
        walk = [tracks[d][t] for t in sorted(tracks[d])][3 : 3 + 8 * stride : stride]
        turned = np.array(walk)[:, ::-1] * [1, -1, 1] + 50 + rng.normal(0, 0.05, (len(walk), 3))
        chains[f"d{d}"] = np.linalg.norm(np.diff(turned, axis=0), axis=1)
    public = registration.runs(spark.createDataFrame([(i, t, *map(float, p)) for i, at in tracks.items() for t, p in at.items()], TRACK), stride)
    found = spark.createDataFrame([(d, [float(x) for x in s]) for d, s in chains.items()], "dataset string, steps array<double>")
    got = sorted((r.dataset, r.track_id, r.t) for r in registration.placed(found, public, tolerance, 3, stride).collect())
    want = sorted((d, i, t) for d, s in chains.items() for i, t in plain(s, tracks, tolerance, stride))
    assert got == want and len(got) >= 2


def test_gaps_repeats_nulls_and_short_chains(spark):
    rows = [(1, t, 0.0, 0.0, float(t * t)) for t in (0, 1, 2, 4, 5, 6, 7)] + [(1, 0, 0.0, 0.0, 9.0), (None, 1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0, 0.0), (3, 0, 1.0, 1.0, 1.0)]
    runs = registration.runs(spark.createDataFrame(rows, TRACK))
    assert {(r.track_id, r.t, tuple(r.steps)) for r in runs.collect()} == {(1, 0, (1.0, 3.0)), (1, 4, (9.0, 11.0, 13.0))}
    found = spark.createDataFrame([("edge", [9.5, 11.5]), ("over", [3.0, 9.0]), ("short", [9.0]), ("none", [])], "dataset string, steps array<double>")
    assert [tuple(r) for r in registration.placed(found, runs, 0.5, 2).collect()] == [("edge", 1, 4)]
    assert registration.placed(found, runs.limit(0), 0.5, 2).count() == registration.placed(found.limit(0), runs, 0.5, 2).count() == 0


def test_power(spark):
    found = spark.createDataFrame([("a", [1.0] * 11 + [4.0]), ("flat", [1.0] * 20), ("short", [1.0, 9.0])], "dataset string, steps array<double>")
    assert {r.dataset: (r.n_nodes, r.tested) for r in registration.with_power(found, 1.0).collect()} == {"a": (13, True), "flat": (21, False), "short": (3, False)}


def test_needle_is_the_longest_chain_of_a_dataset(spark):
    nodes = spark.createDataFrame([("a", i, i, 0.0, 0.0, float(i * i)) for i in range(4)] + [("a", 10 + i, i, 5.0, 0.0, float(i)) for i in range(2)], "dataset string, node_id long, t int, uz double, uy double, ux double")
    edges = spark.createDataFrame([("a", i, i + 1, i) for i in range(3)] + [("a", 10, 11, 9)], "dataset string, source_id long, target_id long, edge_seq long")
    assert [tuple(r) for r in registration.needles(nodes, edges).collect()] == [("a", 0, [1.0, 3.0, 5.0])]


def test_a_lost_daughter_leaves_the_chain_whole(spark):
    nodes = spark.createDataFrame([("d", i, i, float(i * i), 0.0, 0.0) for i in range(6)], "dataset string, node_id long, t int, uz double, uy double, ux double")
    edges = spark.createDataFrame([*[("d", i, i + 1, i + 1) for i in range(5)], ("d", 2, 99, 99)], "dataset string, source_id long, target_id long, edge_seq long")
    got = registration.needles(nodes, edges).collect()
    assert [(r.chain_id, len(r.steps)) for r in got] == [(0, 5)]
