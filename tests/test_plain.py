"""Linkers, stages and voxel operators against plain versions on small inputs."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_stages import graph
from tracelace.functions.geometry import to_um
from tracelace.operators import assign, features, joins, linkers, motion, scoring, stages, voxels

SCALE = np.array([1.625, 0.40625, 0.40625])


def scene(seed, frames=4, most=4):
    rng = np.random.default_rng(seed)
    nodes, i = [], 1
    for t in range(frames):
        for _ in range(int(rng.integers(2, most + 1))):
            nodes.append((i, t, int(rng.integers(0, 4)), int(rng.integers(0, 30)), int(rng.integers(0, 30))))
            i += 1
    return nodes


def assigned(cost, ok):
    """All of the smaller side assigned at least cost, forbidden pairs being dear; only allowed pairs are returned."""
    n, m = cost.shape
    if n > m:
        return [(i, j) for j, i in assigned(cost.T, ok.T)]
    priced = np.where(ok, cost, assign.FORBIDDEN)
    best = min(itertools.permutations(range(m), n), key=lambda p: sum(priced[i, j] for i, j in enumerate(p)))
    return [(i, j) for i, j in enumerate(best) if ok[i, j]]


def plain_motion(nodes, knobs):
    links, prev = [], None
    for t in sorted({x[1] for x in nodes}):
        now = sorted(x for x in nodes if x[1] == t)
        at = np.array([x[2:] for x in now], float) * SCALE
        v = np.zeros_like(at)
        if prev is not None and prev[0] == t - 1:
            _, ids, a, w = prev
            raw = np.linalg.norm(a[:, None] - at[None], axis=2)
            cost = np.linalg.norm((a + knobs.ahead * w)[:, None] - at[None], axis=2) + (0.05 * raw if knobs.faithful else 0)
            rows, cols = list(range(len(a))), list(range(len(at)))
            for gate in (knobs.tight, knobs.loose):
                if not rows or not cols:
                    break
                got = [(rows[i], cols[j]) for i, j in assigned(cost[np.ix_(rows, cols)], raw[np.ix_(rows, cols)] <= gate)]
                for i, j in got:
                    links.append((ids[i], now[j][0]))
                    v[j] = at[j] - a[i]
                rows = [i for i in rows if i not in {x for x, _ in got}]
                cols = [j for j in cols if j not in {x for _, x in got}]
        prev = (t, [x[0] for x in now], at, v)
    return set(links)


@pytest.mark.parametrize("faithful", [False, True])
def test_motion_linker_equals_plain(spark, faithful):
    knobs = linkers.Motion(faithful=faithful)
    for seed in range(3):
        nodes = scene(seed)
        got = linkers.motion(graph(spark, nodes, [])[0], knobs)
        assert {(r.source_id, r.target_id) for r in got.collect()} == plain_motion(nodes, knobs)


@pytest.mark.parametrize("seed", range(3))
def test_division_program_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [("a", 0, s, 10 + t, float(rng.random() * 4), float(rng.random())) for s in range(3) for t in range(4) if rng.random() < 0.8]
    df = spark.createDataFrame(pairs, "dataset string, t int, source_id long, target_id long, d double, p double")
    got = {(r.source_id, r.target_id) for r in linkers.integer_program(df, 3.0, 1.0).collect()}
    cost = {(s, t): d - 3.0 * p - 1.0 for _, _, s, t, d, p in pairs}
    best = 0.0
    for parents in itertools.product(*[[None, *[s for s in range(3) if (s, 10 + t) in cost]] for t in range(4)]):
        if all(parents.count(s) <= 2 for s in range(3)):
            best = min(best, sum(cost[s, 10 + t] for t, s in enumerate(parents) if s is not None))
    assert sum(cost[x] for x in got) == pytest.approx(best)
    assert len({t for _, t in got}) == len(got) and all(sum(a == s for a, _ in got) <= 2 for s in range(3))


@pytest.mark.parametrize("seed", range(3))
def test_division_aware_linker_equals_plain(spark, seed):
    nodes = scene(seed, frames=3)
    got = {(r.source_id, r.target_id) for r in linkers.division_aware(graph(spark, nodes, [])[0], 9.0).collect()}
    want = set()
    for t in range(2):
        a, b = sorted(x for x in nodes if x[1] == t), sorted(x for x in nodes if x[1] == t + 1)
        d = np.linalg.norm((np.array([x[2:] for x in a], float)[:, None] - np.array([x[2:] for x in b], float)[None]) * SCALE, axis=2)
        first = assigned(d, d <= 9.0)
        single, taken = {i for i, _ in first}, set()
        for j in range(len(b)):
            if j in {y for _, y in first}:
                continue
            near = sorted((d[i, j], a[i][0], i) for i in single if d[i, j] <= 9.0)
            for _, _, i in near:
                if i not in taken:
                    taken.add(i)
                    want.add((a[i][0], b[j][0]))
                    break
        want |= {(a[i][0], b[j][0]) for i, j in first}
    assert len(got) == len(want)  # as many pairs as possible, then the least total; equal totals may differ in pairs
    where = {x[0]: np.array(x[2:], float) * SCALE for x in nodes}
    total = lambda s: sum(np.linalg.norm(where[x] - where[y]) for x, y in s)
    assert total(got) == pytest.approx(total(want))


def test_skips_cost_what_they_say(spark):
    rng = np.random.default_rng(4)
    pairs = [("a", 0, s, 10 + t, float(rng.random() * 3)) for s in range(3) for t in range(3)]
    df = spark.createDataFrame(pairs, "dataset string, t int, source_id long, target_id long, cost double")
    cost = {(s, t): c for _, _, s, t, c in pairs}
    last = -1
    for stop in (0.2, 1.0, 5.0):
        got = {(r.source_id, r.target_id) for r in assign.with_skips(df, "cost", stop).collect()}
        own = sum(cost[x] for x in got) + stop * (3 - len(got))
        best = min(sum(cost[s, 10 + t] for s, t in enumerate(p) if t < 3) + stop * sum(t >= 3 for t in p) for p in itertools.permutations(range(6), 3))
        assert own == pytest.approx(best) and len(got) >= last
        last = len(got)


@pytest.mark.parametrize("seed", range(2))
def test_geometric_divisions_equal_plain(spark, seed):
    nodes = scene(seed, frames=3, most=6)
    first = plain_motion(nodes, linkers.Motion())
    edges = sorted(x for k, x in enumerate(sorted(first)) if k % 3)
    n, e = graph(spark, nodes, edges)
    got = {(r.source_id, r.target_id) for r in stages.geometric_divisions(n, e, 9.0, 12.0, 12.0, 1.0, 1.0).collect()}
    where, frame = {x[0]: np.array(x[2:], float) * SCALE for x in nodes}, {x[0]: x[1] for x in nodes}
    kids = {s: [t for a, t in edges if a == s] for s, _ in edges}
    parented = {t for _, t in edges}
    d = lambda a, b: float(np.linalg.norm(where[a] - where[b]))
    want = []
    for t in range(2):
        single = [s for s, c in kids.items() if len(c) == 1 and frame[s] == t and d(s, c[0]) <= 12.0]
        claimed, kept = set(), []
        for c in sorted(x for x in where if frame[x] == t + 1 and x not in parented):
            near = sorted((d(s, c) + 0.15 * d(kids[s][0], c), s) for s in single if d(s, c) <= 9.0 and d(kids[s][0], c) <= 12.0)
            for score, s in near:
                if s not in claimed:
                    claimed.add(s)
                    kept.append((score, s, c))
                    break
        want += [(t, *x) for x in sorted(kept)[: max(1, len([s for s, c in kids.items() if len(c) == 1 and frame[s] == t]))]]
    assert got == {(s, c) for _, _, s, c in want[: len(edges)]}


def test_nearest_equals_all_pairs(spark):
    nodes = [*scene(3, frames=3, most=6), (900, 1, 0, 4000, 4000), (901, 7, 1, 1, 1)]
    n = graph(spark, nodes, [])[0]
    where = {x[0]: (x[1], np.array(x[2:], float) * SCALE) for x in nodes}
    for dt, others in ((0, True), (1, False)):
        got = {r.node_id: (r.nearest_id, r.d) for r in joins.nearest(n, n, dt, others=others, start=2.0).collect()}
        for i, (t, p) in where.items():
            near = sorted((float(np.linalg.norm(p - q)), j) for j, (u, q) in where.items() if u == t + dt and (not others or j != i))
            assert got[i] == (near[0][1], pytest.approx(near[0][0])) if near else got[i] == (None, None)


def test_furth_fit_finds_what_made_the_curve():
    s, tau, noise = 1.3, 2.5, 0.4
    curve = [(t, 2 * s * s * tau * (t - tau * (1 - math.exp(-t / tau))) + noise) for t in range(1, 9)]
    assert motion.furth_fit(curve) == (pytest.approx(s, rel=1e-3), pytest.approx(tau, rel=1e-3), pytest.approx(noise, rel=1e-2))


def test_split_score_of_two_videos(spark):
    rows = [("a", 8, 1, 1, 100, 110, 1, 0, 1), ("b", 2, 2, 0, 50, 40, 0, 0, 0)]
    counts = spark.createDataFrame([(r[0], *r[1:4], r[1] / (r[1] + r[2] + r[3])) for r in rows], "dataset string, tp long, fp long, fn long, jaccard double")
    n = spark.createDataFrame([(r[0], r[4]) for r in rows], "dataset string, n_pred long")
    video = spark.createDataFrame([(r[0], r[5]) for r in rows], "dataset string, estimated_nodes long")
    div = spark.createDataFrame([(r[0], *r[6:]) for r in rows], "dataset string, div_tp long, div_fp long, div_fn long")
    metrics = {r.dataset: r for r in scoring.video_metrics(counts, n, video, div).collect()}
    got = scoring.split_score(scoring.video_metrics(counts, n, video, div)).first()
    want = (metrics["a"].adjusted * 10 + metrics["b"].adjusted * 4) / 14
    assert got.adjusted == pytest.approx(want) and got.division == pytest.approx(0.5) and got.score == pytest.approx(want + 0.05)
    assert metrics["b"].div_jaccard is None


def test_network_equals_a_plain_loop():
    rng = np.random.default_rng(0)
    weights = [(rng.normal(size=(3, 4)), rng.normal(size=4)), (rng.normal(size=(4, 1)), rng.normal(size=1))]
    norm, mean, std = (rng.normal(size=4), rng.normal(size=4)), rng.normal(size=3), np.abs(rng.normal(size=3))
    x = rng.normal(size=(5, 3))
    got = features.network(weights, norm, mean, std)(x)
    for row, score in zip(x, got, strict=True):
        h = [sum((row[i] - mean[i]) / std[i] * weights[0][0][i][j] for i in range(3)) + weights[0][1][j] for j in range(4)]
        mid = sum(h) / 4
        var = sum((v - mid) ** 2 for v in h) / 4
        h = [max(0.0, (v - mid) / math.sqrt(var + 1e-5) * norm[0][j] + norm[1][j]) for j, v in enumerate(h)]
        out = sum(v * weights[1][0][j][0] for j, v in enumerate(h)) + weights[1][1][0]
        assert score == pytest.approx(1 / (1 + math.exp(-out)))


@pytest.mark.parametrize("seed", range(3))
def test_peaks_equal_a_plain_search(seed):
    a = np.random.default_rng(seed).random((4, 7, 6)).astype(np.float32)
    want = []
    for p in np.ndindex(a.shape):
        box = a[tuple(slice(max(0, c - r), c + r + 1) for c, r in zip(p, (1, 2, 2), strict=True))]
        if a[p] == box.max() and a[p] > 0.6:
            want.append((*p, float(a[p])))
    assert voxels.peaks_of(a, (1, 2, 2), 0.6) == sorted(want)


def test_blob_responses_peak_on_a_blob():
    z, y, x = np.meshgrid(*[np.arange(n) for n in (9, 15, 15)], indexing="ij")
    a = np.exp(-((z - 4) ** 2 + (y - 8) ** 2 + (x - 6) ** 2) / 4.0)
    for response in (voxels.dog(a, (1.0, 1.5, 1.5)), voxels.log_response(a, (1.0, 1.5, 1.5))):
        assert np.unravel_index(response.argmax(), response.shape) == (4, 8, 6) and response.max() > 0
    flat = np.full((4, 6, 6), 3.0)
    assert np.allclose(voxels.dog(flat, (1, 1, 1)), 0) and np.allclose(voxels.log_response(flat, (1, 1, 1)), 0)


def test_normalising_and_pooling_equal_plain():
    a = np.random.default_rng(1).random((3, 5, 7)).astype(np.float32)
    got = voxels.per_slice(a)
    for k in range(3):
        lo, hi = np.percentile(a[k], [1.0, 99.8])
        assert np.allclose(got[k], np.maximum((a[k] - lo) / (hi - lo), 0), atol=1e-5)
    small = voxels.pooled(a, 2)
    assert small.shape == (3, 2, 3) and small[1, 1, 2] == pytest.approx(a[1, 2:4, 4:6].mean())


def test_rendered_spots_equal_a_plain_sum(spark):
    nodes = graph(spark, [(1, 0, 1, 4, 5), (2, 0, 2, 9, 9), (3, 1, 0, 0, 0), (4, 1, 50, 50, 50)], [])[0]
    got = {r.t: np.array(r.voxels).reshape(r.shape) for r in voxels.rendered(nodes, (4, 12, 12), 1.2).collect()}
    for t, points in ((0, [(1, 4, 5), (2, 9, 9)]), (1, [(0, 0, 0)])):
        for q in [(0, 0, 0), (1, 4, 5), (2, 9, 8), (3, 11, 11)]:
            want = max(math.exp(-sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) / (2 * 1.44)) for p in points)
            assert got[t][q] == pytest.approx(want, abs=1e-6)


def test_streamed_links_equal_the_batch_linker(spark):
    import __spark_entry__ as entry
    from tracelace.sources.tracks import Tracks

    sf = "/root/testdata/sf0.001"
    want = {(r.dataset, r.source_id, r.target_id) for r in linkers.motion(Tracks(spark, sf).nodes).collect()}
    rows = entry.queries()["z2_streaming_motion_linker"](spark, sf).collect()
    got = {(r.dataset, r.source_id, r.target_id) for r in rows if r.kind == "link"}
    assert got == want and not [r for r in rows if r.kind == "late"]
