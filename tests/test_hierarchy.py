"""The tree of nested segments against flood fills at every level, its scores, and what they say about real segments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_volumes import flood, frames_of
from tracelace.operators import hierarchy, patches, voxels

LEVELS = (0.9, 0.75, 0.6, 0.45)


def plain(a):
    """Segments by (level, key): size, mass, place, peak, parent's key, merge; a key is the least voxel."""
    found = [{min(map(tuple, p)): {tuple(q) for q in p} for p in flood(a.astype(float) > v)} for v in LEVELS]
    out = {}
    for level in reversed(range(len(LEVELS))):
        for key, voxels in found[level].items():
            up = next((k for k, held in found[level + 1].items() if voxels <= held), None) if level + 1 < len(LEVELS) else None
            kids = sum(v <= voxels for v in found[level - 1].values()) if level else 0
            merge = LEVELS[-1] if up is None else (LEVELS[level + 1] if out[level + 1, up]["kids"] > 1 else out[level + 1, up]["merge"])
            values = [float(a[q]) for q in voxels]
            out[level, key] = {"size": len(voxels), "mass": round(sum(values), 4), "peak": max(values), "at": tuple(round(float(x), 6) for x in np.mean(list(voxels), axis=0)), "up": up, "kids": kids, "merge": merge}
    return out


@pytest.mark.parametrize("side", [(2, 4, 4), (8, 32, 32)])
def test_tree_equals_flood_fill_at_every_level(spark, side):
    rng = np.random.default_rng(5)
    arrays = {(d, t): rng.random((4, 9, 10)).astype(np.float32) for d, t in (("a", 0), ("a", 1), ("b", 0))}
    segments = hierarchy.tree(patches.blocks(frames_of(spark, arrays), side, 1), LEVELS, side)
    rows = hierarchy.scored(segments, LEVELS).collect()
    for (d, t), a in arrays.items():
        mine = {r.segment: r for r in rows if (r.dataset, r.t) == (d, t)}
        want = plain(a)
        mark = lambda level, size, mass, peak, at: (level, size, mass, round(peak, 6), at)
        of = lambda r: mark(r.level, r["size"], round(r.mass, 4), r.peak, tuple(round(x, 6) for x in (r.z, r.y, r.x)))
        theirs = {k: mark(k[0], w["size"], w["mass"], w["peak"], w["at"]) for k, w in want.items()}
        got = sorted((of(r), of(mine[r.parent]) if r.parent is not None else None, r.children, round(r.merge, 6), round(r.height, 6)) for r in mine.values())
        assert got == sorted((theirs[k], theirs[k[0] + 1, w["up"]] if w["up"] is not None else None, w["kids"], w["merge"], round(w["peak"] - w["merge"], 6)) for k, w in want.items())


def test_two_peaks_on_one_ridge(spark):
    a = np.array([[[0, 0.8, 0.95, 0.5, 0.92, 0]]], np.float32)
    rows = hierarchy.scored(hierarchy.tree(patches.blocks(frames_of(spark, {("a", 0): a}), (1, 1, 2), 1), LEVELS, (1, 1, 2)), LEVELS).collect()
    assert sorted((r.level, r["size"], r.children, r.merge) for r in rows) == [(0, 1, 0, 0.45), (0, 1, 0, 0.45), (1, 1, 1, 0.45), (1, 2, 1, 0.45), (2, 1, 1, 0.45), (2, 2, 1, 0.45), (3, 4, 2, 0.45)]
    empty = hierarchy.tree(patches.blocks(frames_of(spark, {("a", 0): a * 0})), LEVELS)
    assert empty.count() == 0
    with pytest.raises(ValueError, match="fall"):
        hierarchy.tree(patches.blocks(frames_of(spark, {("a", 0): a})), (0.5, 0.6))


def test_real_segments_are_the_nearest_of_truth_and_scores_are_cut_at_their_quantiles(spark):
    s = spark.createDataFrame([("a", 0, i, 0.0, 0.0, float(x), float(v)) for i, (x, v) in enumerate(((0, 5), (10, 3), (20, 1), (24, 2), (90, 4)))] + [("a", 7, 1, 0.0, 0.0, 0.0, 9.0)], "dataset string, t int, segment long, z double, y double, x double, area double")
    spacing = hierarchy.Spacing(1.0, 1.0, 1.0)
    truth = spark.createDataFrame([("a", 1, 0, 0.0, 0.0, 1.0), ("a", 2, 0, 0.0, 0.0, 22.0), ("a", 3, 0, 0.0, 0.0, 50.0), ("a", 4, 0, 0.0, 0.0, 2.0), ("b", 5, 0, 0.0, 0.0, 0.0)], "dataset string, node_id long, t int, uz double, uy double, ux double")
    judged, within = hierarchy.labelled_by(s, truth, 3.0, spacing)
    assert {(r.segment, r.is_real) for r in judged.collect()} == {(0, True), (1, False), (2, True), (3, False), (4, False)}
    assert {tuple(r) for r in within.collect()} == {("a", 4, 3), ("b", 1, 0)}
    r = hierarchy.separation(judged, "area", (0.0, 0.5)).first()
    assert (r.n_pos, r.n_neg, round(r.auc, 6), r.recall_at_0, round(r.recall_at_50, 6)) == (2, 3, 0.5, 0.0, round(1 / 3, 6))
    assert hierarchy.separation(judged.filter("not is_real"), "area").first().auc is None


def test_tree_of_drawn_frames_equals_that_of_blocks(spark):
    rng = np.random.default_rng(7)
    rows = [("a", t, int(z), int(y), int(x)) for t in range(2) for z, y, x in rng.integers((0, 0, 0), (8, 40, 40), (14, 3))]
    p = spark.createDataFrame(rows, "dataset string, t int, z int, y int, x int")
    levels = (0.9, 0.5, 0.15)
    cuts = patches.blocks(voxels.rendered(p, (8, 40, 40), 1.5), halo=1), voxels.Drawn(p, (8, 40, 40), 1.5)
    of = lambda cut: sorted((r.t, r.level, r.size, r.children, round(r.merge, 6), *(round(r[c], 6) for c in ("mass", "z", "y", "x", "peak"))) for r in hierarchy.scored(hierarchy.tree(cut, levels), levels).collect())
    want, got = map(of, cuts)
    assert got == want and len({r[1] for r in got}) == 3


def test_segments_judged_where_frames_are_drawn_equal_those_of_the_tree(spark):
    rng = np.random.default_rng(9)
    times = [0, 1, 15, 16, 40]
    rows = [(d, t, int(z), int(y), int(x)) for d in "ab" for t in times for z, y, x in rng.integers((0, 0, 0), (8, 40, 40), (14, 3))]
    p = spark.createDataFrame(rows, "dataset string, t int, z int, y int, x int")
    real = [(d, 100 * i + j, t, float(z), float(y) / 2, float(x) / 2) for i, (d, t) in enumerate((d, t) for d in "abc" for t in [*times[1:], 70]) for j, (z, y, x) in enumerate(rng.integers((0, 0, 0), (12, 34, 34), (6, 3)))]
    truth = spark.createDataFrame(real, "dataset string, node_id long, t int, uz double, uy double, ux double")
    drawn, levels, sizes = voxels.Drawn(p, (8, 40, 40), 1.5), (0.9, 0.7, 0.5, 0.3, 0.15), (20, 900)
    want = hierarchy.scored(hierarchy.tree(drawn, levels), levels).filter(F.col("size").between(*sizes))
    judged, within = hierarchy.labelled_by(want, truth, 2.5)
    out = hierarchy.drawn_real(drawn, levels, sizes, truth, 2.5)
    of = lambda df: sorted((r.dataset, r.t, r.segment, r.is_real, *(round(r[c], 9) for c in ("height", "area", "intensity"))) for r in df.collect())
    assert of(out) == of(judged) and {r.is_real for r in out.collect()} == {True, False}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    held = {(r.dataset, r.ruler): (r.n_truth, r.contained) for r in hierarchy.drawn_containment(drawn, levels, sizes, truth, (1.0, 2.5)).collect()}
    assert {d: v for (d, ruler), v in held.items() if ruler == 2.5} == {r.dataset: (r.n_truth, r.contained) for r in within.collect()} and len(held) == 6
    assert {d: v[1] for (d, ruler), v in held.items() if ruler == 1.0} == {r.dataset: r.contained for r in hierarchy.labelled_by(want, truth, 1.0)[1].collect()}
