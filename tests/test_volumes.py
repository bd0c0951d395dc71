"""Boxes around points, basins and quantiles over blocks of volumes against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelace.operators import basins, patches, voxels

SPACING = np.array([1.625, 0.40625, 0.40625])


def frames_of(spark, arrays):
    rows = [(d, t, list(a.shape), [float(v) for v in a.ravel()]) for (d, t), a in arrays.items()]
    return spark.createDataFrame(rows, voxels.FRAME)


def points_of(spark, rows):
    return spark.createDataFrame(rows, "dataset string, node_id long, t int, z double, y double, x double")


def flood(mask):
    """Pieces that share faces, by flood filling, as sets of voxels."""
    todo, out = {tuple(p) for p in np.argwhere(mask).tolist()}, []
    while todo:
        stack, piece = [todo.pop()], []
        while stack:
            p = stack.pop()
            piece.append(p)
            for axis in range(3):
                for step in (-1, 1):
                    q = tuple(c + step * (i == axis) for i, c in enumerate(p))
                    if q in todo:
                        todo.remove(q)
                        stack.append(q)
        out.append(piece)
    return out


@pytest.mark.parametrize("share", [0.2, 0.35, 0.6])
def test_basins_over_blocks_equal_flood_fill(spark, share):
    rng = np.random.default_rng(int(100 * share))
    arrays = {("a", 0): rng.random((5, 13, 11)), ("a", 1): rng.random((5, 13, 11)), ("b", 0): rng.random((4, 8, 8))}
    arrays = {k: a.astype(np.float32) for k, a in arrays.items()}
    side = (2, 4, 4)
    got = basins.basins(patches.blocks(frames_of(spark, arrays), side, 1), 1 - share, side).collect()
    for (d, t), a in arrays.items():
        want = sorted((len(p), round(float(sum(float(a[q]) for q in p)), 4)) for p in flood(a.astype(float) > 1 - share))
        assert sorted((r["size"], round(r.mass, 4)) for r in got if r.dataset == d and r.t == t) == want


def test_a_snake_through_all_blocks_is_one_basin(spark):
    a = np.zeros((1, 9, 21), np.float32)
    a[0, ::2] = 1
    a[0, 1::4, -1] = a[0, 3::4, 0] = 1
    got = basins.basins(patches.blocks(frames_of(spark, {("a", 0): a}), (1, 3, 3), 1), 0.5, (1, 3, 3)).collect()
    assert [r["size"] for r in got] == [int(a.sum())]
    assert basins.basins(patches.blocks(frames_of(spark, {("a", 0): a}), (1, 3, 3), 1), 5.0, (1, 3, 3)).count() == 0


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(4)
    arrays = {("a", t): (rng.normal(size=(3, 7, 7)) * 10).astype(np.float32) for t in range(3)} | {("b", 0): np.array([[[0.0, -0.0, 1.0, -1.0, 1.0]]], np.float32)}
    every = {d: np.sort(np.concatenate([a.ravel() for (k, _), a in arrays.items() if k == d])) for d in "ab"}
    ranks = [("a", r) for r in (0, 1, 200, 440)] + [("b", r) for r in range(5)]
    got = basins.order_statistic(frames_of(spark, arrays), spark.createDataFrame(ranks, "dataset string, rank long")).collect()
    assert {(r.dataset, r["rank"]): r.value for r in got} == {(d, r): float(every[d][r]) for d, r in ranks}


def test_floors_are_matched_by_share(spark):
    rng = np.random.default_rng(5)
    coarse = {("a", t): rng.random((3, 6, 6)).astype(np.float32) for t in range(2)}
    fine = {("a", t): (rng.random((3, 12, 12)) * 7).astype(np.float32) for t in range(2)}
    got = basins.matched_floor(frames_of(spark, coarse), 0.7, frames_of(spark, fine)).first().floor
    share = np.mean(np.stack(list(coarse.values())) > np.float32(0.7))
    assert math.isclose(got, float(np.quantile(np.concatenate([a.ravel() for a in fine.values()]).astype(float), 1 - share)), rel_tol=1e-9)


def test_the_referee_sees_two_cells_in_a_merged_basin(spark):
    fine = np.zeros((1, 32, 64), np.float32)
    for y, x in ((6, 6), (6, 30), (24, 10), (24, 50), (24, 54)):
        fine[0, y - 2 : y + 2, x - 2 : x + 2] = 1
    coarse = voxels.pooled(fine, 2)
    rows = {r.grid: r for r in basins.referee(frames_of(spark, {("a", 0): coarse}), frames_of(spark, {("a", 0): fine}), 0.5, 4, (1, 2), (1, 8, 8)).collect()}
    assert rows["coarse"].n_basins == 4 and rows["coarse"].single_n == 3 and rows["coarse"].merged_n == 1
    assert math.isclose(rows["coarse"].single_share + rows["coarse"].merged_share, 1.0)
    assert rows["fine"].n_basins == rows["fine"].single_n + rows["fine"].merged_n + rows["fine"].fragment_n


def scene(seed=3):
    rng = np.random.default_rng(seed)
    arrays = {(d, t): (rng.random((6, 20, 18)) * 100).round().astype(np.float32) for d, t in (("a", 0), ("a", 1), ("b", 0))}
    arrays["a", 1][2:4] = 7  # flat places
    points = []
    for i in range(60):
        d, t = [("a", 0), ("a", 1), ("b", 0)][i % 3]
        points.append((d, i, t, float(rng.integers(0, 60)) / 10, float(rng.integers(0, 200)) / 10, float(rng.integers(0, 180)) / 10))
    points += [("a", 90, 0, 2.0, 500.0, 3.0), ("a", 91, 7, 2.0, 5.0, 3.0), ("c", 92, 0, 2.0, 5.0, 3.0), ("a", 93, 0, 0.0, 0.0, 0.0)]
    return arrays, points


def window(a, p, half):
    c = [int(np.rint(v)) for v in p]
    low, high = [max(0, v - h) for v, h in zip(c, half, strict=True)], [min(n, v + h + 1) for v, h, n in zip(c, half, a.shape, strict=True)]
    return a[tuple(slice(x, max(x, y)) for x, y in zip(low, high, strict=True))].astype(float), low


def test_refined_centres_equal_a_plain_version(spark):
    arrays, points = scene()
    half, side = (1, 3, 3), (2, 5, 7)
    p = points_of(spark, points)
    got = {(r.dataset, r.node_id): (r.z, r.y, r.x) for r in patches.refined(p, patches.boxes(p, patches.blocks(frames_of(spark, arrays), side), half, side), farthest=0.6).collect()}
    assert len(got) == len(points)
    moved = 0
    for d, i, t, *c in points:
        want = np.array(c)
        if (d, t) in arrays:
            a, low = window(arrays[d, t], c, half)
            if a.size:
                w = np.maximum(a - np.percentile(a, 20), 0)
                if w.sum() > 0:
                    place = np.array([(w * g).sum() / w.sum() for g in np.meshgrid(*[np.arange(o, o + n) for o, n in zip(low, a.shape, strict=True)], indexing="ij")])
                    if np.sqrt((((place - want) * SPACING) ** 2).sum()) <= 0.6:
                        want, moved = place, moved + 1
        assert np.allclose(got[d, i], want, atol=1e-9), (d, i)
    assert 5 < moved < len(points) - 5


def test_eigenvalues_equal_numpy(spark):
    rng = np.random.default_rng(6)
    mats = [m @ m.T for m in rng.normal(size=(50, 3, 3))] + [np.diag([2.0, 2.0, 2.0]), np.diag([3.0, 1.0, 1.0]), np.zeros((3, 3)), np.diag([1e6, 1.0, 1e-3])]
    rows = [(i, *(float(v) for v in (m[0, 0], m[1, 1], m[2, 2], m[0, 1], m[0, 2], m[1, 2]))) for i, m in enumerate(mats)]
    df = spark.createDataFrame(rows, "i int, zz double, yy double, xx double, zy double, zx double, yx double")
    got = df.select("i", patches.eigenvalues(*[F.col(c) for c in ("zz", "yy", "xx", "zy", "zx", "yx")]).alias("e")).collect()
    for r in got:
        want = np.linalg.eigvalsh(mats[r.i])[::-1]
        assert np.allclose([r.e.largest, r.e.middle, r.e.least], want, atol=1e-9 * max(1.0, abs(want).max()))


def test_appearance_equals_a_plain_version(spark):
    arrays, points = scene(8)
    half, side, core, ground = (1, 4, 4), (3, 6, 6), 1.3, 1.6
    p = points_of(spark, points)
    box = patches.boxes(p, patches.blocks(frames_of(spark, arrays), side), half, side)
    got = {(r.dataset, r.node_id): [r[k] for k in patches.FEATURES] for r in patches.appearance(box, half, core, ground).collect()}
    grids = np.meshgrid(*[np.arange(-h, h + 1) * s for h, s in zip(half, SPACING, strict=True)], indexing="ij")
    radius = np.sqrt(sum(g**2 for g in grids))
    n = 0
    for d, i, t, *c in points:
        if (d, t) not in arrays:
            continue
        inner, low = window(arrays[d, t], c, half)
        if not inner.size:
            assert (d, i) not in got
            continue
        a = np.full(radius.shape, np.median(inner))
        corner = [lo - (int(np.rint(v)) - h) for lo, v, h in zip(low, c, half, strict=True)]
        a[tuple(slice(o, o + m) for o, m in zip(corner, inner.shape, strict=True))] = inner
        back = np.median(a[radius > ground])
        inside = radius <= core
        w = np.maximum(a - back, 0) * inside
        offset, long = 0.0, 1.0
        if w.sum() > 1e-12:
            m = np.array([(w * g).sum() / w.sum() for g in grids])
            cov = np.array([[(w * (grids[p] - m[p]) * (grids[q] - m[q])).sum() / w.sum() for q in range(3)] for p in range(3)])
            e = np.clip(np.linalg.eigvalsh(cov), 0, None)
            offset, long = float(np.linalg.norm(m)), float(np.sqrt(e[-1] / e[0])) if e[0] > 1e-12 else 1.0
        top = a[inside].max()
        want = [a[inside].mean(), a[inside].std(), top, top - back, ((a > back + 0.5 * (top - back)) & inside).sum() * SPACING.prod(), offset, long]
        assert np.allclose(got[d, i], want, rtol=1e-6, atol=1e-8), (d, i)
        n += 1
    assert n > 40


def test_raw_boxes_lie_inside_and_are_rolled_to_their_peak(spark):
    arrays, points = scene(9)
    half, side = (1, 2, 3), (2, 5, 5)
    p = points_of(spark, points)
    box = patches.boxes(p, patches.blocks(frames_of(spark, arrays), side), half, side)
    for align in (False, True):
        got = {(r.dataset, r.node_id): np.array(r.voxels).reshape(3, 5, 7) for r in patches.raw_boxes(box, half, align).collect()}
        want = {}
        for d, i, t, *c in points:
            if (d, t) in arrays:
                a, _ = window(arrays[d, t], c, half)
                if a.shape == (3, 5, 7):
                    if align:
                        a = np.roll(a, tuple(np.array(half) - np.array(np.unravel_index(int(np.argmax(a)), a.shape))), axis=(0, 1, 2))
                    want[d, i] = a
        assert set(got) == set(want) and all((got[k] == want[k]).all() for k in want) and want


def test_percentiles_split_ties(spark):
    rng = np.random.default_rng(10)
    rows = [("a", i, "mother" if i < 6 else "other", *[float(v) for v in rng.integers(0, 9, 7)]) for i in range(90)]
    df = spark.createDataFrame(rows, "dataset string, node_id long, kind string, " + ", ".join(f"{k} double" for k in patches.FEATURES))
    got = {(r.node_id, r.feature): (r.percentile, r.separates) for r in patches.tail_verdict(df, "kind", "mother", "other").collect()}
    others = np.array([r[3:] for r in rows[6:]])
    for i in range(6):
        for k, name in enumerate(patches.FEATURES):
            want = 100 * (np.mean(others[:, k] < rows[i][3 + k]) + 0.5 * np.mean(others[:, k] == rows[i][3 + k]))
            assert math.isclose(got[i, name][0], want) and got[i, name][1] == (want >= 90 or want <= 10)
    assert len(got) == 42


def test_correlations_and_ranks_equal_a_plain_version(spark):
    rng = np.random.default_rng(12)
    look = {i: rng.random(12).round(2).tolist() for i in range(12)} | {12: [1.0] * 12, 13: [0.5] * 12}
    whole = spark.createDataFrame([("a", i, 0, v) for i, v in look.items()], "dataset string, node_id long, t int, voxels array<float>")
    pairs = [(s, t) for s in range(4) for t in range(4, 14) if (s + t) % 3]
    df = spark.createDataFrame([("a", s, t) for s, t in [*pairs, (0, 99)]], "dataset string, source_id long, target_id long")
    scored = patches.alike(df, whole)
    got = {(r.source_id, r.target_id): r.ncc for r in scored.collect()}
    assert set(got) == set(pairs)
    for (s, t), v in got.items():
        flat = t >= 12
        assert (v is None) == flat and (flat or math.isclose(v, np.corrcoef(np.float32(look[s]).astype(float), np.float32(look[t]).astype(float))[0, 1], abs_tol=1e-9))
    truth = spark.createDataFrame([("a", 0, 4), ("a", 1, 12), ("a", 2, 50)], "dataset string, source_id long, target_id long")
    ranks = {(r.source_id, r.target_id): (r["rank"], r.n) for r in patches.identity_ranks(scored, truth).collect()}
    want = {}
    for s, t in [(0, 4), (1, 12)]:
        if (s, t) in got:
            order = sorted((x for x in pairs if x[0] == s), key=lambda x: (got[x] is None, -(got[x] or 0), x[1]))
            want[s, t] = (order.index((s, t)) + 1, len(order))
    assert ranks == want and ranks


def test_drawn_frames_give_what_rendered_ones_do_and_are_never_sent(spark):
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([("a", t, int(z), int(y), int(x)) for t in range(4) for z, y, x in rng.integers((0, 0, 0), (6, 24, 24), (5, 3))], "dataset string, t int, z int, y int, x int")
    shape = (6, 24, 24)
    stored, drawn = voxels.rendered(p, shape, 1.2), voxels.Drawn(p, shape, 1.2)
    for f in (lambda a: voxels.dog(a, (1.0, 1.5, 1.5)), lambda a: voxels.log_response(a, (1.0, 1.5, 1.5)), lambda a: voxels.pooled(voxels.per_slice(a), 2)):
        want, got = (voxels.peaks(voxels.mapped(x, f), (1, 2, 2), 0.05) for x in (stored, drawn))
        assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect())) != []
        assert "voxels" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_smoothing_and_peaks_equal_plain_loops():
    rng = np.random.default_rng(4)
    a = np.round(rng.random((4, 7, 6)), 1).astype(np.float32)
    padded = np.pad(a, [(1, 1), (2, 2), (2, 2)], constant_values=-np.inf)
    tops = {tuple(p) for p in np.ndindex(a.shape) if a[p] > 0.5 and a[p] == padded[p[0] : p[0] + 3, p[1] : p[1] + 5, p[2] : p[2] + 5].max()}
    got = voxels.peaks_of(a, (1, 2, 2), 0.5)
    assert got and {p[:3] for p in got} <= tops and all(v == a[z, y, x] for z, y, x, v in got)
    kernel = np.array([0.2, 0.5, 0.3])
    for axis in range(3):
        wide = np.pad(a.astype(float), [(1, 1) if k == axis else (0, 0) for k in range(3)], mode="symmetric")
        want = sum(w * np.take(wide, range(i, i + a.shape[axis]), axis=axis) for i, w in enumerate(kernel))
        assert (voxels._along(a.astype(float), kernel, axis) == want).all()


def test_boxes_cut_where_frames_are_drawn_equal_those_of_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [("a", 100 * t + i, t, int(z), int(y), int(x)) for t in range(3) for i, (z, y, x) in enumerate(rng.integers((-4, -1, -1), (9, 40, 40), (12, 3)))]
    p = spark.createDataFrame(rows, "dataset string, node_id long, t int, z int, y int, x int")
    shape, half = (6, 38, 38), (1, 4, 4)
    want = patches.boxes(p, patches.blocks(voxels.rendered(p, shape, 0.6)), half)
    got = patches.drawn_boxes(voxels.Drawn(p, shape, 0.6), half)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and 0 < got.count() < 36
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "voxels" not in plan and "Join" not in plan


def test_drawn_basins_and_their_referee_equal_those_of_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(d, t, int(z), int(y), int(x)) for d in "ab" for t in range(2) for z, y, x in rng.integers((0, 0, 0), (8, 40, 40), (14, 3))]
    p = spark.createDataFrame(rows, "dataset string, t int, z int, y int, x int")
    stored, drawn = voxels.rendered(p, (8, 40, 40), 1.5), voxels.Drawn(p, (8, 40, 40), 1.5)
    of = lambda cut: sorted((r.dataset, r.t, r.size, round(r.mass, 6)) for r in basins.basins(cut, 0.5).collect())
    assert of(patches.blocks(stored, halo=1)) == of(drawn) != []
    assert "voxels" not in basins.basins(drawn, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    judged = [basins.referee(voxels.mapped(f, lambda a: voxels.pooled(a, 2)), f, 0.4, 4, (1, 2)) for f in (stored, drawn)]
    want, got = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in j.collect()) for j in judged)
    assert got == want and len(got) == 4


def test_appearance_measured_where_frames_are_drawn_equals_that_of_boxes(spark):
    rng = np.random.default_rng(8)
    rows = [("a", 100 * t + i, t, int(z), int(y), int(x)) for t in range(2) for i, (z, y, x) in enumerate(rng.integers((-3, -1, -1), (8, 40, 40), (12, 3)))]
    rows += [("a", 500, 2, 3, 20, 20), ("a", 501, 2, 0, 0, 37)]
    p = spark.createDataFrame(rows, "dataset string, node_id long, t int, z int, y int, x int")
    drawn, half = voxels.Drawn(p, (6, 38, 38), 0.6), (1, 4, 4)
    want = {r.node_id: r for r in patches.appearance(patches.drawn_boxes(drawn, half), half, 1.8, 2.0).collect()}
    out = patches.drawn_appearance(drawn, half, 1.8, 2.0)
    got = {r.node_id: r for r in out.collect()}
    assert got.keys() == want.keys() and len(got) == 20 < len(rows)
    for k, r in got.items():
        assert [r[c] for c in patches.FEATURES] == pytest.approx([want[k][c] for c in patches.FEATURES], rel=1e-6, abs=1e-7), k
    assert "box" not in out._jdf.queryExecution().optimizedPlan().toString()


def drawn_scene(spark, seed=8):
    """Points of three blocks of frames, some of them outside of the frame or at its edge, and a frame that is missing."""
    rng = np.random.default_rng(seed)
    times = [0, 1, 2, 15, 16, 17, 31, 32]
    rows = [(d, 1000 * n + 100 * i + j, t, int(z), int(y), int(x)) for n, d in enumerate("ab") for i, t in enumerate(times) for j, (z, y, x) in enumerate(rng.integers((-3, -1, -1), (8, 40, 40), (12, 3)))]
    p = spark.createDataFrame(rows, "dataset string, node_id long, t int, z int, y int, x int")
    return p, voxels.Drawn(p, (6, 38, 38), 0.6)


def sent(df):
    """Whether anything like a box or a frame is a column of the plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(w in plan for w in ("voxels", "box#", "Generate explode(_part"))


def test_middles_and_rolled_middles_are_read_where_frames_are_drawn(spark):
    _, drawn = drawn_scene(spark)
    drawn, half = voxels.mapped(drawn, lambda a: a[:, ::-1, ::-1]), (1, 4, 4)
    box = patches.drawn_boxes(drawn, half)
    plain, turned = ({(r.dataset, r.node_id): r.voxels[121] for r in patches.raw_boxes(box, half, align).collect()} for align in (False, True))
    out = patches.drawn_middles(drawn, half)
    assert {(r.dataset, r.node_id): (r.before, r.after) for r in out.collect()} == {k: (v, turned[k]) for k, v in plain.items()} and len(plain) > 20
    assert any(v != turned[k] for k, v in plain.items()) and not sent(out) and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    v = np.random.default_rng(2).random((20, 243)).round(1).astype(np.float32)
    want = [np.roll(a, tuple(np.array(half) - np.array(np.unravel_index(int(np.argmax(a)), a.shape))), axis=(0, 1, 2)).ravel() for a in v.reshape(-1, 3, 9, 9)]
    assert (patches.rolled(v, half) == np.stack(want)).all()


def test_eigenvalues_measured_where_frames_are_drawn_equal_those_of_boxes(spark):
    _, drawn = drawn_scene(spark, 9)
    half = (1, 4, 4)
    moments = patches.second_moments(patches.drawn_boxes(drawn, half), half, 1.8, 2.0).filter("zz is not null")
    want = {(r.dataset, r.node_id): r.e for r in moments.select("dataset", "node_id", patches.eigenvalues(*[F.col(c) for c in ("zz", "yy", "xx", "zy", "zx", "yx")]).alias("e")).collect()}
    out = patches.drawn_eigenvalues(drawn, half, 1.8, 2.0)
    got = {(r.dataset, r.node_id): (r.largest, r.middle, r.least) for r in out.collect()}
    assert got.keys() == want.keys() and len(got) > 60 and not sent(out)
    for k, v in got.items():
        assert v == pytest.approx(tuple(want[k]), rel=1e-6, abs=1e-9), k


def test_correlations_taken_where_frames_are_drawn_equal_those_of_boxes(spark):
    p, drawn = drawn_scene(spark, 10)
    half = (1, 4, 4)
    a, b = (p.select("dataset", F.col("t").alias(t), F.col("node_id").alias(k)) for t, k in (("t", "source_id"), ("_t", "target_id")))
    pairs = a.join(b, "dataset").filter("_t = t + 1").drop("_t")
    stray = spark.createDataFrame([("a", 0, 0, 99999), ("c", 0, 0, 100), ("a", 5, 0, 100)], "dataset string, t int, source_id long, target_id long")
    want = {tuple(r)[:3]: r.ncc for r in patches.alike(pairs.select("dataset", "source_id", "target_id"), patches.raw_boxes(patches.drawn_boxes(drawn, half), half)).collect()}
    out = patches.drawn_alike(pairs.unionByName(stray), drawn, half)
    got = {tuple(r)[:3]: r.ncc for r in out.collect()}
    assert got.keys() == want.keys() and {k for k in got if k[0] == "a" and k[1] // 100 in (3, 6)}, "pairs over the borders of blocks too"
    assert all(v == pytest.approx(want[k], abs=1e-12) for k, v in got.items())
    assert not sent(out)


def test_percentiles_hold_mothers_and_their_run_up_against_all_controls(spark):
    # 1 -> 2 -> 3 -> (4, 5), and 10 -> 11 -> 12 -> 13 -> 14, of which 2 isn't detected; ids of detections are 100 higher
    te = spark.createDataFrame([("a", s, t, t) for s, t in ((1, 2), (2, 3), (3, 4), (3, 5), *((i, i + 1) for i in range(10, 14)))], "dataset string, source_id long, target_id long, edge_seq long")
    seen = [1, 3, 4, 5, *range(10, 15)]
    match = spark.createDataFrame([("a", 100 + i, i) for i in seen] + [("a", 150, None)], "dataset string, pred_id long, gt_id long")
    nodes = spark.createDataFrame([("a", 100 + i) for i in [*seen, 50]], "dataset string, node_id long")
    links = spark.createDataFrame([("a", s, t) for s, t in ((101, 103), (103, 104), (103, 105), (110, 111), (111, 112), (112, 113), (113, 114), (114, 150))], "dataset string, source_id long, target_id long")
    proposed = spark.createDataFrame([("a", 112), ("a", 103)], "dataset string, parent_id long")
    mothers, controls = patches.division_populations(nodes, links, te, match, proposed)
    assert sorted(tuple(r) for r in mothers.collect()) == [("a", 101, 3, 2), ("a", 103, 3, 0)]
    held = {c: {r.node_id for r in controls.collect() if r[c]} for c in ("candidate", "linked", "annotated")}
    assert held == {"candidate": {112}, "linked": {111, 113, 114}, "annotated": {104, 105, 110, 111, 112, 113, 114}}
    look = controls.select("*", *[(F.col("node_id") % 7 + i + F.col("node_id") * 1e-13).alias(k) for i, k in enumerate(patches.FEATURES)])
    rows = patches.placed_among(look, mothers, tuple(held)).collect()
    assert len(rows) == 2 * 3 * 7 and {(r.node_id, r.lag) for r in rows} == {(101, 2), (103, 0)}
    for r in rows:
        others = np.array([n % 7 for n in held[r.control]])
        own = r.node_id % 7
        want = 100 * (np.mean(others < own) + 0.5 * np.mean(others == own))
        assert r.percentile == pytest.approx(want) and r.separates == (want >= 90 or want <= 10)


def test_the_referee_draws_frames_three_times(spark, monkeypatch):
    p = spark.createDataFrame([("a", t, 3, 4 + 9 * i, 30 - 8 * i) for t in (0, 20) for i in range(4)], "dataset string, t int, z int, y int, x int")
    fine, seen, grouped = voxels.Drawn(p, (8, 40, 40), 1.5), [], voxels.grouped
    monkeypatch.setattr(voxels, "grouped", lambda *a, **k: (seen.append(1), grouped(*a, **k))[1])
    rows = basins.referee(voxels.mapped(fine, lambda a: voxels.pooled(a, 2)), fine, 0.4, 4, (1, 2)).collect()
    assert len(seen) == 3 and {(r.grid, r.n_basins, r.peaks_native) for r in rows} == {("coarse", 8, 8), ("fine", 8, 8)}


def test_pieces_of_pairs_and_orders_of_floats():
    rng = np.random.default_rng(3)
    a = rng.random((5, 9, 8)) > 0.55
    label = basins.labelled(a)
    assert (label[a] > 0).all() and (label[~a] == 0).all()
    flat = np.arange(a.size).reshape(a.shape)
    want = {min(flat[q] for q in piece) + 1: set(piece) for piece in flood(a)}
    assert {k: set(map(tuple, np.argwhere(label == k).tolist())) for k in np.unique(label[a])} == want
    v = np.sort(np.array([-np.inf, -2.5, -1e-40, 0.0, 1e-40, 1.0, 3e38, np.inf], np.float32))
    assert (np.diff(basins._ordered(v.view(np.uint32)).astype(np.int64)) > 0).all()


@pytest.mark.parametrize("sigma", [(1.0, 1.5, 1.5), (0.0, 2.0, 1.0)])
def test_peaks_of_blobs_equal_those_of_the_whole_response(sigma):
    rng = np.random.default_rng(11)
    frames = [voxels.spots(rng.integers((-2, 0, 0), (12, 40, 44), (n, 3)).astype(float), (10, 40, 44), 1.2) for n in (1, 12, 60)]
    frames += [(rng.random((6, 21, 23)) * 3).round().astype(np.float32), np.zeros((4, 12, 12), np.float32), np.ones((4, 12, 12), np.float32) * 7]
    flat = np.zeros((5, 24, 24), np.float32)
    flat[2, 5:9, 5:9], flat[:, 15:19] = 1, 2  # plateaus and mirrored tops
    n = 0
    for a in [*frames, flat, -flat]:
        want = voxels.peaks_of(voxels.dog(a, sigma).astype(np.float32), (1, 2, 2), 0.05)
        assert voxels.dog_peaks_of(a, sigma, (1, 2, 2), 0.05) == want
        n += len(want)
    assert n > 60


def test_blobs_are_smoothed_in_full_nowhere(monkeypatch):
    a = voxels.spots(np.array([[3.0, 10, 10], [5, 30, 12]]), (10, 40, 44), 1.2)
    want = voxels.peaks_of(voxels.dog(a, (1.0, 1.5, 1.5)).astype(np.float32), (1, 2, 2), 0.05)
    asked, near = [], voxels._gaussian_at
    monkeypatch.setattr(voxels, "gaussian", None)
    monkeypatch.setattr(voxels, "_gaussian_at", lambda a, s, at: (asked.append(len(at[0])), near(a, s, at))[1])
    assert voxels.dog_peaks_of(a, (1.0, 1.5, 1.5), (1, 2, 2), 0.05) == want and len(want) == 2 and max(asked) < 20


def test_spots_on_whole_places_are_one_spot_moved():
    rng = np.random.default_rng(1)
    p = rng.integers((-12, -12, -12), (20, 40, 40), (30, 3)).astype(float)
    z, y, x = (np.exp(-((np.arange(n) - p[:, i, None]) ** 2) / (2 * 1.5 * 1.5)) for i, n in enumerate((9, 30, 31)))
    near = [np.abs(np.arange(n) - p[:, i, None]) <= 9 for i, n in enumerate((9, 30, 31))]
    every = (z[:, :, None, None] * y[:, None, :, None] * x[:, None, None, :]) * (near[0][:, :, None, None] & near[1][:, None, :, None] & near[2][:, None, None, :])
    assert (voxels.spots(p, (9, 30, 31), 1.5) == every.astype(np.float32).max(axis=0)).all()
    a = rng.random((3, 9, 8)).astype(np.float32)
    assert (voxels.pooled(a, 2) == a[:, :8].reshape(3, 4, 2, 4, 2).mean(axis=(2, 4))).all()
