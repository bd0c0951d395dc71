"""Losses in blocks of frames against plain versions, with frames on either side of a block's border and nulls."""

import math

import numpy as np
import pytest

from tracelace.operators import losses


def test_contrastive_equals_plain_and_writes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    points = [("a", 100 * t + i, t, [float(x) for x in rng.normal(size=3)]) for t in range(-3, 36) for i in range(4)]
    points[5] = (*points[5][:3], None)
    points[9] = (*points[9][:3], [0.0, 0.0, 0.0])
    points[14] = (*points[14][:3], [1.0, None, 2.0])
    e = {p[1]: np.array(p[3]) / max(math.sqrt(sum(x * x for x in p[3])), 1e-12) for p in points if p[3] and None not in p[3]}
    t = {p[1]: p[2] for p in points}
    true = [("a", 100 * k + i, 100 * (k + 1) + i) for k in range(-3, 35) for i in range(3)] + [("a", 0, 102), ("a", 0, 102), ("a", 300, 500), ("a", 700, 9_999)]
    decoys = [("a", t[s], s, s + 101) for _, s, _ in true[::5]] + [("a", 4, 403, 502)]
    s = {(a, b): float(e[a] @ e[b]) / 0.1 for a in e for b in e if t[b] == t[a] + 1}
    log = {(a, b): x - math.log(sum(math.exp(s[a, c]) for c in e if t[c] == t[a] + 1)) for (a, b), x in s.items()}
    own = {}
    for _, a, b in set(true):
        if (a, b) in s:
            own.setdefault(a, []).append(b)
    nce = [np.mean([-log[a, b] for b in kids]) for a, kids in own.items()]
    soft = [math.log1p(math.exp(s[a, b] - max(s[a, c] for c in own[a]))) for _, _, a, b in decoys if (a, b) in s and a in own]
    p = spark.createDataFrame(points, "dataset string, node_id long, t int, e array<double>")
    y = spark.createDataFrame(true, "dataset string, source_id long, target_id long")
    d = spark.createDataFrame(decoys, "dataset string, t int, source_id long, target_id long")
    got = losses.contrastive(p, y, d, 0.1).collect()
    assert [tuple(r)[:2] for r in got] == [("a", len(nce))]
    assert (got[0].nce, got[0].margin) == (pytest.approx(np.mean(nce)), pytest.approx(np.mean(soft)))
    assert losses.info_nce(p, y, 0.1).first().loss == pytest.approx(np.mean(nce))


def test_offset_targets_equal_plain_and_shuffle_points_only(spark):
    rng = np.random.default_rng(3)
    points = [("a", int(i), int(t), *map(int, rng.integers(0, (3, 6, 6)))) for i, t in zip(rng.permutation(60), rng.integers(-2, 20, 60), strict=True)]
    want = {}
    for _, i, t, *at in points:
        for o in np.ndindex(3, 5, 5):
            o = np.array(o) - (1, 2, 2)
            um = [float(v) for v in o * np.array((1.6, 0.4, 0.4))]
            v = tuple(int(x) for x in o + at)
            if all(0 <= c < m for c, m in zip(v, (3, 6, 6), strict=True)):
                best = (math.sqrt(um[0] * um[0] + um[1] * um[1] + um[2] * um[2]), i, *[-u for u in um])
                want[t, *v] = min(want.get((t, *v), best), best)
    df = losses.offset_targets(spark.createDataFrame(points, "dataset string, node_id long, t int, z int, y int, x int"), (1, 2, 2), (3, 6, 6), (1.6, 0.4, 0.4))
    got = {(r.t, r.z, r.y, r.x): (r.oz, r.oy, r.ox) for r in df.collect()}
    assert got == {v: m[2:] for v, m in want.items()}
    assert len(df.collect()) == len(want)
    assert "explode" not in df._jdf.queryExecution().executedPlan().toString()
