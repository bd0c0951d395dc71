"""Second daughters by affinity against a plain pass over proposals, for every candidacy, gate and ranking."""

import numpy as np
import pytest

from tracelace.operators import forks, sisters

GATES = (6.0, 9.0, 7.0)


def made(seed):
    rng = np.random.default_rng(seed)
    points, edges, p = {}, [], {}
    for t in range(5):
        for i in range(14):
            points[t * 100 + i] = (t, *map(float, rng.integers(0, 12, 3)))
    for t in range(4):
        now, nxt = ([n for n in points if n // 100 == x] for x in (t, t + 1))
        for b in nxt:
            if rng.random() < 0.6:
                edges.append((int(rng.choice(now)), b))
        for a in now:
            for b in nxt:
                if rng.random() < 0.8:
                    p[a, b] = float(rng.integers(0, 12)) / 12 + ((a, b) in edges and rng.random() < 0.7)
    return points, edges, p


def plain(points, edges, p, candidacy, floors, margin, mutual, divergence, cap, cost_of):
    down, up = {n: [] for n in points}, {n: [] for n in points}
    for a, b in edges:
        down[a].append(b)
        up[b].append(a)
    far = lambda a, b: float(np.linalg.norm(np.subtract(points[a][1:], points[b][1:])))
    ahead = lambda n: 1 + max(map(ahead, down[n]), default=0)
    out = []
    for a in points:
        if len(down[a]) != 1:
            continue
        kept, nxt = down[a][0], sorted(n for n in points if points[n][0] == points[a][0] + 1)
        orphans = [n for n in nxt if not up[n]]
        scored = sorted((n for n in nxt if (a, n) in p), key=lambda n: (-p[a, n], n))
        if candidacy == "geometric":
            offered = [(n, None) for n in orphans]
        elif candidacy == "runner_up":
            ok = len(scored) > 1 and scored[0] == kept and p[a, kept] >= floors[0] and p[a, scored[1]] >= floors[1] and not up[scored[1]]
            offered = [(scored[1], None)] if ok else []
        else:
            offered = [(n, up[n][0]) for n in scored if up[n] and n != kept and up[n][0] != a and p[a, n] - p.get((up[n][0], n), 0.0) > margin]
        for n, taken in offered:
            if far(a, n) > GATES[0] or far(kept, n) > GATES[1] or far(a, kept) > GATES[2]:
                continue
            if mutual:
                pool = [*orphans, kept]
                close = lambda x: min((y for y in pool if y != x), key=lambda y: far(x, y), default=None)  # noqa: B023, E731
                if close(kept) != n or close(n) != kept:
                    continue
            grown = far(min(down[kept]), min(down[n])) - far(kept, n) if down[kept] and down[n] else None
            if divergence is not None and (grown is None or grown < divergence):
                continue
            out.append((cost_of(p.get((a, n), 0.0), far(a, n), far(kept, n), grown, ahead(n)), a, n, taken))
    seen, got = set(), []
    for _, a, n, taken in sorted(out, key=lambda x: x[:3]):
        if len(got) < cap and n not in seen:
            seen.add(n)
            got.append((a, n, taken))
    return got


RANKINGS = {
    "probability": (lambda: -sisters.F.col("p"), lambda p, dp, ds, g, f: -p),
    "geometry": (lambda: forks.geometry(0.15), lambda p, dp, ds, g, f: dp + 0.15 * ds),
    "surviving": (lambda: forks.surviving(forks.geometry(0.15), 6), lambda p, dp, ds, g, f: dp + 0.15 * ds + (6 - min(f, 6)) / 5),
    "diverging": (lambda: forks.diverging(forks.geometry(0.15)), lambda p, dp, ds, g, f: dp + 0.15 * ds + (1.0 if g is None else 1 - max(0.0, g / max(ds, ds + g) if max(ds, ds + g) else 0.0))),
}


@pytest.mark.parametrize(
    ("candidacy", "ranking", "mutual", "divergence", "cap"),
    [("runner_up", "probability", False, None, 50), ("geometric", "geometry", False, None, 5), ("geometric", "surviving", True, None, 50), ("geometric", "diverging", False, 0.5, 50), ("steal", "probability", False, None, 8), ("steal", "diverging", False, -2.0, 50), ("steal", "geometry", True, None, 50)],
)
def test_forks_equal_a_plain_pass(spark, candidacy, ranking, mutual, divergence, cap):
    total = 0
    sets = {f"d{s}": made(s) for s in range(6)}
    n = spark.createDataFrame([(d, i, int(x[0]), *x[1:]) for d, (pts, _, _) in sets.items() for i, x in pts.items()], "dataset string, node_id long, t int, uz double, uy double, ux double")
    e = spark.createDataFrame([(d, a, b, i) for d, (_, es, _) in sets.items() for i, (a, b) in enumerate(es)], "dataset string, source_id long, target_id long, edge_seq long")
    a = spark.createDataFrame([(d, s, t, v) for d, (_, _, p) in sets.items() for (s, t), v in p.items()], "dataset string, source_id long, target_id long, p double")
    column, cost_of = RANKINGS[ranking]
    found = sisters.proposals(n, e, a, candidacy, *GATES, 0.2, 0.1, 0.1, mutual, divergence)
    taken = sisters.admitted(found, column(), sisters.budget(n, e, most=cap))
    rows = taken.select("dataset", "parent_id", "child_id", "taken_from", "rank").collect()
    new = {(r.dataset, r.source_id, r.target_id) for r in sisters.edited(e, taken).collect()}
    for d, (pts, es, p) in sets.items():
        want = plain(pts, es, p, candidacy, (0.2, 0.1), 0.1, mutual, divergence, cap, cost_of)
        assert [(r.parent_id, r.child_id, r.taken_from) for r in sorted((r for r in rows if r.dataset == d), key=lambda r: r.rank)] == want
        gone = {(t, c) for _, c, t in want if t is not None}
        assert {x[1:] for x in new if x[0] == d} == {x for x in es if x not in gone} | {(x, c) for x, c, _ in want}
        total += len(want)
    assert total or (candidacy == "steal" and mutual)


def test_budget_is_a_rate_or_given_and_no_more_than_a_share_of_edges(spark):
    n = spark.range(2000).selectExpr("'a' as dataset", "id as node_id").unionByName(spark.range(3).selectExpr("'b' as dataset", "id as node_id"))
    e = spark.range(400).selectExpr("'a' as dataset", "id as source_id")
    caps = lambda *a: {r.dataset: r.cap for r in sisters.budget(n, e, *a).collect()}
    assert caps() == {"a": 2, "b": 0} and caps(7) == {"a": 7, "b": 7} and caps(7, 0.00375) == {"a": 2, "b": 0}
