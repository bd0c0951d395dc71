"""Admission, gap closing, cytokinesis and the output chain against plain versions on small inputs."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_plain import SCALE, assigned
from tests.test_stages import graph
from tracelace.operators import joins, recovery
from tracelace.operators.admission import admit


@pytest.mark.parametrize(("seed", "rooms"), [(1, (1, 1)), (2, (1, 2)), (3, (2, 3))])
def test_rounds_admit_what_a_pass_admits(spark, seed, rooms):
    rng = np.random.default_rng(seed)
    rows = [(int(a), int(b), int(c), int(f)) for a, b, c, f in zip(rng.integers(0, 25, 300), rng.integers(0, 25, 300), rng.integers(0, 40, 300), rng.integers(0, 6, 300), strict=True)]
    rows += [(100 + i, 101 + i, i, 9) for i in range(12)]  # a chain in order: one round each at worst
    rows = list(dict.fromkeys(rows))
    caps = {f: 4 + f for f in range(10)}
    left = defaultdict(int)
    want = []
    for a, b, c, f in sorted(rows, key=lambda r: (r[2], r[0], r[1], r[3])):
        if left["a", a] < rooms[0] and left["b", b] < rooms[1] and left["f", f] < caps[f]:
            for key in (("a", a), ("b", b), ("f", f)):
                left[key] += 1
            want.append((a, b, c, f))
    df = spark.createDataFrame([(*r, caps[r[3]]) for r in rows], "a long, b long, c long, f long, cap int")
    got = admit(df, ["c", "a", "b", "f"], [(("a",), rooms[0]), (("b",), rooms[1]), (("f",), F.col("cap"))])
    assert sorted((r.a, r.b, r.c, r.f) for r in got.collect()) == sorted(want)


def test_no_proposals_admit_nothing(spark):
    assert admit(spark.createDataFrame([], "a long, c long"), ["c"], [(("a",), 1)]).count() == 0


def scene(seed, frames=8, cells=9, drop=0.25, extent=60):
    """Cells that drift, some of whose points or links are missing."""
    rng = np.random.default_rng(seed)
    at = np.column_stack([rng.integers(0, 6, cells), rng.integers(0, extent, cells), rng.integers(0, extent, cells)]).astype(float)
    move = rng.integers(-4, 5, (cells, 3)) * np.array([0, 1, 1])
    nodes, edges, last, i = [], [], {}, 1
    for t in range(frames):
        at = at + move + rng.integers(-1, 2, (cells, 3)) * np.array([0, 1, 1])
        for c in range(cells):
            if rng.random() < drop:
                continue
            nodes.append((i, t, *[max(0, int(v)) for v in at[c]]))
            if c in last and last[c][1] == t - 1 and rng.random() > 0.15:
                edges.append((last[c][0], i))
            last[c] = (i, t)
            i += 1
    return nodes, edges


def um(node):
    return np.array(node[2:5], float) * SCALE


def ends_starts(nodes, edges):
    out, into = {s for s, _ in edges}, {e for _, e in edges}
    return [n for n in nodes if n[0] not in out], [n for n in nodes if n[0] not in into], out | into


def plain_spacing(nodes, k, alone):
    out = {}
    for n in nodes:
        ds = sorted(float(np.linalg.norm(um(n) - um(m))) for m in nodes if m[1] == n[1] and m[0] != n[0])[:k]
        out[n[0]] = float(np.median(ds)) if ds else alone
    return out


def even(x):
    return round(x)


def plain_close(nodes, edges, knobs):
    ends, starts, touched = ends_starts(nodes, edges)
    local = plain_spacing(nodes, knobs.neighbours, knobs.reference)
    by_id = {n[0]: n for n in nodes}
    top = max(by_id)
    cap = min(knobs.most_added, max(1, even(len(nodes) * knobs.most_share)))
    new_nodes, new_edges, used, counts = [], [], set(), defaultdict(int)
    for t in sorted({n[1] for n in nodes}):
        es, ss = sorted(n for n in ends if n[1] == t), sorted(n for n in starts if n[1] == t + 2)
        if not es or not ss:
            continue
        d = np.array([[np.linalg.norm(um(a) - um(b)) for b in ss] for a in es])
        step = np.array([[np.clip(knobs.gain * (0.5 * (local[a[0]] + local[b[0]]) - knobs.reference), -knobs.most_delta, knobs.most_delta) for b in ss] for a in es])
        ok, base = d <= 2 * knobs.base + 2 * step, d <= 2 * knobs.base
        counts["gap_candidates"] += int(ok.sum())
        counts["gap_expanded"] += int((ok & ~base).sum())
        counts["gap_restricted"] += int((base & ~ok).sum())
        for i, j in sorted(assigned(d, ok)):
            a, b = es[i], ss[j]
            middle = [(x + y) / 2 for x, y in zip(a[2:], b[2:], strict=True)]
            free = sorted((float(np.linalg.norm(np.array(middle) * SCALE - um(n))), n[0]) for n in nodes if n[1] == t + 1 and n[0] not in touched and n[0] not in used)
            if free and free[0][0] <= knobs.reuse:
                via = free[0][1]
                used.add(via)
                counts["gap_reused"] += 1
            elif counts["gap_added_nodes"] < cap:
                counts["gap_added_nodes"] += 1
                via = top + counts["gap_added_nodes"]
                new_nodes.append((via, t + 1, *[int(np.rint(v)) for v in middle]))
            else:
                continue
            counts["gap_selected"] += 1
            counts["gap_selected_outside_base"] += int(not base[i, j])
            new_edges += [(a[0], via), (via, b[0])]
    return new_nodes, new_edges, {k: v for k, v in counts.items() if v}


def plain_strict(nodes, edges, knobs):
    ends, starts, _ = ends_starts(nodes, edges)
    parents, children = defaultdict(list), defaultdict(list)
    for s, e in edges:
        parents[e].append(s)
        children[s].append(e)
    by_id = {n[0]: n for n in nodes}
    proposals = []
    for a in ends:
        for b in starts:
            d = float(np.linalg.norm(um(b) - um(a)))
            if b[1] != a[1] + 3 or d > knobs.most_total or d / 3 > knobs.most_step:
                continue
            step = (um(b) - um(a)) / 3
            ok, penalty = False, 0.0
            moves = [um(a) - um(by_id[p]) for p in parents[a[0]] if len(parents[a[0]]) == 1] + [um(by_id[c]) - um(b) for c in children[b[0]] if len(children[b[0]]) == 1]
            for move in moves:
                x, y = np.linalg.norm(move), np.linalg.norm(step)
                if x <= 0.01 or y <= 0.01:
                    ok = True
                    continue
                cosine = float(np.dot(move, step) / (x * y + 1e-9))
                ok = ok or (cosine > knobs.least_cosine and np.linalg.norm(move - step) <= knobs.most_change)
                penalty += max(0.0, 0.25 - cosine)
            if ok:
                proposals.append((d + 2 * penalty, a[1], a[0], b[0]))
    cap = min(knobs.most_links, max(1, even(len(edges) * knobs.most_share)))
    used, frames, got = set(), defaultdict(int), []
    for p in sorted(proposals):
        _, t, a, b = p
        if len(got) >= cap:
            break
        if ("a", a) in used or ("b", b) in used or frames[t] >= max(1, even(sum(n[1] == t for n in ends) * knobs.frame_share)):
            continue
        got.append(p)
        used |= {("a", a), ("b", b)}
        frames[t] += 1
    return proposals, got


@pytest.mark.parametrize("seed", [1, 4, 6])
def test_gap_closing_equals_a_plain_version(spark, seed):
    nodes, edges = scene(seed, cells=12)
    knobs = recovery.GapClose(base=2.0, gain=0.3, most_delta=0.8, most_share=0.08)
    n, e = graph(spark, nodes, edges)
    done = recovery.close_gaps(n, e, knobs)
    want_nodes, want_edges, counts = plain_close(nodes, edges, knobs)
    got_nodes = {(r.node_id, r.t, r.z, r.y, r.x) for r in done.nodes.collect()}
    assert got_nodes - set(nodes) == set(want_nodes) and set(nodes) <= got_nodes
    assert sorted((r.source_id, r.target_id) for r in done.edges.collect()) == sorted(edges + want_edges)
    assert {r.counter: r.n for r in done.counters().collect()} == counts and want_edges


def test_a_long_bridge_needs_a_centre(spark):
    nodes, edges = graph(spark, [(1, 0, 1, 10, 10), (2, 1, 1, 10, 10), (3, 3, 1, 34, 10), (4, 4, 1, 34, 10)], [(1, 2), (3, 4)])
    far = spark.createDataFrame([("a", 2, 1.625, 100.0, 4.0)], "dataset string, t int, uz double, uy double, ux double")
    close = spark.createDataFrame([("a", 2, 1.625, 22 * 0.40625, 4.0)], far.schema)
    made = lambda c: recovery.close_gaps(nodes, edges, recovery.GapClose(), c).edges.count()
    assert (made(None), made(far), made(close)) == (4, 2, 4)


@pytest.mark.parametrize("seed", [2, 3, 8])
def test_strict_gaps_equal_a_plain_version(spark, seed):
    nodes, edges = scene(seed, frames=10, cells=14, drop=0.4)
    knobs = recovery.StrictGap(most_total=14.0, most_step=6.0, most_share=0.2, frame_share=0.3)
    n, e = graph(spark, nodes, edges)
    proposals, got = plain_strict(nodes, edges, knobs)
    found = recovery.strict_proposals(n, e, knobs)
    assert sorted((round(r.score, 9), r.t, r.end_id, r.start_id) for r in found.collect()) == sorted((round(s, 9), *r) for s, *r in proposals)
    done = recovery.strict_gaps(n, e, knobs)
    top = max(x[0] for x in nodes)
    want = [pair for k, (_, _, a, b) in enumerate(got) for pair in ((a, top + 2 * k + 1), (top + 2 * k + 1, top + 2 * k + 2), (top + 2 * k + 2, b))]
    assert sorted((r.source_id, r.target_id) for r in done.edges.collect()) == sorted(edges + want) and got
    t = {r.node_id: r.t for r in done.nodes.collect()}
    assert all(t[b] == t[a] + 1 for a, b in want)


def test_k_nearest_widens_until_found(spark):
    nodes, _ = scene(5, frames=3, cells=7, extent=400)
    n, _ = graph(spark, nodes, [])
    got = {(r.node_id, r.rank): (r.other_id, round(r.d, 9)) for r in joins.k_nearest(n, 3, start=2.0).collect()}
    want = {}
    for a in nodes:
        near = sorted((float(np.linalg.norm(um(a) - um(b))), b[0]) for b in nodes if b[1] == a[1] and b[0] != a[0])[:3]
        want |= {(a[0], i + 1): (b, round(d, 9)) for i, (d, b) in enumerate(near)}
    assert got == want


def plain_cytokinesis(nodes, edges, k):
    by_id = {n[0]: n for n in nodes}
    children, into = defaultdict(list), {e for _, e in edges}
    for s, e in edges:
        children[s].append(e)
    dist = lambda a, b: float(np.linalg.norm(um(by_id[a]) - um(by_id[b])))

    def length(i):
        n = 1
        while len(children[i]) == 1:
            i, n = children[i][0], n + 1
        return n

    out = []
    for s in (n[0] for n in nodes if len(children[n[0]]) == 1):
        c1 = children[s][0]
        orphans = [n[0] for n in nodes if n[1] == by_id[s][1] + 1 and n[0] not in into and n[0] != c1]
        if not orphans or by_id[c1][1] != by_id[s][1] + 1:
            continue
        sister, c2 = min((dist(c1, o), o) for o in orphans)
        if max(dist(s, c1), dist(s, c2)) > k.parent_gate or not k.least_sister <= sister <= k.most_sister:
            continue
        if any(not k.border[0] <= v <= k.border[1] for i in (s, c1, c2) for v in by_id[i][3:5]):
            continue
        if min(length(c1), length(c2)) < k.least_track or len(children[c1]) != 1 or len(children[c2]) != 1:
            continue
        if dist(children[c1][0], children[c2][0]) - sister < k.least_divergence:
            continue
        a, b = um(by_id[c1]) - um(by_id[s]), um(by_id[c2]) - um(by_id[s])
        cosine = float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-6))
        if math.degrees(math.acos(max(-1.0, min(1.0, cosine)))) >= k.least_angle:
            out.append((s, c2))
    return sorted(out)


def test_cytokinesis_equals_a_plain_version(spark):
    nodes, edges, i = [], [], 1
    for cell in range(12):  # parents whose two daughters part along y; one daughter's first link is missing
        y, x = 60 + 3 * cell, 40 + 90 * (cell % 3) + 7 * cell
        nodes.append((i, 0, 2, y, x))
        parent, rows = i, []
        i += 1
        for side in (-1, 1):
            before = parent
            for t in range(1, 5 + cell % 3):
                nodes.append((i, t, 2, y + side * (10 + t + (cell % 4) * (t > 1)), x + (side + 1) * (cell % 5)))
                if t > 1 or side < 0:
                    edges.append((before, i))
                before = i
                i += 1
    knobs = recovery.Cytokinesis(least_track=5, border=(0.0, 10_000.0), least_angle=120.0)
    n, e = graph(spark, nodes, edges)
    got = sorted((r.source_id, r.target_id) for r in recovery.cytokinesis(n, e, knobs).collect())
    assert got == plain_cytokinesis(nodes, edges, knobs) and 0 < len(got) < 12
    assert recovery.cytokinesis(n, e, recovery.Cytokinesis(least_nodes=10_000)).count() == 0


def test_fork_geometry_keeps_good_pairs(spark):
    nodes, edges = graph(spark, [(1, 0, 1, 50, 50), (2, 1, 1, 55, 50), (3, 1, 1, 45, 50), (4, 1, 1, 50, 70), (5, 0, 1, 90, 90), (6, 1, 1, 90, 95), (7, 1, 1, 90, 60), (8, 0, 1, 5, 5), (9, 1, 1, 5, 6)], [(1, 2), (1, 3), (1, 4), (5, 6), (5, 7), (8, 9)])
    e = edges.withColumn("p", F.when(F.col("target_id") == 3, 0.9))
    cut = lambda *a: sorted((r.source_id, r.target_id) for r in recovery.fork_geometry(nodes, e, *a).collect())
    assert cut(10.5, 8.0) == [(1, 2), (1, 3), (5, 6), (8, 9)]
    assert cut(10.5, 1.0) == [(1, 3), (5, 6), (8, 9)]
    assert len(cut(10.5, 1.0, True)) == 6


def test_the_chain_counts_what_it_does(spark):
    nodes, edges = scene(9, frames=12, cells=8, drop=0.1)
    nodes = nodes + [(900, 5, 0, 300, 300)]
    extra = [(nodes[0][0], nodes[30][0]), (nodes[2][0], [n for n in nodes if n[1] == 1][0][0])]
    n, e = graph(spark, nodes, edges + extra)
    done = recovery.output_filter(n, e, recovery.OutputFilter(gaps=recovery.GapClose(base=4.0), strict=recovery.StrictGap(), fork=(10.5, 8.0), safe=(10.0, 14.0, 14.0, -5.0, 1.0, 1.0)))
    counts = {r.counter: r.n for r in done.counters().collect()}
    by_id = {x[0]: x for x in nodes}
    assert counts["dropped_nonconsecutive"] == sum(by_id[b][1] != by_id[a][1] + 1 for a, b in edges + extra)
    assert counts["gap_selected"] == counts["gap_added_nodes"] + counts.get("gap_reused", 0) and counts["pruned_isolated"] >= 1
    out_nodes, out_edges = done.nodes.collect(), done.edges.collect()
    ids = {r.node_id for r in out_nodes}
    assert 900 not in ids and all(r.source_id in ids and r.target_id in ids for r in out_edges)
    assert len({r.target_id for r in out_edges}) == len(out_edges)
    size = defaultdict(int)
    label = {i: i for i in ids}
    for _ in range(40):
        for r in out_edges:
            label[r.source_id] = label[r.target_id] = min(label[r.source_id], label[r.target_id])
    for i in ids:
        size[label[i]] += 1
    forks = {label[r.source_id] for r in out_edges if sum(x.source_id == r.source_id for x in out_edges) > 1}
    assert all(n >= 6 or c in forks for c, n in size.items())


def test_bridges_by_rounds_equal_bridges_by_a_pass(spark):
    from tracelace.operators import stages

    rng = np.random.default_rng(11)
    rows = [("a", 1, int(e), int(s), float(c)) for e, s, c in zip(rng.integers(0, 20, 80), rng.integers(0, 20, 80), rng.integers(0, 9, 80), strict=True)]
    df = spark.createDataFrame(list(dict.fromkeys(rows)), "dataset string, missing int, end_id long, start_id long, cost double")
    cap = spark.createDataFrame([("a", 7)], "dataset string, cap int")
    one, many = (sorted(map(tuple, stages.accept_tightest(df, cap, gap).select("end_id", "start_id", "cost", "rank").collect())) for gap in (1, 2))
    assert one == many and len(one) == 7


def test_a_merge_by_rounds_equals_a_merge_by_a_pass(spark):
    from tracelace.operators import stages

    rng = np.random.default_rng(12)
    pairs = lambda n: [(int(a), 100 + int(b)) for a, b in zip(rng.integers(0, 12, n), rng.integers(0, 30, n), strict=True)]
    own, donor = list(dict.fromkeys(pairs(10))), pairs(60)
    parents, children, want = {e for _, e in own}, defaultdict(int), list(own)
    for s, _ in own:
        children[s] += 1
    for s, e in donor:
        if e not in parents and children[s] < 2:
            parents.add(e)
            children[s] += 1
            want.append((s, e))
    frame = lambda es: spark.createDataFrame([("a", s, e, i) for i, (s, e) in enumerate(es)], "dataset string, source_id long, target_id long, edge_seq long")
    got = [(r.source_id, r.target_id) for r in stages.merged(frame(own), frame(donor)).orderBy("edge_seq").collect()]
    assert got == want
