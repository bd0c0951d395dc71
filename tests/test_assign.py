import itertools
import math

import numpy as np
import pytest

from tracelace.operators import assign, linkers


def brute(cost):
    n, m = cost.shape
    return min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))


@pytest.mark.parametrize("seed", range(12))
def test_least_cost_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 6))
    m = int(rng.integers(n, 7))
    cost = rng.integers(-20, 20, (n, m)).astype(float)
    got = assign.solve(cost)
    assert len(set(got.tolist())) == n
    assert sum(cost[i, j] for i, j in enumerate(got)) == brute(cost)


def test_tall_matrices_assign_every_column():
    cost = np.array([[3.0], [1.0], [2.0]])
    assert assign.rectangle(cost) == [(1, 0)]
    with pytest.raises(ValueError):
        assign.solve(cost)


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "dataset string, t int, source_id long, target_id long, d double")


def test_as_many_allowed_pairs_as_possible_come_first(spark):
    # the near pair would leave one source alone
    p = _pairs(spark, [("a", 0, 1, 10, 1.0), ("a", 0, 1, 11, 5.0), ("a", 0, 2, 10, 5.0)])
    got = {(r.source_id, r.target_id) for r in assign.gated_hungarian(p).collect()}
    assert got == {(1, 11), (2, 10)}


def test_skips_leave_a_dear_pair_alone(spark):
    p = _pairs(spark, [("a", 0, 1, 10, 1.0), ("a", 0, 2, 11, 9.0)])
    got = {(r.source_id, r.target_id) for r in assign.with_skips(p, "d", 5.0).collect()}
    assert got == {(1, 10)}


def test_two_children_at_most(spark):
    p = _pairs(spark, [("a", 0, 1, 10 + i, 0.1 * (i + 1)) for i in range(3)])
    got = {r.target_id for r in assign.with_divisions(p, "d", 1.0).collect()}
    assert got == {10, 11}


def test_matching_prefers_the_nearer_and_is_one_to_one(spark):
    p = _pairs(spark, [("a", 0, 1, 10, 0.0), ("a", 0, 2, 10, 3.0), ("a", 0, 2, 11, 6.5), ("b", 0, 1, 10, 2.0)])
    got = {(r.dataset, r.pred_id, r.gt_id) for r in assign.match_nodes(p).collect()}
    assert got == {("a", 1, 10), ("a", 2, 11), ("b", 1, 10)}


def plain_frame(w):
    """The rule of a frame by trying everything: rows are truth, columns detections, 0 where a pair isn't allowed."""
    n, m = w.shape
    if n > m:
        return {(i, j) for j, i in plain_frame(w.T)}

    def best(table):
        fits = [p for p in itertools.permutations(range(m), n) if all(table[i, j] != 0 for i, j in enumerate(p))]
        return max(fits, key=lambda p: sum(table[i, j] for i, j in enumerate(p)), default=None)

    padded = w.copy()
    padded[(w == 0).all(axis=1)] = -1
    padded[:, (w == 0).all(axis=0)] = -1
    got = best(w)
    if got is None:
        got = best(padded)
    if got is None:
        got = best(np.where(w == 0, -1, w))
    return {(i, j) for i, j in enumerate(got) if w[i, j] > 0}


def test_a_frame_decides_the_cover_for_all_its_pieces(spark):
    rng = np.random.default_rng(8)
    rows, want, sizes = [], set(), []
    for f in range(150):
        n, m = (int(x) for x in rng.integers(1, 6, 2))
        d = rng.random((n, m)) * 7
        ok = rng.random((n, m)) < rng.choice([0.2, 0.4, 0.7])
        if not ok.any():
            continue
        w = np.where(ok, (1 / (1 + d)).astype(np.float32).astype(float), 0)
        want |= {(f, 100 + j, i) for i, j in plain_frame(w)}
        rows += [("a", f, 100 + int(j), int(i), float(d[i, j])) for i, j in zip(*np.nonzero(ok), strict=True)]
        sizes.append(("a", f, m, n))
    got = assign.match_nodes(_pairs(spark, rows), sizes=spark.createDataFrame(sizes, "dataset string, t int, n_pred long, n_gt long"))
    assert {(r.t, r.pred_id, r.gt_id) for r in got.collect()} == want


def test_a_lone_truth_and_a_lone_detection_change_a_chain(spark):
    w = lambda d: 1 / (1 + d)
    chain = [("a", 0, 1, 10, 6.0), ("a", 0, 1, 11, 0.0), ("a", 0, 2, 11, 6.0), ("a", 0, 2, 12, 0.0), ("a", 0, 3, 12, 6.0)]
    match = lambda n: {(r.pred_id, r.gt_id) for r in assign.match_nodes(_pairs(spark, chain), sizes=spark.createDataFrame([("a", 0, n, n)], "dataset string, t int, n_pred long, n_gt long")).collect()}
    assert match(3) == {(1, 10), (2, 11), (3, 12)} and match(4) == {(1, 11), (2, 12)}
    assert 2 * w(0.0) - 1 > 3 * w(6.0) - 0


def test_most_pairs_finds_the_augmenting_path():
    got = assign.most_pairs([(1, 1), (1, 2), (2, 1)])
    assert len(got) == 2


def _flow_brute(arcs, nodes, end):
    best = (0, [])
    for k in range(len(arcs) + 1):
        for some in itertools.combinations(arcs, k):
            if len({a for a, _, _ in some}) < k or len({b for _, b, _ in some}) < k:
                continue
            used = {a for a, _, _ in some} | {b for _, b, _ in some}
            tracks = len(used) - k
            best = min(best, (sum(c for _, _, c in some) + 2 * end * tracks, sorted((a, b) for a, b, _ in some)), key=lambda x: x[0])
    return best[0]


@pytest.mark.parametrize("seed", range(10))
def test_flow_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    nodes = list(range(9))
    arcs = [(a, b, int(rng.integers(-30, 10))) for a in nodes for b in nodes if b // 3 == a // 3 + 1 and rng.random() < 0.55]
    end = int(rng.integers(0, 12))
    got = linkers.flow(arcs, nodes, end, end)
    price = {(a, b): c for a, b, c in arcs}
    assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})
    used = {x for ab in got for x in ab}
    assert sum(price[x] for x in got) + 2 * end * (len(used) - len(got)) == _flow_brute(arcs, nodes, end)


@pytest.mark.parametrize("seed", range(16))
def test_flow_with_divisions_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    nodes = list(range(8))
    arcs = [(a, b, int(rng.integers(-40, 10))) for a in nodes for b in nodes if (b // 2 == a // 2 + 1 or b // 4 == a // 4 + 1) and rng.random() < 0.5][:14]
    appear, disappear, divide = int(rng.integers(0, 12)), int(rng.integers(0, 12)), int(rng.integers(0, 15))

    def total(some):
        into, out = [b for _, b, _ in some], [a for a, _, _ in some]
        cost = sum(c for _, _, c in some)
        for x in nodes:
            a, b = into.count(x), out.count(x)
            if a > 1 or b > 2:
                return math.inf
            cost += (disappear if a and not b else 0) + (appear if b and not a else 0) + (appear + divide if b == 2 else 0)
        return cost

    best = min(total(some) for k in range(len(arcs) + 1) for some in itertools.combinations(arcs, k))
    got = set(linkers.flow(arcs, nodes, appear, disappear, divide))
    assert total([x for x in arcs if (x[0], x[1]) in got]) == best


def test_a_division_is_priced_with_an_appearance():
    assert linkers.flow([(0, 1, -3000)], [0, 1], 3000, 1000, 500) == []
    assert linkers.flow([(0, 1, -3000)], [0, 1], 1000, 1000, 500) == [(0, 1)]
    two = [(0, 1, -3000), (0, 2, -3000)]
    assert [len(linkers.flow(two, [0, 1, 2], 1000, 1000, d)) for d in (0, 900, 1100)] == [2, 2, 1]


def test_flow_of_a_dense_dataset_equals_the_dense_assignment():
    rng = np.random.default_rng(5)
    nodes = list(range(60))
    arcs = [(a, b, int(rng.integers(-900, 300))) for a in nodes for b in nodes if b // 12 == a // 12 + 1 and rng.random() < 0.6]
    for both in (0, 150, 700):
        table = np.full((120, 120), assign.FORBIDDEN)
        for a, b, c in arcs:
            table[a, b] = c
        for i in nodes:
            table[i, i] = 0
            table[i, 60 + i] = table[60 + i, i] = both / 2
        table[60:, 60:] = 0
        want = sum(table[i, j] for i, j in assign.rectangle(table))
        got = linkers.flow(arcs, nodes, both // 2, both // 2)
        price = {(a, b): c for a, b, c in arcs}
        out, into = {a for a, _ in got}, {b for _, b in got}
        assert sum(price[x] for x in got) + both // 2 * (len(out - into) + len(into - out)) == want


def test_a_knob_that_the_linker_does_not_read_is_an_error():
    with pytest.raises(ValueError):
        linkers.LinkerConfig("nearest", bonus=1.0)
    with pytest.raises(ValueError):
        linkers.LinkerConfig("other")
    assert linkers.LinkerConfig("assignment", gate=8.0).effective_bonus == 16.0


@pytest.mark.parametrize("name", ["nearest", "assignment", "ilp", "division", "motion", "flow"])
def test_linkers_keep_the_gate_and_the_limits(spark, name):
    from tracelace.functions.geometry import to_um

    rng = np.random.default_rng(3)
    rows = [("a" if i % 2 else "b", 100 * t + i, t, int(rng.integers(0, 8)), int(rng.integers(0, 60)), int(rng.integers(0, 60))) for t in range(4) for i in range(14)]
    nodes = to_um(spark.createDataFrame(rows, "dataset string, node_id long, t int, z int, y int, x int"))
    from pyspark.sql import functions as F

    from tracelace.operators.joins import candidates

    pairs = candidates(nodes, 10.0).withColumn("p", 1 / (1 + F.col("d")))
    config = linkers.LinkerConfig(name, gate=10.0, boundary=2.0 if name in ("assignment", "flow") else None)
    got = config.build(nodes, pairs).collect()
    allowed = {(r.dataset, r.source_id, r.target_id) for r in pairs.collect()}
    assert got and {(r.dataset, r.source_id, r.target_id) for r in got} <= allowed
    assert len({(r.dataset, r.target_id) for r in got}) == len(got)
    most = 2 if name in ("ilp", "division") else 1
    out = {}
    for r in got:
        out[(r.dataset, r.source_id)] = out.get((r.dataset, r.source_id), 0) + 1
    assert max(out.values()) <= most


def test_skips_by_lists_equal_the_whole_matrix():
    rng = np.random.default_rng(8)
    for n, m in rng.integers(1, 12, (150, 2)):
        cost = np.where(rng.random((n, m)) < 0.6, rng.integers(0, 9, (n, m)) / 7, np.nan)
        stop = float(rng.integers(1, 9)) / 7
        whole = np.hstack([np.where(np.isnan(cost), assign.FORBIDDEN, cost), np.where(np.eye(n) > 0, stop, assign.FORBIDDEN)])
        best = whole[np.arange(n), assign.solve(whole)].sum()
        rows = [[(j, cost[i, j] - stop) for j in range(m) if cost[i, j] < stop] for i in range(n)]
        column = assign.cheapest_columns(rows, m)
        taken = [j for j in column if j >= 0]
        assert len(taken) == len(set(taken))
        assert sum(cost[i, j] if j >= 0 else stop for i, j in enumerate(column)) == pytest.approx(best)


def test_a_crowded_gap_is_searched_as_lists(spark, monkeypatch):
    monkeypatch.setattr(assign, "solve", lambda cost: pytest.fail("a matrix"))
    p = _pairs(spark, [("a", 0, s, 1000 + t, 1.0 + (s != t)) for s in range(60) for t in range(60) if abs(s - t) < 3])
    got = {(r.source_id, r.target_id) for r in assign.with_skips(p, "d", 5.0).collect()}
    assert got == {(s, 1000 + s) for s in range(60)}
