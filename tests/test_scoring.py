"""The structural cases: base truth 0 (t0), 1 (t1), 2 and 3 (t2), links 0-1, 1-2, 1-3; predictions add 100 to ids."""

import pytest

from tracelace.functions.geometry import to_um
from tracelace.operators import assign, divisions, joins, scoring

NODES = [(0, 0, 10, 10, 10), (1, 1, 10, 10, 10), (2, 2, 10, 20, 10), (3, 2, 10, 0, 10)]
EDGES = [(0, 1), (1, 2), (1, 3)]
P_NODES = [(100 + i, *rest) for i, *rest in NODES]
P_EDGES = [(100 + a, 100 + b) for a, b in EDGES]

CASES = {
    "perfect": (NODES, EDGES, P_NODES, P_EDGES, (3, 0, 0), (1, 0, 0)),
    "empty_pred": (NODES, EDGES, [], [], (0, 0, 3), (0, 0, 1)),
    "duplicate_edges": (NODES, EDGES, P_NODES, P_EDGES * 2, (3, 0, 0), (1, 1, 0)),
    "backward_and_skip": (NODES, EDGES, P_NODES, [*P_EDGES, (101, 100), (100, 102)], (3, 0, 0), (0, 2, 1)),
    "over_out_degree": (NODES, EDGES, [*P_NODES, (104, 2, 10, 40, 10), (105, 2, 10, 60, 10)], [*P_EDGES, (101, 104), (101, 105)], (3, 0, 0), (1, 0, 0)),
    "merge_onto_one_gt_edge": (NODES, EDGES, [*P_NODES, (106, 0, 11, 10, 10), (107, 1, 11, 10, 10)], [*P_EDGES, (106, 107)], (3, 0, 0), (1, 0, 0)),
    "free_edges_in_unannotated_tissue": (NODES, EDGES, [*P_NODES, (108, 0, 200, 200, 200), (109, 1, 200, 200, 200)], [*P_EDGES, (108, 109)], (3, 0, 0), (1, 0, 0)),
    "no_gt_edges": (NODES, [], P_NODES, P_EDGES, (0, 0, 0), (0, 1, 0)),
}


def _graph(spark, name, nodes, edges):
    n = spark.createDataFrame([(name, *x) for x in nodes], "dataset string, node_id long, t int, z int, y int, x int")
    e = spark.createDataFrame([(name, a, b, i) for i, (a, b) in enumerate(edges)], "dataset string, source_id long, target_id long, edge_seq long")
    return to_um(n), e


@pytest.fixture(scope="module")
def scored(spark):
    parts = [(name, *c) for name, c in CASES.items()]
    truth = [_graph(spark, n, c[0], c[1]) for n, *c in parts]
    pred = [_graph(spark, n, c[2], c[3]) for n, *c in parts]
    gather = lambda xs: __import__("functools").reduce(lambda a, b: a.unionByName(b), xs).coalesce(2).cache()
    tn, te, pn, pe = gather([x[0] for x in truth]), gather([x[1] for x in truth]), gather([x[0] for x in pred]), gather([x[1] for x in pred])
    slim = lambda df: df.select("dataset", "node_id", "t", "uz", "uy", "ux")
    near = joins.gated(slim(pn), slim(tn), 7.0)
    match = assign.match_nodes(near.selectExpr("a_dataset as dataset", "a_t as t", "a_node_id as source_id", "b_node_id as target_id", "d")).cache()
    edges = {r.dataset: (r.tp, r.fp, r.fn) for r in scoring.edge_counts(scoring.charged_links(pe, pn, te, match), te).collect()}
    div = {r.dataset: (r.div_tp, r.div_fp, r.div_fn) for r in divisions.division_counts(pn, pe, tn, te).collect()}
    return edges, div


@pytest.mark.parametrize("name", CASES)
def test_edge_counts(scored, name):
    assert scored[0].get(name, (0, 0, 0)) == CASES[name][4]


@pytest.mark.parametrize("name", CASES)
def test_division_counts(scored, name):
    assert scored[1].get(name, (0, 0, 0)) == CASES[name][5]


def test_division_reach(spark):
    """A missed division by where it was lost: a daughter claimed by another track, a parent without a child, forks on known tissue."""
    far = [(4, 0, 10, 300, 10), (5, 1, 10, 300, 10)]
    cases = {
        "recovered": (P_NODES, P_EDGES),
        "one_orphan_daughter": (P_NODES, P_EDGES[:2]),
        "both_claimed": ([*P_NODES, (110, 1, 10, -4, 10)], [*P_EDGES[:2], (110, 103)]),
        "childless_parent": (P_NODES, [(100, 101)][:0]),
        "childless_and_claimed": ([*P_NODES, (110, 1, 10, -40, 10), (111, 1, 10, 60, 10)], [(110, 103), (111, 102)]),
        "daughter_missing": (P_NODES[:3], P_EDGES[:2]),
        "spurious_fork": ([*P_NODES, (104, 0, 10, 300, 10), (105, 1, 10, 300, 10), (106, 1, 10, 310, 10)], [*P_EDGES, (104, 105), (104, 106)]),
    }
    gather = lambda xs: __import__("functools").reduce(lambda a, b: a.unionByName(b), xs).coalesce(2).cache()
    truth = [_graph(spark, n, NODES + far, [*EDGES, (4, 5)]) for n in cases]
    pred = [_graph(spark, n, a, b) if b else (_graph(spark, n, a, [(1, 2)])[0], _graph(spark, n, a, [(1, 2)])[1].limit(0)) for n, (a, b) in cases.items()]
    rows = divisions.division_counts(gather([x[0] for x in pred]), gather([x[1] for x in pred]), gather([x[0] for x in truth]), gather([x[1] for x in truth])).collect()
    got = {r.dataset: (r.div_tp, r.nodes_missing, r.no_fork, r.fork_rejected, r.unproposable, r.no_kept_child, r.spurious) for r in rows}
    assert got == {
        "recovered": (1, 0, 0, 0, 0, 0, 0),
        "one_orphan_daughter": (0, 0, 1, 0, 0, 0, 0),
        "both_claimed": (0, 0, 1, 0, 1, 0, 0),
        "childless_parent": (0, 0, 1, 0, 0, 1, 0),
        "childless_and_claimed": (0, 0, 1, 0, 1, 1, 0),
        "daughter_missing": (0, 1, 0, 0, 0, 0, 0),
        "spurious_fork": (1, 0, 0, 0, 0, 0, 1),
    }
