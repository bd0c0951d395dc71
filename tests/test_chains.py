"""Chains against a plain version, and how much of them is joined in rounds."""

import random

from tests.test_stages import graph
from tracelace.operators import motion


def test_chains_equal_plain_and_only_crossings_are_joined_in_rounds(spark, monkeypatch):
    seen, plain = [], motion.components
    monkeypatch.setattr(motion, "components", lambda e, *a: (seen.append(e.count()), plain(e, *a))[1])
    draw = random.Random(3)
    ids = draw.sample(range(1, 10_000), 400)
    nodes = [(ids[10 * t + i], t - 5, 0, i, 0) for t in range(40) for i in range(10)]
    at = {n[0]: n[1] for n in nodes}
    place = {(n[1], n[3]): n[0] for n in nodes}
    # a track a row, with gaps, forks, two parents, links over two frames and a link to an id that isn't a node
    edges = [(place[t, i], place[t + 1, i]) for t in range(-5, 34) for i in range(10) if draw.random() < 0.95]
    edges += [(place[t, i], place[t + 1, (i + 1) % 10]) for t, i in ((0, 2), (8, 4), (20, 7))] + [(place[-5, 9], place[-3, 8]), (place[34, 0], 20_000)]
    n, e = graph(spark, nodes, edges)
    out, into = ([x[k] for x in edges] for k in (0, 1))
    single = {s: t for s, t in edges if t in at and out.count(s) == 1 and into.count(t) == 1 and at[t] - at[s] == 1}
    want = set()
    for s in set(single) - set(single.values()):
        run = [s]
        while run[-1] in single:
            run.append(single[run[-1]])
        want |= {(min(run), pos, x, at[x]) for pos, x in enumerate(run)}
    got = [(r.chain_id, r.pos, r.node_id, r.t) for r in motion.chains(n, e).collect()]
    assert len(got) == len(want) and set(got) == want
    assert seen[0] < len(single) / 10
