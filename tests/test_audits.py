"""Audits on cases small enough to do by hand."""

from tracelace.operators import audits


def frames(spark):
    links = spark.createDataFrame([("d", 1, 11, 0), ("d", 1, 12, 1), ("d", 2, 13, 2), ("d", 2, 14, 3), ("d", 3, 21, 4)], "dataset string, source_id long, target_id long, edge_seq long")
    truth = spark.createDataFrame([("d", 101, 111), ("d", 102, 113), ("d", 102, 114), ("d", 103, 120), ("d", 103, 121)], "dataset string, source_id long, target_id long")
    match = spark.createDataFrame([("d", p, p + 100) for p in (1, 2, 3, 11, 13, 14, 20, 21)], "dataset string, pred_id long, gt_id long")
    p = spark.createDataFrame([("d", 1, 11, 0.2), ("d", 1, 12, 0.7), ("d", 2, 13, 0.5), ("d", 2, 14, 0.5)], "dataset string, source_id long, target_id long, p double")
    return links, truth, match, p


def test_forks_are_cut_where_the_truth_does_not_divide(spark):
    links, truth, match, p = frames(spark)
    pairs = lambda df: sorted((r.parent, r.dropped_id) for r in df.collect())
    assert pairs(audits.fork_cull(links, match, truth, p)) == [(1, 12)]
    assert pairs(audits.fork_cull(links, match, truth, p, blind=True)) == [(1, 11), (2, 14)]


def test_daughters_move_under_their_parent(spark):
    links, truth, match, _ = frames(spark)
    got = audits.reparent_plan(truth, match, links).collect()
    assert [(r.parent, r.daughter, r.claimed_by) for r in got] == [(3, 20, None)]
    taken = links.unionByName(spark.createDataFrame([("d", 1, 20, 9)], links.schema))
    assert [(r.parent, r.daughter, r.claimed_by) for r in audits.reparent_plan(truth, match, taken).collect()] == [(3, 20, 1)]


def test_difficulty_follows_new_bests(spark):
    scores = spark.createDataFrame([("d", i, s) for i, s in enumerate([3.0, 3.0, 5.0])], "dataset string, w int, s double")
    row = audits.paced_difficulty(scores, "w", "s", 0.5, 0.0).first()
    assert (row.windows, row.difficulty) == (3, 0.625)
