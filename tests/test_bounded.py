"""Plans whose memory must not grow with the tables: no emitted rows are broadcast, and groups are dealt by their keys."""

from pyspark.sql import functions as F

from tracelace.operators import audits, drift, joins, patches, placing, repair, voxels
from tracelace.storage import written


def _points(spark, n=400, name="bounded-points"):
    at = lambda k, m: F.pmod(F.col("id") * k, F.lit(m)).cast("double")
    df = spark.range(n).select(F.lit("d0").alias("dataset"), F.col("id").alias("node_id"), F.pmod("id", F.lit(5)).cast("int").alias("t"), at(7, 16).alias("uz"), at(37, 41).alias("uy"), at(53, 43).alias("ux"))
    return written(df.withColumns({a: F.col(f"u{a}").cast("int") for a in "zyx"}), name)


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_gated_join_broadcasts_no_emitted_points(spark):
    p = _points(spark)
    got = joins.gated(p, p, 10.0, 1)
    assert _broadcasts(got) == 0
    rows = p.collect()
    near = lambda a, b: ((a.uz - b.uz) ** 2 + (a.uy - b.uy) ** 2 + (a.ux - b.ux) ** 2) ** 0.5 <= 10.0
    assert got.count() == sum(b.t == a.t + 1 and near(a, b) for a in rows for b in rows)


def test_gated_join_emits_less_than_five_copies_of_a_point(spark):
    p = _points(spark)
    assert joins.emitted(p, "", 10.0).count() < 5 * p.count()


def test_wider_rounds_emit_only_open_points(spark, monkeypatch):
    p, seen, gated = _points(spark), [], joins.gated
    monkeypatch.setattr(joins, "gated", lambda left, right, gate, *more: (seen.append(right.count()), gated(left, right, gate, *more))[1])
    assert joins.k_nearest(p, 3, start=4.0).count() == 3 * p.count()
    assert len(seen) > 2 and sorted(seen, reverse=True) == seen and seen[-1] < seen[0] / 4


def test_only_edges_between_blocks_of_frames_go_through_rounds(spark, monkeypatch):
    # lineages of 100 frames with merges, forks, gaps, and an end that isn't among the nodes
    edges = [(100 * k + t, 100 * k + t + 1) for k in range(8) for t in range(99) if (t + k) % 45] + [(130, 233), (520, 420), (640, 541), (777, 9999), (655, 9999)]
    nodes = spark.createDataFrame([("a", n, n % 100) for n in range(800)], "dataset string, node_id long, t int")
    e = spark.createDataFrame([("a", *x) for x in edges], "dataset string, source_id long, target_id long")
    at = {n: n for x in [*edges, *((n, n) for n in range(800))] for n in x}
    for _ in range(200):
        for a, b in [*edges, *reversed(edges)]:
            at[a] = at[b] = min(at[a], at[b])
    seen, components = [], repair.components
    monkeypatch.setattr(repair, "components", lambda rows, *more: (seen.append(rows.count()), components(rows, *more))[1])
    assert {r.node_id: r.component for r in repair.labelled(nodes, e).collect()} == {n: at[n] for n in range(800)}
    between = sum(b == 9999 or a % 100 // repair.BLOCK != b % 100 // repair.BLOCK for a, b in edges)
    assert len(seen) == 1 and seen[0] <= 2 * between < len(edges) / 8


def test_confirmed_broadcasts_no_emitted_points(spark):
    p = _points(spark)
    heat = p.filter("node_id % 3 = 0").select("dataset", "t", "z", "y", "x", F.col("node_id").cast("double").alias("v"))
    got = placing.confirmed(p, heat, (1, 3, 3), 200.0)
    assert _broadcasts(got) == 0
    rows, hot = p.collect(), heat.collect()
    for r in got.collect():
        seen = [h.v for h in hot if h.t == r.t and abs(h.z - r.z) <= 1 and abs(h.y - r.y) <= 3 and abs(h.x - r.x) <= 3]
        assert r.confirmed == (not seen or max(seen) >= 200.0)
    assert len(rows) == got.count()


def test_prune_grid_broadcasts_no_cells(spark):
    p = _points(spark)
    pairs = written(joins.candidates(p, 10.0).withColumn("p", 1 / (1 + F.col("d"))), "bounded-pairs")
    truth = pairs.filter("source_id % 2 = 0").select("dataset", "source_id", "target_id")
    real = p.filter("node_id % 3 != 0").select("dataset", "node_id")
    grid = [(0.0, 0.0), (0.5, 0.1)]
    got = audits.prune_grid(pairs, truth, p, real, grid)
    nodes_in_plan = got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode")
    assert nodes_in_plan == 1
    rows = {(r.recall, r.collateral): r for r in got.collect()}
    assert len(rows) == 2 and rows[0.0, 0.0].destroyed == 0 and rows[0.5, 0.1].destroyed > 0
    assert {r.total for r in rows.values()} == {truth.count()}


def test_prune_grid_sends_a_candidate_once_for_all_cells(spark, monkeypatch):
    p = _points(spark)
    pairs = written(joins.candidates(p, 10.0).withColumn("p", 1 / (1 + F.col("d"))), "pruned-pairs")
    truth = pairs.filter("source_id % 2 = 0").select("dataset", "source_id", "target_id")
    real = p.filter("node_id % 3 != 0").select("dataset", "node_id")
    grid = [(r, c) for r in (0.25, 0.5, 0.9) for c in (0.0, 0.1)]
    of = lambda: audits.prune_grid(pairs, truth, p, real, grid)
    plan = of()._jdf.queryExecution().optimizedPlan().toString()
    assert "cell" not in plan and plan.count("Generate explode") == 1 and plan.index("Generate explode") < plan.index("Window")
    good, rows, want = {(r.source_id, r.target_id) for r in truth.collect()}, pairs.collect(), {}
    for i, (recall, collateral) in enumerate(grid):
        alive = lambda n: (n * 48271 + i * 40692) % 999983 / 999983.0 >= (collateral if n % 3 else recall)  # noqa: E731, B023
        live = [r for r in rows if alive(r.source_id) and alive(r.target_id)]
        best = [{k: max(r.p for r in live if r[c] == k) for k in {r[c] for r in live}} for c in ("source_id", "target_id")]
        kept = sum((r.source_id, r.target_id) in good and r.p >= best[0][r.source_id] and r.p >= best[1][r.target_id] for r in live)
        want[recall, collateral] = (kept, len(good) - sum((r.source_id, r.target_id) in good for r in live), len(good))
    read = lambda: {(r.recall, r.collateral): (r.kept, r.destroyed, r.total) for r in of().collect()}
    assert read() == want
    monkeypatch.setattr(audits, "MOST_CELLS", 4)
    assert read() == want
    assert audits.prune_grid(pairs, truth.limit(0), p, real, grid).count() == 0


def test_drift_field_deals_votes_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(drift, "PART", 100)
    cast = spark.range(1000).select(F.lit("d0").alias("dataset"), F.pmod("id", F.lit(40)).cast("int").alias("t"), *[F.pmod("id", F.lit(m)).cast("double").alias(c) for m, c in ((5, "uz"), (7, "uy"), (11, "ux"), (3, "dz"), (4, "dy"), (2, "dx"))])
    got = drift.field(cast, drift.anchors(cast, 20.0), 12.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(dataset#" in plan and ", 10), REPARTITION_BY_NUM" in plan
    at = drift.at_points(cast.withColumn("node_id", F.monotonically_increasing_id()), got, 12.0)
    assert at.count() == 1000 and at.filter("fz is null").isEmpty()


def test_boxes_broadcast_no_emitted_points(spark):
    p = _points(spark, 60)
    frames = voxels.rendered(p, (16, 48, 48), 0.6)
    got = patches.boxes(p, written(patches.blocks(frames), "bounded-blocks"), (1, 4, 4))
    assert _broadcasts(got) == 0
    inside = {r.node_id: (min(r.z + 1, 15) - max(r.z - 1, 0) + 1) * (r.y + 4 - max(r.y - 4, 0) + 1) * (r.x + 4 - max(r.x - 4, 0) + 1) for r in p.collect()}
    assert {r.node_id: len(r.box) for r in got.collect()} == inside
