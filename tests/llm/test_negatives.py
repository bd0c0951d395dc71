"""Hard negatives against a plain version that scores all pairs."""

import math

import duckdb
import numpy as np
import pytest

from tracelace.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long, row string, id int, x double"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", 2, 0.5) for r in rows], SCHEMA)


def plain(rows, width):
    used = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        x = [math.floor(256 * float(np.float32(c))) for c in v]
        used.append((vec_id, [max(-(1 << 22), min(1 << 22, c)) for c in x] + [0] * (width - len(x)), label))
    place = lambda s, i: (-s, i is None, i or 0)
    out = []
    for k, (a, x, label) in enumerate(used):
        if a is None or a % 100:
            continue
        scored = [(sum(p * q for p, q in zip(x, y, strict=True)), i, m) for n, (i, y, m) in enumerate(used) if n != k]
        same = sorted((place(s, i), s, i) for s, i, m in scored if m == label)[:5]
        for _, ps, p in same:
            near = sorted((place(s, i), s, i) for s, i, m in scored if m != label and 30 * ps <= 100 * s <= 90 * ps)[:10]
            out += [(a, p, r + 1, n, ps, s) for r, (_, s, n) in enumerate(near)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect()), key=str)


def made(seed, n, width, labels, hot=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    label = np.where(rng.random(n) < hot, 1, rng.integers(0, labels, n))
    v = (centres[rng.integers(0, 4, n)] + rng.normal(size=(n, width)) * 0.5) / math.sqrt(width)
    v[n // 2 :: 9] = v[3]  # many rows alike in their vectors: ties
    return [(int(i * 5), [float(x) for x in v[i]], int(label[i])) for i in range(n)]


def dirty_rows():
    rows = made(3, 260, 16, 3)
    rows += [rows[20], rows[20], (None, rows[5][1], 1), (None, rows[6][1], None), (35, None, 1), (42, [], 2), (700, [float("nan")] * 16, 1), (800, [float("inf")] + [0.0] * 15, 1)]
    rows += [(900, [None] + [0.5] * 15, 1), (1000, [0.25] * 4, 1), (1100, [0.25] * 4, 4), (1300, [0.0] * 16, 2), (-100, rows[7][1], -3), (1200, [1e30, -1e30] + [0.0] * 14, 1), (1201, [1e30, -1e29] + [0.0] * 14, 2)]
    return rows


def test_dirty_rows_equal_all_pairs(spark):
    rows = dirty_rows()
    found = got(negatives.digest(table(spark, rows).repartition(5)))
    assert found == plain(rows, 16) and len({r[0] for r in found}) > 5


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_of_anchors_give_the_same(spark, seed):
    rows = made(seed, 400, 24, 5)
    prepared = negatives.written(negatives.prepared(table(spark, rows).repartition(3)), "test-vectors")
    anchors = prepared.filter("id % 20 = 0")
    one, many = negatives.mine(prepared, anchors), negatives.mine(prepared, anchors, negatives.Mining(block_bytes=5000))
    assert got(one) == got(many) and one.count() > 0


def test_bounds_hold_and_discard(spark):
    rows = made(5, 600, 32, 2)
    x = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    axes = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1].copy()
    space = negatives.Space(axes)
    a, b = space.turned(x[:300]), space.turned(x[300:])
    exact = x[:300] @ x[300:].T
    least, most = np.quantile(exact, 0.97, axis=0), np.quantile(exact, 0.99, axis=0)
    i, j = space.pairs(a, b, least, most)
    met = np.zeros(exact.shape, bool)
    met[i, j] = True
    assert met[(exact >= least) & (exact <= most)].all() and met.sum() < 1.05 * ((exact >= least) & (exact <= most)).sum() + 50
    assert (negatives.products(x[:300], x[300:], i, j) == exact[i, j]).all()


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert got(negatives.digest(spark.read.parquet(f"{sf}/embeddings.parquet"))) == sorted(con.execute(negatives.SQL).fetchall(), key=str)


def test_no_rows_and_no_anchors(spark):
    assert negatives.digest(table(spark, [])).count() == 0
    assert negatives.digest(table(spark, [(1, [0.5, 0.5], 1), (2, [0.5, 0.5], 2)])).count() == 0
    assert negatives.digest(table(spark, [(100, [0.5, 0.5], 1), (3, [0.5, 0.5], 1), (2, [0.5, 0.4], 2)])).count() == 1
