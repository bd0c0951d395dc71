"""Hard negatives by bounded inner products in a rotated space.

Vectors of whole numbers are turned by the orthogonal axes of their second moments, which puts most of their length into
the leading components. Partial products over these, give or take the product of what is left of both lengths and a slack
for rounding, bound a score from both sides; pairs that can't matter are dropped early, and those that are left are scored
by products of whole numbers. Anchors are broadcast in blocks of bounded size; all rows are scored against each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.storage import written

#: No component is beyond this, so that a score times a hundred is an exact long at any of 4096 dimensions.
WIDEST = 1 << 22
#: Stands for a null id, after all others.
NO_ID = np.iinfo(np.int64).max
NONE = np.iinfo(np.int64).min
TILE = 1024


@dataclass(frozen=True)
class Mining:
    """An anchor has so many positives; each of these so many negatives at between ``low`` and ``high`` percent of its score."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    #: Bytes of the anchors that are broadcast together.
    block_bytes: int = 32 << 20


def prepared(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """row, id, label and x, the whole numbers floor(scale * component): the rows with a label and a finite vector.

    ``row`` tells apart rows alike; it is fixed once the table is written.
    """
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda v: F.floor(F.greatest(F.lit(float(-WIDEST)), F.least(F.lit(float(WIDEST)), v.cast("double") * scale))).cast("int"))
    return vectors.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite).select(F.monotonically_increasing_id().alias("row"), F.col(ident).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a column as rows of whole numbers; a vector of fewer than ``d`` components ends in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), d), np.int64)
    out[np.arange(d)[None] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """Orthogonal axes as columns, those of the largest second moments first.

    A task sends the upper half of its sum of products, which Spark adds up: d (d + 1) / 2 numbers come to the driver.
    """
    upper = np.triu_indices(d)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = matrix(batch.column(0), d).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], names=["place", "v"])

    sums = rows.select("x").mapInArrow(moments, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).toArrow()
    full = np.zeros((d, d))
    v = np.zeros(len(upper[0]))
    v[sums.column("place").to_numpy()] = sums.column("v").to_numpy()
    full[upper] = v
    full = full + np.triu(full, 1).T
    return np.linalg.eigh(full)[1][:, ::-1].copy()


class Space:
    """Vectors turned by ``axes``: the components, and what is left of the length beyond each cut."""

    def __init__(self, axes: np.ndarray):
        d = len(axes)
        self.axes = axes
        self.cuts = sorted({max(1, d * k // 8) for k in (1, 2, 4, 6, 8)})
        # rounding of two rotations and a product, and what the axes lack of being orthogonal
        self.slack = float(np.linalg.norm(axes.T @ axes - np.eye(d))) + 8 * d * (d + 4) * np.finfo(float).eps

    def turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = x.astype(float) @ self.axes
        left = np.stack([np.sqrt((y[:, c:] ** 2).sum(axis=1)) for c in self.cuts], axis=1)
        return y, left, np.sqrt((x.astype(float) ** 2).sum(axis=1))

    def pairs(self, a: tuple, b: tuple, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (i, j) of the pairs of ``a`` and ``b`` whose product may lie between ``least[j]`` and ``most[j]``."""
        (ya, la, na), (yb, lb, nb) = a, b
        rows, cols = np.arange(len(ya)), np.arange(len(yb))
        part = np.zeros((len(rows), len(cols)))
        begin, alive = 0, np.ones(part.shape, bool)
        for s, end in enumerate(self.cuts):
            part += ya[rows, begin:end] @ yb[cols, begin:end].T
            slack = np.outer(la[rows, s], lb[cols, s]) + np.outer(self.slack * na[rows], nb[cols])
            alive &= (part + slack >= least[cols]) & (part - slack <= most[cols])
            begin = end
            if end < self.cuts[-1]:
                r, c = alive.any(axis=1), alive.any(axis=0)
                rows, cols, part, alive = rows[r], cols[c], part[np.ix_(r, c)], alive[np.ix_(r, c)]
                if not alive.size:
                    break
        i, j = np.nonzero(alive)
        return rows[i], cols[j]


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The exact scores of pairs."""
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 1 << 16):
        out[s : s + (1 << 16)] = np.einsum("ij,ij->i", a[i[s : s + (1 << 16)]], b[j[s : s + (1 << 16)]])
    return out


class Best:
    """The ``k`` best (score, id) of each slot: higher scores first, ties by smaller id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), NONE, np.int64)
        self.id = np.full((slots, k), NO_ID, np.int64)

    def least(self) -> np.ndarray:
        """What a score must reach to be kept in a slot."""
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.score[slot, -1]
        slot, score, ids = slot[good], score[good], ids[good]
        if not len(slot):
            return
        held = np.unique(slot)
        slot = np.concatenate([np.repeat(held, self.k), slot])
        score = np.concatenate([self.score[held].ravel(), score])
        ids = np.concatenate([self.id[held].ravel(), ids])
        order = np.lexsort((ids, ~score, slot))  # ~ turns the order of whole numbers round without overflow
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, held)
        take = first[:, None] + np.arange(self.k)
        self.score[held], self.id[held] = score[take], ids[take]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.score != NONE)
        return slot, self.score[slot, place], self.id[slot, place]


def _ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def _read(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = batch.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False)
    return batch.column(0).to_numpy(zero_copy_only=False), ids, batch.column(2).to_numpy(zero_copy_only=False), matrix(batch.column(3), d)


def _tiles(x: np.ndarray) -> Iterator[slice]:
    return (slice(s, s + TILE) for s in range(0, len(x), TILE))


def same_label(rows: DataFrame, anchors: tuple, space: Space, d: int, k: int) -> DataFrame:
    """row (of the anchor), score and id: each task's ``k`` best other rows of an anchor's own label."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, _, label, x = shared.value
        turned = space.turned(x)
        places = {v: np.nonzero(label == v)[0] for v in np.unique(label)}
        best = Best(len(key), k)
        for batch in batches:
            row, ids, labels, y = _read(batch, d)
            for v in np.unique(labels):
                mine, all_of = np.nonzero(labels == v)[0], places.get(v, ())
                for s in _tiles(mine):
                    part = mine[s]
                    a = space.turned(y[part])
                    for t in _tiles(all_of):
                        to = all_of[t]
                        i, j = space.pairs(a, tuple(z[to] for z in turned), best.least()[to].astype(float), np.full(len(to), np.inf))
                        i, j = part[i], to[j]
                        other = row[i] != key[j]
                        i, j = i[other], j[other]
                        best.add(j, products(y, x, i, j), ids[i])
        slot, score, ids = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(key[slot]), pa.array(score), _ids(ids)], names=["row", "score", "id"])

    return rows.select("row", "id", "label", "x").mapInArrow(scan, "row long, score long, id long")


def other_label(rows: DataFrame, anchors: tuple, windows: tuple, space: Space, d: int, k: int) -> DataFrame:
    """window, anchor_id, positive_id, positive_score, score and id: each task's ``k`` best rows of another label within a window of an anchor's scores.

    ``windows``: the anchors' places in their block, the least and the largest score of each window, and its positive's id and score.
    """
    shared = rows.sparkSession.sparkContext.broadcast((anchors, windows))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, names, label, x), (of, low, high, positive, positive_score) = shared.value
        anchor = names[of]
        used = np.unique(of)
        label, x, of = label[used], x[used], np.searchsorted(used, of)
        turned, best = space.turned(x), Best(len(of), k)
        by_anchor = np.argsort(of, kind="stable")
        first, n = np.searchsorted(of[by_anchor], np.arange(len(used))), np.bincount(of, minlength=len(used))
        most = np.full(len(used), NONE)
        np.maximum.at(most, of, high)
        for batch in batches:
            _, ids, labels, y = _read(batch, d)
            for s in _tiles(y):
                a = space.turned(y[s])
                least = np.full(len(used), NO_ID)
                np.minimum.at(least, of, np.maximum(low, best.least()))
                for t in _tiles(used):
                    i, j = space.pairs(a, tuple(z[t] for z in turned), least[t].astype(float), most[t].astype(float))
                    i, j = i + s.start, j + t.start
                    differ = labels[i] != label[j]
                    i, j = i[differ], j[differ]
                    score = products(y, x, i, j)
                    for p in range(int(n.max(initial=0))):
                        has = np.nonzero(n[j] > p)[0]
                        window = by_anchor[first[j[has]] + p]
                        inside = (score[has] >= low[window]) & (score[has] <= high[window])
                        best.add(window[inside], score[has][inside], ids[i[has][inside]])
        slot, score, ids = best.rows()
        columns = [pa.array(slot), _ids(anchor[slot]), _ids(positive[slot]), pa.array(positive_score[slot]), pa.array(score), _ids(ids)]
        yield pa.RecordBatch.from_arrays(columns, names=["window", "anchor_id", "positive_id", "positive_score", "score", "id"])

    return rows.select("row", "id", "label", "x").mapInArrow(scan, "window long, anchor_id long, positive_id long, positive_score long, score long, id long")


def _ranked(df: DataFrame, key: str, k: int) -> DataFrame:
    best = W.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return df.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, anchors: DataFrame, knobs: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: each positive's negatives.

    ``rows`` is a written table of ``prepared``, ``anchors`` are some of its rows. An anchor's positives are its best other
    rows of the same label; a positive's negatives are the best rows of another label whose score is between ``low`` and
    ``high`` percent of the positive's. All rows are read twice for each block of anchors; a task sends its best few of each
    anchor. A block, its positives and the tasks' states are bounded by ``block_bytes``.
    """
    spark = rows.sparkSession
    size = rows.agg(F.max(F.size("x")).alias("d")).first()["d"]
    d, n = max(1, size or 0), anchors.count()
    out = spark.createDataFrame([], _OUT)
    if not n:
        return out
    space = Space(rotation(rows, d))
    blocks = -(-n * d * 8 // knobs.block_bytes)
    for b in range(blocks):
        held = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "id", "label", "x").toArrow().combine_chunks()
        if not len(held):
            continue
        key, ids, label, x = _read(held.to_batches()[0], d)
        block = (key, ids, label, x)
        found = _ranked(same_label(rows, block, space, d, knobs.positives), "row", knobs.positives).toArrow()
        order = np.argsort(key)
        of = order[np.searchsorted(key[order], found.column("row").to_numpy())]
        score = found.column("score").to_numpy()
        low, high = -(-knobs.low * score // 100), knobs.high * score // 100
        some = low <= high
        if not some.any():
            continue
        positive = found.column("id").fill_null(NO_ID).to_numpy()
        windows = tuple(z[some] for z in (of, low, high, positive, score))
        best = _ranked(other_label(rows, block, windows, space, d, knobs.negatives), "window", knobs.negatives)
        out = out.unionByName(written(best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    return out


def digest(vectors: DataFrame) -> DataFrame:
    """The negatives of the anchors of a table of vec_id, embedding and label.

    Rows with a null label or vector, or a null or non-finite component, take no part; a null id is no anchor, keeps its
    label and comes after all others in ties; rows alike are rows of their own, and an anchor is no positive of itself but
    of its copies; shorter vectors end in zeros, components of over 16,384 count as that; extra columns are left aside; no
    rows or no anchors give none.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = written(prepared(vectors.select("vec_id", "embedding", label.alias("label"))), "vectors")
    return mine(rows, rows.filter(F.col("id") % 100 == 0))


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS k, * FROM e),
s AS MATERIALIZED (SELECT a.k, a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM d a JOIN d r ON a.k <> r.k WHERE a.vec_id % 100 = 0),
p AS (SELECT k, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY k ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.k, p.place ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM p JOIN s ON s.k = p.k AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
