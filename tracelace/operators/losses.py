"""Loss terms as aggregates over pairs of points and their embeddings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Frames of a block that a task holds.
BLOCK = 16


def unit(v: Column) -> Column:
    """An array divided by its length; zeros stay."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.greatest(size, F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def asked(points: DataFrame, pairs: DataFrame, temperature: float) -> DataFrame:
    """The rows of ``pairs`` (dataset, t of the source, source_id, target_id, y) with s, cosine / temperature, and l, its
    log-softmax over all points of the next frame; pairs that don't join a frame to the next are left out.

    ``points`` has dataset, node_id, t and e. A softmax needs all of a frame's targets, and frames are as dense whatever the
    number of datasets, so a task has the points of ``BLOCK`` frames, and only what is asked for leaves it.
    """
    own = F.floor(F.col("t") / BLOCK)
    whole = points.filter("dataset is not null and t is not null and node_id is not null").filter(F.forall("e", lambda x: x.isNotNull()))
    # a block also gets the next one's first frame
    block = F.explode(F.when(F.col("t") % BLOCK == 0, F.array(own, own - 1)).otherwise(F.array(own))).alias("_near")
    dealt = whole.select(F.col("dataset").alias("_set"), F.col("t").alias("_t"), F.col("node_id").alias("_id"), F.col("e").alias("_e"), block)
    want = pairs.select("dataset", "t", "source_id", "target_id", "y", own.alias("_block"))
    kinds = dict(want.dtypes)
    schema = f"dataset {kinds['dataset']}, source_id {kinds['source_id']}, target_id {kinds['target_id']}, y boolean, s double, l double"

    def run(points: pa.Table, pairs: pa.Table) -> pa.Table:
        return _asked(temperature, points, pairs)

    return dealt.groupBy("_set", "_near").cogroup(want.groupBy("dataset", "_block")).applyInArrow(run, schema)


def _asked(temperature: float, points: pa.Table, pairs: pa.Table) -> pa.Table:
    if not points.num_rows or not pairs.num_rows:
        pairs = pairs.slice(0, 0)
    sizes = pc.list_value_length(points.column("_e")).to_numpy()
    e = np.zeros((len(sizes), sizes.max(initial=0)))
    e[np.arange(e.shape[1]) < sizes[:, None]] = pc.list_flatten(points.column("_e")).to_numpy()
    e /= np.maximum(np.sqrt((e * e).sum(axis=1)), 1e-12)[:, None]
    ids, t = points.column("_id").to_numpy(), points.column("_t").to_numpy()
    source, target = pairs.column("source_id").to_numpy(), pairs.column("target_id").to_numpy()
    s, log = np.full(len(source), np.nan), np.full(len(source), np.nan)
    at = pairs.column("t").to_numpy()
    for frame in np.unique(at):
        a, b, asked = np.flatnonzero(t == frame), np.flatnonzero(t == frame + 1), np.flatnonzero(at == frame)
        if not len(a) or not len(b):
            continue
        i, j = (order[np.minimum(np.searchsorted(ids[side], x[asked], sorter=order), len(side) - 1)] for side, x in ((a, source), (b, target)) for order in (np.argsort(ids[side]),))
        there = (ids[a[i]] == source[asked]) & (ids[b[j]] == target[asked])
        asked, i, j = asked[there], i[there], j[there]
        cosine = np.where(sizes[a][:, None] == sizes[b], e[a] @ e[b].T / temperature, -np.inf)
        top = cosine.max(axis=1)
        top[~np.isfinite(top)] = 0.0
        with np.errstate(divide="ignore"):
            total = np.log(np.exp(cosine - top[:, None]).sum(axis=1))
        s[asked] = cosine[i, j]
        log[asked] = cosine[i, j] - top[i] - total[i]
    found = np.isfinite(s)
    out = pairs.select(["dataset", "source_id", "target_id", "y"]).append_column("s", pa.array(s)).append_column("l", pa.array(log))
    return out.filter(pa.array(found))


def _true(points: DataFrame, true: DataFrame) -> DataFrame:
    at = points.select("dataset", F.col("node_id").alias("source_id"), "t")
    return true.select("dataset", "source_id", "target_id").distinct().join(at, ["dataset", "source_id"]).withColumn("y", F.lit(True))


def _marked(pairs: DataFrame, true: DataFrame) -> DataFrame:
    y = true.select("dataset", "source_id", "target_id").distinct().withColumn("y", F.lit(True))
    return pairs.join(y, ["dataset", "source_id", "target_id"], "left").withColumn("y", F.coalesce("y", F.lit(False)))


def info_nce(points: DataFrame, true: DataFrame, temperature: float) -> DataFrame:
    """dataset, n (sources with a true target), loss: cross-entropy over a source's targets, a fork's mean over its daughters."""
    by_source = asked(points, _true(points, true), temperature).groupBy("dataset", "source_id").agg(F.avg(-F.col("l")).alias("_x"))
    return by_source.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("loss"))


def contrastive(points: DataFrame, true: DataFrame, decoys: DataFrame, temperature: float, margin: float = 0.0) -> DataFrame:
    """dataset, n, nce, margin: ``info_nce`` and the mean softplus of (decoy - true) similarities over mined decoys (t, source_id, target_id)."""
    want = _true(points, true).select("dataset", "t", "source_id", "target_id", "y").unionByName(decoys.select("dataset", "t", "source_id", "target_id", F.lit(False).alias("y")))
    by_source = W.partitionBy("dataset", "source_id")
    rows = asked(points, want, temperature).withColumn("_true", F.max(F.when(F.col("y"), F.col("s"))).over(by_source)).filter("_true is not null")
    gap = F.col("s") - F.col("_true") + margin
    soft = F.greatest(gap, F.lit(0.0)) + F.ln(1 + F.exp(-F.abs(gap)))
    one = rows.groupBy("dataset", "source_id").agg(F.avg(F.when(F.col("y"), -F.col("l"))).alias("_x"), F.count_if(~F.col("y")).alias("_k"), F.sum(F.when(~F.col("y"), soft)).alias("_m"))
    return one.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("nce"), F.try_divide(F.sum("_m"), F.sum("_k")).alias("margin"))


def slack_row(pairs: DataFrame, true: DataFrame, gamma: float = 2.0) -> DataFrame:
    """dataset, slack, loss: focal cross-entropy of a softmax over a target's sources and a slack row, whose logit is the mean logit.

    ``pairs`` has s; a target without a true parent may put its mass on the slack row.
    """
    slack = pairs.groupBy("dataset").agg(F.avg("s").alias("slack"))
    w = W.partitionBy("dataset", "target_id")
    rows = _marked(pairs, true).join(slack, "dataset")
    top = F.greatest(F.max("s").over(w), F.col("slack"))
    total = F.sum(F.exp(F.col("s") - top)).over(w) + F.exp(F.col("slack") - top)
    p = F.exp(F.col("s") - top) / total
    rows = rows.withColumn("_p", p).withColumn("_x", F.when(F.col("y"), -F.pow(1 - F.col("_p"), gamma) * F.ln(F.greatest("_p", F.lit(1e-12)))).otherwise(-F.pow("_p", gamma) * F.ln(F.greatest(1 - F.col("_p"), F.lit(1e-12)))))
    return rows.groupBy("dataset").agg(F.first("slack").alias("slack"), F.avg("_x").alias("loss"))


def offset_targets(points: DataFrame, radius: tuple[int, int, int], extent: tuple[int, int, int], scale: tuple[float, float, float]) -> DataFrame:
    """dataset, t, z, y, x and oz, oy, ox of every voxel within a box around a point: micrometres to its nearest point (equals: the least id).

    Points are dealt by ``BLOCK`` frames and put in boxes there, so that voxels, many times as many, are never shuffled.
    """
    kinds = dict(points.dtypes)
    dealt = points.select("dataset", "t", "node_id", "z", "y", "x", F.floor(F.col("t") / BLOCK).alias("_block"))
    schema = f"dataset {kinds['dataset']}, t {kinds['t']}, z int, y int, x int, oz double, oy double, ox double"

    def run(block: pa.Table) -> pa.Table:
        return _boxed(radius, extent, scale, block)

    return dealt.groupBy("dataset", "_block").applyInArrow(run, schema)


def _boxed(radius: tuple[int, int, int], extent: tuple[int, int, int], scale: tuple[float, float, float], points: pa.Table) -> pa.Table:
    """A block's voxels: those of a frame in order of the distance, the point's id and the offset, and the first of each."""
    box = np.stack(np.meshgrid(*[np.arange(-r, r + 1) for r in radius], indexing="ij"), axis=-1).reshape(-1, 3)
    um = box * np.array(scale)
    d = np.sqrt(um[:, 0] * um[:, 0] + um[:, 1] * um[:, 1] + um[:, 2] * um[:, 2])
    order = np.lexsort((-um[:, 2], -um[:, 1], -um[:, 0], d))
    box, um, near = box[order], -um[order], np.unique(d[order], return_inverse=True)[1]
    points = points.sort_by("node_id")
    n, m = points.num_rows, len(box)
    place = np.stack([points.column(c).to_numpy() for c in "zyx"], axis=1)
    at = (place[:, None] + box[None]).reshape(-1, 3)
    row, which = np.divmod(np.arange(n * m), m)
    inside = ((at >= 0) & (at < np.array(extent))).all(axis=1)
    at, row, which = at[inside], row[inside], which[inside]
    t = points.column("t").to_numpy()[row].astype(np.int64)
    voxel = (((t - t.min(initial=0)) * extent[0] + at[:, 0]) * extent[1] + at[:, 1]) * extent[2] + at[:, 2]
    # rows are in order of the id and, for one point, of the distance and offset
    first = np.lexsort((near[which], voxel))
    first = first[np.flatnonzero(np.diff(voxel[first], prepend=-1))]
    row, which, at = row[first], which[first], at[first]
    out = points.select(["dataset", "t"]).take(pa.array(row))
    for k, c in enumerate("zyx"):
        out = out.append_column(c, pa.array(at[:, k].astype(np.int32)))
    for k, c in enumerate("zyx"):
        out = out.append_column(f"o{c}", pa.array(um[which, k]))
    return out


def offset_loss(targets: DataFrame, predicted: DataFrame) -> DataFrame:
    """dataset, n_frames, n_voxels, loss: the mean over frames of the mean absolute error over supervised voxels; ``predicted`` has pz, py, px, else 0."""
    j = targets.join(predicted, ["dataset", "t", "z", "y", "x"], "left")
    error = sum((F.abs(F.coalesce(F.col(f"p{c}"), F.lit(0.0)) - F.col(f"o{c}")) for c in "yx"), F.abs(F.coalesce(F.col("pz"), F.lit(0.0)) - F.col("oz")))
    frames = j.groupBy("dataset", "t").agg(F.avg(error).alias("_e"), F.count(F.lit(1)).alias("_n"))
    return frames.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_frames"), F.sum("_n").alias("n_voxels"), F.avg("_e").alias("loss"))


def sigreg(views: DataFrame, directions: int, frequencies: tuple[float, ...], weight: float) -> DataFrame:
    """invariance, gaussianity, total of paired views (arrays a and b): the mean squared distance between the views, and the
    mean over projections and frequencies of the squared distance of the characteristic function to that of N(0, 1).

    The directions are unit vectors of cosines that depend on their numbers alone. Projections are summed as partial
    aggregates; rows aren't gathered.
    """
    gap = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    both = views.select(F.explode(F.array("a", "b")).alias("e"))
    line = unit_direction(directions)
    k = F.explode(F.sequence(F.lit(1), F.lit(directions))).alias("k")
    at = both.select("e", k).select("k", dot(F.col("e"), line(F.size("e"), F.col("k"))).alias("p"))
    f = F.explode(F.array(*map(F.lit, frequencies))).alias("f")
    cf = at.select("k", "p", f).groupBy("k", "f").agg(F.avg(F.cos(F.col("p") * F.col("f"))).alias("re"), F.avg(F.sin(F.col("p") * F.col("f"))).alias("im"))
    real = F.col("re") - F.exp(-0.5 * F.col("f") * F.col("f"))
    gauss = cf.agg(F.avg(real * real + F.col("im") * F.col("im")).alias("gaussianity"))
    return views.agg(F.avg(gap).alias("invariance")).crossJoin(gauss).withColumn("total", F.col("invariance") + weight * F.col("gaussianity"))


def unit_direction(directions: int):
    """A function of a width and a number k: the k-th direction, cos(i * k * phi) for i from 1, made of length 1."""
    phi = math.pi * (math.sqrt(5) - 1)
    return lambda n, k: unit(F.transform(F.sequence(F.lit(1), n), lambda i: F.cos(i * k * F.lit(phi))))


def pair_difficulty(pairs: DataFrame, true: DataFrame) -> DataFrame:
    """dataset, t, n_sources, difficulty: the share of a gap's annotated sources whose nearest candidate isn't their true one."""
    first = F.row_number().over(W.partitionBy("dataset", "source_id").orderBy("d", "target_id"))
    rows = _marked(pairs, true).withColumn("_k", first)
    one = rows.groupBy("dataset", "t", "source_id").agg(F.max("y").alias("_any"), F.max(F.col("y") & (F.col("_k") == 1)).alias("_first")).filter("_any")
    return one.groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n_sources"), F.avg((~F.col("_first")).cast("int")).alias("difficulty"))
