"""The tree of nested segments that falling thresholds cut from a volume, over blocks, and how well its scores tell real ones.

A block is labelled by itself at every level, and says for each of its pieces the piece of the next lower level that holds it:
what is above a threshold is above all lower ones. Voxels on the layers that blocks share join pieces of one level, so the
tree needs one run of connected components, and no frame is held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelace.functions.geometry import AXES, Spacing
from tracelace.operators import basins, joins, patches, scoring, voxels
from tracelace.operators.components import components
from tracelace.operators.groups import spread
from tracelace.operators.patches import Triple
from tracelace.storage import scratch, written

#: Levels that fit into a segment's name beside its label.
MOST_LEVELS = 16
_PIECE = "dataset string, t int, level int, label long, within long, size long, mass double, sz double, sy double, sx double, peak double, z int, y int, x int"


def tree(cut: DataFrame | voxels.Drawn, levels: Sequence[float], side: Triple = patches.SIDE) -> DataFrame:
    """dataset, t, level, segment, parent, size, mass, z, y, x, peak: face-connected pieces strictly above each threshold.

    ``cut``: blocks with a halo of 1, or frames that are drawn, which a task holds whole. ``levels``: thresholds from high to low, 16 at most; level 0 is the first. A segment's
    name is unique in its frame; ``parent`` is the segment of the next level that holds it, null at the last. Sizes are in
    voxels, z, y and x the mean place, ``peak`` the greatest value. Frames without a voxel above the lowest threshold give no rows.
    """
    if not 1 <= len(levels) <= MOST_LEVELS or any(a <= b for a, b in zip(levels, levels[1:], strict=False)):
        raise ValueError(f"levels must fall, and be 1 to {MOST_LEVELS}")

    names = [c.split()[0] for c in _PIECE.split(", ")]
    kinds = {"label": "Int64", "within": "Int64", "size": "Int64"} | {x: "Int32" for x in AXES}

    def pieces_of(dataset: str, t: int, a: np.ndarray, base: int, home: np.ndarray, shared: np.ndarray, origin: np.ndarray) -> pd.DataFrame:
        labels = [basins.labelled(a > np.float64(v)) for v in levels]
        parts = []
        for level, label in enumerate(labels):
            at = np.flatnonzero(label)
            if not len(at):
                continue
            found, first, where = np.unique(label.ravel()[at], return_index=True, return_inverse=True)
            own = home.ravel()[at]
            mine, value = where[own], a.ravel()[at][own]
            total = lambda w=None: np.bincount(mine, weights=w, minlength=len(found))  # noqa: B023, E731
            peak = np.full(len(found), -np.inf)
            np.maximum.at(peak, mine, value)
            place = np.stack(np.unravel_index(at[own], a.shape)) + origin[:, None]
            out = {"level": level, "label": base + found, "size": total(), "mass": total(value.astype(float)), **{f"s{x}": total(place[i].astype(float)) for i, x in enumerate(AXES)}, "peak": peak}
            if level + 1 < len(labels):
                out["within"] = base + labels[level + 1].ravel()[at[first]]
            parts.append(pd.DataFrame(out))
            seam = np.argwhere(shared & (label > 0))
            if len(seam):
                parts.append(pd.DataFrame({"level": level, "label": base + label[tuple(seam.T)], **{x: (seam + origin)[:, i] for i, x in enumerate(AXES)}}))
        out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"level": []}, dtype="int32")
        return out.assign(dataset=dataset, t=t).reindex(columns=names).astype(kinds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                a = np.asarray(row.voxels, np.float32).reshape(row.sz, row.sy, row.sx)
                yield pieces_of(row.dataset, row.t, a, *basins.zones(row, a.shape, side), np.array([row.bz, row.by, row.bx]) * side)

    def whole(dataset: str, t: int, a: np.ndarray, _: None) -> pd.DataFrame:
        return pieces_of(dataset, t, a, 0, np.ones(a.shape, bool), np.zeros(a.shape, bool), np.zeros(3, int))

    pieces = written(voxels.each(cut, whole, _PIECE) if isinstance(cut, voxels.Drawn) else cut.mapInPandas(run, _PIECE), "segment-pieces")
    key = ["dataset", "t", "level"]
    least = pieces.filter("z is not null").groupBy(*key, *AXES).agg(F.min("label").alias("_least"), F.collect_set("label").alias("_all"))  # eight blocks at most share a voxel
    links = least.select(*key, "_least", F.explode("_all").alias("label")).filter("label != _least").distinct()
    root = components(links, "label", "_least", tuple(key)).select(*key, F.col("node").alias("label"), "root")
    above = root.select("dataset", "t", (F.col("level") - 1).alias("level"), F.col("label").alias("within"), F.col("root").alias("_up"))
    name = lambda label, level: label * MOST_LEVELS + level
    own = pieces.filter("z is null").join(root, [*key, "label"], "left").join(above, [*key, "within"], "left")
    own = own.withColumns({"segment": name(F.coalesce("root", "label"), F.col("level")), "parent": name(F.coalesce("_up", "within"), F.col("level") + 1)})
    whole = own.groupBy(*key, "segment").agg(F.min("parent").alias("parent"), *[F.sum(c).alias(c) for c in ("size", "mass", "sz", "sy", "sx")], F.max("peak").alias("peak"))
    return whole.select(*key, "segment", "parent", "size", "mass", *[(F.col(f"s{a}") / F.col("size")).alias(a) for a in AXES], "peak")


def scored(segments: DataFrame, levels: Sequence[float]) -> DataFrame:
    """``segments`` with children, merge, height, area and intensity.

    ``merge``: the threshold at which a segment first lies in one that holds several of the level above it, the lowest
    threshold where none does; ``height``: the peak over that; ``intensity``: the mean value. A round for each level.
    """
    key = ["dataset", "t", "segment"]
    with scratch(segments.sparkSession) as keep:
        kids = segments.filter("parent is not null").groupBy("dataset", "t", F.col("parent").alias("segment")).agg(F.count(F.lit(1)).alias("children"))
        base = keep(segments.join(kids, key, "left").fillna(0, ["children"]), "segments")
        done = keep(base.filter(F.col("level") == len(levels) - 1).withColumn("merge", F.lit(float(levels[-1]))), "0")
        parts = [done]
        for level in range(len(levels) - 2, -1, -1):
            up = parts[-1].select("dataset", "t", F.col("segment").alias("parent"), F.when(F.col("children") > 1, F.lit(float(levels[level + 1]))).otherwise(F.col("merge")).alias("merge"))
            parts.append(keep(base.filter(F.col("level") == level).join(up, ["dataset", "t", "parent"]).select(*base.columns, "merge"), f"level-{level}"))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return written(out.withColumns({"height": F.col("peak") - F.col("merge"), "area": F.col("size").cast("double"), "intensity": F.col("mass") / F.col("size")}), "scored-segments")


def labelled_by(segments: DataFrame, truth: DataFrame, ruler: float, spacing: Spacing = Spacing()) -> tuple[DataFrame, DataFrame]:
    """``segments`` with is_real: the nearest of its frame (of equals the least name) to some truth point within the ruler;
    and dataset, n_truth, contained: truth points that have a segment within it. Frames without truth aren't judged."""
    um = segments.select("dataset", "t", F.col("segment").alias("node_id"), *[(F.col(a) * getattr(spacing, a)).alias(f"u{a}") for a in AXES])
    pairs = joins.gated(truth.select("dataset", "node_id", "t", "uz", "uy", "ux"), um, ruler)
    best = pairs.groupBy("a_dataset", "a_t", "a_node_id").agg(F.min(F.struct("d", "b_node_id")).alias("_m"))
    hit = best.select(F.col("a_dataset").alias("dataset"), F.col("a_t").alias("t"), F.col("_m.b_node_id").alias("segment"))
    known = truth.select("dataset", "t").distinct()
    real = segments.join(known, ["dataset", "t"], "left_semi").join(hit.distinct().withColumn("is_real", F.lit(True)), ["dataset", "t", "segment"], "left").fillna(False, ["is_real"])
    within = truth.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_truth")).join(hit.groupBy("dataset").agg(F.count(F.lit(1)).alias("contained")), "dataset", "left").fillna(0, ["contained"])
    return real, within


def _segments(pen: voxels.Pen, t: np.ndarray, points: np.ndarray, levels: Sequence[float], sizes: tuple[int, int]) -> pd.DataFrame:
    """``scored`` segments of a block of frames whose size lies between two bounds: t, segment, z, y, x (means), height, area, intensity.

    The voxels of all the block's frames are labelled together at each level; only those above the lowest threshold are looked at.
    """
    when, at, value, low, high, held = [], [], [], [], [], 0
    shape = pen.shape
    for frame, _, a in pen.frames(t, points):
        shape, voxel = a.shape, np.flatnonzero(a > np.float64(levels[-1]))
        p, q = basins.neighbours(voxel, a.shape)
        when.append(np.full(len(voxel), frame)), at.append(voxel), value.append(a.ravel()[voxel]), low.append(p + held), high.append(q + held)
        held += len(voxel)
    when, at, value, low, high = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (when, at, value, low, high))
    place = np.unravel_index(at, shape)
    below, kids, merge, parts = None, None, None, []
    for level in range(len(levels) - 1, -1, -1):
        over = value > np.float64(levels[level])
        own = np.flatnonzero(over)
        number = np.cumsum(over) - 1
        both = over[low] & over[high]
        root = basins.joined(len(own), number[low[both]], number[high[both]])
        heads = np.flatnonzero(root == np.arange(len(root)))
        piece = (np.cumsum(root == np.arange(len(root))) - 1)[root] if len(root) else root
        n = len(heads)
        total = lambda w=None: np.bincount(piece, weights=w, minlength=n)  # noqa: B023, E731
        v = value[own].astype(float)
        peak = np.full(n, -np.inf)
        np.maximum.at(peak, piece, v)
        size = total()
        if below is None:
            here = np.full(n, float(levels[-1]))
        else:
            up = below[own[heads]]
            kids = np.bincount(up, minlength=len(merge))
            here = np.where(kids[up] > 1, float(levels[level + 1]), merge[up])
        below, merge = np.full(len(at), -1), here
        below[own] = piece
        first = own[heads]
        out = {"t": when[first], "segment": (at[first] + 1) * MOST_LEVELS + level, **{x: total(place[i][own].astype(float)) / size for i, x in enumerate(AXES)}, "height": peak - merge, "area": size.astype(float), "intensity": total(v) / size}
        parts.append(pd.DataFrame(out)[(size >= sizes[0]) & (size <= sizes[1])])
    return pd.concat(parts, ignore_index=True)


def _nearest(segments: pd.DataFrame, t: np.ndarray, truth: np.ndarray, spacing: Spacing) -> tuple[np.ndarray, np.ndarray]:
    """For each truth point (in micrometres) the row of the segment of its frame that is nearest, of equals the least name, -1 without any, and how far it is."""
    row, far = np.full(len(t), -1), np.full(len(t), np.inf)
    ordered = segments.sort_values(["t", "segment"])
    frame, index = ordered["t"].to_numpy(), ordered.index.to_numpy()
    um = np.stack([ordered[a].to_numpy() * getattr(spacing, a) for a in AXES])
    for one in np.unique(t):
        mine, asked = slice(*np.searchsorted(frame, [one, one + 1])), np.flatnonzero(t == one)
        if mine.start == mine.stop:
            continue
        d = np.sqrt(sum((truth[asked, i, None] - um[i, mine]) ** 2 for i in range(3)))
        best = d.argmin(axis=1)
        row[asked], far[asked] = index[mine][best], d[np.arange(len(asked)), best]
    return row, far


def _beside(frames: voxels.Drawn, truth: DataFrame, of: Callable[[str, np.ndarray, np.ndarray, pd.DataFrame], pd.DataFrame], levels: Sequence[float], sizes: tuple[int, int], schema: str) -> DataFrame:
    """``of(dataset, frames and places of truth, segments)`` for each block of frames, which a task draws, labels and scores."""
    if not 1 <= len(levels) <= MOST_LEVELS or any(a <= b for a, b in zip(levels, levels[1:], strict=False)):
        raise ValueError(f"levels must fall, and be 1 to {MOST_LEVELS}")
    pen, block = frames.pen, F.floor(F.col("t") / voxels.BLOCK)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(points: pd.DataFrame, real: pd.DataFrame) -> pd.DataFrame:
        segments = _segments(pen, points["t"].to_numpy(), points[list(AXES)].to_numpy(float), levels, sizes)
        dataset = (points if len(points) else real)["dataset"].iloc[0]
        return of(dataset, real["t"].to_numpy(), real[["uz", "uy", "ux"]].to_numpy(float), segments)[names]

    dealt = frames.points.select("dataset", "t", *AXES, block.alias("_block")).transform(spread("dataset", "_block"))
    known = truth.select("dataset", "t", "uz", "uy", "ux", block.alias("_block")).transform(spread("dataset", "_block"))
    return dealt.groupBy("dataset", "_block").cogroup(known.groupBy("dataset", "_block")).applyInPandas(run, schema)


def drawn_real(frames: voxels.Drawn, levels: Sequence[float], sizes: tuple[int, int], truth: DataFrame, ruler: float, spacing: Spacing = Spacing()) -> DataFrame:
    """The segments of ``tree``, ``scored``, of a size within bounds and ``labelled_by`` truth, all where frames are drawn: dataset, t, segment, height, area, intensity, is_real."""

    def of(dataset: str, t: np.ndarray, real: np.ndarray, segments: pd.DataFrame) -> pd.DataFrame:
        row, far = _nearest(segments, t, real, spacing)
        hit = np.zeros(len(segments), bool)
        hit[row[far <= ruler]] = True
        return segments.assign(dataset=dataset, is_real=hit)[np.isin(segments["t"], t)]

    return _beside(frames, truth, of, levels, sizes, "dataset string, t int, segment long, height double, area double, intensity double, is_real boolean")


def drawn_containment(frames: voxels.Drawn, levels: Sequence[float], sizes: tuple[int, int], truth: DataFrame, rulers: Sequence[float], spacing: Spacing = Spacing()) -> DataFrame:
    """dataset, n_truth, contained, ruler: truth points that have a segment (of a size within bounds) within each ruler."""

    def of(dataset: str, t: np.ndarray, real: np.ndarray, segments: pd.DataFrame) -> pd.DataFrame:
        far = _nearest(segments, t, real, spacing)[1] if len(t) else np.zeros(0)
        return pd.DataFrame({"dataset": dataset, "n_truth": len(t), "contained": [int((far <= r).sum()) for r in rulers], "ruler": [float(r) for r in rulers]})

    counts = _beside(frames, truth, of, levels, sizes, "dataset string, n_truth long, contained long, ruler double")
    return counts.groupBy("dataset", "ruler").agg(F.sum("n_truth").alias("n_truth"), F.sum("contained").alias("contained")).filter("n_truth > 0").select("dataset", "n_truth", "contained", "ruler")


def separation(judged: DataFrame, score: str, targets: Sequence[float] = (0.02, 0.05, 0.10)) -> DataFrame:
    """dataset, score, n_pos, n_neg, auc and for each target what share of false segments lies below the real ones' quantile there.

    Datasets without real or without false segments have a null auc and no cut or no share.
    """
    cuts = judged.filter("is_real").groupBy("dataset").agg(*[F.percentile(score, float(x)).alias(f"_q{i}") for i, x in enumerate(targets)])
    below = judged.filter("not is_real").join(cuts, "dataset", "left").groupBy("dataset").agg(*[F.avg((F.col(score) < F.col(f"_q{i}")).cast("double")).alias(f"recall_at_{round(100 * x)}") for i, x in enumerate(targets)])
    auc = scoring.auc(judged.select("dataset", score, "is_real"), score, "is_real", ("dataset",))
    return auc.join(below, "dataset", "left").withColumn("score", F.lit(score))
