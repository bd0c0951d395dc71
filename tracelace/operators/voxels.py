"""Frames as arrays of voxels: peaks, blob responses, normalisation and pooling, one frame at a time in numpy.

A frame is a row (dataset, t, shape array<int>, voxels array<float>) in z, y, x order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import product
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from tracelace.functions.geometry import once
from tracelace.operators.groups import spread

FRAME = "dataset string, t int, shape array<int>, voxels array<float>"
#: Frames of a block that a task takes as one group, where frames are drawn.
BLOCK = 16
#: The steps to a voxel's neighbours.
_AROUND = [d for d in product((-1, 0, 1), repeat=3) if any(d)]


@dataclass(frozen=True)
class Pen:
    """How a task draws frames: their extent, the spots' width, and the steps that a frame is put through."""

    shape: tuple[int, int, int]
    sigma: float
    steps: tuple[Callable[[np.ndarray], np.ndarray], ...] = ()

    def put(self, a: np.ndarray) -> np.ndarray:
        for step in self.steps:
            a = step(a).astype(np.float32)
        return a

    def frames(self, t: np.ndarray, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each frame's number, the rows of ``points`` that lie in it, and the frame, one at a time."""
        order = np.argsort(t, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(t[order])) + 1):
            if len(rows):
                yield int(t[rows[0]]), rows, self.put(spots(points[rows], self.shape, self.sigma))


@dataclass(frozen=True)
class Drawn:
    """Frames that are rendered from points in the task that reads them, under the rules of ``rendered``, and put through ``steps``.

    A frame so drawn is neither written nor sent: what is shuffled are the points, and each reader draws anew.
    """

    points: DataFrame
    shape: tuple[int, int, int]
    sigma: float
    steps: tuple[Callable[[np.ndarray], np.ndarray], ...] = ()

    @property
    def pen(self) -> Pen:
        return Pen(self.shape, self.sigma, self.steps)


Frames = DataFrame | Drawn


def grouped(frames: Drawn, by: DataFrame | None = None, columns: tuple[str, ...] = ("dataset", "t", "z", "y", "x")) -> GroupedData:
    """The points that frames are drawn from by blocks of ``BLOCK`` frames; with ``value`` of their dataset."""
    slim = frames.points.select(*columns, F.floor(F.col("t") / BLOCK).alias("_block"))
    slim = slim if by is None else slim.join(by, "dataset")
    return slim.transform(spread("dataset", "_block")).groupBy("dataset", "_block")


def each(frames: Frames, of: Callable[[str, int, np.ndarray, Any], pd.DataFrame | list[tuple]], schema: str, by: DataFrame | None = None) -> DataFrame:
    """The rows that ``of(dataset, t, array, value)`` gives of each frame; ``by`` (dataset, value) has a row for each dataset that counts."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def rows(dataset: str, t: int, a: np.ndarray, value: Any) -> pd.DataFrame:
        out = of(dataset, t, a, value)
        return out if isinstance(out, pd.DataFrame) else pd.DataFrame(out, columns=columns)

    def stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield rows(row.dataset, row.t, np.asarray(row.voxels, np.float32).reshape(tuple(row.shape)), getattr(row, "value", None))

    if isinstance(frames, DataFrame):
        slim = frames.select("dataset", "t", "shape", "voxels")
        return (slim if by is None else slim.join(by, "dataset")).mapInPandas(stored, schema)
    pen = frames.pen

    def drawn(pdf: pd.DataFrame) -> pd.DataFrame:
        value, out, whole = pdf["value"].iloc[0] if "value" in pdf else None, [], []
        for t, _, a in pen.frames(pdf["t"].to_numpy(), pdf[["z", "y", "x"]].to_numpy(float)):
            got = of(pdf["dataset"].iloc[0], t, a, value)
            (whole if isinstance(got, pd.DataFrame) else out).extend([got] if isinstance(got, pd.DataFrame) else got)
        return pd.concat(whole, ignore_index=True) if whole else pd.DataFrame(out, columns=columns)

    return grouped(frames, by).applyInPandas(drawn, schema)


def mapped(frames: Frames, f: Callable[[np.ndarray], np.ndarray]) -> Frames:
    """Each frame through a function of its array."""
    if isinstance(frames, Drawn):
        return replace(frames, steps=(*frames.steps, f))

    def run(dataset: str, t: int, a: np.ndarray, _: Any) -> pd.DataFrame:
        a = f(a)
        return pd.DataFrame([(dataset, t, list(a.shape), a.astype(np.float32).ravel())], columns=["dataset", "t", "shape", "voxels"])

    return each(frames, run, FRAME)


def windowed(a: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip((a - low) / max(high - low, 1e-6), 0, None)


def per_slice(a: np.ndarray, low: float = 1.0, high: float = 99.8) -> np.ndarray:
    """Each z slice between its own percentiles, clipped below only."""
    lo, hi = np.percentile(a, [low, high], axis=(1, 2), keepdims=True)
    return np.clip((a - lo) / np.maximum(hi - lo, 1e-6), 0, None)


def pooled(a: np.ndarray, factor: int) -> np.ndarray:
    """Means over factor x factor blocks of y and x; ragged edges are cropped."""
    z, y, x = a.shape
    y, x = y // factor * factor, x // factor * factor
    if factor == 2:  # the sums that the mean below takes, in its order
        rows = a[:, :y, :x:2] + a[:, :y, 1:x:2]
        return (rows[:, ::2] + rows[:, 1::2]) / 4
    return a[:, :y, :x].reshape(z, y // factor, factor, x // factor, factor).mean(axis=(2, 4))


def _along(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """``a`` under the kernel along one axis, edges mirrored; the taps are added in their order."""
    r, n = len(kernel) // 2, a.shape[axis]
    padded = np.pad(a, [(r, r) if k == axis else (0, 0) for k in range(a.ndim)], mode="symmetric")
    out, part = np.zeros(a.shape), np.empty(a.shape)
    at = [slice(None)] * a.ndim
    for i, w in enumerate(kernel):
        at[axis] = slice(i, i + n)
        out += np.multiply(padded[tuple(at)], w, out=part)
    return out


def gaussian(a: np.ndarray, sigma: tuple[float, float, float]) -> np.ndarray:
    """Separable smoothing, edges mirrored, four sigmas wide."""
    out = a.astype(float)
    for axis, s in enumerate(sigma):
        if s > 0:
            r = max(1, int(4 * s + 0.5))
            k = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
            out = _along(out, k / k.sum(), axis)
    return out


def dog(a: np.ndarray, sigma: tuple[float, float, float], ratio: float = 1.6) -> np.ndarray:
    """Difference of Gaussians, positive on bright blobs."""
    return gaussian(a, sigma) - gaussian(a, tuple(ratio * s for s in sigma))


def peaks_of(a: np.ndarray, radius: tuple[int, int, int], floor: float) -> list[tuple[int, int, int, float]]:
    """Local maxima strictly above the floor in a box window; a plateau is one peak, at the voxel nearest its centre of mass."""
    padded = np.pad(a, [(r, r) for r in radius], constant_values=-np.inf)
    at = np.flatnonzero(a > floor)
    own = a.ravel()[at]
    corner = np.ravel_multi_index(np.unravel_index(at, a.shape), padded.shape)
    flat = padded.ravel()
    for d in np.ndindex(*(2 * r + 1 for r in radius)):
        high = flat[corner + np.ravel_multi_index(d, padded.shape)] <= own
        if not high.all():
            at, own, corner = at[high], own[high], corner[high]
    return _plateaus(a, np.unravel_index(at, a.shape))


def _plateaus(a: np.ndarray, tops: tuple[np.ndarray, ...]) -> list[tuple[int, int, int, float]]:
    """One peak for each plateau of the voxels that are tops, at the voxel nearest its centre of mass."""
    todo = set(zip(*(x.tolist() for x in tops), strict=True))
    out = []
    while todo:
        stack, plateau = [todo.pop()], []
        while stack:
            p = stack.pop()
            plateau.append(p)
            for d in _AROUND if todo else ():
                q = (p[0] + d[0], p[1] + d[1], p[2] + d[2])
                if q in todo:
                    todo.remove(q)
                    stack.append(q)
        if len(plateau) == 1:
            best = plateau[0]
        else:
            middle = np.mean(plateau, axis=0)
            best = min(sorted(plateau), key=lambda p: float(((np.array(p) - middle) ** 2).sum()))
        out.append((*best, float(a[best])))
    return sorted(out)


def peaks(frames: Frames, radius: tuple[int, int, int], floor: float) -> DataFrame:
    """dataset, t, z, y, x, v of every peak of every frame."""
    return each(frames, lambda dataset, t, a, _: [(dataset, t, *p) for p in peaks_of(a, radius, floor)], "dataset string, t int, z int, y int, x int, v double")


def _spot(sigma: float, reach: int) -> np.ndarray:
    w = np.exp(-(np.arange(-reach, reach + 1.0) ** 2) / (2 * sigma * sigma))
    return (w[:, None, None] * w[:, None] * w).astype(np.float32)


def spots(points: np.ndarray, shape: tuple[int, int, int], sigma: float) -> np.ndarray:
    """A frame with a Gaussian spot for each of the points, the brighter one where spots meet."""
    reach = int(np.ceil(6 * sigma))
    a = np.zeros(shape, np.float32)
    lows = (np.floor(points).astype(int) - reach).tolist()
    highs = (np.ceil(points).astype(int) + reach + 1).tolist()
    alike = _spot(sigma, reach) if (points == np.rint(points)).all() else None  # spots on whole places are one spot, moved
    along = None if alike is not None else [np.exp(-((np.arange(n) - points[:, i, None]) ** 2) / (2 * sigma * sigma)) for i, n in enumerate(shape)]
    (nz, ny, nx) = shape
    for i, ((z0, y0, x0), (z1, y1, x1)) in enumerate(zip(lows, highs, strict=True)):
        z, y, x = max(z0, 0), max(y0, 0), max(x0, 0)
        to_z, to_y, to_x = min(z1, nz), min(y1, ny), min(x1, nx)
        if z >= to_z or y >= to_y or x >= to_x:
            continue
        if alike is not None:
            spot = alike[z - z0 : to_z - z0, y - y0 : to_y - y0, x - x0 : to_x - x0]
        else:
            spot = (along[0][i, z:to_z][:, None, None] * along[1][i, y:to_y][:, None] * along[2][i, x:to_x]).astype(np.float32)
        box = a[z:to_z, y:to_y, x:to_x]
        np.maximum(box, spot, out=box)
    return a


def rendered(nodes: DataFrame, shape: tuple[int, int, int], sigma: float) -> DataFrame:
    """Frames with a Gaussian spot for each point, the brighter one where spots meet; one frame's points at a time.

    A spot fills a box of six sigmas, beyond which it is under 2e-8 and left out.
    """
    return each(Drawn(nodes, shape, sigma), lambda dataset, t, a, _: pd.DataFrame({"dataset": [dataset], "t": [t], "shape": [list(a.shape)], "voxels": [a.ravel()]}), FRAME)


#: What ``_weights`` gave before, by width and extent; a worker's own, as functions travel by value.
_KEPT: dict[tuple[float, int], tuple[np.ndarray, np.ndarray]] = {}


def _weights(s: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A Gaussian's taps, as ``gaussian`` has them, and the matrix that smooths ``n`` voxels with edges mirrored, in single precision."""
    if (s, n) not in _KEPT:
        k = np.ones(1)
        if s > 0:
            r = max(1, int(4 * s + 0.5))
            k = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
            k = k / k.sum()
        _KEPT[s, n] = k, _along(np.eye(n), k, 0).astype(np.float32)
    return _KEPT[s, n]


def _rough(a: np.ndarray, sigma: tuple[float, ...]) -> np.ndarray:
    """``gaussian`` as three products of matrices, in single precision."""
    z, y, x = (_weights(s, n)[1] for s, n in zip(sigma, a.shape, strict=True))
    out = np.matmul(y, (z @ a.reshape(a.shape[0], -1)).reshape(a.shape))
    return (out.reshape(-1, a.shape[2]) @ x.T).reshape(a.shape)


def _gaussian_at(a: np.ndarray, sigma: tuple[float, ...], at: tuple[np.ndarray, ...]) -> np.ndarray:
    """``gaussian`` at some voxels alone, to the last bit: the taps are added in the same order."""
    taps = [_weights(s, n)[0] for s, n in zip(sigma, a.shape, strict=True)]
    padded = np.pad(a, [(len(k) // 2,) * 2 for k in taps], mode="symmetric")
    around = np.lib.stride_tricks.sliding_window_view(padded, tuple(len(k) for k in taps))
    out = [np.zeros(0)]
    for i in range(0, len(at[0]), 64):
        part = around[tuple(v[i : i + 64] for v in at)]
        for k in taps:
            total = np.zeros((len(part), *part.shape[2:]))
            for j, w in enumerate(k):
                total += part[:, j] * w
            part = total
        out.append(part)
    return np.concatenate(out)


def dog_peaks_of(a: np.ndarray, sigma: tuple[float, float, float], radius: tuple[int, int, int], floor: float, ratio: float = 1.6) -> list[tuple[int, int, int, float]]:
    """``peaks_of`` the difference of Gaussians (in single precision), which is smoothed in full nowhere but where a peak can be.

    Products of matrices give the response to within ``slack``; a voxel that lies further than twice that below one of its
    window is no peak, and the others, and what in their windows may reach them, are reckoned as ``dog`` does.
    """
    wide = tuple(ratio * s for s in sigma)
    slack = 4 * (sum(a.shape) + 32) * 2.0**-24 * float(np.abs(a).max(initial=0.0))
    if not np.isfinite(slack):
        return peaks_of(dog(a, sigma, ratio).astype(np.float32), radius, floor)
    rough = _rough(a, sigma)
    rough -= _rough(a, wide)
    padded = np.pad(rough, [(r, r) for r in radius], constant_values=-np.inf)
    at = np.flatnonzero(rough > floor - slack)
    corner = np.ravel_multi_index(np.unravel_index(at, a.shape), padded.shape)
    flat, least = padded.ravel(), rough.ravel()[at] + 2 * slack
    steps = np.array([np.ravel_multi_index(d, padded.shape) for d in np.ndindex(*(2 * r + 1 for r in radius))])
    for step in steps:
        high = flat[corner + step] <= least
        if not high.all():
            at, least, corner = at[high], least[high], corner[high]
    near = corner[:, None] + steps
    asked = np.unique(near[flat[near] >= (least - 4 * slack)[:, None]])
    places = tuple(x - r for x, r in zip(np.unravel_index(asked, padded.shape), radius, strict=True))
    exact = np.full(padded.shape, -np.inf, np.float32)
    exact.ravel()[asked] = _gaussian_at(a, sigma, places) - _gaussian_at(a, wide, places)
    middle = corner + steps[len(steps) // 2]
    own = exact.ravel()[middle]
    top = (own > floor) & (exact.ravel()[near] <= own[:, None]).all(axis=1)
    inner = exact[tuple(slice(r, r + n) for r, n in zip(radius, a.shape, strict=True))]
    return _plateaus(inner, np.unravel_index(at[top], a.shape))


def dog_peaks(frames: Frames, sigma: tuple[float, float, float], radius: tuple[int, int, int], floor: float, ratio: float = 1.6) -> DataFrame:
    """dataset, t, z, y, x, v of every peak of every frame's difference of Gaussians."""
    return each(frames, lambda dataset, t, a, _: [(dataset, t, *p) for p in dog_peaks_of(a, sigma, radius, floor, ratio)], "dataset string, t int, z int, y int, x int, v double")


def log_response(a: np.ndarray, sigma: tuple[float, float, float]) -> np.ndarray:
    """Minus the Laplacian of the smoothed volume, each axis's second difference times its sigma squared: positive on bright blobs."""
    smooth = gaussian(a, sigma)
    out = np.zeros_like(smooth)
    for axis, s in enumerate(sigma):
        padded = np.pad(smooth, [(1, 1) if k == axis else (0, 0) for k in range(3)], mode="symmetric")
        n = smooth.shape[axis]
        low, high = (padded[tuple(slice(i, i + n) if k == axis else slice(None) for k in range(3))] for i in (0, 2))
        out -= s * s * (low - 2 * smooth + high)
    return out


def correlation(a: str, b: str) -> Column:
    """Normalised cross-correlation of two arrays of one length, null where either is flat."""
    total = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    centred = lambda c: once(mean(c), lambda m: F.transform(c, lambda x: x - m))

    def of(p: Column) -> Column:
        return once(F.sqrt(total(p["a"], p["a"]) * total(p["b"], p["b"])), lambda size: F.when(size > 0, total(p["a"], p["b"]) / size))

    return once(F.struct(centred(F.col(a)).alias("a"), centred(F.col(b)).alias("b")), of)
