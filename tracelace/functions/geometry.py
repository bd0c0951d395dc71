"""Scalar geometry as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spacing:
    """Micrometres per voxel."""

    z: float = 1.625
    y: float = 0.40625
    x: float = 0.40625


AXES = ("z", "y", "x")


def to_um(df: DataFrame, spacing: Spacing = Spacing()) -> DataFrame:
    """With uz, uy and ux: the coordinates in micrometres."""
    return df.withColumns({f"u{a}": F.col(a) * F.lit(getattr(spacing, a)) for a in AXES})


def to_voxels(df: DataFrame, spacing: Spacing = Spacing()) -> DataFrame:
    """With z, y and x from uz, uy and ux, as numbers that needn't be whole."""
    return df.withColumns({a: F.col(f"u{a}") / F.lit(getattr(spacing, a)) for a in AXES})


def radius_voxels(radius: Column, spacing: Spacing = Spacing()) -> Column:
    """An isotropic radius in voxels along each axis."""
    return F.struct(*[(radius / F.lit(getattr(spacing, a))).alias(a) for a in AXES])


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squared(dz: Column, dy: Column, dx: Column) -> Column:
    return dz * dz + dy * dy + dx * dx


def distance(a: str = "", b: str = "") -> Column:
    """Between the points uz, uy, ux with the prefixes ``a`` and ``b``."""
    return F.sqrt(squared(*[F.col(f"{a}u{k}") - F.col(f"{b}u{k}") for k in AXES]))


def norm(*parts: Column) -> Column:
    return F.sqrt(squared(*parts))


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cosine(a: tuple[Column, ...], b: tuple[Column, ...], degenerate: float | None = None) -> Column:
    """The cosine between two steps; ``degenerate`` (null by default) where either has no length."""
    size = norm(*a) * norm(*b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(degenerate).cast("double"))


def whole_voxel(c: Column) -> Column:
    """Rounded half to even, and 0 at least."""
    return F.greatest(F.rint(c), F.lit(0.0)).cast("int")


def normalised(v: Column, low: Column, high: Column) -> Column:
    """Intensity between two levels, clipped to 0 and 1; 0 where the levels meet."""
    return F.when(high > low, F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def windowed(v: Column, low: Column, high: Column) -> Column:
    """Intensity in units of a window, clipped below only; the window is 1e-6 wide at least."""
    return F.greatest((v - low) / F.greatest(high - low, F.lit(1e-6)), F.lit(0.0))


def guarded_probability(p: Column) -> Column:
    """A probability as it is; anything else is read as a logit, clipped to 20 either way."""
    return F.when(p.between(0.0, 1.0), p).otherwise(1 / (1 + F.exp(-F.least(F.greatest(p, F.lit(-20.0)), F.lit(20.0)))))


def logit_floor(threshold: float) -> float:
    """The logit at or above which a probability is at or above the threshold; infinite at 0 and 1."""
    import math

    if threshold <= 0:
        return -math.inf
    return math.inf if threshold >= 1 else math.log(threshold / (1 - threshold))


def at_face(coordinate: Column, low: Column, high: Column, margin: Column) -> Column:
    """Within the margin of either face of a volume."""
    return F.least(coordinate - low, high - coordinate) <= margin


def motion_log_likelihood(d: Column, sigma: Column) -> Column:
    return -(d * d) / (2 * sigma * sigma)


def log_probability(p: Column, floor: float = 1e-12) -> Column:
    return F.ln(F.greatest(p, F.lit(floor)))


def harmonic_fusion(forward: Column, reverse: Column, weight: float) -> Column:
    """The weighted harmonic mean of two probabilities of one link."""
    return forward * reverse / F.greatest((1 - weight) * reverse + weight * forward, F.lit(1e-12))


def scaled_jaccard(jaccard: Column, signed_ratio: Column, clamped: bool = False) -> Column:
    """Jaccard less a tenth of the signed excess of nodes, 0 at least; ``clamped``: too few nodes earn nothing."""
    factor = 1 - 0.1 * signed_ratio
    return F.greatest(F.lit(0.0), jaccard * (F.least(F.lit(1.0), factor) if clamped else factor))


def prefix_of(name: Column) -> Column:
    return F.split_part(name, F.lit("_"), F.lit(1))
