"""Grid and volume operators: blending and resampling as aggregates, pixel kernels in numpy.

Volumes are rows of blocks; a kernel sees one block with its halo, so tasks stay small and
independent. Grids (sparse voxels as rows) are resampled with plain aggregates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted(value: str, weight: str) -> Column:
    """Weighted mean; 0 where no weight falls."""
    return F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.col(weight).cast("double"))), F.lit(0.0))


def block_mean(grid: DataFrame, factors: dict[str, int], value: str) -> DataFrame:
    """Mean over blocks of a grid."""
    return grid.groupBy(*[F.floor(F.col(a) / f).alias(a) for a, f in factors.items()]).agg(F.avg(value).alias(value))


def halve(grid: DataFrame, axis: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Mean of neighbouring pairs along an axis that starts at 0; an odd tail is dropped."""
    keys = keys or []
    size = grid.agg((F.max(axis) + 1).alias("__n"))
    even = grid.join(F.broadcast(size)).filter(F.col(axis) < F.floor(F.col("__n") / 2) * 2)
    return even.groupBy(*keys, F.floor(F.col(axis) / 2).alias(axis)).agg(F.avg(value).alias(value))


def pyramid_weight(p: list[Column], lower: list[Column], upper: list[Column]) -> Column:
    """Blend weight: least distance to a face of the box."""
    return F.greatest(F.lit(0.0), F.least(*[F.least(v - a, b - v) for v, a, b in zip(p, lower, upper, strict=True)]))


def radial_shift(x: Column, y: Column, cx: float, cy: float, cutoff: float, shift: float) -> tuple[Column, Column]:
    """Source coordinates of a radial correction: beyond the cutoff a radius grows linearly up to ``shift`` at the corner."""
    dx, dy = x - cx, y - cy
    r = F.sqrt(dx * dx + dy * dy)
    far = math.hypot(cx, cy)
    grown = F.when(r > cutoff, r + (r - cutoff) * shift / (far - cutoff)).otherwise(r)
    k = F.coalesce(F.try_divide(grown, r), F.lit(1.0))
    return F.lit(cx) + dx * k, F.lit(cy) + dy * k


# ---- numpy kernels on one block ----


#: Side of the squares whose medians are taken together, without their rims.
_SQUARE = 64


def _square_medians(v: np.ndarray, w: int) -> np.ndarray:
    """Medians of the w x w windows (w odd) inside one square plane. Values become ranks, ranks fall into as
    many bins as the side has voxels: tables of running sums count the values up to each bin in any window with
    four lookups, and the bin of the median holds so few places that each is tested for lying in the window.
    Neither step depends on w."""
    n, m = v.shape
    order = np.argsort(v, axis=None)
    size = max(n, m)  # ranks in a bin, and at least as many as there are bins
    bins = -(-v.size // size)
    small = np.min_scalar_type(n + m + w)
    bin_of = np.empty(v.size, dtype=small)
    bin_of[order] = np.arange(v.size) // size
    # upto[i, j, b]: places before row i and column j whose bin is at most b
    upto = np.zeros((n + 1, m + 1, bins), dtype=np.min_scalar_type(v.size))
    upto[1:, 1:] = bin_of.reshape(n, m)[:, :, None] <= np.arange(bins, dtype=small)
    for i in range(1, n + 1):
        upto[i] += upto[i - 1]
    for j in range(1, m + 1):
        upto[:, j] += upto[:, j - 1]
    inside = upto[w:, w:] - upto[:-w, w:]
    inside -= upto[w:, :-w]
    inside += upto[:-w, :-w]
    middle = w * w // 2
    of = np.einsum("ijk->ij", (inside <= middle).astype(small))
    before = np.take_along_axis(inside, np.maximum(of.astype(np.int64) - 1, 0)[:, :, None], axis=2)[:, :, 0]
    left = (middle - np.where(of > 0, before, 0).astype(np.int64)).ravel()
    place = np.full(bins * size, v.size, dtype=np.int64)
    place[: v.size] = order
    # places of the last bin that do not exist lie in a row that no window has
    row, col = (x.astype(small).reshape(bins, size) for x in (np.where(place < v.size, place // m, n + w), place % m))
    top, side = (x.ravel().astype(small)[:, None] for x in np.indices(of.shape))
    # unsigned differences wrap, so places before the window lie beyond it
    hit = ((row[of.ravel()] - top) < w) & ((col[of.ravel()] - side) < w)
    start = np.cumsum(np.einsum("ij->i", hit.astype(np.min_scalar_type(size))), dtype=np.int64)
    start = np.r_[0, start[:-1]]
    nth = np.flatnonzero(hit)[start + left] % size
    return v.ravel()[place[of.ravel() * np.int64(size) + nth]].reshape(of.shape)


def background_subtract(v: np.ndarray, radius: int) -> np.ndarray:
    """Minus the median of the (2r+1) x (2r+1) window in the first two axes; edges mirrored. Planes are cut
    into squares with rims, so memory does not grow with the block. NaN counts as the largest value."""
    if radius <= 0:
        return v
    padded = np.pad(v, ((radius, radius), (radius, radius), (0, 0)), mode="reflect")
    out = np.empty(v.shape, dtype=np.result_type(v, np.float32))
    for x in range(0, v.shape[0], _SQUARE):
        for y in range(0, v.shape[1], _SQUARE):
            at = slice(x, x + _SQUARE), slice(y, y + _SQUARE)
            rim = padded[x : x + _SQUARE + 2 * radius, y : y + _SQUARE + 2 * radius]
            for z in range(v.shape[2]):
                out[(*at, z)] = v[(*at, z)] - _square_medians(np.ascontiguousarray(rim[:, :, z]), 2 * radius + 1)
    return out


def gaussian(v: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian of radius int(4 sigma + 0.5), edges repeated by mirroring."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = v.astype(np.float64)
    for axis in range(v.ndim):
        pad = [(r, r) if a == axis else (0, 0) for a in range(v.ndim)]
        windows = np.lib.stride_tricks.sliding_window_view(np.pad(out, pad, mode="symmetric"), 2 * r + 1, axis=axis)
        out = windows @ k
    return out


def difference_of_gaussian(v: np.ndarray, sigma: float, steps: int = 4) -> np.ndarray:
    k = 2 ** (1 / steps)
    applied = [math.sqrt(max(s * s - 0.25, 1e-6)) for s in (sigma, sigma * k)]
    return (gaussian(v, applied[0]) - gaussian(v, applied[1])) / (k - 1)


def peaks(v: np.ndarray, least: float) -> np.ndarray:
    """Interior voxels above all 26 neighbours and at least ``least``: rows of indices."""
    core = v[1:-1, 1:-1, 1:-1]
    best = core >= least
    n = v.shape
    for d in np.ndindex(3, 3, 3):
        if d != (1, 1, 1):
            best &= core > v[d[0] : n[0] - 2 + d[0], d[1] : n[1] - 2 + d[1], d[2] : n[2] - 2 + d[2]]
    return np.argwhere(best) + 1


def refine(v: np.ndarray, at: np.ndarray, moves: int = 10) -> np.ndarray:
    """Sub-voxel places by a quadratic fit; a fit that leaves its voxel moves to the neighbour. All
    places that still move are fitted together."""
    out, p = at.astype(np.float64), at.copy()
    active = np.arange(len(at))
    axes = np.eye(3, dtype=int)
    for move in range(moves):
        if not len(active):
            break
        c = lambda d: v[tuple((p[active] + d).T)].astype(np.float64)  # noqa: E731, B023
        centre, g, h = c(0), np.empty((len(active), 3)), np.empty((len(active), 3, 3))
        for i, e in enumerate(axes):
            up, down = c(e), c(-e)
            g[:, i], h[:, i, i] = (up - down) / 2, up + down - 2 * centre
            for j in range(i):
                f = axes[j]
                h[:, i, j] = h[:, j, i] = (c(e + f) - c(e - f) - c(f - e) + c(-e - f)) / 4
        solvable = np.abs(np.linalg.det(h)) >= 1e-12
        active, g, h = active[solvable], g[solvable], h[solvable]
        if not len(active):
            break
        step = -np.linalg.solve(h, g[:, :, None])[:, :, 0]
        settled = np.all(np.abs(step) <= 0.5 + 0.1 * move, axis=1)
        out[active[settled]] = p[active[settled]] + step[settled]
        active, step = active[~settled], step[~settled]
        p[active] = np.clip(p[active] + np.sign(step).astype(int) * (np.abs(step) > 0.5), 1, np.array(v.shape) - 2)
    return out


def sample_linear(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at sub-voxel places from the 8 voxels around each; beyond the faces mirrored (the edge
    voxel is repeated)."""
    low = np.floor(at).astype(int)
    part = at - low
    out = np.zeros(len(at))
    for d in np.ndindex(2, 2, 2):
        corner = [np.where((i := (low[:, a] + d[a]) % (2 * n)) < n, i, 2 * n - 1 - i) for a, n in enumerate(v.shape)]
        out += v[tuple(corner)] * np.where(d, part, 1 - part).prod(axis=1)
    return out


def resample_nearest(v: np.ndarray, inverse: np.ndarray, shape: tuple[int, int, int], origin=(0, 0, 0)) -> np.ndarray:
    """Output block whose voxels take the nearest input voxel under the inverse model; 0 outside."""
    grid = np.stack(np.meshgrid(*[np.arange(n) + o for n, o in zip(shape, origin, strict=True)], indexing="ij"), axis=-1)
    at = np.rint(grid @ inverse[:, :3].T + inverse[:, 3]).astype(int)
    inside = np.all((at >= 0) & (at < np.array(v.shape)), axis=-1)
    at = np.clip(at, 0, np.array(v.shape) - 1)
    return np.where(inside, v[at[..., 0], at[..., 1], at[..., 2]], 0)


def block_sum(data: str, kind: str | None = None) -> Column:
    """Sum of a block: of float64, or of the kind that a column names."""

    @F.pandas_udf("double")
    def total(blocks: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([float(np.frombuffer(b, dtype=k).sum(dtype=np.float64)) for b, k in zip(blocks, kinds, strict=True)])

    return total(data, F.col(kind) if kind else F.lit("<f8"))
