"""Interest point detection over volumes as rows of blocks.

A volume is cut into blocks with a halo as wide as the filters reach; a block is one row, filtered by
one task, and owns the peaks of its core, so nothing is found twice and blocks need not meet again.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import arrays
from . import volume

BLOCK = "x0 long, y0 long, z0 long, nx int, ny int, nz int, cx0 long, cy0 long, cz0 long, cx1 long, cy1 long, cz1 long, data binary"


def reach(sigma: float, median_radius: int = 0, steps: int = 4, moves: int = 2) -> int:
    """Voxels beyond a peak that its value and refinement may depend on."""
    wide = math.sqrt(max((sigma * 2 ** (1 / steps)) ** 2 - 0.25, 1e-6))
    return int(4 * wide + 0.5) + median_radius + 1 + moves


def rasterize(voxels: DataFrame, view: str, shape: tuple[int, int, int], block: tuple[int, int, int], halo: int, value: str = "value") -> DataFrame:
    """Blocks of views from their voxels (view, x, y, z, value; absent ones are 0): view and ``BLOCK``. The
    halo ends at the faces of the volume. A voxel is sent to every block whose halo holds it."""
    parts = voxels
    for a, n, b in zip("xyz", shape, block, strict=True):
        first = F.greatest(F.lit(0), F.floor((F.col(a) - halo) / b))
        last = F.least(F.lit(-(-n // b) - 1), F.floor((F.col(a) + halo) / b))
        parts = parts.withColumn(f"b{a}", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    kind = voxels.schema[view].dataType.simpleString()

    def run(f):
        import pandas as pd

        at = [int(f[f"b{a}"].iloc[0]) * b for a, b in zip("xyz", block, strict=True)]
        end = [min(o + b, n) for o, b, n in zip(at, block, shape, strict=True)]
        lo = [max(0, o - halo) for o in at]
        size = [min(n, e + halo) - o for n, e, o in zip(shape, end, lo, strict=True)]
        v = np.zeros(size, dtype="<f4")
        np.add.at(v, tuple(f[a].to_numpy() - o for a, o in zip("xyz", lo, strict=True)), f[value].to_numpy())
        return pd.DataFrame([(f[view].iloc[0], *lo, *size, *at, *end, v.tobytes())], columns=[view, *[c.split()[0] for c in BLOCK.split(", ")]])

    inside = [F.col(a).between(0, n - 1) for a, n in zip("xyz", shape, strict=True)]
    return parts.filter(inside[0] & inside[1] & inside[2]).groupBy(view, "bx", "by", "bz").applyInPandas(run, f"{view} {kind}, {BLOCK}")


def stored_blocks(files: DataFrame, view: str, block: tuple[int, int, int], factor: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """view, uri, n0..n2, c0..c2, e0..e2: the blocks of the stored arrays of ``files`` (view, uri, size), as rows without
    voxels, in voxels of the volume downsampled by ``factor``: its shape, and first and last + 1 voxel of the
    block's core. A size, where there is one, ends the array before padding does."""
    rows = files.join(arrays.shapes(files.sparkSession, files.select("uri").distinct()).select("uri", "shape"), "uri")
    for d in range(3):
        n = F.floor(F.least(F.get("shape", F.lit(d)), F.get("size", F.lit(d)).cast("long")) / factor[d])  # least skips nulls
        rows = rows.withColumn(f"n{d}", n).filter(F.col(f"n{d}") > 0)
        rows = rows.withColumn(f"c{d}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{d}") - 1, F.lit(block[d]).cast("long"))))
        rows = rows.withColumn(f"e{d}", F.least(F.col(f"c{d}") + block[d], f"n{d}"))
    return rows.select(view, "uri", *[f"{k}{d}" for k in "nce" for d in range(3)])


def read_stored(wanted: DataFrame, view: str, halo: int, factor: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """view and ``BLOCK`` of rows of ``stored_blocks``, with their halo; read by executors, a block at a time."""
    kind = wanted.schema[view].dataType.simpleString()
    names = [view, *[c.split()[0] for c in BLOCK.split(", ")]]

    def run(frames):
        import pandas as pd

        for f in frames:
            for r in f.itertuples(index=False):
                core = [(getattr(r, f"c{d}"), getattr(r, f"e{d}"), getattr(r, f"n{d}")) for d in range(3)]
                lo, hi = [max(0, c - halo) for c, _, _ in core], [min(n, e + halo) for _, e, n in core]
                v = arrays.read_slice(arrays.open_array(r.uri), [a * k for a, k in zip(lo, factor, strict=True)], [b * k for b, k in zip(hi, factor, strict=True)])
                v = np.ascontiguousarray(arrays.averaged(v, factor) if max(factor) > 1 else v, dtype="<f4")
                yield pd.DataFrame([(getattr(r, view), *lo, *v.shape, *[c for c, _, _ in core], *[e for _, e, _ in core], v.tobytes())], columns=names)

    return wanted.repartition(view, "c0", "c1", "c2").mapInPandas(run, f"{view} {kind}, {BLOCK}")


def without_background(blocks: DataFrame, view: str, radius: int) -> DataFrame:
    """The blocks (their halo at least ``radius``) minus the running median in x and y of every voxel."""

    def run(frames):
        for f in frames:
            data = [volume.background_subtract(np.frombuffer(b.data, dtype="<f4").reshape(b.nx, b.ny, b.nz), radius).astype("<f4").tobytes() for b in f.itertuples(index=False)]
            yield f.assign(data=data)

    return blocks.mapInPandas(run, blocks.schema)


def core_voxels(blocks: DataFrame, view: str, least: float) -> DataFrame:
    """view, x, y, z, value of the voxels above ``least`` in the blocks' cores."""
    kind = blocks.schema[view].dataType.simpleString()

    def run(frames):
        import pandas as pd

        for f in frames:
            for b in f.itertuples(index=False):
                core = tuple(slice(lo - o, hi - o) for o, lo, hi in ((b.x0, b.cx0, b.cx1), (b.y0, b.cy0, b.cy1), (b.z0, b.cz0, b.cz1)))
                v = np.frombuffer(b.data, dtype="<f4").reshape(b.nx, b.ny, b.nz)[core]
                at = np.argwhere(v > least)
                found = pd.DataFrame(at + (b.cx0, b.cy0, b.cz0), columns=["x", "y", "z"])
                yield found.assign(value=v[tuple(at.T)].astype(float)).assign(**{view: getattr(b, view)})[[view, "x", "y", "z", "value"]]

    return blocks.mapInPandas(run, f"{view} {kind}, x long, y long, z long, value double")


def detect_block(v: np.ndarray, sigma: float, threshold: float, median_radius: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(peak voxels, their responses, refined places, intensities of the background-subtracted block there)."""
    plain = volume.background_subtract(v.astype(np.float64), median_radius)
    dog = volume.difference_of_gaussian(plain, sigma)
    found = volume.peaks(dog, threshold / 3)
    at = volume.refine(dog, found)
    return found, dog[tuple(found.T)], at, volume.sample_linear(plain, at)


def detect_points(blocks: DataFrame, view: str, sigma: float, threshold: float, median_radius: int = 0) -> DataFrame:
    """view, px, py, pz (peak voxel), response, x, y, z (refined), intensity of the peaks of the blocks'
    cores."""
    kind = blocks.schema[view].dataType.simpleString()
    names = [view, "px", "py", "pz", "response", "x", "y", "z", "intensity"]

    def run(frames):
        import pandas as pd

        for f in frames:
            parts = []
            for b in f.itertuples(index=False):
                v = np.frombuffer(b.data, dtype="<f4").reshape(b.nx, b.ny, b.nz)
                origin = np.array([b.x0, b.y0, b.z0])
                found, response, at, intensity = detect_block(v, sigma, threshold, median_radius)
                found, at = found + origin, at + origin
                core = np.all((found >= [b.cx0, b.cy0, b.cz0]) & (found < [b.cx1, b.cy1, b.cz1]), axis=1)
                rows = pd.DataFrame({"px": found[core, 0], "py": found[core, 1], "pz": found[core, 2], "response": response[core], "x": at[core, 0], "y": at[core, 1], "z": at[core, 2], "intensity": intensity[core]})
                rows.insert(0, view, getattr(b, view))
                parts.append(rows)
            yield pd.concat(parts)[names] if parts else pd.DataFrame(columns=names)

    return blocks.mapInPandas(run, f"{view} {kind}, px long, py long, pz long, response double, x double, y double, z double, intensity double")


def downsample(voxels: DataFrame, view: str, factor_xy: int, factor_z: int, value: str = "value") -> DataFrame:
    """Mean over cells of a view's voxels, in coordinates of the smaller volume."""
    cell = {"x": factor_xy, "y": factor_xy, "z": factor_z}
    count = factor_xy * factor_xy * factor_z
    grouped = voxels.groupBy(view, *[F.floor(F.col(a) / f).alias(a) for a, f in cell.items()])
    return grouped.agg((F.sum(value) / count).alias(value))


def upsampled(points: DataFrame, factor_xy: int, factor_z: int) -> DataFrame:
    """Points of a downsampled volume in coordinates of the full one (centres of cells)."""
    f = {"x": factor_xy, "y": factor_xy, "z": factor_z}
    return points.select(*[((F.col(c) + 0.5) * f[c] - 0.5).alias(c) if c in f else F.col(c) for c in points.columns])


def by_view(chunks: DataFrame, view: list[str], chunk: str) -> DataFrame:
    """The chunks of each view, in order, and how many: rows of references, not of voxels."""
    return chunks.groupBy(*view).agg(F.array_sort(F.collect_list(chunk)).alias("chunks"), F.count("*").alias("n"))
