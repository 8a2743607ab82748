"""Splitting tiles and block layouts: arithmetic on sizes, on the driver or as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.shared import discard, n_tasks, written
from . import spatial


def last_tile(length: int, size: int, overlap: int) -> int:
    """Length of the last tile of an axis cut into tiles of ``size``."""
    last = overlap + int(math.fmod(length - 2 * (size - overlap) - overlap, size - overlap))
    return last if last >= 0 else length + last


def tile_size(length: int, target: int, overlap: int, step: int = 64) -> int:
    """Size near ``target`` with a well-filled last tile: if at ``target`` the last tile is at most half a
    tile, sizes grow by ``step`` until the last tile stops getting shorter; otherwise they shrink as long
    as it gets longer."""
    if length <= target or last_tile(length, target, overlap) == target:
        return min(length, target)
    grow, size, last = last_tile(length, target, overlap) <= target // 2, target, last_tile(length, target, overlap)
    while True:
        following = size + (step if grow else -step)
        if following <= overlap:
            return size
        now = last_tile(length, following, overlap)
        if grow and now >= last:
            return following
        if not grow and now <= last:
            return size
        size, last = following, now


def split_axis(length: int, target: int, overlap: int, step: int = 64) -> list[tuple[int, int]]:
    """Intervals [lo, hi] (ends included) that cover an axis with tiles of ``tile_size`` and fixed
    overlap. An axis no longer than the target is one interval."""
    size = tile_size(length, target, overlap, step)
    out, at = [], 0
    while True:
        hi = min(at + size, length) - 1
        out.append((at, hi))
        if hi == length - 1:
            return out
        at += size - overlap


def split_table(df: DataFrame, length: str, target: int, overlap: int, step: int = 64) -> DataFrame:
    """``df`` with the tile size (``tile``) and the ``intervals`` of each row's axis length. Each distinct
    length is split once, where it lies after the shuffle."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(int(n), tile_size(int(n), target, overlap, step), [{"lo": a, "hi": b} for a, b in split_axis(int(n), target, overlap, step)]) for n in f[length]]
            yield pd.DataFrame(rows, columns=[length, "tile", "intervals"])

    found = df.select(length).distinct().mapInPandas(run, f"{length} {df.schema[length].dataType.simpleString()}, tile int, intervals array<struct<lo: int, hi: int>>")
    return df.join(found, length)


#: Parts that a view may have; part numbers take that many places in the new ids.
PARTS = 1 << 16


def split_views(setups: DataFrame, target: tuple[int, int, int], overlap: tuple[int, int, int], step: int = 64) -> DataFrame:
    """Sub-tiles of each view setup (id, size): id, new_id, lower, upper. Targets and overlaps are
    rounded up to ``step``. A view of more than ``PARTS`` parts is an error: its ids would be another's."""
    up = lambda v: -(-v // step) * step
    found = setups.select("id", *[F.get("size", F.lit(i)).alias(f"s{i}") for i in range(3)])
    for i, (t, o) in enumerate(zip(target, overlap, strict=True)):
        found = split_table(found, f"s{i}", up(t), up(o), step).drop("tile", f"s{i}").withColumnRenamed("intervals", f"v{i}")
    for i in (2, 1, 0):
        found = found.select(*[c for c in found.columns if c != f"v{i}"], F.posexplode(f"v{i}").alias(f"n{i}", f"b{i}"), F.size(f"v{i}").cast("long").alias(f"c{i}"))
    part = F.col("n0") + F.col("c0") * (F.col("n1") + F.col("c1") * F.col("n2"))
    part = F.when(part < PARTS, part).otherwise(F.raise_error(F.lit(f"a view has more than {PARTS} parts")).cast("long"))
    return found.select("id", (F.col("id").cast("long") * PARTS + part).alias("new_id"), *[F.array(*[F.col(f"b{i}.{e}") for i in range(3)]).alias(n) for n, e in (("lower", "lo"), ("upper", "hi"))])


def points_in_parts(points: DataFrame, parts: DataFrame) -> DataFrame:
    """Points (setup, x, y, z, ..) in local coordinates of every part that contains them: an equi-join on
    the setup whose strategy is Spark's choice."""
    inside = G.contains_point([F.get("lower", F.lit(i)) for i in range(3)], [F.get("upper", F.lit(i)) for i in range(3)], [F.col(a) for a in "xyz"])
    found = points.join(parts.withColumnRenamed("id", "setup"), "setup").filter(inside)
    local = {a: F.col(a) - F.get("lower", F.lit(i)) for i, a in enumerate("xyz")}
    keep = [c for c in points.columns if c not in local]
    return found.select("new_id", *keep, *[v.alias(a) for a, v in local.items()])


def n_synthetic(voxels: Column, density: float, least: int, most: int) -> Column:
    """Points to add to an overlap: in proportion to its volume, within bounds."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(voxels * (density / 1e6)))).cast("int")


def synthetic_points(overlaps: DataFrame, key: str, density: float, least: int, most: int, error: float) -> DataFrame:
    """Points in overlap boxes (key, lower, upper, ends included, and further columns, which are kept), as seen by
    both sides with up to half ``error`` of jitter each: key, i, tx.. (the place), px.., qx... Random numbers are
    hashes of key, point and axis, so repeated tasks agree."""
    size = G.voxels([F.get("lower", F.lit(d)) for d in range(3)], [F.get("upper", F.lit(d)) for d in range(3)])
    # overlaps are few bytes and many points
    spread = overlaps.repartition(n_tasks(overlaps.sparkSession), key)
    n = spread.withColumn("i", F.explode(F.sequence(F.lit(1), n_synthetic(size, density, least, most))))
    unit = lambda *salt: F.pmod(F.xxhash64(key, "i", *[F.lit(s) for s in salt]), F.lit(1 << 30)) / float(1 << 30)
    cols = []
    for d, a in enumerate("xyz"):
        lo, hi = F.get("lower", F.lit(d)), F.get("upper", F.lit(d))
        at = lo + unit(d) * (hi - lo + 1)
        cols += [at.alias(f"t{a}"), *[(at + (unit(d, s) - 0.5) * error).alias(f"{s}{a}") for s in "pq"]]
    return n.select(*[c for c in overlaps.columns if c not in ("lower", "upper")], "i", *cols)


def without_crowded(points: DataFrame, key: str, radius: float) -> DataFrame:
    """The synthetic points (key, i, a, b, tx.., px.., qx..) that keep their distance: overlaps are taken in order of
    their key, and a point of an overlap between the view ``a`` and an earlier one ``b`` is left out if a point kept
    in an overlap before lies within ``radius`` in the view ``b``, as that view sees it (p if it is that overlap's
    ``a``, else q).

    Whom a point has to wait for is found once, by an equi-join on views and grid cells. Then in rounds, over the pairs
    of that list alone: a point that waits for one that waits for none goes, and so do the pairs of points that are
    gone; who waits for none any more is kept. Rounds are as many as the longest chain of points that hang on each
    other, whatever the number of overlaps."""
    name = F.struct(F.col(key).alias("k"), "i")
    points = written(points, "points")
    cand = points.select(name.alias("id"), F.col("b").alias("view"), "tx", "ty", "tz")
    sides = [F.struct(F.col(v).alias("view"), *[F.col(f"{s}{a}").alias(f"s{a}") for a in "xyz"]) for v, s in (("a", "p"), ("b", "q"))]
    seen = points.select(name.alias("before"), F.inline(F.array(*sides)))
    near = spatial.radius_join(seen, cand, ["sx", "sy", "sz"], ["tx", "ty", "tz"], radius, ["view"], condition=F.col("before.k") < F.col("id.k"), coarse=2)
    waits = written(near.select("id", "before"), "waits")
    gone = None
    while waits.limit(1).count():
        free = waits.join(waits.select(F.col("id").alias("before")), "before", "left_anti")
        out = written(free.select("id").distinct(), "gone")
        gone = out if gone is None else gone.unionByName(out)
        still = written(waits.join(out, "id", "left_anti").join(out.withColumnRenamed("id", "before"), "before", "left_anti").select("id", "before"), "waits")
        discard(waits)
        waits = still
    discard(waits)
    return points if gone is None else points.withColumn("id", name).join(gone, "id", "left_anti").drop("id")


def slices(df: DataFrame, length: str, block: int, index: str, first: str, end: str) -> DataFrame:
    """``df`` with a row for each block of an axis of ``length``: its index, and [first, end)."""
    last = F.floor((F.col(length) - 1) / block)
    rows = df.filter(F.col(length) > 0).withColumn(index, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.withColumn(first, F.col(index) * block).withColumn(end, F.least(F.col(index) * block + block, F.col(length)))


def block_shape(shape: tuple[int, ...], chunk: tuple[int, ...], itemsize: int, target_bytes: int) -> tuple[int, ...]:
    """Chunk multiple near a target size: axes doubled in turn from the last, or all alike, whichever comes closer."""
    size = lambda b: math.prod(b) * itemsize
    turn, axis = list(chunk), len(chunk) - 1
    for _ in range(64 * len(chunk)):
        if size(turn) >= target_bytes or all(b >= n for b, n in zip(turn, shape, strict=True)):
            break
        if turn[axis] < shape[axis]:
            turn[axis] = min(2 * turn[axis], shape[axis])
        axis = (axis - 1) % len(chunk)
    k = 1
    while size([min(c * (k + 1), n) for c, n in zip(chunk, shape, strict=True)]) <= target_bytes and any(c * k < n for c, n in zip(chunk, shape, strict=True)):
        k += 1
    alike = [min(c * k, n) for c, n in zip(chunk, shape, strict=True)]
    return tuple(min((turn, alike), key=lambda b: abs(size(b) - target_bytes)))


def to_rank(shape: tuple[int, ...], rank: int = 5) -> tuple[int, ...]:
    """Shape with leading ones added, or leading ones dropped, to a rank."""
    shape = tuple(shape)
    while len(shape) > rank and shape[0] == 1:
        shape = shape[1:]
    if len(shape) > rank:
        raise ValueError(f"{shape} has more than {rank} axes")
    return (1,) * (rank - len(shape)) + shape


def channel_metadata(names: list[str], colours: list[int], ranges: list[tuple[float, float, float, float]]) -> dict:
    """Display settings of channels: label, colour (RGB number), and the window (min, max, start, end)."""
    shown = []
    for name, colour, (lo, hi, start, end) in zip(names, colours, ranges, strict=True):
        shown.append({"active": True, "coefficient": 1, "color": f"{colour:06X}", "family": "linear", "inverted": False, "label": name, "window": {"min": lo, "max": hi, "start": start, "end": end}})
    return {"omero": {"channels": shown, "rdefs": {"defaultT": 0, "defaultZ": 0, "model": "color"}, "version": "0.4"}}


def pyramid_metadata(name: str, levels: int, scale: tuple[float, float, float], factor: int = 2) -> dict:
    """Multiscale metadata (z, y, x): scale and origin of each level."""
    sets = []
    for k in range(levels):
        f = factor**k
        sets.append({
            "path": str(k),
            "coordinateTransformations": [
                {"type": "scale", "scale": [1.0, 1.0, *[s * f for s in scale]]},
                {"type": "translation", "translation": [0.0, 0.0, *[s * (f - 1) / 2 for s in scale]]},
            ],
        })
    axes = [{"name": "t", "type": "time"}, {"name": "c", "type": "channel"}, *[{"name": a, "type": "space", "unit": "micrometer"} for a in "zyx"]]
    return {"multiscales": [{"name": name, "version": "0.4", "axes": axes, "datasets": sets}]}
