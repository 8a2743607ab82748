"""Affine fusion: tiles resampled and blended cell by cell of the output.

A tile's image names the output cells that it reaches (an explode and a shuffle by cell, no pairs of all
cells and tiles); one task fills a cell from the tiles that reach it, each resampled by the inverse model to
the nearest voxel, a slab at a time.

* ``fuse`` takes blocks as rows. A block is cut down to what each cell needs of it, in its own kind, before
  anything is shuffled, so little more than the overlap of blocks and cells moves.
* ``fuse_tiles`` takes tiles in stores: a row is the name of a tile for a cell, and the cell's task reads
  just the chunks that it needs. No voxel is shuffled.
* ``fuse_to_store`` writes the cells as chunks of a Zarr array, level by level of a pyramid. Every finished
  cell leaves a mark, so a run that was stopped goes on where it was; each level reads the one before once.

Cells go to tasks along a Z-curve, so that neighbours, which share chunks, are read and written together.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources import arrays, precomputed
from ..sources.shared import discard, n_tasks, written

#: Blocks of tiles: a tile and its voxels, here as float64 without a kind.
BLOCK = "tile long, origin array<long>, shape array<long>, data binary"
FUSED = f"c0 long, c1 long, c2 long, {arrays.VOXELS}, covered long"
BLENDS = ("weighted", "mean", "max", "first")
#: Voxels of a cell that are resampled together; bounds a task's memory.
SLAB = 1 << 20
#: Bits of each cell coordinate below which cells share a task.
NEAR_BITS = 1
_CELL = ["c0", "c1", "c2"]
#: Tiles of a cell from which on several tasks share it, and the most that do; bounds what is merged of a cell.
PART_TILES = 256
MOST_PARTS = 64
#: Tiles whose models are sent to all executors at most, and bytes of cut blocks that a task collects before it passes them on.
MOST_SENT = 10_000
MOST_HELD = 1 << 24
_STATE = "c0 long, c1 long, c2 long, part int, origin array<long>, shape array<long>, total binary, weight binary, count binary"


def _reached(rows: DataFrame, lo: list[Column], hi: list[Column], cell: tuple[int, int, int], lower: tuple[int, int, int]) -> DataFrame:
    """A row for each cell (c0, c1, c2) that the image of the box lo .. hi under the model m00.. reaches."""
    first, last = G.image_of_box(G.model(), lo, hi)
    for d in range(3):
        cells = F.sequence(F.floor((F.floor(first[d]) - lower[d]) / cell[d]), F.floor((F.ceil(last[d]) - lower[d]) / cell[d]))
        rows = rows.withColumn(f"c{d}", F.explode(cells))
    return rows


def _near() -> Column:
    """The same for cells that lie together on the Z-curve: the curve's number without its lowest bits."""
    return F.struct(*[F.shiftright(F.col(c), NEAR_BITS) for c in _CELL])


def _by_cell(rows: DataFrame):
    # dealt by neighbourhood; a cell is a part of it, so grouping by both needs no further shuffle
    return rows.withColumn("near", _near()).repartition("near").groupBy("near", *_CELL)


def _parts(cells: DataFrame, blend: str) -> int:
    """How many tasks share a cell, by the fullest one of a table of a row a cell and tile."""
    if blend == "first":  # the order of all tiles decides
        return 1
    most = cells.groupBy(*_CELL).count().agg(F.max("count")).first()[0] or 0
    return min(-(-most // PART_TILES), MOST_PARTS) or 1


def _filled(rows: DataFrame, parts: int, new, add, result, schema: str, skip=lambda c: False) -> DataFrame:
    """``result(c, filler)`` (rows of ``schema``) of each cell: ``new(c)`` is its empty filler, ``add(filler, frame)`` gives it rows.
    With several parts the tiles of a cell are dealt to them by a hash; each part is filled in a group of its own,
    and what the parts reach is merged. Cells that ``skip`` names are left out."""
    names = [x.split()[0] for x in schema.split(", ")]

    def cell(f):
        return [int(f[k].iloc[0]) for k in _CELL]

    def whole(f):
        import pandas as pd

        c = cell(f)
        if skip(c):
            return pd.DataFrame([], columns=names)
        fill = new(c)
        add(fill, f)
        return pd.DataFrame(result(c, fill), columns=names)

    def part(f):
        import pandas as pd

        c, found = cell(f), []
        if not skip(c):
            fill = new(c)
            add(fill, f)
            found = [(*c, int(f["part"].iloc[0]), *fill.state())]
        return pd.DataFrame(found, columns=[x.split()[0] for x in _STATE.split(", ")])

    def merged(f):
        import pandas as pd

        c = cell(f)
        fill = new(c)
        for r in f.sort_values("part").itertuples(index=False):
            fill.merge(r.origin, r.shape, r.total, r.weight, r.count)
        return pd.DataFrame(result(c, fill), columns=names)

    if parts == 1:
        return _by_cell(rows).applyInPandas(whole, schema)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(parts)).cast("int")).repartition(n_tasks(rows.sparkSession), *_CELL, "part")
    return _by_cell(dealt.groupBy(*_CELL, "part").applyInPandas(part, _STATE)).applyInPandas(merged, schema)


def source_box(inverse: np.ndarray, at: np.ndarray, size) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 voxel of a tile that the voxels of an output box may take."""
    m = inverse[:, :3]
    first, across = m @ at + inverse[:, 3], m * (np.asarray(size) - 1)
    lo, hi = first + np.minimum(across, 0).sum(axis=1), first + np.maximum(across, 0).sum(axis=1)
    return np.floor(lo + 0.5 - 1e-6).astype(np.int64), np.floor(hi + 0.5 + 1e-6).astype(np.int64) + 1


class Filler:
    """One output cell: tiles are added in order, then the blend is read."""

    def __init__(self, at, size, blend: str):
        self.at, self.size, self.blend = np.asarray(at), tuple(size), blend
        self.total, self.weight, self.count = np.zeros(self.size), np.zeros(self.size), np.zeros(self.size, dtype=np.int32)

    def _reach(self, m: np.ndarray, origin, shape) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 voxel of the cell that a block's image may reach, with a voxel to spare."""
        try:
            linear = np.linalg.inv(m[:, :3])
        except np.linalg.LinAlgError:
            return np.zeros(3, dtype=np.int64), np.array(self.size)
        first, across = linear @ (np.asarray(origin) - 0.5 - m[:, 3]), linear * np.asarray(shape)
        lo = np.floor(first + np.minimum(across, 0).sum(axis=1)) - 1 - self.at
        hi = np.ceil(first + np.maximum(across, 0).sum(axis=1)) + 2 - self.at
        return np.clip(lo, 0, self.size).astype(np.int64), np.clip(hi, 0, self.size).astype(np.int64)

    def state(self) -> tuple:
        """What tiles have given so far, cut to the voxels that they reach: origin within the cell, shape, values."""
        at = np.nonzero(self.count)
        box = tuple(slice(int(a.min()), int(a.max()) + 1) if len(a) else slice(0, 0) for a in at)
        v = [x[box] for x in (self.total, self.weight, self.count)]
        return [s.start for s in box], list(v[0].shape), *[x.tobytes() for x in v]

    def merge(self, origin, shape, total: bytes, weight: bytes, count: bytes) -> None:
        """Add the ``state`` of another filler of the same cell; not for the blend ``first``, which needs an order."""
        box = tuple(slice(o, o + n) for o, n in zip(origin, shape, strict=True))
        total, weight, count = (np.frombuffer(v, dtype=k).reshape(tuple(shape)) for v, k in ((total, "f8"), (weight, "f8"), (count, "i4")))
        mine, here = self.total[box], self.count[box]
        if self.blend == "max":
            self.total[box] = np.where(here == 0, total, np.where(count == 0, mine, np.maximum(mine, total)))
        else:
            self.total[box] = mine + total
            self.weight[box] += weight
        self.count[box] = here + count

    def add(self, origin, v: np.ndarray, inverse, whole) -> None:
        """A block of a tile of shape ``whole``. ``weighted``: weights are distances to the tile's nearest face."""
        m, whole = np.asarray(inverse, dtype=np.float64).reshape(3, 4), np.asarray(whole)
        lo, hi = self._reach(m, origin, v.shape)
        if not (lo < hi).all():
            return
        step = max(1, int(SLAB // ((hi[1] - lo[1]) * (hi[2] - lo[2]))))
        for x in range(lo[0], hi[0], step):
            slab = (slice(x, min(x + step, hi[0])), slice(lo[1], hi[1]), slice(lo[2], hi[2]))
            ax = [np.arange(s.start, s.stop).reshape([-1 if i == d else 1 for i in range(3)]) for d, s in enumerate(slab)]
            ax = [a + o for a, o in zip(ax, self.at, strict=True)]
            exact = [m[d, 0] * ax[0] + m[d, 1] * ax[1] + m[d, 2] * ax[2] + m[d, 3] for d in range(3)]
            near = [np.floor(e + 0.5).astype(np.int64) - o for e, o in zip(exact, origin, strict=True)]
            here = np.nonzero(np.logical_and.reduce([(n >= 0) & (n < k) for n, k in zip(near, v.shape, strict=True)]))
            if not len(here[0]):
                continue
            value = v[tuple(n[here] for n in near)].astype(np.float64)
            total, weight, count = self.total[slab], self.weight[slab], self.count[slab]
            if self.blend == "max":
                total[here] = np.where(count[here] > 0, np.maximum(total[here], value), value)
            elif self.blend == "first":
                total[here] = np.where(count[here] > 0, total[here], value)
            else:
                w = np.ones(len(value))
                if self.blend == "weighted":
                    w = np.minimum.reduce([np.minimum(e[here] + 1, n - e[here]) for e, n in zip(exact, whole, strict=True)]).clip(1e-6)
                total[here] += w * value
                weight[here] += w
            count[here] += 1

    def result(self) -> np.ndarray:
        if self.blend in ("weighted", "mean"):
            return np.divide(self.total, self.weight, out=np.zeros(self.size), where=self.weight > 0)
        return self.total


def _fused(c, fill: Filler, kind: str) -> tuple:
    v = fill.result()
    if np.dtype(kind).kind in "iu":
        v = np.clip(np.rint(v), np.iinfo(kind).min, np.iinfo(kind).max)
    return (*c, fill.at.tolist(), list(fill.size), kind, v.astype(kind).tobytes(), int((fill.count > 0).sum()))


def _fresh(cell, lower, blend: str):
    """A function that makes the empty filler of a cell."""
    return lambda c: Filler([lo + k * n for lo, k, n in zip(lower, c, cell, strict=True)], cell, blend)


def _placed(models: DataFrame, tile_shape: DataFrame) -> DataFrame:
    """A row a tile: its model, the inverse and the tile's shape. Written, and joined by a shuffle: tables of a row a tile
    grow with the input, however few bytes of their files make them look small enough for a broadcast."""
    back = models.select("tile", *G.NAMES, F.array(*G.inverse(G.model())).alias("inverse"))
    return written(back.join(tile_shape.select("tile", F.col("whole").cast("array<long>").alias("whole")).hint("merge"), "tile"), "placed")


def cut_to_cells(blocks: DataFrame, models: DataFrame, tile_shape: DataFrame, cell: tuple[int, int, int], lower: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """What each output cell needs of each block, in the block's kind, with the inverse model of its tile and the
    tile's shape. ``models``: tile and m00..m23 to the output; ``tile_shape``: tile, whole. Cells begin at ``lower``."""
    return _cut(blocks, _placed(models, tile_shape), cell, lower)


def _cut(blocks: DataFrame, placed: DataFrame, cell: tuple[int, int, int], lower: tuple[int, int, int]) -> DataFrame:
    """``cut_to_cells`` of ``_placed``. Few tiles are sent to where the blocks are; of more the blocks are dealt by tile."""
    kind = F.col("kind") if "kind" in blocks.columns else F.lit("<f8")
    dealt = blocks.select("tile", "origin", "shape", kind.alias("kind"), "data")
    if placed.limit(MOST_SENT + 1).count() > MOST_SENT:
        both = dealt.repartition(n_tasks(blocks.sparkSession), "tile").join(placed.hint("merge"), "tile")
    else:
        both = dealt.join(F.broadcast(placed), "tile")
    lo = [F.get("origin", F.lit(d)) - 0.5 for d in range(3)]
    hi = [F.get("origin", F.lit(d)) + F.get("shape", F.lit(d)) - 0.5 for d in range(3)]
    first, last = G.image_of_box(G.model(), lo, hi)
    ends = [F.floor((f(e[d]) - lower[d]) / cell[d]) for f, e in ((F.floor, first), (F.ceil, last)) for d in range(3)]
    rows = both.select("tile", "origin", "shape", "kind", "data", "inverse", "whole", F.array(*ends).alias("ends"))
    names = ["tile", "origin", "shape", "kind", "data", "inverse", "whole", *_CELL]

    def run(frames):
        import pandas as pd

        for f in frames:
            out, held = [], 0
            for r in f.itertuples(index=False):
                v, inverse, ends = arrays.voxels(r), np.asarray(r.inverse).reshape(3, 4), list(r.ends)
                for c in np.ndindex(*[b - a + 1 for a, b in zip(ends[:3], ends[3:], strict=True)]):
                    c = [int(a + i) for a, i in zip(ends, c, strict=False)]
                    at = np.array([o + k * n for o, k, n in zip(lower, c, cell, strict=True)])
                    a, b = source_box(inverse, at, cell)
                    a = np.maximum(a - r.origin, 0)
                    part = v[tuple(slice(int(x), max(int(x), int(y))) for x, y in zip(a, b - r.origin, strict=True))]
                    if part.size:
                        out.append((r.tile, (a + r.origin).tolist(), list(part.shape), r.kind, part.tobytes(), r.inverse, r.whole, *c))
                        held += part.nbytes
                        if held >= MOST_HELD:
                            yield pd.DataFrame(out, columns=names)
                            out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    tile = blocks.schema["tile"].dataType.simpleString()
    return rows.mapInPandas(run, f"tile {tile}, {arrays.VOXELS}, inverse array<double>, whole array<long>, c0 long, c1 long, c2 long")


def fuse(blocks: DataFrame, models: DataFrame, tile_shape: DataFrame, cell: tuple[int, int, int], lower: tuple[int, int, int] | None = None, blend: str = "weighted", kind: str = "<f8") -> DataFrame:
    """The output volume as blocks (``FUSED``): the cell, its voxels in ``kind``, and how many voxels some tile
    reaches. Cells that nothing reaches are absent."""
    if blend not in BLENDS:
        raise ValueError(f"blend must be one of {BLENDS}")
    lower = lower or (0, 0, 0)

    def add(fill, f):
        for r in f.assign(first=[tuple(o) for o in f["origin"]]).sort_values(["tile", "first"]).itertuples(index=False):
            fill.add(r.origin, arrays.voxels(r), r.inverse, r.whole)

    new, result = _fresh(cell, lower, blend), lambda c, fill: [_fused(c, fill, kind)] if fill.count.any() else []
    half, whole, placed = F.lit(-0.5), [F.get("whole", F.lit(d)) - 0.5 for d in range(3)], _placed(models, tile_shape)
    reached = _reached(placed, [half] * 3, whole, cell, lower)
    return _filled(_cut(blocks, placed, cell, lower), _parts(reached, blend), new, add, result, FUSED)


def cells_of_tiles(tiles: DataFrame, cell: tuple[int, int, int], lower: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """tile, uri, whole, inverse of every cell that a tile's image reaches. ``tiles``: tile, uri, m00..m23, and maybe
    size, where the tile ends in an array that is padded to whole chunks."""
    known = arrays.shapes(tiles.sparkSession, tiles.select("uri").distinct().repartition(n_tasks(tiles.sparkSession), "uri")).select("uri", "shape")
    whole = F.col("shape")
    if "size" in tiles.columns:
        whole = F.array(*[F.least(F.get("shape", F.lit(d)), F.get("size", F.lit(d)).cast("long")) for d in range(3)])  # least skips nulls
    rows = tiles.join(known.hint("merge"), "uri").withColumn("whole", whole).withColumn("inverse", F.array(*G.inverse(G.model())))
    half = F.lit(-0.5)
    rows = _reached(rows, [half] * 3, [F.get("whole", F.lit(d)) - 0.5 for d in range(3)], cell, lower)
    return rows.select("tile", "uri", "whole", "inverse", *_CELL)


def _add_from_stores(fill: Filler, f) -> None:
    for r in f.sort_values("tile").itertuples(index=False):
        inverse = np.asarray(r.inverse).reshape(3, 4)
        a, b = source_box(inverse, fill.at, fill.size)
        a, b = np.maximum(a, 0), np.minimum(b, r.whole)
        if (a < b).all():
            fill.add(a, arrays.read_slice(arrays.open_array(r.uri), a.tolist(), b.tolist()), inverse, r.whole)


def fuse_tiles(tiles: DataFrame, cell: tuple[int, int, int], lower: tuple[int, int, int] | None = None, blend: str = "weighted", kind: str = "<f8") -> DataFrame:
    """As ``fuse``, of tiles in stores (tile, uri, m00..m23, maybe size); each cell reads what it needs of them."""
    if blend not in BLENDS:
        raise ValueError(f"blend must be one of {BLENDS}")
    lower = lower or (0, 0, 0)

    result = lambda c, fill: [_fused(c, fill, kind)] if fill.count.any() else []
    cells = written(cells_of_tiles(tiles, cell, lower), "cells")
    return _filled(cells, _parts(cells, blend), _fresh(cell, lower, blend), _add_from_stores, result, FUSED)


def _mark(uri: str, c) -> tuple:
    where, path = arrays._open(uri.rstrip("/"))
    return where, f"{path}.done", f"{path}.done/{'.'.join(map(str, c))}"


def finished(uri: str, c) -> bool:
    """Whether a cell of the array has been written whole: its mark is there. Marks stand beside the array."""
    from pyarrow import fs

    where, _, name = _mark(uri, c)
    return where.get_file_info(name).type != fs.FileType.NotFound


def _finish(uri: str, c, origin, v: np.ndarray) -> None:
    arrays.put_block(arrays.open_array(uri), origin, v)
    where, folder, name = _mark(uri, c)
    where.create_dir(folder, recursive=True)
    with where.open_output_stream(name, compression=None) as f:
        f.write(b"done")


def _has_header(uri: str) -> bool:
    return arrays._bytes(uri.rstrip("/") + "/.zarray") is not None


def halve(spark: SparkSession, source: str, target: str, cell: tuple[int, int, int]) -> int:
    """The next level of a pyramid: means of 2 x 2 x 2 voxels of the array ``source``, an incomplete one at the end
    dropped, written cell by cell into the array ``target`` by the executors; the cells written. Each cell reads
    its voxels of ``source`` once, and finished ones are skipped."""
    if not _has_header(target):
        array = arrays.open_array(source)
        arrays.create_zarr(target, tuple(max(1, n // 2) for n in array.shape), cell, array.kind.str)
    counts = [-(-n // c) for n, c in zip(arrays.open_array(target).shape, cell, strict=True)]
    cells = spark.range(counts[0] * counts[1] * counts[2]).select(
        F.floor(F.col("id") / (counts[1] * counts[2])).alias("c0"), (F.floor(F.col("id") / counts[2]) % counts[1]).alias("c1"), (F.col("id") % counts[2]).alias("c2")
    )

    def run(frames):
        import pandas as pd

        whole = arrays.open_array(source)
        for f in frames:
            n = 0
            for c in f[_CELL].itertuples(index=False):
                if finished(target, c):
                    continue
                lo = [2 * k * m for k, m in zip(c, cell, strict=True)]
                hi = [min(o + 2 * m, w) for o, m, w in zip(lo, cell, whole.shape, strict=True)]
                if all(a < b for a, b in zip(lo, hi, strict=True)):
                    v = arrays.read_slice(whole, lo, hi)
                    v = arrays.averaged(v, tuple(min(2, k) for k in v.shape)) if min(v.shape) else v
                    _finish(target, c, [o // 2 for o in lo], v)
                    n += 1
            yield pd.DataFrame({"n": [n]})

    return cells.withColumn("near", _near()).repartition("near").select(*_CELL).mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def fuse_to_store(tiles: DataFrame, uri: str, shape: tuple[int, int, int], cell: tuple[int, int, int], chunk: tuple[int, int, int] | None = None, levels: int = 1, lower: tuple[int, int, int] | None = None, blend: str = "weighted", kind: str = "<u2", attributes: dict | None = None) -> list[int]:
    """Fuse stored tiles (tile, uri, m00..m23, maybe size) into level 0 of ``uri`` and halve it ``levels`` - 1 times; the cells
    written of each level. The volume of ``shape`` begins at ``lower`` of the models' space. Run again after a
    stop, it writes what is missing. Cells are made of whole chunks."""
    if blend not in BLENDS:
        raise ValueError(f"blend must be one of {BLENDS}")
    chunk, lower, spark = chunk or cell, lower or (0, 0, 0), tiles.sparkSession
    if any(n % c for n, c in zip(cell, chunk, strict=True)):
        raise ValueError("a cell must be made of whole chunks")
    base = f"{uri.rstrip('/')}/0"
    if attributes is not None:
        where, path = arrays._open(uri)
        where.create_dir(path, recursive=True)
        with where.open_output_stream(f"{path}/.zattrs", compression=None) as f:
            f.write(json.dumps(attributes).encode())
    if not _has_header(base):
        arrays.create_zarr(base, shape, chunk, kind)
    within = F.lit(True)
    for d, (n, c) in enumerate(zip(shape, cell, strict=True)):
        within = within & F.col(f"c{d}").between(0, -(-n // c) - 1)

    def new(c):
        at = [k * n for k, n in zip(c, cell, strict=True)]
        size = [min(n, m - o) for n, m, o in zip(cell, shape, at, strict=True)]
        return Filler([o + lo for o, lo in zip(at, lower, strict=True)], size, blend)

    def result(c, fill):
        _finish(base, c, [k * n for k, n in zip(c, cell, strict=True)], fill.result())
        return [(1,)]

    cells = written(cells_of_tiles(tiles, cell, lower).filter(within), "cells")
    done = _filled(cells, _parts(cells, blend), new, _add_from_stores, result, "n long", lambda c: finished(base, c))
    made = [done.agg(F.sum("n")).first()[0] or 0]
    discard(cells)
    for k in range(1, levels):
        made.append(halve(spark, f"{uri.rstrip('/')}/{k - 1}", f"{uri.rstrip('/')}/{k}", chunk))
    return made


def pyramid_step(blocks: DataFrame, cell: tuple[int, int, int]) -> DataFrame:
    """Half the resolution along every axis of blocks as rows: blocks of the same cell shape from means of 2 x 2 x 2
    voxels. A cell of the result is filled from the eight cells that it covers; missing ones count as 0. A block is
    halved before it is sent, so an eighth of the voxels moves."""
    if any(n % 2 for n in cell):
        raise ValueError("cells must have even sizes")

    def small(frames):
        import pandas as pd

        for f in frames:
            made = [arrays.averaged(arrays.voxels(r), (2, 2, 2)) for r in f.itertuples(index=False)]
            yield pd.DataFrame({"origin": [[o // 2 for o in r] for r in f["origin"]], "shape": [list(v.shape) for v in made], "data": [v.astype("<f8").tobytes() for v in made]})

    def run(f):
        import pandas as pd

        c = [int(f[f"p{d}"].iloc[0]) for d in range(3)]
        at, out = np.array(c) * np.array(cell), np.zeros(cell)
        for r in f.itertuples(index=False):
            lo = np.asarray(r.origin) - at
            out[tuple(slice(a, a + n) for a, n in zip(lo, r.shape, strict=True))] = arrays.voxels(r)
        return pd.DataFrame([(*c, at.tolist(), list(cell), out.astype("<f8").tobytes())], columns=[*_CELL, "origin", "shape", "data"])

    kept = [c for c in ("origin", "shape", "kind", "data") if c in blocks.columns]
    halves = blocks.select(*kept).mapInPandas(small, "origin array<long>, shape array<long>, data binary")
    up = halves.select("origin", "shape", "data", *[F.floor(F.get("origin", F.lit(d)) / cell[d]).alias(f"p{d}") for d in range(3)])
    return up.groupBy("p0", "p1", "p2").applyInPandas(run, "c0 long, c1 long, c2 long, origin array<long>, shape array<long>, data binary")


def pyramid(blocks: DataFrame, cell: tuple[int, int, int], levels: int):
    """Levels 0 .. levels - 1 of blocks as rows, each from the one before (lazily: ``fuse_to_store`` keeps levels)."""
    for k in range(levels):
        yield k, blocks
        if k + 1 < levels:
            blocks = pyramid_step(blocks, cell)


def zoom_labels(v: np.ndarray, factor: tuple[float, float, float]) -> np.ndarray:
    """Nearest-neighbour zoom of a label block: ends stay at ends."""
    return v[np.ix_(*map(precomputed.zoom_index, v.shape, factor))]


def radial_correct(v: np.ndarray, cutoff: float, shift: float, crop: int) -> np.ndarray:
    """One plane (x, y) with its radial distortion removed: beyond ``cutoff`` a radius grows linearly up to
    ``shift`` at the corner; values are interpolated, the edge is cropped."""
    c = [(n - 1) / 2 for n in v.shape]
    x, y = np.meshgrid(*[np.arange(n) - m for n, m in zip(v.shape, c, strict=True)], indexing="ij")
    r, far = np.hypot(x, y), np.hypot(*c)
    k = np.where(r > cutoff, (r + (r - cutoff) * shift / max(far - cutoff, 1e-9)) / np.maximum(r, 1e-9), 1.0)
    at = np.stack([np.clip(a * k + m, 0, n - 1) for a, m, n in zip((x, y), c, v.shape, strict=True)], axis=-1)
    low = np.minimum(np.floor(at).astype(int), np.array(v.shape) - 2)
    part = at - low
    out = np.zeros(v.shape)
    for d in np.ndindex(2, 2):
        out += v[low[..., 0] + d[0], low[..., 1] + d[1]] * np.where(d, part, 1 - part).prod(axis=-1)
    return out[crop : v.shape[0] - crop, crop : v.shape[1] - crop]
