"""Detection and fusion over blocks (survey 2.8), on grids made of the driver's tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import detection, fusion, volume
from ..sources import arrays, precomputed
from ..sources.shared import n_tasks
from ._base import query, shared_folder, table

_SIGMA, _THRESHOLD, _N = 1.8, 6.0, 24
_GRID = "SELECT user_id % 16 AS view, event_id % 24 AS x, hour(ts) AS y, (event_id * 7 + day(ts)) % 24 AS z, value FROM events"


def _blurred_sql(name: str, sigma: float) -> str:
    """CTEs ``name``: the grid convolved with a Gaussian along each axis, edges repeated by mirroring."""
    r = int(4 * sigma + 0.5)
    out = f"""{name}_k AS (SELECT d, exp(-0.5 * (d / {sigma}) ** 2) / sum(exp(-0.5 * (d / {sigma}) ** 2)) OVER () AS w FROM (SELECT unnest(generate_series(-{r}, {r})) AS d)),
{name}_m AS (SELECT i, CASE WHEN i + d < 0 THEN -1 - (i + d) WHEN i + d >= {_N} THEN {2 * _N - 1} - (i + d) ELSE i + d END AS src, sum(w) AS w
  FROM {name}_k, (SELECT unnest(generate_series(0, {_N - 1})) AS i) GROUP BY 1, 2)"""
    before = "g"
    for a in "xyz":
        keep = ", ".join(f"m.i AS {b}" if b == a else b for b in "xyz")
        out += f",\n{name}_{a} AS (SELECT view, {keep}, sum(v * w) AS v FROM {before} JOIN {name}_m m ON {a} = m.src GROUP BY view, {', '.join('m.i' if b == a else b for b in 'xyz')})"
        before = f"{name}_{a}"
    return out + f",\n{name} AS (SELECT * FROM {before})"


def _grid(spark, sf):
    view, x = (F.col("user_id") % 16).alias("view"), (F.col("event_id") % _N).alias("x")
    z = ((F.col("event_id") * 7 + F.dayofmonth("ts")) % _N).alias("z")
    grid = table(spark, sf, "events").select(view, x, F.hour("ts").cast("long").alias("y"), z, "value")
    return grid.groupBy("view", "x", "y", "z").agg(F.sum("value").alias("value"))


_K = 2 ** (1 / 4)
_S1, _S2 = ((s * s - 0.25) ** 0.5 for s in (_SIGMA, _SIGMA * _K))


@query(f"""WITH g AS (SELECT view, x, y, z, sum(value) AS v FROM ({_GRID}) GROUP BY 1, 2, 3, 4),
{_blurred_sql('a', _S1)}, {_blurred_sql('b', _S2)},
dog AS MATERIALIZED (SELECT a.view, a.x, a.y, a.z, (a.v - coalesce(b.v, 0)) / {_K - 1} AS v FROM a LEFT JOIN b USING (view, x, y, z)),
o AS (SELECT * FROM (SELECT unnest(generate_series(-1, 1)) AS dx), (SELECT unnest(generate_series(-1, 1)) AS dy), (SELECT unnest(generate_series(-1, 1)) AS dz) WHERE dx <> 0 OR dy <> 0 OR dz <> 0),
c AS (SELECT * FROM dog WHERE v >= {_THRESHOLD / 3} AND {' AND '.join(f'{a} BETWEEN 1 AND {_N - 2}' for a in 'xyz')}),
n AS (SELECT c.view, c.x, c.y, c.z, c.v, max(d.v) AS around FROM c CROSS JOIN o JOIN dog d ON d.view = c.view AND d.x = c.x + dx AND d.y = c.y + dy AND d.z = c.z + dz GROUP BY 1, 2, 3, 4, 5)
SELECT view, CAST(x AS BIGINT) AS px, CAST(y AS BIGINT) AS py, CAST(z AS BIGINT) AS pz, round(v, 3) AS response FROM n WHERE v > around""")
def q_detect(spark, sf):
    """Difference of Gaussian, maxima above all 26 neighbours, block by block with halos."""
    found = detection.rasterize(_grid(spark, sf), "view", (_N,) * 3, (12, 12, 12), detection.reach(_SIGMA))
    return detection.detect_points(found, "view", _SIGMA, _THRESHOLD).select("view", "px", "py", "pz", F.round("response", 3).alias("response"))


_MEDIAN = 2
_REFLECT = f"CASE WHEN i + d < 0 THEN -(i + d) WHEN i + d >= {_N} THEN {2 * _N - 2} - (i + d) ELSE i + d END"


@query(f"""WITH g AS (SELECT view, x, y, z, sum(value) AS v FROM ({_GRID}) GROUP BY 1, 2, 3, 4),
a AS (SELECT i, {_REFLECT} AS src, d FROM (SELECT unnest(generate_series(0, {_N - 1})) AS i), (SELECT unnest(generate_series(-{_MEDIAN}, {_MEDIAN})) AS d)),
h AS (SELECT g.view, ax.i AS x, ay.i AS y, g.z, g.v FROM g JOIN a ax ON g.x = ax.src JOIN a ay ON g.y = ay.src),
m AS (SELECT view, x, y, z, list_sort(list(v), 'DESC') AS v FROM h GROUP BY 1, 2, 3, 4),
b AS (SELECT view, x, y, z, coalesce(v[{(2 * _MEDIAN + 1) ** 2 // 2 + 1}], 0) AS median FROM m)
SELECT view, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z, round(g.v - b.median, 2) AS value FROM g JOIN b USING (view, x, y, z) WHERE g.v - b.median > 0.001""")
def q_background(spark, sf):
    """Voxels above the running median of the 5 x 5 window around them, block by block with halos."""
    blocks = detection.rasterize(_grid(spark, sf), "view", (_N,) * 3, (12, 12, 12), _MEDIAN)
    plain = detection.without_background(blocks, "view", _MEDIAN)
    return detection.core_voxels(plain, "view", 0.001).select("view", "x", "y", "z", F.round("value", 2).alias("value"))


_LABELS = (240, 24, 24)
_FACTORS = ((1.0, 1.0, 1.0), (0.5, 0.5, 0.5), (0.1, 0.25, 0.5))


def _zoomed_sql() -> str:
    """One SELECT a scale: the labels at the nearest source voxels."""
    parts = []
    for s, factors in enumerate(_FACTORS):
        sizes = [(n, max(1, round(n * f))) for n, f in zip(_LABELS, factors, strict=True)]
        on = " ".join(f"JOIN (SELECT floor(unnest(generate_series(0, {m - 1})) * ({n - 1} / {m - 1}.0) + 0.5) AS {a}) USING ({a})" for a, (n, m) in zip("xyz", sizes, strict=True))
        parts.append(f"SELECT {s} AS scale, label FROM g {on}")
    return " UNION ALL ".join(parts)


@query(f"""WITH g AS (SELECT event_id % 240 AS x, hour(ts) AS y, (event_id * 7 + day(ts)) % 24 AS z, max(user_id) + 1 AS label FROM events GROUP BY 1, 2, 3)
SELECT CAST(scale AS INTEGER) AS scale, CAST(label AS BIGINT) AS label, count(*) AS voxels FROM ({_zoomed_sql()}) GROUP BY 1, 2""")
def q_label_scales(spark, sf):
    """A label volume written as compressed segmentation of three scales, read back, voxels counted by label."""
    e, folder, side = table(spark, sf, "events"), shared_folder(spark) + "/labels", (60, 12, 12)
    z = (F.col("event_id") * 7 + F.dayofmonth("ts")) % 24
    grid = e.groupBy((F.col("event_id") % 240).alias("x"), F.hour("ts").cast("long").alias("y"), z.alias("z")).agg((F.max("user_id") + 1).alias("label"))

    def block(f):
        at = [int(f[a].iloc[0]) // w * w for a, w in zip("xyz", side, strict=True)]
        v = np.zeros(side, dtype="<u4")
        v[tuple(f[a].to_numpy() - o for a, o in zip("xyz", at, strict=True))] = f["label"]
        return pd.DataFrame({"origin": [at], "shape": [list(side)], "data": [v.tobytes()]})

    def tally(frames):
        for f in frames:
            for data in f["data"]:
                label, n = np.unique(np.frombuffer(data, dtype="<u4"), return_counts=True)
                yield pd.DataFrame({"label": label.astype(np.int64), "voxels": n})

    blocks = grid.groupBy(*[F.floor(F.col(a) / w) for a, w in zip("xyz", side, strict=True)]).applyInPandas(block, "origin array<long>, shape array<long>, data binary")
    precomputed.write_segmentation(blocks, folder, _LABELS, (32, 16, 8), "uint32", factors=_FACTORS)
    out = None
    for s in range(len(_FACTORS)):
        found = precomputed.read_segmentation(spark, folder, s).mapInPandas(tally, "label long, voxels long").withColumn("scale", F.lit(s))
        out = found if out is None else out.unionByName(found)
    return out.filter("label > 0").groupBy("scale", "label").agg(F.sum("voxels").alias("voxels"))


_CELL = 32
_SHAPE = (12, 10, 6)
#: Tiles are turned by the angle of a 3-4-5 triangle about z and grown by a quarter; no voxel is halfway between two.
_TURN = ((0.75, -1.0, 0.0), (1.0, 0.75, 0.0), (0.0, 0.0, 1.25))
_BACK = ((0.48, 0.64, 0.0), (-0.64, 0.48, 0.0), (0.0, 0.0, 0.8))
_SHIFT = (0.013, 0.027, 0.13)
_PLACES = "SELECT s_suppkey AS k, (s_suppkey % 10) * 9 + 20.013 AS dx, (s_suppkey // 10) % 10 * 8 + 20.027 AS dy, s_suppkey % 3 + 2.13 AS dz FROM supplier"
_EXACT = [" + ".join(f"{m} * ({a} - d{a})" for m, a in zip(row, "xyz", strict=True)) for row in _BACK]
_FUSED_SQL = f"""WITH t AS (SELECT k, CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy, CAST(dz AS DOUBLE) AS dz FROM ({_PLACES})),
g AS (SELECT k, CAST(floor(dx) AS BIGINT) + i AS x, CAST(floor(dy) AS BIGINT) + j AS y, CAST(floor(dz) AS BIGINT) + l AS z, dx, dy, dz FROM t, (SELECT unnest(generate_series(-16, 16)) AS i), (SELECT unnest(generate_series(-6, 26)) AS j), (SELECT unnest(generate_series(-3, 12)) AS l)),
e AS (SELECT k, x, y, z, {', '.join(f'{v} AS e{a}' for v, a in zip(_EXACT, "xyz", strict=True))} FROM g),
n AS (SELECT *, {', '.join(f'CAST(floor(e{a} + 0.5) AS BIGINT) AS n{a}' for a in "xyz")} FROM e),
v AS (SELECT x, y, z, (nx * 7 + ny * 3 + nz + k) % 251 AS v, greatest(1e-6, least({', '.join(f'e{a} + 1, {m} - e{a}' for a, m in zip("xyz", _SHAPE, strict=True))})) AS w FROM n WHERE {' AND '.join(f'n{a} BETWEEN 0 AND {m - 1}' for a, m in zip("xyz", _SHAPE, strict=True))}),
f AS (SELECT x, y, z, sum(v * w) / sum(w) AS v FROM v GROUP BY 1, 2, 3)
SELECT CAST(x // {_CELL} AS BIGINT) AS c0, CAST(y // {_CELL} AS BIGINT) AS c1, CAST(z // {_CELL} AS BIGINT) AS c2, count(*) AS covered, round(sum(v), 2) AS total FROM f GROUP BY 1, 2, 3"""


def _placed_tiles(spark, sf):
    """tile and its model to the output, a tile a supplier."""
    k = F.col("s_suppkey")
    at = [(k % 10) * 9 + 20, F.floor(k / 10) % 10 * 8 + 20, k % 3 + 2]
    cols = [F.lit(m) for row in _TURN for m in (*row, None)]
    for d in range(3):
        cols[4 * d + 3] = at[d] + F.lit(_SHIFT[d])
    return table(spark, sf, "supplier").select(k.alias("tile"), *[c.cast("double").alias(n) for c, n in zip(cols, G.NAMES, strict=True)])


def _image(tile: int) -> np.ndarray:
    x, y, z = np.meshgrid(*map(np.arange, _SHAPE), indexing="ij")
    return ((x * 7 + y * 3 + z + tile) % 251).astype("<u2")


def _totals(fused):
    return fused.select("c0", "c1", "c2", "covered", F.round(volume.block_sum("data"), 2).alias("total"))


@query(_FUSED_SQL)
def q_fuse(spark, sf):
    """Turned, grown and overlapping tiles, as rows of blocks in their own kind, blended by the distance to their
    faces into output cells; the sum of each cell."""
    models = _placed_tiles(spark, sf)

    def image(frames):
        for f in frames:
            made = [(t, x, _image(t)[x : x + 5]) for t in f["tile"] for x in range(0, _SHAPE[0], 5)]
            yield pd.DataFrame([(t, [x, 0, 0], list(v.shape), v.dtype.str, v.tobytes()) for t, x, v in made], columns=["tile", "origin", "shape", "kind", "data"])

    blocks = models.select("tile").repartition(n_tasks(spark), "tile").mapInPandas(image, f"tile long, {arrays.VOXELS}")
    whole = models.select("tile", F.array(*map(F.lit, _SHAPE)).alias("whole"))
    return _totals(fusion.fuse(blocks, models, whole, (_CELL,) * 3))


def _stored_tiles(spark, sf):
    """As ``_placed_tiles``, with the images in arrays that the executors write."""
    folder, models = shared_folder(spark) + "/tiles", _placed_tiles(spark, sf)

    def write(frames):
        for f in frames:
            for t in f["tile"]:
                arrays.create_zarr(f"{folder}/{t}", _SHAPE, (6, 5, 3), "<u2")
                arrays.put_block(arrays.open_array(f"{folder}/{t}"), (0, 0, 0), _image(t))
            yield f[["tile"]]

    models.select("tile").repartition(n_tasks(spark), "tile").mapInPandas(write, "tile long").agg(F.count("*")).first()
    return models.withColumn("uri", F.concat(F.lit(f"{folder}/"), "tile"))


@query(_FUSED_SQL)
def q_fuse_stores(spark, sf):
    """The same from tiles in chunked arrays: each cell reads the chunks that it needs, no voxel is shuffled."""
    return _totals(fusion.fuse_tiles(_stored_tiles(spark, sf), (_CELL,) * 3))


@query(_FUSED_SQL.replace(f"""SELECT CAST(x // {_CELL} AS BIGINT) AS c0""", """, h AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, sum(round_even(v, 0)) / 8 AS v FROM f GROUP BY 1, 2, 3),
r AS (SELECT x, y, z, round_even(v, 0) AS v FROM h)
SELECT CAST(x // 16 AS BIGINT) AS c0""").replace(f"CAST(y // {_CELL} AS BIGINT) AS c1, CAST(z // {_CELL} AS BIGINT) AS c2, count(*) AS covered, round(sum(v), 2) AS total FROM f", "CAST(y // 16 AS BIGINT) AS c1, CAST(z // 16 AS BIGINT) AS c2, round(sum(v), 2) AS total FROM r") + " HAVING sum(v) > 0")
def q_fused_pyramid(spark, sf):
    """Fused into a store as 16-bit numbers, halved there, and read back from level 1."""
    uri = shared_folder(spark) + "/fused"
    fusion.fuse_to_store(_stored_tiles(spark, sf), uri, (160, 160, 32), (_CELL,) * 3, (16,) * 3, levels=2)
    level = spark.createDataFrame([(0, f"{uri}/1")], "tile long, uri string")
    at = [F.floor(F.get("origin", F.lit(d)) / 16).alias(f"c{d}") for d in range(3)]
    found = arrays.read_tiles(level).select(*at, volume.block_sum("data", "kind").alias("total"))
    return found.filter("total > 0").select("c0", "c1", "c2", F.round("total", 2).alias("total"))
