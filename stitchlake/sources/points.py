"""Interest points as chunked arrays: ``id``, ``loc`` and ``intensities`` of every point set, by executors.

A set lies in a folder of its own (``.../interestpoints``). Written sets are N5: an attributes file a data set,
and gzip blocks of ``CHUNK`` points, the first axis fastest. Read are N5 and Zarr version 2 data sets, of any
chunk size. Points are ranked over all tasks (a set may hold most of them), and the rows of a chunk go to the
one task that writes it. A set without points is three empty data sets.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered
from . import arrays, store

#: Points of a chunk, as most readers expect it.
CHUNK = 300_000
VIEW = ["timepoint", "setup", "label"]
#: The data sets of a point set, their kinds, and values of a point; the attributes of its folder.
DATA = {"id": ("uint64", 1), "loc": ("float64", 3), "intensities": ("float32", 1)}
ROOT = {"pointcloud": "1.0.0", "type": "list", "list version": "1.0.0"}


def set_path(folder: str):
    """The folder of a point set below ``folder``, from timepoint, setup and label."""
    return F.format_string(f"{folder.rstrip('/').replace('%', '%%')}/tpId_%d_viewSetupId_%d/%s/interestpoints", "timepoint", "setup", "label")


def _put(uri: str, content: bytes) -> None:
    where, path = arrays._open(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(path, compression=None) as f:
        f.write(content)


def _start(uri: str, n: int, chunk: int) -> None:
    """The headers of a set of n points; what was there before goes."""
    from pyarrow import fs

    where, path = arrays._open(uri)
    if where.get_file_info(path).type == fs.FileType.Directory:
        where.delete_dir(path)
    _put(f"{uri}/attributes.json", json.dumps(ROOT | {"n5": "4.0.0"}).encode())
    for name, (kind, width) in DATA.items():
        shape, block = ((width, n), (width, chunk)) if n else ((0,), (1,))
        _put(f"{uri}/{name}/attributes.json", store.attributes(shape, block, kind).encode())


def write_point_arrays(points: DataFrame, folder: str, sets: DataFrame | None = None, chunk: int = CHUNK) -> int:
    """Write the points (timepoint, setup, label, x, y, z, intensity) of each set, ids from 0 by place; sets of
    the table ``sets`` without points become empty ones. Returns the points written."""
    rows = points.select(*VIEW, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "intensity")]).withColumn("uri", set_path(folder))
    counts = rows.groupBy("uri").agg(F.count("*").alias("n"))
    if sets is not None:
        counts = sets.select(set_path(folder).alias("uri")).distinct().join(counts, "uri", "full").select("uri", F.coalesce("n", F.lit(0)).alias("n"))

    def begin(frames):
        import pandas as pd

        for f in frames:
            for uri, n in zip(f["uri"], f["n"], strict=True):
                _start(uri, int(n), chunk)
            yield pd.DataFrame({"n": [len(f)]})

    def write(f):
        import pandas as pd

        f = f.sort_values("rank")
        uri, k = f["uri"].iloc[0], int(f["chunk"].iloc[0])
        values = {"id": f["rank"].to_numpy()[None, :] - 1, "loc": f[["x", "y", "z"]].to_numpy().T, "intensities": f["intensity"].to_numpy()[None, :]}
        for name, (kind, _) in DATA.items():
            _put(f"{uri}/{name}/0/{k}", store.pack_block(np.ascontiguousarray(values[name]).astype(kind)))
        return pd.DataFrame({"n": [len(f)]})

    counts.mapInPandas(begin, "n long").agg(F.sum("n")).first()
    ranked = ordered.ranks(rows, ["uri"], ["x", "y", "z", "intensity"]).withColumn("chunk", F.floor((F.col("rank") - 1) / chunk))
    return ranked.groupBy("uri", "chunk").applyInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


class _Rows:
    """A data set of rows: N5 or Zarr version 2."""

    def __init__(self, uri: str):
        self.uri, self.n, self.block, self.width = uri, 0, 1, 0
        self.zarr, self.meta = True, arrays._bytes(f"{uri}/.zarray")
        if self.meta is None:
            self.zarr, self.meta = False, arrays._bytes(f"{uri}/attributes.json")
        if self.meta is None:
            return  # an absent set has no points
        self.meta = json.loads(self.meta)
        shape, block = (self.meta["shape"], self.meta["chunks"]) if self.zarr else (self.meta["dimensions"][::-1], self.meta["blockSize"][::-1])
        self.n, self.block, self.rank, self.width = shape[0], block[0], len(shape), shape[1] if len(shape) > 1 else 1
        if len(shape) > 1 and block[1] < self.width:
            raise ValueError(f"{uri}: a row lies in several chunks")

    def chunk(self, k: int) -> np.ndarray:
        """Rows k * block and on, as (rows, width)."""
        rows = min(self.block, self.n - k * self.block)
        if not self.zarr:
            raw = arrays._bytes("/".join([self.uri, *["0"] * (self.rank - 1), str(k)]))
            if raw is None:
                raise ValueError(f"{self.uri}: chunk {k} is missing")
            v = store.unpack_block(raw, self.meta["dataType"], self.meta["compression"]["type"])
            return v.reshape(-1, v.shape[-1]).T[:rows]
        raw = arrays._bytes(f"{self.uri}/" + self.meta.get("dimension_separator", ".").join([str(k), *["0"] * (self.rank - 1)]))
        if raw is None:
            return np.full((rows, self.width), self.meta.get("fill_value") or 0, dtype=self.meta["dtype"])
        v = np.frombuffer(arrays.decoded(self.meta, raw), dtype=self.meta["dtype"])
        return v.reshape(self.meta["chunks"], order=self.meta.get("order", "C")).reshape(self.block, -1)[:rows, : self.width]


def read_point_arrays(sets: DataFrame) -> DataFrame:
    """point_id, x, y, z, intensity (null where a set has none) of every point, with the columns of ``sets``, whose
    ``uri`` names the set's folder. Headers and chunks are read by executors; a set that is absent has no points."""
    keep = [c for c in sets.columns if c != "uri"]

    def heads(frames):
        for f in frames:
            found = [_Rows(f"{u}/loc") for u in f["uri"]]
            yield f.assign(chunks_=[-(-r.n // r.block) if r.n else 0 for r in found])

    def read(frames):
        import pandas as pd

        for f in frames:
            for _, r in f.iterrows():
                loc, ids, light = (_Rows(f"{r['uri']}/{name}") for name in ("loc", "id", "intensities"))
                k = int(r["chunk_"])
                at = loc.chunk(k)
                lo, n = k * loc.block, len(at)
                same = lambda x, lo=lo, n=n, loc=loc, k=k: x.chunk(k)[:, 0] if x.block == loc.block else _span(x, lo, lo + n)
                out = pd.DataFrame({"point_id": same(ids).astype("int64") if ids.n else np.arange(lo, lo + n), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]})
                out["intensity"] = same(light).astype("float64") if light.n else None
                for i, c in enumerate(keep):
                    out.insert(i, c, [r[c]] * n)
                yield out.astype({"x": "float64", "y": "float64", "z": "float64"})

    kinds = ", ".join(f"`{c}` {sets.schema[c].dataType.simpleString()}" for c in sets.columns)
    found = sets.mapInPandas(heads, f"{kinds}, chunks_ long").filter("chunks_ > 0")
    found = found.withColumn("chunk_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks_") - 1))).drop("chunks_").repartition("uri", "chunk_")
    out = "".join(f"`{c}` {sets.schema[c].dataType.simpleString()}, " for c in keep)
    return found.mapInPandas(read, f"{out}point_id long, x double, y double, z double, intensity double")


def _span(rows: _Rows, lo: int, hi: int) -> np.ndarray:
    """Values lo .. hi of a data set of one column, from the chunks that hold them."""
    first, last = lo // rows.block, (hi - 1) // rows.block
    v = np.concatenate([rows.chunk(k)[:, 0] for k in range(first, last + 1)])
    return v[lo - first * rows.block : hi - first * rows.block]
