"""Viewer files written by executors: point annotations by grid cell, and compressed segmentation."""

from __future__ import annotations

import itertools
import json
import math
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .shared import discard, written


def put(uri: str, data: bytes) -> None:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(path, compression=None) as f:
        f.write(data)


def write_annotations(points: DataFrame, folder: str, cell: tuple[float, float, float], names: tuple[str, str, str] = ("x", "y", "z"), unit: str = "m", scale: tuple[float, float, float] = (1e-6, 1e-6, 1e-6), limit: int = 10_000, levels: int = 16) -> dict:
    """Points (x, y, z) as annotations with a spatial index of up to ``levels`` grids, each of half the cells of the
    one before: one file a grid cell, written by the task that holds the cell. Points of one place are one
    annotation, points without a coordinate none.

    Every annotation stands in one level. A level takes an even random share (by a hash of the place) of those
    that are left, so that its fullest cell gets about ``limit``; all others go on to smaller cells, and the last
    level takes all that come to it. Returns the ``info`` that the driver writes; it names the most in a cell."""
    places = points.select(*[F.col(a).cast("double").alias(a) for a in "xyz"]).dropna().distinct()
    placed = written(places.withColumn("id", F.xxhash64("x", "y", "z")).withColumn("u", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 40)) / (1 << 40)), "annotations")
    b = placed.agg(*[f(a) for a in "xyz" for f in (F.min, F.max)]).first()
    lower, upper = [float(v or 0) for v in b[0::2]], [float(v or 0) for v in b[1::2]]

    def file_writer(level: int):
        def run(f):
            import pandas as pd

            f = f.sort_values(["x", "y", "z"])
            key = "_".join(str(int(f[f"c{a}"].iloc[0])) for a in "xyz")
            body = f[["x", "y", "z"]].to_numpy("<f4").tobytes() + f["id"].to_numpy().view("<u8").tobytes()
            put(f"{folder}/spatial{level}/{key}", struct.pack("<Q", len(f)) + body)
            return pd.DataFrame({"n": [len(f)]})

        return run

    spatial, taken = [], 0.0
    for k in range(levels):
        size = [c / 2**k for c in cell]
        at = [F.floor((F.col(a) - o) / c).cast("long").alias(f"c{a}") for a, o, c in zip("xyz", lower, size, strict=True)]
        left = placed.filter(F.col("u") >= taken).select("x", "y", "z", "id", "u", *at)
        most = left.groupBy("cx", "cy", "cz").count().agg(F.max("count")).first()[0] or 0
        if not most and k:
            break
        last = most <= limit or k == levels - 1
        upto = 1.0 if last else taken + (1 - taken) * limit / most
        made = left.filter(F.col("u") < upto).groupBy("cx", "cy", "cz").applyInPandas(file_writer(k), "n long").agg(F.max("n")).first()[0] or 0
        shape = [max(1, math.floor((u - o) / c) + 1) for o, u, c in zip(lower, upper, size, strict=True)]
        spatial.append({"key": f"spatial{k}", "grid_shape": shape, "chunk_size": size, "limit": made})
        taken = upto
        if last:
            break
    discard(placed)
    info = {
        "@type": "neuroglancer_annotations_v1", "annotation_type": "POINT", "dimensions": {n: [s, unit] for n, s in zip(names, scale, strict=True)},
        "lower_bound": lower, "upper_bound": upper, "properties": [], "relationships": [], "by_id": {"key": "by_id"}, "spatial": spatial,
    }
    put(f"{folder}/info", json.dumps(info).encode())
    return info


def read_annotations(spark, folder: str) -> DataFrame:
    """level, x, y, z, id of all annotations of all levels, a file a task."""
    files = spark.read.format("binaryFile").load(f"{folder}/spatial*/*")
    level = F.regexp_extract("path", r"/spatial(\d+)/[^/]+$", 1).cast("int")

    def run(frames):
        import pandas as pd

        for f in frames:
            for k, raw in zip(f["level"], f["content"], strict=True):
                (n,) = struct.unpack_from("<Q", raw)
                xyz = np.frombuffer(raw, "<f4", 3 * n, 8).reshape(n, 3).astype(float)
                yield pd.DataFrame({"level": k, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "id": np.frombuffer(raw, "<u8", n, 8 + 12 * n).view("<i8")})

    return files.select(level.alias("level"), "content").mapInPandas(run, "level int, x double, y double, z double, id long")


def encode_segmentation(v: np.ndarray, block: tuple[int, int, int] = (8, 8, 8)) -> bytes:
    """One channel of labels (x, y, z) in the compressed segmentation format: for each block its look-up table
    and packed indices; equal tables are stored once."""
    wide = v.dtype.itemsize // 4
    grid = [-(-n // b) for n, b in zip(v.shape, block, strict=True)]
    headers = np.zeros((math.prod(grid), 2), dtype="<u4")
    body: list[bytes] = []
    size, tables = headers.size, {}
    for k, (z, y, x) in enumerate(itertools.product(*map(range, grid[::-1]))):
        part = v[tuple(slice(i * b, (i + 1) * b) for i, b in zip((x, y, z), block, strict=True))]
        full = np.pad(part, [(0, b - n) for n, b in zip(part.shape, block, strict=True)], mode="edge")
        table, bits, packed = store.encode_labels(full.transpose(2, 1, 0))
        headers[k, 1] = size
        body.append(packed)
        size += len(packed) // 4
        raw = table.astype(f"<u{4 * wide}").tobytes()
        if raw not in tables:
            tables[raw] = size
            body.append(raw)
            size += len(raw) // 4
        headers[k, 0] = tables[raw] | bits << 24
    if size >= 1 << 24:
        raise ValueError("the block is too large for 24-bit offsets")
    return struct.pack("<I", 1) + headers.tobytes() + b"".join(body)


def decode_segmentation(raw: bytes, shape: tuple[int, int, int], kind: str, block: tuple[int, int, int] = (8, 8, 8)) -> np.ndarray:
    words = np.frombuffer(raw, dtype="<u4")[1:]
    out, grid = np.zeros(shape, dtype=kind), [-(-n // b) for n, b in zip(shape, block, strict=True)]
    for k, (z, y, x) in enumerate(itertools.product(*map(range, grid[::-1]))):
        bits, at, values = int(words[2 * k]) >> 24, int(words[2 * k]) & 0xFFFFFF, int(words[2 * k + 1])
        n = math.prod(block) * bits // 32
        table = words[at : at + min(1 << bits, math.prod(block)) * np.dtype(kind).itemsize // 4].tobytes()
        table = np.frombuffer(table[: len(table) // np.dtype(kind).itemsize * np.dtype(kind).itemsize], dtype=kind)
        got = store.decode_labels(table, bits, words[values : values + n].tobytes(), block[::-1]).transpose(2, 1, 0)
        here = tuple(slice(i * b, min((i + 1) * b, m)) for i, b, m in zip((x, y, z), block, shape, strict=True))
        out[here] = got[tuple(slice(0, s.stop - s.start) for s in here)]
    return out


def zoom_index(n: int, factor: float) -> np.ndarray:
    """For each place of an axis of n voxels zoomed by ``factor``, its source voxel: the nearest, ends at ends."""
    m = max(1, int(round(n * factor)))
    return np.floor(np.arange(m) * ((n - 1) / max(m - 1, 1)) + 0.5).astype(int)


def write_segmentation(blocks: DataFrame, folder: str, shape: tuple[int, int, int], chunk: tuple[int, int, int], kind: str = "uint32", resolution: tuple[float, float, float] = (1.0, 1.0, 1.0), factors: tuple[tuple[float, float, float], ...] = ((1.0, 1.0, 1.0),)) -> dict:
    """Label blocks (origin, shape, data of ``kind``; disjoint, cut in any way) of a volume as files of several
    scales, zoomed by ``factors`` to the nearest label.

    One pass over the blocks: each gives every scale the voxels that it owns there, cut at the borders of that
    scale's chunks, so that only what is kept is shuffled; the task that holds a chunk's pieces encodes and writes it.
    Labels that no block gives are 0, and chunks without any block are not written."""
    index = [[zoom_index(n, f) for n, f in zip(shape, fs, strict=True)] for fs in factors]
    sizes = [[len(i) for i in axes] for axes in index]
    steps = [[r / f for r, f in zip(resolution, fs, strict=True)] for fs in factors]
    keys = ["_".join(f"{v:g}" for v in r) for r in steps]
    if len(set(keys)) < len(keys):
        raise ValueError("two scales have one resolution")
    info = {
        "@type": "neuroglancer_multiscale_volume", "type": "segmentation", "data_type": kind, "num_channels": 1,
        "scales": [{"key": k, "size": n, "resolution": r, "chunk_sizes": [list(chunk)], "encoding": "compressed_segmentation", "compressed_segmentation_block_size": [8, 8, 8], "voxel_offset": [0, 0, 0]} for k, n, r in zip(keys, sizes, steps, strict=True)],
    }
    names = ["scale", "c0", "c1", "c2", "o0", "o1", "o2", "n0", "n1", "n2", "data"]

    def cut(frames):
        import pandas as pd

        for f in frames:
            for b in f.itertuples(index=False):
                v, rows = np.frombuffer(b.data, dtype=kind).reshape(tuple(b.shape)), []
                for s, axes in enumerate(index):
                    own = [np.searchsorted(i, (o, o + n)) for i, o, n in zip(axes, b.origin, b.shape, strict=True)]
                    spans = [[(c, max(lo, c * w), min(hi, (c + 1) * w)) for c in range(lo // w, -(-hi // w))] if lo < hi else [] for (lo, hi), w in zip(own, chunk, strict=True)]
                    for span in itertools.product(*spans):
                        part = v[np.ix_(*[i[lo:hi] - o for i, (_, lo, hi), o in zip(axes, span, b.origin, strict=True)])]
                        rows.append((s, *[c for c, _, _ in span], *[lo for _, lo, _ in span], *part.shape, part.tobytes()))
                yield pd.DataFrame(rows, columns=names)

    def write(f):
        import pandas as pd

        s, at = int(f["scale"].iloc[0]), [int(f[f"c{d}"].iloc[0]) * chunk[d] for d in range(3)]
        end = [min(o + w, n) for o, w, n in zip(at, chunk, sizes[s], strict=True)]
        v = np.zeros([e - o for o, e in zip(at, end, strict=True)], dtype=kind)
        for r in f.itertuples(index=False):
            here = tuple(slice(o - a, o - a + n) for o, a, n in zip((r.o0, r.o1, r.o2), at, (r.n0, r.n1, r.n2), strict=True))
            v[here] = np.frombuffer(r.data, dtype=kind).reshape(r.n0, r.n1, r.n2)
        put(f"{folder}/{keys[s]}/" + "_".join(f"{o}-{e}" for o, e in zip(at, end, strict=True)), encode_segmentation(v))
        return pd.DataFrame({"n": [1]})

    pieces = blocks.select("origin", "shape", "data").mapInPandas(cut, ", ".join(f"{c} {'binary' if c == 'data' else 'long'}" for c in names))
    pieces.groupBy("scale", "c0", "c1", "c2").applyInPandas(write, "n long").agg(F.sum("n")).first()
    put(f"{folder}/info", json.dumps(info).encode())
    return info


def read_segmentation(spark, folder: str, scale: int = 0) -> DataFrame:
    """origin, shape, data of the chunks of one scale that were written, each decoded by a task."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(f"{folder}/info")
    with where.open_input_stream(path) as f:
        info = json.loads(f.read())
    kind, found = info["data_type"], info["scales"][scale]
    counts = [-(-n // c) for n, c in zip(found["size"], found["chunk_sizes"][0], strict=True)]
    chunk, size, key = found["chunk_sizes"][0], found["size"], found["key"]

    def run(frames):
        import pandas as pd

        for f in frames:
            for i in f["id"]:
                at = [int(a) * c for a, c in zip(np.unravel_index(i, counts), chunk, strict=True)]
                end = [min(o + c, n) for o, c, n in zip(at, chunk, size, strict=True)]
                where, path = fs.FileSystem.from_uri(f"{folder}/{key}/" + "_".join(f"{o}-{e}" for o, e in zip(at, end, strict=True)))
                if where.get_file_info(path).type == fs.FileType.NotFound:
                    continue
                with where.open_input_stream(path) as g:
                    v = decode_segmentation(g.read(), tuple(e - o for o, e in zip(at, end, strict=True)), kind)
                yield pd.DataFrame({"origin": [at], "shape": [list(v.shape)], "data": [v.tobytes()]})

    return spark.range(math.prod(counts)).mapInPandas(run, "origin array<long>, shape array<long>, data binary")
