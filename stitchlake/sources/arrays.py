"""Image volumes in chunked stores, read and written by executors block by block.

``read_blocks`` reads Zarr (versions 2 and 3, C order; raw, zlib, gzip, zstd or Blosc chunks), chunk
folders with an ``attributes.json`` (see ``store``) and TIFF stacks (also large ones; strips or tiles; raw,
deflate, LZW or zstd, with or without differences): one Spark partition a block, with a halo, optionally
averaged to a lower resolution. A task opens only the chunks (strips, tiles) that its block needs.
``write_blocks`` writes blocks as chunks of a Zarr array from the executors; a repeated task writes the
same bytes to the same names. Axes are x, y, z; on disk Zarr arrays are (.., z, y, x).
"""

from __future__ import annotations

import functools
import gzip
import itertools
import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import codecs, store

SCHEMA = "x0 long, y0 long, z0 long, nx int, ny int, nz int, cx0 long, cy0 long, cz0 long, cx1 long, cy1 long, cz1 long, data binary"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _bytes(uri: str) -> bytes | None:
    from pyarrow import fs

    where, path = _open(uri)
    if where.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with where.open_input_stream(path, compression=None) as f:
        return f.read()


_DECODERS = {"zstd": codecs.zstd, "blosc": codecs.blosc}


def decoded(meta: dict, raw: bytes) -> bytes:
    """A chunk of a version 2 array, uncompressed."""
    c = meta.get("compressor")
    if c is None:
        return raw
    if c["id"] in ("zlib", "gzip"):
        return zlib.decompress(raw, 47)
    if c["id"] in _DECODERS:
        return _DECODERS[c["id"]](raw)
    raise ValueError(f"compressor {c['id']} is not known")


class ZarrArray:
    """Zarr version 2; axes before the last three are taken at 0."""

    def __init__(self, uri: str, meta: dict):
        self.uri, self.meta = uri.rstrip("/"), meta
        if meta.get("order", "C") != "C" or meta.get("filters"):
            raise ValueError("only C order without filters can be read")
        self.lead = len(meta["shape"]) - 3
        self.shape, self.chunk = tuple(meta["shape"][:-4:-1]), tuple(meta["chunks"][:-4:-1])
        self.kind = np.dtype(meta["dtype"])

    def decode(self, raw: bytes) -> bytes:
        return decoded(self.meta, raw)

    def name(self, index: tuple[int, int, int]) -> str:
        return self.meta.get("dimension_separator", ".").join(map(str, [0] * self.lead + list(index[::-1])))

    def read_chunk(self, index: tuple[int, int, int]) -> np.ndarray:
        raw = _bytes(f"{self.uri}/{self.name(index)}")
        size = self.meta["chunks"]
        if raw is None:
            return np.full(self.chunk, self.meta.get("fill_value") or 0, dtype=self.kind)
        v = np.frombuffer(self.decode(raw), dtype=self.kind).reshape(size)
        return v[(0,) * self.lead].transpose(2, 1, 0)


class Zarr3Array(ZarrArray):
    """Zarr version 3: a regular grid; codecs ``bytes``, then gzip, zstd, blosc or crc32c in any order."""

    def __init__(self, uri: str, meta: dict):
        steps = [(c["name"], c.get("configuration", {})) for c in meta["codecs"]]
        if meta["chunk_grid"]["name"] != "regular" or not steps or steps[0][0] != "bytes":
            raise ValueError("only regular grids whose first codec is bytes can be read")
        self.after = [n for n, _ in steps[1:]]
        if unknown := set(self.after) - {"gzip", "crc32c", *_DECODERS}:
            raise ValueError(f"codecs {sorted(unknown)} are not known")
        kind = np.dtype(meta["data_type"]).newbyteorder(">" if steps[0][1].get("endian") == "big" else "<")
        keys = meta.get("chunk_key_encoding", {"name": "default"})
        mark = keys.get("configuration", {}).get("separator", "/" if keys["name"] == "default" else ".")
        self.prefix = "c" + mark if keys["name"] == "default" else ""
        two = {"shape": meta["shape"], "chunks": meta["chunk_grid"]["configuration"]["chunk_shape"], "dtype": kind.str, "dimension_separator": mark, "fill_value": meta.get("fill_value")}
        super().__init__(uri, two)

    def name(self, index: tuple[int, int, int]) -> str:
        return self.prefix + super().name(index)

    def decode(self, raw: bytes) -> bytes:
        for name in reversed(self.after):
            raw = raw[:-4] if name == "crc32c" else zlib.decompress(raw, 47) if name == "gzip" else _DECODERS[name](raw)
        return raw


class FolderArray:
    """Blocks of ``store.pack_block`` in folders by index."""

    def __init__(self, uri: str, meta: dict):
        self.uri, self.meta = uri.rstrip("/"), meta
        self.shape, self.chunk, self.kind = tuple(meta["dimensions"]), tuple(meta["blockSize"]), np.dtype(meta["dataType"])

    def read_chunk(self, index: tuple[int, int, int]) -> np.ndarray:
        raw = _bytes("/".join([self.uri, *map(str, index)]))
        out = np.zeros(self.chunk, dtype=self.kind)
        if raw is not None:
            v = store.unpack_block(raw, self.meta["dataType"], self.meta["compression"]["type"])
            out[tuple(slice(0, n) for n in v.shape)] = v
        return out


class TiffStack:
    """Pages of a TIFF or BigTIFF file as z; one sample a pixel. A chunk is a tile or a strip of a page."""

    #: Kinds by bits and sample format, sizes of entries' types, and compressions.
    _KINDS = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (8, 2): "i1", (16, 2): "i2", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8"}
    _SIZES = {1: "B", 3: "H", 4: "I", 16: "Q"}
    _PACKED = {1: bytes, 5: codecs.lzw, 8: zlib.decompress, 32946: zlib.decompress, 50000: codecs.zstd}

    def __init__(self, uri: str):
        self.uri, self.pages = uri, []
        with self._file() as f:
            head = f.read(16)
            self.end = {b"II": "<", b"MM": ">"}.get(head[:2])
            magic = struct.unpack(self.end + "H", head[2:4])[0] if self.end else 0
            if magic not in (42, 43):
                raise ValueError("not a TIFF file")
            big = magic == 43
            self.offset, count = ("Q", "Q") if big else ("I", "H")
            (at,) = struct.unpack_from(self.end + self.offset, head, 8 if big else 4)
            wide, many = struct.calcsize(self.end + self.offset), struct.calcsize(self.end + count)
            size = 4 + 2 * wide
            while at:
                f.seek(at)
                (n,) = struct.unpack(self.end + count, f.read(many))
                entries = f.read(size * n)
                (at,) = struct.unpack(self.end + self.offset, f.read(wide))
                self.pages.append(dict(self._entry(f, entries[size * i : size * (i + 1)]) for i in range(n)))
        p = self.pages[0]
        one = lambda tag, default=None: p.get(tag, [default])[0]
        self.packing, self.differences = one(259, 1), one(317, 1) == 2
        if one(277, 1) != 1 or self.packing not in self._PACKED or one(317, 1) not in (1, 2):
            raise ValueError("only pages of one sample; raw, deflate, LZW or zstd; plain or with differences can be read")
        self.shape = (p[256][0], p[257][0], len(self.pages))
        self.tiled = 322 in p
        self.chunk = (one(322), one(323), 1) if self.tiled else (self.shape[0], min(one(278, self.shape[1]), self.shape[1]), 1)
        self.kind = np.dtype(self.end + self._KINDS[one(258), one(339, 1)])
        if self.differences and self.kind.kind == "f":
            raise ValueError("differences of floats cannot be read")

    def _file(self):
        where, path = _open(self.uri)
        return where.open_input_file(path)

    def _entry(self, f, raw: bytes):
        tag, kind, n = struct.unpack_from(self.end + "HH" + self.offset, raw)
        code, value = self._SIZES.get(kind), raw[4 + struct.calcsize(self.end + self.offset) :]
        if code is None:
            return tag, []
        size = n * struct.calcsize(code)
        data = value[:size]
        if size > len(value):
            f.seek(struct.unpack(self.end + self.offset, value)[0])
            data = f.read(size)
        return tag, list(struct.unpack(f"{self.end}{n}{code}", data))

    def read_chunk(self, index: tuple[int, int, int]) -> np.ndarray:
        p, (x, y, z) = self.pages[index[2]], index
        across = -(-self.shape[0] // self.chunk[0])
        places, sizes = (p[324], p[325]) if self.tiled else (p[273], p[279])
        with self._file() as f:
            f.seek(places[y * across + x])
            raw = self._PACKED[self.packing](f.read(sizes[y * across + x]))
        rows = self.chunk[1] if self.tiled else min(self.chunk[1], self.shape[1] - y * self.chunk[1])
        v = np.frombuffer(raw, dtype=self.kind, count=rows * self.chunk[0]).reshape(rows, self.chunk[0])
        if self.differences:
            v = codecs.undo_differences(v.astype(self.kind.newbyteorder("=")))
        return v.T[:, :, None]


@functools.lru_cache(maxsize=256)
def open_array(uri: str):
    """The array at a URI; headers are read once a process."""
    if uri.lower().endswith((".tif", ".tiff")):
        return TiffStack(uri)
    if (meta := _bytes(uri.rstrip("/") + "/.zarray")) is not None:
        return ZarrArray(uri, json.loads(meta))
    if (meta := _bytes(uri.rstrip("/") + "/zarr.json")) is not None:
        return Zarr3Array(uri, json.loads(meta))
    if (meta := _bytes(uri.rstrip("/") + "/attributes.json")) is not None:
        return FolderArray(uri, json.loads(meta))
    raise ValueError(f"{uri} is no array")


def shapes(spark: SparkSession, uris: DataFrame) -> DataFrame:
    """uri, shape (x, y, z), chunk, kind of each array of a table (uri); headers only, by the executors."""

    def run(frames):
        import pandas as pd

        for f in frames:
            found = [(u, open_array(u)) for u in f["uri"]]
            yield pd.DataFrame({"uri": [u for u, _ in found], "shape": [list(a.shape) for _, a in found], "chunk": [list(a.chunk) for _, a in found], "kind": [a.kind.name for _, a in found]})

    return uris.select("uri").mapInPandas(run, "uri string, shape array<long>, chunk array<long>, kind string")


def read_slice(array, lo: tuple[int, int, int], hi: tuple[int, int, int]) -> np.ndarray:
    """Voxels lo to hi (not included), from the chunks that hold them."""
    out = np.zeros([b - a for a, b in zip(lo, hi, strict=True)], dtype=array.kind.newbyteorder("="))
    for index in itertools.product(*[range(a // c, -(-b // c)) for a, b, c in zip(lo, hi, array.chunk, strict=True)]):
        at = [i * c for i, c in zip(index, array.chunk, strict=True)]
        first = [max(a, o) for a, o in zip(lo, at, strict=True)]
        last = [min(b, o + c) for b, o, c in zip(hi, at, array.chunk, strict=True)]
        v = array.read_chunk(index)
        out[tuple(slice(f - a, e - a) for f, e, a in zip(first, last, lo, strict=True))] = v[tuple(slice(f - o, e - o) for f, e, o in zip(first, last, at, strict=True))]
    return out


def averaged(v: np.ndarray, factor: tuple[int, int, int]) -> np.ndarray:
    """Means over cells; an incomplete cell at the end is dropped."""
    v = v[tuple(slice(0, n // f * f) for n, f in zip(v.shape, factor, strict=True))]
    shape = [x for n, f in zip(v.shape, factor, strict=True) for x in (n // f, f)]
    return v.reshape(shape).mean(axis=(1, 3, 5))


class _Block(InputPartition):
    def __init__(self, index):
        self.index = index


def _three(text: str) -> tuple[int, int, int]:
    found = tuple(int(v) for v in str(text).split(","))
    return found if len(found) == 3 else found * 3


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"]
        array = open_array(self.uri)
        self.factor, self.halo = _three(options.get("factor", "1")), _three(options.get("halo", "0"))
        self.shape = tuple(n // f for n, f in zip(array.shape, self.factor, strict=True))
        self.block = _three(options["block"]) if "block" in options else tuple(max(1, c // f) for c, f in zip(array.chunk, self.factor, strict=True))

    def partitions(self):
        return [_Block(i) for i in itertools.product(*[range(-(-n // b)) for n, b in zip(self.shape, self.block, strict=True)])]

    def read(self, partition):
        core = [i * b for i, b in zip(partition.index, self.block, strict=True)]
        end = [min(o + b, n) for o, b, n in zip(core, self.block, self.shape, strict=True)]
        lo = [max(0, o - h) for o, h in zip(core, self.halo, strict=True)]
        hi = [min(n, e + h) for n, e, h in zip(self.shape, end, self.halo, strict=True)]
        full = [tuple(a * f for a, f in zip(x, self.factor, strict=True)) for x in (lo, hi)]
        v = averaged(read_slice(open_array(self.uri), *full).astype(np.float32), self.factor)
        yield (*lo, *v.shape, *core, *end, v.astype("<f4").tobytes())


class ArrayBlocks(DataSource):
    """``spark.read.format("array-blocks")`` with path, and optionally block, halo and factor ("64,64,32" or
    one number for all axes)."""

    @classmethod
    def name(cls):
        return "array-blocks"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))


def read_blocks(spark: SparkSession, uri: str, block: tuple[int, int, int] | None = None, halo: int = 0, factor: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """float32 blocks of an array, with their halo, as ``detection.detect_points`` takes them."""
    spark.dataSource.register(ArrayBlocks)
    reader = spark.read.format("array-blocks").option("halo", str(halo)).option("factor", ",".join(map(str, factor)))
    return (reader.option("block", ",".join(map(str, block))) if block else reader).load(uri)


def create_zarr(uri: str, shape: tuple[int, int, int], chunk: tuple[int, int, int], kind: str = "<u2", compressor: str | None = "zstd", level: int = 1, attributes: dict | None = None) -> dict:
    """The header of an empty five-axis Zarr array (t, c, z, y, x); shapes are rounded up to chunks."""
    whole = [-(-n // c) * c for n, c in zip(shape, chunk, strict=True)]
    meta = {
        "zarr_format": 2, "shape": [1, 1, *whole[::-1]], "chunks": [1, 1, *chunk[::-1]], "dtype": kind, "order": "C", "fill_value": 0, "filters": None,
        "dimension_separator": "/", "compressor": {"id": compressor, "level": level} if compressor else None,
    }
    where, path = _open(uri)
    where.create_dir(path, recursive=True)
    for name, content in ((".zarray", meta), (".zattrs", attributes)):
        if content is not None:
            with where.open_output_stream(f"{path}/{name}") as f:
                f.write(json.dumps(content).encode())
    return meta


def _packed(array, raw: bytes) -> bytes:
    c = array.meta["compressor"]
    if c is None:
        return raw
    if c["id"] == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=c["level"]).compress(raw)
    if c["id"] == "blosc":
        return codecs.to_blosc(raw, array.kind.itemsize)
    return zlib.compress(raw, c["level"]) if c["id"] == "zlib" else gzip.compress(raw, mtime=0)


def put_block(array: ZarrArray, origin, v: np.ndarray) -> int:
    """Write the chunks of one block; it begins at chunk borders and ends there or at the array's end. Returns how
    many chunks it has."""
    ends = [o + n for o, n in zip(origin, v.shape, strict=True)]
    if any(o % c for o, c in zip(origin, array.chunk, strict=True)) or any(e % c and -(-e // c) * c < n for e, c, n in zip(ends, array.chunk, array.shape, strict=True)):
        raise ValueError(f"block at {list(origin)} of {list(v.shape)} does not begin and end at chunks")
    if array.kind.kind in "iu" and v.dtype != array.kind:
        v = np.clip(np.rint(v), np.iinfo(array.kind).min, np.iinfo(array.kind).max)
    where, path = _open(array.uri)
    found = list(itertools.product(*[range(-(-n // c)) for n, c in zip(v.shape, array.chunk, strict=True)]))
    for index in found:
        part = v[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, array.chunk, strict=True))]
        whole = np.zeros(array.chunk, dtype=array.kind)
        whole[tuple(slice(0, n) for n in part.shape)] = part
        full = f"{path}/{array.name([o // c + i for o, c, i in zip(origin, array.chunk, index, strict=True)])}"
        where.create_dir(full.rpartition("/")[0], recursive=True)
        with where.open_output_stream(full, compression=None) as out:
            out.write(_packed(array, np.ascontiguousarray(whole.transpose(2, 1, 0)).tobytes()))
    return len(found)


#: Blocks of voxels as rows, in the kind of their source (first axis slowest).
VOXELS = "origin array<long>, shape array<long>, kind string, data binary"


def voxels(row) -> np.ndarray:
    """The array of a row of ``VOXELS``; without a kind float64."""
    return np.frombuffer(row.data, dtype=getattr(row, "kind", None) or "<f8").reshape(tuple(row.shape))


def write_blocks(blocks: DataFrame, uri: str) -> int:
    """Write blocks (``VOXELS``, or float64 without a kind) into the Zarr array at ``uri``, from the executors;
    returns their number."""

    def run(frames):
        import pandas as pd

        array = open_array(uri)
        for f in frames:
            for b in f.itertuples(index=False):
                put_block(array, b.origin, voxels(b))
            yield pd.DataFrame({"n": [len(f)]})

    kept = [c for c in ("origin", "shape", "kind", "data") if c in blocks.columns]
    return blocks.select(*kept).mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_tiles(tiles: DataFrame, block: tuple[int, int, int] | None = None) -> DataFrame:
    """tile and ``VOXELS`` of all blocks of many arrays, ``tiles`` (tile, uri), in their own kind: headers and
    blocks are read by executors, nothing is listed on the driver. ``block`` defaults to each array's chunks."""
    spark = tiles.sparkSession
    size = F.array(*map(F.lit, block)).cast("array<long>") if block else F.col("chunk")
    found = shapes(spark, tiles.select("uri")).withColumn("size", size).join(tiles.select("tile", "uri"), "uri")
    for d in range(3):
        n = F.ceil(F.get("shape", F.lit(d)) / F.get("size", F.lit(d)))
        found = found.withColumn(f"i{d}", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))

    def run(frames):
        import pandas as pd

        for f in frames:
            for r in f.itertuples(index=False):
                lo = [i * n for i, n in zip((r.i0, r.i1, r.i2), r.size, strict=True)]
                v = read_slice(open_array(r.uri), lo, [min(o + n, m) for o, n, m in zip(lo, r.size, r.shape, strict=True)])
                yield pd.DataFrame([(r.tile, lo, list(v.shape), v.dtype.str, v.tobytes())], columns=["tile", "origin", "shape", "kind", "data"])

    rows = found.select("tile", "uri", "shape", F.col("size").alias("size"), "i0", "i1", "i2").repartition("uri", "i0", "i1", "i2")
    return rows.mapInPandas(run, f"tile {tiles.schema['tile'].dataType.simpleString()}, {VOXELS}")
