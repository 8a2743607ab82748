"""Tables of points, correspondences and volume blocks, and chunked array files.

Point sets and correspondences live in Parquet partitioned by view and label; overwriting a view
replaces its partitions alone. Chunked arrays (raw or gzip blocks with a JSON header, big-endian)
are read by a Spark data source with one partition a block.
"""

from __future__ import annotations

import gzip
import itertools
import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_PER_FILE = 300_000
VIEW = ["timepoint", "setup", "label"]


def write_points(points: DataFrame, path: str) -> None:
    """timepoint, setup, label, x, y, z, intensity; ids count from 0 in each set, by place, over all tasks."""
    from ..operators.ordered import ranks

    numbered = ranks(points, VIEW, ["x", "y", "z", "intensity"], "point_id")
    _replace(numbered.withColumn("point_id", F.col("point_id") - 1), path, VIEW)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_correspondences(matches: DataFrame, path: str) -> None:
    """view_a, label_a, id_a, view_b, label_b, id_b, stored in both directions."""
    flipped = matches.select(*[F.col(f"{c}_{'b' if s == 'a' else 'a'}").alias(f"{c}_{s}") for s in "ab" for c in ("view", "label", "id")])
    _replace(matches.select(*flipped.columns).unionByName(flipped).distinct(), path, ["view_a", "label_a"])


#: Kinds of stored correspondences whose views and labels are texts.
CORRESPONDENCES = "id_a long, view_b string, label_b string, id_b long, view_a string, label_a string"


def read_correspondences(spark: SparkSession, path: str, directed: bool = False, schema: str | None = None) -> DataFrame:
    """Each correspondence once unless ``directed``. Only with a schema can a store without any be read, and
    do views and labels that look like numbers stay texts."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return df if directed else df.filter("view_a < view_b OR (view_a = view_b AND id_a < id_b)")


def _replace(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(*by).parquet(path)


# ---- chunked arrays ----

_KINDS = {"uint8": ">u1", "uint16": ">u2", "uint32": ">u4", "uint64": ">u8", "int16": ">i2", "int32": ">i4", "float32": ">f4", "float64": ">f8"}


def pack_block(v: np.ndarray, compression: str = "gzip") -> bytes:
    """One block: mode, rank, dimensions, values (first axis fastest), big-endian."""
    head = struct.pack(">HH", 0, v.ndim) + struct.pack(f">{v.ndim}I", *v.shape)
    body = v.astype(_KINDS[v.dtype.name]).tobytes(order="F")
    return head + (gzip.compress(body, mtime=0) if compression == "gzip" else body)


def unpack_block(raw: bytes, kind: str, compression: str) -> np.ndarray:
    mode, rank = struct.unpack_from(">HH", raw)
    shape = struct.unpack_from(f">{rank}I", raw, 4)
    at = 4 + 4 * rank + (4 if mode == 1 else 0)
    body = zlib.decompress(raw[at:], 47) if compression == "gzip" else raw[at:]
    return np.frombuffer(body, dtype=_KINDS[kind], count=int(np.prod(shape))).reshape(shape, order="F").astype(kind)


def attributes(shape: tuple[int, ...], block: tuple[int, ...], kind: str, compression: str = "gzip") -> str:
    return json.dumps({"dimensions": shape, "blockSize": block, "dataType": kind, "compression": {"type": compression}})


class _Block(InputPartition):
    def __init__(self, index):
        self.index = index


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        from pyarrow import fs

        self.folder = folder
        where, path = fs.FileSystem.from_uri(folder)
        self.meta = json.loads(where.open_input_stream(f"{path}/attributes.json").read())

    def partitions(self):
        counts = [-(-n // b) for n, b in zip(self.meta["dimensions"], self.meta["blockSize"], strict=True)]
        return [_Block(i) for i in itertools.product(*map(range, counts))]

    def read(self, partition):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(self.folder)
        full = "/".join([path, *map(str, partition.index)])
        if where.get_file_info(full).type == fs.FileType.NotFound:
            return  # absent blocks are empty
        v = unpack_block(where.open_input_stream(full).read(), self.meta["dataType"], self.meta["compression"]["type"])
        origin = [i * b for i, b in zip(partition.index, self.meta["blockSize"], strict=True)]
        yield (origin, list(v.shape), v.astype("<f8").tobytes())


class ChunkedArray(DataSource):
    """``spark.read.format("chunked-array").load(uri)``: origin, shape, data (float64, C order) of each block."""

    @classmethod
    def name(cls):
        return "chunked-array"

    def schema(self):
        return "origin array<long>, shape array<long>, data binary"

    def reader(self, schema):
        return _Reader(self.options["path"])


def read_array(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ChunkedArray)
    return spark.read.format("chunked-array").load(folder)


# ---- segmentation blocks ----


def encode_labels(v: np.ndarray) -> tuple[np.ndarray, int, bytes]:
    """Look-up table, bits a voxel, and packed indices (32-bit words) of a label block."""
    table, index = np.unique(v, return_inverse=True)
    bits = next(b for b in (0, 1, 2, 4, 8, 16, 32) if len(table) <= 1 << b)
    flat = index.ravel().astype(np.uint64)
    if not bits:
        return table, 0, b""
    per = 32 // bits
    flat = np.concatenate([flat, np.zeros(-len(flat) % per, dtype=np.uint64)]).reshape(-1, per)
    words = (flat << (np.arange(per, dtype=np.uint64) * np.uint64(bits))).sum(axis=1)
    return table, bits, words.astype("<u4").tobytes()


def decode_labels(table: np.ndarray, bits: int, packed: bytes, shape: tuple[int, ...]) -> np.ndarray:
    n = int(np.prod(shape))
    if not bits:
        return np.full(shape, table[0])
    words = np.frombuffer(packed, dtype="<u4").astype(np.uint64)
    per = 32 // bits
    index = (words[:, None] >> (np.arange(per, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
    return table[index.ravel()[:n].astype(int)].reshape(shape)
