"""Chunk codecs, fusion from store to store, resumable pyramids."""

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from stitchlake.functions import geometry as G
from stitchlake.operators import fusion
from stitchlake.sources import arrays, codecs

MODEL = "tile long, uri string, " + ", ".join(f"{n} double" for n in G.NAMES)


def blosc_frame(raw, itemsize, block, inner, shuffle=1, split=True):
    """A frame by hand: header, places of blocks, streams with their lengths."""
    pack = {
        "lz4": lambda b: pa.Codec("lz4_raw").compress(b, asbytes=True), "zstd": lambda b: zstandard.ZstdCompressor().compress(b),
        "zlib": zlib.compress, "snappy": lambda b: pa.Codec("snappy").compress(b, asbytes=True),
    }[inner]
    flags = {"lz4": 1, "snappy": 2, "zlib": 3, "zstd": 4}[inner] << 5 | {0: 0, 1: 1, 2: 4}[shuffle] | (0 if split else 16)
    starts, body = [], b""
    count = -(-len(raw) // block)
    for i in range(count):
        part = np.frombuffer(raw[i * block : (i + 1) * block], dtype=np.uint8)
        n = len(part) // itemsize
        if shuffle == 1:
            part = np.concatenate([part[: n * itemsize].reshape(n, itemsize).T.ravel(), part[n * itemsize :]])
        elif shuffle == 2 and n % 8 == 0:
            bits = np.unpackbits(part[: n * itemsize].reshape(n, itemsize), axis=1, bitorder="little")
            part = np.concatenate([np.packbits(bits.T.ravel(), bitorder="little"), part[n * itemsize :]])
        streams = itemsize if split and itemsize <= 16 and block // itemsize >= 128 and len(part) == block else 1
        starts.append(16 + 4 * count + len(body))
        for s in np.split(part, streams):
            got = pack(s.tobytes())
            got = s.tobytes() if len(got) >= len(s) else got
            body += struct.pack("<i", len(got)) + got
    whole = 16 + 4 * count + len(body)
    return struct.pack("<BBBBIII", 2, 1, flags, itemsize, len(raw), block, whole) + struct.pack(f"<{count}I", *starts) + body


@pytest.mark.parametrize("inner", ["lz4", "zstd", "zlib", "snappy"])
@pytest.mark.parametrize("shuffle", [0, 1, 2])
@pytest.mark.parametrize("split", [True, False])
def test_blosc_frames(inner, shuffle, split):
    rng = np.random.default_rng(0)
    for kind, n in (("<u2", 5000), ("<u4", 1001), ("u1", 700), ("<f8", 333)):
        v = np.cumsum(rng.integers(0, 3, n)).astype(kind)
        assert codecs.blosc(blosc_frame(v.tobytes(), v.itemsize, 2048, inner, shuffle, split)) == v.tobytes()
    noise = rng.bytes(5000)
    assert codecs.blosc(blosc_frame(noise, 4, 1024, inner, shuffle, split)) == noise


def test_blosc_odd_frames():
    copied = struct.pack("<BBBBIII", 2, 1, 2, 4, 5, 64, 21) + b"hello"
    assert codecs.blosc(copied) == b"hello"
    assert codecs.blosc(struct.pack("<BBBBIII", 2, 1, 33, 4, 0, 64, 16)) == b""
    for bad, says in ((b"x", "header"), (copied[:-1], "ends early"), (struct.pack("<BBBBIII", 2, 1, 0, 4, 5, 64, 16) + b"", "blosclz")):
        with pytest.raises(ValueError, match=says):
            codecs.blosc(bad)


def lzw_packed(raw):
    """A plain LZW encoder with TIFF's early change of widths."""
    table, width, out, held, n = {bytes([i]): i for i in range(256)}, 9, bytearray(), 0, 0

    def put(code):
        nonlocal held, n
        held, n = held << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(held >> n & 255)
        held &= (1 << n) - 1

    put(256)
    size, w = 258, b""
    for c in raw:
        if w + bytes([c]) in table:
            w += bytes([c])
            continue
        put(table[w])
        table[w + bytes([c])] = size
        size += 1
        w = bytes([c])
        if size + 1 > (1 << width) - 0 and width < 12:
            width += 1
        if size >= 4094:
            put(table[w])
            w = b""
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
    if w:
        put(table[w])
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if n:
        out.append(held << (8 - n) & 255)
    return bytes(out)


def test_lzw():
    rng = np.random.default_rng(1)
    for raw in (b"", b"a", b"abab" * 5, rng.integers(0, 4, 20_000).astype(np.uint8).tobytes(), rng.bytes(9000)):
        assert codecs.lzw(lzw_packed(raw)) == raw


def tiff(v, packing=1, differences=False, tile=None, big=False, end="<"):
    """Pages of a stack by hand, in tiles or in strips of 4 rows."""
    pack = {1: bytes, 5: lzw_packed, 8: zlib.compress, 50000: lambda b: zstandard.ZstdCompressor().compress(b)}[packing]
    word, form = ("Q", "HHQQ") if big else ("I", "HHII")
    head = struct.pack(end + "HHHQ", 43, 8, 0, 0) if big else struct.pack(end + "HI", 42, 0)
    out, after = bytearray((b"II" if end == "<" else b"MM") + head), 8 if big else 4
    for z in range(v.shape[2]):
        rows = v[:, :, z].T
        if tile:
            rows = np.pad(rows, [(0, -n % t) for n, t in zip(rows.shape, tile[::-1], strict=True)])
            parts = [rows[y : y + tile[1], x : x + tile[0]] for y in range(0, len(rows), tile[1]) for x in range(0, rows.shape[1], tile[0])]
        else:
            parts = [rows[y : y + 4] for y in range(0, len(rows), 4)]
        places, sizes = [], []
        for p in parts:
            p = np.diff(p, axis=1, prepend=p.dtype.type(0)) if differences else p
            got = pack(np.ascontiguousarray(p).astype(p.dtype.newbyteorder(end)).tobytes())
            places.append(len(out))
            sizes.append(len(got))
            out += got
        lists = []
        for values in (places, sizes):
            lists.append(len(out) if len(values) > 1 else values[0])
            if len(values) > 1:
                out += struct.pack(f"{end}{len(values)}{word}", *values)
        n, kind = len(parts), 16 if big else 4
        tags = [(256, 4, v.shape[0]), (257, 4, v.shape[1]), (258, 3, 8 * v.dtype.itemsize), (259, 3, packing), (277, 3, 1), (317, 3, 2 if differences else 1)]
        tags += [(322, 4, tile[0]), (323, 4, tile[1])] if tile else [(278, 4, 4)]
        rows = [(t, k, 1, x if end == "<" or k == 4 else x << 16) for t, k, x in tags]
        if big and end == ">":
            rows = [(t, k, 1, x << (48 if k == 3 else 32)) for t, k, x in tags]
        rows += [(324 if tile else 273, kind, n, lists[0]), (325 if tile else 279, kind, n, lists[1])]
        struct.pack_into(end + word, out, after, len(out))
        out += struct.pack(end + ("Q" if big else "H"), len(rows)) + b"".join(struct.pack(end + form, *r) for r in sorted(rows))
        after = len(out)
        out += struct.pack(end + word, 0)
    return bytes(out)


TIFFS = [dict(packing=p, differences=d, tile=t) for p in (1, 5, 8, 50000) for d in (False, True) for t in (None, (16, 16))]


@pytest.mark.parametrize("form", [*TIFFS, dict(big=True, tile=(16, 16), packing=5), dict(big=True), dict(end=">", packing=8, differences=True), dict(big=True, end=">", tile=(16, 32))])
def test_tiff_forms(tmp_path, form):
    v = np.random.default_rng(2).integers(0, 900, (37, 21, 3)).astype("<u2")
    (tmp_path / "a.tif").write_bytes(tiff(v, **form))
    array = arrays.open_array(f"file://{tmp_path}/a.tif")
    assert array.shape == v.shape and array.chunk == ((*form["tile"], 1) if form.get("tile") else (37, 4, 1))
    assert np.array_equal(arrays.read_slice(array, (0, 0, 0), v.shape), v)
    assert np.array_equal(arrays.read_slice(array, (15, 3, 1), (33, 19, 2)), v[15:33, 3:19, 1:2])


def zarr3(folder, v, chunk, after, separator="/", end="little", default=True):
    """A version 3 array by hand, (z, y, x)."""
    pack = {"zstd": lambda b: zstandard.ZstdCompressor().compress(b), "gzip": lambda b: zlib.compress(b), "blosc": lambda b: blosc_frame(b, 2, 512, "lz4"), "crc32c": lambda b: b + bytes(4)}
    meta = {
        "zarr_format": 3, "node_type": "array", "shape": list(v.shape[::-1]), "data_type": "uint16", "fill_value": 7,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunk[::-1])}},
        "chunk_key_encoding": {"name": "default" if default else "v2", "configuration": {"separator": separator}},
        "codecs": [{"name": "bytes", "configuration": {"endian": end}}, *({"name": n} for n in after)],
    }
    folder.mkdir()
    (folder / "zarr.json").write_text(json.dumps(meta))
    for at in np.ndindex(*[-(-n // c) for n, c in zip(v.shape, chunk, strict=True)]):
        if at == (0, 0, 0):
            continue  # absent: the fill value
        part = v[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunk, strict=True))]
        part = np.pad(part, [(0, c - n) for c, n in zip(chunk, part.shape, strict=True)])
        raw = part.transpose(2, 1, 0).astype("<u2" if end == "little" else ">u2").tobytes()
        for n in after:
            raw = pack[n](raw)
        name = folder / (("c" + separator if default else "") + separator.join(map(str, at[::-1])))
        name.parent.mkdir(parents=True, exist_ok=True)
        name.write_bytes(raw)


@pytest.mark.parametrize("after, kw", [([], {}), (["zstd", "crc32c"], {"end": "big"}), (["gzip"], {"separator": "."}), (["blosc"], {"default": False})])
def test_zarr_version_3_in_blocks(spark, tmp_path, after, kw):
    v = np.random.default_rng(3).integers(0, 900, (14, 11, 7)).astype("<u2")
    zarr3(tmp_path / "a", v, (5, 4, 3), after, **kw)
    want = v.copy()
    want[:5, :4, :3] = 7
    for r in arrays.read_blocks(spark, f"file://{tmp_path}/a", (6, 5, 7), halo=1).collect():
        got = np.frombuffer(r.data, dtype="<f4").reshape(r.nx, r.ny, r.nz)
        assert np.array_equal(got, want[r.x0 : r.x0 + r.nx, r.y0 : r.y0 + r.ny, r.z0 : r.z0 + r.nz])


def test_unknown_version_3_codecs_are_refused(tmp_path):
    zarr3(tmp_path / "a", np.zeros((2, 2, 2), "<u2"), (2, 2, 2), [])
    meta = json.loads((tmp_path / "a/zarr.json").read_text())
    (tmp_path / "a/zarr.json").write_text(json.dumps(meta | {"codecs": [*meta["codecs"], {"name": "sharding_indexed"}]}))
    with pytest.raises(ValueError, match="sharding"):
        arrays.open_array(f"file://{tmp_path}/a")


def stored(spark, folder, images, models, chunk=(6, 5, 3)):
    rows = []
    for k, v in images.items():
        uri = f"file://{folder}/tile{k}"
        arrays.create_zarr(uri, v.shape, chunk, v.dtype.str)
        arrays.put_block(arrays.open_array(uri), (0, 0, 0), v)
        rows.append((k, uri, *map(float, np.asarray(models[k]).ravel())))
    return spark.createDataFrame(rows, MODEL)


def shifted(x, y, z):
    return np.column_stack([np.eye(3), [x, y, z]])


def volume_of(rows, shape):
    out = np.zeros(shape)
    for r in rows:
        v = arrays.voxels(r)
        out[tuple(slice(o, o + n) for o, n in zip(r.origin, v.shape, strict=True))] = v
    return out


def test_blocks_are_cut_before_they_are_sent(spark):
    """What is sent to the cells is little more than the blocks, in their own kind."""
    v = np.arange(24 * 24 * 12).reshape(24, 24, 12).astype("<u2")
    turn = np.array([[0.995, -0.0998, 0], [0.0998, 0.995, 0], [0, 0, 1.0]])
    blocks = spark.createDataFrame([(0, [0, 0, 0], list(v.shape), "<u2", bytearray(v.tobytes()))], f"tile long, {arrays.VOXELS}")
    whole = spark.createDataFrame([(0, list(v.shape))], "tile long, whole array<long>")
    for model, most in ((shifted(8, 16, 4), 1.0), (np.column_stack([turn, [9.0, 7, 3]]), 1.3)):
        models = spark.createDataFrame([(0, *map(float, model.ravel()))], "tile long, " + ", ".join(f"{n} double" for n in G.NAMES))
        cut = fusion.cut_to_cells(blocks, models, whole, (24, 24, 12))
        sent = cut.agg(F.sum(F.length("data"))).first()[0]
        assert v.nbytes <= sent <= most * v.nbytes and cut.count() >= 4


def test_models_of_many_tiles_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Small in bytes, but a row a tile: beyond a number of tiles no table is collected to be sent to all."""
    v = np.arange(4 * 4 * 2).reshape(4, 4, 2).astype("<u2")
    blocks = spark.createDataFrame([(k, [0, 0, 0], list(v.shape), "<u2", bytearray((v + k).tobytes())) for k in range(6)], f"tile long, {arrays.VOXELS}")
    whole = spark.createDataFrame([(k, list(v.shape)) for k in range(6)], "tile long, whole array<long>")
    models = spark.createDataFrame([(k, *map(float, shifted(3 * k, k, 0).ravel())) for k in range(6)], "tile long, " + ", ".join(f"{n} double" for n in G.NAMES))
    models.write.parquet(f"file://{tmp_path}/models")
    models = spark.read.parquet(f"file://{tmp_path}/models")
    cut = lambda: fusion.cut_to_cells(blocks, models, whole, (4, 4, 4))
    rows = lambda df: sorted((r.tile, r.c0, r.c1, r.c2, tuple(r.origin), bytes(r.data)) for r in df.collect())
    few = rows(cut())
    monkeypatch.setattr(fusion, "MOST_SENT", 5, raising=False)
    monkeypatch.setattr(fusion, "MOST_HELD", 40, raising=False)
    many = cut()
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()
    assert rows(many) == few and len(few) > 6


@pytest.mark.parametrize("blend", fusion.BLENDS)
def test_stored_tiles_fuse_as_rows_do(spark, tmp_path, blend):
    rng = np.random.default_rng(4)
    c, s = np.cos(0.3), np.sin(0.3)
    models = {0: shifted(1, 2, 0), 1: shifted(9, 3, 1), 2: np.column_stack([np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.1]]), [7.0, 1, 2]])}
    images = {k: rng.integers(1, 900, (12, 10, 6)).astype("<u2") for k in models}
    tiles = stored(spark, tmp_path, images, models)
    whole = arrays.shapes(spark, tiles.select("uri")).join(tiles, "uri").select("tile", F.col("shape").alias("whole"))
    rows = fusion.fuse(arrays.read_tiles(tiles.select("tile", "uri"), (6, 5, 3)), tiles, whole, (8, 8, 8), blend=blend).collect()
    near = fusion.fuse_tiles(tiles, (8, 8, 8), blend=blend).collect()
    by_cell = lambda found: {(r.c0, r.c1, r.c2): (r.covered, arrays.voxels(r)) for r in found}
    a, b = by_cell(rows), by_cell(near)
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and np.allclose(a[k][1], b[k][1]) for k in a)


@pytest.mark.parametrize("blend", fusion.BLENDS)
def test_tasks_share_a_crowded_cell(spark, tmp_path, monkeypatch, blend):
    """Many tiles in one place: several groups fill a cell, with the result of one."""
    rng = np.random.default_rng(6)
    models = {k: shifted(k % 5, k % 3, k % 2) for k in range(20)}
    tiles = stored(spark, tmp_path, {k: rng.integers(1, 900, (12, 10, 6)).astype("<u2") for k in models}, models)
    run = lambda: {(r.c0, r.c1, r.c2): (r.covered, arrays.voxels(r)) for r in fusion.fuse_tiles(tiles, (8, 8, 8), blend=blend).collect()}
    store = lambda name: (fusion.fuse_to_store(tiles, f"file://{tmp_path}/{name}", (16, 16, 8), (8, 8, 8), blend=blend), arrays.read_slice(a := arrays.open_array(f"file://{tmp_path}/{name}/0"), (0, 0, 0), a.shape))
    one, plain = run(), store("one")
    monkeypatch.setattr(fusion, "PART_TILES", 4)
    many, shared = run(), store("many")
    assert fusion._parts(fusion.cells_of_tiles(tiles, (8, 8, 8)), blend) == (1 if blend == "first" else 5)
    assert one.keys() == many.keys() and all(one[k][0] == many[k][0] and np.allclose(one[k][1], many[k][1]) for k in one)
    assert plain[0] == shared[0] and np.abs(plain[1].astype(int) - shared[1]).max() <= 1


def test_only_the_image_of_a_block_is_visited(monkeypatch):
    """A small block in a large cell: work in proportion to the block, not to the cell."""
    visited = []
    monkeypatch.setattr(fusion.np, "floor", lambda v, keep=np.floor: (visited.append(np.size(v)), keep(v))[1])
    fill = fusion.Filler((0, 0, 0), (64, 64, 64), "weighted")
    fill.add((0, 0, 0), np.ones((4, 4, 4)), np.column_stack([np.eye(3), [-30.0, -20, -10]]), (4, 4, 4))
    assert fill.count.sum() == 64 and max(visited) < 10 * 64


def test_fused_store_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    models = {0: shifted(0, 0, 0), 1: shifted(20, 0, 0), 2: shifted(0, 17, 3)}
    images = {k: rng.integers(1, 60_000, (24, 20, 12)).astype("<u2") for k in models}
    tiles, uri, shape = stored(spark, tmp_path, images, models), f"file://{tmp_path}/out", (44, 37, 15)
    run = lambda levels: fusion.fuse_to_store(tiles, uri, shape, (16, 16, 16), (8, 8, 8), levels, attributes={"a": 1})
    level = lambda k: arrays.open_array(f"{uri}/{k}")
    whole = lambda k: arrays.read_slice(level(k), (0, 0, 0), level(k).shape)
    assert len(run(2)) == 2
    plain = volume_of(fusion.fuse_tiles(tiles, (16, 16, 16)).collect(), (48, 48, 16))
    assert np.array_equal(whole(0)[:44, :37, :15], np.rint(plain[:44, :37, :15]))
    want = arrays.averaged(whole(0).astype(float), (2, 2, 2))
    assert np.array_equal(whole(1)[: want.shape[0], : want.shape[1], : want.shape[2]], np.rint(want))

    # as if the run had been stopped within level 1: some cells lack their marks and have wrong chunks
    marks = sorted(os.listdir(tmp_path / "out/1.done"))
    for m in marks[::2]:
        os.remove(tmp_path / "out/1.done" / m)
        os.remove(tmp_path / "out/1" / "/".join(["0", "0", *m.split(".")[::-1]]))
    before = {f: os.stat(tmp_path / "out/1.done" / f).st_mtime_ns for f in marks[1::2]}
    again = run(4)
    assert again[:2] == [0, len(marks[::2])] and len(again) == 4 and level(3).shape == (8, 8, 8)
    assert {f: os.stat(tmp_path / "out/1.done" / f).st_mtime_ns for f in before} == before
    for k in (1, 2, 3):
        want = arrays.averaged(whole(k - 1).astype(float), (2, 2, 2))
        assert np.array_equal(whole(k)[tuple(map(slice, want.shape))], np.rint(want)), k
    assert run(4) == [0] * 4 and json.loads((tmp_path / "out/.zattrs").read_text()) == {"a": 1}
    with pytest.raises(ValueError, match="whole chunks"):
        fusion.fuse_to_store(tiles, uri, shape, (16, 16, 16), (7, 8, 8))
