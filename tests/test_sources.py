"""Project descriptors, stores and block files."""

import json

import numpy as np
import pytest

from pyspark.sql import functions as F

from stitchlake.sources import arrays, precomputed, project, store


def descriptor(files=14, setups=7, registrations=14, sections=project.SECTIONS):
    views = [(tp, s) for tp in (18, 30) for s in range(7)]
    tag = lambda name, body, extra="": f"<{name}{extra}>{body}</{name}>" if name in sections else body
    maps = "".join(f'<FileMapping view_setup="{s}" timepoint="{t}" series="0" channel="0">\n<file type="relative">f_{t}_{s}.tif</file></FileMapping>' for t, s in views[:files])
    sets = "".join(f"<ViewSetup><id>{i}</id><name>{i}</name><size>1388 1040 81</size><voxelSize><unit>µm</unit><size>0.73 0.73 2.0</size></voxelSize><attributes><illumination>0</illumination><angle>{i}</angle></attributes></ViewSetup>" for i in range(setups))
    affine = "1.0 0.0 0.0 5.0\n 0.0 1.0 0.0 6.0 0.0 0.0 1.0 7.0"
    regs = "".join(f'<ViewRegistration timepoint="{t}" setup="{s}"><ViewTransform type="affine"><Name>Rotation</Name><affine>{affine}</affine></ViewTransform><ViewTransform type="affine"><Name>calibration</Name><affine>{affine}</affine></ViewTransform></ViewRegistration>' for t, s in views[:registrations])
    points = "".join(f'<ViewInterestPointsFile timepoint="{t}" setup="{s}" label="beads" params="DOG s=1.8">tp_{t}_{s}/beads</ViewInterestPointsFile>' for t, s in views)
    loader = tag("ImageLoader", f"<files>{maps}</files>", ' format="spimreconstruction.filemap2"')
    return f'<?xml version="1.0" encoding="UTF-8"?><SpimData version="0.2"><SequenceDescription>{loader}{tag("ViewSetups", sets)}</SequenceDescription>{tag("ViewRegistrations", regs)}{tag("ViewInterestPoints", points)}</SpimData>'


def put(tmp_path, text):
    p = tmp_path / "project.xml"
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_scans(spark, tmp_path):
    path = put(tmp_path, descriptor())
    project.check(spark, path)
    views = project.views(spark, path)
    assert views.count() == 14 and views.filter("timepoint = 18 AND setup = 3").first().file_path == "f_18_3.tif"
    setups = {r.id: r for r in project.view_setups(spark, path).collect()}
    assert len(setups) == 7 and setups[2].size == [1388, 1040, 81] and setups[2].voxel_size == [0.73, 0.73, 2.0]
    assert setups[2].attributes == {"illumination": "0", "angle": "2"} and setups[2].voxel_unit == "µm"
    t = project.view_transforms(spark, path)
    assert t.count() == 28 and t.first().affine == [1, 0, 0, 5, 0, 1, 0, 6, 0, 0, 1, 7]
    assert [r.name for r in t.filter("timepoint = 18 AND setup = 0").orderBy("seq").collect()] == ["Rotation", "calibration"]
    assert project.point_sets(spark, path).count() == 14
    assert project.view_sizes(views, project.view_setups(spark, path)).count() == 14
    assert {tuple(r.labels) for r in project.labels(project.point_sets(spark, path)).collect()} == {("beads",)}


@pytest.mark.parametrize("kw, says", [({"files": 0}, "no files"), ({"sections": []}, "do not exist"), ({"files": 12, "registrations": 13}, "do not match")])
def test_checks(spark, tmp_path, kw, says):
    with pytest.raises(ValueError, match=says):
        project.check(spark, put(tmp_path, descriptor(**kw)))


def test_chunked_loader(spark, tmp_path):
    path = put(tmp_path, '<a><zgroup setup="3" timepoint="0"><path type="relative">tile_x_ch_488.ome.zarr</path></zgroup></a>')
    r = project.views(spark, path).first()
    assert (r.setup, r.series, r.channel) == (3, 1, "488")


def test_writer_round_trip(spark, tmp_path):
    path = put(tmp_path, descriptor())
    tables = [f(spark, path) for f in (project.views, project.view_setups, project.view_transforms, project.point_sets)]
    again = put(tmp_path / ".", project.to_xml(*[spark.createDataFrame(t.collect(), t.schema) for t in tables]))
    for f, t in zip((project.views, project.view_setups, project.view_transforms, project.point_sets), tables, strict=True):
        assert sorted(map(str, f(spark, again).collect())) == sorted(map(str, t.collect()))


def test_solved_models_come_first(spark, tmp_path):
    t = project.view_transforms(spark, put(tmp_path, descriptor()))
    models = spark.createDataFrame([(18, 0, [2.0] * 12)], "timepoint int, setup int, affine array<double>")
    out = project.with_models(t, models, "AffineModel3D")
    assert out.count() == 42
    first = {(r.timepoint, r.setup): r.affine for r in out.filter("seq = 0").collect()}
    assert first[18, 0] == [2.0] * 12 and first[30, 1] == [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]


def test_point_store(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = [(0, s, "beads", float(i % 7), float(i), 0.0, 1.0) for s in range(2) for i in range(20)]
    df = spark.createDataFrame(rows, "timepoint int, setup int, label string, x double, y double, z double, intensity double")
    store.write_points(df, path)
    store.write_points(df.filter("setup = 1 AND y < 5"), path)  # replaces one view alone
    got = store.read_points(spark, path)
    assert got.filter("setup = 0").count() == 20 and sorted(r.point_id for r in got.filter("setup = 1").collect()) == list(range(5))


def test_correspondence_store(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = [("0,0", "beads", i, "0,1", "beads", i + 50) for i in range(10)]
    store.write_correspondences(spark.createDataFrame(rows, "view_a string, label_a string, id_a long, view_b string, label_b string, id_b long"), path)
    assert store.read_correspondences(spark, path, directed=True).count() == 20 and store.read_correspondences(spark, path).count() == 10


def write_array(v, folder, block, compression="gzip"):
    """An array as a folder of blocks, by hand."""
    from pathlib import Path

    root = Path(folder.removeprefix("file://"))
    root.mkdir(parents=True)
    (root / "attributes.json").write_text(store.attributes(v.shape, block, v.dtype.name, compression))
    for at in np.ndindex(*[-(-n // b) for n, b in zip(v.shape, block, strict=True)]):
        name = root.joinpath(*map(str, at))
        name.parent.mkdir(parents=True, exist_ok=True)
        name.write_bytes(store.pack_block(v[tuple(slice(i * b, (i + 1) * b) for i, b in zip(at, block, strict=True))], compression))


@pytest.mark.parametrize("compression", ["gzip", "raw"])
def test_chunked_array(spark, tmp_path, compression):
    v = np.arange(7 * 5 * 4, dtype="uint16").reshape(7, 5, 4)
    uri = f"file://{tmp_path}/array"
    write_array(v, uri, (3, 2, 4), compression)
    out = np.zeros(v.shape)
    for r in store.read_array(spark, uri).collect():
        at = tuple(slice(o, o + n) for o, n in zip(r.origin, r.shape, strict=True))
        out[at] = np.frombuffer(r.data, dtype="<f8").reshape(r.shape)
    assert np.array_equal(out, v)


@pytest.mark.parametrize("values", [[7], [0, 9], range(5), range(300), range(70000)])
def test_label_blocks(values):
    v = np.random.default_rng(0).choice(np.array(values, dtype=np.uint32), (9, 8, 5))
    table, bits, packed = store.encode_labels(v)
    assert np.array_equal(store.decode_labels(table, bits, packed, v.shape), v)


def test_curation_and_metrics(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"ng_link": "http://x"}')
    (tmp_path / "j/b.json").write_text('{"other": 1}')
    (tmp_path / "j/c.json").write_text("not json")
    assert [r.ng_link for r in project.curated_links(spark, str(tmp_path / "j"), str(tmp_path / "out")).collect()] == ["http://x"]
    assert json.loads(project.upsert_metric("broken", "kde", {"a": 1})) == {"kde": {"a": 1}}
    assert json.loads(project.upsert_metric('{"x": 1}', "kde", {}))["x"] == 1


def test_markers(spark, tmp_path):
    path = put(tmp_path, "<r><Marker><MarkerX>1</MarkerX><MarkerY>2</MarkerY><MarkerZ>3</MarkerZ></Marker></r>")
    assert tuple(project.markers(spark, path).first()) == (1.0, 2.0, 3.0)


def _tiff(v, deflate):
    """A stack of pages of uint16 in strips of 4 rows, little-endian."""
    import struct
    import zlib

    out, after = bytearray(b"II" + struct.pack("<HI", 42, 0)), 4
    for z in range(v.shape[2]):
        rows = v[:, :, z].T.astype("<u2")
        strips = [rows[i : i + 4].tobytes() for i in range(0, len(rows), 4)]
        strips = [zlib.compress(s) if deflate else s for s in strips]
        places = []
        for s in strips:
            places.append(len(out))
            out += s
        lists = []
        for values in (places, [len(s) for s in strips]):
            lists.append(len(out) if len(values) > 1 else values[0])
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
        tags = [(256, 3, 1, v.shape[0]), (257, 3, 1, v.shape[1]), (258, 3, 1, 16), (259, 3, 1, 8 if deflate else 1), (273, 4, len(strips), lists[0]), (277, 3, 1, 1), (278, 3, 1, 4), (279, 4, len(strips), lists[1])]
        struct.pack_into("<I", out, after, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        after = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def _blocks_to_volume(rows, shape):
    v, seen = np.full(shape, np.nan), np.zeros(shape, int)
    for r in rows:
        b = np.frombuffer(r.data, dtype="<f4").reshape(r.nx, r.ny, r.nz)
        core = [slice(a - o, e - o) for a, e, o in zip((r.cx0, r.cy0, r.cz0), (r.cx1, r.cy1, r.cz1), (r.x0, r.y0, r.z0), strict=True)]
        at = tuple(slice(a, e) for a, e in zip((r.cx0, r.cy0, r.cz0), (r.cx1, r.cy1, r.cz1), strict=True))
        v[at] = b[tuple(core)]
        seen[at] += 1
    assert (seen == 1).all()
    return v


@pytest.mark.parametrize("form", ["tiff", "deflated tiff", "zarr", "raw zarr", "folder"])
def test_volumes_are_read_in_blocks(spark, tmp_path, form):
    v = np.random.default_rng(5).integers(0, 60000, (14, 11, 7)).astype("<u2")
    uri = f"file://{tmp_path}/a"
    if "tiff" in form:
        uri += ".tif"
        (tmp_path / "a.tif").write_bytes(_tiff(v, "deflated" in form))
    elif "zarr" in form:
        arrays.create_zarr(uri, v.shape, (5, 4, 4), "<u2", None if "raw" in form else "zstd")
        rows = [([x, 0, 0], [min(10, 14 - x), 11, 7], bytearray(np.ascontiguousarray(v[x : x + 10].astype("<f8")).tobytes())) for x in (0, 10)]
        assert arrays.write_blocks(spark.createDataFrame(rows, "origin array<long>, shape array<long>, data binary"), uri) == 2
    else:
        write_array(v, uri, (5, 4, 3))
    shape = tuple(arrays.open_array(uri).shape)
    assert all(a >= b for a, b in zip(shape, v.shape, strict=True))
    whole = np.zeros(shape)
    whole[:14, :11, :7] = v
    rows = arrays.read_blocks(spark, uri, (6, 5, 3), halo=2).collect()
    assert np.array_equal(_blocks_to_volume(rows, shape), whole)
    r = next(r for r in rows if (r.cx0, r.cy0, r.cz0) == (6, 5, 3))
    assert (r.x0, r.y0, r.z0) == (4, 3, 1) and np.array_equal(np.frombuffer(r.data, "<f4").reshape(r.nx, r.ny, r.nz), whole[4 : 4 + r.nx, 3 : 3 + r.ny, 1 : 1 + r.nz])
    small = arrays.read_blocks(spark, uri, (3, 2, 2), factor=(2, 2, 3)).collect()
    assert np.allclose(_blocks_to_volume(small, [n // f for n, f in zip(shape, (2, 2, 3), strict=True)]), arrays.averaged(whole, (2, 2, 3)))
    (s,) = arrays.shapes(spark, spark.createDataFrame([(uri,)], "uri string")).collect()
    assert tuple(s.shape) == shape and s.kind == "uint16"


def test_detection_over_a_store(spark, tmp_path):
    from stitchlake.operators import detection, volume

    v = volume.gaussian(np.random.default_rng(6).uniform(0, 200, (30, 28, 20)), 1.0)
    uri = f"file://{tmp_path}/v"
    arrays.create_zarr(uri, v.shape, (10, 14, 10), "<f4")
    rows = [([0, 0, 0], list(v.shape), bytearray(np.ascontiguousarray(v).tobytes()))]
    arrays.write_blocks(spark.createDataFrame(rows, "origin array<long>, shape array<long>, data binary"), uri)
    blocks = arrays.read_blocks(spark, uri, (16, 16, 20), halo=detection.reach(1.5)).withColumn("view", F.lit(3))
    got = {(r.px, r.py, r.pz) for r in detection.detect_points(blocks, "view", 1.5, 6.0).collect()}
    found, *_ = detection.detect_block(v.astype("<f4"), 1.5, 6.0)
    assert got == {tuple(map(int, p)) for p in found} and len(got) > 10


def test_unknown_arrays_are_refused(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"not a tiff file")
    for name, error in (("x.tif", "TIFF"), ("none", "no array")):
        with pytest.raises(ValueError, match=error):
            arrays.open_array(f"file://{tmp_path}/{name}")
    arrays.create_zarr(f"file://{tmp_path}/b", (4, 4, 4), (2, 2, 2), compressor="blosc")
    (tmp_path / "b/0/0/0/0").mkdir(parents=True)
    (tmp_path / "b/0/0/0/0/0").write_bytes(b"x")
    with pytest.raises(ValueError, match="blosc"):
        arrays.open_array(f"file://{tmp_path}/b").read_chunk((0, 0, 0))


def test_annotations_by_cell(spark, tmp_path):
    import json
    import struct

    p = np.random.default_rng(7).uniform(0, 100, (200, 3)).astype("f4").astype(float)
    d = spark.createDataFrame([tuple(map(float, q)) for q in p], "x double, y double, z double")
    info = precomputed.write_annotations(d, f"file://{tmp_path}/a", (30.0, 30.0, 30.0))
    assert json.loads((tmp_path / "a/info").read_text()) == info and np.allclose(info["lower_bound"], p.min(axis=0))
    found = []
    for f in (tmp_path / "a/spatial0").iterdir():
        raw = f.read_bytes()
        (n,) = struct.unpack_from("<Q", raw)
        xyz = np.frombuffer(raw, "<f4", 3 * n, 8).reshape(n, 3)
        assert len(raw) == 8 + 20 * n and n <= info["spatial"][0]["limit"]
        assert f.name == "_".join(str(int(v)) for v in np.floor((xyz[0] - info["lower_bound"]) / 30))
        found += map(tuple, xyz)
    assert sorted(found) == sorted(map(tuple, p.astype("f4")))


def test_annotations_in_levels(spark, tmp_path):
    """A dense corner: levels of halved cells, about ``limit`` a cell, every place once and alike in all parts."""
    rng = np.random.default_rng(9)
    p = np.r_[rng.uniform(0, 100, (300, 3)), rng.uniform(0, 3, (3000, 3))].astype("f4").astype(float)
    rows = [*map(lambda q: tuple(map(float, q)), p)] * 2 + [(None, 1.0, 2.0)]
    d = spark.createDataFrame(rows, "x double, y double, z double")
    info = precomputed.write_annotations(d, f"file://{tmp_path}/a", (50.0, 50.0, 50.0), limit=200)
    levels = info["spatial"]
    assert len(levels) > 3 and [v["chunk_size"] for v in levels[:2]] == [[50.0] * 3, [25.0] * 3]
    assert all(v["limit"] <= 260 for v in levels)
    got = precomputed.read_annotations(spark, f"file://{tmp_path}/a").collect()
    assert sorted((r.x, r.y, r.z) for r in got) == sorted(set(map(tuple, p))) and len({r.id for r in got}) == len(got)
    share = [sum(r.level == 0 for r in got if (r.x < 3) == near) / sum((r.x < 3) == near for r in got) for near in (True, False)]
    assert share[0] == pytest.approx(share[1], abs=0.05)
    last = precomputed.write_annotations(d, f"file://{tmp_path}/b", (50.0, 50.0, 50.0), limit=200, levels=2)["spatial"]
    assert len(last) == 2 and last[1]["limit"] > 200  # the last level takes all that are left
    empty = precomputed.write_annotations(d.limit(0), f"file://{tmp_path}/c", (1.0, 1.0, 1.0))
    assert [v["limit"] for v in empty["spatial"]] == [0]


def test_segmentation_of_several_scales(spark, tmp_path):
    """Blocks that fit no chunk; three scales against the zoom of the whole volume; a hole stays 0."""
    from stitchlake.operators import fusion

    v = np.random.default_rng(4).integers(1, 50, (37, 20, 11)).astype("<u4")
    rows = []
    for at in np.ndindex(3, 2, 2):
        o = np.array(at) * (14, 13, 7)
        part = v[tuple(slice(a, a + n) for a, n in zip(o, (14, 13, 7), strict=True))]
        if at == (1, 1, 1):
            v[tuple(slice(a, a + n) for a, n in zip(o, (14, 13, 7), strict=True))] = 0
        else:
            rows.append((o.tolist(), list(part.shape), bytearray(part.tobytes())))
    d = spark.createDataFrame(rows, "origin array<long>, shape array<long>, data binary").repartition(4)
    factors = ((1.0, 1.0, 1.0), (0.5, 0.5, 1.0), (0.2, 0.1, 0.05))
    info = precomputed.write_segmentation(d, f"file://{tmp_path}/s", v.shape, (16, 8, 8), resolution=(2.0, 2.0, 5.0), factors=factors)
    assert [s["key"] for s in info["scales"]] == ["2_2_5", "4_4_5", "10_20_100"] and json.loads((tmp_path / "s/info").read_text()) == info
    for s, f in enumerate(factors):
        want = fusion.zoom_labels(v, f)
        got = np.zeros_like(want)
        for r in precomputed.read_segmentation(spark, f"file://{tmp_path}/s", s).collect():
            got[tuple(slice(a, a + n) for a, n in zip(r.origin, r.shape, strict=True))] = np.frombuffer(r.data, "<u4").reshape(r.shape)
        assert list(want.shape) == info["scales"][s]["size"] and np.array_equal(got, want)
    with pytest.raises(ValueError, match="one resolution"):
        precomputed.write_segmentation(d, f"file://{tmp_path}/t", v.shape, (16, 8, 8), factors=((1, 1, 1), (1, 1, 1)))


@pytest.mark.parametrize("kind", ["uint32", "uint64"])
def test_segmentation_round_trip(spark, tmp_path, kind):
    rng = np.random.default_rng(8)
    for values in (1, 2, 5, 300, 4000):
        v = rng.integers(0, values, (13, 9, 17)).astype(kind)
        assert np.array_equal(precomputed.decode_segmentation(precomputed.encode_segmentation(v), v.shape, kind), v)
    rows = [([0, 0, 0], [13, 9, 17], bytearray(v.tobytes()))]
    info = precomputed.write_segmentation(spark.createDataFrame(rows, "origin array<long>, shape array<long>, data binary"), f"file://{tmp_path}/s", v.shape, v.shape, kind)
    raw = (tmp_path / "s" / info["scales"][0]["key"] / "0-13_0-9_0-17").read_bytes()
    assert np.array_equal(precomputed.decode_segmentation(raw, v.shape, kind), v)


def test_split_project_round_trip(spark, tmp_path):
    from stitchlake.operators import layout

    path = put(tmp_path, descriptor())
    views, setups, lists = project.views(spark, path), project.view_setups(spark, path), project.view_transforms(spark, path)
    parts = layout.split_views(setups, (704, 1088, 128), (64, 64, 64)).cache()
    new_setups, new_lists = project.split_tables(views, setups, lists, parts)
    text = project.to_xml(views, new_setups, new_lists, parts=parts)
    (tmp_path / "split.xml").write_text(text)
    again = f"file://{tmp_path}/split.xml"
    want = sorted((r.id, r.new_id, r.lower, r.upper) for r in parts.collect())
    assert sorted((r.id, r.new_id, r.lower, r.upper) for r in project.split_parts(spark, again).collect()) == want and len(want) > 7
    sizes = {r.id: (r.size, r.attributes["tile"], r.attributes["angle"]) for r in project.view_setups(spark, again).collect()}
    assert sizes == {n: ([b - a + 1 for a, b in zip(lo, hi, strict=True)], str(n), str(i)) for i, n, lo, hi in want}
    last = {(r.timepoint, r.setup): r.affine for r in project.view_transforms(spark, again).filter("seq = 2").collect()}
    assert all(last[t, n][3::4] == list(map(float, lo)) for _, n, lo, _ in want for t in (18, 30))
    assert project.views(spark, again).count() == views.count()


def test_tiles_and_channels_of_a_folder(spark, tmp_path):
    for n in ("tile_1_ch_561.zarr", "tile_0_ch_488.zarr", "tile_0_CH_561.zarr", "plain.zarr", "other.txt"):
        (tmp_path / n).mkdir()
    tiles = project.tiles_in(spark, f"file://{tmp_path}")
    assert [(r.name, r.channel) for r in tiles.collect()] == [("plain.zarr", None), ("tile_0_CH_561.zarr", 561), ("tile_0_ch_488.zarr", 488), ("tile_1_ch_561.zarr", 561)]
    assert [r.channel for r in project.channels(tiles).collect()] == [561, 488]


def test_viewer_layers_of_other_types(spark):
    from stitchlake.operators import layout, viewer

    rows = spark.createDataFrame([("cells", "segmentation", "s3://b/seg", None, [3, 5]), ("marks", "annotation", "precomputed://x", "rendering", None)], "name string, type string, source string, tab string, segments array<long>")
    a, b = (json.loads(r.layer) for r in viewer.other_layers(rows).collect())
    assert a == {"name": "cells", "type": "segmentation", "source": "precomputed://s3://b/seg", "segments": ["3", "5"], "tab": "segments"} and b["tab"] == "rendering"
    image = spark.createDataFrame([("s3://b/k.zarr", 1, "dots", None, None, None, "red")], "source string, channel int, name string, range_lo int, range_hi int, visible boolean, color string")
    whole = json.loads(viewer.state(viewer.layers(image, "s3", "b"), (1e-6, 1e-6, 2e-6), title="t}", others=viewer.other_layers(rows)).first().state)
    assert [v["type"] for v in whole["layers"]] == ["segmentation", "image", "annotation"] and whole["layers"][0] == a and whole["dimensions"]["z"] == ["2e-06", "m"] and whole["title"] == "t}"
    with pytest.raises(Exception, match="unknown layer type"):
        viewer.other_layers(rows.withColumn("type", F.lit("mesh"))).collect()
    shown = layout.channel_metadata(["a"], [0x0AFE], [(0, 65535, 10, 900)])["omero"]["channels"][0]
    assert shown["color"] == "000AFE" and shown["window"] == {"min": 0, "max": 65535, "start": 10, "end": 900}


@pytest.mark.parametrize("module", [arrays, precomputed, project, store])
def test_sources_go_to_executors_whole(module):
    """A function that names a module takes all of it along, by value."""
    from pyspark import cloudpickle

    assert cloudpickle.dumps(lambda: module)
