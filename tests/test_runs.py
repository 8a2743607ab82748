"""Whole runs over a planted project: what is stored by one run is read by the next."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from stitchlake import runs
from stitchlake.functions import geometry as G
from stitchlake.operators import detection
from stitchlake.sources import arrays

SIZE, STEP = (60, 48, 24), 30
#: How far the transforms of each view are off.
OFF = {0: (0, 0, 0), 1: (2, -1, 1), 2: (-1, 2, -1)}


@pytest.fixture(scope="module")
def world():
    """Bright spots over a dark volume that three views share."""
    rng = np.random.default_rng(3)
    shape = (SIZE[0] + 2 * STEP, *SIZE[1:])
    v, grid = np.zeros(shape), np.indices(shape)
    for c in rng.uniform(3, np.array(shape) - 3, (260, 3)):
        lo, hi = np.maximum(c.astype(int) - 6, 0), np.minimum(c.astype(int) + 7, shape)
        part = (slice(None), *[slice(a, b) for a, b in zip(lo, hi, strict=True)])
        v[part[1:]] += rng.uniform(600, 1000) * np.exp(-((grid[part] - c[:, None, None, None]) ** 2).sum(axis=0) / 4.5)
    return np.minimum(v, 60000).astype("<u2")


@pytest.fixture(scope="module")
def stored(spark, world, tmp_path_factory):
    """The views as Zarr arrays and their descriptor; the transforms lie beside the truth by ``OFF``."""
    base = tmp_path_factory.mktemp("project")
    for k in OFF:
        uri = f"file://{base}/images/v{k}.zarr"
        arrays.create_zarr(uri, SIZE, (32, 32, 16), "<u2")
        v = world[k * STEP : k * STEP + SIZE[0]]
        row = ([0, 0, 0], list(SIZE), bytearray(v.tobytes()), "<u2")
        arrays.write_blocks(spark.createDataFrame([row], "origin array<long>, shape array<long>, data binary, kind string"), uri)
    views = spark.createDataFrame([(0, k, 0, "488", f"v{k}.zarr") for k in OFF], "timepoint int, setup int, series int, channel string, file_path string")
    setups = spark.createDataFrame([(k, f"v{k}", list(SIZE), "um", [1.0] * 3, {"tile": str(k)}) for k in OFF], "id int, name string, size array<int>, voxel_unit string, voxel_size array<double>, attributes map<string,string>")
    shift = lambda x, y, z: [1.0, 0.0, 0.0, float(x), 0.0, 1.0, 0.0, float(y), 0.0, 0.0, 1.0, float(z)]
    rows = [(0, k, s, "affine", name, m) for k, off in OFF.items() for s, name, m in ((0, "grid", shift(k * STEP, 0, 0)), (1, "error", shift(*[-x for x in off])))]
    transforms = spark.createDataFrame(rows, "timepoint int, setup int, seq int, type string, name string, affine array<double>")
    sets = spark.createDataFrame([], "timepoint int, setup int, label string, params string, path string")
    path = runs.save(runs.Project(views, setups, transforms, sets), f"file://{base}/xml", "start")
    return base, path


def _model(df, *by):
    return {tuple(r[c] for c in by): [r[n] for n in G.NAMES] for r in df.collect()}


def test_boxes_and_overlaps(spark, stored):
    p = runs.load(spark, stored[1])
    got = {r.view: [r[c] for c in runs._BOX] for r in runs.world_boxes(p).collect()}
    assert got["0_1"] == [STEP - 2, 1, -1, STEP - 2 + SIZE[0] - 1, SIZE[1], SIZE[2] - 2]
    pairs = {(r.a, r.b): (r.l0, r.u0) for r in runs.overlaps(p).collect()}
    assert pairs == {("0_0", "0_1"): (STEP - 2, SIZE[0] - 1), ("0_1", "0_2"): (2 * STEP + 1, STEP - 2 + SIZE[0] - 1)}
    own = {(r.view, round(r.l0), round(r.u0)) for r in runs.own_overlaps(p).collect()}
    assert own == {("0_0", 28, 59), ("0_1", 0, 31), ("0_1", 33, 59), ("0_2", 0, 26)}
    assert runs.overlaps(dataclasses.replace(p, views=p.views.filter("setup <> 1"))).count() == 0


def test_stored_blocks_are_those_of_the_whole(spark, stored, world):
    """Peaks of blocks with halos are the peaks of the volume, at full and at half resolution."""
    files = spark.createDataFrame([("a", f"file://{stored[0]}/images/v0.zarr", list(SIZE))], "view string, uri string, size array<int>")
    for by in ((1, 1, 1), (2, 2, 1)):
        wanted = detection.stored_blocks(files, "view", (20, 16, 24), by)
        got = {(r.px, r.py, r.pz) for r in detection.detect_points(detection.read_stored(wanted, "view", detection.reach(1.8), by), "view", 1.8, 10.0).collect()}
        whole = arrays.averaged(world[: SIZE[0]], by).astype("<f4")
        found, *_ = detection.detect_block(whole, 1.8, 10.0)
        assert got == {tuple(map(int, q)) for q in found} and len(got) > 20


def test_from_images_to_a_fused_volume(spark, stored, world):
    base, path = stored
    p = runs.load(spark, path)
    points, matches = f"file://{base}/points", f"file://{base}/matches"
    p = runs.detect(p, f"file://{base}/images", points, 1.8, 10.0, block=(32, 32, 24))
    at = runs.world_points(p, points)
    inside = {r.view: r.n for r in at.groupBy("view").agg(F.count("*").alias("n")).collect()}
    assert set(inside) == {"0_0", "0_1", "0_2"} and min(inside.values()) > 20
    # only where views meet: the first view has nothing left of the second
    assert at.filter("view = '0_0'").agg(F.min("wx")).first()[0] >= STEP - 2
    runs.match(p, points, matches, radius=8.0, significance=2.0, trials=500, epsilon=1.0)
    n = {(r.tile, r.other): r["count"] for r in runs.matched_points(p, points, matches).groupBy("tile", "other").count().collect()}
    assert set(n) == {("0_0", "0_1"), ("0_1", "0_2")} and min(n.values()) >= 10
    solved, errors = runs.solve(p, points, matches, plateau=2)
    assert errors[-1] < 0.2
    again = runs.load(spark, runs.save(solved, f"file://{base}/xml-solved", "solved"))
    found = _model(runs.models(again), "setup")
    for k in OFF:
        want = np.array([[1, 0, 0, k * STEP], [0, 1, 0, 0], [0, 0, 1, 0]], dtype=float)
        assert np.abs(np.array(found[k,]).reshape(3, 4) - want)[:, 3].max() < 1.0
    moved = [np.array(found[k,])[[3, 7, 11]] - (k * STEP, 0, 0) for k in OFF]
    assert np.abs(moved).max() < 0.6
    # with the planted models on whole voxels the fused volume is the world
    at = F.array(*[F.lit(float(i % 5 == 0)) if i != 3 else (F.col("setup") * STEP).cast("double") for i in range(12)])
    whole = dataclasses.replace(again, transforms=again.transforms.filter("seq = 0").withColumn("affine", at))
    lower, shape = runs.fuse(whole, f"file://{base}/images", f"file://{base}/fused", (32, 32, 24), levels=2, blend="weighted")
    array = arrays.open_array(f"file://{base}/fused/0")
    fused = arrays.read_slice(array, (0, 0, 0), tuple(shape))
    assert lower == [0, 0, 0] and tuple(shape) == world.shape
    assert np.abs(fused.astype(int) - world.astype(int)).max() <= 1
    assert arrays.open_array(f"file://{base}/fused/1").shape[0] >= shape[0] // 2


def test_projects_without_points_or_sizes(spark, stored, tmp_path):
    """No overlap: empty point sets, no matches, and the transforms stay; nothing to fuse without sizes."""
    p = runs.load(spark, stored[1])
    p = dataclasses.replace(p, views=p.views.filter("setup <> 1"), transforms=p.transforms.filter("setup <> 1"))
    points, matches = f"file://{tmp_path}/points", f"file://{tmp_path}/matches"
    p = runs.detect(p, f"file://{stored[0]}/images", points, 1.8, 10.0)
    assert runs.world_points(p, points).count() == 0 and p.sets.count() == 2
    runs.match(p, points, matches)
    solved, errors = runs.solve(p, points, matches)
    assert errors == [] and solved.transforms.count() == p.transforms.count()
    with pytest.raises(ValueError, match="size"):
        runs.fuse(dataclasses.replace(p, setups=p.setups.limit(0)), "x", f"file://{tmp_path}/fused", (8, 8, 8))
