"""Operators on planted data: joins against all pairs, fits that recover a motion, filters that find blobs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stitchlake.functions import geometry as G
from stitchlake.operators import detection, fit, fusion, graph, layout, matching, quality, solver, spatial, transforms, viewer, volume


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows], schema)


def rotation(rng):
    q = rng.normal(size=4)
    w, x, y, z = q / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


MATCH = "pair long, match_id long, px double, py double, pz double, qx double, qy double, qz double"


def matches(spark, models, n=40, noise=0.0, wrong=0, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k, m in enumerate(models):
        p = rng.uniform(-100, 100, (n, 3))
        q = p @ m[:, :3].T + m[:, 3] + rng.normal(0, noise, (n, 3)) if noise else p @ m[:, :3].T + m[:, 3]
        q[:wrong] = rng.uniform(-100, 100, (wrong, 3))
        out += [(k, i, *p[i], *q[i]) for i in range(n)]
    return frame(spark, out, MATCH)


def models_of(df, key):
    return {r[key]: np.array([r[n] for n in G.NAMES]).reshape(3, 4) for r in df.collect()}


def test_rigid_and_affine_fits_recover_the_model(spark):
    rng = np.random.default_rng(5)
    rigid = [np.column_stack([rotation(rng), rng.uniform(-50, 50, 3)]) for _ in range(4)]
    affine = [np.column_stack([np.eye(3) + rng.uniform(-0.3, 0.3, (3, 3)), rng.uniform(-50, 50, 3)]) for _ in range(4)]
    got = models_of(fit.rigid_fit(fit.moments(matches(spark, rigid), ["pair"]), ["pair"]), "pair")
    assert all(np.allclose(got[k], m, atol=1e-6) for k, m in enumerate(rigid))
    got = models_of(fit.affine_fit(fit.moments(matches(spark, affine), ["pair"]), ["pair"]), "pair")
    assert all(np.allclose(got[k], m, atol=1e-6) for k, m in enumerate(affine))


def test_affine_fit_of_flat_points_is_null(spark):
    flat = matches(spark, [np.eye(3, 4)]).withColumn("pz", F.lit(0.0))
    assert fit.affine_fit(fit.moments(flat, ["pair"]), ["pair"]).first().m00 is None


def test_translation_and_two_point_fit(spark):
    m = matching.fit_model("rigid", np.array([[0.0, 0, 0], [1, 2, 3], [4, 1, 0]]), np.array([[3.0, 3, 3], [4, 5, 6], [7, 4, 3]]))
    assert np.allclose(m, np.column_stack([np.eye(3), [3, 3, 3]]))
    assert matching.fit_model("rigid", np.zeros((2, 3)), np.zeros((2, 3))) is None


def test_ransac_finds_the_planted_inliers(spark):
    rng = np.random.default_rng(2)
    models = [np.column_stack([rotation(rng), rng.uniform(-20, 20, 3)]) for _ in range(2)]
    m = matches(spark, models, n=60, noise=0.2, wrong=20)
    a, b = (sorted(map(tuple, matching.ransac(m, "pair", "match_id", epsilon=3.0, seed=s).select("pair", "match_id").collect())) for s in (1, 1))
    assert a == b and set(a) == {(k, i) for k in range(2) for i in range(20, 60)}
    assert matching.ransac(m.filter("match_id < 4"), "pair", "match_id").count() == 0


def test_descriptor_matching(spark):
    rng = np.random.default_rng(8)
    p = rng.uniform(0, 300, (60, 3))
    a = frame(spark, [(0, i, *v) for i, v in enumerate(p)], "view long, id long, x double, y double, z double")
    b = frame(spark, [(0, i + 100, *(v + 500)) for i, v in enumerate(p)], "view long, id long, x double, y double, z double")
    da, db = (matching.descriptors(d, "view", "id", ["x", "y", "z"]) for d in (a, b))
    got = {(r.ia, r.ib) for r in matching.candidates(da, db, "view", "id", 5.0, 3.0).collect()}
    # a single candidate within the radius is no match; a radius over all of them is needed
    assert got <= {(i, i + 100) for i in range(60)}
    wide = {(r.ia, r.ib) for r in matching.candidates(da, db, "view", "id", 400.0, 3.0).collect()}
    assert wide == {(i, i + 100) for i in range(60)}


def test_radius_join_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    p, q = rng.uniform(-50, 50, (80, 3)), rng.uniform(-50, 50, (90, 3))
    a = frame(spark, [(i, *v) for i, v in enumerate(p)], "i long, x double, y double, z double")
    b = frame(spark, [(i, *v) for i, v in enumerate(q)], "j long, u double, v double, w double")
    near = {(i, j) for i in range(80) for j in range(90) if ((p[i] - q[j]) ** 2).sum() <= 15.0**2}
    assert {(r.i, r.j) for r in spatial.radius_join(a, b, list("xyz"), list("uvw"), 15.0).collect()} == near
    kept = {r.i for r in spatial.radius_join(a, b, list("xyz"), list("uvw"), 15.0, how="left_anti").collect()}
    assert kept == set(range(80)) - {i for i, _ in near}


@pytest.mark.parametrize("touching", [True, False])
def test_box_join_equals_all_pairs(spark, touching):
    rng = np.random.default_rng(4)
    lo = rng.integers(-60, 60, (50, 3))
    hi = lo + rng.integers(0, 40, (50, 3))
    rows = [(i, *lo[i], *hi[i]) for i in range(50)]
    a, b = (frame(spark, rows, f"{s}k long, " + ", ".join(f"{s}{c}{d} long" for c in "lu" for d in range(3))) for s in "ab")
    c = lambda s, k: [f"{s}{k}{d}" for d in range(3)]
    got = [(r.ak, r.bk) for r in spatial.box_join(a, b, c("a", "l"), c("a", "u"), c("b", "l"), c("b", "u"), 30, touching=touching).collect()]
    ok = (lambda x, y: x <= y) if touching else (lambda x, y: x < y)
    want = [(i, j) for i in range(50) for j in range(50) if all(ok(lo[i][d], hi[j][d]) and ok(lo[j][d], hi[i][d]) for d in range(3))]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize(("radius", "few"), [(40.0, 4.0), (5.0, 40.0), (200.0, 1.0)])
def test_nearest_ratio_equals_all_pairs(spark, monkeypatch, radius, few):
    monkeypatch.setattr(spatial, "NEAR_ROWS", few)
    rng = np.random.default_rng(8)
    make = lambda n: [(int(k % 3), k, *map(float, np.rint(rng.normal(0, 20, 3)))) for k in range(n)]
    a, b = make(120), [*make(90), (2, 500, 900.0, 0.0, 0.0), (7, 501, 0.0, 0.0, 0.0)]
    da, db = spark.createDataFrame(a, "g long, ia long, x double, y double, z double"), spark.createDataFrame(b, "g long, ib long, u double, v double, w double")
    d2 = G.distance2([F.col(c) for c in "xyz"], [F.col(c) for c in "uvw"])
    found = spatial.nearest_ratio(da, db, ["g"], "ia", "ib", list("xyz"), list("uvw"), d2, radius, 1.5)
    want = []
    for g, i, *p in a:
        near = sorted((sum((s - t) ** 2 for s, t in zip(p, q, strict=True)), j) for h, j, *q in b if h == g)
        near = [v for v in near if v[0] <= radius * radius]
        if len(near) > 1 and near[0][0] * 1.5 < near[1][0]:
            want.append((g, i, near[0][1], near[0][0]))
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_point_in_box_join_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    points = [(k, *map(float, rng.integers(0, 40, 2))) for k in range(60)]
    boxes = [(k, float(x), float(y), float(x + 6), float(y + 9)) for k, (x, y) in enumerate(rng.integers(0, 6, (50, 2)) * 7)]
    found = spatial.point_in_box_join(spark.createDataFrame(points, "i long, x double, y double"), spark.createDataFrame(boxes, "k long, a double, b double, c double, d double"), ["x", "y"], ["a", "b"], ["c", "d"], [5, 3])
    assert sorted((r.i, r.k) for r in found.collect()) == sorted((i, k) for i, x, y in points for k, a, b, c, d in boxes if a <= x <= c and b <= y <= d)
    assert found.columns == ["i", "x", "y", "k", "a", "b", "c", "d"]


def test_equal_boxes_are_searched_once(spark):
    """Candidates of a point do not grow with the copies of boxes that it is not in."""
    points = spark.createDataFrame([(0.5, 0.5)] * 50, "x double, y double")
    boxes = spark.createDataFrame([(0.6, 0.6, 0.7, 0.7, k) for k in range(200)], "a double, b double, c double, d double, k long")
    found = spatial.point_in_box_join(points, boxes, ["x", "y"], ["a", "b"], ["c", "d"], 1)
    assert found.count() == 0 and "Aggregate" in found._jdf.queryExecution().optimizedPlan().toString()


def test_written_points_in_boxes_take_few_bytes(spark, tmp_path, monkeypatch):
    """Points of a place meet its boxes in short runs that repeat, over several tasks."""
    monkeypatch.setattr(spatial, "POINTS_TOGETHER", 100, raising=False)
    points = spark.range(400).select(F.col("id").alias("i"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    k = np.random.default_rng(5).permutation(30000)[:3000]
    boxes = spark.createDataFrame([(int(v), 0.0, 0.0, 1.0, 1.0) for v in k], "k long, a double, b double, c double, d double")
    found = spatial.point_in_box_join(points, boxes, ["x", "y"], ["a", "b"], ["c", "d"], 1).select("i", "k")
    found.withColumn("task", F.spark_partition_id()).write.parquet(f"file://{tmp_path}/found")
    n = spark.read.parquet(f"file://{tmp_path}/found").agg(F.count("*"), F.countDistinct("i", "k"), F.countDistinct("task")).first()
    assert tuple(n)[:2] == (400 * 3000, 400 * 3000) and n[2] > 1
    assert sum(f.stat().st_size for f in (tmp_path / "found").glob("part-*")) < n[0] / 4


@pytest.mark.parametrize("block", [3, 100])
def test_pairs_in_groups_equal_all_pairs(spark, block):
    rows = [("u", k % 17, k) for k in range(20)] + [("v", k, -k) for k in range(9)] + [("w", 1, 0), (None, 1, 0), (None, 2, 0), ("u", None, 0)]
    found = graph.pairs_in_groups(spark.createDataFrame(rows, "g string, k long, n long"), "g", "k", block)
    want = [(*a, *b) for a in rows for b in rows if None not in (*a, *b) and a[0] == b[0] and a[1] < b[1]]
    assert sorted(tuple(r[f"{s}_{c}"] for s in "ab" for c in "gkn") for r in found.collect()) == sorted(want)


def test_no_group_is_paired_in_one_task(spark):
    found = graph.pairs_in_groups(spark.createDataFrame([(1, k) for k in range(400)], "g long, k long"), "g", "k", 20)
    most = found.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    assert most[1] == 400 * 399 // 2 and most[0] < most[1] / 10


def test_written_pairs_take_few_bytes(spark, tmp_path):
    rows = [("u", int(k)) for k in np.random.default_rng(3).permutation(2500)]
    graph.pairs_in_groups(spark.createDataFrame(rows, "g string, k long"), "g", "k").write.parquet(f"file://{tmp_path}/pairs")
    n = spark.read.parquet(f"file://{tmp_path}/pairs").agg(F.count("*"), F.countDistinct("a_k"), F.sum((F.col("a_k") < F.col("b_k")).cast("long"))).first()
    assert tuple(n) == (2500 * 2499 // 2, 2499, 2500 * 2499 // 2)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("part-*")) < n[0] / 2


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 240)]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(frame(spark, edges, "a long, b long")).collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert {k: v for k, v in got.items() if k in linked} == {v: find(v) for v in linked}


def test_relaxation_recovers_translations(spark):
    rng = np.random.default_rng(7)
    at = {0: np.zeros(3), 1: np.array([100.0, 5, -3]), 2: np.array([198.0, -4, 6])}
    rows = []
    for a, b in ((0, 1), (1, 2)):
        for w in rng.uniform(0, 50, (25, 3)) + at[b]:
            rows.append((a, b, *(w - at[a]), *(w - at[b])))
    m = frame(spark, rows, "tile long, other long, px double, py double, pz double, qx double, qy double, qz double")
    start = models_of(solver.prealign(m, 0), "tile")
    assert all(np.allclose(start[t][:, 3], v, atol=8) for t, v in at.items())
    models, errors = solver.relax(m, [0], iterations=6, start=solver.prealign(m, 0))
    got = models_of(models, "tile")
    assert errors[-1] < 1.5 and np.allclose(got[0], np.eye(3, 4))
    assert all(np.allclose(got[t] @ [25, 25, 25, 1], at[t] + 25, atol=2) for t in at)


def test_concatenate(spark):
    one = solver.identity(spark.range(2).withColumnRenamed("id", "tile")).withColumn("m03", F.lit(5.0))
    two = solver.identity(spark.range(1, 3).withColumnRenamed("id", "tile")).withColumn("m00", F.lit(2.0))
    got = models_of(solver.concatenate(one, two), "tile")
    assert got[0][0, 3] == 5 and got[1][0, 3] == 10 and got[2][0, 0] == 2


def test_inverse_and_compose(spark):
    rng = np.random.default_rng(9)
    m = np.column_stack([np.eye(3) + rng.uniform(-0.2, 0.2, (3, 3)), rng.uniform(-5, 5, 3)]).ravel().tolist()
    row = spark.range(1).select(*[v.alias(n) for v, n in zip(G.compose(m, G.inverse(m)), G.NAMES, strict=True)]).first()
    assert np.allclose(list(row), G.IDENTITY, atol=1e-9)
    assert spark.range(1).select(G.inverse([0.0] * 12)[0]).first()[0] is None


def test_golden_match_statistics(spark):
    m = frame(spark, [(0, 0, 1.0, 1.0, 1.0, 4.0, 4.0, 4.0), (0, 1, 2.0, 2.0, 2.0, 5.0, 5.0, 5.0), (0, 2, 3.0, 3.0, 3.0, 6.0, 6.0, 6.0)], MATCH)
    r = quality.kde(m, "pair", "match_id", 2 ** (-1 / 7)).first()
    assert all(math.isclose(r[c], 0.440468, abs_tol=1e-6) for c in ("min_f", "max_f", "mean_f", "median_f"))
    diagonal = frame(spark, [(10.0 * i,) * 3 for i in range(5)], "x double, y double, z double")
    v = quality.voxel_stats(diagonal, ["x", "y", "z"], [20.0] * 3).first()
    assert (v.cells, v.occupied, v.total) == (27, 3, 5)


def volume_frame(spark, v):
    """A dense volume as voxels of view 1."""
    rows = [(1, *map(int, at), float(v[tuple(at)])) for at in np.argwhere(v != 0)]
    return spark.createDataFrame(rows, "view long, x long, y long, z long, value double")


def test_detection_finds_blobs(spark):
    n, centres = 40, [(12.0, 14.0, 20.0), (27.3, 25.6, 12.2)]
    g = np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij"), axis=-1)
    v = sum(np.exp(-((g - c) ** 2).sum(-1) / (2 * 2.0**2)) for c in centres).astype("<f4")
    blocks = detection.rasterize(volume_frame(spark, v), "view", (n,) * 3, (n,) * 3, 0)
    found = [(r.x, r.y, r.z) for r in detection.detect_points(blocks, "view", 1.8, 0.05).collect()]
    assert len(found) == 2 and all(min(math.dist(c, f) for f in found) < 0.5 for c in centres)


def test_detection_intensity_is_sampled(spark):
    n = 40
    g = np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij"), axis=-1)
    v = (7 + np.exp(-((g - (12.3, 14.4, 20.2)) ** 2).sum(-1) / (2 * 2.0**2))).astype("<f4")
    blocks = detection.rasterize(volume_frame(spark, v), "view", (n,) * 3, (n,) * 3, 0)
    for radius, base in ((0, 7), (9, 0)):
        (r,) = detection.detect_points(blocks, "view", 1.8, 0.05, radius).collect()
        assert abs(r.intensity - base - 1) < 0.1


@pytest.mark.parametrize("radius", [0, 2])
def test_detection_in_blocks_equals_the_whole(spark, radius):
    rng = np.random.default_rng(11)
    v = volume.gaussian(rng.uniform(0, 100, (36, 30, 26)), 1.0).astype("<f4")
    found, response, at, intensity = detection.detect_block(v, 1.5, 3.0, radius)
    want = {tuple(map(int, p)): (round(float(r), 3), *np.round(q, 3), round(float(i), 3)) for p, r, q, i in zip(found, response, at, intensity)}
    halo = detection.reach(1.5, radius, moves=8)
    got = detection.detect_points(detection.rasterize(volume_frame(spark, v), "view", v.shape, (16, 14, 13), halo), "view", 1.5, 3.0, radius).collect()
    assert len(want) > 20 and len(got) == len(want)
    mine = {(r.px, r.py, r.pz): (r.response, r.x, r.y, r.z, r.intensity) for r in got}
    assert set(mine) == set(want) and all(mine[k] == pytest.approx(want[k], abs=2e-3) for k in want)


def test_refinement_of_a_paraboloid():
    g = np.stack(np.meshgrid(*[np.arange(12)] * 3, indexing="ij"), axis=-1)
    peaks = np.array([(4.3, 5.2, 6.4), (6.0, 5.6, 5.1)])
    for p in peaks:
        v = 50 - ((g - p) ** 2 * (1, 2, 0.5)).sum(axis=-1)
        start = np.array([np.rint(p).astype(int), np.rint(p).astype(int) + (1, 0, -1)])
        assert np.allclose(volume.refine(v, start), p)
    assert np.array_equal(volume.refine(np.ones((5, 5, 5)), np.array([[2, 2, 2]])), [[2.0, 2, 2]])
    assert volume.refine(np.ones((5, 5, 5)), np.empty((0, 3), dtype=int)).shape == (0, 3)


@pytest.mark.parametrize(("shape", "radius"), [((14, 13, 3), 1), ((9, 70, 2), 2), ((40, 33, 2), 10), ((5, 3, 2), 2), ((30, 30, 1), 29), ((100, 6, 1), 60)])
def test_background_is_the_median_of_each_window(monkeypatch, shape, radius):
    """Against sorted windows: continuous values, ties, a constant plane, squares of other sizes."""
    rng = np.random.default_rng(3)
    for v in (rng.uniform(size=shape), rng.integers(0, 4, shape), np.full(shape, 7.0), rng.integers(-5000, 5000, shape).astype("<i2")):
        padded = np.pad(v, ((radius, radius), (radius, radius), (0, 0)), mode="reflect")
        windows = np.lib.stride_tricks.sliding_window_view(padded, (2 * radius + 1,) * 2, axis=(0, 1))
        want = v - np.median(windows, axis=(-2, -1))
        for side in (64, 7):
            monkeypatch.setattr(volume, "_SQUARE", side)
            assert np.array_equal(volume.background_subtract(v, radius), want)
    assert volume.background_subtract(v, 0) is v


def test_downsampled_detection_coordinates(spark):
    v = volume_frame(spark, np.arange(1, 65, dtype=float).reshape(4, 4, 4))
    small = {(r.x, r.y, r.z): r.value for r in detection.downsample(v, "view", 2, 4).collect()}
    assert small[0, 0, 0] == np.arange(1, 65).reshape(4, 4, 4)[:2, :2].mean() and len(small) == 4
    p = detection.upsampled(spark.createDataFrame([(1, 1.0, 0.0, 0.0)], "view long, x double, y double, z double"), 2, 4).first()
    assert (p.x, p.y, p.z) == (2.5, 0.5, 1.5)
    chunks = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "view long, chunk string")
    assert {r.view: r.chunks for r in detection.by_view(chunks, ["view"], "chunk").collect()} == {1: ["a", "b"], 2: ["c"]}


@pytest.mark.parametrize("kind", ["rigid", "affine"])
def test_consensus_of_many_trials(kind):
    rng = np.random.default_rng(12)
    m = np.column_stack([rotation(rng) if kind == "rigid" else np.eye(3) + rng.uniform(-0.2, 0.2, (3, 3)), rng.uniform(-500, 500, 3)])
    p = rng.uniform(0, 1000, (300, 3))
    q = p @ m[:, :3].T + m[:, 3] + rng.normal(0, 0.1, (300, 3))
    q[:200] = rng.uniform(0, 1000, (200, 3))
    inside = matching.consensus(p, q, kind, 2000, 5.0, 12, 0.1, 1)
    assert inside[200:].all() and inside[:200].sum() <= 2
    assert not matching.consensus(p[:200], q[:200], kind, 500, 2.0, 12, 0.1, 1).any()
    w = np.zeros((1, 300))
    w[0, 200:] = 1
    assert np.allclose(matching._fit_all(kind, w, p, q).reshape(3, 4), matching.fit_model(kind, p[200:], q[200:]), atol=1e-6)


def test_ransac_takes_text_pairs(spark):
    m = matches(spark, [np.eye(3, 4)], n=20).withColumn("pair", F.lit("left-right"))
    assert matching.ransac(m, "pair", "match_id", trials=50).count() == 20


def test_tile_sizes_grow_and_shrink():
    # 1100 by 512 with 64 shared: the last tile has 64 + (1100 - 896 - 64) % 448 = 204, at most half, so sizes grow:
    # 576 leaves 64 + 12 = 76 (shorter), at 640 two tiles reach beyond the end (1100 - 52)
    assert [layout.last_tile(1100, s, 64) for s in (512, 576, 640)] == [204, 76, 1048] and layout.tile_size(1100, 512, 64) == 640
    # 1300: 64 + 340 = 404, more than half, so sizes shrink while the last tile gets longer: 448 leaves 64 + 84 = 148
    assert [layout.last_tile(1300, s, 64) for s in (512, 448)] == [404, 148] and layout.tile_size(1300, 512, 64) == 512
    # 1700: 64 + 292 = 356; 448 leaves 64 + 100 = 164
    assert layout.tile_size(1700, 512, 64) == 512
    # 1350: 64 + 6 + .. at 512: 1350 - 960 = 390 -> 454; 448: 1350 - 832 = 518 % 384 = 134 -> 198
    assert layout.tile_size(1350, 512, 64) == 512
    assert layout.tile_size(960, 512, 64) == 576 and layout.tile_size(300, 512, 64) == 300
    grown = [n for n in range(513, 3000) if layout.tile_size(n, 512, 64) > 512]
    shrunk = [n for n in range(513, 3000) if layout.tile_size(n, 512, 64) < 512]
    assert grown and shrunk


def test_split_views_number_parts(spark):
    setups = spark.createDataFrame([(0, [1100, 600, 100]), (3, [100, 100, 100])], "id int, size array<int>")
    parts = layout.split_views(setups, (512, 512, 512), (64, 64, 64)).collect()
    assert [r.new_id for r in parts if r.id == 3] == [3 * layout.PARTS]
    mine = sorted((r.new_id, r.lower, r.upper) for r in parts if r.id == 0)
    assert [m[0] for m in mine] == list(range(len(mine))) and mine[0][1] == [0, 0, 0] and mine[1][1] == [576, 0, 0]


def test_fusion_of_turned_tiles(spark):
    rng = np.random.default_rng(13)
    whole = (9, 8, 5)
    tiles = {k: rng.uniform(1, 9, whole) for k in range(3)}
    models = {0: np.eye(3, 4), 1: np.column_stack([[[0, -1, 0], [1, 0, 0], [0, 0, 1]], [12.0, 3, 1]]), 2: np.column_stack([rotation(rng), [4.0, 5, 2]])}
    rows = []
    for k, v in tiles.items():
        for x in range(0, 9, 5):
            part = v[x : x + 5]
            rows.append((k, [x, 0, 0], list(part.shape), bytearray(np.ascontiguousarray(part).tobytes())))
    blocks = spark.createDataFrame(rows, fusion.BLOCK)
    model_rows = frame(spark, [(k, *m.ravel()) for k, m in models.items()], "tile long, " + ", ".join(f"{n} double" for n in G.NAMES))
    shapes = spark.createDataFrame([(k, list(whole)) for k in tiles], "tile long, whole array<int>")
    for blend in fusion.BLENDS:
        got = {}
        for r in fusion.fuse(blocks, model_rows, shapes, (6, 6, 6), (-12, -12, -12), blend).collect():
            v = np.frombuffer(r.data).reshape(r.shape)
            got |= {tuple(np.add(at, r.origin)): v[at] for at in np.ndindex(*r.shape)}
        for at in itertools.product(range(-10, 16, 3), range(-10, 16, 2), range(-8, 10)):
            seen = []
            for k, m in models.items():
                p = np.linalg.solve(m[:, :3], np.array(at) - m[:, 3])
                i = np.floor(p + 0.5).astype(int)
                if np.all((i >= 0) & (i < whole)):
                    seen.append((tiles[k][tuple(i)], max(1e-6, min((p + 1).min(), (np.array(whole) - p).min()))))
            want = {"max": lambda: max(v for v, _ in seen), "first": lambda: seen[0][0], "mean": lambda: np.mean([v for v, _ in seen]), "weighted": lambda: sum(v * w for v, w in seen) / sum(w for _, w in seen)}[blend]() if seen else 0.0
            assert got.get(at, 0.0) == pytest.approx(want), (blend, at)
    with pytest.raises(ValueError, match="blend"):
        fusion.fuse(blocks, model_rows, shapes, (6, 6, 6), blend="sum")


def test_pyramid_of_blocks(spark):
    v = np.random.default_rng(14).uniform(size=(8, 8, 4))
    rows = [([x, y, 0], [4, 4, 4], bytearray(np.ascontiguousarray(v[x : x + 4, y : y + 4]).tobytes())) for x in (0, 4) for y in (0, 4)]
    blocks = spark.createDataFrame(rows, "origin array<long>, shape array<long>, data binary")
    levels = dict(fusion.pyramid(blocks, (4, 4, 4), 3))
    (r,) = levels[1].collect()
    want = v.reshape(4, 2, 4, 2, 2, 2).mean(axis=(1, 3, 5))
    assert np.allclose(np.frombuffer(r.data).reshape(4, 4, 4)[:, :, :2], want)
    (r,) = levels[2].collect()
    assert np.frombuffer(r.data).reshape(4, 4, 4)[1, 1, 0] == pytest.approx(v[4:, 4:].mean())


def test_zoom_and_radial_planes():
    labels = np.arange(24).reshape(4, 3, 2)
    assert np.array_equal(fusion.zoom_labels(labels, (1, 1, 1)), labels)
    big = fusion.zoom_labels(labels, (2, 2, 2))
    assert big.shape == (8, 6, 4) and set(big.ravel()) == set(range(24)) and big[-1, -1, -1] == 23
    v = np.fromfunction(lambda x, y: 2 * x + y, (21, 31))
    assert np.allclose(fusion.radial_correct(v, 100.0, 3.0, 2), v[2:-2, 2:-2])
    moved = fusion.radial_correct(v, 5.0, -2.0, 0)
    assert moved[10, 15] == v[10, 15] and moved[0, 0] > v[0, 0]


def test_settled_needs_every_slope():
    assert not solver.settled([1.0] * 6, 5) and solver.settled([1.0] * 7, 5)
    assert not solver.settled([5.0] * 7, 5, allowed=2.0)
    assert not solver.settled([1.0] * 6 + [1.001], 5)
    assert solver.settled([9.0] * 3 + [1.0] * 7, 5)


def test_solver_metrics(spark):
    import json

    m = json.loads(solver.metrics([4.0, 2.0], frame(spark, [(0, 1.5)], "tile long, error double")))
    assert m["tile_errors"] == {"0": 1.5} and m["solver_metrics_per_tile"]["stats"][1] == {"iteration": 1, "error": 2.0, "mean": 3.0, "min": 2.0, "max": 4.0, "rms": math.sqrt(10)}


def test_groups_that_overlap_become_one(spark):
    g = frame(spark, [(1, 10), (1, 11), (2, 11), (2, 12), (3, 12), (7, 70), (8, 80)], "group long, view long")
    assert sorted((r.view, r.group) for r in solver.merged_groups(g).collect()) == [(10, 1), (11, 1), (12, 1), (70, 7), (80, 8)]


def test_two_rounds_put_components_in_place(spark):
    rng = np.random.default_rng(15)
    at = {0: np.zeros(3), 1: np.array([50.0, 2, 1]), 5: np.array([0.0, 80, 3]), 6: np.array([52.0, 81, 2])}

    def link(a, b, n):
        return [(a, b, *(w - at[a]), *(w - at[b])) for w in rng.uniform(0, 30, (n, 3)) + at[b]]

    schema = "tile long, other long, px double, py double, pz double, qx double, qy double, qz double"
    strong = frame(spark, link(0, 1, 12) + link(5, 6, 12), schema)
    weak = frame(spark, link(0, 5, 8) + link(1, 6, 8) + link(0, 1, 3), schema)
    models, errors = solver.two_rounds(strong, weak, 0, iterations=60, plateau=5)
    got = models_of(models, "tile")
    assert all(np.allclose(got[t], np.column_stack([np.eye(3), v]), atol=0.1) for t, v in at.items())
    assert errors["tiles"][-1] < 0.1 and errors["components"][-1] < 0.1


def test_alignment_gate():
    text = '{"alignment errors": {"minimum error": 0.5, "maximum error": 4.0}}'
    assert quality.alignment_gate(text) == [] and quality.alignment_gate(text, 0.5, 4.0) == []
    assert len(quality.alignment_gate(text, 0.6, 3.9)) == 2
    with pytest.raises(KeyError):
        quality.alignment_gate("{}")


def test_acquisition_resolution_and_units(spark):
    one = '{"schema_version": "1.0.4", "tiles": [{"coordinate_transformations": [{"type": "translation", "translation": [1]}, {"type": "scale", "scale": ["0.5", 0.6, 2.0]}]}]}'
    two = '{"schema_version": "2.1.0", "data_streams": [{"configurations": [{"device": 1}, {"images": [{"image_to_acquisition_transform": [{"object_type": "Rotation"}, {"object_type": "Scale", "scale": [1.0, 1.5, 4.0]}]}]}]}]}'
    rows = spark.createDataFrame([(one,), (two,), ("{}",)], "j string").select(viewer.voxel_resolution(F.col("j")).alias("r")).collect()
    assert [r.r for r in rows] == [[2.0, 0.6, 0.5], [4.0, 1.5, 1.0], None]
    value, base = viewer.in_base_unit(F.col("v"), F.col("u"))
    got = spark.createDataFrame([(2.0, "microns"), (3.0, "ms"), (1.0, "parsec")], "v double, u string").select(value.alias("x"), base.alias("b")).collect()
    assert [(r.x and round(r.x, 9), r.b) for r in got] == [(2e-6, "m"), (0.003, "s"), (None, None)]


def test_transform_lists(spark):
    turn, move, mirror = [0, -1, 0, 1, 1, 0, 0, 0, 0, 0, 1, 0], [1, 0, 0, 5, 0, 1, 0, 6, 0, 0, 1, 7], [1, 0, 0, 0, 0, -1, 0, 0, 0, 0, 1, 2]
    rows = [(1, 0, "grid", move), (1, 1, "turn", turn), (1, 2, "turn", mirror), (2, 0, "turn", turn)]
    t = spark.createDataFrame([(a, b, c, list(map(float, m))) for a, b, c, m in rows], "view long, seq long, kind string, affine array<double>")
    full = lambda m: np.vstack([np.reshape(m, (3, 4)), [0, 0, 0, 1]])
    found = lambda df: {r.view: np.reshape(r.affine, (3, 4)) for r in df.collect()}
    a = found(transforms.rotation_after_calibration(t, ["view"], F.col("kind") == "grid", F.col("kind") == "turn"))
    assert np.allclose(a[1], (full(mirror) @ full(move))[:3]) and np.allclose(a[2], full(turn)[:3])
    b = found(transforms.rotations_after_grid(t, ["view"], F.col("kind") == "turn", F.col("kind") == "grid"))
    assert np.allclose(b[1], (full(turn) @ full(mirror) @ full(move))[:3])
    c = found(transforms.net(t, ["view"]))
    assert np.allclose(c[1][:, :3], full(turn)[:3, :3] @ full(mirror)[:3, :3]) and np.allclose(c[1][:, 3], [6, 6, 9])


def test_sample_linear():
    rng = np.random.default_rng(4)
    g = np.stack(np.meshgrid(*[np.arange(k) for k in (5, 6, 7)], indexing="ij"), axis=-1).astype(float)
    at = rng.uniform(0, (4, 5, 6), (50, 3))
    poly = lambda p: 2 + p @ (1, -3, 0.5) + p.prod(axis=-1)
    assert np.allclose(volume.sample_linear(poly(g), at), poly(at))
    v = rng.uniform(size=(5, 6, 7))
    assert np.allclose(volume.sample_linear(v, g.reshape(-1, 3)), v.ravel())
    assert np.allclose(volume.sample_linear(v, np.array([[-0.3, 2, 3], [4.4, 2, 3]])), [v[0, 2, 3], v[4, 2, 3]])


def test_kernels():
    v = np.full((12, 11, 10), 3.0)
    assert np.allclose(volume.gaussian(v, 1.5), 3) and np.allclose(volume.background_subtract(v, 2), 0)
    assert np.array_equal(volume.background_subtract(v, 0), v)
    shifted = volume.resample_nearest(np.arange(27.0).reshape(3, 3, 3), np.column_stack([np.eye(3), [1, 0, 0]]), (3, 3, 3))
    assert shifted[0, 0, 0] == 9 and (shifted[2] == 0).all()


def test_layout():
    for length, target, overlap in itertools.product((50, 128, 500, 1388), (64, 128, 256), (0, 32)):
        parts = layout.split_axis(length, target, overlap)
        assert parts[0][0] == 0 and parts[-1][1] == length - 1
        assert all(b[0] == a[1] + 1 - overlap for a, b in itertools.pairwise(parts))
    assert layout.to_rank((3, 4)) == (1, 1, 1, 3, 4) and layout.to_rank((1, 1, 2, 3, 4, 5)) == (1, 2, 3, 4, 5)
    shape = layout.block_shape((1000, 1000, 1000), (64, 64, 64), 2, 64 << 20)
    assert 0.25 < math.prod(shape) * 2 / (64 << 20) < 4
    meta = layout.pyramid_metadata("x", 3, (2.0, 1.0, 1.0))["multiscales"][0]["datasets"][2]["coordinateTransformations"]
    assert meta[0]["scale"][2:] == [8.0, 4.0, 4.0] and meta[1]["translation"][2:] == [3.0, 1.5, 1.5]


def test_split_points(spark):
    setups = spark.createDataFrame([(0, [200, 100, 50])], "id int, size array<int>")
    parts = layout.split_views(setups, (100, 100, 100), (40, 40, 40))
    boxes = [(r.lower, r.upper) for r in parts.collect()]
    assert all(any(b[0][0] <= x <= b[1][0] for b in boxes) for x in range(200))
    pts = frame(spark, [(0, 150.0, 50.0, 20.0)], "setup int, x double, y double, z double")
    got = layout.points_in_parts(pts, parts).collect()
    assert len(got) == sum(b[0][0] <= 150 <= b[1][0] for b in boxes)
    overlap = spark.createDataFrame([(1, [0, 0, 0], [99, 99, 99])], "k long, lower array<long>, upper array<long>")
    made = layout.synthetic_points(overlap, "k", 100.0, 5, 1000, 2.0).collect()
    assert len(made) == 100 and all(abs(r.px - r.qx) <= 2 for r in made)
    assert made == layout.synthetic_points(overlap, "k", 100.0, 5, 1000, 2.0).collect()


def test_stream_equals_batch(spark, tmp_path):
    from stitchlake.streaming.detection_qc import windowed_stats

    rows = [(f"2024-01-0{1 + i // 20} 0{i % 9}:00:00", i % 3, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "t string, view long, v double").select(F.to_timestamp("t").alias("ts"), "view", "v")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_stats(stream, "ts", "view", "v").writeStream.format("memory").queryName("qc").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = df.groupBy(F.window("ts", "1 day"), "view").count().count()
    assert spark.table("qc").count() == want == 9


def test_knn_equals_all_pairs(spark):
    rng = np.random.default_rng(11)
    clumped = np.concatenate([rng.normal(0, 1, (40, 3)), rng.normal(500, 1, (20, 3)), rng.uniform(-2000, 2000, (5, 3)), np.zeros((6, 3))])
    rows = [(0, i, *v) for i, v in enumerate(clumped)] + [(1, 900, 1.0, 2.0, 3.0), (2, 901, 0.0, 0.0, 0.0), (2, 902, 5.0, 0.0, 0.0)]
    got = {(r.g, r.i, r["rank"]): r.neighbour for r in spatial.knn_self(frame(spark, rows, "g long, i long, x double, y double, z double"), "g", "i", ["x", "y", "z"], 3).collect()}
    want = {}
    for g, i, *v in rows:
        near = sorted((float(((np.array(v) - np.array(w)) ** 2).sum()), j) for h, j, *w in rows if h == g and j != i)
        want |= {(g, i, r + 1): j for r, (_, j) in enumerate(near[:3])}
    assert {k: v for k, v in got.items()} == want


def test_domain_net_model(spark):
    rng = np.random.default_rng(12)
    ms = [np.column_stack([np.eye(3) + rng.uniform(-0.2, 0.2, (3, 3)), rng.uniform(-5, 5, 3)]) for _ in range(3)]
    df = spark.createDataFrame([([m.ravel().tolist() for m in ms],)], "t array<array<double>>")
    got = np.array(df.select(G.domain_net(F.col("t"))).first()[0]).reshape(3, 4)
    linear, shift = np.eye(3), np.zeros(3)
    for m in ms:
        shift = shift + np.linalg.inv(linear) @ m[:, 3]
        linear = m[:, :3] @ linear
    assert np.allclose(got[:, :3], linear) and np.allclose(got[:, 3], shift)


def test_viewer_rows(spark):
    import json

    from stitchlake.operators import viewer

    schema = "source string, channel int, name string, range_lo int, range_hi int, visible boolean, color string"
    rows = spark.createDataFrame([("/results/a/tile_1.zarr", None, None, None, None, None, "red"), ("s3://b/x.zarr", 2, "named", 5, 90, False, None)], schema)
    out = json.loads(viewer.state(viewer.layers(rows, "s3", "bucket"), (1e-6, 1e-6, 2e-6)).first().state)
    assert [x["name"] for x in out["layers"]] == ["named", "tile_1_0"] and out["layers"][1]["source"] == "zarr://s3://bucket/a/tile_1.zarr"
    assert out["layers"][1]["shaderControls"]["normalized"]["range"] == [0, 200] and 'default="red"' in out["layers"][1]["shader"]
    with pytest.raises(Exception, match="unknown image format"):
        viewer.layers(rows.withColumn("source", F.lit("a.tif")), "s3", "b").collect()
    one = F.lit(1)
    assert "range=[1, 2]" in spark.range(1).select(viewer.rgb_shader([(one, F.lit(2))] * 3)).first()[0]


def test_trials_are_shared_by_tasks(spark):
    """Parts of the trials find together what all find at once, and a pair's trials are not one task's work."""
    rng = np.random.default_rng(4)
    p, q = rng.normal(size=(3000, 3)) * 100, rng.normal(size=(3000, 3)) * 100
    whole = matching.best_sample(p, q, "rigid", 2000, 120.0, 5)
    parts = [matching.best_sample(p, q, "rigid", 2000, 120.0, 5, part=i, parts=4) for i in range(4)]
    assert whole == max(parts, key=lambda b: (b[0], -b[1])) and min(b[0] for b in parts) > 0
    rows = [(k, i, *map(float, (*p[i], *q[i]))) for k in (None, 1) for i in range(50)]
    m = spark.createDataFrame(rows, "pair long, match_id long, px double, py double, pz double, qx double, qy double, qz double")
    found = matching.ransac(m, "pair", "match_id", trials=50, epsilon=120.0)
    assert {r.pair for r in found.select("pair").distinct().collect()} == {None, 1}
    assert "hashpartitioning(pair#" in (plan := found._jdf.queryExecution().toString()) and f", {matching.TASKS})" in plan
