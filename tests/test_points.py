"""Point sets as chunked arrays; ranks, thresholds, bins and colours against plain versions."""

import itertools
import json
import os

import numpy as np
import pytest
import zstandard

from stitchlake.operators import graph, layout, ordered, quality, solver, spatial
from stitchlake.sources import points, shared, store

SCHEMA = "timepoint int, setup int, label string, x double, y double, z double, intensity double"


@pytest.mark.parametrize("chunk", [7, 300_000])
def test_point_arrays_round_trip(spark, tmp_path, chunk):
    rng, folder = np.random.default_rng(0), f"file://{tmp_path}/points"
    made = [(0, s, "beads", *map(float, rng.integers(0, 9, 4))) for s, n in ((1, 50), (2, 14), (3, 1)) for _ in range(n)]
    df = spark.createDataFrame(made, SCHEMA)
    sets = spark.createDataFrame([(0, s, "beads") for s in (1, 2, 3, 4, 9)], "timepoint int, setup int, label string").withColumn("uri", points.set_path(folder))
    assert points.write_point_arrays(df.repartition(5), folder, sets.filter("setup <> 9"), chunk) == 65
    for again in (False, True):
        got = points.read_point_arrays(sets).select("setup", "point_id", "x", "y", "z", "intensity").collect()
        want = {s: sorted(r[3:] for r in made if r[1] == s) for s in (1, 2, 3)}
        assert sorted(map(tuple, got)) == [(s, i, *r) for s in (1, 2, 3) for i, r in enumerate(want[s])]
        if not again:  # fewer points than before: nothing of the old set is read
            made = made[:10] + made[50:]
            points.write_point_arrays(spark.createDataFrame(made, SCHEMA), folder, sets.filter("setup <> 9"), chunk)
    root = tmp_path / "points/tpId_0_viewSetupId_4/beads/interestpoints"
    assert json.loads((root / "loc/attributes.json").read_text())["dimensions"] == [0] and os.listdir(root / "loc") == ["attributes.json"]
    loc = json.loads((root.parent.parent.parent / "tpId_0_viewSetupId_2/beads/interestpoints/loc/attributes.json").read_text())
    assert (loc["dimensions"], loc["blockSize"], loc["dataType"]) == ([3, 14], [3, chunk], "float64")


def test_point_arrays_of_other_writers(spark, tmp_path):
    """Zarr data sets, chunks of different sizes, no ids or intensities."""
    loc, ids = np.arange(33.0).reshape(11, 3), np.arange(100, 111).astype("<u8")
    for name, v, chunks in (("loc", loc.astype("<f8"), [4, 3]), ("id", ids, [5])):
        d = tmp_path / "a" / name
        d.mkdir(parents=True)
        (d / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": list(v.shape), "chunks": chunks, "dtype": v.dtype.str, "order": "C", "compressor": {"id": "zstd"}, "fill_value": 0}))
        for k in range(-(-11 // chunks[0])):
            part = v[k * chunks[0] : (k + 1) * chunks[0]]
            part = np.concatenate([part, np.zeros((chunks[0] - len(part), *v.shape[1:]), v.dtype)])
            (d / ".".join([str(k), *["0"] * (v.ndim - 1)])).write_bytes(zstandard.ZstdCompressor().compress(part.tobytes()))
    d = tmp_path / "b" / "loc" / "0"
    d.mkdir(parents=True)
    (d.parent / "attributes.json").write_text(store.attributes((3, 2), (3, 4), "float32", "raw"))
    (d / "0").write_bytes(store.pack_block(np.array([[1, 2], [3, 4], [5, 6]], "float32"), "raw"))
    rows = [(n, f"file://{tmp_path}/{n}") for n in "abc"]
    got = sorted(map(tuple, points.read_point_arrays(spark.createDataFrame(rows, "name string, uri string")).collect()))
    assert got == [("a", 100 + i, *loc[i], None) for i in range(11)] + [("b", 0, 1, 3, 5, None), ("b", 1, 2, 4, 6, None)]


def test_ranks_of_a_hot_group(spark):
    rng = np.random.default_rng(1)
    rows = [(0 if i % 3 else int(rng.integers(1, 50)), int(rng.integers(0, 40))) for i in range(3000)]
    got = ordered.ranks(spark.createDataFrame(rows, "g long, v long").repartition(7), ["g"], ["v"]).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r["rank"], r.v) for r in got if r.g == g)
        assert [r for r, _ in mine] == list(range(1, len(mine) + 1)) and [v for _, v in mine] == sorted(v for h, v in rows if h == g)


@pytest.mark.parametrize("most", [0.2, 3, 40, 1000])
def test_top_scaled_equals_sorting(spark, most):
    rng = np.random.default_rng(2)
    rows = [(g, i, float(np.round(rng.normal(0, 50), d))) for g, n in ((1, 400), (2, 90), (3, 7), (4, 1)) for d in (1,) for i in range(n)]
    rows += [(5, i, 7.0) for i in range(300)] + [(6, i, -1e300 * (i % 2)) for i in range(10)]
    got = {}
    for r in spatial.top_scaled(spark.createDataFrame(rows, "g long, i long, v double"), "g", "v", "i", most).collect():
        got.setdefault(r.g, set()).add(r.i)
    for g in range(1, 7):
        mine = sorted((-v, i) for h, i, v in rows if h == g)
        keep = int(np.rint(most * len(mine) / 400))
        keep = keep if 1 <= keep <= len(mine) - 1 else len(mine)
        assert got[g] == {i for _, i in mine[:keep]}, (g, most)


@pytest.mark.parametrize("bandwidth", [0.05, 0.9])
def test_kde_by_bins(spark, bandwidth):
    rng, rows = np.random.default_rng(3), []
    for pair, d in ((1, rng.gamma(2, 3, 300)), (2, np.full(5, 4.0)), (3, np.r_[rng.normal(0, 1e-3, 50) + 1, 1e4]), (4, [2.0])):
        rows += [(pair, i, 0.0, 0.0, 0.0, float(x), 0.0, 0.0) for i, x in enumerate(np.abs(d))]
    got = {r.pair: r for r in quality.kde(spark.createDataFrame(rows, "pair long, k long, px double, py double, pz double, qx double, qy double, qz double"), "pair", "k", bandwidth).collect()}
    for pair in (1, 2, 3, 4):
        e = np.array([r[5] for r in rows if r[0] == pair])
        v = (e - e.mean()) / (e.std() or 1)
        f = np.exp(-((v[:, None] - v[None, :]) ** 2) / (2 * bandwidth**2)).mean(axis=1) / (bandwidth * np.sqrt(2 * np.pi))
        r = got[pair]
        assert [r.min_f, r.max_f, r.mean_f, r.median_f, r.std_f] == pytest.approx([f.min(), f.max(), f.mean(), np.median(f), f.std()], abs=1.1e-6)


def test_knn_of_clustered_points(spark):
    """Few far points go on alone; the rest is done in the first rounds."""
    rng = np.random.default_rng(4)
    xyz = np.r_[rng.normal(0, 1, (150, 3)), rng.normal(0, 1, (20, 3)) + 500, [[1e4, 0, 0]], np.zeros((3, 3))]
    rows = [(0, i, *map(float, v)) for i, v in enumerate(xyz)] + [(1, 0, 0.0, 0.0, 0.0), (1, 1, 5.0, 0.0, 0.0)]
    got = {}
    for r in spatial.knn_self(spark.createDataFrame(rows, "g long, i long, x double, y double, z double"), "g", "i", ["x", "y", "z"], 3).collect():
        got.setdefault((r.g, r.i), []).append((r["rank"], r.d2, r.neighbour))
    for i, v in enumerate(xyz):
        want = sorted((float(d), j) for j, d in enumerate(((xyz - v) ** 2).sum(axis=1)) if j != i)[:3]
        assert [(d, j) for _, d, j in sorted(got[0, i])] == [(pytest.approx(d), j) for d, j in want]
    assert [j for *_, j in got[1, 0]] == [1] and len(got) == len(rows)


def test_colours_differ_along_edges(spark):
    rng = np.random.default_rng(5)
    edges = {tuple(sorted(map(int, e))) for e in rng.integers(0, 60, (150, 2))} | {(i, i + 1) for i in range(100, 140)} | {(0, 0)}
    got = {r.node: r.colour for r in graph.coloured(spark.createDataFrame(list(edges), "a long, b long")).collect()}
    assert got.keys() == {v for e in edges for v in e}
    assert all(got[a] != got[b] for a, b in edges if a != b)
    degree = {v: sum(v in e for e in edges if e[0] != e[1]) for v in got}
    assert max(got.values()) <= max(degree.values()) and max(c for v, c in got.items() if v >= 100) <= 2


def planted(spark, at, edges, seed=6):
    rng = np.random.default_rng(seed)
    rows = [(a, b, *(w - at[a]), *(w - at[b])) for a, b in edges for w in rng.uniform(0, 40, (12, 3)) + at[b]]
    return spark.createDataFrame([(a, b, *map(float, v)) for a, b, *v in rows], "tile long, other long, " + ", ".join(f"{s}{a} double" for s in "pq" for a in "xyz"))


@pytest.mark.parametrize("shape", ["ring", "grid"])
def test_coloured_relaxation_from_the_identity(spark, shape, tmp_path, monkeypatch):
    """Tiles far from their places come there in fewer iterations than when all move at once, and no more than the
    newest table of models stays."""
    if shape == "ring":
        at = {k: np.array([60 * np.cos(k), 60 * np.sin(k), 2.0 * k]) for k in range(4)}
        edges = [(k, (k + 1) % 4) for k in range(4)]
    else:
        at = {3 * i + j: np.array([30.0 * i, 25.0 * j, i - j]) for i in range(2) for j in range(3)}
        edges = [(k, k + 1) for k in at if k % 3 < 2] + [(k, k + 3) for k in at if k < 3]
    at = {k: v - at[0] for k, v in at.items()}
    m = planted(spark, at, edges)
    count = itertools.count()
    monkeypatch.setattr(shared, "shared_folder", lambda spark, name: f"file://{tmp_path}/{name}-{next(count)}")
    models, errors = solver.relax(m, [0], iterations=6, plateau=200)
    assert sum("models" in d for d in os.listdir(tmp_path)) == 1
    _, slow = solver.relax(m, spark.createDataFrame([(0,)], "tile long"), iterations=6, plateau=200, coloured=False)
    assert all(a < b for a, b in zip(errors, slow, strict=True)) and errors[3] < slow[5]
    assert models.filter("tile = 0").first().m03 == 0


@pytest.mark.parametrize("radius", [3.0, 25.0])
def test_synthetic_points_keep_their_distance(spark, radius):
    """As taking overlaps and points one after another."""
    boxes = [(k, a, b, [10 * b, 0, 0], [10 * b + 40, 30, 20]) for k, (a, b) in enumerate([(1, 0), (2, 0), (2, 1), (3, 1), (3, 2), (4, 0), (4, 3)])]
    overlaps = spark.createDataFrame(boxes, "k long, a long, b long, lower array<long>, upper array<long>")
    made = layout.synthetic_points(overlaps, "k", 900.0, 5, 40, 2.0)
    rows = sorted(made.collect(), key=lambda r: (r.k, r.i))
    assert len(rows) == sum(min(40, max(5, int(np.ceil(41 * 31 * 21 * 900 / 1e6)))) for _ in boxes)
    kept, seen = set(), {}
    for k, a, b, lo, hi in boxes:
        before = list(seen.get(b, []))
        for r in rows:
            if r.k != k:
                continue
            t = np.array([r.tx, r.ty, r.tz])
            assert all(x <= v <= y + 1 for x, v, y in zip(lo, t, hi, strict=True))
            if all(((t - s) ** 2).sum() > radius * radius for s in before):
                kept.add((r.k, r.i))
                seen.setdefault(a, []).append(np.array([r.px, r.py, r.pz]))
                seen.setdefault(b, []).append(np.array([r.qx, r.qy, r.qz]))
    got = {(r.k, r.i) for r in layout.without_crowded(made, "k", radius).collect()}
    assert got == kept and 0 < len(kept) < len(rows)
    assert layout.without_crowded(made.limit(0), "k", radius).collect() == []


def test_crowded_points_are_found_in_few_rows(spark, monkeypatch):
    """Cells two radii wide: 8 rows a point, the pairs of cells one radius wide; rounds hold only points that wait."""
    rng = np.random.default_rng(5)
    a, b = ([(int(i), *map(float, rng.uniform(-15, 15, 3)), int(i % 2)) for i in range(150)] for _ in range(2))
    a.append((150, 4.0, 0.0, 0.0, 0))
    b.append((150, 0.0, 0.0, 0.0, 0))  # as far away as the radius
    a = spark.createDataFrame(a, "i long, x double, y double, z double, v int")
    b = spark.createDataFrame(b, "j long, u double, w double, t double, v int")
    pairs = [{(r.i, r.j) for r in spatial.radius_join(a, b, ["x", "y", "z"], ["u", "w", "t"], 4.0, ["v"], coarse=n).collect()} for n in (1, 2, 3)]
    assert pairs[0] == pairs[1] == pairs[2] and (150, 150) in pairs[0] and len(pairs[0]) > 10
    assert [spatial._near_cells(b, ["u", "w", "t"], 4.0, True, n).count() for n in (1, 2)] == [27 * 151, 8 * 151]

    sizes = []
    monkeypatch.setattr(layout, "written", lambda df, name, f=layout.written: (out := f(df, name), sizes.append((name, out.count())))[0])
    boxes = [(k, a, a - 1, [10 * a, 0, 0], [10 * a + 40, 90, 90]) for k, a in enumerate(range(1, 8))]
    overlaps = spark.createDataFrame(boxes, "k long, a long, b long, lower array<long>, upper array<long>")
    made = layout.synthetic_points(overlaps, "k", 900.0, 5, 40, 2.0)
    assert made.rdd.getNumPartitions() > 1
    left = layout.without_crowded(made, "k", 12.0).count()
    assert sizes[0] == ("points", 280) and left < 280 and all(n < 280 for _, n in sizes[1:])
