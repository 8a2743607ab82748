"""Descriptors and stores written to the shared folder and read back (survey 2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transforms as T
from ..sources import points, precomputed, project, store
from ._base import PTS, pts, query, r6, shared_folder, table


def _projects(setups):
    """The project of each setup: sixteen of them."""
    return setups.select("setup", F.concat(F.lit("project_"), F.col("setup") % 16).alias("name"))


def _descriptors(spark, sf) -> str:
    """The folder of descriptors of one view a supplier, written by executors, a file a project."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    views = s.select(F.lit(0).alias("timepoint"), k.alias("setup"), F.lit(0).alias("series"), (k % 3).cast("string").alias("channel"), F.concat(F.lit("tile_"), k, F.lit("_ch_"), k % 3, F.lit(".tif")).alias("file_path"))
    attributes = F.create_map(F.lit("tile"), k.cast("string"), F.lit("angle"), (k % 4).cast("string"))
    setups = s.select(k.alias("id"), F.col("s_name").alias("name"), F.array(100 + k % 7, 200 + k % 5, F.lit(50)).alias("size"), F.lit("um").alias("voxel_unit"), F.array(F.lit(0.5), F.lit(0.5), F.lit(2.0)).alias("voxel_size"), attributes.alias("attributes"))
    model = F.array(*[F.lit(float(i % 5 == 0)) if i % 4 < 3 else (k % (3 + i)).cast("double") for i in range(12)])
    lists = s.select(F.lit(0).alias("timepoint"), k.alias("setup"), F.posexplode(F.array(F.lit("calibration"), F.lit("grid"))).alias("seq", "name"), F.lit("affine").alias("type"), model.alias("affine"))
    sets = s.select(F.lit(0).alias("timepoint"), k.alias("setup"), F.lit("beads").alias("label"), F.lit("DOG s=1.8").alias("params"), F.concat(F.lit("points/"), k).alias("path"))
    folder = shared_folder(spark) + "/projects"
    project.write_descriptors(views, setups, lists, sets, _projects(views), folder)
    return folder


@query("""SELECT s_suppkey::INT AS setup, (s_suppkey % 3)::VARCHAR AS channel, 'tile_' || s_suppkey || '_ch_' || s_suppkey % 3 || '.tif' AS file_path,
  (100 + s_suppkey % 7)::INT AS nx, s_name AS name, (s_suppkey % 4)::VARCHAR AS angle, 'points/' || s_suppkey AS points FROM supplier""")
def q_view_scan(spark, sf):
    """Files, setups and point sets of descriptors."""
    path = _descriptors(spark, sf)
    setups = project.view_setups(spark, path).select(F.col("id").alias("setup"), "name", F.get("size", F.lit(0)).alias("nx"), F.col("attributes")["angle"].alias("angle"))
    found = project.views(spark, path).join(setups, "setup").join(project.point_sets(spark, path).select("setup", F.col("path").alias("points")), "setup")
    return found.select("setup", "channel", "file_path", "nx", "name", "angle", "points")


_TWICE = ", ".join(f"round(2.0 * (s_suppkey % {3 + i}), 6) AS t{i // 4}" for i in (3, 7, 11))


@query(f"SELECT s_suppkey::INT AS setup, {_TWICE} FROM supplier".replace("round(2.0 * (s_suppkey % ", "CAST(2 * (s_suppkey % ").replace("), 6) AS", ") AS DOUBLE) AS"))
def q_registration_scan(spark, sf):
    """The ordered product of each view's models from descriptors: two equal shifts."""
    lists = project.view_transforms(spark, _descriptors(spark, sf)).groupBy("setup").agg(T.composed().alias("m"))
    return lists.select("setup", *[r6(F.get("m", F.lit(i)), f"t{i // 4}") for i in (3, 7, 11)])


@query("SELECT s_suppkey::INT AS setup, 3::BIGINT AS models, CASE WHEN s_suppkey % 2 = 0 THEN 7.0 ELSE 1.0 END::DOUBLE AS first FROM supplier")
def q_saved_models(spark, sf):
    """Solved models put before each view's list, identity where a view has none; the descriptors are written and read again."""
    path = _descriptors(spark, sf)
    views, setups, lists = project.views(spark, path), project.view_setups(spark, path), project.view_transforms(spark, path)
    model = F.array(*[F.lit(7.0 if i == 0 else float(i % 5 == 0)) for i in range(12)])
    solved = views.filter("setup % 2 = 0").select("timepoint", "setup", model.alias("affine"))
    folder = shared_folder(spark) + "/solved"
    project.write_descriptors(views, setups, project.with_models(lists, solved, "solved"), project.point_sets(spark, path), _projects(views), folder)
    again = project.view_transforms(spark, folder)
    return again.groupBy("setup").agg(F.count("*").alias("models"), F.max(F.when(F.col("seq") == 0, F.get("affine", F.lit(0)))).alias("first"))


@query(f"""WITH {PTS} SELECT label::INT AS setup, CAST(row_number() OVER (PARTITION BY label ORDER BY x, y, z, intensity) - 1 AS BIGINT) AS point_id, round(x, 6) + 0.0 AS x, round(intensity, 6) + 0.0 AS intensity FROM pts""")
def q_points_store(spark, sf):
    """Points written by view, ids by place, and read back."""
    folder = shared_folder(spark) + "/points"
    store.write_points(pts(spark, sf).select(F.lit(0).alias("timepoint"), F.col("label").cast("int").alias("setup"), F.lit("beads").alias("label"), "x", "y", "z", "intensity"), folder)
    return store.read_points(spark, folder).select("setup", "point_id", r6(F.col("x"), "x"), r6(F.col("intensity"), "intensity"))


@query("SELECT DISTINCT 'v' || (o_custkey % 20) AS view_a, o_orderkey AS id_a, 'v' || (o_custkey % 20 + 1 + o_orderkey % 5) AS view_b, o_orderkey + 1 AS id_b FROM orders WHERE 'v' || (o_custkey % 20) < 'v' || (o_custkey % 20 + 1 + o_orderkey % 5) UNION SELECT DISTINCT 'v' || (o_custkey % 20 + 1 + o_orderkey % 5), o_orderkey + 1, 'v' || (o_custkey % 20), o_orderkey FROM orders WHERE 'v' || (o_custkey % 20) > 'v' || (o_custkey % 20 + 1 + o_orderkey % 5)")
def q_correspondence_store(spark, sf):
    """Correspondences stored in both directions, each read once."""
    folder, c, o = shared_folder(spark) + "/matches", F.col("o_custkey") % 20, F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("v"), c).alias("view_a"), F.lit("beads").alias("label_a"), o.alias("id_a"), F.concat(F.lit("v"), c + 1 + o % 5).alias("view_b"), F.lit("beads").alias("label_b"), (o + 1).alias("id_b")
    )
    store.write_correspondences(rows, folder)
    return store.read_correspondences(spark, folder).select("view_a", "id_a", "view_b", "id_b")


@query("SELECT CAST(s_suppkey AS DOUBLE) AS x, CAST(s_suppkey % 7 AS DOUBLE) AS y, CAST(s_suppkey % 5 AS DOUBLE) AS z FROM supplier")
def q_markers(spark, sf):
    """Cell markers of XML files that the executors write, a file a group."""
    k = F.col("s_suppkey")
    folder = shared_folder(spark) + "/markers"

    def write(f):
        body = "".join(f"<Marker><MarkerX>{x}</MarkerX><MarkerY>{y}</MarkerY><MarkerZ>{z}</MarkerZ></Marker>" for x, y, z in zip(f["x"], f["y"], f["z"], strict=True))
        precomputed.put(f"{folder}/{f['g'].iloc[0]}.xml", f"<Markers>{body}</Markers>".encode())
        return f[["g"]].head(1)

    rows = table(spark, sf, "supplier").select((k % 16).alias("g"), k.alias("x"), (k % 7).alias("y"), (k % 5).alias("z"))
    rows.groupBy("g").applyInPandas(write, "g long").count()
    return project.markers(spark, folder)


@query(f"""WITH {PTS} SELECT label::INT AS setup, CAST(row_number() OVER (PARTITION BY label ORDER BY x, y, z, intensity) - 1 AS BIGINT) AS point_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, round(CAST(CAST(intensity AS FLOAT) AS DOUBLE), 6) + 0.0 AS intensity FROM pts""")
def q_point_arrays(spark, sf):
    """Points as chunked arrays, a chunk a task, and read back; a set without points stays empty."""
    folder = shared_folder(spark) + "/point-arrays"
    rows = pts(spark, sf).select(F.lit(0).alias("timepoint"), F.col("label").cast("int").alias("setup"), F.lit("beads").alias("label"), "x", "y", "z", "intensity")
    sets = rows.select("timepoint", "setup", "label").distinct().unionByName(rows.agg(F.lit(0).alias("timepoint"), (F.max("setup") + 1).alias("setup"), F.lit("beads").alias("label")))
    points.write_point_arrays(rows, folder, sets, chunk=64)
    found = points.read_point_arrays(sets.withColumn("uri", points.set_path(folder)))
    return found.select("setup", "point_id", *[r6(F.col(c), c) for c in ("x", "y", "z", "intensity")])


@query("SELECT DISTINCT CAST(l_partkey % 997 AS DOUBLE) AS x, CAST(l_suppkey % 89 AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS z, CAST(1 AS BIGINT) AS copies FROM lineitem")
def q_annotation_levels(spark, sf):
    """Annotations in levels of ever smaller cells, read back: every place stands in one level."""
    folder = shared_folder(spark) + "/annotations"
    rows = table(spark, sf, "lineitem").select((F.col("l_partkey") % 997).alias("x"), (F.col("l_suppkey") % 89).alias("y"), F.col("l_quantity").alias("z"))
    precomputed.write_annotations(rows, folder, (250.0, 90.0, 50.0), limit=2000)
    return precomputed.read_annotations(spark, folder).groupBy("x", "y", "z").agg(F.count("*").alias("copies"))
