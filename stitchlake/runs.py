"""Whole runs over a project: detection, matching, alignment and fusion, from descriptor and stores to stores.

A project is the tables of its descriptor. Each run reads what the one before has written to a store (point
sets as chunked arrays, correspondences as Parquet, the solved descriptor), so a run that was stopped starts
from the last finished store, and nothing but metadata (boxes of views, an error curve) reaches the driver.
Views are named ``<timepoint>_<setup>``.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .operators import detection, fusion, matching, solver, spatial
from .operators import transforms as T
from .sources import points as point_arrays
from .sources import project as descriptor
from .sources import store
from .sources.shared import discard, written

_AXES = range(3)
_BOX = [f"{c}{d}" for c in "lu" for d in _AXES]
_WORLD = ["wx", "wy", "wz"]


@dataclasses.dataclass
class Project:
    """The tables of a descriptor: files of views, setups, ordered transforms, and point sets."""

    views: DataFrame
    setups: DataFrame
    transforms: DataFrame
    sets: DataFrame


def load(spark: SparkSession, path: str) -> Project:
    """The project of a descriptor (or of a folder of them)."""
    return Project(descriptor.views(spark, path), descriptor.view_setups(spark, path), descriptor.view_transforms(spark, path), descriptor.point_sets(spark, path))


def save(project: Project, folder: str, name: str, base: str = ".") -> str:
    """Write the descriptor ``name``.xml below ``folder``; its path."""
    of = project.setups.select(F.col("id").alias("setup"), F.lit(name).alias("name"))
    descriptor.write_descriptors(project.views, project.setups, project.transforms, project.sets, of, folder, base)
    return f"{folder.rstrip('/')}/{name}.xml"


def view_key() -> Column:
    return F.concat_ws("_", "timepoint", "setup")


def models(project: Project) -> DataFrame:
    """view, timepoint, setup, m00..m23: each view's transforms as one model; identity without any."""
    found = project.transforms.groupBy("timepoint", "setup").agg(T.composed().alias("m"))
    rows = project.views.select("timepoint", "setup").distinct().join(found, ["timepoint", "setup"], "left").withColumn("m", F.coalesce("m", T.identity()))
    return rows.select(view_key().alias("view"), "timepoint", "setup", *[F.get("m", F.lit(i)).alias(n) for i, n in enumerate(G.NAMES)])


def world_boxes(project: Project) -> DataFrame:
    """The columns of ``models`` and l0..u2, the box of each view in the world; views without a size have none."""
    sized = models(project).join(project.setups.filter("size IS NOT NULL").select(F.col("id").alias("setup"), "size"), "setup")
    lo, hi = G.image_of_box(G.model(), [F.lit(0.0)] * 3, [(F.get("size", F.lit(d)) - 1).cast("double") for d in _AXES])
    return sized.select("view", "timepoint", "setup", "size", *G.NAMES, *[c.alias(n) for c, n in zip([*lo, *hi], _BOX, strict=True)])


def overlaps(project: Project) -> DataFrame:
    """a, b, l0..u2: pairs of views of one timepoint whose boxes meet, each once, and where they do."""
    boxes = world_boxes(project)
    wide = boxes.agg(F.max(F.greatest(F.col("u0") - F.col("l0"), F.col("u1") - F.col("l1")))).first()[0]
    side = lambda p: boxes.select(F.col("view").alias(p), F.col("timepoint").alias(f"{p}t"), *[F.col(c).alias(f"{p}{c}") for c in _BOX])
    corner = lambda p, c: [f"{p}{c}{d}" for d in _AXES]
    once = (F.col("a") < F.col("b")) & (F.col("at") == F.col("bt"))
    met = spatial.box_join(side("a"), side("b"), corner("a", "l"), corner("a", "u"), corner("b", "l"), corner("b", "u"), max(wide or 1.0, 1.0), once, touching=False)
    lo, hi = G.intersection(*[[F.col(n) for n in corner(p, c)] for p, c in (("a", "l"), ("a", "u"), ("b", "l"), ("b", "u"))])
    return met.select("a", "b", *[c.alias(n) for c, n in zip([*lo, *hi], _BOX, strict=True)])


def own_overlaps(project: Project) -> DataFrame:
    """view, l0..u2: where a view meets others, as boxes of its own voxels."""
    met = overlaps(project)
    both = met.select(F.col("a").alias("view"), *_BOX).unionByName(met.select(F.col("b").alias("view"), *_BOX)).join(models(project), "view")
    lo, hi = G.image_of_box(G.inverse(G.model()), [F.col(f"l{d}") for d in _AXES], [F.col(f"u{d}") for d in _AXES])
    return both.select("view", *[c.alias(n) for c, n in zip([*lo, *hi], _BOX, strict=True)])


def detect(project: Project, images: str, points: str, sigma: float, threshold: float, block: tuple[int, int, int] = (256, 256, 256), label: str = "beads", median_radius: int = 0, factor: tuple[int, int] = (1, 1), everywhere: bool = False) -> Project:
    """Write the interest points of every view as point sets below ``points``; the project with these sets. ``factor``
    is the downsampling (x and y, z). Only where views meet unless ``everywhere``: blocks that meet no overlap are
    not read. A view without points has an empty set."""
    files = project.views.join(project.setups.select(F.col("id").alias("setup"), "size"), "setup", "left")
    files = files.select(view_key().alias("view"), "timepoint", "setup", F.concat(F.lit(images.rstrip("/") + "/"), "file_path").alias("uri"), "size")
    by = (factor[0], factor[0], factor[1])
    wanted = detection.stored_blocks(files.select("view", "uri", "size"), "view", block, by)
    met = None if everywhere else written(own_overlaps(project), "overlaps")
    if met is not None:
        meets = [(F.col(f"u{d}") >= F.col(f"c{d}") * by[d]) & (F.col(f"l{d}") < F.col(f"e{d}") * by[d]) for d in _AXES]
        wanted = wanted.alias("w").join(met.alias("o"), (F.col("w.view") == F.col("o.view")) & meets[0] & meets[1] & meets[2], "left_semi")
    blocks = detection.read_stored(wanted, "view", detection.reach(sigma, median_radius), by)
    found = detection.upsampled(detection.detect_points(blocks, "view", sigma, threshold, median_radius), *factor)
    if met is not None:
        inside = G.contains_point([F.col(f"o.l{d}") for d in _AXES], [F.col(f"o.u{d}") for d in _AXES], [F.col(f"p.{a}") for a in "xyz"])
        found = found.alias("p").join(met.alias("o"), (F.col("p.view") == F.col("o.view")) & inside, "left_semi")
    sets = files.select("timepoint", "setup", F.lit(label).alias("label")).distinct()
    rows = found.join(files.select("view", "timepoint", "setup").distinct(), "view").withColumn("label", F.lit(label))
    point_arrays.write_point_arrays(rows, points, sets)
    discard(met)
    params = F.lit(f"DOG s={sigma} t={threshold} dsxy={factor[0]} dsz={factor[1]}")
    kept = project.sets.join(sets, ["timepoint", "setup", "label"], "left_anti")
    new = sets.select("timepoint", "setup", "label", params.alias("params"), F.format_string("tpId_%d_viewSetupId_%d/%s", "timepoint", "setup", "label").alias("path"))
    return dataclasses.replace(project, sets=kept.unionByName(new))


def world_points(project: Project, points: str) -> DataFrame:
    """view, label, point_id, wx, wy, wz of all points of the project's sets."""
    sets = project.sets.select("timepoint", "setup", "label").distinct()
    rows = point_arrays.read_point_arrays(sets.withColumn("uri", point_arrays.set_path(points))).join(models(project), ["timepoint", "setup"])
    return rows.select("view", "label", "point_id", *[c.alias(n) for c, n in zip(G.apply(G.model(), [F.col(a) for a in "xyz"]), _WORLD, strict=True)])


def match(project: Project, points: str, matches: str, radius: float = 100.0, significance: float = 3.0, neighbours: int = 3, kind: str = "rigid", trials: int = 10_000, epsilon: float = 10.0, least: int = 6, ratio: float = 0.1) -> None:
    """Write the correspondences of all pairs of views that meet: points of equal labels in the overlap, descriptors
    of their nearest neighbours, candidates by the ratio test, consensus a pair."""
    at = written(world_points(project, points), "points")
    pairs = overlaps(project).withColumn("pair", F.concat_ws("|", "a", "b"))

    def side(view: str) -> DataFrame:
        """The points of one side of each pair and label that lie in the overlap."""
        rows = at.join(pairs.select("pair", F.col(view).alias("view"), *_BOX), "view")
        inside = G.contains_point([F.col(f"l{d}") for d in _AXES], [F.col(f"u{d}") for d in _AXES], [F.col(c) for c in _WORLD])
        return written(rows.filter(inside).select(F.concat_ws("|", "pair", "label").alias("pair"), "view", "label", "point_id", *_WORLD), "side")

    a, b = side("a"), side("b")
    described = [matching.descriptors(s, "pair", "point_id", _WORLD, neighbours) for s in (a, b)]
    found = matching.candidates(*described, "pair", "point_id", radius, significance, 3 * neighbours).select("pair", "ia", "ib")
    place = lambda s, i, v, p: s.select("pair", F.col("point_id").alias(i), F.col("view").alias(v), "label", *[F.col(w).alias(f"{p}{x}") for w, x in zip(_WORLD, "xyz", strict=True)])
    rows = written(found.join(place(a, "ia", "view_a", "p"), ["pair", "ia"]).join(place(b, "ib", "view_b", "q").drop("label"), ["pair", "ib"]), "candidates")
    kept = matching.ransac(rows, "pair", "ia", kind, trials, epsilon, least, ratio).select("pair", "ia")
    good = rows.join(kept, ["pair", "ia"])
    store.write_correspondences(good.select("view_a", F.col("label").alias("label_a"), F.col("ia").alias("id_a"), "view_b", F.col("label").alias("label_b"), F.col("ib").alias("id_b")), matches)
    discard(at, a, b, rows)


def matched_points(project: Project, points: str, matches: str) -> DataFrame:
    """tile, other, px.., qx..: the stored correspondences of the project's views with both places in the world."""
    at = world_points(project, points)
    end = lambda s, p: at.select(F.col("view").alias(f"view_{s}"), F.col("label").alias(f"label_{s}"), F.col("point_id").alias(f"id_{s}"), *[F.col(w).alias(f"{p}{x}") for w, x in zip(_WORLD, "xyz", strict=True)])
    rows = store.read_correspondences(at.sparkSession, matches, schema=store.CORRESPONDENCES)
    rows = rows.join(end("a", "p"), ["view_a", "label_a", "id_a"]).join(end("b", "q"), ["view_b", "label_b", "id_b"])
    return rows.select(F.col("view_a").alias("tile"), F.col("view_b").alias("other"), *[f"{s}{x}" for s in "pq" for x in "xyz"])


def solve(project: Project, points: str, matches: str, fixed: str | None = None, kind: str = "rigid", iterations: int = 10_000, plateau: int = 200, name: str = "alignment") -> tuple[Project, list[float]]:
    """The project with a solved model before each view's transforms, and the error curve. The fixed view (the first of
    those with matches unless named) and views without matches keep their place."""
    rows = written(matched_points(project, points, matches), "matched")
    if fixed is None:
        order = F.struct(F.split("view", "_")[0].cast("long"), F.split("view", "_")[1].cast("long"))
        fixed = rows.select(F.explode(F.array("tile", "other")).alias("view")).agg(F.min_by("view", order)).first()[0]
    if fixed is None:
        return project, []
    start = solver.prealign(rows, fixed)
    found, errors = solver.relax(rows, [fixed], kind, iterations, plateau=plateau, start=start)
    solved = found.join(models(project).select(F.col("view").alias("tile"), "timepoint", "setup"), "tile").select("timepoint", "setup", F.array(*G.NAMES).alias("affine"))
    discard(start, rows)
    return dataclasses.replace(project, transforms=descriptor.with_models(project.transforms, solved, name)), errors


def fuse(project: Project, images: str, target: str, cell: tuple[int, int, int], levels: int = 1, blend: str = "weighted", kind: str = "<u2", channel: str | None = None) -> tuple[list[int], list[int]]:
    """Fuse the views (of one channel, if named) into the pyramid ``target``; its lower corner in the world, and its shape."""
    chosen = project if channel is None else dataclasses.replace(project, views=project.views.filter(F.col("channel") == channel))
    whole = world_boxes(chosen).agg(*[F.min(f"l{d}") for d in _AXES], *[F.max(f"u{d}") for d in _AXES]).first()
    if whole[0] is None:
        raise ValueError("no view of the project has a size")
    lower = [math.floor(whole[d]) for d in _AXES]
    shape = [math.ceil(whole[3 + d]) + 1 - lower[d] for d in _AXES]
    files = chosen.views.select(view_key().alias("view"), F.concat(F.lit(images.rstrip("/") + "/"), "file_path").alias("uri"))
    sized = models(chosen).join(files, "view").join(project.setups.select(F.col("id").alias("setup"), "size"), "setup", "left")
    tiles = sized.select(F.col("view").alias("tile"), "uri", "size", *G.NAMES)
    fusion.fuse_to_store(tiles, target, tuple(shape), cell, levels=levels, lower=tuple(lower), blend=blend, kind=kind)
    return lower, shape
