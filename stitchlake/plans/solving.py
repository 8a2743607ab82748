"""Fits, consensus and alignment (survey 2.7). SQL has no eigenvectors, so the fits are compared where the
answer is planted: points moved by known models must come back with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import runs
from ..functions import geometry as G
from ..operators import fit, layout, matching, solver, spatial
from ..sources import points
from ._base import PTS, TILES, matched, pts, query, r6, shared_folder, table, tiles

#: A quarter turn about z and a shift that grows with the label: exact in SQL.
_MOVED = f"""{PTS}, m AS (SELECT label AS pair, vec_id AS match_id, x AS px, y AS py, z AS pz, -y + label AS qx, x + 2 * label AS qy, z - 3 * label AS qz FROM pts)"""


def _moved(spark, sf):
    x, y, z, label = (F.col(c) for c in ("x", "y", "z", "label"))
    q = (-y + label, x + 2 * label, z - 3 * label)
    return pts(spark, sf).select(label.alias("pair"), F.col("vec_id").alias("match_id"), *[F.col(a).alias(f"p{a}") for a in "xyz"], *[v.alias(f"q{a}") for v, a in zip(q, "xyz", strict=True)])


_TURN = "0.0 AS m00, -1.0 AS m01, 0.0 AS m02, {x} AS m03, 1.0 AS m10, 0.0 AS m11, 0.0 AS m12, {y} AS m13, 0.0 AS m20, 0.0 AS m21, 1.0 AS m22, {z} AS m23"


@query(f"""WITH {_MOVED} SELECT pair, count(*) AS n, {_TURN.format(x='CAST(pair AS DOUBLE)', y='CAST(2 * pair AS DOUBLE)', z='CAST(-3 * pair AS DOUBLE) + 0.0')} FROM m GROUP BY pair HAVING count(*) >= 3""".replace("0.0 AS", "CAST(0 AS DOUBLE) AS").replace("1.0 AS", "CAST(1 AS DOUBLE) AS"))
def q_rigid_fit(spark, sf):
    """The turn and shift of each label's points."""
    m = fit.rigid_fit(fit.moments(_moved(spark, sf), ["pair"]), ["pair"])
    return m.select("pair", F.col("n").cast("long").alias("n"), *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in G.NAMES])


@query(f"""WITH {_MOVED}, g AS (SELECT pair, count(*) AS n, count(*) FILTER (WHERE match_id % 4 <> 3) AS good FROM m GROUP BY pair)
SELECT m.pair, m.match_id FROM m JOIN g USING (pair) WHERE m.match_id % 4 <> 3 AND good >= 6 AND good > 0.1 * n""")
def q_ransac(spark, sf):
    """Every fourth match of a label points elsewhere; the others are found by consensus of 10,000 trials."""
    m = _moved(spark, sf)
    far = lambda a, k: F.when(F.col("match_id") % 4 == 3, F.col(f"q{a}") + 5000 + F.col("match_id") * k % 977 * 40).otherwise(F.col(f"q{a}"))
    m = m.select("pair", "match_id", "px", "py", "pz", far("x", 31).alias("qx"), far("y", 57).alias("qy"), far("z", 83).alias("qz"))
    return matching.ransac(m, "pair", "match_id", "rigid", epsilon=5.0, least=6, ratio=0.1).select("pair", "match_id")


def _shifted(spark, sf):
    """Matches of a chain of tiles, each shifted against the one before."""
    p = pts(spark, sf)
    return p.select(F.col("label").alias("tile"), (F.col("label") + 1).alias("other"), *[F.col(a).alias(f"p{a}") for a in "xyz"], *[(F.col(a) - s).alias(f"q{a}") for a, s in zip("xyz", (90.0, -4.0, 2.5), strict=True)])


@query(f"""WITH {PTS}, t AS (SELECT DISTINCT label AS tile FROM pts UNION SELECT max(label) + 1 FROM pts)
SELECT tile, round(CAST(tile * 90.0 AS DOUBLE), 2) + 0.0 AS m03, round(CAST(tile * -4.0 AS DOUBLE), 2) + 0.0 AS m13, round(CAST(tile * 2.5 AS DOUBLE), 2) + 0.0 AS m23 FROM t""")
def q_relax(spark, sf):
    """A chain of tiles, each shifted against the one before; alignment to the plateau puts them in place."""
    m = _shifted(spark, sf)
    models, _ = solver.relax(m, [0], plateau=5, start=solver.prealign(m, 0))
    return models.select("tile", *[(F.round(n, 2) + F.lit(0.0)).alias(n) for n in ("m03", "m13", "m23")])


@query()
def q_ransac_noise(spark, sf):
    """Consensus on matches that no model explains: rows only."""
    found = matching.ransac(matched(spark, sf), "pair", "match_id", "rigid", epsilon=150.0, least=6, ratio=0.1)
    return found.select("pair", "match_id", r6(F.col("error"), "error"))


@query(f"""WITH {PTS}, e AS (SELECT DISTINCT label AS tile FROM pts WHERE label % 2 = 0), g AS (SELECT tile FROM e UNION SELECT tile + 1 FROM e)
SELECT tile, round(CAST(tile * 90.0 AS DOUBLE), 1) + 0.0 AS m03, round(CAST(tile * -4.0 AS DOUBLE), 1) + 0.0 AS m13, round(CAST(tile * 2.5 AS DOUBLE), 1) + 0.0 AS m23 FROM g""")
def q_two_rounds(spark, sf):
    """Pairs of tiles aligned by strong matches; then the pairs against the first by the weak ones between them."""
    p = pts(spark, sf)
    shift = [(F.col("label") - 1) * s for s in (90.0, -4.0, 2.5)]
    far = [(F.col(a) + s).alias(f"p{a}") for a, s in zip("xyz", shift, strict=True)]
    weak = p.filter("label % 2 = 0 AND label > 0").select(F.lit(1).cast("long").alias("tile"), F.col("label").cast("long").alias("other"), *far, *[F.col(a).alias(f"q{a}") for a in "xyz"])
    models, _ = solver.two_rounds(_shifted(spark, sf).filter("tile % 2 = 0"), weak, 0, plateau=2)
    return models.select("tile", *[(F.round(n, 1) + F.lit(0.0)).alias(n) for n in ("m03", "m13", "m23")])


@query("""WITH RECURSIVE g AS (SELECT DISTINCT o_orderkey % 40 AS "group", o_custkey % 997 AS view FROM orders),
e AS (SELECT DISTINCT a."group" AS a, b."group" AS b FROM g a JOIN g b USING (view)), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a AS "group", min(b) AS least FROM r GROUP BY a)
SELECT DISTINCT view, least AS "group" FROM g JOIN c USING ("group")""")
def q_merged_groups(spark, sf):
    """Groups of views that share one become one."""
    rows = table(spark, sf, "orders").select((F.col("o_orderkey") % 40).alias("group"), (F.col("o_custkey") % 997).alias("view"))
    return solver.merged_groups(rows)


@query()
def q_synthetic_points(spark, sf):
    """Points in the overlaps of neighbouring tiles that keep their distance from those of earlier overlaps."""
    t = tiles(spark, sf)
    side = lambda p: t.select(F.col("k").alias(p), *[F.col(f"{c}{d}").alias(f"{p}{c}{d}") for c in "lu" for d in range(3)])
    found = spatial.box_join(side("a"), side("b"), [f"al{d}" for d in range(3)], [f"au{d}" for d in range(3)], [f"bl{d}" for d in range(3)], [f"bu{d}" for d in range(3)], 120.0, F.col("b") < F.col("a"), touching=False)
    lower, upper = (F.array(*[f(f"a{c}{d}", f"b{c}{d}") for d in range(3)]) for c, f in (("l", F.greatest), ("u", F.least)))
    overlaps = found.select((F.col("a") * 1_000_000 + F.col("b")).alias("k"), "a", "b", lower.alias("lower"), upper.alias("upper"))
    kept = layout.without_crowded(layout.synthetic_points(overlaps, "k", 100.0, 5, 30, 2.0), "k", 20.0)
    return kept.select("k", "i", "a", "b", *[r6(F.col(c), c) for c in ("px", "py", "pz", "qx", "qy", "qz")])


@query(f"""WITH {PTS}, {TILES} SELECT vec_id, k AS new_id, round(x - l0, 6) + 0.0 AS x, round(y - l1, 6) + 0.0 AS y, round(z - l2, 6) + 0.0 AS z FROM pts JOIN tiles ON grp % 10 = label AND x BETWEEN l0 AND u0 AND y BETWEEN l1 AND u1 AND z BETWEEN l2 AND u2""")
def q_points_in_parts(spark, sf):
    """The points of each view in the parts that contain them, in a part's own coordinates."""
    box = lambda c: F.array(*[F.col(f"{c}{d}") for d in range(3)])
    parts = tiles(spark, sf).select((F.col("grp") % 10).alias("id"), F.col("k").alias("new_id"), box("l").alias("lower"), box("u").alias("upper"))
    p = pts(spark, sf).select("vec_id", F.col("label").alias("setup"), "x", "y", "z")
    found = layout.points_in_parts(p, parts)
    return found.select("vec_id", "new_id", *[r6(F.col(a), a) for a in "xyz"])


#: How far the two labels of neighbours lie apart, and where the first view begins.
_APART = 10_000.0


@query(f"""WITH {PTS}, v AS (SELECT DISTINCT label % 4 AS setup FROM pts UNION SELECT max(label % 4) + 1 FROM pts)
SELECT setup::INT AS setup, round(CAST(setup * 3.0 AS DOUBLE), 2) + 0.0 AS x, round(CAST(setup * -2.0 AS DOUBLE), 2) + 0.0 AS y, round(CAST(setup * 1.0 AS DOUBLE), 2) + 0.0 AS z FROM v""")
def q_aligned_views(spark, sf):
    """A project from its descriptor to its solved models: views l and l + 1 both hold the points whose label is l modulo 4, and each
    view stands beside its place. Points are stored, matched and aligned; the solved descriptor is written and read."""
    p = pts(spark, sf).withColumn("label", F.col("label") % 4)
    seen = p.withColumn("setup", F.explode(F.array(F.col("label"), F.col("label") + 1))).withColumn("setup", F.col("setup").cast("int"))
    beside = [F.col("setup") * s for s in (3.0, -2.0, 1.0)]
    # a view's voxels begin half a step before the first of its labels
    local = [F.col("x") + F.lit(_APART) * (F.col("label") - F.col("setup") + 1.5) - beside[0], F.col("y") + F.lit(_APART / 2) - beside[1], F.col("z") + F.lit(_APART / 2) - beside[2]]
    rows = seen.select(F.lit(0).alias("timepoint"), "setup", F.lit("beads").alias("label"), *[c.alias(a) for c, a in zip(local, "xyz", strict=True)], "intensity")
    ids = rows.select("setup").distinct()
    views = ids.select(F.lit(0).alias("timepoint"), "setup", F.lit(0).alias("series"), F.lit("0").alias("channel"), F.concat(F.lit("v"), "setup").alias("file_path"))
    size = F.array(*[F.lit(int(n)) for n in (2 * _APART, _APART, _APART)])
    setups = ids.select(F.col("setup").alias("id"), F.concat(F.lit("v"), "setup").alias("name"), size.alias("size"), F.lit("um").alias("voxel_unit"), F.array(*[F.lit(1.0)] * 3).alias("voxel_size"), F.create_map(F.lit("tile"), F.col("setup").cast("string")).alias("attributes"))
    place = F.array(*[F.lit(float(i % 5 == 0)) if i % 4 < 3 else (F.lit(_APART) * (F.col("setup") - 1.5) if i == 3 else F.lit(-_APART / 2)) for i in range(12)])
    lists = ids.select(F.lit(0).alias("timepoint"), "setup", F.lit(0).alias("seq"), F.lit("affine").alias("type"), F.lit("grid").alias("name"), place.alias("affine"))
    sets = ids.select(F.lit(0).alias("timepoint"), "setup", F.lit("beads").alias("label"), F.lit("").alias("params"), F.concat(F.lit("v"), "setup").alias("path"))
    folder = shared_folder(spark)
    points.write_point_arrays(rows, f"{folder}/points")
    project = runs.load(spark, runs.save(runs.Project(views, setups, lists, sets), f"{folder}/xml", "start"))
    runs.match(project, f"{folder}/points", f"{folder}/matches", radius=500.0, significance=2.0, trials=200, epsilon=1.0, least=3)
    solved, _ = runs.solve(project, f"{folder}/points", f"{folder}/matches", plateau=2)
    again = runs.load(spark, runs.save(solved, f"{folder}/solved", "solved"))
    return again.transforms.filter("seq = 0").select("setup", *[(F.round(F.get("affine", F.lit(i)), 2) + F.lit(0.0)).alias(a) for i, a in zip((3, 7, 11), "xyz", strict=True)])
