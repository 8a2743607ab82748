"""Projections, scalar geometry, predicates and text scans (survey 2.1, 2.2)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import graph, layout, ordered, viewer
from ..operators import transforms as T
from ._base import BOXES, EVT, PTS, TILES, boxes, evt, pts, query, r6, table, tiles

M = [1.0, 0.1, 0.0, 5.0, 0.0, 1.0, 0.2, -3.0, 0.1, 0.0, 1.0, 7.0]


def _apply_sql(m, x="x", y="y", z="z"):
    return [f"({m[4 * r]} * {x} + {m[4 * r + 1]} * {y} + {m[4 * r + 2]} * {z} + {m[4 * r + 3]})" for r in range(3)]


_T = _apply_sql(M)


@query(f"WITH {PTS} SELECT vec_id, round({_T[0]}, 6) + 0.0 AS tx, round({_T[1]}, 6) + 0.0 AS ty, round({_T[2]}, 6) + 0.0 AS tz FROM pts")
def q_affine_apply(spark, sf):
    t = G.apply(M, [F.col(a) for a in "xyz"])
    return pts(spark, sf).select("vec_id", *[r6(v, f"t{a}") for v, a in zip(t, "xyz", strict=True)])


@query("""
WITH RECURSIVE t AS (SELECT s_nationkey AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r,
  1 + (s_suppkey % 3) * 0.25 AS s, CAST(s_suppkey % 7 AS DOUBLE) AS x, CAST(s_suppkey % 5 AS DOUBLE) AS y, CAST(s_suppkey % 3 AS DOUBLE) AS z FROM supplier),
c AS (SELECT v, r, CAST(s AS DOUBLE) AS s, x, y, z FROM t WHERE r = 1
  UNION ALL SELECT t.v, t.r, c.s * t.s, c.s * t.x + c.x, c.s * t.y + c.y, c.s * t.z + c.z FROM c JOIN t ON t.v = c.v AND t.r = c.r + 1)
SELECT v AS view_id, round(max_by(s, r), 6) AS m00, round(max_by(x, r), 6) AS m03, round(max_by(y, r), 6) AS m13, round(max_by(z, r), 6) AS m23 FROM c GROUP BY v""")
def q_affine_compose(spark, sf):
    k = F.col("s_suppkey")
    s = 1 + (k % 3) * 0.25
    zero = F.lit(0.0)
    m = F.array(*[v.cast("double") for v in (s, zero, zero, k % 7, zero, s, zero, k % 5, zero, zero, s, k % 3)])
    lists = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("view_id")).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), m.alias("m")))).alias("t"))
    out = lists.select("view_id", G.compose_all(F.transform("t", lambda x: x["m"])).alias("m"))
    return out.select("view_id", *[r6(F.get("m", F.lit(4 * r + c)), f"m{r}{c}") for r, c in ((0, 0), (0, 3), (1, 3), (2, 3))])


def _kinds(k):
    """Models that do not commute, by a key: a stretch, a quarter turn, a shear with a mirrored axis."""
    n = lambda v: F.lit(float(v))
    d = lambda v: v.cast("double")
    stretch = [d(1 + k % 5 * 0.25), n(0), n(0), d(k % 7), n(0), n(1), n(0), d(k % 3), n(0), n(0), d(0.5 + k % 2), n(1)]
    turn = [n(0), n(-1), n(0), n(1), n(1), n(0), n(0), n(0), n(0), n(0), n(1), d(k % 2)]
    shear = [n(1), n(0), n(0.5), d(k % 4), n(0), n(1), n(0), n(2), n(0), n(0), n(-1), n(0)]
    return F.array(*[F.when(k % 3 == 0, x).when(k % 3 == 1, y).otherwise(z) for x, y, z in zip(stretch, turn, shear, strict=True)])


_AT = [f"m{r}{c}" for r in range(3) for c in range(4)]


def _kinds_sql(k: str) -> str:
    """The same models as columns m00..m23."""
    stretch = [f"1 + {k} % 5 * 0.25", "0", "0", f"{k} % 7", "0", "1", "0", f"{k} % 3", "0", "0", f"0.5 + {k} % 2", "1"]
    turn = ["0", "-1", "0", "1", "1", "0", "0", "0", "0", "0", "1", f"{k} % 2"]
    shear = ["1", "0", "0.5", f"{k} % 4", "0", "1", "0", "2", "0", "0", "-1", "0"]
    return ", ".join(f"CAST(CASE {k} % 3 WHEN 0 THEN {x} WHEN 1 THEN {y} ELSE {z} END AS DOUBLE) AS {n}" for n, x, y, z in zip(_AT, stretch, turn, shear, strict=True))


def _product_sql(a: str, b: str, linear: bool = False) -> str:
    def at(r, c):
        terms = [f"{a}.m{r}{i} * {b}.m{i}{c}" for i in range(3)]
        if c == 3:
            terms = [f"{a}.m{r}3 + {b}.m{r}3"] if linear else [*terms, f"{a}.m{r}3"]
        return " + ".join(terms)

    return ", ".join(f"{at(r, c)} AS m{r}{c}" for r in range(3) for c in range(4))


def _chain_sql(name: str, rows: str, linear: bool = False) -> str:
    """CTEs ``name``: the ordered product of the models of every v in ``rows`` (v, seq, m00..)."""
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY seq) AS r FROM ({rows})),
{name}_c AS (SELECT v, r, {', '.join(_AT)} FROM {name}_r WHERE r = 1
  UNION ALL SELECT b.v, b.r, {_product_sql('a', 'b', linear)} FROM {name}_c a JOIN {name}_r b ON a.v = b.v AND b.r = a.r + 1),
{name} AS (SELECT v, {', '.join(f'max_by({n}, r) AS {n}' for n in _AT)} FROM {name}_c GROUP BY v)"""


_ORDERS = f"o AS (SELECT o_custkey AS v, o_orderkey AS seq, o_orderstatus AS kind, {_kinds_sql('o_orderkey')} FROM orders), e AS (SELECT {', '.join(f'CAST({float(v)} AS DOUBLE) AS {n}' for n, v in zip(_AT, G.IDENTITY, strict=True))})"
_OUT = ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in _AT)


def _or_identity(name: str) -> str:
    return f"(SELECT u.v, {', '.join(f'coalesce(x.{n}, e.{n}) AS {n}' for n in _AT)} FROM (SELECT DISTINCT v FROM o) u CROSS JOIN e LEFT JOIN {name} x ON x.v = u.v)"


def _orders(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("view_id"), k.alias("seq"), F.col("o_orderstatus").alias("kind"), _kinds(k).alias("affine"))


def _numbers(df):
    return df.select("view_id", *[r6(F.get("affine", F.lit(i)), n) for i, n in enumerate(_AT)])


def _last_sql(kind: str) -> str:
    return f"SELECT v, {', '.join(f'max_by({n}, seq) AS {n}' for n in _AT)} FROM o WHERE kind = '{kind}' GROUP BY v"


@query(f"""WITH {_ORDERS}, lr AS ({_last_sql('O')}), lc AS ({_last_sql('F')}), a AS {_or_identity('lr')}, b AS {_or_identity('lc')},
p AS (SELECT a.v, {_product_sql('a', 'b')} FROM a JOIN b ON a.v = b.v)
SELECT v AS view_id, {_OUT} FROM p""")
def q_calibration_rotation(spark, sf):
    """The last rotation times the last calibration of a view."""
    return _numbers(T.rotation_after_calibration(_orders(spark, sf), ["view_id"], F.col("kind") == "F", F.col("kind") == "O"))


@query(f"""WITH RECURSIVE {_ORDERS}, {_chain_sql('rot', "SELECT * FROM o WHERE kind = 'O'")}, {_chain_sql('grid', "SELECT * FROM o WHERE kind = 'F'")},
a AS {_or_identity('rot')}, b AS {_or_identity('grid')}, p AS (SELECT a.v, {_product_sql('a', 'b')} FROM a JOIN b ON a.v = b.v)
SELECT v AS view_id, {_OUT} FROM p""")
def q_solver_transform(spark, sf):
    """All rotations of a view in order, times all its moves to the nominal grid in order."""
    return _numbers(T.rotations_after_grid(_orders(spark, sf), ["view_id"], F.col("kind") == "O", F.col("kind") == "F"))


@query(f"""WITH RECURSIVE {_ORDERS}, {_chain_sql('whole', "SELECT * FROM o")} SELECT v AS view_id, {_OUT} FROM whole""")
def q_transform_chain(spark, sf):
    """All models of a view in order."""
    return _numbers(_orders(spark, sf).groupBy("view_id").agg(T.composed().alias("affine")))


def _supplier_model(k):
    one = F.lit(1.0)
    return [v.cast("double") for v in (2 + k % 3, one * 0.5, one * 0.1, k % 7, one * 0.2, 1 + k % 2, one * 0.3, k % 5, one * 0.1, one * 0.4, 3 - k % 2, k % 3)]


_SUP = """sup AS (SELECT s_suppkey AS k, CAST(2 + s_suppkey % 3 AS DOUBLE) AS a, 0.5::DOUBLE AS b, 0.1::DOUBLE AS c, CAST(s_suppkey % 7 AS DOUBLE) AS x, 0.2::DOUBLE AS d, CAST(1 + s_suppkey % 2 AS DOUBLE) AS e,
  0.3::DOUBLE AS f, CAST(s_suppkey % 5 AS DOUBLE) AS y, 0.1::DOUBLE AS g, 0.4::DOUBLE AS h, CAST(3 - s_suppkey % 2 AS DOUBLE) AS i, CAST(s_suppkey % 3 AS DOUBLE) AS z FROM supplier)"""


@query(f"""WITH {_SUP}, q AS (SELECT *, a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g) AS det FROM sup),
r AS (SELECT k, x, y, z, (e * i - f * h) / det AS r0, (c * h - b * i) / det AS r1, (b * f - c * e) / det AS r2, (f * g - d * i) / det AS r3, (a * i - c * g) / det AS r4, (c * d - a * f) / det AS r5,
  (d * h - e * g) / det AS r6, (b * g - a * h) / det AS r7, (a * e - b * d) / det AS r8 FROM q)
SELECT k, round(r0, 6) + 0.0 AS m00, round(r1, 6) + 0.0 AS m01, round(r2, 6) + 0.0 AS m02, round(-(r0 * x + r1 * y + r2 * z), 6) + 0.0 AS m03, round(r3, 6) + 0.0 AS m10, round(r4, 6) + 0.0 AS m11,
  round(r5, 6) + 0.0 AS m12, round(-(r3 * x + r4 * y + r5 * z), 6) + 0.0 AS m13, round(r6, 6) + 0.0 AS m20, round(r7, 6) + 0.0 AS m21, round(r8, 6) + 0.0 AS m22, round(-(r6 * x + r7 * y + r8 * z), 6) + 0.0 AS m23 FROM r""")
def q_affine_inverse(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("k"), *[r6(v, n) for v, n in zip(G.inverse(_supplier_model(k)), G.NAMES, strict=True)])


@query(f"""WITH {_SUP} SELECT k, round(1.0 * a + 0.1 * d + 0.0 * g, 6) + 0.0 AS m00, round(1.0 * e + 0.2 * h, 6) + 0.0 AS m11, round(1.0 * x + 0.1 * y + 5, 6) + 0.0 AS m03,
  round(1.0 * y + 0.2 * z - 3, 6) + 0.0 AS m13, round(0.1 * x + 1.0 * z + 7, 6) + 0.0 AS m23 FROM sup""")
def q_affine_concat(spark, sf):
    k = F.col("s_suppkey")
    out = dict(zip(G.NAMES, G.compose(M, _supplier_model(k)), strict=True))
    return table(spark, sf, "supplier").select(k.alias("k"), *[r6(out[n], n) for n in ("m00", "m11", "m03", "m13", "m23")])


@query(f"WITH {_SUP} SELECT k, round(0.9 * a + 0.1 * 1.0, 6) AS m00, round(0.9 * b, 6) AS m01, round(0.9 * x, 6) + 0.0 AS m03, round(0.9 * i + 0.1 * 1.0, 6) AS m22 FROM sup")
def q_model_blend(spark, sf):
    k = F.col("s_suppkey")
    out = dict(zip(G.NAMES, G.blend(_supplier_model(k), G.IDENTITY, 0.1), strict=True))
    return table(spark, sf, "supplier").select(k.alias("k"), *[r6(out[n], n) for n in ("m00", "m01", "m03", "m22")])


_LO = [f"({M[4 * r + 3]}{''.join(f' + least({M[4 * r + c]} * l{c}, {M[4 * r + c]} * u{c})' for c in range(3))})" for r in range(3)]
_HI = [f"({M[4 * r + 3]}{''.join(f' + greatest({M[4 * r + c]} * l{c}, {M[4 * r + c]} * u{c})' for c in range(3))})" for r in range(3)]


@query(f"WITH {TILES} SELECT k, {', '.join(f'round({_LO[d]}::DOUBLE, 6) + 0.0 AS lo{d}, round({_HI[d]}::DOUBLE, 6) + 0.0 AS hi{d}, CAST(round_even({_LO[d]}::DOUBLE, 0) - 1 AS BIGINT) AS plo{d}, CAST(round_even({_HI[d]}::DOUBLE, 0) + 1 AS BIGINT) AS phi{d}' for d in range(3))} FROM tiles")
def q_aabb(spark, sf):
    lo, hi = G.image_of_box(M, [F.col(f"l{d}") for d in range(3)], [F.col(f"u{d}") for d in range(3)])
    plo, phi = G.padded(lo, hi)
    return tiles(spark, sf).select("k", *[c for d in range(3) for c in (r6(lo[d], f"lo{d}"), r6(hi[d], f"hi{d}"), plo[d].alias(f"plo{d}"), phi[d].alias(f"phi{d}"))])


@query(f"""WITH {TILES} SELECT a.k AS ka, b.k AS kb, {', '.join(f'greatest(a.l{d}, b.l{d}) AS l{d}, least(a.u{d}, b.u{d}) AS u{d}' for d in range(3))}
FROM tiles a JOIN tiles b ON a.grp = b.grp AND a.k < b.k""")
def q_box_intersect(spark, sf):
    c = lambda p: [F.col(f"{p}{d}") for d in range(3)]
    lo, hi = G.intersection(c("a_l"), c("a_u"), c("b_l"), c("b_u"))
    found = graph.pairs_in_groups(tiles(spark, sf), "grp", "k")
    return found.select(F.col("a_k").alias("ka"), F.col("b_k").alias("kb"), *[x for d in range(3) for x in (lo[d].alias(f"l{d}"), hi[d].alias(f"u{d}"))])


@query(f"""WITH {TILES} SELECT k, CASE WHEN l0 = 0 THEN u0 + 1 ELSE u0 - l0 END AS span0, (u0 - l0 + 1) * (u1 - l1 + 1) * (u2 - l2 + 1) AS voxels,
  (l0 <= 300 AND 200 <= u0 AND l1 <= 300 AND 200 <= u1) AS closed, (l0 < 300 AND 200 < u0 AND l1 < 300 AND 200 < u1) AS strict, (l0 >= 100 AND u0 <= 500 AND l1 >= 0 AND u1 <= 700) AS inside,
  max((u0 - l0 + 1) * (u1 - l1 + 1) * (u2 - l2 + 1)) OVER () AS largest FROM tiles""")
def q_box_measures(spark, sf):
    t = tiles(spark, sf)
    l, u = [F.col(f"l{d}") for d in range(3)], [F.col(f"u{d}") for d in range(3)]
    lit = lambda *v: [F.lit(x) for x in v]
    out = t.select(
        "k", G.span(l[0], u[0]).alias("span0"), G.voxels(l, u).alias("voxels"),
        G.overlaps(l[:2], u[:2], lit(200, 200), lit(300, 300)).alias("closed"),
        G.overlaps(l[:2], u[:2], lit(200, 200), lit(300, 300), touching=False).alias("strict"),
        G.contains_box(lit(100, 0), lit(500, 700), l[:2], u[:2]).alias("inside"),
    )
    return out.join(F.broadcast(out.agg(F.max("voxels").alias("largest"))))


@query(f"WITH {EVT} SELECT event_id, (x BETWEEN 10 AND 100 AND y BETWEEN 6 AND 18 AND z BETWEEN 5 AND 20) AS inside FROM evt")
def q_point_in_box(spark, sf):
    lit = lambda *v: [F.lit(x) for x in v]
    return evt(spark, sf).select("event_id", G.contains_point(lit(10, 6, 5), lit(100, 18, 20), [F.col(a) for a in "xyz"]).alias("inside"))


@query(f"WITH {PTS} SELECT vec_id, round(4.0 * x + 1.5, 6) + 0.0 AS hx, round(4.0 * y + 1.5, 6) + 0.0 AS hy, round(4.0 * z + 1.5, 6) + 0.0 AS hz FROM pts")
def q_half_pixel(spark, sf):
    t = G.apply(G.half_pixel(4.0), [F.col(a) for a in "xyz"])
    return pts(spark, sf).select("vec_id", *[r6(v, f"h{a}") for v, a in zip(t, "xyz", strict=True)])


@query(f"WITH {PTS} SELECT vec_id, round({math.tan(math.radians(45.0))!r} * x + z, 6) + 0.0 AS sz FROM pts")
def q_shear(spark, sf):
    return pts(spark, sf).select("vec_id", r6(G.apply(G.shear(45.0), [F.col(a) for a in "xyz"])[2], "sz"))


@query(f"WITH {PTS} SELECT vec_id, round(x * 16 + 100, 6) + 0.0 AS ux, round(y * 16 + 200, 6) + 0.0 AS uy, round(z * 4 + 50, 6) + 0.0 AS uz FROM pts")
def q_coord_shift(spark, sf):
    m = [16.0, 0.0, 0.0, 100.0, 0.0, 16.0, 0.0, 200.0, 0.0, 0.0, 4.0, 50.0]
    return pts(spark, sf).select("vec_id", *[r6(v, f"u{a}") for v, a in zip(G.apply(m, [F.col(a) for a in "xyz"]), "xyz", strict=True)])


@query(f"WITH {BOXES} SELECT k, level, round(0.5 * (pow(2, level) - 1), 6) AS shift FROM (SELECT k, unnest(generate_series(0, CAST(floor(log2(greatest(n, 1)) + 1e-9) AS BIGINT)))::INT AS level FROM boxes)")
def q_origin_shift(spark, sf):
    """Origin of each pyramid level of every box: half a voxel of every coarser step added up."""
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.col("n"), F.lit(1))) + 1e-9).cast("int"))
    lv = boxes(spark, sf).select("k", F.explode(levels).alias("level"))
    return lv.select("k", "level", r6(G.origin_shift(F.col("level")), "shift"))


@query(f"""WITH {BOXES} SELECT k, CAST(least(floor(log2(greatest(n, 1)) + 1e-9), floor(log2(greatest(n // 2, 1)) + 1e-9), 7) AS INTEGER) AS level,
  CAST(ceil(n / 8.0) AS BIGINT) AS third FROM boxes""")
def q_pyramid_dims(spark, sf):
    n = F.col("n")
    return boxes(spark, sf).select("k", G.pyramid_level(n, F.floor(n / 2)).alias("level"), G.halved(n, F.lit(3)).alias("third"))


@query(f"WITH {EVT}, r AS (SELECT view_id, min(x) AS lo, max(x) AS hi FROM evt GROUP BY view_id) SELECT event_id, round((x - lo) / nullif(hi - lo, 0), 6) AS v FROM evt JOIN r USING (view_id)")
def q_normalize(spark, sf):
    e = evt(spark, sf)
    r = e.groupBy("view_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return e.join(r, "view_id").select("event_id", r6(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), "v"))


@query(f"WITH {BOXES} SELECT k, i, round((1 + n / 10.0) * pow(2, i / 4.0), 6) AS sigma, round(sqrt(pow((1 + n / 10.0) * pow(2, i / 4.0), 2) - 0.25), 6) AS applied FROM boxes, (SELECT unnest(generate_series(0, 3))::INT AS i)")
def q_sigmas(spark, sf):
    """The ladder of filter widths that begins with each box's own."""
    s = (1 + F.col("n") / 10.0) * F.pow(F.lit(2.0), F.col("i") / 4.0)
    rows = boxes(spark, sf).select("k", "n", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    return rows.select("k", "i", r6(s, "sigma"), r6(F.sqrt(s * s - 0.25), "applied"))


@query(f"WITH {BOXES} SELECT k, CAST(ceil(n / 64.0) * 64 AS BIGINT) AS target, CAST(ceil(price / 64.0) * 64 AS BIGINT) AS overlap FROM boxes")
def q_grid_round(spark, sf):
    return boxes(spark, sf).select("k", G.round_up(F.col("n"), 64).alias("target"), G.round_up(F.col("price"), 64).alias("overlap"))


@query(f"WITH {BOXES} SELECT k, 4 + (n * 3 - 2 * 12 - 4) % 12 AS last FROM boxes")
def q_last_tile_size(spark, sf):
    return boxes(spark, sf).select("k", G.last_tile(F.col("n") * 3, F.lit(16), F.lit(4)).alias("last"))


@query(f"""WITH RECURSIVE o AS (SELECT s_nationkey AS v, s_suppkey AS seq, {_kinds_sql('s_suppkey')} FROM supplier), {_chain_sql('whole', "SELECT * FROM o", True)} SELECT v AS view_id, {_OUT} FROM whole""")
def q_net_transform(spark, sf):
    """Product of the linear parts in order with the sum of the translations."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("view_id"), k.alias("seq"), _kinds(k).alias("affine"))
    return _numbers(T.net(s, ["view_id"]))


@query(f"WITH {_SUP} SELECT k, i AS e00, h AS e01, z AS e05, c AS e20, x AS e25 FROM sup")
def q_matrix_embed(spark, sf):
    """3 x 4 model with axes reversed, as the last rows of a 5 x 6 viewer matrix."""
    k = F.col("s_suppkey")
    m = _supplier_model(k)
    order = [2, 1, 0]
    rows = [[m[4 * order[r] + order[c]] for c in range(3)] + [m[4 * order[r] + 3]] for r in range(3)]
    zero, one = F.lit(0.0), F.lit(1.0)
    embed = F.array(*[F.array(*[one if c == r else zero for c in range(6)]) for r in range(2)], *[F.array(zero, zero, *row) for row in rows])
    at = lambda r, c: F.get(F.get("e", F.lit(r + 2)), F.lit(c))
    return table(spark, sf, "supplier").select(k.alias("k"), embed.alias("e")).select("k", at(0, 2).alias("e00"), at(0, 3).alias("e01"), at(0, 5).alias("e05"), at(2, 2).alias("e20"), at(2, 5).alias("e25"))


@query(f"""WITH {BOXES}, b AS (SELECT * FROM (VALUES {', '.join(f"({a}, {c})" for a, c in viewer.WAVELENGTH_COLOURS)}) t(upper, colour)), w AS (SELECT k, 380 + n * 8 AS nm FROM boxes)
SELECT k, CAST(coalesce((SELECT arg_min(colour, upper) FROM b WHERE b.upper > w.nm), {viewer.WAVELENGTH_COLOURS[-1][1]}) AS BIGINT) AS colour FROM w""")
def q_bucket_lookup(spark, sf):
    """Colour of a wavelength."""
    return boxes(spark, sf).select("k", viewer.wavelength_colour(380 + F.col("n") * 8).alias("colour"))


_UNITS = ["nanometer", "um", "millimeters", "second", "ms", "microns", "inch"]


@query(f"""WITH {BOXES}, u AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{u}', {viewer.unit_factor(u)}, '{viewer.unit_base(u)}')" for i, u in enumerate(_UNITS))}) t(i, unit, factor, base))
SELECT k, unit, round(n * factor::DOUBLE * 1e6, 6) AS micro, base FROM boxes JOIN u ON k % {len(_UNITS)} = i""")
def q_unit_lookup(spark, sf):
    """Sizes in metres or seconds."""
    unit = F.element_at(F.array(*[F.lit(u) for u in _UNITS]), (F.col("k") % len(_UNITS) + 1).cast("int"))
    value, base = viewer.in_base_unit(F.col("n"), F.col("unit"))
    return boxes(spark, sf).withColumn("unit", unit).select("k", "unit", r6(value * 1e6, "micro"), base.alias("base"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS key FROM pages""")
def q_url_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(u, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(u, "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract(u, "^[a-z]+://[^/]+/([^?#]*)", 1).alias("key"))


@query("SELECT s_suppkey AS k, 'timepoint: ' || s_nationkey || ', setup: ' || s_suppkey AS view_key, s_nationkey AS timepoint, CAST(s_suppkey AS INTEGER) AS setup FROM supplier")
def q_view_key(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.format_string("timepoint: %d, setup: %d", "s_nationkey", "s_suppkey").alias("view_key"))
    part = lambda i: F.regexp_extract("view_key", r"timepoint: (\d+), setup: (\d+)", i).cast("int")
    return s.select("k", "view_key", part(1).alias("timepoint"), part(2).alias("setup"))


@query("SELECT s_suppkey AS k, CAST(s_nationkey AS VARCHAR) AS channel, 'tile_' || s_suppkey || '_ch_561.ome.zarr' AS other FROM supplier")
def q_channel_regex(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.format_string("tile_%d_ch_%d.ome.zarr", "s_suppkey", "s_nationkey").alias("path"))
    return s.select("k", F.regexp_extract("path", r"_ch_(.*?)\.ome\.zarr", 1).alias("channel"), F.regexp_replace("path", r"_ch_\d+(?=\.ome)", "_ch_561").alias("other"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS worker FROM orders")
def q_round_robin(spark, sf):
    """index mod 7 over the sorted keys: ranks within key buckets plus the sizes of earlier ones."""
    return ordered.round_robin(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7)


_LENGTH, _TARGET, _OVERLAP, _STEP = "200 + n * 37", 512, 64, 64


# the sizes of each distinct length are tried once; sizes that grow from a target end at the first whose last tile
# is no shorter than the one before, sizes that shrink at the last that is still longer
@query(f"""WITH {BOXES}, b AS (SELECT k, {_LENGTH} AS l FROM boxes), d AS (SELECT DISTINCT l FROM b),
f AS (SELECT l, s, CASE WHEN o + r < 0 THEN l + o + r ELSE o + r END AS last FROM (SELECT *, (l - 2 * (s - o) - o) - (s - o) * CAST(trunc((l - 2 * (s - o) - o) / (s - o)) AS BIGINT) AS r
  FROM d, (SELECT unnest(generate_series({_OVERLAP + _STEP}, 4096, {_STEP})) AS s, {_OVERLAP} AS o))),
n AS (SELECT l, s, last, last - lag(last) OVER w AS up, last - lead(last) OVER w AS down, max(CASE WHEN s = {_TARGET} THEN last END) OVER (PARTITION BY l) AS here FROM f WINDOW w AS (PARTITION BY l ORDER BY s)),
e AS (SELECT l, any_value(here) AS here, min(s) FILTER (WHERE s > {_TARGET} AND up >= 0) AS grown, max(s) FILTER (WHERE s < {_TARGET} AND down <= 0) + {_STEP} AS shrunk FROM n GROUP BY l),
t AS (SELECT l, CASE WHEN l <= {_TARGET} THEN l WHEN here = {_TARGET} THEN {_TARGET} WHEN here <= {_TARGET} // 2 THEN grown ELSE shrunk END AS s FROM e)
SELECT k, CAST(s AS BIGINT) AS size, CAST(CASE WHEN l <= {_TARGET} THEN 1 ELSE greatest(1, ceil((l - {_OVERLAP}) / (s - {_OVERLAP}))) END AS BIGINT) AS tiles FROM b JOIN t USING (l)""")
def q_split_sizes(spark, sf):
    """Tile size along an axis, and how many tiles cover it."""
    return layout.split_table(boxes(spark, sf).select("k", (200 + F.col("n") * 37).cast("int").alias("length")), "length", _TARGET, _OVERLAP, _STEP).select(
        "k", F.col("tile").cast("long").alias("size"), F.size("intervals").cast("long").alias("tiles")
    )
