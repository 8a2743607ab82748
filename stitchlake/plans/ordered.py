"""Windows, top-k, slices and grids (survey 2.5, 2.8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import layout
from ..operators import ordered as O
from ..operators import spatial as S
from ..operators import volume as V
from ._base import BOXES, EVT, PTS, TILES, boxes, evt, pts, query, r6, table, tiles


@query(f"""WITH {EVT}, s AS (SELECT view_id, count(*) AS n FROM evt GROUP BY view_id), m AS (SELECT max(n) AS mx FROM s),
r AS (SELECT event_id, view_id, row_number() OVER (PARTITION BY view_id ORDER BY x DESC, event_id) AS r FROM evt)
SELECT event_id, view_id FROM r JOIN s USING (view_id), m WHERE r <= CASE WHEN round_even(100.0::DOUBLE * n / mx, 0) BETWEEN 1 AND n - 1 THEN round_even(100.0::DOUBLE * n / mx, 0) ELSE n END""")
def q_topn_scaled(spark, sf):
    """Brightest points of each view, their number in proportion to the view's size."""
    return S.top_scaled(evt(spark, sf), "view_id", "x", "event_id", 100.0).select("event_id", "view_id")


_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


@query(f"""WITH {PTS}, c AS (SELECT a.vec_id AS ia, b.vec_id AS ib, {_D2} AS d2 FROM pts a JOIN pts b ON b.label = a.label + 1 AND {_D2} <= 40000),
r AS (SELECT *, row_number() OVER (PARTITION BY ia ORDER BY d2, ib) AS r FROM c), t AS (SELECT ia, max(CASE WHEN r = 1 THEN ib END) AS ib, max(CASE WHEN r = 1 THEN d2 END) AS best, max(CASE WHEN r = 2 THEN d2 END) AS second FROM r WHERE r <= 2 GROUP BY ia)
SELECT ia, ib, round(best, 6) AS best FROM t WHERE best * 1.5 < second""")
def q_ratio_test(spark, sf):
    p = pts(spark, sf)
    a = p.select(F.col("vec_id").alias("ia"), "label", "x", "y", "z")
    b = p.select(F.col("vec_id").alias("ib"), (F.col("label") - 1).alias("label"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    d2 = G.distance2([F.col(c) for c in "xyz"], [F.col(f"b{c}") for c in "xyz"])
    found = S.nearest_ratio(a, b, ["label"], "ia", "ib", ["x", "y", "z"], ["bx", "by", "bz"], d2, 200.0, 1.5)
    return found.select("ia", "ib", F.round("best", 6).alias("best"))


_DAY = "d AS (SELECT CAST(day(ts) AS INTEGER) AS i, avg(value) AS v FROM events GROUP BY 1)"


@query(f"WITH {_DAY} SELECT i, round(v - lag(v) OVER (ORDER BY i), 6) + 0.0 AS slope, round((v - lag(v, 5) OVER (ORDER BY i)) / 5, 6) + 0.0 AS wide FROM d")
def q_slope(spark, sf):
    d = table(spark, sf, "events").groupBy(F.dayofmonth("ts").alias("i")).agg(F.avg("value").alias("v"))
    w = Window.orderBy("i")
    return d.select("i", r6(F.col("v") - F.lag("v").over(w), "slope"), r6((F.col("v") - F.lag("v", 5).over(w)) / 5, "wide"))


@query("""WITH k AS (SELECT DISTINCT o_custkey AS c, o_orderkey // 200 AS s FROM orders), i AS (SELECT c, s, s - row_number() OVER (PARTITION BY c ORDER BY s) AS island FROM k)
SELECT c, min(s) AS first, max(s) AS last, CAST(min(s) AS VARCHAR) || ' >-> ' || CAST(max(s) AS VARCHAR) AS label FROM i GROUP BY c, island""")
def q_islands(spark, sf):
    k = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.floor(F.col("o_orderkey") / 200).alias("s"))
    return O.islands(k, "c", "s")


@query(f"WITH {TILES} SELECT grp, min(k) AS k, min_by(l0, k) AS l0 FROM tiles GROUP BY grp")
def q_representative(spark, sf):
    return O.representative(tiles(spark, sf), "grp", "k", "l0")


@query("SELECT o_custkey AS view_id, o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS point_id FROM orders")
def q_positional_ids(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("view_id"), F.col("o_orderkey").alias("key"))
    return rows.withColumn("point_id", O.position("view_id", "key"))


@query("SELECT s_nationkey AS grp, string_agg('z' || s_suppkey, ',' ORDER BY s_suppkey) AS names FROM supplier GROUP BY 1")
def q_natural_sort(spark, sf):
    """Names in the order of the numbers in them."""
    named = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("grp"), F.concat(F.lit("z"), "s_suppkey").alias("name"))
    return O.natural_order(named, "grp", "name", "names")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders QUALIFY i >= 100 AND i < 350")
def q_slice(spark, sf):
    """Rows [100, 350) in key order."""
    return O.rows_between(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100, 350)


@query("""WITH b AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) * 3 AS n FROM part), c AS (SELECT k, n, unnest(generate_series(0, 6)) AS i FROM b)
SELECT k, i, greatest(i * (n // 7) + least(i, n % 7) - 4, 0) AS lo, least((i + 1) * (n // 7) + least(i + 1, n % 7) + 4, n) AS hi FROM c WHERE n // 7 + (CASE WHEN i < n % 7 THEN 1 ELSE 0 END) > 0""")
def q_chunk_halo(spark, sf):
    """Seven near-equal parts with a halo of 4, empty parts left out."""
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size").cast("long") * 3).alias("n"))
    return O.near_equal_parts(b, "n", 7, 4).select("k", "i", "lo", "hi")


@query(f"""WITH {EVT}, g AS (SELECT CAST(floor(x / 50) AS BIGINT) AS gx, CAST(y AS BIGINT) AS gy, CAST(z AS BIGINT) AS gz, count(*) AS n FROM evt GROUP BY 1, 2, 3)
SELECT gx, gy, gz, n FROM g a WHERE n >= 3 AND NOT EXISTS (SELECT 1 FROM g b WHERE (a.gx, a.gy, a.gz) <> (b.gx, b.gy, b.gz) AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND abs(a.gz - b.gz) <= 1 AND b.n >= a.n)""")
def q_local_maxima(spark, sf):
    g = evt(spark, sf).groupBy(F.floor(F.col("x") / 50).alias("gx"), F.col("y").cast("long").alias("gy"), F.col("z").cast("long").alias("gz")).agg(F.count("*").alias("n"))
    return S.local_maxima(g, ["gx", "gy", "gz"], "n", 3).select("gx", "gy", "gz", "n")


@query(f"""WITH {EVT}, g AS (SELECT event_id, x / 10.0 AS px, y * 1.25 AS py FROM evt), o AS (SELECT *, px - 20.0 AS dx, py - 15.0 AS dy FROM g), r AS (SELECT *, sqrt(dx * dx + dy * dy) AS r FROM o),
k AS (SELECT *, CASE WHEN r = 0 THEN 1 WHEN r > 10 THEN (r + (r - 10) * 3.0 / (sqrt(20.0 * 20 + 15.0 * 15) - 10)) / r ELSE 1 END AS k FROM r)
SELECT event_id, round((20 + dx * k)::DOUBLE, 6) + 0.0 AS sx, round((15 + dy * k)::DOUBLE, 6) + 0.0 AS sy FROM k""")
def q_radial_coords(spark, sf):
    """Where radial correction reads the value of each event's place in a plane of 41 x 31."""
    g = evt(spark, sf).select("event_id", (F.col("x") / 10.0).alias("px"), (F.col("y") * 1.25).alias("py"))
    sx, sy = V.radial_shift(F.col("px"), F.col("py"), 20.0, 15.0, 10.0, 3.0)
    return g.select("event_id", r6(sx, "sx"), r6(sy, "sy"))


@query(f"""WITH {BOXES}, b AS (SELECT k, 40 + n * 7 AS nx, 30 + n * 5 AS ny FROM boxes), i AS (SELECT *, unnest(generate_series(0, (nx - 1) // 64)) AS i FROM b), j AS (SELECT *, unnest(generate_series(0, (ny - 1) // 75)) AS j FROM i)
SELECT k, i, j, i * 64 AS x0, least(i * 64 + 64, nx) AS x1, j * 75 AS y0, least(j * 75 + 75, ny) AS y1 FROM j""")
def q_block_slices(spark, sf):
    """Slices that cover each box's plane in blocks of 64 x 75, the last ones cut."""
    planes = boxes(spark, sf).select("k", (40 + F.col("n") * 7).alias("nx"), (30 + F.col("n") * 5).alias("ny"))
    cut = layout.slices(layout.slices(planes, "nx", 64, "i", "x0", "x1"), "ny", 75, "j", "y0", "y1")
    return cut.select("k", "i", "j", "x0", "x1", "y0", "y1")
