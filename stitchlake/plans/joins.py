"""Joins, set operations and components (survey 2.3, 2.6, 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import graph, layout, ordered
from ..operators import spatial as S
from ._base import BOXES, EVT, MATCHED, PTS, TILES, boxes, evt, matched, pts, query, r6, table, tiles


def _c(p, n=3):
    return [F.col(f"{p}{d}") for d in range(n)]


_MEET = " AND ".join(f"a.l{d} <= b.u{d} AND b.l{d} <= a.u{d}" for d in range(3))
_STRICT = " AND ".join(f"a.l{d} < b.u{d} AND b.l{d} < a.u{d}" for d in range(3))
_CUT = ", ".join(f"greatest(a.l{d}, b.l{d}) - a.l{d} AS l{d}, least(a.u{d}, b.u{d}) - a.l{d} AS u{d}" for d in range(3))


def _tile_pairs(spark, sf, condition, touching=True):
    a, b = tiles(spark, sf, "a_"), tiles(spark, sf, "b_")
    return S.box_join(a, b, ["a_l0", "a_l1", "a_l2"], ["a_u0", "a_u1", "a_u2"], ["b_l0", "b_l1", "b_l2"], ["b_u0", "b_u1", "b_u2"], 200, condition, touching)


@query(f"WITH {TILES} SELECT a.k AS ka, b.k AS kb, {_CUT} FROM tiles a JOIN tiles b ON a.k <> b.k AND {_MEET}")
def q_aabb_join(spark, sf):
    found = _tile_pairs(spark, sf, F.col("a_k") != F.col("b_k"))
    lo, hi = G.intersection(_c("a_l"), _c("a_u"), _c("b_l"), _c("b_u"))
    return found.select(F.col("a_k").alias("ka"), F.col("b_k").alias("kb"), *[v for d in range(3) for v in ((lo[d] - F.col(f"a_l{d}")).alias(f"l{d}"), (hi[d] - F.col(f"a_l{d}")).alias(f"u{d}"))])


@query(f"WITH {TILES} SELECT a.k AS ka, b.k AS kb, a.grp FROM tiles a JOIN tiles b ON a.grp = b.grp AND a.k < b.k")
def q_pairs_within_group(spark, sf):
    return graph.pairs_in_groups(tiles(spark, sf).select("grp", "k"), "grp", "k").select(F.col("a_k").alias("ka"), F.col("b_k").alias("kb"), F.col("a_grp").alias("grp"))


@query(f"WITH {TILES} SELECT a.k AS ka, b.k AS kb FROM tiles a JOIN tiles b ON a.k < b.k AND {_STRICT}")
def q_pairs_all_overlap(spark, sf):
    return _tile_pairs(spark, sf, F.col("a_k") < F.col("b_k"), touching=False).select(F.col("a_k").alias("ka"), F.col("b_k").alias("kb"))


@query(f"""WITH {TILES} SELECT a.k AS later, b.k AS earlier, (least(a.u0, b.u0) - greatest(a.l0, b.l0) + 1) * (least(a.u1, b.u1) - greatest(a.l1, b.l1) + 1) AS area
FROM tiles a JOIN tiles b ON a.grp = b.grp AND b.k < a.k AND {_MEET}""")
def q_earlier_intersections(spark, sf):
    found = _tile_pairs(spark, sf, (F.col("a_grp") == F.col("b_grp")) & (F.col("b_k") < F.col("a_k")))
    lo, hi = G.intersection(_c("a_l", 2), _c("a_u", 2), _c("b_l", 2), _c("b_u", 2))
    return found.select(F.col("a_k").alias("later"), F.col("b_k").alias("earlier"), G.voxels(lo, hi).alias("area"))


@query("""WITH l AS (SELECT DISTINCT user_id AS v, event_type AS label FROM events)
SELECT a.v AS va, b.v AS vb, a.label FROM l a JOIN l b ON a.label = b.label AND a.v < b.v""")
def q_label_expand(spark, sf):
    """Labels that two views share, one row each: users stand for views."""
    by = table(spark, sf, "events").select(F.col("user_id").alias("v"), F.col("event_type").alias("label")).distinct()
    return graph.pairs_in_groups(by, "label", "v").select(F.col("a_v").alias("va"), F.col("b_v").alias("vb"), F.col("a_label").alias("label"))


_OVER = "0.5 * x + 40"


@query(f"""WITH {EVT}, bx AS (SELECT s_suppkey AS k, (s_suppkey % 10) * 40.0 AS lo, (s_suppkey % 10) * 40.0 + 50 AS hi, (s_suppkey // 10) % 24 AS y0 FROM supplier)
SELECT event_id, k FROM evt JOIN bx ON {_OVER} >= lo AND {_OVER} < hi AND y >= y0 AND y < y0 + 3""")
def q_overlap_filter(spark, sf):
    """Points that fall, after a transform, into another view's half-open box."""
    p = evt(spark, sf).withColumn("tx", F.col("x") * 0.5 + 40)
    k = F.col("s_suppkey")
    bx = table(spark, sf, "supplier").select(k.alias("k"), ((k % 10) * 40.0).alias("lo"), ((k % 10) * 40.0 + 50).alias("hi"), (F.floor(k / 10) % 24).cast("double").alias("y0")).withColumn("y1", F.col("y0") + 3)
    found = S.point_in_box_join(p, bx, ["tx", "y"], ["lo", "y0"], ["hi", "y1"], [25, 3])
    return found.filter("tx < hi AND y < y1").select("event_id", "k")


_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


@query(f"""WITH {PTS}, d AS (SELECT a.label, a.vec_id, b.vec_id AS neighbour, {_D2} AS d2 FROM pts a JOIN pts b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY d2, neighbour) AS rank FROM d)
SELECT label, vec_id, neighbour, round(d2, 6) AS d2, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def q_knn_self(spark, sf):
    return S.knn_self(pts(spark, sf), "label", "vec_id", ["x", "y", "z"], 3).withColumn("d2", F.round("d2", 6))


@query(f"WITH {PTS} SELECT a.vec_id AS ia, b.vec_id AS ib, round({_D2}, 6) AS d2 FROM pts a JOIN pts b ON a.label < b.label AND {_D2} <= 3600")
def q_radius_join(spark, sf):
    a = pts(spark, sf).select(F.col("vec_id").alias("ia"), F.col("label").alias("la"), "x", "y", "z")
    b = pts(spark, sf).select(F.col("vec_id").alias("ib"), F.col("label").alias("lb"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    found = S.radius_join(a, b, ["x", "y", "z"], ["bx", "by", "bz"], 60.0, condition=F.col("la") < F.col("lb"))
    return found.select("ia", "ib", r6(F.col("__d2"), "d2"))


@query(f"""WITH {PTS} SELECT vec_id, label FROM pts a WHERE label < 5 OR NOT EXISTS (SELECT 1 FROM pts b WHERE b.label < 5 AND {_D2} <= 2500)""")
def q_dedup_anti(spark, sf):
    """A later list keeps the points that have none of the accepted list within the radius."""
    p = pts(spark, sf).select("vec_id", "label", "x", "y", "z")
    first, second = p.filter("label < 5"), p.filter("label >= 5")
    near = first.select(*[F.col(c).alias(f"b{c}") for c in "xyz"])
    kept = S.radius_join(second, near, ["x", "y", "z"], ["bx", "by", "bz"], 50.0, how="left_anti")
    return first.unionByName(kept).select("vec_id", "label")


@query(f"""WITH {PTS} SELECT vec_id FROM pts a WHERE NOT EXISTS (SELECT 1 FROM pts b WHERE b.label = a.label + 1 AND {_D2} <= 4900)""")
def q_radius_exclusion(spark, sf):
    p = pts(spark, sf).select("vec_id", "label", "x", "y", "z")
    near = p.select((F.col("label") - 1).alias("label"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    return S.radius_join(p, near, ["x", "y", "z"], ["bx", "by", "bz"], 70.0, on=["label"], how="left_anti").select("vec_id")


@query(f"""WITH {MATCHED} SELECT m.pair, m.match_id, round(a.x - b.x, 6) + 0.0 AS dx, round(a.y - b.y, 6) + 0.0 AS dy FROM matched m JOIN pts a ON a.vec_id = m.id_a AND a.label = m.pair JOIN pts b ON b.vec_id = m.id_b AND b.label = m.pair + 1""")
def q_corr_points(spark, sf):
    """Correspondences joined with the points of both sides by view and id."""
    m, p = matched(spark, sf).select("pair", "match_id", "id_a", "id_b"), pts(spark, sf)
    a = p.select(F.col("label").alias("pair"), F.col("vec_id").alias("id_a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p.select((F.col("label") - 1).alias("pair"), F.col("vec_id").alias("id_b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return m.join(a, ["pair", "id_a"]).join(b, ["pair", "id_b"]).select("pair", "match_id", r6(F.col("ax") - F.col("bx"), "dx"), r6(F.col("ay") - F.col("by"), "dy"))


@query(f"""WITH {TILES}, p AS (SELECT a.k AS ka, b.k AS kb, {', '.join(f'greatest(a.l{d}, b.l{d}) AS l{d}, least(a.u{d}, b.u{d}) AS u{d}' for d in range(3))} FROM tiles a JOIN tiles b ON a.grp < b.grp AND {_STRICT}),
c AS (SELECT unnest(generate_series(0, 7)) AS i)
SELECT ka, kb, CASE WHEN i & 1 = 1 THEN u0 ELSE l0 END AS x, CASE WHEN i & 2 = 2 THEN u1 ELSE l1 END AS y, CASE WHEN i & 4 = 4 THEN u2 ELSE l2 END AS z FROM p, c""")
def q_weak_links(spark, sf):
    """Corners of the overlap of tiles of different groups, as synthetic matches."""
    found = _tile_pairs(spark, sf, F.col("a_grp") < F.col("b_grp"), touching=False)
    lo, hi = G.intersection(_c("a_l"), _c("a_u"), _c("b_l"), _c("b_u"))
    return found.select(F.col("a_k").alias("ka"), F.col("b_k").alias("kb"), F.explode(G.corners(lo, hi)).alias("p")).select("ka", "kb", "p.x", "p.y", "p.z")


@query(f"""WITH {TILES}, c AS (SELECT cx, cy FROM (SELECT unnest(generate_series(0, (SELECT max(u0) // 128 FROM tiles))) AS cx), (SELECT unnest(generate_series(0, (SELECT max(u1) // 128 FROM tiles))) AS cy))
SELECT cx, cy, k FROM c JOIN tiles ON cx * 128 < u0 AND l0 < cx * 128 + 128 AND cy * 128 < u1 AND l1 < cy * 128 + 128""")
def q_cell_tile_join(spark, sf):
    """Output cells with the tiles that reach into them: a tile names its cells, no join is needed."""
    t = tiles(spark, sf)
    for d in range(2):
        first, last = F.floor(F.col(f"l{d}") / 128), F.ceil(F.col(f"u{d}") / 128) - 1
        t = t.withColumn("cx" if d == 0 else "cy", F.explode(F.sequence(first, last)))
    return t.select("cx", "cy", "k")


@query(f"""WITH {TILES}, g AS (SELECT k, CAST(l0 // 100 AS BIGINT) AS ix, CAST(l1 // 100 AS BIGINT) AS iy FROM tiles)
SELECT DISTINCT a.k AS ka, b.k AS kb FROM g a JOIN g b ON a.k < b.k AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1""")
def q_grid_adjacency(spark, sf):
    g = tiles(spark, sf).select("k", F.floor(F.col("l0") / 100).alias("ix"), F.floor(F.col("l1") / 100).alias("iy"))
    offsets = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in S.half_offsets(2)])
    around = g.withColumn("o", F.explode(offsets)).select(F.col("k").alias("ka"), (F.col("ix") + F.col("o.x")).alias("ix"), (F.col("iy") + F.col("o.y")).alias("iy"))
    return around.join(g.withColumnRenamed("k", "kb"), ["ix", "iy"]).filter("ka < kb").select("ka", "kb").distinct()


@query(f"""WITH {TILES}, ch AS (SELECT o_orderkey AS c, (o_orderkey * 7) % 1000 AS a0, (o_orderkey * 7) % 1000 + 20 AS b0, (o_orderkey * 13) % 1000 AS a1, (o_orderkey * 13) % 1000 + 20 AS b1 FROM orders)
SELECT c, k FROM ch JOIN tiles ON a0 >= l0 AND b0 <= u0 AND a1 >= l1 AND b1 <= u1""")
def q_containment_join(spark, sf):
    """Chunks that lie wholly inside a tile. A chunk's corner lies in the tile too."""
    k = F.col("o_orderkey")
    ch = table(spark, sf, "orders").select(k.alias("c"), *[((k * f) % 1000 + add).alias(n) for n, f, add in (("a0", 7, 0), ("b0", 7, 20), ("a1", 13, 0), ("b1", 13, 20))])
    found = S.point_in_box_join(ch, tiles(spark, sf), ["a0", "a1"], ["l0", "l1"], ["u0", "u1"], 120)
    return found.filter("b0 <= u0 AND b1 <= u1").select("c", "k")


@query("""SELECT r_name || '/' || n_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def q_region_counts(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return counts.join(n, "n_nationkey").select(F.concat_ws("/", "r_name", "n_name").alias("region"), "n")


@query(f"WITH {TILES} SELECT n_name AS name, k FROM tiles JOIN nation ON n_nationkey = grp WHERE l0 = 300")
def q_tile_lookup(spark, sf):
    return tiles(spark, sf).filter("l0 = 300").join(table(spark, sf, "nation"), F.col("grp") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), "k")


@query("SELECT v, min(g) AS g FROM (SELECT s_suppkey % 40 AS v, s_nationkey AS g FROM supplier) GROUP BY v")
def q_group_of_view(spark, sf):
    """First group that lists a view."""
    groups = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("g")).agg(F.collect_set(F.col("s_suppkey") % 40).alias("views"))
    return groups.select("g", F.explode("views").alias("v")).groupBy("v").agg(F.min("g").alias("g"))


@query(f"WITH {TILES}, m AS (SELECT k, 2.0::DOUBLE AS m00, CAST(k AS DOUBLE) AS m03 FROM tiles WHERE k % 3 = 0) SELECT t.k, coalesce(m00, 1.0)::DOUBLE AS m00, coalesce(m03, 0.0)::DOUBLE AS m03 FROM tiles t LEFT JOIN m USING (k)")
def q_default_model(spark, sf):
    t = tiles(spark, sf).select("k")
    m = t.filter("k % 3 = 0").select("k", F.lit(2.0).alias("m00"), F.col("k").cast("double").alias("m03"))
    return t.join(m, "k", "left").select("k", F.coalesce("m00", F.lit(1.0)).alias("m00"), F.coalesce("m03", F.lit(0.0)).alias("m03"))


@query("""WITH t AS (SELECT DISTINCT r_regionkey AS tp FROM region), s AS (SELECT s_suppkey AS setup, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey * 10 END AS size FROM supplier)
SELECT tp, setup, size FROM t, s WHERE size IS NOT NULL""")
def q_view_sizes(spark, sf):
    """Timepoints (a small axis) times setups, without setups of unknown size."""
    tp = F.array_sort(F.collect_set("r_regionkey")).alias("tps")
    k = F.col("s_suppkey")
    sized = table(spark, sf, "supplier").select(k.alias("setup"), F.when(k % 4 != 0, k * 10).alias("size")).filter("size IS NOT NULL")
    axis = table(spark, sf, "region").agg(tp)
    return sized.join(F.broadcast(axis)).select(F.explode("tps").alias("tp"), "setup", "size")


@query(f"""WITH {MATCHED}, e AS (SELECT pair, id_a, id_b FROM matched) SELECT pair AS view_id, pair + 1 AS other, id_a, id_b FROM e UNION ALL SELECT pair + 1, pair, id_b, id_a FROM e""")
def q_bidirectional(spark, sf):
    return graph.both_ways(matched(spark, sf).select(F.col("pair").alias("view_id"), (F.col("pair") + 1).alias("other"), "id_a", "id_b"), [("view_id", "other"), ("id_a", "id_b")])


@query(f"""WITH {MATCHED}, e AS (SELECT pair AS v, pair + 1 AS o FROM matched UNION ALL SELECT pair + 1, pair FROM matched), d AS (SELECT DISTINCT v, o, '0,' || o || ',beads' AS key FROM e)
SELECT v, key, dense_rank() OVER (PARTITION BY v ORDER BY key) - 1 AS id FROM d""")
def q_id_map(spark, sf):
    """0-based ids of each view's partners in the order of their text keys."""
    e = graph.both_ways(matched(spark, sf).select(F.col("pair").alias("v"), (F.col("pair") + 1).alias("o")), [("v", "o")]).distinct()
    e = e.select("v", F.format_string("0,%d,beads", "o").alias("key"))
    return e.select("v", "key", ordered.id_of("v", "key").alias("id"))


@query(f"""WITH {MATCHED}, e AS (SELECT pair AS v, pair + 1 AS o, id_a AS ia, id_b AS ib FROM matched UNION ALL SELECT pair + 1, pair, id_b, id_a FROM matched)
SELECT v, ia, ib, dense_rank() OVER (PARTITION BY v ORDER BY '0,' || o || ',beads') - 1 AS group_id FROM e""")
def q_directed_expand(spark, sf):
    e = graph.both_ways(matched(spark, sf).select(F.col("pair").alias("v"), (F.col("pair") + 1).alias("o"), F.col("id_a").alias("ia"), F.col("id_b").alias("ib")), [("v", "o"), ("ia", "ib")])
    return e.select("v", "ia", "ib", ordered.id_of("v", F.format_string("0,%d,beads", "o")).alias("group_id"))


@query(f"WITH {MATCHED} SELECT id_a AS id, round(px, 6) + 0.0 AS x FROM matched UNION ALL SELECT id_b, round(qx, 6) + 0.0 FROM matched")
def q_union_all(spark, sf):
    m = matched(spark, sf)
    return m.select(F.col("id_a").alias("id"), r6(F.col("px"), "x")).unionByName(m.select(F.col("id_b").alias("id"), r6(F.col("qx"), "x")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def q_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 48")
def q_except(spark, sf):
    """Parts that were never ordered in large numbers."""
    used = table(spark, sf, "lineitem").filter("l_quantity >= 48").select(F.col("l_partkey").alias("k"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k")).distinct().join(used, "k", "left_anti")


@query(f"WITH {TILES} SELECT DISTINCT least(a.k, b.k) AS ka, greatest(a.k, b.k) AS kb FROM tiles a JOIN tiles b ON a.k <> b.k AND {_STRICT}")
def q_distinct_edges(spark, sf):
    found = _tile_pairs(spark, sf, F.col("a_k") != F.col("b_k"), touching=False)
    return found.select(F.least("a_k", "b_k").alias("ka"), F.greatest("a_k", "b_k").alias("kb")).distinct()


@query(f"""WITH {BOXES}, b AS (SELECT k, 50 + n * 3 AS nz, 40 + n * 2 AS ny, 30 + n AS nx FROM boxes), z AS (SELECT *, unnest(generate_series(0, (nz - 1) // 64)) AS z FROM b), y AS (SELECT *, unnest(generate_series(0, (ny - 1) // 48)) AS y FROM z),
x AS (SELECT *, unnest(generate_series(0, (nx - 1) // 32)) AS x FROM y) SELECT k, z, y, x, least(z * 64 + 64, nz) AS z1 FROM x""")
def q_cell_grid(spark, sf):
    """The cells of each box's volume: the product of its three axes' blocks."""
    rows = boxes(spark, sf).select("k", *[(a + F.col("n") * m).alias(f"n{c}") for c, a, m in (("z", 50, 3), ("y", 40, 2), ("x", 30, 1))])
    for c, block in (("z", 64), ("y", 48), ("x", 32)):
        rows = layout.slices(rows, f"n{c}", block, c, f"{c}0", f"{c}1")
    return rows.select("k", "z", "y", "x", "z1")


@query(f"""WITH RECURSIVE {TILES}, e AS (SELECT a.k AS ka, b.k AS kb FROM tiles a JOIN tiles b ON a.grp % 5 = b.grp % 5 AND a.k <> b.k AND {_STRICT}),
r AS (SELECT k AS a, k AS b FROM tiles UNION SELECT r.a, e.kb FROM r JOIN e ON e.ka = r.b)
SELECT a AS k, min(b) AS component FROM r GROUP BY a""")
def q_components(spark, sf):
    """Connected components of overlapping tiles whose groups agree modulo 5."""
    e = _tile_pairs(spark, sf, (F.col("a_grp") % 5 == F.col("b_grp") % 5) & (F.col("a_k") < F.col("b_k")), touching=False).select(F.col("a_k").alias("a"), F.col("b_k").alias("b"))
    nodes = tiles(spark, sf).select("k")
    found = graph.components(e)
    return nodes.join(found, nodes["k"] == found["node"], "left").select("k", F.coalesce("component", "k").alias("component"))
