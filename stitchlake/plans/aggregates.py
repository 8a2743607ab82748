"""Aggregations (survey 2.4) and validation gates (2.12)."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fit, quality
from ._base import BOXES, EVT, MATCHED, PTS, TILES, boxes, evt, matched, pts, query, r6, table, tiles


@query(f"""WITH {EVT} SELECT view_id, count(*) AS n, round(min(x), 6) AS min_i, round(max(x), 6) AS max_i, round(avg(x), 6) AS mean_i, round(stddev_pop(x), 6) AS std_i,
  round(stddev_pop(y), 6) AS std_y, round(stddev_pop(z), 6) AS std_z,
  round(CASE WHEN (max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) = 0 THEN 0 ELSE count(*) / ((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) / 1e9) END, 4) AS density FROM evt GROUP BY view_id""")
def q_detection_stats(spark, sf):
    return quality.detection_stats(evt(spark, sf), "view_id", "x", ["x", "y", "z"]).select(
        "view_id", "n", F.round("min_i", 6).alias("min_i"), F.round("max_i", 6).alias("max_i"), F.round("mean_i", 6).alias("mean_i"), F.round("std_i", 6).alias("std_i"),
        F.round("std_y", 6).alias("std_y"), F.round("std_z", 6).alias("std_z"), F.round("density", 4).alias("density"),
    )


@query(f"WITH {PTS} SELECT count(*) AS total, count(DISTINCT label) AS views FROM pts")
def q_total_points(spark, sf):
    per = pts(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("total"), F.count("*").alias("views"))


@query(f"""WITH {MATCHED}, u AS (SELECT px AS x, py AS y, pz AS z FROM matched UNION ALL SELECT qx, qy, qz FROM matched)
SELECT count(*) AS n, round(min(x), 2) + 0.0 AS min_x, round(max(x), 2) AS max_x, round(stddev_samp(x), 2) AS std_x, round(stddev_samp(y), 2) AS std_y, round(stddev_samp(z), 2) AS std_z,
  round((stddev_samp(x) + stddev_samp(y) + stddev_samp(z)) / 3, 2) AS mean_std, round((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 2) AS volume FROM u""")
def q_match_stats(spark, sf):
    return quality.match_stats(matched(spark, sf))


@query(f"""WITH {EVT}, o AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM evt)
SELECT CAST(floor((x - x0) / 20) AS BIGINT) AS ix, CAST(floor((y - y0) / 4) AS BIGINT) AS iy, CAST(floor((z - z0) / 5) AS BIGINT) AS iz, count(*) AS n FROM evt, o GROUP BY 1, 2, 3""")
def q_voxel_counts(spark, sf):
    return quality.voxel_counts(evt(spark, sf), ["x", "y", "z"], [20.0, 4.0, 5.0])


@query(f"""WITH {EVT}, o AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, (ceil((max(x) - min(x)) / 20) + 1) * (ceil((max(y) - min(y)) / 4) + 1) * (ceil((max(z) - min(z)) / 5) + 1) AS cells FROM evt),
v AS (SELECT floor((x - x0) / 20) AS ix, floor((y - y0) / 4) AS iy, floor((z - z0) / 5) AS iz, count(*) AS n FROM evt, o GROUP BY 1, 2, 3),
m AS (SELECT avg(n) AS mu, sum(n) AS t, count(*) AS k, max(n) AS mx, min(n) AS mn FROM v),
c AS (SELECT avg(pow(n - mu, 2)) AS m2, avg(pow(n - mu, 3)) AS m3, avg(pow(n - mu, 4)) AS m4, -sum(n / t * ln(n / t)) AS h FROM v, m)
SELECT CAST(cells AS BIGINT) AS cells, k AS occupied, CAST(t AS BIGINT) AS total, round(mu, 4) AS mean, round(sqrt(m2), 4) AS std, round(sqrt(m2) / mu, 4) AS cv, round(100 * k / cells, 4) AS occupancy, round(h, 4) AS entropy, mx AS most, mn AS least,
  round(m3 / pow(m2, 1.5), 4) AS skew, round(m4 / pow(m2, 2) - 3, 4) AS kurtosis FROM m, c, o""")
def q_voxel_stats(spark, sf):
    return quality.voxel_stats(evt(spark, sf), ["x", "y", "z"], [20.0, 4.0, 5.0])


H = 2 ** (-1 / 7)


@query(f"""WITH {MATCHED}, d AS (SELECT pair, match_id, sqrt(pow(px - qx, 2) + pow(py - qy, 2) + pow(pz - qz, 2)) AS d FROM matched),
s AS (SELECT pair, match_id, (d - avg(d) OVER w) / coalesce(nullif(stddev_pop(d) OVER w, 0), 1) AS v FROM d WINDOW w AS (PARTITION BY pair)),
k AS (SELECT a.pair, a.match_id, avg(exp(-pow(a.v - b.v, 2) / (2 * {H * H!r})) / ({H!r} * {math.sqrt(2 * math.pi)!r})) AS f FROM s a JOIN s b ON a.pair = b.pair GROUP BY 1, 2)
SELECT pair, round(min(f), 6) AS min_f, round(max(f), 6) AS max_f, round(avg(f), 6) AS mean_f, round(median(f), 6) AS median_f, round(stddev_pop(f), 6) AS std_f FROM k GROUP BY pair""")
def q_kde(spark, sf):
    """Density of match distances at every match of a pair, which has as many as its views have points."""
    return quality.kde(matched(spark, sf), "pair", "match_id", H)


@query(f"WITH {BOXES} SELECT n, count(*) AS c, round(min(price), 2) AS least FROM boxes GROUP BY n")
def q_size_histogram(spark, sf):
    return boxes(spark, sf).groupBy("n").agg(F.count("*").alias("c"), F.round(F.min("price"), 2).alias("least"))


_SUMS = ", ".join(["count(*) AS n", *[f"sum({p}{a}) AS s{p}{a}" for p in "pq" for a in "xyz"], *[f"sum(p{a} * q{b}) AS s{a}{b}" for a in "xyz" for b in "xyz"], *[f"sum(p{a} * p{b}) AS t{a}{b}" for i, a in enumerate("xyz") for b in "xyz"[i:]]])
_ROUND = ", ".join([f"round(s{p}{a}, 3) + 0.0 AS s{p}{a}" for p in "pq" for a in "xyz"] + [f"round(s{a}{b}, 3) + 0.0 AS s{a}{b}" for a in "xyz" for b in "xyz"])


@query(f"WITH {MATCHED}, m AS (SELECT pair, {_SUMS} FROM matched GROUP BY pair) SELECT pair, n, {_ROUND} FROM m")
def q_rigid_moments(spark, sf):
    m = fit.moments(matched(spark, sf), ["pair"])
    names = [f"s{p}{a}" for p in "pq" for a in "xyz"] + [f"s{a}{b}" for a in "xyz" for b in "xyz"]
    return m.select("pair", "n", *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in names])


def _affine_sql() -> str:
    a = {x + y: f"(t{min(x, y)}{max(x, y)} - sp{x} * sp{y} / n)" for x in "xyz" for y in "xyz"}
    b = {x + y: f"(s{x}{y} - sp{x} * sq{y} / n)" for x in "xyz" for y in "xyz"}
    named = ", ".join([f"{v} AS a{k}" for k, v in a.items()] + [f"{v} AS b{k}" for k, v in b.items()])
    cof = {"xx": "ayy * azz - ayz * ayz", "xy": "ayz * axz - axy * azz", "xz": "axy * ayz - ayy * axz", "yy": "axx * azz - axz * axz", "yz": "axy * axz - axx * ayz", "zz": "axx * ayy - axy * axy"}
    c = lambda x, y: f"({cof[min(x, y) + max(x, y)]})"
    rows = []
    for r, q in enumerate("xyz"):
        lin = ["(" + " + ".join(f"b{k}{q} * {c(k, p)} / det" for k in "xyz") + ")" for p in "xyz"]
        rows += [f"round({v}, 4) + 0.0 AS m{r}{i}" for i, v in enumerate(lin)]
        rows.append(f"round(sq{q} / n - ({' + '.join(f'{v} * sp{p} / n' for v, p in zip(lin, 'xyz', strict=True))}), 3) + 0.0 AS m{r}3")
    return f"""WITH {MATCHED}, m AS (SELECT pair, {_SUMS} FROM matched GROUP BY pair), c AS (SELECT *, {named} FROM m), d AS (SELECT *, axx * {c("x", "x")} + axy * {c("x", "y")} + axz * {c("x", "z")} AS det FROM c)
SELECT pair, n, {', '.join(rows)} FROM d"""


@query(_affine_sql())
def q_affine_fit(spark, sf):
    m = fit.affine_fit(fit.moments(matched(spark, sf), ["pair"]), ["pair"])
    return m.select("pair", "n", *[(F.round(f"m{r}{c}", 3 if c == 3 else 4) + F.lit(0.0)).alias(f"m{r}{c}") for r in range(3) for c in range(4)])


_ERR = "sqrt(pow(px - qx, 2) + pow(py - qy, 2) + pow(pz - qz, 2))"


@query(f"""WITH {MATCHED}, d AS (SELECT pair, avg({_ERR}) AS e, sum({_ERR} * {_ERR} * (1 + match_id % 3)) / sum(1 + match_id % 3) AS w FROM matched GROUP BY pair)
SELECT pair, round(e, 4) AS distance, round(w, 4) AS weighted, round(avg(e) OVER (), 4) AS mean_error, round(min(e) OVER (), 4) AS min_error, round(max(e) OVER (), 4) AS max_error FROM d""")
def q_tile_error(spark, sf):
    return quality.tile_error(matched(spark, sf).withColumn("weight", 1 + F.col("match_id") % 3), "pair")


@query(f"""WITH {MATCHED}, e AS (SELECT pair, match_id, {_ERR} AS e FROM matched), t AS (SELECT pair, median(e) AS m FROM e GROUP BY pair)
SELECT pair, match_id, round(e, 6) AS e FROM e JOIN t USING (pair) WHERE e <= 1.2 * m""")
def q_median_trim(spark, sf):
    return quality.median_trim(quality.with_error(matched(spark, sf)), "pair", "e", 1.2).select("pair", "match_id", F.round("e", 6).alias("e"))


@query(f"""WITH {MATCHED}, e AS (SELECT pair, {_ERR} AS e FROM matched)
SELECT pair, count(*) AS candidates, count(*) FILTER (WHERE e < 200) AS inliers, (count(*) FILTER (WHERE e < 200) >= 12 AND count(*) FILTER (WHERE e < 200) > 0.25 * count(*)) AS good FROM e GROUP BY pair""")
def q_consensus(spark, sf):
    return quality.consensus(quality.with_error(matched(spark, sf)), "pair", "e", 200.0, 12, 0.25)


@query(f"""WITH {TILES}, c AS (SELECT unnest(generate_series(0, 7)) AS i), p AS (SELECT CASE WHEN i & 1 = 1 THEN u0 ELSE l0 END AS x, CASE WHEN i & 2 = 2 THEN u1 ELSE l1 END AS y, CASE WHEN i & 4 = 4 THEN u2 ELSE l2 END AS z FROM tiles, c),
t AS (SELECT x + 0.1 * y + 5 AS a, y + 0.2 * z - 3 AS b, 0.1 * x + z + 7 AS c FROM p)
SELECT {', '.join(f'round(min({v})::DOUBLE, 6) AS min_{v}, round(max({v})::DOUBLE, 6) AS max_{v}' for v in 'abc')} FROM t""")
def q_global_bbox(spark, sf):
    from ..functions import geometry as G

    m = [1.0, 0.1, 0.0, 5.0, 0.0, 1.0, 0.2, -3.0, 0.1, 0.0, 1.0, 7.0]
    p = tiles(spark, sf).select(F.explode(G.corners([F.col(f"l{d}") for d in range(3)], [F.col(f"u{d}") for d in range(3)])).alias("p"))
    t = p.select(*[v.alias(n) for v, n in zip(G.apply(m, [F.col(f"p.{a}") for a in "xyz"]), "abc", strict=True)])
    return t.agg(*[f(F.col(v)) for v in "abc" for f in (lambda c, v=v: r6(F.min(c), f"min_{v}"), lambda c, v=v: r6(F.max(c), f"max_{v}"))])


@query(f"WITH {PTS} SELECT label, count(*) AS n, {', '.join(f'round(min({a}), 6) AS lo_{a}, round(max({a}), 6) AS hi_{a}' for a in 'xyz')} FROM pts GROUP BY label")
def q_bounds(spark, sf):
    return pts(spark, sf).groupBy("label").agg(F.count("*").alias("n"), *[c for a in "xyz" for c in (F.round(F.min(a), 6).alias(f"lo_{a}"), F.round(F.max(a), 6).alias(f"hi_{a}"))])


@query(f"""WITH {BOXES}, b AS (SELECT k // 64 AS block, brand FROM boxes) SELECT block, array_to_string(list_sort(list(DISTINCT brand)), ',') AS lut, count(DISTINCT brand) AS n,
  CAST(ceil(log2(greatest(count(DISTINCT brand), 2))) AS BIGINT) AS bits FROM b GROUP BY block""")
def q_block_lut(spark, sf):
    lut = boxes(spark, sf).groupBy(F.floor(F.col("k") / 64).alias("block")).agg(F.array_sort(F.collect_set("brand")).alias("s"))
    n = F.size("s").cast("long")
    return lut.select("block", F.array_join("s", ",").alias("lut"), n.alias("n"), F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double"))).alias("bits"))


_DAY = "d AS (SELECT CAST(day(ts) AS INTEGER) AS i, avg(value) AS v FROM events GROUP BY 1)"


@query(f"""WITH {_DAY} SELECT i, round(v, 6) AS v, round(avg(v) OVER w, 6) AS mean, round(var_pop(v) OVER w, 4) AS var, round(min(v) OVER w, 6) AS lo, round(max(v) OVER w, 6) AS hi FROM d WINDOW w AS (ORDER BY i ROWS UNBOUNDED PRECEDING)""")
def q_running_stats(spark, sf):
    """Statistics of the iterations so far; at most one row a day of a month."""
    d = table(spark, sf, "events").groupBy(F.dayofmonth("ts").alias("i")).agg(F.avg("value").alias("v"))
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("i", F.round("v", 6).alias("v"), F.round(F.avg("v").over(w), 6).alias("mean"), F.round(F.var_pop("v").over(w), 4).alias("var"), F.round(F.min("v").over(w), 6).alias("lo"), F.round(F.max("v").over(w), 6).alias("hi"))


@query(f"""WITH {EVT}, g AS (SELECT CAST(y AS BIGINT) AS gy, CAST(z AS BIGINT) AS gz, x AS v, 1 + view_id AS w FROM evt)
SELECT gy, gz, round(sum(w * v) / sum(w), 6) AS blended FROM g GROUP BY 1, 2""")
def q_weighted_blend(spark, sf):
    from ..operators import volume

    g = evt(spark, sf).select(F.col("y").cast("long").alias("gy"), F.col("z").cast("long").alias("gz"), F.col("x").alias("v"), (1 + F.col("view_id")).alias("w"))
    return g.groupBy("gy", "gz").agg(F.round(volume.weighted("v", "w"), 6).alias("blended"))


@query(f"WITH {EVT} SELECT CAST(y AS BIGINT) AS gy, CAST(z AS BIGINT) AS gz, max(x) AS v FROM evt GROUP BY 1, 2")
def q_max_blend(spark, sf):
    return evt(spark, sf).groupBy(F.col("y").cast("long").alias("gy"), F.col("z").cast("long").alias("gz")).agg(F.max("x").alias("v"))


@query("SELECT p_brand AS channel, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS sources FROM part GROUP BY 1")
def q_collect_sources(spark, sf):
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("channel")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("p_partkey")).alias("s"))
    return p.select("channel", "n", F.array_join(F.transform("s", lambda v: v.cast("string")), ",").alias("sources"))


@query(f"""WITH {EVT}, g AS (SELECT CAST(y AS BIGINT) AS gy, CAST(z AS BIGINT) AS gz, avg(x) AS v FROM evt GROUP BY 1, 2) SELECT gy // 2 AS by, gz // 2 AS bz, round(avg(v), 6) AS v FROM g GROUP BY 1, 2""")
def q_block_mean(spark, sf):
    from ..operators import volume

    g = evt(spark, sf).groupBy(F.col("y").cast("long").alias("gy"), F.col("z").cast("long").alias("gz")).agg(F.avg("x").alias("v"))
    return volume.block_mean(g, {"gy": 2, "gz": 2}, "v").select(F.col("gy").alias("by"), F.col("gz").alias("bz"), F.round("v", 6).alias("v"))


@query(f"""WITH {EVT}, g AS (SELECT CAST(z AS BIGINT) AS i, avg(x) AS v FROM evt GROUP BY 1), n AS (SELECT max(i) + 1 AS n FROM g)
SELECT i // 2 AS i, round(avg(v), 6) AS v FROM g, n WHERE i < n // 2 * 2 GROUP BY 1""")
def q_pairwise_halve(spark, sf):
    from ..operators import volume

    g = evt(spark, sf).groupBy(F.col("z").cast("long").alias("i")).agg(F.avg("x").alias("v"))
    return volume.halve(g, "i", "v").select("i", F.round("v", 6).alias("v"))


@query("""WITH s AS (SELECT (SELECT count(*) FROM embeddings) AS points, (SELECT count(*) FROM events) AS matches, (SELECT stddev_pop(value) / avg(value) FROM events) AS cv),
g AS (SELECT * FROM (VALUES ('points', 100.0, NULL), ('matches', 50.0, 1000000.0), ('cv', NULL, 0.1)) t(gate, lo, hi)),
v AS (SELECT gate, CASE gate WHEN 'points' THEN points WHEN 'matches' THEN matches ELSE cv END::DOUBLE AS value, lo, hi FROM g, s)
SELECT gate, round(value, 6) AS value, (lo IS NULL OR value >= lo) AND (hi IS NULL OR value <= hi) AS ok FROM v""")
def q_gates(spark, sf):
    n = table(spark, sf, "embeddings").agg(F.count("*").cast("double").alias("value")).select(F.lit("points").alias("gate"), "value")
    e = table(spark, sf, "events").agg(F.count("*").cast("double").alias("m"), (F.stddev_pop("value") / F.avg("value")).alias("cv"))
    e = e.select(F.explode(F.array(F.struct(F.lit("matches").alias("gate"), F.col("m").alias("value")), F.struct(F.lit("cv").alias("gate"), F.col("cv").alias("value")))).alias("r")).select("r.*")
    return quality.gates(n.unionByName(e), {"points": (100.0, None), "matches": (50.0, 1000000.0), "cv": (None, 0.1)}).select("gate", F.round("value", 6).alias("value"), "ok")


@query("""WITH c AS (SELECT (SELECT count(*) FROM orders) AS files, (SELECT count(*) FROM orders WHERE o_orderkey IS NOT NULL) AS regs, (SELECT count(*) FROM customer) AS setups)
SELECT files, regs, setups, files = regs AS files_ok, setups * 2 = regs AS setups_ok FROM c""")
def q_validate_counts(spark, sf):
    o = table(spark, sf, "orders").agg(F.count("*").alias("files"), F.count("o_orderkey").alias("regs"))
    c = table(spark, sf, "customer").agg(F.count("*").alias("setups"))
    return o.join(F.broadcast(c)).select("files", "regs", "setups", (F.col("files") == F.col("regs")).alias("files_ok"), (F.col("setups") * 2 == F.col("regs")).alias("setups_ok"))
