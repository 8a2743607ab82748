"""Global alignment of tiles from matches.

An iteration goes through the colours of the tile graph (Gauss-Seidel): tiles of one colour share no
match, so they move together, each to the newest models of its neighbours. Matches are transformed by the
models of both tiles, each tile's moments are summed natively, and new models are fitted from the sums.
Models are one small row a tile, in a table that replaces the one before; fixed tiles are a table too.
Only the error curve reaches the driver, which decides on stopping; matches are read, never collected.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.shared import discard, written
from . import fit, graph

NAMES = G.NAMES


def identity(tiles: DataFrame, tile: str = "tile") -> DataFrame:
    return tiles.select(tile, *[F.lit(float(v)).alias(n) for n, v in zip(NAMES, G.IDENTITY, strict=True)])


def _world(links: DataFrame, models: DataFrame) -> DataFrame:
    """Links (tile, other, px.., qx..) with both points in world coordinates (wx.., vx..)."""
    own = models.select("tile", *[F.col(n).alias(f"a_{n}") for n in NAMES])
    other = models.select(F.col("tile").alias("other"), *[F.col(n).alias(f"b_{n}") for n in NAMES])
    both = links.join(own, "tile").join(other, "other")
    w = G.apply(G.model("a_"), [F.col(f"p{a}") for a in "xyz"])
    v = G.apply(G.model("b_"), [F.col(f"q{a}") for a in "xyz"])
    return both.select("tile", "other", *[F.col(f"p{a}") for a in "xyz"], *[x.alias(f"w{a}") for x, a in zip(w, "xyz", strict=True)], *[x.alias(f"v{a}") for x, a in zip(v, "xyz", strict=True)])


def tile_errors(links: DataFrame, models: DataFrame) -> DataFrame:
    w = _world(links, models)
    return w.groupBy("tile").agg(F.avg(F.sqrt(G.distance2([F.col(f"w{a}") for a in "xyz"], [F.col(f"v{a}") for a in "xyz"]))).alias("error"))


def settled(errors: list[float], plateau: int, allowed: float = math.inf, slope: float = 1e-4) -> bool:
    """Whether a search may end: more than ``plateau`` + 1 errors, the last one allowed, and no slope over
    the last plateau, half of it, a quarter, .. down to one step, beyond ``slope``."""
    if len(errors) < plateau + 2 or errors[-1] > allowed:
        return False
    width = float(plateau)
    while width >= 1:
        if abs(errors[-1] - errors[-1 - int(width)]) / int(width) > slope:
            return False
        width /= 2
    return True


def _tiles(spark, fixed) -> DataFrame:
    """A table (tile) of fixed tiles from a list, or the table itself."""
    if isinstance(fixed, DataFrame):
        return fixed.select("tile")
    kind = "string" if any(isinstance(t, str) for t in fixed) else "long"
    return spark.createDataFrame([(t,) for t in fixed], f"tile {kind}")


def _models(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select("tile", *[F.col(n).alias(f"{prefix}{n}") for n in NAMES])


def relax(matches: DataFrame, fixed: list | DataFrame, kind: str = "rigid", iterations: int = 10_000, damp: float = 1.0, plateau: int = 200, slope: float = 1e-4, share: float = 0.1, start: DataFrame | None = None, allowed: float = math.inf, coloured: bool = True) -> tuple[DataFrame, list[float]]:
    """(models, mean error of each iteration). ``matches``: tile, other, px.., qx..; fixed tiles (a list, or a table
    of tile) keep the identity. ``affine`` fits are drawn towards the rigid ones by ``share``. The search ends when
    ``settled``. ``start`` gives first models, as those of ``prealign``. Without ``coloured`` all tiles
    move at once (Jacobi), which needs more iterations and can swing far from the solution."""
    links = written(graph.both_ways(matches.select("tile", "other", *[f"{s}{a}" for s in "pq" for a in "xyz"]), [("tile", "other"), *[(f"p{a}", f"q{a}") for a in "xyz"]]), "links")
    moving = links.join(_tiles(matches.sparkSession, fixed), "tile", "left_anti")
    if coloured:
        found = written(graph.coloured(matches.select(F.col("tile").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "tile"), "colours")
        moving = written(moving.join(found, "tile"), "moving")
        colours = sorted(r.colour for r in moving.select("colour").distinct().collect())  # few: at most a tile's matches partners + 1
        discard(found)
    else:
        moving, colours = moving.withColumn("colour", F.lit(0)), [0]
    models = identity(links.select("tile").distinct())
    if start is not None:
        models = models.join(_models(start, "s_"), "tile", "left").select("tile", *[F.coalesce(f"s_{n}", n).alias(n) for n in NAMES])
    models = written(models, "models")
    errors: list[float] = []
    for _ in range(iterations):
        for colour in colours:
            w = _world(moving.filter(F.col("colour") == colour), models)
            target = [(F.col(f"w{a}") + damp * (F.col(f"v{a}") - F.col(f"w{a}"))).alias(f"q{a}") for a in "xyz"]
            sums = fit.moments(w.select("tile", *[F.col(f"p{a}") for a in "xyz"], *target), ["tile"])
            new = fit.rigid_fit(sums, ["tile"])
            if kind == "affine":
                mixed = [(F.coalesce(F.col(f"f_{n}") * (1 - share) + F.col(n) * share, F.col(n))).alias(n) for n in NAMES]
                new = new.join(_models(fit.affine_fit(sums, ["tile"]), "f_"), "tile", "left").select("tile", *mixed)
            held = models
            models = written(held.join(_models(new, "n_"), "tile", "left").select("tile", *[F.coalesce(f"n_{n}", n).alias(n) for n in NAMES]), "models")
            discard(held)
        errors.append(tile_errors(links, models).agg(F.avg("error")).first()[0])
        if settled(errors, plateau, allowed, slope):
            break
    discard(links, moving)
    return models, errors


def prealign(matches: DataFrame, seed, least: int = 3) -> DataFrame:
    """Models along a breadth-first spread from the seed (a tile, or a table of tile): each round fits the tiles that
    touch the aligned ones by their matches with those. Unreached tiles are absent."""
    links = written(graph.both_ways(matches.select("tile", "other", *[f"{s}{a}" for s in "pq" for a in "xyz"]), [("tile", "other"), *[(f"p{a}", f"q{a}") for a in "xyz"]]), "links")
    seeds = _tiles(matches.sparkSession, seed if isinstance(seed, DataFrame) else [seed])
    models = written(identity(links.join(seeds, "tile", "left_semi").select("tile").distinct()), "models")
    while True:
        done = models.select("tile")
        front = links.join(done, "tile", "left_anti").join(models.select(F.col("tile").alias("other"), *NAMES), "other")
        world = G.apply(G.model(), [F.col(f"q{a}") for a in "xyz"])
        sums = fit.moments(front.select("tile", *[F.col(f"p{a}") for a in "xyz"], *[v.alias(f"q{a}") for v, a in zip(world, "xyz", strict=True)]), ["tile"])
        new = written(fit.rigid_fit(sums, ["tile"], least).select("tile", *NAMES), "front")
        if not new.limit(1).count():
            discard(new, links)
            return models
        held = models
        models = written(held.unionByName(new), "models")
        discard(held, new)


def concatenate(first: DataFrame, second: DataFrame) -> DataFrame:
    """Models of a second round after those of the first; a tile absent from one keeps the other."""
    a = first.select("tile", *[F.col(n).alias(f"a_{n}") for n in NAMES])
    b = second.select("tile", *[F.col(n).alias(f"b_{n}") for n in NAMES])
    both = a.join(b, "tile", "full")
    fill = both.select("tile", *[F.coalesce(f"{p}{n}", F.lit(float(v))).alias(f"{p}{n}") for p in ("a_", "b_") for n, v in zip(NAMES, G.IDENTITY, strict=True)])
    return fill.select("tile", *[v.alias(n) for v, n in zip(G.compose(G.model("b_"), G.model("a_")), NAMES, strict=True)])


def observed(errors: list[float]) -> list[dict]:
    """Statistics of the error curve after each iteration: last, mean, least, most, square root of the mean square."""
    out, total, squares = [], 0.0, 0.0
    for i, e in enumerate(errors):
        total, squares = total + e, squares + e * e
        out.append({"iteration": i, "error": e, "mean": total / (i + 1), "min": min(errors[: i + 1]), "max": max(errors[: i + 1]), "rms": math.sqrt(squares / (i + 1))})
    return out


def metrics(errors: list[float], per_tile: DataFrame | None = None) -> str:
    """JSON text of a run: the curve and its statistics, and the last error of each tile (few rows)."""
    tiles = {} if per_tile is None else {str(r.tile): r.error for r in per_tile.toLocalIterator()}
    return json.dumps({"solver_metrics_per_tile": {"stats": observed(errors)}, "tile_errors": tiles}, indent=2)


def merged_groups(groups: DataFrame) -> DataFrame:
    """view, group of overlapping groups (group, view): groups that share a view become one, named by the
    smallest, until none do."""
    views = groups.select("group", "view").distinct()
    least = views.groupBy("view").agg(F.min("group").alias("a"))
    edges = views.join(least, "view").filter("group <> a").select("a", F.col("group").alias("b"))
    found = graph.components(edges).select(F.col("node").alias("group"), "component")
    return views.join(found, "group", "left").select("view", F.coalesce("component", "group").alias("group")).distinct()


def two_rounds(matches: DataFrame, weak: DataFrame, fixed, kind: str = "rigid", iterations: int = 10_000, plateau: int = 200) -> tuple[DataFrame, dict[str, list[float]]]:
    """Split alignment. Round 1 aligns the tiles of each component of the strong matches with its smallest tile
    fixed (a tile with weak matches alone is a component); round 2 moves whole components by the weak matches (tile, other, px.., qx.. as ``matches``), with
    the component of ``fixed`` fixed. A tile's model is its component's after its own."""
    group = written(graph.components(matches.select(F.col("tile").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("tile"), "component"), "groups")
    lone = weak.select(F.explode(F.array("tile", "other")).alias("tile")).distinct().join(group, "tile", "left_anti")  # each a component
    group = written(group.unionByName(lone.withColumn("component", F.col("tile"))), "groups")
    seeds = group.select(F.col("component").alias("tile")).distinct()
    first, errors = relax(matches, seeds, kind, iterations, plateau=plateau, start=prealign(matches, seeds))
    first = first.unionByName(identity(group.select("tile").join(first, "tile", "left_anti")))
    moved = _world(weak.select("tile", "other", *[f"{s}{a}" for s in "pq" for a in "xyz"]), first)
    of = lambda c, name: group.select(F.col("tile").alias(c), F.col("component").alias(name))
    between = moved.join(of("tile", "ga"), "tile").join(of("other", "gb"), "other").filter("ga <> gb")
    links = between.select(F.col("ga").alias("tile"), F.col("gb").alias("other"), *[F.col(f"w{a}").alias(f"p{a}") for a in "xyz"], *[F.col(f"v{a}").alias(f"q{a}") for a in "xyz"])
    anchor = group.filter(F.col("tile") == fixed).first()
    seed = anchor.component if anchor else fixed
    second, more = relax(links, [seed], "rigid", iterations, plateau=plateau, start=prealign(links, seed))
    by_tile = group.join(second.withColumnRenamed("tile", "component"), "component").drop("component")
    return concatenate(first, by_tile.select("tile", *NAMES)), {"tiles": errors, "components": more}
