"""Statistics of detections and matches, and validation gates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def detection_stats(points: DataFrame, view: str, intensity: str, axes: list[str]) -> DataFrame:
    """Per view: n, range, mean and population deviation of intensity and axes, density per 1e9 voxels."""
    extent = reduce(lambda a, b: a * b, [F.max(a) - F.min(a) for a in axes])
    cols = [F.count("*").alias("n")]
    for name, c in [("i", intensity), *((a, a) for a in axes)]:
        cols += [F.min(c).alias(f"min_{name}"), F.max(c).alias(f"max_{name}"), F.avg(c).alias(f"mean_{name}"), F.stddev_pop(c).alias(f"std_{name}")]
    cols.append(F.coalesce(F.try_divide(F.count("*").cast("double"), extent / 1e9), F.lit(0.0)).alias("density"))
    return points.groupBy(view).agg(*cols)


def match_stats(matches: DataFrame) -> DataFrame:
    """One row over the points of both sides: count, bounds, sample deviations, their mean, box volume."""
    side = lambda s: F.struct(*[F.col(f"{s}{a}").alias(a) for a in "xyz"])
    p = matches.select(F.explode(F.array(side("p"), side("q"))).alias("p")).select("p.*")
    std = [F.stddev_samp(a) for a in "xyz"]
    return p.agg(
        F.count("*").alias("n"), (F.round(F.min("x"), 2) + F.lit(0.0)).alias("min_x"), F.round(F.max("x"), 2).alias("max_x"),
        *[F.round(s, 2).alias(f"std_{a}") for s, a in zip(std, "xyz", strict=True)],
        F.round((std[0] + std[1] + std[2]) / 3, 2).alias("mean_std"),
        F.round(reduce(lambda x, y: x * y, [F.max(a) - F.min(a) for a in "xyz"]), 2).alias("volume"),
    )


def _origin(points: DataFrame, axes: list[str], size: list[float]) -> DataFrame:
    cells = reduce(lambda x, y: x * y, [F.ceil((F.max(a) - F.min(a)) / s) + 1 for a, s in zip(axes, size, strict=True)])
    return points.agg(*[F.min(a).alias(f"{a}0") for a in axes], cells.cast("long").alias("cells"))


def voxel_counts(points: DataFrame, axes: list[str], size: list[float], with_cells: bool = False) -> DataFrame:
    """Points per occupied voxel of a grid that starts at the smallest coordinates (one broadcast row)."""
    at = points.join(F.broadcast(_origin(points, axes, size)))
    index = [F.floor((F.col(a) - F.col(f"{a}0")) / s).alias(f"i{a}") for a, s in zip(axes, size, strict=True)]
    out = at.groupBy(*index, *(["cells"] if with_cells else [])).agg(F.count("*").alias("n"))
    return out.select(*[F.col(f"i{a}") for a in axes], "n", *(["cells"] if with_cells else []))


def voxel_stats(points: DataFrame, axes: list[str], size: list[float]) -> DataFrame:
    """Distribution of the counts over occupied voxels. Entropy needs only n and n ln n:
    -sum(n/t ln(n/t)) = ln t - sum(n ln n)/t."""
    v = voxel_counts(points, axes, size, True)
    t = F.sum("n")
    return v.agg(
        F.max("cells").alias("cells"), F.count("*").alias("occupied"), t.alias("total"),
        F.round(F.avg("n"), 4).alias("mean"), F.round(F.stddev_pop("n"), 4).alias("std"), F.round(F.stddev_pop("n") / F.avg("n"), 4).alias("cv"),
        F.round(100 * F.count("*") / F.max("cells"), 4).alias("occupancy"), F.round(F.ln(t) - F.sum(F.col("n") * F.ln("n")) / t, 4).alias("entropy"),
        F.max("n").alias("most"), F.min("n").alias("least"), F.round(F.skewness("n"), 4).alias("skew"), F.round(F.kurtosis("n"), 4).alias("kurtosis"),
    )


def error() -> Column:
    """Distance of the two points of a match."""
    return F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(f"p{a}") - F.col(f"q{a}"), F.lit(2.0)) for a in "xyz"]))


def with_error(matches: DataFrame) -> DataFrame:
    return matches.withColumn("e", error())


#: Half the width of a bin of ``kde`` in bandwidths, terms of its expansion, and bandwidths beyond which a kernel counts as 0.
HALF_BIN, TERMS, REACH = 0.25, 12, 7.0


def _hermite(n: int) -> list[list[float]]:
    """Coefficients of the probabilists' Hermite polynomials 0 .. n - 1, lowest power first."""
    out = [[1.0], [0.0, 1.0]]
    while len(out) < n:
        last, m = out[-1], len(out) - 1
        out.append([a - m * b for a, b in zip([0.0, *last], [*out[-2], 0.0, 0.0], strict=True)])
    return [h + [0.0] * (n - len(h)) for h in out[:n]]


def kde(matches: DataFrame, pair: str, key: str, bandwidth: float) -> DataFrame:
    """Gaussian density of each pair's standardised match distances at its own matches.

    Distances are merged into bins half a bandwidth wide, each kept as the sums of the powers of its members'
    offsets from its middle: a kernel sum over the bin is ``exp(-a^2/2)`` times a Hermite series in the
    distance a to the middle. ``TERMS`` terms leave an error below 1e-11 of a kernel's height, and kernels
    beyond ``REACH`` (2e-11) are left out. A match meets the bins within reach, some thirty, instead of the matches of its pair.
    """
    e = with_error(matches).select(pair, key, "e")
    stats = e.groupBy(pair).agg(F.avg("e").alias("mean_"), F.coalesce(F.nullif(F.stddev_pop("e"), F.lit(0.0)), F.lit(1.0)).alias("std_"), F.count("*").alias("n_"))
    width = 2 * HALF_BIN
    s = e.join(stats, pair).withColumn("v", (F.col("e") - F.col("mean_")) / F.col("std_") / bandwidth)
    s = s.select(pair, key, "v", "n_", F.floor(F.col("v") / width).alias("bin"))
    off = F.col("v") - (F.col("bin") + 0.5) * width
    sums = s.groupBy(pair, "bin").agg(*[F.sum(F.pow(off, F.lit(float(m)))).alias(f"m{m}") for m in range(TERMS)])
    series = _hermite(TERMS)
    power = [sum((F.col(f"m{m}") * (series[m][k] / math.factorial(m)) for m in range(k, TERMS)), F.lit(0.0)).alias(f"c{k}") for k in range(TERMS)]
    steps = math.ceil(REACH / width) + 1
    near = F.explode(F.sequence(F.col("bin") - steps, F.col("bin") + steps)).alias("bin")
    bins = sums.select(pair, ((F.col("bin") + 0.5) * width).alias("middle"), *power, near)
    a = F.col("v") - F.col("middle")
    total = F.lit(0.0)
    for k in reversed(range(TERMS)):
        total = total * a + F.col(f"c{k}")
    kernel = F.when(F.abs(a) <= REACH + width, F.exp(-a * a / 2) * total).otherwise(F.lit(0.0))
    at = s.join(bins, [pair, "bin"]).groupBy(pair, key).agg((F.sum(kernel) / F.first("n_") / (bandwidth * math.sqrt(2 * math.pi))).alias("f"))
    return at.groupBy(pair).agg(
        F.round(F.min("f"), 6).alias("min_f"), F.round(F.max("f"), 6).alias("max_f"), F.round(F.avg("f"), 6).alias("mean_f"),
        F.round(F.percentile("f", F.lit(0.5)), 6).alias("median_f"), F.round(F.stddev_pop("f"), 6).alias("std_f"),
    )


def tile_error(matches: DataFrame, tile: str) -> DataFrame:
    """Mean distance and weighted mean square of each tile, with mean, least and largest over tiles (one broadcast row)."""
    d = with_error(matches).groupBy(tile).agg(F.avg("e").alias("e"), (F.sum(F.col("weight") * F.col("e") * F.col("e")) / F.sum("weight")).alias("w"))
    whole = d.agg(F.round(F.avg("e"), 4).alias("mean_error"), F.round(F.min("e"), 4).alias("min_error"), F.round(F.max("e"), 4).alias("max_error"))
    return d.join(F.broadcast(whole)).select(tile, F.round("e", 4).alias("distance"), F.round("w", 4).alias("weighted"), "mean_error", "min_error", "max_error")


def median_trim(matches: DataFrame, pair: str, err: str, factor: float) -> DataFrame:
    """Matches within ``factor`` times the median error of their pair."""
    middle = matches.groupBy(pair).agg(F.percentile(err, F.lit(0.5)).alias("__m"))
    return matches.join(middle, pair).filter(F.col(err) <= F.col("__m") * factor).drop("__m")


def consensus(matches: DataFrame, pair: str, err: str, epsilon: float, least: int, ratio: float) -> DataFrame:
    """Inliers (strictly below epsilon) of each pair, and whether there are enough."""
    inliers = F.count_if(F.col(err) < epsilon)
    return matches.groupBy(pair).agg(F.count("*").alias("candidates"), inliers.alias("inliers"), ((inliers >= least) & (inliers > F.lit(ratio) * F.count("*"))).alias("good"))


def gates(stats: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(gate, value, ok) of named statistics against [lo, hi]; None is unbounded."""
    ok = F.lit(True)
    for name, (lo, hi) in bounds.items():
        here = F.lit(True)
        if lo is not None:
            here = here & (F.col("value") >= lo)
        if hi is not None:
            here = here & (F.col("value") <= hi)
        ok = ok & ((F.col("gate") != name) | here)
    return stats.withColumn("ok", ok)


def alignment_gate(metrics: str, least: float | None = None, most: float | None = None) -> list[str]:
    """What an alignment violates, from the JSON text of its metrics (``alignment errors``: minimum and
    maximum): nothing if it passes. Metrics without that entry are an error."""
    import json

    found = json.loads(metrics).get("alignment errors")
    if found is None:
        raise KeyError("no alignment errors have been saved")
    out = []
    if least is not None and found["minimum error"] < least:
        out.append(f"minimum error {found['minimum error']} is below {least}")
    if most is not None and found["maximum error"] > most:
        out.append(f"maximum error {found['maximum error']} is above {most}")
    return out
