"""Least-squares models of matched points.

The sums over matches are native aggregates (one row a group leaves a task); solving happens on the
group rows alone: in Column arithmetic for the affine model, in a vectorised function over group
rows for the rigid one, which needs an eigenvector.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = "xyz"


def moment_sums(p: str = "p", q: str = "q") -> list[Column]:
    """n, sums, and the sums of products p p and p q of columns ``px..pz``, ``qx..qz``."""
    out = [F.count("*").alias("n")]
    out += [F.sum(f"{p}{a}").alias(f"sp{a}") for a in AXES] + [F.sum(f"{q}{a}").alias(f"sq{a}") for a in AXES]
    out += [F.sum(F.col(f"{p}{a}") * F.col(f"{q}{b}")).alias(f"s{a}{b}") for a in AXES for b in AXES]
    out += [F.sum(F.col(f"{p}{a}") * F.col(f"{p}{b}")).alias(f"t{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]]
    return out


def moments(matches: DataFrame, by: list[str]) -> DataFrame:
    return matches.groupBy(*by).agg(*moment_sums())


def _centred(a: str, b: str, first: str, second: str, raw: str) -> Column:
    return F.col(raw) - F.col(f"s{first}{a}") * F.col(f"s{second}{b}") / F.col("n")


def affine_fit(sums: DataFrame, by: list[str], least: int = 4) -> DataFrame:
    """m00..m23 that maps p to q with least squares; null where points do not span space."""
    A = {}
    for i, a in enumerate(AXES):
        for b in AXES[i:]:
            A[a + b] = A[b + a] = _centred(a, b, "p", "p", f"t{a}{b}")
    B = {a + b: _centred(a, b, "p", "q", f"s{a}{b}") for a in AXES for b in AXES}
    cof = lambda r, c: A[r[0] + c[0]] * A[r[1] + c[1]] - A[r[0] + c[1]] * A[r[1] + c[0]]
    pairs = {"x": "yz", "y": "zx", "z": "xy"}
    det = sum((A["x" + c] * cof(pairs["x"], pairs[c]) for c in AXES), F.lit(0.0))
    scale = A["xx"] * A["yy"] * A["zz"]
    good = (F.col("n") >= least) & (F.abs(det) > 1e-12 * F.abs(scale)) & (scale != 0)
    out = sums.withColumn("__det", F.when(good, det))
    inv = {r + c: cof(pairs[c], pairs[r]) / F.col("__det") for r in AXES for c in AXES}
    cols = {}
    for r, q in enumerate(AXES):
        for c, p in enumerate(AXES):
            cols[f"m{r}{c}"] = sum((B[k + q] * inv[k + p] for k in AXES), F.lit(0.0))
    out = out.select(*by, "n", *[F.col(f"sp{a}") / F.col("n") for a in AXES], *[(F.col(f"sq{a}") / F.col("n")).alias(f"__q{a}") for a in AXES], *[(F.col(f"sp{a}") / F.col("n")).alias(f"__p{a}") for a in AXES], *[v.alias(k) for k, v in cols.items()])
    t = {f"m{r}3": F.col(f"__q{q}") - sum((F.col(f"m{r}{c}") * F.col(f"__p{p}") for c, p in enumerate(AXES)), F.lit(0.0)) for r, q in enumerate(AXES)}
    names = [f"m{r}{c}" for r in range(3) for c in range(4)]
    return out.select(*by, "n", *[(t[m] if m in t else F.col(m)).alias(m) for m in names])


def rigid_from_moments(n: np.ndarray, sp: np.ndarray, sq: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Rotation and translation for each row of sums, by the unit quaternion that maximises the
    correlation; rows of twelve numbers. s holds sums of p_a q_b, row-major."""
    s = s.reshape(-1, 3, 3) - sp[:, :, None] * sq[:, None, :] / n[:, None, None]
    k = np.zeros((len(n), 4, 4))
    k[:, 0, 0] = np.trace(s, axis1=1, axis2=2)
    skew = np.stack([s[:, 1, 2] - s[:, 2, 1], s[:, 2, 0] - s[:, 0, 2], s[:, 0, 1] - s[:, 1, 0]], axis=1)
    k[:, 0, 1:] = k[:, 1:, 0] = skew
    k[:, 1:, 1:] = s + s.transpose(0, 2, 1) - k[:, 0, 0][:, None, None] * np.eye(3)
    w, x, y, z = np.linalg.eigh(k)[1][:, :, -1].T
    r = np.stack(
        [
            w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y),
            2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z,
        ], axis=1,
    ).reshape(-1, 3, 3)
    t = sq / n[:, None] - np.einsum("nij,nj->ni", r, sp / n[:, None])
    return np.concatenate([r, t[:, :, None]], axis=2).reshape(-1, 12)


def rigid_fit(sums: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """m00..m23 of the rigid motion from p to q of each group with ``least`` matches."""
    kinds = ", ".join(f"{b} {sums.schema[b].dataType.simpleString()}" for b in by)
    names = [f"m{r}{c}" for r in range(3) for c in range(4)]

    def solve(frames):
        for f in frames:
            m = rigid_from_moments(
                f["n"].to_numpy(float), f[[f"sp{a}" for a in AXES]].to_numpy(float), f[[f"sq{a}" for a in AXES]].to_numpy(float),
                f[[f"s{a}{b}" for a in AXES for b in AXES]].to_numpy(float),
            )
            out = f[[*by, "n"]].copy()
            for i, c in enumerate(names):
                out[c] = m[:, i]
            yield out

    return sums.filter(F.col("n") >= least).mapInPandas(solve, f"{kinds}, n long, " + ", ".join(f"{c} double" for c in names))
