"""Point matching between views: descriptors, candidates, consensus.

Candidate search stays in native joins; only the consensus, a random search over one pair's
candidates, runs in numpy, one pair of views a call. A pair's candidates are bounded by the points
that a detector keeps of a view.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fit
from .spatial import knn_self, nearest_ratio


def descriptors(points: DataFrame, view: str, key: str, p: list[str], neighbours: int = 3) -> DataFrame:
    """view, key, d0..: vectors from each point to its nearest neighbours in order (translation invariant)."""
    near = knn_self(points, view, key, p, neighbours)
    at = points.select(view, F.col(key).alias("neighbour"), *[F.col(c).alias(f"__n{c}") for c in p])
    both = near.join(at, [view, "neighbour"]).join(points.select(view, key, *p), [view, key])
    cols = [F.max(F.when(F.col("rank") == r + 1, F.col(f"__n{c}") - F.col(c))).alias(f"d{len(p) * r + i}") for r in range(neighbours) for i, c in enumerate(p)]
    return both.groupBy(view, key).agg(*cols).dropna()


def candidates(a: DataFrame, b: DataFrame, pair: str, key: str, radius: float, significance: float, n: int = 9) -> DataFrame:
    """pair, ia, ib: descriptor matches of one pair's sides that pass the ratio test. Sides have the
    columns pair, key, d0..; distance is the mean squared length of vector differences."""
    left = a.select(pair, F.col(key).alias("ia"), *[F.col(f"d{i}") for i in range(n)])
    right = b.select(pair, F.col(key).alias("ib"), *[F.col(f"d{i}").alias(f"e{i}") for i in range(n)])
    # the first vector alone is within the radius bound; the residual covers all
    bound = radius * (n // 3) ** 0.5
    d2 = sum(((F.col(f"d{i}") - F.col(f"e{i}")) * (F.col(f"d{i}") - F.col(f"e{i}")) for i in range(n)), F.lit(0.0)) / (n // 3)
    within = F.when(d2 <= radius * radius, d2)
    return nearest_ratio(left, right, [pair], "ia", "ib", ["d0", "d1", "d2"], ["e0", "e1", "e2"], within, bound, significance * significance, 1.0 / (n // 3))


def _rigid(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    one = lambda v: np.array([v], dtype=float)
    return fit.rigid_from_moments(one(len(p)), one(p.sum(0)), one(q.sum(0)), one((p.T @ q).ravel()))[0].reshape(3, 4)


def _affine(p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    pc, qc = p.mean(0), q.mean(0)
    a = (p - pc).T @ (p - pc)
    if abs(np.linalg.det(a)) <= 1e-12 * np.prod(np.diag(a)):
        return None
    m = np.linalg.solve(a, (p - pc).T @ (q - qc)).T
    return np.column_stack([m, qc - m @ pc])


def fit_model(kind: str, p: np.ndarray, q: np.ndarray, regularization: float = 0.0) -> np.ndarray | None:
    """3 x 4 model of a kind: rigid, affine, or affine drawn towards rigid by ``regularization``."""
    if len(p) < (3 if kind == "rigid" else 4):
        return None
    r = _rigid(p, q)
    if kind == "rigid":
        return r
    a = _affine(p, q)
    return None if a is None else (1 - regularization) * a + regularization * r


def _terms(kind: str, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """One row a match, whose sums over matches are what a fit needs: 1, p, q, products of p and q, of p and p."""
    t = [np.ones((len(p), 1)), p, q, (p[:, :, None] * q[:, None, :]).reshape(len(p), 9)]
    return np.hstack(t if kind == "rigid" else [*t, (p[:, :, None] * p[:, None, :]).reshape(len(p), 9)])


def _fit_sums(kind: str, sums: np.ndarray, regularization: float = 0.0) -> np.ndarray:
    """One model (12 numbers) for each row of sums of ``_terms``; NaN where none can be fitted."""
    n, sp, sq, s = sums[:, 0], sums[:, 1:4], sums[:, 4:7], sums[:, 7:16]
    out = fit.rigid_from_moments(n, sp, sq, s)
    if kind != "rigid":
        with np.errstate(all="ignore"):
            mp, mq = sp / n[:, None], sq / n[:, None]
            a = sums[:, 16:].reshape(-1, 3, 3) - n[:, None, None] * mp[:, :, None] * mp[:, None, :]
            b = s.reshape(-1, 3, 3) - n[:, None, None] * mp[:, :, None] * mq[:, None, :]
            fine = np.abs(np.linalg.det(a)) > 1e-12 * np.prod(np.diagonal(a, axis1=1, axis2=2), axis=1)
        m = np.full((len(sums), 3, 4), np.nan)
        if fine.any():
            linear = np.linalg.solve(a[fine], b[fine]).transpose(0, 2, 1)
            m[fine] = np.concatenate([linear, (mq[fine] - np.einsum("tij,tj->ti", linear, mp[fine]))[:, :, None]], axis=2)
        out = (1 - regularization) * m.reshape(-1, 12) + regularization * out
    out[n < (3 if kind == "rigid" else 4)] = np.nan
    return out


def _fit_all(kind: str, w: np.ndarray, p: np.ndarray, q: np.ndarray, regularization: float = 0.0) -> np.ndarray:
    """One model (12 numbers) for each row of weights ``w`` (0 or 1) over the matches; NaN where none can be fitted."""
    return _fit_sums(kind, w @ _terms(kind, p, q), regularization)


def _samples(rng: np.random.Generator, n: int, k: int, trials: int) -> np.ndarray:
    """``trials`` rows of k different places."""
    pick = rng.integers(0, n, (trials, k))
    while len(bad := np.flatnonzero((np.diff(np.sort(pick, axis=1), axis=1) == 0).any(axis=1))):
        pick[bad] = rng.integers(0, n, (len(bad), k))
    return pick


#: Places of trials drawn together, and distances that are worked on at once.
_DISTANCES, _AT_ONCE = 1 << 20, 1 << 17
#: Shares of a pair's trials, and tasks that the shares of all pairs are dealt to.
PARTS, TASKS = 16, 256


def _within(m: np.ndarray, p: np.ndarray, q: np.ndarray, terms: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """For models ``m``: masks of the matches strictly below epsilon, and the sums of their terms."""
    inside, sums = np.empty((len(m), len(p)), dtype=bool), np.zeros((len(m), terms.shape[1]))
    m = m.reshape(-1, 3, 4)
    step = max(1, _AT_ONCE // len(m))
    for lo in range(0, len(p), step):
        at = slice(lo, lo + step)
        far = np.zeros((len(m), len(p[at])))
        for d in range(3):
            off = m[:, d, :3] @ p[at].T
            off += m[:, d, 3:]
            off -= q[at, d]
            off *= off
            far += off
        with np.errstate(invalid="ignore"):
            np.less(far, epsilon * epsilon, out=inside[:, at])
        sums += inside[:, at].astype(float) @ terms[at]
    return inside, sums


def _centred(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return p - p.mean(axis=0), q - q.mean(axis=0)  # moments of centred points keep their digits


def _grow(kind: str, pick: np.ndarray, p: np.ndarray, q: np.ndarray, terms: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """The inlier sets of samples, grown by refitting while they gain, and their sizes."""
    inside, size = np.zeros((len(pick), len(p)), dtype=bool), np.zeros(len(pick), dtype=int)
    active, sums = np.arange(len(pick)), terms[pick].sum(axis=1)
    while len(active):
        now, sums = _within(_fit_sums(kind, sums), p, q, terms, epsilon)
        grown = sums[:, 0] > size[active]
        active, now, sums = active[grown], now[grown], sums[grown]
        inside[active], size[active] = now, sums[:, 0]
    return inside, size


def best_sample(p: np.ndarray, q: np.ndarray, kind: str, trials: int, epsilon: float, seed: int, sample: int | None = None, part: int = 0, parts: int = 1) -> tuple[int, int, list[int]]:
    """(size, batch, sample) of the first of the largest inlier sets among the trials of every ``parts``-th batch from
    ``part`` on. Trials are drawn, fitted and grown many at a time; all parts draw the same."""
    n, k = len(p), sample or (3 if kind == "rigid" else 4)
    best: tuple[int, int, list[int]] = (0, 0, [])
    if n < k:
        return best
    rng = np.random.default_rng(seed)
    p, q = _centred(p, q)
    terms, at_once = _terms(kind, p, q), max(1, _DISTANCES // n)
    for batch, lo in enumerate(range(0, trials, at_once)):
        pick = _samples(rng, n, k, min(at_once, trials - lo))
        if batch % parts == part:
            _, size = _grow(kind, pick, p, q, terms, epsilon)
            first = int(size.argmax())
            if size[first] > best[0]:
                best = int(size[first]), batch, pick[first].tolist()
    return best


def grown(p: np.ndarray, q: np.ndarray, kind: str, epsilon: float, least: int, ratio: float, pick: list[int]) -> np.ndarray:
    """Mask of the inlier set grown from a sample; empty if it is smaller than ``least`` or not more than ``ratio`` of
    the candidates."""
    if len(pick) and len(p) >= least:
        p, q = _centred(p, q)
        inside = _grow(kind, np.array([pick]), p, q, _terms(kind, p, q), epsilon)[0][0]
        if inside.sum() >= least and inside.sum() > ratio * len(p):
            return inside
    return np.zeros(len(p), dtype=bool)


def consensus(p: np.ndarray, q: np.ndarray, kind: str, trials: int, epsilon: float, least: int, ratio: float, seed: int, sample: int | None = None) -> np.ndarray:
    """Mask of the largest inlier set found (strictly below epsilon), grown by refitting; empty if
    it is smaller than ``least`` or not more than ``ratio`` of the candidates."""
    return grown(p, q, kind, epsilon, least, ratio, best_sample(p, q, kind, trials, epsilon, seed, sample)[2])


def ransac(matches: DataFrame, pair: str, key: str, kind: str = "rigid", trials: int = 10_000, epsilon: float = 10.0, least: int = 6, ratio: float = 0.1, trim: float = 4.0, seed: int = 0) -> DataFrame:
    """(pair, key, error) of each pair's inliers, trimmed at ``trim`` times their median error.
    Seeds depend on the pair alone, so a repeated task gives the same rows. A pair's trials are cut into ``PARTS``
    shares, each of which holds the pair's candidates; the best sample of all is grown once more for its inliers."""
    kinds = {c: matches.schema[c].dataType.simpleString() for c in (pair, key)}
    ends = ["px", "py", "pz", "qx", "qy", "qz"]
    parts = PARTS

    def sides(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return f[ends[:3]].to_numpy(float), f[ends[3:]].to_numpy(float)

    def search(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key)
        of = seed + zlib.crc32(str(f[pair].iloc[0]).encode())
        size, batch, pick = best_sample(*sides(f), kind, trials if len(f) >= least else 0, epsilon, of, part=int(f["__part"].iloc[0]), parts=parts)
        return pd.DataFrame({pair: f[pair].iloc[:1], "size": [size], "batch": [batch], "pick": [pick]})

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key)
        p, q = sides(f)
        inside = grown(p, q, kind, epsilon, least, ratio, f["__pick"].iloc[0])
        m = fit_model(kind, p[inside], q[inside])
        err = np.full(len(p), np.inf)
        if m is not None:
            err = np.linalg.norm(p @ m[:, :3].T + m[:, 3] - q, axis=1)
            while inside.sum() >= least:
                keep = inside & (err <= trim * np.median(err[inside]))
                if keep.sum() == inside.sum():
                    break
                inside = keep
                m = fit_model(kind, p[inside], q[inside])
                if m is None:
                    break
                err = np.linalg.norm(p @ m[:, :3].T + m[:, 3] - q, axis=1)
        out = f.loc[inside, [pair, key]].copy()
        out["error"] = err[inside]
        return out

    rows = matches.select(pair, key, *ends)
    every = rows.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # a number of its own: small rows that cost much time would be coalesced into one task
    found = every.repartition(TASKS, pair, "__part").groupBy(pair, "__part").applyInPandas(search, f"{pair} {kinds[pair]}, size long, batch long, pick array<long>")
    best = found.groupBy(pair).agg(F.max_by("pick", F.struct("size", -F.col("batch"))).alias("__pick")).withColumnRenamed(pair, "__pair")
    return rows.join(best, F.col(pair).eqNullSafe(F.col("__pair"))).groupBy(pair).applyInPandas(run, f"{pair} {kinds[pair]}, {key} {kinds[key]}, error double")
