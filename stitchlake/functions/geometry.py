"""Affine and box geometry as Column expressions; everything stays in generated JVM code.

An affine model is a list of twelve Columns (or numbers), row-major 3 x 4. Coordinates are x, y, z.
A box is (lower, upper), each a list of three Columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Affine = list
IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
NAMES = [f"m{r}{c}" for r in range(3) for c in range(4)]


def col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def model(prefix: str = "") -> Affine:
    """The twelve columns ``m00`` to ``m23``, with a prefix."""
    return [F.col(prefix + n) for n in NAMES]


def of_array(a: Column) -> Affine:
    return [F.get(a, F.lit(i)) for i in range(12)]


def apply(m: Affine, p: list) -> list[Column]:
    """m applied to the point p."""
    m = [col(v) for v in m]
    return [m[4 * r] * p[0] + m[4 * r + 1] * p[1] + m[4 * r + 2] * p[2] + m[4 * r + 3] for r in range(3)]


def compose(a: Affine, b: Affine) -> list[Column]:
    """a after b."""
    a, b = [col(v) for v in a], [col(v) for v in b]
    out = []
    for r in range(3):
        for c in range(4):
            v = a[4 * r] * b[c] + a[4 * r + 1] * b[4 + c] + a[4 * r + 2] * b[8 + c]
            out.append(v + a[4 * r + 3] if c == 3 else v)
    return out


def compose_all(models: Column) -> Column:
    """Product, left to right, of an array of twelve-number arrays."""
    start = F.array(*[F.lit(float(v)) for v in IDENTITY])
    return F.aggregate(models, start, lambda acc, m: F.array(*compose(of_array(acc), of_array(m))))


def determinant(m: Affine) -> Column:
    a, b, c, _, d, e, f, _, g, h, i, _ = [col(v) for v in m]
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def inverse(m: Affine) -> list[Column]:
    """Closed-form inverse; all null where the model is singular."""
    det = F.nullif(determinant(m), F.lit(0.0))
    a, b, c, x, d, e, f, y, g, h, i, z = [col(v) for v in m]
    r = [
        (e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det,
        (f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det,
        (d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det,
    ]
    t = [-(r[3 * k] * x + r[3 * k + 1] * y + r[3 * k + 2] * z) for k in range(3)]
    return [*r[0:3], t[0], *r[3:6], t[1], *r[6:9], t[2]]


def blend(a: Affine, b: Affine, share: float) -> list[Column]:
    """(1 - share) a + share b."""
    return [col(x) * (1 - share) + col(y) * share for x, y in zip(a, b, strict=True)]


def image_of_box(m: Affine, lower: list, upper: list) -> tuple[list[Column], list[Column]]:
    """Smallest axis-aligned box around the image of a box."""
    m = [col(v) for v in m]
    lo, hi = [], []
    for r in range(3):
        ends = [(m[4 * r + c] * lower[c], m[4 * r + c] * upper[c]) for c in range(3)]
        lo.append(reduce(lambda s, e: s + F.least(*e), ends, m[4 * r + 3]))
        hi.append(reduce(lambda s, e: s + F.greatest(*e), ends, m[4 * r + 3]))
    return lo, hi


def padded(lower: list, upper: list) -> tuple[list[Column], list[Column]]:
    """Integer box with a margin of one; halves round to even."""
    return [(F.rint(v) - 1).cast("long") for v in lower], [(F.rint(v) + 1).cast("long") for v in upper]


def intersection(al: list, au: list, bl: list, bu: list) -> tuple[list[Column], list[Column]]:
    return [F.greatest(x, y) for x, y in zip(al, bl, strict=True)], [F.least(x, y) for x, y in zip(au, bu, strict=True)]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def overlaps(al: list, au: list, bl: list, bu: list, touching: bool = True) -> Column:
    """Whether boxes meet; ``touching`` counts common faces."""
    if touching:
        return _all([(x <= v) & (y <= u) for x, u, y, v in zip(al, au, bl, bu, strict=True)])
    return _all([(x < v) & (y < u) for x, u, y, v in zip(al, au, bl, bu, strict=True)])


def contains_point(lower: list, upper: list, p: list) -> Column:
    """Both ends included."""
    return _all([v.between(a, b) for a, b, v in zip(lower, upper, p, strict=True)])


def contains_box(lower: list, upper: list, il: list, iu: list) -> Column:
    return _all([(x >= a) & (y <= b) for a, b, x, y in zip(lower, upper, il, iu, strict=True)])


def span(lower: Column, upper: Column) -> Column:
    """Length of an interval as chunk readers count it."""
    return F.when(lower == 0, upper + 1).otherwise(upper - lower)


def voxels(lower: list, upper: list) -> Column:
    return reduce(lambda x, y: x * y, [(b - a + 1).cast("long") for a, b in zip(lower, upper, strict=True)])


def corners(lower: list, upper: list) -> Column:
    """Array of the eight corners as structs (x, y, z)."""
    return F.array(*[F.struct(*[(upper if bits >> k & 1 else lower)[k].alias("xyz"[k]) for k in range(3)]) for bits in range(8)])


def origin_shift(level: Column) -> Column:
    """Where the first voxel of a pyramid level lies in voxels of level 0: half a voxel of every step before it."""
    return 0.5 * (F.pow(F.lit(2.0), level) - 1)


def half_pixel(scale: float) -> list[float]:
    """Model of a down-sampling: scale about pixel centres."""
    t = 0.5 * (scale - 1)
    return [scale, 0.0, 0.0, t, 0.0, scale, 0.0, t, 0.0, 0.0, scale, t]


def shear(degrees: float) -> list[float]:
    import math

    return [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, math.tan(math.radians(degrees)), 0.0, 1.0, 0.0]


def pyramid_level(xy: Column, z: Column, most: int = 7) -> Column:
    """Largest level whose factor fits into both down-samplings."""
    level = lambda v: F.floor(F.log2(F.greatest(v, F.lit(1)).cast("double")) + 1e-9)
    return F.least(level(xy), level(z), F.lit(most)).cast("int")


def halved(n: Column, times: Column) -> Column:
    """n halved repeatedly, rounding up."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(times, F.lit(1))), n.cast("long"), lambda v, k: F.when(k <= times, F.ceil(v / 2)).otherwise(v))


def round_up(v: Column, step: int) -> Column:
    return (F.ceil(v / F.lit(float(step))) * step).cast("long")


def last_tile(length: Column, size: Column, overlap: Column) -> Column:
    """Size of the last tile when tiles of ``size`` with ``overlap`` cover ``length``."""
    return overlap + (length - 2 * (size - overlap) - overlap) % (size - overlap)


def distance2(p: list, q: list) -> Column:
    return reduce(lambda s, d: s + d, [(a - b) * (a - b) for a, b in zip(p, q, strict=True)])


def domain_net(models: Column) -> Column:
    """Net model of a list of models whose translations are given in the domain of the first: the
    product of the linear parts, last on the left, and the translations taken back to the start."""
    zero = [0, 1, 2, 4, 5, 6, 8, 9, 10]

    def step(acc, m):
        a, b = of_array(acc["m"]), of_array(m)
        back = inverse(a)
        moved = [back[4 * r] * b[3] + back[4 * r + 1] * b[7] + back[4 * r + 2] * b[11] for r in range(3)]
        linear = [v if i in zero else F.lit(0.0) for i, v in enumerate(b)]
        return F.struct(F.array(*compose(linear, a)).alias("m"), F.array(*[F.get(acc["t"], F.lit(i)) + moved[i] for i in range(3)]).alias("t"))

    start = F.struct(F.array(*[F.lit(v) for v in IDENTITY]).alias("m"), F.array(*[F.lit(0.0)] * 3).alias("t"))
    put = lambda acc: F.array(*[F.get(acc["t"], F.lit(i // 4)) if i % 4 == 3 else F.get(acc["m"], F.lit(i)) for i in range(12)])
    return F.aggregate(models, start, step, put)
