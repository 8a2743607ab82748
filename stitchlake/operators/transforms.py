"""Views' transform lists reduced to one model each (view keys, seq, kind, affine array<double> of 12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def identity() -> Column:
    return F.array(*[F.lit(float(v)) for v in G.IDENTITY])


def in_order(condition: Column | None = None, seq: str = "seq", affine: str = "affine") -> Column:
    """Aggregate: the models of a view in order of ``seq``, those that meet the condition."""
    row = F.struct(F.col(seq).alias("seq"), F.col(affine).alias("m"))
    return F.transform(F.sort_array(F.collect_list(row if condition is None else F.when(condition, row))), lambda x: x["m"])


def composed(condition: Column | None = None, seq: str = "seq", affine: str = "affine") -> Column:
    """Aggregate: the ordered matrix product of a view's models; identity without any."""
    return G.compose_all(in_order(condition, seq, affine))


def latest(condition: Column, seq: str = "seq", affine: str = "affine") -> Column:
    """Aggregate: the last model that meets the condition; null without any."""
    return F.max_by(F.when(condition, F.col(affine)), F.when(condition, F.col(seq)))


def product(a: Column, b: Column) -> Column:
    """Matrix product of two models as arrays."""
    return F.array(*G.compose(G.of_array(a), G.of_array(b)))


def rotation_after_calibration(transforms: DataFrame, by: list[str], calibration: Column, rotation: Column) -> DataFrame:
    """by, affine: the last rotation times the last calibration; the rotation alone if nothing is calibrated."""
    last = transforms.groupBy(*by).agg(latest(rotation).alias("r"), latest(calibration).alias("c"))
    r, c = (F.coalesce(F.col(x), identity()) for x in "rc")
    return last.select(*by, F.when(F.col("c").isNull(), r).otherwise(product(r, c)).alias("affine"))


def rotations_after_grid(transforms: DataFrame, by: list[str], rotation: Column, grid: Column) -> DataFrame:
    """by, affine: the product of all rotations times the product of all moves to the nominal grid."""
    both = transforms.groupBy(*by).agg(composed(rotation).alias("r"), composed(grid).alias("g"))
    return both.select(*by, product(F.col("r"), F.col("g")).alias("affine"))


def net(transforms: DataFrame, by: list[str]) -> DataFrame:
    """by, affine: the ordered product of the linear parts with the plain sum of the translations."""
    linear = F.transform(in_order(), lambda m: F.array(*[F.lit(0.0) if i % 4 == 3 else F.get(m, F.lit(i)) for i in range(12)]))
    shift = [F.sum(F.get("affine", F.lit(4 * r + 3))).alias(f"t{r}") for r in range(3)]
    found = transforms.groupBy(*by).agg(G.compose_all(linear).alias("m"), *shift)
    return found.select(*by, F.array(*[F.col(f"t{i // 4}") if i % 4 == 3 else F.get("m", F.lit(i)) for i in range(12)]).alias("affine"))
