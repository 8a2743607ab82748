"""Ordered operators: islands, positions, slices, near-equal parts and dealing out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def islands(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, first, last, label of the runs of consecutive integers of each group."""
    rows = df.select(group, value).distinct()
    run = F.col(value) - F.row_number().over(Window.partitionBy(group).orderBy(value))
    out = rows.withColumn("run", run).groupBy(group, "run").agg(F.min(value).alias("first"), F.max(value).alias("last"))
    return out.select(group, "first", "last", F.format_string("%d >-> %d", "first", "last").alias("label"))


def representative(df: DataFrame, group: str, key: str, *others: str) -> DataFrame:
    """group, key and others of the row with the smallest key of each group."""
    return df.groupBy(group).agg(F.min(key).alias(key), *[F.min_by(c, key).alias(c) for c in others])


def position(group: str, *order: str) -> Column:
    """0-based place of a row in its group."""
    return (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long")


def id_of(group: str, key: Column | str) -> Column:
    """0-based number of a key among the distinct keys of its group, in their order."""
    return (F.dense_rank().over(Window.partitionBy(group).orderBy(key)) - 1).cast("long")


def natural_order(df: DataFrame, group: str, name: str, into: str) -> DataFrame:
    """group and, comma-joined as ``into``, its names in the order of the first numbers in them."""
    number = F.regexp_extract(name, r"(\d+)", 1).cast("long")
    out = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(number.alias("n"), F.col(name).alias("name")))).alias("s"))
    return out.select(group, F.array_join(F.transform("s", lambda v: v["name"]), ",").alias(into))


def global_rank(df: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """``df`` with ``rank``, the 1-based place of every row in the order of an integer key, without moving
    all rows to one task: ranks within buckets of the key plus the rows in earlier buckets. Only the bucket
    counts, one row for ``width`` keys, meet in one place, in two levels of buckets."""
    dealt = df.withColumn("bucket_", F.floor(F.col(key) / width))
    sizes = dealt.groupBy("bucket_").agg(F.count("*").alias("n_")).withColumn("top_", F.floor(F.col("bucket_") / width))
    tops = sizes.groupBy("top_").agg(F.sum("n_").alias("n_top"))
    above = tops.select("top_", F.coalesce(F.sum("n_top").over(Window.orderBy("top_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above_"))
    inner = F.sum("n_").over(Window.partitionBy("top_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.withColumn("inner_", F.coalesce(inner, F.lit(0))).join(above, "top_").select("bucket_", (F.col("inner_") + F.col("above_")).alias("before_"))
    own = dealt.withColumn("own_", F.row_number().over(Window.partitionBy("bucket_").orderBy(key)))
    return own.join(before, "bucket_").withColumn("rank", F.col("own_") + F.col("before_")).drop("bucket_", "own_", "before_")


def rows_between(df: DataFrame, key: str, first: int, end: int) -> DataFrame:
    """``df`` with ``i``, the 0-based place in key order: rows ``first`` to ``end`` (not included)."""
    ranked = global_rank(df, key).withColumn("i", (F.col("rank") - 1).cast("long")).drop("rank")
    return ranked.filter((F.col("i") >= first) & (F.col("i") < end))


def round_robin(df: DataFrame, key: str, workers: int) -> DataFrame:
    """``df`` with ``worker``: rows dealt out in turn in key order."""
    return global_rank(df, key).withColumn("worker", (F.col("rank") - 1) % workers).drop("rank")


def near_equal_parts(df: DataFrame, length: str, parts: int, halo: int) -> DataFrame:
    """``df`` with i, lo, hi of the parts of [0, length): sizes differ by one at most, longer ones first, each
    grown by a halo; empty parts are left out."""
    n = F.col(length)
    rows = df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    edge = lambda i: i * F.floor(n / parts) + F.least(i, n % parts)
    lo, hi = edge(F.col("i")), edge(F.col("i") + 1)
    return rows.filter(hi > lo).withColumn("lo", F.greatest(lo - halo, F.lit(0)).cast("long")).withColumn("hi", F.least(hi + halo, n).cast("long"))


def ranks(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with ``name``, the 1-based place of every row in its group (without nulls), however many rows a group
    has: rows are sorted by range over all tasks, a task counts its own, and what earlier tasks hold of a group
    is added from a table of one row a task and group. Rows equal in group and order may come in any order."""
    keys = [*group, *order]
    dealt = df.withColumn("any_", F.monotonically_increasing_id()).repartitionByRange(*keys, "any_").sortWithinPartitions(*keys, "any_").drop("any_")
    cut = written(dealt.withColumn("at_", F.monotonically_increasing_id()), "sorted").withColumn("task_", F.shiftright("at_", 33))
    spans = cut.groupBy(*group, "task_").agg(F.min("at_").alias("lo_"), F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*group).orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    zero = spans.select(*group, "task_", (F.col("lo_") - before).alias("zero_"))
    return cut.join(zero, [*group, "task_"]).select(*df.columns, (F.col("at_") - F.col("zero_") + 1).alias(name))
