"""Registry of queries, and the views of the driver's tables that they use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

__all__ = ["ORACLES", "QUERIES", "query", "shared_folder", "table"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the DuckDB SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pts(spark: SparkSession, sf: str) -> DataFrame:
    """Points: vec_id, label (the view), x, y, z, intensity."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf, "embeddings").select("vec_id", "label", *[(at(i) * 1000).alias(a) for i, a in enumerate("xyz")], at(3).alias("intensity"))


PTS = """pts AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y,
  CAST(embedding[3] AS DOUBLE) * 1000 AS z, CAST(embedding[4] AS DOUBLE) AS intensity FROM embeddings)"""


def evt(spark: SparkSession, sf: str) -> DataFrame:
    """Grid points: event_id, view_id, x, y (hour), z (day)."""
    return table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 16).alias("view_id"), F.col("value").alias("x"),
        F.hour("ts").cast("double").alias("y"), F.dayofmonth("ts").cast("double").alias("z"),
    )


EVT = """evt AS (SELECT event_id, user_id % 16 AS view_id, value AS x, CAST(hour(ts) AS DOUBLE) AS y, CAST(day(ts) AS DOUBLE) AS z FROM events)"""


def tiles(spark: SparkSession, sf: str, prefix: str = "") -> DataFrame:
    """Tiles: k, grp, l0..l2, u0..u2."""
    k = F.col("s_suppkey")
    lower = [(k % 10) * 100, F.floor(k / 10) * 100, F.lit(0)]
    return table(spark, sf, "supplier").select(
        k.alias(f"{prefix}k"), F.col("s_nationkey").alias(f"{prefix}grp"),
        *[v.cast("long").alias(f"{prefix}l{d}") for d, v in enumerate(lower)],
        *[(v + 120).cast("long").alias(f"{prefix}u{d}") for d, v in enumerate(lower)],
    )


TILES = """tiles AS (SELECT s_suppkey AS k, s_nationkey AS grp, (s_suppkey % 10) * 100 AS l0, (s_suppkey // 10) * 100 AS l1, CAST(0 AS BIGINT) AS l2,
  (s_suppkey % 10) * 100 + 120 AS u0, (s_suppkey // 10) * 100 + 120 AS u1, CAST(120 AS BIGINT) AS u2 FROM supplier)"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("n"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"))


BOXES = "boxes AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS n, p_retailprice AS price, p_brand AS brand FROM part)"


def matched(spark: SparkSession, sf: str) -> DataFrame:
    """Matches: pairs of points of labels l and l + 1 with the same rank in their label:
    pair, match_id, id_a, id_b, px..pz, qx..qz."""
    from pyspark.sql import Window

    p = pts(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    a = p.select(F.col("label").alias("pair"), F.col("r").alias("match_id"), F.col("vec_id").alias("id_a"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    b = p.select((F.col("label") - 1).alias("pair"), F.col("r").alias("match_id"), F.col("vec_id").alias("id_b"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
    return a.join(b, ["pair", "match_id"])


MATCHED = (
    PTS
    + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM pts),
matched AS (SELECT a.label AS pair, a.r AS match_id, a.vec_id AS id_a, b.vec_id AS id_b, a.x AS px, a.y AS py, a.z AS pz, b.x AS qx, b.y AS qy, b.z AS qz
  FROM rk a JOIN rk b ON b.label - 1 = a.label AND a.r = b.r)"""
)


def r6(c, name: str):
    """Rounded for comparison, without a negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)
