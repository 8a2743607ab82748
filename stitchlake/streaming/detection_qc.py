"""Detection statistics over a stream of detections; an extension, the batch operators have no stream.

Late rows are dropped after the watermark; each window of a view is emitted once it is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(stream: DataFrame, ts: str, view: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window start, view, n, min, max, mean of every window of event time."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width), view)
    out = w.agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), view, "n", "least", "most", "mean")
