"""Tables in the folder that driver and executors share: lineage ends there, and what is read no more goes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: The attribute of a written table that names its folder. No table of paths here: this module is pickled with
#: functions of its users, and a weak reference cannot be.
_PATH = "_stitchlake_path"


def shared_folder(spark: SparkSession, name: str = "store") -> str:
    """A fresh folder below ``spark.checkpoint.dir``. A session on one machine without that setting (a local test)
    gets a temporary folder; any other must have it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="stitchlake-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/stitchlake-{name}-{uuid.uuid4().hex[:12]}"


def n_tasks(spark: SparkSession) -> int:
    """Tasks for rows that are small but costly to work on, which Spark would put into one by their bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    vars(out)[_PATH] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables whose last reader has run."""
    for df in tables:
        if df is not None and (path := vars(df).pop(_PATH, None)):
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
