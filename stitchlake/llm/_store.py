"""Where intermediate tables and archives go: the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI below ``spark.checkpoint.dir``.

    A session without that setting gets a temporary folder of this machine if it runs on one machine
    (a local test), and an error otherwise: executors elsewhere would write to their own disks.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _FALLBACK:
            _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="stitchlake-")
        base = _FALLBACK[app]
    return f"{base.rstrip('/')}/stitchlake-{name}-{uuid.uuid4().hex[:12]}"


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here and a
    lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    relieve(spark)
    return out


def relieve(spark: SparkSession) -> None:
    """Have the driver let go of the plans, file lists and broadcasts of jobs that are done, before its heap grows for more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Folders of materialized tables that are still referred to.
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables whose last reader has run."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table, as (node, component) with the smallest
    node of each component. Nodes without an edge are absent.

    Alternates neighbourhood minimum and pointer jumping over DataFrames; every round is cut
    through the shared folder, so the plan stays small. Nothing is collected but the count of
    labels that changed.
    """
    from pyspark.sql import functions as F

    both = materialize(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
        .filter("u <> v")
        .distinct(),
        "edges",
    )
    label = materialize(
        both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")),
        "label",
    )
    while True:
        nbr = (
            both.join(label.select(F.col("node").alias("v"), F.col("component").alias("c")), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("c").alias("c"))
        )
        up = label.select(F.col("node").alias("component"), F.col("component").alias("root"))
        held, new = label, (
            label.join(nbr, "node")
            .join(up, "component", "left")
            .select("node", F.col("component").alias("old"), F.least("component", "c", "root").alias("component"))
        )
        new = materialize(new, "label")
        moved = new.filter("old <> component").limit(1).count()
        discard(held)
        label = new
        if not moved:
            discard(both)
            return label.select("node", "component")


#: Rows of partial vectors that one task adds up.
FAN_IN = 32


def _add(width: int, dtype: str):
    def run(pdf):
        import numpy as np

        whole = np.issubdtype(dtype, np.integer)
        total = np.zeros(width, dtype=np.uint64 if whole else np.float64)
        for x in pdf["counts"]:
            total += np.frombuffer(x, dtype=dtype)
        if whole:
            total = np.minimum(total, np.iinfo(dtype).max)
        return pdf.head(1)[["seg", "part"]].assign(part=pdf["part"].iloc[0] // FAN_IN, counts=[total.astype(dtype).tobytes()])

    return run


def sum_vectors(rows: DataFrame, width: int, segments: int, dtype: str = "<u8"):
    """Sum of fixed-size vectors given as rows (seg int, part int, counts binary of ``width``
    numbers of ``dtype``; sums of
    integers stop at its largest value); part numbers the sending task. Adds in a tree of fixed fan-in; the
    driver receives one vector of ``width * segments`` numbers, whatever the input."""
    import numpy as np
    from pyspark.sql import functions as F

    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        rows = rows.groupBy("seg", (F.col("part") / FAN_IN).cast("int").alias("up")).applyInPandas(_add(width, dtype), "seg int, part int, counts binary")
        parts = -(-parts // FAN_IN)
        if parts == 1:
            break
    out = np.zeros(width * segments, dtype=np.uint64 if np.issubdtype(dtype, np.integer) else np.float64)
    for r in rows.toLocalIterator():
        out[r["seg"] * width : (r["seg"] + 1) * width] = np.frombuffer(r["counts"], dtype=dtype)
    return out
