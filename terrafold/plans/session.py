"""Session, shared scratch space and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast on request only when its construction bounds it by this many rows.
BROADCAST_ROWS = 100_000

_LOCAL_ROOTS: dict[str, str] = {}


def build_session(app: str = "terrafold", cores: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are tuned for. On a cluster pass ``--master`` to spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # call-site capture costs a JVM round trip or more per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if cores is not None:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", "16g")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="terrafold-")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/terrafold/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to shared storage and read it back: lineage ends there and survives executor loss."""
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_copy(df: DataFrame, rows: int) -> DataFrame:
    """A metadata table of at most BROADCAST_ROWS rows as a local relation: filters and projections need no job."""
    return df.sparkSession.createDataFrame(df.toArrow()) if rows <= BROADCAST_ROWS else df


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only when ``max_rows``, a bound the caller can prove, is small.

    Otherwise the plan keeps an ordinary equi-join and adaptive execution decides from measured sizes.
    """
    return F.broadcast(df) if max_rows <= BROADCAST_ROWS else df
