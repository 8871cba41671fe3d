"""Point streams. The stateless operators take a streaming DataFrame as they take a static one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from terrafold.plans.session import scratch_path


def read_point_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def run_to_files(stream: DataFrame, path: str, step: Callable[[DataFrame], DataFrame], timeout: int | None = None) -> DataFrame:
    """Process everything available through a stateless step into a Parquet folder and return that folder.

    ``timeout`` in seconds stops a stream that takes longer; by default there is no limit."""
    out = step(stream)
    query = (
        out.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", scratch_path(stream.sparkSession, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    finished = query.awaitTermination() is None if timeout is None else query.awaitTermination(timeout)
    if not finished:
        query.stop()
        raise TimeoutError("stream did not finish in time")
    return stream.sparkSession.read.schema(out.schema).parquet(path)
