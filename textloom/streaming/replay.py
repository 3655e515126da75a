"""Runs a stored table through a streaming query to its end, and gives what the query has written."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.names import shared_folder


def folder(spark: SparkSession) -> str:
    """A new folder where all executors can write."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of a table's files, whether the table is one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if whole else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def replayed(spark: SparkSession, sf_dir: str, name: str, transform: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """The result of a streaming query over all files of a table: appended rows, or the last complete result."""
    out = folder(spark)
    query = transform(stream_of(spark, sf_dir, name)).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/state")
    if mode == "append":
        query = query.format("parquet").outputMode("append").start(f"{out}/rows")
    else:
        query = query.outputMode(mode).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/rows")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
