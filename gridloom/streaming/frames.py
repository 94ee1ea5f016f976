"""Frames that arrive one after another: the same operators, applied to each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def stream_of(spark, path: str) -> DataFrame:
    """The Parquet table at ``path``, a file or a folder of files, as a stream of rows."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def each_frame(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a query that writes ``plan(frame)`` below ``path``; a batch that is repeated overwrites its own folder."""

    def write(frame: DataFrame, number: int) -> None:
        plan(frame).write.mode("overwrite").parquet(f"{path}/frame={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
