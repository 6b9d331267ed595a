"""Resource files, plain or compressed, with checksums; sinks that call back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, crc, content)`` of each file as it lies there."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.crc32("content").alias("crc"), "content")


def changed_resources(found: DataFrame, expected: DataFrame) -> DataFrame:
    """``(path, crc, expected_crc)`` of files whose checksum is not that of ``expected`` (path, crc), or that are missing."""
    wanted = expected.select("path", F.col("crc").alias("expected_crc"))
    return wanted.join(found.select("path", "crc"), "path", "left").where(~F.col("crc").eqNullSafe(F.col("expected_crc"))).select("path", "crc", "expected_crc")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line)`` of text resources; compressed ones (gzip, bzip2, zstd and others by their ending) are unpacked."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def call_back(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch of ``stream`` and its number to ``callback``, which must stand a repeat of the last one."""
    return stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
