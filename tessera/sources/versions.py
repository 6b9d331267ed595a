"""Tables that readers never see half written: every write goes to a new version, then a marker names it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def versions(spark: SparkSession, path: str) -> list[str]:
    """Finished versions, oldest first: those whose writer left its success marker."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    jvm = spark.sparkContext._jvm
    found = []
    for status in fs.listStatus(root):
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if status.isDirectory() and fs.exists(done):
            found.append((fs.getFileStatus(done).getModificationTime(), status.getPath().getName()))
    return [name for _, name in sorted(found)]


def write_version(df: DataFrame, path: str, keep: int = 2) -> str:
    """Write ``df`` as the newest version and drop all but the last ``keep``."""
    spark = df.sparkSession
    n = len(versions(spark, path))
    name = f"v{n:06d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{name}")
    fs, _ = _fs(spark, path)
    for old in versions(spark, path)[:-keep]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)
    return name


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no finished version under {path}")
    return spark.read.parquet(f"{path}/{found[-1]}")
