"""Tables kept in the folder that all executors share.

``spark.checkpoint.dir`` names that folder. A staged table cuts lineage, so work
before it is never repeated, and it survives the loss of any executor.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a temporary folder, but only if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete what :func:`stage` wrote for ``df``, which nothing reads any more."""
    _STAGED.remove(df._tessera_path)
    _delete(df.sparkSession, df._tessera_path)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished work, which else stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_staged(spark: SparkSession) -> None:
    """Delete every table this process has staged. Call it when no result that reads them is needed."""
    while _STAGED:
        _delete(spark, _STAGED.pop())
