"""Trained models on disk: their tables and settings, as versions that readers never see half written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.versions import read_current, write_version


def save_model(path: str, tables: dict[str, DataFrame], settings: dict | None = None) -> None:
    """Write a model: each of its tables (weights, counts, state) and its settings (anything that JSON holds).

    The settings, which name the tables' versions, are written last, so that a reader finds a whole model or the one before.
    """
    if not tables:
        raise ValueError("a model has at least one table")
    spark = next(iter(tables.values())).sparkSession
    names = {name: write_version(df, f"{path}/tables/{name}", keep=3) for name, df in tables.items()}
    text = json.dumps({"tables": names, "settings": settings or {}})
    write_version(spark.createDataFrame([(text,)], "model string"), f"{path}/model", keep=3)


def load_model(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables and settings of the newest whole model."""
    held = json.loads(read_current(spark, f"{path}/model").first()["model"])
    return {name: spark.read.parquet(f"{path}/tables/{name}/{version}") for name, version in held["tables"].items()}, held["settings"]
