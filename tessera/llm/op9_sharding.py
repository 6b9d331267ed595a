"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Source blocks (by hash) are counted; the driver draws how many rows each block sends to
each cell, a cell being a fixed range of a shard's slots. Rows are ranked inside their
block by one hash (local permutation), sent to the cell whose drawn range holds that
rank (exchange), and ranked inside the cell by another hash (second permutation).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.hypergeometric import communication_matrix
from tessera.plans.staging import stage

#: Rows that a block or cell holds, until there are MAX_BLOCKS of them.
BLOCK_ROWS = 25_000
#: Bounds the matrix on the driver and in the broadcast: at most a million counts (8 MB).
MAX_BLOCKS = 1_024


def _passed(bounds: Column, rank: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b <= rank))


def shuffle_shards(rows: DataFrame, shards: int = 16, seed: int = 11, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: a uniform shuffle whose shard sizes differ by one row at most.

    Slots are gapless from 0 in each shard. A row's place depends on its values and the
    whole table's counts, so reruns agree; equal rows take adjacent draws and are all kept.
    Nulls hash like any value. ``rows`` must be narrow and cheap to read again (staged),
    and must not have columns ``shard``, ``slot`` or names starting with ``_sh``. An empty
    table gives no rows.
    """
    spark, names = rows.sparkSession, rows.columns
    total = rows.count()
    cells = max(1, min(MAX_BLOCKS // shards, -(-total // (shards * block_rows))))
    blocks = max(1, min(MAX_BLOCKS, -(-total // block_rows)))
    mark = rows.withColumn("_sh1", F.xxhash64(F.lit(seed), *names)).withColumn("_sh2", F.xxhash64(F.lit(seed + 1), *names))
    mark = mark.withColumn("_shb", F.pmod(F.xxhash64(F.lit(seed + 2), *names), F.lit(blocks)))
    sent = {r["_shb"]: r["count"] for r in mark.groupBy("_shb").count().collect()}
    sizes = [(total + shards - 1 - s) // shards for s in range(shards)]
    columns = [(n + cells - 1 - c) // cells for n in sizes for c in range(cells)]
    matrix = np.array(communication_matrix(np.random.default_rng(seed), [sent.get(b, 0) for b in range(blocks)], columns), dtype=np.int64)
    start = np.cumsum(matrix, axis=1)
    plan = [(b, start[b, cells - 1 :: cells][:-1].tolist(), [start[b, s * cells : (s + 1) * cells - 1].tolist() for s in range(shards)]) for b in range(blocks)]
    ranges = spark.createDataFrame(plan, "_shb long, _shto array<bigint>, _shin array<array<bigint>>")
    first = [[sum(columns[s * cells : s * cells + c]) for c in range(cells)] for s in range(shards)]
    begins = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in first])

    rank = F.row_number().over(Window.partitionBy("_shb").orderBy("_sh1", *names)).cast("long") - 1
    ranked = mark.withColumn("_shr", rank).join(F.broadcast(ranges), "_shb")
    sharded = ranked.withColumn("shard", _passed(F.col("_shto"), F.col("_shr")).cast("int"))
    celled = sharded.withColumn("_shc", _passed(F.element_at("_shin", F.col("shard") + 1), F.col("_shr")))
    within = F.row_number().over(Window.partitionBy("shard", "_shc").orderBy("_sh2", *names)).cast("long") - 1
    slot = F.element_at(F.element_at(begins, F.col("shard") + 1), F.col("_shc") + 1) + within
    return celled.withColumn("slot", slot).select(*names, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``, under the law ``rows``.

    ``size`` is the text's UTF-8 bytes plus 1 (1 for null); ``text_crc32`` of a null text is
    that of an empty one. ``grown_shard`` is null: this law says nothing of one more shard.
    Only ids, sizes and checksums move; to write shards, join on ``doc_id`` and sort by slot.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shuffle_shards(stage(narrow, "shard-input"), shards, seed, block_rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
