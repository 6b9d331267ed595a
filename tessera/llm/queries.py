"""Queries of the ten operators, and the DuckDB statements for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import op1_ann, op2_line_dedup, op3_mixing, op4_toxicity, op5_chat, op6_language, op7_quality, op8_simhash, op9_sharding, op10_bpe

#: The tokenizer of op10: a path, or the name of a file of the installed public tokenizers.
TOKENIZER = os.environ.get("TESSERA_TOKENIZER", "word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_definition(name: str = TOKENIZER) -> str:
    """Text of a tokenizer file, read on the driver and sent to the tasks."""
    if not os.path.exists(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Path(name).read_text(encoding="utf-8")


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op4_toxicity.score(docs, op4_toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann_one_bit": lambda s, d: op1_ann.search_embeddings(table(s, d, "embeddings")),
    "op2_line_dedup": lambda s, d: op2_line_dedup.dedup_pages(table(s, d, "pages")),
    "op3_mixing": lambda s, d: op3_mixing.mix_documents(table(s, d, "documents")),
    "op4_toxicity": _toxicity,
    "op5_chat_trees": lambda s, d: op5_chat.format_conversations(table(s, d, "conversations")),
    "op6_language_id": lambda s, d: op6_language.predict_documents(table(s, d, "documents")),
    "op7_quality_rules": lambda s, d: op7_quality.quality(table(s, d, "documents")),
    "op8_simhash": lambda s, d: op8_simhash.near_duplicates(table(s, d, "documents")),
    "op9_sharding": lambda s, d: op9_sharding.shard_documents(table(s, d, "documents")),
    "op10_bpe": lambda s, d: op10_bpe.digests(table(s, d, "documents"), tokenizer_definition()),
}

ORACLE: dict[str, str] = {
    "op2_line_dedup": op2_line_dedup.ORACLE,
    "op5_chat_trees": op5_chat.ORACLE,
    "op7_quality_rules": op7_quality.ORACLE,
}
