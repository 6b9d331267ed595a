"""Corpus pipeline: language ID, line deduplication, near-duplicate removal, mixing, BPE.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept;
``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import near_copies, op2_line_dedup, op3_mixing, op6_language, op10_bpe
from tessera.llm.queries import table, tokenizer_definition
from tessera.plans import presence
from tessera.plans.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without determinable language (null texts, texts without letters); ``lang`` becomes the predicted one."""
    judged = op6_language.identify(docs.select(*COLUMNS), op6_language.fit(docs))
    return judged.where(F.col("lang_pred") != op6_language.UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that are boilerplate of their source; ``n_chars`` follows. Documents stay, even if nothing is left of one."""
    out = op2_line_dedup.drop_boilerplate(docs.select(*COLUMNS), "source", "text")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five-word shingles, Jaccard 0.8): that with the smallest id, rows without an id coming last.

    Rows are told apart by id and text, so different texts under one id, or without one, are judged each by itself; of rows that agree
    in both, the least in its other columns stays. Texts without words are alike. An empty table gives no rows.
    """
    names = ["_last", "_id", "_mark"]
    told = [F.col("doc_id").isNull().alias("_last"), F.coalesce("doc_id", F.lit(0)).alias("_id")]
    named = stage(near_copies.groups(docs).select(*told, F.col("mark").alias("_mark"), "component"), "named")
    kept = stage(named.groupBy("component").agg(F.min(F.struct(*names)).alias("first")).select("first.*"), "kept")
    # Names that go, or that several rows have. Rows of other names stay as they are, and where they are.
    unsure = named.groupBy(*names).agg(F.count("*").alias("n")).join(kept.withColumn("stays", F.lit(True)), names, "left").where("stays is null or n > 1")
    marked = docs.select(*COLUMNS, *told, F.xxhash64("text").alias("_mark")).withColumn("_hash", F.xxhash64(*names))
    met, sure = presence.split(marked, "_hash", unsure.select(F.xxhash64(*names)))
    others = F.struct("lang", "source", "n_chars", "text")
    chosen = met.join(kept, names, "left_semi").groupBy(*names, "doc_id").agg(F.min(others).alias("row"))
    return sure.select(*COLUMNS).unionByName(chosen.select("doc_id", "row.*").select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents of each source to its target weight: a document appears as often as the shards of the mix take it (twice at most).

    Null sources form one source; documents without words go where their block goes; rows that agree in id, source, size and
    checksum stand for each other. An empty table gives no rows.
    """
    return op3_mixing.mixed_rows(docs.select(*COLUMNS)).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes each row that the mix took: its number of tokens and the digests of both.

    Null texts are empty; repeated rows all stay; long texts are encoded whole. An empty table gives no rows.
    """
    return op10_bpe.digests(docs, tokenizer_definition())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: Cross-parsing, components of near copies and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
