"""Relational building blocks of the mining operators, as plain DataFrame compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def project_document(docs: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, body)``: configured columns joined by blanks; rows without id are left out."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.concat_ws(" ", *columns).alias("body"))


def without_stop_words(terms: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Rows ``(.., term)`` whose term is not in the table ``(term)``; the list is small enough to broadcast if AQE finds it so."""
    return terms.join(stop_words.select("term").distinct(), "term", "left_anti")


def ends_with_stop_word(phrases: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Rows ``(phrase)`` whose last term is a stop word."""
    last = phrases.withColumn("term", F.substring_index("phrase", " ", -1))
    return last.join(stop_words.select("term").distinct(), "term", "left_semi").select("phrase")


def cogroup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(key, n_left, n_right, sum_left, sum_right)`` of both sides by key, in a full outer join of their aggregates."""
    a = left.groupBy(key).agg(F.count("*").alias("n_left"), F.sum("value").alias("sum_left"))
    b = right.groupBy(key).agg(F.count("*").alias("n_right"), F.sum("value").alias("sum_right"))
    return a.join(b, key, "full").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_left", "n_right", "sum_left", "sum_right")])


def accumulate(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Sum of ``value`` by ``key``."""
    return rows.groupBy(key).agg(F.sum(value).alias(value))


def top_per_key(rows: DataFrame, key: str, by: str, tie: str, k: int) -> DataFrame:
    """The ``k`` largest of each key with ``rank``, ties by ``tie``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(by).desc(), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def prefix_rollup(paths: DataFrame) -> DataFrame:
    """``(prefix, n)``: counts of ``(terms, n)`` added to every prefix of the terms."""
    each = paths.select("n", "terms", F.explode(F.sequence(F.lit(1), F.size("terms"))).alias("k"))
    return each.groupBy(F.array_join(F.slice("terms", F.lit(1), F.col("k")), " ").alias("prefix")).agg(F.sum("n").alias("n"))


def islands(rows: DataFrame, key: str, day: str) -> DataFrame:
    """``(key, start, days)``: runs of consecutive days."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(day))
    return rows.withColumn("g", F.date_sub(day, rank)).groupBy(key, "g").agg(F.min(day).alias("start"), F.count("*").cast("int").alias("days")).drop("g")


def containment_join(small: DataFrame, large: DataFrame) -> DataFrame:
    """``(small_id, large_id)``: sets ``(id, item)`` all of whose items a larger set holds, by counting matched items."""
    sizes = small.groupBy("id").agg(F.countDistinct("item").alias("size"))
    s, r = small.select(F.col("id").alias("small_id"), "item").distinct(), large.select(F.col("id").alias("large_id"), "item").distinct()
    met = s.join(r, "item").groupBy("small_id", "large_id").agg(F.count("*").alias("n"))
    return met.join(sizes, met["small_id"] == sizes["id"]).where("n = size").select("small_id", "large_id")
