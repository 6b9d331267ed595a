"""Stateful operators over micro-batches: state is a versioned table, a batch joins with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import dedup, recommend
from tessera.sources.versions import read_current, versions, write_version


def deduplicate(stream: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Keep fingerprints of a stream of documents ``(doc_id, text)`` and links of new to all in ``state``.

    ``state/prints`` and ``state/links`` hold the newest versions. A batch that is replayed
    replaces its own documents, so results do not depend on retries.
    """

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = dedup.simhash(batch).withColumn("is_new", F.lit(True))
        merged = fresh
        if versions(spark, f"{state}/prints"):
            old = read_current(spark, f"{state}/prints").join(fresh.select("doc_id"), "doc_id", "left_anti")
            merged = fresh.unionByName(old.withColumn("is_new", F.lit(False)))
        reps = merged.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens"), F.max("is_new").alias("is_new"))
        links = dedup.links(reps, only_new="is_new")
        if versions(spark, f"{state}/links"):
            links = links.unionByName(read_current(spark, f"{state}/links")).distinct()
        write_version(links, f"{state}/links")
        write_version(merged.drop("is_new"), f"{state}/prints")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def covisit(stream: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Keep co-visit counts of a stream of visits ``(user, item)``: ``state/visits`` and ``state/counts``.

    A visit already known changes nothing, so a replayed batch adds nothing.
    """

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.select("user", "item").distinct()
        if versions(spark, f"{state}/visits"):
            old = read_current(spark, f"{state}/visits")
            new = new.join(old, ["user", "item"], "left_anti")
            counts = recommend.merge_covisits(read_current(spark, f"{state}/counts"), recommend.covisits_of_batch(old, new))
            visits = old.unionByName(new)
        else:
            counts, visits = recommend.covisits(new), new
        write_version(counts, f"{state}/counts")
        write_version(visits, f"{state}/visits")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, key: str, time_col: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """``(key, start, n)`` by event time; rows later than the watermark are dropped by the engine."""
    counted = stream.withWatermark(time_col, late).groupBy(F.col(key).alias("key"), F.window(time_col, window).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("key", F.col("w.start").alias("start"), "n")
