"""Readers and writers of the text and binary formats that mining tools exchange.

Every reader uses Spark's own file sources, so paths may be of any file system that Spark knows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.dates import parse_date

#: Largest number of items of a binary set.
MOST_ITEMS = 99_999


def read_scd(spark: SparkSession, path: str, per_file: int | None = None) -> DataFrame:
    """``(file, n, properties)`` of SCD documents: blocks of ``<NAME>value`` lines, each begun by ``<DOCID>``.

    Names are lower-cased; a value may span lines. At most ``per_file`` documents of a file, in order.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    docs = whole.select("file", F.posexplode(F.split("value", r"(?m)^(?=<DOCID>)")).alias("n", "doc")).where(F.startswith("doc", F.lit("<DOCID>")))
    fields = F.filter(F.split("doc", r"(?m)^(?=<[A-Za-z0-9_]+>)"), lambda x: x != "")
    pairs = F.transform(fields, lambda x: F.struct(F.lower(F.regexp_extract(x, r"(?s)^<([A-Za-z0-9_]+)>(.*?)\s*$", 1)), F.regexp_extract(x, r"(?s)^<([A-Za-z0-9_]+)>(.*?)\s*$", 2)))
    unique = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["col1"]), F.create_map(p["col1"], p["col2"])))
    out = docs.select("file", "n", unique.alias("properties"))
    if per_file is not None:
        rank = F.row_number().over(Window.partitionBy("file").orderBy("n"))
        out = out.withColumn("r", rank).where(F.col("r") <= per_file).drop("r")
    return out


def scd_documents(scd: DataFrame, content: tuple[str, ...] = ("title", "content")) -> DataFrame:
    """``(docid, title, body, date)``: configured properties joined; documents without docid are left out."""
    body = F.concat_ws("\n", *[F.element_at("properties", F.lit(c)) for c in content])
    out = scd.select(F.element_at("properties", F.lit("docid")).alias("docid"), F.element_at("properties", F.lit("title")).alias("title"), body.alias("body"), parse_date(F.element_at("properties", F.lit("date"))).alias("date"))
    return out.where("docid is not null and docid <> ''")


def valid_share(documents: DataFrame) -> float:
    """Share of documents with title and date; a dated corpus with less than 0.8 should be refused."""
    return documents.agg(F.avg(F.when(F.col("title").isNotNull() & F.col("date").isNotNull(), 1.0).otherwise(0.0))).first()[0] or 0.0


def read_text_sets(spark: SparkSession, path: str) -> DataFrame:
    """``(file, set_id, items)`` of sets written as numbers between white space, each ended by 0."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("v"))
    parts = whole.select("file", F.posexplode(F.split(F.concat(F.lit(" "), "v", F.lit(" ")), " 0(?= )")).alias("set_id", "part")).where("trim(part) <> ''")
    return parts.select("file", "set_id", F.transform(F.split(F.trim("part"), " "), lambda x: x.cast("long")).alias("items"))


def read_binary_sets(spark: SparkSession, path: str) -> DataFrame:
    """``(set_id, items)`` of records ``u32 id, u32 n, n x u32``. A truncated record or more than ``MOST_ITEMS`` items is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, at, ids, items = content.as_py(), 0, [], []
                while at < len(data):
                    if at + 8 > len(data):
                        raise ValueError("truncated set header")
                    set_id, n = struct.unpack_from("<II", data, at)
                    if n > MOST_ITEMS or at + 8 + 4 * n > len(data):
                        raise ValueError("truncated or too long set")
                    ids.append(set_id)
                    items.append(list(struct.unpack_from(f"<{n}I", data, at + 8)))
                    at += 8 + 4 * n
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.list_(pa.int64()))], ["set_id", "items"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "set_id long, items array<bigint>")


def read_feature_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(target, features)`` of lines ``target index value index value ...``; blank lines are left out."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).where("trim(value) <> ''").select(parts.alias("p"))
    count = ((F.size("p") - 1) / 2).cast("int")
    pairs = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.element_at("p", i * 2 + 2).cast("long").alias("idx"), F.element_at("p", i * 2 + 3).cast("double").alias("val")))
    return rows.select(F.element_at("p", 1).cast("double").alias("target"), pairs.alias("features"))


def feature_rows_summary(rows: DataFrame) -> DataFrame:
    """One row: least and largest target, and the number of features (largest index plus 1)."""
    each = rows.select("target", F.coalesce(F.array_max(F.transform("features", lambda f: f["idx"])), F.lit(-1)).alias("m"))
    return each.agg(F.min("target").alias("low"), F.max("target").alias("high"), (F.max("m") + 1).alias("n_features"))


def read_pinyin(spark: SparkSession, path: str) -> DataFrame:
    """``(char, pinyin)`` of lines ``char pinyinN``; the tone digit is dropped."""
    parts = F.split("value", " ")
    return spark.read.text(path).where("size(split(value, ' ')) = 2").select(parts[0].alias("char"), F.expr("substring(split(value, ' ')[1], 1, length(split(value, ' ')[1]) - 1)").alias("pinyin"))


def read_gram_table(spark: SparkSession, path: str) -> DataFrame:
    """``(gram, n, p)`` of tab-separated grams of one to three characters."""
    raw = spark.read.csv(path, sep="\t", schema="gram string, p double")
    return raw.where("gram is not null").select("gram", F.char_length("gram").alias("n"), "p").where("n between 1 and 3")


def write_gram_table(model: DataFrame, path: str) -> None:
    model.select("gram", "p").write.csv(path, sep="\t")


def read_wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(title, text)`` of a dump's pages: records end at ``</page>``."""
    raw = spark.read.option("lineSep", "</page>").text(path)
    title = F.regexp_extract("value", r"(?s)<title>(.*?)</title>", 1)
    return raw.where(F.contains("value", F.lit("<title>"))).select(title.alias("title"), F.regexp_extract("value", r"(?s)<text[^>]*>(.*?)</text>", 1).alias("text"))


def read_keyphrase_index(spark: SparkSession, path: str) -> DataFrame:
    """``(kp, docs)`` of lines ``phrase<TAB>doc,freq|doc,freq...``."""
    parts = F.split("value", "\t")
    docs = F.transform(F.split(parts[1], r"\|"), lambda x: F.struct(F.split(x, ",")[0].cast("int").alias("doc_id"), F.split(x, ",")[1].cast("int").alias("freq")))
    return spark.read.text(path).where("value like '%\t%'").select(parts[0].alias("kp"), docs.alias("docs"))


def read_tagged_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, text, phrases)`` of lines ``T:...`` and ``C:...`` with phrases between percent signs."""
    marked = F.regexp_extract_all("value", F.lit("%([^%]+)%"), 1)
    return spark.read.text(path).where(F.rlike("value", F.lit("^[TC]:"))).select(F.substring("value", 1, 1).alias("kind"), F.expr("substring(value, 3)").alias("text"), marked.alias("phrases"))


def write_topics(topics: DataFrame, path: str) -> None:
    """Topics as JSON lines, in order of date where the frame has one."""
    (topics.orderBy("day") if "day" in topics.columns else topics).write.json(path)


def topic_json(series: DataFrame) -> DataFrame:
    """``(key, json)``: each key's series as one JSON text."""
    points = F.sort_array(F.collect_list(F.struct(F.col("day").cast("string").alias("day"), "value")))
    return series.groupBy("key").agg(F.to_json(points).alias("json"))


def keep(condition: Column) -> Column:
    """Null conditions as false."""
    return F.coalesce(condition, F.lit(False))
