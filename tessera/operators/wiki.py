"""Entities, categories, named-entity types and features from marked-up text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINK = r"\[\[([^\[\]]*)\]\]"
CATEGORY = r"\[\[Category:(.+?)(\|[^\]]*)?\]\]"
ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'
#: Types by number; the first in this order wins.
TYPES = {"person": 1, "location": 2, "organisation": 3}


def wiki_links(pages: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """``(page_id, surface, ref, left, right)`` of ``[[ref|surface]]`` links; those with a colon are skipped."""
    marked = F.split(F.regexp_replace(F.col(text_col), LINK, "\x01$1\x02"), "\x01", -1)
    parts = pages.select(F.col(id_col).alias("page_id"), marked.alias("p")).select("page_id", "p", F.posexplode("p").alias("i", "part")).where("i > 0")
    body = F.substring_index("part", "\x02", 1)
    before = F.regexp_extract(F.regexp_replace(F.get("p", F.col("i") - 1), "^[^\x02]*\x02", ""), r"(\S+)\s*$", 1)
    after = F.regexp_extract(F.regexp_replace("part", "^[^\x02]*\x02", ""), r"^\s*(\S+)", 1)
    out = parts.select("page_id", F.element_at(F.split(body, r"\|"), -1).alias("surface"), F.element_at(F.split(body, r"\|"), 1).alias("ref"), before.alias("left"), after.alias("right"))
    return out.where(~F.contains("ref", F.lit(":")) & (F.col("ref") != ""))


def anchors(pages: DataFrame) -> DataFrame:
    """``(page_id, ref, surface)`` of HTML links."""
    found = F.explode(F.regexp_extract_all("html", F.lit(ANCHOR), 0)).alias("a")
    return pages.select("page_id", found).select("page_id", F.regexp_extract("a", ANCHOR, 1).alias("ref"), F.regexp_extract("a", ANCHOR, 2).alias("surface"))


def categories(pages: DataFrame, title_col: str = "title", text_col: str = "text") -> DataFrame:
    """``(title, category)`` of category links; titles with a colon are skipped."""
    found = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(CATEGORY), 1)).alias("category")
    return pages.where(~F.contains(F.col(title_col), F.lit(":"))).select(F.col(title_col).alias("title"), found)


def titles(pages: DataFrame, html_col: str = "html") -> DataFrame:
    return pages.select("page_id", F.trim(F.regexp_extract(F.col(html_col), r"(?s)<title>(.*?)</title>", 1)).alias("title"))


def named_entities(rows: DataFrame, title_col: str, title_pattern: str, category_col: str | None = None, category_pattern: str | None = None) -> DataFrame:
    """Distinct titles that match as a whole, and whose category does, if asked for."""
    kept = rows.where(F.rlike(F.col(title_col), F.lit(f"^({title_pattern})$")))
    if category_col:
        kept = kept.where(F.rlike(F.col(category_col), F.lit(f"^({category_pattern})$")))
    return kept.select(F.col(title_col).alias("title")).distinct()


def propagate_types(typed: DataFrame, redirects: DataFrame) -> DataFrame:
    """``(name, type)``: types of names and of what redirects to them ``(name, target)``; the smallest number wins."""
    through = redirects.join(typed.withColumnRenamed("name", "target"), "target").select("name", "type")
    return typed.select("name", "type").unionByName(through).groupBy("name").agg(F.min("type").alias("type"))


def surface_features(entities: DataFrame, types: DataFrame) -> DataFrame:
    """``(surface, feature, value)``: affixes, neighbouring words by share, and length of each surface.

    ``entities`` has ``surface, ref, left, right``. Kinds: PU and SU first and last character, PB and SB two,
    LC and RC neighbours, LENGTH min(length / 10, 1).
    """
    s = F.col("surface")
    once = entities.select("surface").distinct()
    fixed = [("PU", F.substring(s, 1, 1)), ("SU", F.expr("right(surface, 1)")), ("PB", F.substring(s, 1, 2)), ("SB", F.expr("right(surface, 2)"))]
    affix = once.select("surface", F.inline(F.array(*[F.struct(F.concat(F.lit(k + "_"), v).alias("feature"), F.lit(1.0).alias("value")) for k, v in fixed], F.struct(F.lit("LENGTH").alias("feature"), F.least(F.char_length(s) / 10, F.lit(1.0)).alias("value")))))
    out = affix
    for side, kind in (("left", "LC_"), ("right", "RC_")):
        seen = entities.where(F.col(side) != "").groupBy("surface", F.concat(F.lit(kind), F.col(side)).alias("feature")).agg(F.count("*").alias("n"))
        out = out.unionByName(seen.select("surface", "feature", (F.col("n") / F.sum("n").over(Window.partitionBy("surface"))).alias("value")))
    return out.join(types.withColumnRenamed("name", "surface"), "surface", "left").select("surface", "feature", "value", F.coalesce("type", F.lit(0)).alias("type"))


def to_libsvm(features: DataFrame) -> DataFrame:
    """``(surface, line)``: ``type index:value ...`` with indexes from 1 in order of the feature's name.

    Indexes come from the sorted dictionary of features, ranked by prefix-bucketed counts rather than in one task.
    """
    names = features.select("feature").distinct().withColumn("b", F.substring(F.md5("feature"), 1, 3))
    sizes = names.groupBy("b").agg(F.count("*").alias("n"))
    before = sizes.select("b", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ids = names.join(F.broadcast(before), "b").select("feature", (F.row_number().over(Window.partitionBy("b").orderBy("feature")) + F.col("base")).alias("id"))
    rows = features.join(ids, "feature").groupBy("surface", "type").agg(F.sort_array(F.collect_list(F.struct("id", F.round("value", 6).alias("value")))).alias("f"))
    return rows.select("surface", F.concat_ws(" ", F.col("type").cast("string"), F.array_join(F.transform("f", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["value"].cast("string"))), " ")).alias("line"))
