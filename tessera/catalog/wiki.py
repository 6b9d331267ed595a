"""Extraction queries on ``pages``: links stand for wiki links, hosts for references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import wiki


def _pages(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/pages.parquet")


def _wiki(s: SparkSession, d: str) -> DataFrame:
    """Pages with their links written as wiki marks, and the language as a category."""
    marked = F.regexp_replace("html", wiki.ANCHOR, "[[$1|$2]]")
    return _pages(s, d).select("page_id", F.concat(F.lit("Page "), "page_id").alias("title"), F.concat(marked, F.lit(" [[Category:"), F.regexp_extract("html", 'lang="([a-z]+)"', 1), F.lit("]]")).alias("text"))


def _entities(s: SparkSession, d: str) -> DataFrame:
    return wiki.wiki_links(_wiki(s, d))


def _types(s: SparkSession, d: str) -> DataFrame:
    names = _entities(s, d).select(F.col("surface").alias("name")).distinct()
    return names.select("name", (F.char_length("name") % 3 + 1).alias("type"))


def _propagated(s: SparkSession, d: str) -> DataFrame:
    redirects = _entities(s, d).select(F.col("ref").alias("name"), F.col("surface").alias("target")).distinct()
    return wiki.propagate_types(_types(s, d), redirects)


def _features(s: SparkSession, d: str) -> DataFrame:
    return wiki.surface_features(_entities(s, d), _types(s, d)).withColumn("value", F.round("value", 6))


QUERIES = {
    "wiki_anchors": lambda s, d: wiki.anchors(_pages(s, d)),
    "wiki_titles": lambda s, d: wiki.titles(_pages(s, d)),
    "wiki_entities": lambda s, d: _entities(s, d).select("page_id", "surface", "ref"),
    "wiki_entity_contexts": _entities,
    "wiki_categories": lambda s, d: wiki.categories(_wiki(s, d)),
    "wiki_named_entities": lambda s, d: wiki.named_entities(wiki.categories(_wiki(s, d)), "title", "Page [0-9]*[05]", "category", "de|fr"),
    "wiki_type_propagation": _propagated,
    "wiki_features": _features,
    "wiki_libsvm": lambda s, d: wiki.to_libsvm(_features(s, d)),
}

_A = "anchors as (select page_id, regexp_extract(a, '" + wiki.ANCHOR + "', 1) as ref, regexp_extract(a, '" + wiki.ANCHOR + "', 2) as surface from (select page_id, unnest(regexp_extract_all(html, '" + wiki.ANCHOR + "')) as a from pages))"
_E = f"{_A}, entities as (select page_id, surface, ref from anchors where ref <> '' and not contains(ref, ':'))"
_TYPED = f"{_E}, typed as (select distinct surface as name, (length(surface) % 3 + 1)::int as type from entities)"
_CATS = "cats as (select 'Page ' || page_id as title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) as category from pages)"
_M = """once as (select distinct surface from entities), affix as (select surface, unnest(['PU_' || left(surface, 1), 'SU_' || right(surface, 1), 'PB_' || left(surface, 2), 'SB_' || right(surface, 2), 'LENGTH']) as feature, unnest([1.0::double, 1, 1, 1, least(length(surface) / 10, 1)]) as value from once)"""
ORACLE = {
    "wiki_anchors": f"with {_A} select * from anchors",
    "wiki_titles": "select page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ' ') as title from pages",
    "wiki_entities": f"with {_E} select * from entities",
    "wiki_categories": f"with {_CATS} select * from cats",
    "wiki_named_entities": f"with {_CATS} select distinct title from cats where regexp_full_match(title, 'Page [0-9]*[05]') and category in ('de', 'fr')",
    "wiki_type_propagation": f"with {_TYPED}, r as (select distinct ref as name, surface as target from entities) select name, min(type) as type from (select name, type from typed union all select r.name, t.type from r join typed t on t.name = r.target) group by name",
}
