"""Queries of the relational and scalar primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dates, numbers, text
from tessera.functions.text import hash32_sql, tokens_sql
from tessera.operators import relational as rel
from tessera.sources.text import topic_json
from tessera.catalog.series import ORACLE as _SERIES
from tessera.catalog.series import QUERIES as _SERIES_QUERIES

STOP_WORDS = ("the", "of", "and", "to", "in", "der", "die", "und", "de", "la")


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _stop(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(w,) for w in STOP_WORDS], "term string")


def _terms(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "benchmark").select("item_id", F.explode(text.tokens(F.col("text"))).alias("term"))


def _heads(s: SparkSession, d: str) -> DataFrame:
    """First line of each document, as its title."""
    return _t(s, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "source", "lang")


def _text_functions(s: SparkSession, d: str) -> DataFrame:
    a = F.col("title")
    return _heads(s, d).select(
        "doc_id", F.array_join(text.tokens(a), "|").alias("tokens"), text.hash32(a).alias("hash"), text.edit_distance(F.regexp_replace(a, "[^ -~]", "?"), F.col("source")).alias("distance"),
        F.size(text.split_nonempty(a, ".")).alias("parts"), text.trim_left(a, "ABCDEFGHIJ").alias("left_trimmed"), text.trim_right(a, ". ").alias("right_trimmed"), F.array_join(text.first_letters(text.tokens(a)), "").alias("letters"), text.to_half_width(a).alias("half"), text.map_characters(a, {"ä": "a", "é": "e"}).alias("plain"),
    )


def _dates(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "events")
    day = F.to_date("ts")
    shapes = F.when(F.col("event_id") % 3 == 0, day.cast("string")).when(F.col("event_id") % 3 == 1, F.date_format(day, "yyyyMMdd")).otherwise("soon")
    seconds = F.unix_timestamp("ts")
    return e.select("event_id", dates.parse_date(shapes).cast("string").alias("parsed"), dates.date_of_epoch(seconds).cast("string").alias("from_epoch"), dates.day_count(F.lit("2024-01-01").cast("date"), day).alias("days"), F.date_add(day, 7).cast("string").alias("shifted"), dates.in_range(day, "2024-01-05", "2024-01-09").alias("inside"))


def _numbers(s: SparkSession, d: str) -> DataFrame:
    line = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("f"))
    f1, f2, n = F.col("f") + 7, F.col("f") + 19, F.lit(1000)
    llr = numbers.log_likelihood_ratio(F.col("f"), f1, f2, n)
    return line.select("l_orderkey", "l_linenumber", "f", F.round(llr, 6).alias("llr"), F.round(numbers.association_ratio(F.col("f"), f1, f2, n), 6).alias("mi"), numbers.phrase_score(F.col("f"), F.lit(3), F.round(llr, 9)).alias("score"), F.round(numbers.sigmoid(F.col("f") / 10), 6).alias("sigmoid"), F.round(numbers.clip(F.col("f"), 5.0, 20.0), 6).alias("clipped"), numbers.round3(F.col("f") / 7).alias("rounded"), F.round(numbers.entropy_over(F.array("f", f1, f2)), 6).alias("entropy")).distinct()


def _cogroup(s: SparkSession, d: str) -> DataFrame:
    a = _t(s, d, "events").where("event_type = 'click'").select("user_id", F.lit(1).alias("value"))
    b = _t(s, d, "events").where("event_type = 'purchase'").select("user_id", F.lit(2).alias("value"))
    return rel.cogroup(a, b, "user_id")


def _rollup(s: SparkSession, d: str) -> DataFrame:
    return rel.prefix_rollup(_t(s, d, "benchmark").select(text.tokens(F.col("text")).alias("terms"), F.lit(1).cast("long").alias("n")))


def _islands(s: SparkSession, d: str) -> DataFrame:
    days = _t(s, d, "events").select(F.col("user_id").alias("user"), F.to_date("ts").alias("day")).distinct()
    return rel.islands(days, "user", "day").withColumn("start", F.col("start").cast("string"))


def _contained(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("item"))
    return rel.containment_join(rows.where("id % 50 = 0"), rows)


def _redirect(s: SparkSession, d: str) -> DataFrame:
    c, n = _t(s, d, "customer"), _t(s, d, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_name", "n_name").orderBy("c_name").limit(10)


def _json(s: SparkSession, d: str) -> DataFrame:
    return topic_json(_SERIES_QUERIES["series_clip"](s, d)).select("key", F.length("json").alias("chars"))


QUERIES = {
    "document_projection": lambda s, d: rel.project_document(_heads(s, d), ["title", "source"]),
    "term_length_filter": lambda s, d: _terms(s, d).where("length(term) > 1"),
    "stop_word_filter": lambda s, d: rel.without_stop_words(_terms(s, d), _stop(s)).select("item_id", "term"),
    "stop_word_endings": lambda s, d: rel.ends_with_stop_word(_heads(s, d).select(F.array_join(text.tokens(F.col("title")), " ").alias("phrase")), _stop(s)),
    "title_regex_filter": lambda s, d: _heads(s, d).where(F.rlike("title", F.lit("^[A-M].*[.]$"))),
    "affix_filter": lambda s, d: _heads(s, d).where(F.startswith("title", F.lit("D")) & ~F.endswith("title", F.lit("?"))).select("doc_id", "title"),
    "accumulate_list": lambda s, d: rel.accumulate(_t(s, d, "lineitem").select("l_partkey", F.col("l_linenumber").cast("long").alias("n")), "l_partkey", "n"),
    "distinct_documents": lambda s, d: _terms(s, d).groupBy("term").agg(F.countDistinct("item_id").alias("df"), F.count("*").alias("n")),
    "cogroup_counts": _cogroup,
    "semi_join": lambda s, d: _t(s, d, "customer").join(_t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"),
    "anti_join": lambda s, d: _t(s, d, "documents").join(_t(s, d, "labels"), "doc_id", "left_anti").select("doc_id"),
    "equi_join_top": _redirect,
    "containment_join": _contained,
    "top_per_key": lambda s, d: rel.top_per_key(_t(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey", 3),
    "prefix_rollup": _rollup,
    "day_islands": _islands,
    "union_distinct": lambda s, d: _t(s, d, "part").select(F.col("p_brand").alias("name")).unionByName(_t(s, d, "region").select(F.col("r_name").alias("name"))).distinct(),
    "value_statistics": lambda s, d: _t(s, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("deviation"), F.min("value").alias("low"), F.max("value").alias("high")),
    "text_functions": _text_functions,
    "date_functions": _dates,
    "number_functions": _numbers,
    "topic_json": _json,
}

_HEADS = "heads as (select doc_id, split_part(text, chr(10), 1) as title, source, lang from documents)"
_TERMS = f"terms as (select item_id, unnest({tokens_sql('text')}) as term from benchmark)"
_STOP = "('" + "', '".join(STOP_WORDS) + "')"
_DAY = "ts::date"
_F1, _F2 = "(f + 7)", "(f + 19)"


def _x(k: str, p: str) -> str:
    return f"(case when {k} = 0 or {p} <= 0 then 0 else {k} * ln({p}) end)"


def _like(p: str, k: str, m: str) -> str:
    return f"({_x(k, p)} + {_x(f'({m} - {k})', f'(1 - {p})')})"


_K2, _N2 = f"greatest({_F2} - f, 0)", f"(1000 - {_F1})"
_P = f"((f + {_K2}) / ({_F1} + {_N2}))"
_LLR = f"({_like(f'(f / {_F1})', 'f', _F1)} + {_like(f'({_K2} / {_N2})', _K2, _N2)} - {_like(_P, 'f', _F1)} - {_like(_P, _K2, _N2)})"
_ALL = f"(f + {_F1} + {_F2})"
_ENT = " - ".join(["0"] + [f"{v} / {_ALL} * ln({v} / {_ALL})" for v in ("f", _F1, _F2)])
ORACLE = {
    "document_projection": f"with {_HEADS} select doc_id, concat_ws(' ', title, source) as body from heads",
    "term_length_filter": f"with {_TERMS} select * from terms where length(term) > 1",
    "stop_word_filter": f"with {_TERMS} select * from terms where term not in {_STOP}",
    "stop_word_endings": f"with {_HEADS}, p as (select array_to_string({tokens_sql('title')}, ' ') as phrase from heads) select phrase from p where split_part(phrase, ' ', -1) in {_STOP}",
    "title_regex_filter": f"with {_HEADS} select * from heads where regexp_full_match(title, '[A-M].*[.]')",
    "affix_filter": f"with {_HEADS} select doc_id, title from heads where starts_with(title, 'D') and not ends_with(title, '?')",
    "accumulate_list": "select l_partkey, sum(l_linenumber)::bigint as n from lineitem group by 1",
    "distinct_documents": f"with {_TERMS} select term, count(distinct item_id) as df, count(*) as n from terms group by term",
    "cogroup_counts": "select user_id, count(*) filter (where event_type = 'click') as n_left, count(*) filter (where event_type = 'purchase') as n_right, count(*) filter (where event_type = 'click') as sum_left, 2 * count(*) filter (where event_type = 'purchase') as sum_right from events where event_type in ('click', 'purchase') group by 1",
    "semi_join": "select c_custkey from customer where c_custkey in (select o_custkey from orders)",
    "anti_join": "select doc_id from documents where doc_id not in (select doc_id from labels)",
    "equi_join_top": "select c_name, n_name from customer join nation on c_nationkey = n_nationkey order by c_name limit 10",
    "containment_join": "with r as (select distinct l_orderkey as id, l_suppkey as item from lineitem), s as (select id, count(*) as size from r where id % 50 = 0 group by 1) select a.id as small_id, b.id as large_id from r a join r b on a.item = b.item join s on s.id = a.id group by a.id, b.id, s.size having count(*) = s.size",
    "top_per_key": "select * from (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as rank from orders) where rank <= 3",
    "prefix_rollup": f"with p as (select {tokens_sql('text')} as t from benchmark) select array_to_string(t[1:k], ' ') as prefix, count(*) as n from (select t, unnest(range(1, len(t) + 1)) as k from p) group by 1",
    "day_islands": f"with x as (select distinct user_id as \"user\", {_DAY} as day from events) select \"user\", min(day)::varchar as start, count(*)::int as days from (select *, day - row_number() over (partition by \"user\" order by day)::int as g from x) group by \"user\", g",
    "union_distinct": "select p_brand as name from part union select r_name from region",
    "value_statistics": "select event_type, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as deviation, min(value) as low, max(value) as high from events group by 1",
    "text_functions": f"""with {_HEADS} select doc_id, array_to_string({tokens_sql('title')}, '|') as tokens, {hash32_sql('title')} as hash, levenshtein(lower(regexp_replace(title, '[^ -~]', '?', 'g')), lower(source))::int as distance, len(list_filter(string_split(title, '.'), lambda x: x <> ''))::int as parts,
regexp_replace(title, '^[ABCDEFGHIJ]+', '') as left_trimmed, regexp_replace(title, '[. ]+$', '') as right_trimmed, array_to_string(list_transform({tokens_sql('title')}, lambda t: left(t, 1)), '') as letters, title as half, translate(title, 'äé', 'ae') as plain from heads""",
    "date_functions": f"select event_id, case when event_id % 3 < 2 then ({_DAY})::varchar end as parsed, ({_DAY})::varchar as from_epoch, ({_DAY} - date '2024-01-01')::int as days, ({_DAY} + 7)::varchar as shifted, {_DAY} between '2024-01-05' and '2024-01-09' as inside from events",
    "number_functions": f"with x as (select distinct l_orderkey, l_linenumber, l_quantity as f from lineitem) select l_orderkey, l_linenumber, f, round({_LLR}, 6) as llr, round(f * 1000 / {_F1} / {_F2}, 6) as mi, (ceil(sqrt(case when f > 200 then 100 else floor(f / 2) end) * 3 * case when round({_LLR}, 9) >= 10 then sqrt(least(round({_LLR}, 9), 100)) else 5 end) + 1)::int as score, round(1 / (1 + exp(-f / 10)), 6) as sigmoid, round(least(greatest(f, 5), 20), 6) as clipped, floor((f / 7 + 0.0005::double) * 1000) / 1000 as rounded, round({_ENT}, 6) as entropy from x",
    "topic_json": _SERIES["series_clip"].replace("select * replace (day::varchar as day) from series", "select key, (2 + sum(length('{\"day\":\"\",\"value\":}') + length(day::varchar) + length(value::varchar)) + count(*) - 1)::int as chars from series") + " group by key",
}
