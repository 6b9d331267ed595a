"""Query-log, correction and concept queries: names of ordered parts are the log, line numbers its time slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import duplicate_label, input_kind, tokens, tokens_sql
from tessera.operators import queries as q
from tessera.plans.staging import stage


def _log(s: SparkSession, d: str) -> DataFrame:
    lines, parts = s.read.parquet(f"{d}/lineitem.parquet"), s.read.parquet(f"{d}/part.parquet")
    log = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_linenumber").alias("time_id"), F.col("p_name").alias("query")).agg(F.count("*").alias("cnt"))
    return stage(log.withColumn("is_latest", F.col("time_id") >= 4), "log")


def _model(s: SparkSession, d: str) -> DataFrame:
    return q.character_model(s.read.parquet(f"{d}/benchmark.parquet"))


def _update(s: SparkSession, d: str) -> DataFrame:
    log = _log(s, d).select("query", F.col("cnt").alias("df"))
    return q.update_character_model(_model(s, d), log).select("gram", "n", F.round("p", 8).alias("p"))


def _members(s: SparkSession, d: str) -> DataFrame:
    """Concepts are the frequent terms of benchmark items, documents the items."""
    b = s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), F.explode(tokens(F.col("text"))).alias("concept")).distinct()
    often = b.groupBy("concept").agg(F.count("*").alias("n")).where("n >= 5").select("concept")
    return stage(b.join(often, "concept", "left_semi"), "members")


def _global(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("concept")).groupBy("concept").agg(F.count("*").alias("g"))


def _concepts(s: SparkSession, d: str) -> DataFrame:
    out = q.concept_scores(_members(s, d), _global(s, d), s.read.parquet(f"{d}/documents.parquet").count())
    return out.select("concept", "df", F.round("score", 6).alias("score"), F.round("rank_score", 6).alias("rank_score"))


def _tree(s: SparkSession, d: str) -> DataFrame:
    m = _members(s, d)
    scores = _concepts(s, d).select((F.char_length("concept") % 3).cast("long").alias("query_id"), "concept", "score")
    c = q.containment(m).withColumn("query_id", (F.char_length("a") % 3).cast("long")).where((F.char_length("b") % 3) == F.col("query_id"))
    return q.concept_tree(scores, c.select("query_id", "a", "b", "contain"))


def _phrases(s: SparkSession, d: str) -> DataFrame:
    return _log(s, d).select(F.col("query").alias("concept")).distinct()


#: A tiny dictionary and model, as the tests of the operator use; real ones come with a language.
_DICTIONARY = {"nuo": ["诺"], "ji": ["基", "机", "记"], "ya": ["亚", "呀"], "shou": ["手", "首"], "zhong": ["中"], "guo": ["国"], "zong": ["总"]}
_BIGRAMS = {"诺基": 0.4, "基亚": 0.5, "诺基亚": 0.9, "手机": 0.6, "中国": 0.7, "诺": 0.01, "手": 0.02, "中": 0.05, "首": 0.01, "总": 0.01}


def _pinyin(s: SparkSession, d: str) -> DataFrame:
    return q.correct_pinyin(s.createDataFrame([("nuojiya",), ("shouji",), ("zongguo",), ("hello",), ("",), (None,)], "query string"), _DICTIONARY, _BIGRAMS)


def _readings(s: SparkSession, d: str) -> DataFrame:
    table = s.createDataFrame([(c, p) for p, cs in _DICTIONARY.items() for c in cs], "char string, pinyin string")
    return q.to_pinyin(s.createDataFrame([("诺基亚手机",), ("中国x",)], "text string"), table).select("text", "position", "char", F.array_join("readings", ",").alias("readings"))


def _labels(s: SparkSession, d: str) -> DataFrame:
    p = _phrases(s, d)
    first = F.substring("concept", 1, 2)
    a, b = p.select(F.col("concept").alias("a"), first.alias("k")), p.select(F.col("concept").alias("b"), first.alias("k"))
    return a.join(b, "k").where("a < b").where(duplicate_label(F.col("a"), F.col("b"))).select("a", "b")


QUERIES = {
    "char_model_train": lambda s, d: _model(s, d).select("gram", "n", F.round("p", 8).alias("p")),
    "char_model_update": _update,
    "popular_queries": lambda s, d: q.popular_queries(_log(s, d), 10).withColumn("score", F.round("score", 6)),
    "realtime_queries": lambda s, d: q.realtime_queries(_log(s, d), 10).withColumn("score", F.round("score", 6)),
    "popular_queries_distinct": lambda s, d: q.without_shared_terms(q.popular_queries(_log(s, d), 10), 10),
    "query_kinds": lambda s, d: _phrases(s, d).select("concept", input_kind(F.col("concept")).alias("kind")),
    "query_correction": _pinyin,
    "query_pinyin": _readings,
    "concept_scores": _concepts,
    "concept_containment": lambda s, d: q.containment(_members(s, d), 0.3).withColumn("contain", F.round("contain", 6)),
    "concept_sibship": lambda s, d: q.sibship(_phrases(s, d)),
    "concept_tree": _tree,
    "label_duplicates": _labels,
}

_RUNS = "runs as (select unnest(regexp_extract_all(text, '\\p{L}+')) as run from benchmark), spots as (select run, unnest(range(1, length(run) + 1)) as i from runs), grams as (select unnest([substr(run, i, 1), case when i + 2 <= length(run) + 1 then substr(run, i, 2) end, case when i + 3 <= length(run) + 1 then substr(run, i, 3) end]) as gram from spots), counts as (select gram, length(gram)::int as n, count(*) as c from grams where gram is not null group by all)"
_MODEL = f"""{_RUNS}, two as (select b.gram, b.n, b.c, b.c / u.c as p from counts b join counts u on u.gram = substr(b.gram, 1, 1) and u.n = 1 where b.n = 2),
three as (select t.gram, t.n, t.c / w.c as p, w.p as hp from counts t join two w on w.gram = substr(t.gram, 1, 2) where t.n = 3),
model as (select gram, n, c / (select sum(c) from counts where n = 1) as p from counts where n = 1 union all select gram, n, p from two where p >= 0.0015::double union all select gram, n, p from three where hp * p >= 0.00015::double)"""
_LOG = "log as (select l_linenumber as time_id, p_name as query, count(*) as cnt, l_linenumber >= 4 as is_latest from lineitem join part on l_partkey = p_partkey group by all)"
_TERMS = f"list_distinct({tokens_sql('query')})"
_POPULAR = f"""{_LOG}, each as (select time_id, cnt, unnest({_TERMS}) as term from log), bt as (select term, time_id, sum(cnt) as c from each group by all), pt as (select *, c / sum(c) over (partition by term) as p from bt),
terms as (select term, sum(c) as c, sum(-p * ln(p)) as h from pt group by term), w as (select sum(c) as n, sum(h) as hh from terms), scored as (select term, ln((c + 200 * h) / (n + 200 * hh + 1) + 1) as s from terms, w),
freq as (select query, freq, unnest({_TERMS}) as term from (select query, sum(cnt)::bigint as freq from log group by query))
select query, freq, round(score, 6) as score from (select query, freq, sum(s) * sqrt(freq + 0.01::double) as score from freq join scored using (term) group by query, freq order by round(score, 9) desc, query limit 50)"""
_REAL = f"""{_LOG}, each as (select cnt, is_latest, unnest({_TERMS}) as term from log), terms as (select term, sum(case when is_latest then cnt else 0 end) as now_, sum(case when is_latest then 0 else cnt end) as past from each group by term), t as (select sum(now_) as n from terms),
freq as (select query, freq, unnest({_TERMS}) as term from (select query, sum(cnt)::bigint as freq from log where is_latest group by query)),
g as (select query, freq, sum(ln(now_ / (n + 1) + 1)) as s, avg((now_ + 1) / (past + 1)) as novelty from freq join terms using (term), t group by all)
select query, freq, round(score, 6) as score from (select query, freq, novelty * sqrt(freq * s + 0.01::double) as score from g order by round(score, 9) desc, query limit 100)"""
_MEMBERS = f"m0 as (select distinct item_id as doc_id, unnest({tokens_sql('text')}) as concept from benchmark), members as (select * from m0 where concept in (select concept from m0 group by concept having count(*) >= 5))"
_PHRASES = f"{_LOG}, phrases as (select distinct query as concept from log)"
_N = "(select count(*) from documents)::double"
ORACLE = {
    "char_model_train": f"with {_MODEL} select gram, n, round(p, 8) as p from model",
    "char_model_update": f"""with {_MODEL}, {_LOG}, spots2 as (select query, cnt, unnest(range(1, length(query) + 1)) as i from log),
added as (select substr(query, i, 1) as gram, 1 as n, cnt * 1e-6::double as p from spots2 union all select substr(query, i, 2), 2, cnt * 0.004::double from spots2 where i + 2 <= length(query) + 1 union all select substr(query, i, 3), 3, cnt * 0.004::double from spots2 where i + 3 <= length(query) + 1)
select gram, n::int as n, round(sum(p), 8) as p from (select gram, n, p from model union all select * from added) group by all""",
    "popular_queries": f"with {_POPULAR}",
    "realtime_queries": f"with {_REAL}",
    "query_kinds": f"with {_PHRASES} select concept, (case when regexp_matches(concept, '^[A-Za-z'' ]+$') then 1 when regexp_matches(concept, '^\\p{{Han}}+$') then -1 else 0 end)::int as kind from phrases",
    "concept_scores": f"""with {_MEMBERS}, g as (select concept, count(*) as g from (select unnest(list_distinct({tokens_sql('text')})) as concept from documents) group by concept), d as (select concept, count(distinct doc_id) as df from members group by concept), nd as (select count(distinct doc_id) as k from members)
select concept, df, round(case when k > 10 and df > k / 3.5 then 0 else ln(df + 1) / ln((sqrt(g + 1) + 1) / ln({_N} + 2) + 2) end, 6) as score, round(case when k > 10 and df > k / 3.5 then 0 else ln(df + 1) / ln((g + greatest(2, {_N} / 10000)) / ln(sqrt({_N} + 1) + 1) + 1) end, 6) as rank_score from d join g using (concept), nd""",
    "concept_containment": f"with {_MEMBERS}, sizes as (select concept, count(*) as n from members group by concept), met as (select a.concept as a, b.concept as b, count(*) as shared from members a join members b on a.doc_id = b.doc_id and a.concept <> b.concept group by all) select a, b, shared, round(shared / n, 6) as contain from met join sizes on concept = b where shared / n between 0.3::double and 1",
    "concept_sibship": f"with {_PHRASES}, t as (select concept, len({tokens_sql('concept')}) as n, unnest({tokens_sql('concept')}) as term, generate_subscripts({tokens_sql('concept')}, 1) as i from phrases) select a.concept as a, b.concept as b, count(*) as equal from t a join t b on a.n = b.n and a.i = b.i and a.term = b.term and a.concept < b.concept group by all",
    "label_duplicates": f"with {_PHRASES}, p as (select concept, {tokens_sql('concept')} as t from phrases) select a.concept as a, b.concept as b from p a join p b on a.concept < b.concept and left(a.concept, 2) = left(b.concept, 2) where len(a.t) = len(b.t) and list_transform(a.t, lambda x: left(x, 1)) = list_transform(b.t, lambda x: left(x, 1)) and levenshtein(lower(a.concept), lower(b.concept)) < 4",
}
