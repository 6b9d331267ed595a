"""Queries of analysed terms, phrase tests, ids, sparse cosine, topic links and title classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import hash32_sql, tokens, tokens_sql
from tessera.operators import analysis, keyphrase
from tessera.operators.lsh import trivial_hash
from tessera.plans.staging import stage

STOP_WORDS = ("the", "of", "and", "to", "in", "der", "die", "und", "de", "la")


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _items(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


def _counts(s: SparkSession, d: str) -> DataFrame:
    return stage(keyphrase.phrase_counts(keyphrase.ngrams(_items(s, d), 3)), "phrases")


def _scored(s: SparkSession, d: str) -> DataFrame:
    grams = keyphrase.ngrams(_items(s, d), 2)
    return grams.groupBy("doc_id", "phrase").agg(F.count("*").alias("score"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    terms = analysis.positions(_t(s, d, "benchmark"), "item_id")
    return stage(terms.groupBy(F.col("doc_id").alias("id"), F.col("term").alias("dim")).agg(F.count("*").cast("double").alias("value")), "vectors")


def _cosine(s: SparkSession, d: str) -> DataFrame:
    pairs = _t(s, d, "benchmark").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"))
    return analysis.sparse_cosine(pairs, _vectors(s, d)).select("a", "b", F.round("cosine", 6).alias("cosine"))


def _similar(s: SparkSession, d: str) -> DataFrame:
    terms = analysis.positions(_t(s, d, "benchmark"), "item_id")
    counts = terms.groupBy("term", F.col("doc_id").alias("context")).agg(F.count("*").alias("n"))
    common = counts.groupBy("term").agg(F.count("*").alias("df")).where("df >= 3").select("term")
    out = analysis.similar_terms(stage(counts.join(common, "term"), "contexts"), 0.4, 5, 500)
    return out.select("id", "other", F.round("sim", 6).alias("sim"), "rank")


def _links(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "events")
    series = e.groupBy(F.col("user_id").alias("topic"), F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("value"))
    out = analysis.linked_topics(stage(series, "daily"), 0.8)
    return out.select("id", "other", F.round("sim", 6).alias("sim"), "rank")


def _merged(s: SparkSession, d: str) -> DataFrame:
    p = _t(s, d, "part").select((F.col("p_size")).alias("group"), F.explode(F.split("p_name", " ")).alias("text"))
    return analysis.merged_text(p)


def _heads(s: SparkSession, d: str) -> DataFrame:
    docs = _t(s, d, "documents").select("doc_id", "lang", F.slice(tokens(F.substring_index("text", "\n", 1)), 1, 15).alias("terms"))
    return docs.where("lang is not null and terms is not null")


def _classes(s: SparkSession, d: str) -> DataFrame:
    docs = stage(_heads(s, d), "titles")
    model = stage(analysis.bayes_train(docs.where("doc_id % 4 <> 0").select(F.col("lang").alias("class"), "terms")), "bayes")
    out = analysis.bayes_classify(docs.where("doc_id % 4 = 0").select(F.col("doc_id").alias("row_id"), "terms"), model)
    return out.select("row_id", "class", F.round("score", 5).alias("score"))


def _aligned(s: SparkSession, d: str) -> DataFrame:
    p = _t(s, d, "part").select("p_partkey", analysis.aligned(F.split("p_name", " "), F.split("p_type", " ")).alias("pairs"))
    return p.select("p_partkey", F.array_join(F.transform("pairs", lambda x: F.concat_ws(":", x["left"], x["right"])), "|").alias("pairs"))


def _titled(s: SparkSession, d: str) -> DataFrame:
    """Phrases of benchmark items; an item's first eight terms are its title."""
    n = _items(s, d).count()
    tf = keyphrase.ngrams(_items(s, d), 3).where("n_terms >= 2").groupBy("doc_id", "phrase").agg(F.count("*").alias("tf"))
    df = tf.groupBy("phrase").agg(F.count("*").alias("df")).where("df >= 2")
    candidates = tf.join(df, "phrase").select("doc_id", "phrase", (F.col("tf") * F.log(F.lit(n) / F.col("df"))).alias("tf_idf"))
    words = stage(analysis.positions(_items(s, d)), "words")
    out = keyphrase.titled_keyphrases(candidates, words.where("pos < 8"), words.groupBy("doc_id", "term").agg(F.count("*").alias("tf")), n)
    return out.select("doc_id", "phrase", F.round("score", 3).alias("score"), "rank")


QUERIES = {
    "titled_keyphrases": _titled,
    "typed_terms": lambda s, d: analysis.analyse(_items(s, d)),
    "analysed_terms": lambda s, d: analysis.analyse(_items(s, d), s.createDataFrame([(w,) for w in STOP_WORDS], "term string"), 3, ("latin", "mixed"), stems=True, merge_numbers=True),
    "stemmed_terms": lambda s, d: analysis.stemmed(analysis.positions(_t(s, d, "documents"), "doc_id").select("term").distinct()),
    "prefix_status": lambda s, d: analysis.prefix_status(_counts(s, d), STOP_WORDS),
    "near_equal_phrases": lambda s, d: analysis.drop_near_equal(stage(_scored(s, d), "scored")),
    "aligned_terms": _aligned,
    "row_shards": lambda s, d: _t(s, d, "part").groupBy(analysis.row_shard(F.col("p_partkey"), 7).alias("shard")).agg(F.count("*").alias("n")),
    "term_ids": lambda s, d: analysis.term_ids(analysis.positions(_t(s, d, "documents"))),
    "sparse_cosine": _cosine,
    "term_similarity": _similar,
    "topic_links": _links,
    "topic_merged_text": _merged,
    "title_classes": _classes,
    "contained_labels": lambda s, d: analysis.contained_labels(_t(s, d, "nation").select(F.lower(F.substring("n_name", 1, 3)).alias("label")), _t(s, d, "part").select(F.lower("p_type").alias("text"))),
    "lsh_trivial": lambda s, d: _t(s, d, "embeddings").select("vec_id", trivial_hash().alias("hash")),
}

_KIND = "case when regexp_matches(term, '^\\p{N}+$') then 'number' when regexp_matches(term, '^\\p{Han}$') then 'han' when regexp_matches(term, '^[a-z]+$') then 'latin' else 'mixed' end"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _positions(table: str, key: str) -> str:
    return f"(select {key} as doc_id, unnest(t) as term, generate_subscripts(t, 1) - 1 as pos from (select {key}, {tokens_sql('text')} as t from {table}))"


def _stem(source: str) -> str:
    out = f"(select * from {source})"
    for name, _, rule in analysis.STEM_STEPS:
        out = f"(select *, {rule.format(m='regexp_matches')} as {name} from {out})"
    return f"(select * exclude (plural, bare, mended, stem), case when regexp_matches(term, '^[a-z]+$') then stem else term end as stem from {out})"


_SPLITS = lambda c: f"(regexp_matches({c}, '^\\p{{N}}+$') or {c} in ({_STOP}) or regexp_matches({c}, '^[a-z]$'))"
_GRAMS = f"""toks as (select item_id as doc_id, {tokens_sql("text")} as t from benchmark), starts as (select doc_id, t, unnest(range(1, len(t) + 1)) as i from toks),
spans as (select *, unnest(range(1, least(3, len(t) - i + 1) + 1)) as n from starts),
grams as (select * from (select doc_id, n, array_to_string(t[i:i + n - 1], ' ') as phrase, t[i] as first, t[i + n - 1] as last, array_to_string(t[i:i + n - 2], ' ') as prefix from spans) where not regexp_matches(phrase, '(^| )\\p{{N}}+( |$)'))"""
_BOTH = "both_ as (select a as id, b as other, sim from pairs union all select b, a, sim from pairs) select id, other, round(sim, 6) as sim, rank from (select *, row_number() over (partition by id order by round(sim, 9) desc, other desc)::int as rank from both_)"
_ENTRIES = ", ".join(f"({hash32_sql(f'''concat_ws('#', context::varchar, '{i}')''')}) % 500" for i in range(10))
_ROUND = """r{i} as (select pair_id, source, target, p / sum(p) over (partition by pair_id, source) as c from pairs join t{j} using (source, target)),
t{i} as (select source, target, c / sum(c) over (partition by target) as p from (select source, target, sum(c) as c from r{i} group by all))"""
ORACLE = {
    "titled_keyphrases": f"""with {_GRAMS}, nd as (select count(*) as n from benchmark), tf as (select doc_id, phrase, count(*) as tf from grams where n >= 2 group by all), df as (select phrase, count(*) as df from tf group by 1 having count(*) >= 2),
cand as (select doc_id, phrase, tf * ln((select n from nd) / df) as w, row_number() over (partition by doc_id order by round(tf * ln((select n from nd) / df), 9) desc, phrase) as place from tf join df using (phrase)),
words as {_positions('benchmark', 'item_id')}, ttl as (select * from words where pos < 8), size as (select doc_id, least(a.n, b.n) as size from (select doc_id, count(*) as n from cand group by 1) a join (select doc_id, count(*) as n from ttl group by 1) b using (doc_id)),
pairs as (select c.doc_id as pair_id, c.phrase as source, t.term as target from cand c join size s using (doc_id) join ttl t on t.doc_id = c.doc_id where c.place <= s.size and t.pos < s.size),
t0 as (select distinct source, target, 1.0::double / (select count(distinct source) from pairs) as p from pairs), {", ".join(_ROUND.format(i=i, j=i - 1) for i in range(1, 21))},
tt as (select doc_id, term, count(*) as tf from words group by 1, 2), td as (select term, count(*) as df from tt group by 1), tw as (select doc_id, term, tf * ln((select n from nd) / df) as w from tt join td using (term)),
sc as (select c.doc_id, c.phrase, round(sum(tw.w * t.p) * length(c.phrase) * length(c.phrase), 6) as score from cand c join t20 t on t.source = c.phrase join tw on tw.doc_id = c.doc_id and tw.term = t.target group by 1, 2),
met as (select a.doc_id, a.phrase as long, b.phrase as short, a.score > b.score as wins from sc a join sc b on a.doc_id = b.doc_id and length(a.phrase) = length(b.phrase) + 1 and (starts_with(a.phrase, b.phrase) or ends_with(a.phrase, b.phrase))),
gone as (select doc_id, case when wins then short else long end as phrase from met), kept as (select * from sc where (doc_id, phrase) not in (select (doc_id, phrase) from gone) and score >= 4)
select doc_id, phrase, round(score, 3) as score, rank from (select *, row_number() over (partition by doc_id order by score desc, phrase)::int as rank from kept) where rank <= 15""",
    "typed_terms": f"select doc_id, pos::int as pos, term, {_KIND} as kind from {_positions('benchmark', 'item_id')}",
    "analysed_terms": f"""with p as (select doc_id, pos, term, {_KIND} as kind from {_positions('benchmark', 'item_id')}), m as (select doc_id, pos, case when kind = 'latin' and lead(kind) over w = 'number' then concat(term, lead(term) over w) else term end as term, coalesce(kind = 'number' and lag(kind) over w = 'latin', false) as gone from p window w as (partition by doc_id order by pos)),
k as (select doc_id, pos, term, {_KIND} as kind from m where not gone) select doc_id, pos::int as pos, stem as term, kind from {_stem('k')} where stem not in ({_STOP}) and length(stem) >= 3 and kind in ('latin', 'mixed')""",
    "stemmed_terms": f"with d as (select distinct term from {_positions('documents', 'doc_id')}) select term, stem from {_stem('d')}",
    "prefix_status": f"""with {_GRAMS}, c as (select phrase, first, last, prefix, count(*) as f from grams group by all) select phrase, f, case when {_SPLITS("first")} then 'return' when {_SPLITS("last")} then 'none' when phrase in (select prefix from c) then 'candidate' else 'phrase' end as status from c""",
    "near_equal_phrases": f"""with {_GRAMS}, s as (select doc_id, phrase, count(*) as score from grams where n <= 2 group by all), met as (select a.doc_id, a.phrase as long, b.phrase as short, a.score > b.score as wins from s a join s b on a.doc_id = b.doc_id and length(a.phrase) = length(b.phrase) + 1 and (starts_with(a.phrase, b.phrase) or ends_with(a.phrase, b.phrase))),
gone as (select doc_id, case when wins then short else long end as phrase from met) select * from s where (doc_id, phrase) not in (select (doc_id, phrase) from gone)""",
    "aligned_terms": "select p_partkey, array_to_string(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] || ':' || b[i]), '|') as pairs from (select p_partkey, string_split(p_name, ' ') as a, string_split(p_type, ' ') as b from part)",
    "row_shards": "select (p_partkey % 7)::int as shard, count(*) as n from part group by 1",
    "sparse_cosine": f"""with v as (select doc_id as id, term, count(*)::double as x from {_positions('benchmark', 'item_id')} group by all), n as (select id, sqrt(sum(x * x)) as n from v group by 1), p as (select item_id as a, item_id + 1 as b from benchmark),
i as (select a, b, sum(u.x * w.x) as s from p join v u on u.id = a join v w on w.id = b and w.term = u.term group by 1, 2) select p.a, p.b, round(case when coalesce(x.n, 0) * coalesce(y.n, 0) = 0 then -100 else coalesce(s, 0) / (x.n * y.n) end, 6) as cosine from p left join i using (a, b) left join n x on x.id = p.a left join n y on y.id = p.b""",
    "term_similarity": f"""with c as (select term, doc_id as context, count(*) as n from {_positions('benchmark', 'item_id')} group by all), k as (select * from c where term in (select term from c group by 1 having count(*) >= 3)),
e as (select term as id, n, unnest([{_ENTRIES}]) as dim, unnest(range(10)) as i from k), v as (select id, dim, sum(case when i % 2 = 0 then n else -n end)::double as x from e group by 1, 2 having sum(case when i % 2 = 0 then n else -n end) <> 0),
u as (select id, dim, x / sqrt(sum(x * x) over (partition by id)) as x from v), pairs as (select p.id as a, q.id as b, sum(p.x * q.x) as sim from u p join u q on p.dim = q.dim and p.id < q.id group by 1, 2 having sum(p.x * q.x) >= 0.4), {_BOTH} where rank <= 5""",
    "topic_links": f"""with v as (select user_id as id, ts::date as dim, count(*)::double as x from events group by 1, 2), u as (select id, dim, x / sqrt(sum(x * x) over (partition by id)) as x from v),
pairs as (select p.id as a, q.id as b, sum(p.x * q.x) as sim from u p join u q on p.dim = q.dim and p.id < q.id group by 1, 2 having sum(p.x * q.x) >= 0.8), {_BOTH} where rank <= 10""",
    "topic_merged_text": """with t as (select distinct p_size as g, unnest(string_split(p_name, ' ')) as text from part), k as (select a.g, a.text from t a where not exists (select 1 from t b where a.g = b.g and (length(b.text) > length(a.text) or length(b.text) = length(a.text) and b.text < a.text) and contains(b.text, a.text)))
select g as "group", string_agg(text, ',' order by -length(text), text) as text from k group by 1""",
    "title_classes": f"""with h as (select doc_id, lang, ({tokens_sql("string_split(text, chr(10))[1]")})[1:15] as terms from documents where lang is not null), tr as (select * from h where doc_id % 4 <> 0), te as (select * from h where doc_id % 4 = 0),
pr as (select lang as class, ln(count(*) / (select count(*) from tr)) as prior from tr group by 1), e as (select lang as class, unnest(terms) as term from tr), c as (select class, term, count(*) as c from e group by 1, 2), w as (select class, sum(c) + (select count(distinct term) from e) as whole from c group by 1),
s as (select te.doc_id, t.term, pr.class, pr.prior, w.whole from te, pr, w, lateral (select unnest(te.terms) as term) t where w.class = pr.class), sc as (select doc_id as row_id, s.class, any_value(prior) + sum(ln((coalesce(c.c, 0) + 1) / whole)) as score from s left join c on c.class = s.class and c.term = s.term group by 1, 2),
none as (select te.doc_id as row_id, pr.class, pr.prior as score from te, pr where len(te.terms) = 0), every as (select * from sc union all select * from none) select row_id, class, round(score, 5) as score from (select *, row_number() over (partition by row_id order by round(score, 9) desc, class) as r from every) where r = 1""",
    "contained_labels": "with l as (select distinct lower(substr(n_name, 1, 3)) as label from nation) select label, (select count(*) from part where contains(lower(p_type), label)) as n from l",
    "lsh_trivial": "select vec_id, 0 as hash from embeddings",
}
