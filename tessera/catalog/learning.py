"""Click-through and classification queries: clicks of ``events``, ratings of ``lineitem``, labelled ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import hash32, tokens
from tessera.operators import learning as ml
from tessera.plans.staging import stage


def _impressions(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    features = F.array(F.concat(F.lit("user="), F.col("user_id")), F.concat(F.lit("hour="), F.hour("ts")), F.concat(F.lit("big="), F.col("value") > 50))
    return e.select(F.date_format("ts", "E").alias("model"), F.col("event_id").alias("seq"), F.col("event_id").alias("row_id"), features.alias("features"), (F.col("event_type") == "click").alias("clicked"))


def _click_rates(s: SparkSession, d: str) -> DataFrame:
    """Weights without training: each feature's click rate, as a table that statements can rebuild."""
    each = _impressions(s, d).select("model", F.explode("features").alias("feature"), F.col("clicked").cast("int").alias("y"))
    return each.groupBy("model", "feature").agg((F.avg("y") - 0.25).alias("w"), (F.avg("y") * 40).alias("mean"), (F.lit(400.0) / F.count("*")).alias("variance"))


def _ratings(s: SparkSession, d: str) -> DataFrame:
    r = s.read.parquet(f"{d}/lineitem.parquet").select(F.xxhash64("l_orderkey", "l_linenumber").alias("row_id"), (F.col("l_suppkey") % 10).alias("a"), (F.col("l_partkey") % 10 + 10).alias("b"), (F.col("l_quantity") / 10).alias("label"))
    features = F.array(*[F.struct(F.col(c).cast("long").alias("feature"), F.lit(1.0).alias("value")) for c in "ab"])
    return r.select(F.concat(F.lit("m"), F.col("a") % 4).alias("model"), F.col("row_id").alias("seq"), "row_id", features.alias("features"), "label")


def _fm_fixed(s: SparkSession, d: str) -> DataFrame:
    """A given model on suppliers (odd features) and parts (even ones)."""
    line = s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.explode(F.array(F.col("l_suppkey") * 2 + 1, F.col("l_partkey") * 2)).alias("feature"))
    f = F.col("feature")
    weights = line.select("feature").distinct().select("feature", (f % 97 / 100).alias("w"), F.array(f % 89 / 100, F.lit(0.5) - f % 83 / 200).alias("v"))
    return ml.fm_predict(line.withColumn("value", F.lit(1.0)), 0.5, weights, 2, 0.0, 2.5).select("row_id", F.round("y", 6).alias("y"))


def _labelled(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet").join(s.read.parquet(f"{d}/labels.parquet"), "doc_id")
    long = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    marks = F.when(F.rlike("text", F.lit(r"[#*$%&]{2}")), "marks").otherwise("plain")
    return docs.select(F.col("doc_id").alias("row_id"), F.array(long, marks, F.concat(F.lit("lang="), F.coalesce("lang", F.lit("?")))).alias("features"), F.col("quality").cast("string").alias("outcome"))


def _maxent(s: SparkSession, d: str) -> DataFrame:
    return ml.maxent_train(ml.maxent_events(_labelled(s, d)))


def _maxent_predict(s: SparkSession, d: str) -> DataFrame:
    return ml.maxent_predict(_labelled(s, d), _maxent(s, d)).withColumn("p", F.round("p", 6))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 2).cast("double").alias("label"))
    return e.withColumn("features", array_to_vector("x"))


def _svm(s: SparkSession, d: str) -> DataFrame:
    rows = _vectors(s, d)
    return ml.linear_svm(rows).transform(rows).select("vec_id", "prediction")


def _rbf(s: SparkSession, d: str) -> DataFrame:
    rows = _vectors(s, d).drop("features")
    model, lift = ml.rbf_svm(rows, features_col="x")
    return model.transform(lift(rows)).select("vec_id", "prediction")


def _fm(s: SparkSession, d: str) -> DataFrame:
    rows = _vectors(s, d)
    return ml.fm_train(rows).transform(rows).select("vec_id", "prediction")


def _als(s: SparkSession, d: str) -> DataFrame:
    line = s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") % 100).cast("int").alias("user"), (F.col("l_partkey") % 100).cast("int").alias("item")).groupBy("user", "item").agg(F.count("*").cast("float").alias("weight"))
    return ml.implicit_factors(line).transform(line).select("user", "item", "prediction")


def _rmse(s: SparkSession, d: str) -> DataFrame:
    truth = s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), (F.col("l_quantity") / 20).alias("label"))
    return ml.rmse(truth.join(_fm_fixed(s, d), "row_id")).select(F.round("rmse", 5).alias("rmse"))


def _lda(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), tokens(F.col("text")).alias("t"))
    words = docs.select((F.col("doc_id") % 4).cast("int").alias("shard"), "doc_id", F.explode("t").alias("word"))
    labels = docs.select("doc_id", F.explode(F.array(F.lit("all"), F.concat(F.lit("size"), (F.size("t") % 3).cast("string")))).alias("topic"))
    return ml.labeled_lda(words, labels, 5)


def _paragraphs(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", tokens(F.col("text")).alias("tokens"))
    from pyspark.ml.functions import vector_to_array

    return ml.paragraph_vectors(docs, 8).transform(docs).select("conv_id", "turn", vector_to_array("vector").alias("vector"))


def _weights(s: SparkSession, d: str) -> DataFrame:
    return stage(_click_rates(s, d), "weights")


QUERIES = {
    "ctr_ad_predictor": lambda s, d: ml.ad_predictor(_impressions(s, d)),
    "ctr_ad_forget": lambda s, d: ml.ad_forget(_weights(s, d)).select("model", "feature", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance")),
    "ctr_ad_predict": lambda s, d: ml.ad_predict(_impressions(s, d), _weights(s, d)),
    "ctr_ftrl": lambda s, d: ml.ftrl(_impressions(s, d)),
    "ctr_ftrl_strict": lambda s, d: ml.ftrl(_impressions(s, d), strict=True),
    "ctr_linear_predict": lambda s, d: ml.linear_predict(_impressions(s, d), _weights(s, d)).select("row_id", F.round("p", 6).alias("p")),
    "fm_predict": _fm_fixed,
    "fm_sgd": lambda s, d: ml.fm_sgd(_ratings(s, d), 2, epochs=2),
    "fm_als": lambda s, d: ml.fm_als(_ratings(s, d), 2, sweeps=3),
    "fm_mcmc": lambda s, d: ml.fm_als(_ratings(s, d), 2, sweeps=4, gibbs=True),
    "fm_regressor": _fm,
    "fm_rmse": _rmse,
    "context_factors": _als,
    "maxent_events": lambda s, d: ml.maxent_events(_labelled(s, d), 2).select(F.array_join("features", ",").alias("features"), "outcome", "n"),
    "maxent_train": lambda s, d: _maxent(s, d).withColumn("theta", F.round("theta", 6)),
    "maxent_predict": _maxent_predict,
    "svm_linear": _svm,
    "svm_rbf": _rbf,
    "labeled_lda": _lda,
    "paragraph_vectors": _paragraphs,
}

_IMP = """imp as (select strftime(ts, '%a') as model, event_id as row_id, unnest(['user=' || user_id, 'hour=' || hour(ts), 'big=' || (value > 50)]) as feature, (event_type = 'click')::int as y from events),
weights as (select model, feature, avg(y) - 0.25::double as w, avg(y) * 40 as mean, 400.0::double / count(*) as variance from imp group by all)"""
_FRESH = "(400::double * variance / ((1 - 0.08::double) * 400 + 0.08::double * variance))"
_LAB = """lab as (select doc_id as row_id, list_sort([case when n_chars > 2000 then 'long' else 'short' end, case when regexp_matches(text, '[#*$%&]{2}') then 'marks' else 'plain' end, 'lang=' || coalesce(lang, '?')]) as f, quality::varchar as outcome from documents join labels using (doc_id))"""
_GIS = f"""{_LAB}, ev as (select f, outcome, count(*) as n from lab group by all), active as (select f, outcome as o, n, unnest(f) as feature from ev), observed as (select feature, o as outcome, sum(n) as seen from active group by all), outs as (select distinct outcome from ev), t0 as (select feature, outcome, 0.0::double as theta from observed)"""
for _i in range(1, 16):
    _GIS += f""", s{_i} as (select a.f, a.o, a.n, t.outcome, sum(theta) as s from active a join t{_i - 1} t using (feature) group by all),
e{_i} as (select v.f, v.o, v.n, x.outcome, exp(coalesce(s.s, 0)) as e from (select f, outcome as o, n from ev) v cross join outs x left join s{_i} s on s.f = v.f and s.o = v.o and s.outcome = x.outcome),
p{_i} as (select *, e / sum(e) over (partition by f, o) as p from e{_i}),
m{_i} as (select a.feature, p.outcome, sum(a.n * p.p) as model from active a join p{_i} p on p.f = a.f and p.o = a.o group by all),
t{_i} as (select t.feature, t.outcome, t.theta + ln(o.seen / m.model) / 3 as theta from t{_i - 1} t join observed o using (feature, outcome) join m{_i} m using (feature, outcome))"""
_FM = """x as (select l_orderkey * 10 + l_linenumber as row_id, unnest([l_suppkey * 2 + 1, l_partkey * 2]) as f from lineitem), y as (select row_id, f % 97 / 100 as w, f % 89 / 100 as a, 0.5::double - f % 83 / 200 as b from x),
z as (select row_id, sum(w) as lin, sum(a) as a, sum(a * a) as a2, sum(b) as b, sum(b * b) as b2 from y group by row_id), fm as (select row_id, least(greatest(0.5::double + lin + (a * a - a2) / 2 + (b * b - b2) / 2, 0), 2.5::double) as y from z)"""
ORACLE = {
    "ctr_ad_forget": f"with {_IMP} select model, feature, round({_FRESH} * ((1 - 0.08::double) * mean / variance + 0.08::double * 0 / 400), 6) as mean, round({_FRESH}, 6) as variance from weights",
    "ctr_linear_predict": f"with {_IMP} select row_id, round(1 / (1 + exp(-sum(w))), 6) as p from imp join weights using (model, feature) group by row_id",
    "fm_predict": f"with {_FM} select row_id, round(y, 6) as y from fm",
    "fm_rmse": f"with {_FM} select round(sqrt(avg((y - l_quantity / 20) * (y - l_quantity / 20))), 5) as rmse from fm join lineitem on row_id = l_orderkey * 10 + l_linenumber",
    "maxent_events": f"with {_LAB} select array_to_string(f, ',') as features, outcome, count(*) as n from lab group by all having count(*) >= 2",
    "maxent_train": f"with {_GIS} select feature, outcome, round(theta, 6) as theta from t15",
    "maxent_predict": f"with {_GIS}, z as (select l.row_id, t.outcome, sum(t.theta) as s from (select row_id, unnest(f) as feature from lab) l join t15 t using (feature) group by all), q as (select l.row_id, x.outcome, exp(coalesce(z.s, 0)) as e from lab l cross join outs x left join z on z.row_id = l.row_id and z.outcome = x.outcome) select row_id, outcome, round(e / sum(e) over (partition by row_id), 6) as p from q",
}
