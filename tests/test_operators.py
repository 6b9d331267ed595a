"""Small fixtures with known answers, formulas recomputed densely, formats and streams."""

import math
import random
import struct
import subprocess
import sys
from collections import Counter, defaultdict
from shutil import copytree, ignore_patterns

import pytest
from pyspark.sql import functions as F

from tests.conftest import ROOT
from tessera.functions import dates, numbers, text
from tessera.operators import dedup, itemsets, keyphrase, learning, lsh, queries, recommend, series, similarity, wiki
from tessera.plans.components import connected_components
from tessera.sources import text as files
from tessera.sources.versions import read_current, versions, write_version
from tessera.streaming import incremental


def groups_of(spark, pairs):
    rows = connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    return {r.node: r.root for r in rows}


def test_group_table(spark):
    pairs = [(1, 2), (3, 4), (6, 5), (10, 11)]
    g = groups_of(spark, pairs)
    assert g[1] == g[2] and g[5] == g[6] and g[10] == g[11] and len({g[1], g[5], g[11], g[3]}) == 4
    g = groups_of(spark, [*pairs, (1, 11)])
    assert g[1] == g[10] and g[1] != g[5] and g[3] != g[6]
    g = groups_of(spark, [*pairs, (1, 11), (23, 1), (24, 4), (23, 24), (7, 7), (None, 3)])
    assert len({g[x] for x in (11, 23, 3, 24, 4)}) == 1 and 7 not in g


def test_components_of_a_long_chain(spark):
    g = groups_of(spark, [(i, i + 1) for i in range(300)])
    assert set(g.values()) == {0} and len(g) == 301


VISITS = [(1, [], [1, 2, 3]), (2, [], [3, 4, 5]), (1, [1, 2, 3], [4, 6, 8]), (2, [3, 4, 5], [6, 7, 9]), (3, [], [1, 3, 5]), (3, [1, 3, 5], [2, 8, 4]), (4, [], [4, 2, 9]), (4, [4, 2, 9], [7, 6, 5]), (5, [], [1])]


def dense():
    c, history = Counter(), defaultdict(list)
    for user, old, new in VISITS:
        for i in new:
            for j in [*old, *new]:
                c[i, j] += 1
            for j in old:
                c[j, i] += 1
        history[user] += new
    return c, history


def test_covisits_and_item_filtering(spark):
    c, history = dense()
    visits = spark.createDataFrame([(u, i) for u, items in history.items() for i in items], "user long, item long")
    counts = recommend.covisits(visits)
    assert {(r.item_i, r.item_j): r.freq for r in counts.collect()} == dict(c)
    old = spark.createDataFrame([(u, i) for u, o, n in VISITS[:2] for i in n], "user long, item long")
    new = visits.join(old, ["user", "item"], "left_anti")
    merged = recommend.merge_covisits(recommend.covisits(old), recommend.covisits_of_batch(old, new))
    assert {(r.item_i, r.item_j): r.freq for r in merged.collect()} == dict(c)
    sim = {(i, j): n / math.sqrt(c[i, i] * c[j, j]) for (i, j), n in c.items() if i != j}
    near = recommend.neighbours(recommend.similarities(counts))
    assert all(abs(r.sim - sim[r.item_i, r.item_j]) < 1e-12 for r in near.collect())
    baskets = {10: [1], 11: [2], 12: [1, 2, 3], 13: [1, 3, 5, 7, 9]}
    asked = spark.createDataFrame([(u, i) for u, items in baskets.items() for i in items], "user long, item long")
    out = recommend.recommend(near, asked, 20).collect()
    for r in out:
        seen = baskets[r.user]
        total = sum(s for (i, _), s in sim.items() if i == r.item)
        assert abs(r.weight - sum(sim.get((r.item, j), 0) for j in seen) / total) < 1e-9 and r.item not in seen and r.weight <= 1 + 1e-9
        assert sorted(r.reasons) == [j for j in seen if (r.item, j) in sim]
    for u in baskets:
        ordered = [r.weight for r in sorted((r for r in out if r.user == u), key=lambda r: r["rank"])]
        assert ordered == sorted(ordered, reverse=True)
    top = recommend.top_covisited(counts, 3).where("item_i = 1").orderBy("rank").collect()
    assert abs(top[0].weight - max(n for (i, j), n in c.items() if i == 1 != j) / sum(n for (i, j), n in c.items() if i == 1 != j)) < 1e-12


def test_simhash_of_no_tokens_is_all_ones(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a"), (4, "A")], "doc_id long, text string")
    p = {r.doc_id: (r.hi, r.lo, r.n_tokens) for r in dedup.simhash(df).collect()}
    assert p[1] == p[2] == (2**32 - 1, 2**32 - 1, 0) and p[3] == p[4] and p[3][2] == 1
    ks = [r[0] for r in spark.range(1).select(F.explode(F.array(*[dedup.adaptive_bits(F.lit(n)) for n in (1, 100, 1000, 7000, 10**6)]))).collect()]
    assert ks == [max(0, min(6, math.floor(-1.619429845 * math.log(7 * n + 1) + 17.57504447 + 0.5))) for n in (1, 100, 1000, 7000, 10**6)]
    assert len(dedup.band_masks(9, 3)) == 84
    assert [dedup.band_blocks(n) for n in (100, 10_000, 10**6, 10**9)] == [7, 7, 8, 10]


def test_frequent_and_maximal_sets(spark):
    import random

    rng = random.Random(1)
    sets = [sorted({rng.randrange(8) for _ in range(4)}) for _ in range(200)] + [[1], [1, 2, 3, 4, 5, 6, 7]]
    df = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s], "set_id long, item long")
    want = Counter()
    from itertools import combinations

    for s in sets:
        for n in range(1, 5):
            want.update(combinations(s, n))
    want = {k: v for k, v in want.items() if v >= 20}
    assert {tuple(r["items"]): r.support for r in itemsets.frequent_itemsets(df, 20).collect()} == want
    assert {tuple(r["items"]): r.support for r in itemsets.fp_growth(df, 20).where("size(items) <= 4").collect()} == want
    kept = {r.set_id for r in itemsets.maximal_sets(df).collect()}
    assert kept == {i for i, s in enumerate(sets) if not any(set(s) < set(t) for t in sets)}


def test_online_learners_follow_their_formulas(spark):
    features = ["age=3", "gender=male", "geo=shanghai", "system=linux"]
    df = spark.createDataFrame([("m", i, features, c) for i, c in enumerate([True, False, False])], "model string, seq int, features array<string>, clicked boolean")
    mean, var, beta = 0.0, 400.0, 450.0
    for clicked in (1, -1, -1):
        s = math.sqrt(beta**2 + 4 * var)
        t = clicked * 4 * mean / s
        v = math.sqrt(2 / math.pi) * math.exp(-t * t / 2) / (1 + math.erf(t / math.sqrt(2)))
        mean, var = mean + clicked * var / s * v, var * (1 - var / s**2 * v * (v + t))
    weights = learning.ad_predictor(df)
    assert all(abs(r["mean"] - mean) < 1e-9 and abs(r.variance - var) < 1e-9 for r in weights.collect())
    new = 400 * var / (0.92 * 400 + 0.08 * var)
    assert all(abs(r.variance - new) < 1e-9 and abs(r["mean"] - new * 0.92 * mean / var) < 1e-9 for r in learning.ad_forget(weights).collect())
    p = learning.ad_predict(spark.createDataFrame([(1, "m", features), (2, "m", ["new"]), (3, "m", [])], "row_id long, model string, features array<string>"), weights)
    want = 0.5 * math.erfc(-4 * mean / math.sqrt(beta**2 + 4 * var) / math.sqrt(2))
    got = {r.row_id: r.p for r in p.collect()}
    assert abs(got[1] - want) < 1e-9 and got[2] == got[3] == 0.5
    for strict in (False, True):
        z = n = w = 0.0
        for y in (1, 0, 0):
            p1 = 1 / (1 + math.exp(-4 * w))
            g = 1.0 if strict else p1 - y
            z, n = z + g - (math.sqrt(n + g * g) - math.sqrt(n)) / 0.5 * w, n + g * g
            w = 0.0 if abs(z) <= 0.1 else -(z - math.copysign(0.1, z)) / ((1 + math.sqrt(n)) / 0.5 + 0.1)
        assert all(abs(r.w - w) < 1e-9 for r in learning.ftrl(df, strict=strict).collect())


def test_factorization_machines_fit(spark):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(300):
        a, b = rng.randrange(3), 3 + rng.randrange(3)
        rows.append(("m", i, i, [(a, 1.0), (b, 1.0)], float((a + 1) * (b - 2))))
    df = spark.createDataFrame(rows, "model string, seq int, row_id long, features array<struct<feature:bigint,value:double>>, label double")
    spread = df.agg(F.stddev_pop("label")).first()[0]
    for y in (learning.fm_als(df, 2, sweeps=15), learning.fm_als(df, 2, sweeps=20, gibbs=True)):
        assert learning.rmse(y.join(df, "row_id")).first().rmse < spread / 3
    w = {r.feature: r for r in learning.fm_sgd(df, 2, epochs=30).collect()}
    rows_ = df.select("row_id", F.inline("features")).withColumnRenamed("feature", "feature")
    weights = spark.createDataFrame([(f, r.w, list(r.v)) for f, r in w.items() if f >= 0], "feature long, w double, v array<double>")
    fitted = learning.fm_predict(rows_, w[-1].w, weights, 2).join(df, "row_id")
    assert learning.rmse(fitted).first().rmse < spread / 2


def test_sequential_factorization_machine_keeps_order_in_little_memory(spark):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    data = [(rng.choice(["m", "n", None]), i, [(rng.randrange(3), 1.0), (3 + rng.randrange(3), rng.choice([1.0, 0.5]))] + [(1, 1.0)] * (i % 3), rng.random() * 3) for i in range(200)]
    data += [("n", 500, [], 1.0), ("m", 501, [(9, -2.0)], 0.5)]
    shuffled = rng.sample(data, len(data))
    df = spark.createDataFrame(shuffled, "model string, seq long, features array<struct<feature:bigint,value:double>>, label double")
    got = {(r.model, r.feature): [r.w, *r.v] for r in learning.fm_sgd(df, 3, epochs=4).collect()}
    want = {}
    for m in ("m", "n", None):
        rows = [(fs, y) for name, _, fs, y in data if name == m]
        gen, bias, low, high = np.random.default_rng(1), 0.0, min(y for _, y in rows), max(y for _, y in rows)
        w, v = {}, {}
        for f in sorted({f for fs, _ in rows for f, _ in fs}):
            w[f], v[f] = 0.0, gen.normal(0, 0.1, 3)
        for _ in range(4):
            for fs, y in rows:
                total, square = sum((v[f] * x for f, x in fs), np.zeros(3)), sum((v[f] ** 2 * x * x for f, x in fs), np.zeros(3))
                e = min(max(bias + sum(w[f] * x for f, x in fs) + 0.5 * float((total**2 - square).sum()), low), high) - y
                bias -= 0.01 * e
                for f, x in fs:
                    w[f] -= 0.01 * (e * x + 0.01 * w[f])
                    v[f] = v[f] - 0.01 * (e * (x * total - v[f] * x * x) + 0.01 * v[f])
        want |= {(m, -1): [bias]} | {(m, f): [w[f], *v[f]] for f in w}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)
    known = {}
    lists = pa.array([[{"feature": i % 3, "value": 1.0}] for i in range(999)], pa.list_(pa.struct([("feature", pa.int64()), ("value", pa.float64())])))
    assert learning._kinds(lists, known).nbytes == 4 * 999 and len(known) == 3


def test_entropy_model_learns(spark):
    rows = [(i, ["bad" if i % 2 else "good", "the"], str(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, features array<string>, outcome string")
    theta = learning.maxent_train(learning.maxent_events(df), 15)
    p = learning.maxent_predict(df, theta).where("outcome = '1'").collect()
    assert all((r.p > 0.8) == bool(r.row_id % 2) for r in p)


def test_series_coefficients_and_filter(spark):
    assert series.ema_coefficients(3) == pytest.approx([0.5, 0.25, 0.125])
    c = series.macd_coefficients()
    assert len(c) == 12 and c[0] == pytest.approx((0.4 - 2 / 9) * (1 - 1 / 3))
    df = spark.createDataFrame([("a", f"2024-01-{i + 1:02d}", float(i * i % 7)) for i in range(20)], "key string, day string, value double").withColumn("day", F.col("day").cast("date"))
    got = [r.filtered for r in series.moving_filter(df, c, 11).orderBy("day").collect()]
    x = [float(i * i % 7) for i in range(20)]
    assert got == pytest.approx([0.0 if min(i + 1, 12) <= 11 else sum(c[j] * x[i - j] for j in range(12)) for i in range(20)])


def test_shapes_linked_as_compared_directly(spark):
    import random

    rng = random.Random(3)
    rows = [(k, f"2024-01-{i + 1:02d}", float(rng.randrange(4) if k % 3 or i > 10 else 0)) for k in range(6) for i in range(20)]
    df = spark.createDataFrame(rows, "key int, day string, value double").withColumn("day", F.col("day").cast("date"))
    pairs = df.select(F.col("key").alias("a"), F.col("day").alias("t"), F.col("value").alias("x")).join(df.select(F.col("key").alias("b"), F.col("day").alias("t"), F.col("value").alias("y")), "t").where("a < b")
    want = {(r.a, r.b): r.similarity for r in series.shape_similarity(pairs).where("similarity >= 0.2").collect()}
    got = {(r.a, r.b): r.similarity for r in series.linked_shapes(df, 0.2).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_topic_storage(spark):
    b = spark.createDataFrame([("earthquake", "2011-01-10", 2), ("earthquake", "2011-01-20", 3)], "key string, start string, period int").withColumn("start", F.col("start").cast("date"))
    counts = [series.active_topics(b, s, e).count() for s, e in (("2011-01-01", "2011-12-31"), ("2011-01-22", "2011-12-31"), ("2011-01-23", "2011-12-31"), ("2011-01-10", "2011-01-10"))]
    assert counts == [1, 1, 0, 0] and series.active_topics(b.where("false"), "2011-01-01", "2011-12-31").count() == 0


def test_all_pairs_equals_naive(spark):
    import random

    rng = random.Random(4)
    rows = [(i, d, rng.random()) for i in range(40) for d in rng.sample(range(12), 4)]
    unit = similarity.normalise(spark.createDataFrame(rows, "id long, dim long, value double"))
    v = defaultdict(dict)
    for r in unit.collect():
        v[r.id][r.dim] = r.value
    naive = {(a, b): sum(x * v[b].get(d, 0) for d, x in v[a].items()) for a in v for b in v if a < b}
    got = {(r.a, r.b): r.sim for r in similarity.all_pairs(unit, 0.6).collect()}
    assert set(got) == {k for k, s in naive.items() if s >= 0.6} and all(abs(got[k] - naive[k]) < 1e-9 for k in got)


def test_all_pairs_moves_vectors_not_pairs(spark, monkeypatch):
    """pairs are made where both vectors are; a row for each met pair was shuffled before."""
    import random

    rng = random.Random(5)
    rows = [(i * 7 - 300, d, rng.random()) for i in range(90) for d in rng.sample(range(9), 3)] + [(900, 1, 0.5), (900, 1, 0.25), (901, 1, 2.0)]
    unit = similarity.normalise(spark.createDataFrame(rows, "id int, dim int, value double")).localCheckpoint()
    want = {(r.a, r.b): round(r.sim, 6) for r in similarity._prefixed(unit, 0.7, True).collect()}
    for cells in (similarity.GROUP_CELLS, 40):
        monkeypatch.setattr(similarity, "GROUP_CELLS", cells)
        found = similarity.all_pairs(unit, 0.7, strict=True, digits=6)
        got = found.collect()
        assert len(got) == len(want) and all(r.a < r.b and abs(want[r.a, r.b] - r.sim) < 2e-6 for r in got)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString() and found.schema["a"].dataType == unit.schema["id"].dataType


def test_interpret_texts_moves_no_terms(spark, monkeypatch):
    """values of texts equal those by rows of terms, whose shuffles alone passed the disk limit."""
    import random

    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice("abcdefghijkl") * rng.randint(1, 2) for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(None, "a b b"), (99, None)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    index = spark.createDataFrame([(t, k, rng.randint(20, 900) / 1000) for t in "abcdefgh" for k in rng.sample(range(6), 3)] + [("zz", 3, 0.5)], "term string, concept long, weight double")

    def values(df):
        return {(r.doc_id, r.concept): r.value for r in df.collect()}

    want = values(similarity.interpret(similarity.tf_idf(similarity.term_frequency(docs), docs.count()), index, 0.05))
    found = similarity.interpret_texts(docs, index, 0.05)
    got = values(found)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got) and found.schema["concept"].dataType == index.schema["concept"].dataType
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    twice = docs.union(docs.where("doc_id = 3"))
    want = values(similarity.interpret(similarity.tf_idf(similarity.term_frequency(twice), twice.count()), index, 0.05))
    got = values(similarity.interpret_texts(twice, index, 0.05))
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_translation_by_blocks_of_sources(spark, monkeypatch):
    """what moves in a round is a total a target; all co-occurrences met their probabilities in a join before."""
    import random

    from tessera.operators import translation

    rng = random.Random(7)
    data = [(f"p{i % 55}", rng.sample("abcdefgh", rng.randint(0, 4)), [rng.choice("stuvwxyz") for _ in range(rng.randint(0, 5))]) for i in range(60)]
    sentences = spark.createDataFrame([*data, (None, ["a"], ["s"]), ("q", None, ["s"])], "pair_id string, x array<string>, y array<string>")
    rows = spark.createDataFrame([(p, s, t) for p, x, y in data for s in x for t in y] + [(None, "a", "s")], "pair_id string, source string, target string")
    for rounds in (1, 4, 7):
        monkeypatch.setattr(translation, "ROUNDS_STAGED", 2)
        want = {(r.source, r.target): r.p for r in keyphrase.ibm_model1(rows, rounds).collect()}
        found = keyphrase.ibm_model1_texts(sentences, rounds)
        got = found.collect()
        assert len(got) == len(want) and all(abs(want[r.source, r.target] - r.p) < 1e-12 for r in got)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(translation, "MOST_TARGETS", 3)
    got = {(r.source, r.target): r.p for r in keyphrase.ibm_model1_texts(sentences, 7).collect()}
    assert got == pytest.approx(want)
    assert keyphrase.ibm_model1_texts(sentences.where("false"), 3).count() == 0


def test_recommend_in_blocks_equals_rows(spark, monkeypatch):
    """baskets and neighbour lists move; a row for each neighbour of each visit was shuffled before."""
    import random

    from tessera.operators import scoring

    rng = random.Random(8)
    visits = [(u, rng.choice([1 << 40, 3, 5, *range(-9, 30)]), rng.choice([1.0, 0.5, -0.5, None])) for u in range(60) for _ in range(rng.randint(1, 9))] + [(None, 3, 1.0), (7, None, 1.0)]
    history = spark.createDataFrame(visits, "user int, item long, weight double").localCheckpoint()
    near = recommend.similarities_by_item(history.where("item is not null"), 6).select("item_i", "item_j", "sim").localCheckpoint()
    for rows, weighted in ((scoring.BLOCK_ROWS, False), (20, True), (20, False)):
        monkeypatch.setattr(scoring, "BLOCK_ROWS", rows)
        monkeypatch.setattr(scoring, "CHUNK_USERS", 7)
        monkeypatch.setattr(scoring, "PIECE_ROWS", 11)
        want = {(r.user, r["rank"]): r for r in recommend._recommend_by_rows(near, history, 4, weighted).collect()}
        found = recommend.recommend(near, history, 4, weighted)
        got = found.collect()
        assert len(got) == len(want) > 50
        for r in got:
            w = want[r.user, r["rank"]]
            assert (r.item, r.reasons) == (w.item, w.reasons) and r.weight == pytest.approx(w.weight, abs=1e-12)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString() and found.schema["user"].dataType == history.schema["user"].dataType
    assert recommend.recommend(near, history.where("false"), 4).count() == 0 == recommend.recommend(near.where("false"), history, 4).count()


def test_string_similarity(spark):
    df = spark.createDataFrame([("a b c d", "a b c d"), ("a b", "x y"), ("", "a"), ("a b x c", "c a b")], "p string, q string")
    got = [r.sim for r in similarity.string_similarity(df, "p", "q").collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == got[2] == 0
    # a b, then x skipped with the walk, then c: three of four terms in two runs; back: c a b in two runs of three terms.
    assert 0 < got[3] < 1


def test_multi_probe_finds_more(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)], "vec_id long, embedding array<double>")
    planes, offsets = [lsh.directions(4, 8, t) for t in range(3)], [np.zeros(4)] * 3
    keyed = lsh.table_keys(df, planes, offsets, 2.0)
    plain = lsh.search(keyed, keyed.where("vec_id % 50 = 0"), 10)
    probed = lsh.multi_probe(df, df.where("vec_id % 50 = 0"), planes, offsets, 2.0, 10, 10)
    # More candidates: at every rank that the plain search reaches, the probed one is as near or nearer.
    near = {(r.query_id, r["rank"]): r.distance for r in probed.collect()}
    assert all(near[r.query_id, r["rank"]] <= r.distance + 1e-9 for r in plain.collect()) and len(near) >= plain.count()
    assert lsh.recall(plain, plain).agg(F.min("recall")).first()[0] == 1.0


def test_pinyin():
    known = {"xi", "an", "xian", "zhong", "zong", "ang"}
    assert queries.pinyin_segments("xian", known) == [("xian",), ("xi", "an")]
    assert queries.fuzzy_syllables("xue", {"xue", "xve", "hue"}) == [("xue", 1.0), ("xve", 0.5)]
    assert queries.fuzzy_syllables("zong", known) == [("zong", 1.0), ("zhong", 0.5)]
    assert queries.pinyin_segments("abc", known) == []


def test_correction(spark):
    d, m = {"nuo": ["诺"], "ji": ["基", "机"], "ya": ["亚"]}, {"诺": 0.1, "诺基": 0.5, "基亚": 0.5, "诺基亚": 0.9}
    rows = queries.correct_pinyin(spark.createDataFrame([("nuojiya",), (None,), ("zzz",)], "query string"), d, m).collect()
    assert [(r.query, r.correction) for r in rows] == [("nuojiya", "诺基亚")]


def test_query_log_slices(spark):
    rows = [(t, "游戏", 4, False) for t in (7, 8, 9)] + [(10, "中国", 4, True), (10, "游戏", 2, True), (10, "音乐", 3, True)]
    log = spark.createDataFrame(rows, "time_id int, query string, cnt long, is_latest boolean")
    assert queries.popular_queries(log.where("not is_latest"), 10).count() == 1
    assert queries.realtime_queries(log, 10).count() == 3
    assert [r.query for r in queries.without_shared_terms(queries.realtime_queries(log, 10), 10).collect()][0] in ("中国", "音乐")


def test_translation_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (1, "b", "y"), (2, "a", "x")], "pair_id int, source string, target string")
    t = {(r.source, r.target): r.p for r in keyphrase.ibm_model1(df, 15).collect()}
    assert t["a", "x"] > 0.8 and t["b", "y"] > t["a", "y"]
    assert t["a", "x"] + t["b", "x"] == pytest.approx(1)


def test_wiki_links(spark):
    df = spark.createDataFrame([(1, "see [[Ref One|surface]] now, [[Plain]] and [[File:x|y]]\n[[Category:Cities|z]]", "T")], "page_id long, text string, title string")
    got = sorted(tuple(r)[1:] for r in wiki.wiki_links(df).collect())
    assert got == [("Plain", "Plain", "now,", "and"), ("surface", "Ref One", "see", "now,")]
    assert [tuple(r) for r in wiki.categories(df).collect()] == [("T", "Cities")]


def test_text_and_dates(spark):
    row = spark.createDataFrame([("Äb 12, 中文x", "2024-02-30", "20240229", 86400 * 365)], "t string, bad string, good string, e long").select(
        text.tokens(F.col("t")), dates.parse_date(F.col("bad")).cast("string"), dates.parse_date(F.col("good")).cast("string"), dates.date_of_epoch(F.col("e")).cast("string"), text.join_terms(F.array(F.lit("中"), F.lit("文"), F.lit("a"), F.lit("b"))), text.to_half_width(F.lit("Ａ１")), numbers.normal_cdf(F.lit(1.96)),
    ).first()
    assert list(row[:6]) == [["äb", "12", "中", "文", "x"], None, "2024-02-29", "1971-01-01", "中文 a b", "A1"] and abs(row[6] - 0.9750021) < 1e-6


def test_formats(spark, tmp_path):
    (tmp_path / "a.scd").write_text("<DOCID>1\n<Title>one\ntwo\n<Date>20240105\n<DOCID>2\n<Content>body\n<DOCID>\n<Title>x\n")
    scd = files.read_scd(spark, str(tmp_path / "a.scd"))
    rows = files.scd_documents(scd).orderBy("docid").collect()
    assert [(r.docid, r.title, str(r.date)) for r in rows] == [("1", "one\ntwo", "2024-01-05"), ("2", None, "None")]
    assert files.valid_share(files.scd_documents(scd)) == 0.5 and files.read_scd(spark, str(tmp_path / "a.scd"), 1).count() == 1
    (tmp_path / "s.txt").write_text("1 2 3 0 10 20\n0\n5 0")
    assert [r["items"] for r in files.read_text_sets(spark, str(tmp_path / "s.txt")).orderBy("set_id").collect()] == [[1, 2, 3], [10, 20], [5]]
    (tmp_path / "s.bin").write_bytes(struct.pack("<II2I", 7, 2, 4, 5) + struct.pack("<II", 8, 0))
    assert [(r.set_id, r["items"]) for r in files.read_binary_sets(spark, str(tmp_path / "s.bin")).collect()] == [(7, [4, 5]), (8, [])]
    (tmp_path / "t.bin").write_bytes(struct.pack("<III", 7, 2, 4))
    with pytest.raises(Exception, match="truncated"):
        files.read_binary_sets(spark, str(tmp_path / "t.bin")).collect()
    (tmp_path / "f.txt").write_text("1.5 0 2 3 4.5\n-1 7 1\n\n2\n")
    rows = files.read_feature_rows(spark, str(tmp_path / "f.txt"))
    assert [len(r.features) for r in rows.orderBy("target").collect()] == [1, 2, 0]
    assert tuple(files.feature_rows_summary(rows).first()) == (-1.0, 2.0, 8)
    (tmp_path / "p.txt").write_text("中 zhong1\n国 guo2\nbad\n")
    assert {(r.char, r.pinyin) for r in files.read_pinyin(spark, str(tmp_path / "p.txt")).collect()} == {("中", "zhong"), ("国", "guo")}
    (tmp_path / "k.txt").write_text("key phrase\t1,2|3,4\n")
    assert files.read_keyphrase_index(spark, str(tmp_path / "k.txt")).first().docs[1].freq == 4
    (tmp_path / "w.xml").write_text("<page><title>A</title><text>x [[B]]</text></page>\n<page><title>C</title><text>y</text></page>")
    assert [tuple(r) for r in files.read_wiki_pages(spark, str(tmp_path / "w.xml")).orderBy("title").collect()] == [("A", "x [[B]]"), ("C", "y")]
    (tmp_path / "c.txt").write_text("T:a %kp% b\nC:%x y%\nno\n")
    assert [r.phrases for r in files.read_tagged_corpus(spark, str(tmp_path / "c.txt")).orderBy("kind").collect()] == [["x y"], ["kp"]]
    model = spark.createDataFrame([("中", 0.5), ("中国", 0.25)], "gram string, p double")
    files.write_gram_table(model, str(tmp_path / "lm"))
    assert {(r.gram, r.n, r.p) for r in files.read_gram_table(spark, str(tmp_path / "lm")).collect()} == {("中", 1, 0.5), ("中国", 2, 0.25)}


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        read_current(spark, path)
    for i in range(4):
        write_version(spark.range(i + 1), path)
        assert read_current(spark, path).count() == i + 1
    assert len(versions(spark, path)) == 2


def test_streams_equal_batches(spark, tmp_path):
    docs = [(i, f"some words of document number {i // 3} and more to say about {i // 3}") for i in range(12)]
    visits = [(u, (u * 7 + k) % 9) for u in range(6) for k in range(4)]
    for part in range(3):
        spark.createDataFrame(docs[part::3], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
        spark.createDataFrame(visits[part::3], "user long, item long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/visits")
    stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    incremental.deduplicate(stream("docs", "doc_id long, text string"), f"file://{tmp_path}/d", f"{tmp_path}/cd").awaitTermination()
    incremental.covisit(stream("visits", "user long, item long"), f"file://{tmp_path}/v", f"{tmp_path}/cv").awaitTermination()
    want = {(r.item_i, r.item_j): r.freq for r in recommend.covisits(spark.createDataFrame(visits, "user long, item long")).collect()}
    assert {(r.item_i, r.item_j): r.freq for r in read_current(spark, f"file://{tmp_path}/v/counts").collect()} == want
    assert read_current(spark, f"file://{tmp_path}/d/prints").count() == 12
    counted = incremental.windowed_counts(spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/docs"), "k")
    assert counted.isStreaming


def test_rest_works_without_the_training_data_operators(tmp_path):
    copytree(ROOT, tmp_path / "repo", ignore=ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'duplicate_groups' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_sums_at_the_threshold_stay_out(spark):
    """0.1 + 0.2 is above 0.3 by rounding only."""
    weights = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (2, "a", 0.3), (2, "b", 0.1)], "doc_id long, term string, weight double")
    concepts = spark.createDataFrame([("a", 7, 1.0), ("b", 7, 1.0)], "term string, concept long, weight double")
    assert [r.doc_id for r in similarity.interpret(weights, concepts, 0.3).collect()] == [2]


def staged_plans(monkeypatch, module):
    """Plans of all that ``module`` stages from now on, by label."""
    seen = defaultdict(list)
    inner = module.stage

    def stage(df, label):
        seen[label].append(df._jdf.queryExecution().executedPlan().toString())
        return inner(df, label)

    monkeypatch.setattr(module, "stage", stage)
    return seen


def test_links_are_not_broadcast(spark):
    """Small files hold many masks: the sides of the join are merged."""
    prints = spark.range(5000).select(F.col("id").alias("doc_id"), F.shiftrightunsigned(F.xxhash64("id"), 32).alias("hi"), F.xxhash64("id").bitwiseAND(0xFFFFFFFF).alias("lo"), F.lit(5).alias("n_tokens"))
    from tessera.plans.staging import stage

    plan = dedup.links(dedup.classes(stage(prints, "prints")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_translation_rounds_are_not_broadcast(spark, monkeypatch):
    plans = staged_plans(monkeypatch, keyphrase)
    pairs = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "a", "x")], "pair_id long, source string, target string")
    assert keyphrase.ibm_model1(pairs, 2).count() == 2
    assert len(plans["ibm1"]) == 2 and not any("Broadcast" in p for p in plans["ibm1"])


def test_offered_pairs_are_not_broadcast(spark):
    sets = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 4)], "set_id long, item long")
    out = itemsets.maximal_sets(sets)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("strategy=merge") == 2 and sorted(r.set_id for r in out.collect()) == [2, 3]


@pytest.mark.parametrize("gibbs", [False, True])
def test_fm_als_folds_equal_rows(spark, monkeypatch, gibbs):
    """Rows that agree in features reach the sweeps as one, and fit as well as their means allow."""
    plans = staged_plans(monkeypatch, learning)
    rows = [("m", i, i, [(i % 2, 1.0), (2 + i % 3, 1.0)], float(i % 2 * 2 + i % 3 + (i // 6) % 2)) for i in range(240)] + [(None, 500, 500, [(0, 1.0)], 1.0)]
    frame = spark.createDataFrame(rows, "model string, seq long, row_id long, features array<struct<feature:long,value:double>>, label double")
    got = {r.row_id: r.y for r in learning.fm_als(frame, 2, sweeps=10, gibbs=gibbs).collect()}
    assert len(plans["fitted"]) == 1 and "Aggregate" in plans["fitted"][0]
    assert len(got) == 241 and got[500] == pytest.approx(1.0)
    assert all(abs(got[i] - (i % 2 * 2 + i % 3 + 0.5)) < 0.4 for i in range(240))


def test_pairs_are_counted_in_blocks_without_a_table_of_them(spark, monkeypatch):
    from tessera.operators import pairing

    rng = random.Random(5)
    big = 1 << 61
    ids = [-big, -5, 0, 3, 70_000, 1 << 40, big, *range(100, 130)]
    rows = [(u, i) for u in range(60) for i in rng.sample(ids, rng.randint(1, 9))] + [(u, 3) for u in range(60, 400)] + [(9, None), (None, 3)]
    visits = spark.createDataFrame(rows * 2, "user long, item long")
    counts = recommend.covisits(visits.where("item is not null"))
    touched = spark.createDataFrame([(3,), (101,)], "item long")
    ranked = lambda df: sorted((tuple(r) for r in df.collect()), key=str)

    def same():
        assert ranked(recommend.similarities_by_item(visits)) == ranked(recommend.similarities(counts))
        assert ranked(recommend.similarities_by_item(visits, 4)) == ranked(recommend.neighbours(recommend.similarities(counts), 4))
        assert ranked(recommend.top_covisited_of(visits, 3, touched)) == ranked(recommend.top_covisited(counts, 3, touched))

    same()
    # Many blocks, one item to a chunk, and an item whose baskets take several chunks.
    monkeypatch.setattr(pairing, "BLOCK_ELEMENTS", 100)
    monkeypatch.setattr(pairing, "CHUNK_PAIRS", 16)
    same()
    assert ranked(recommend.similarities_touching(visits, touched)) == ranked(recommend.similarities_of(counts, touched))
    assert recommend.similarities_by_item(visits.where("user < 0"), 3).count() == 0
    plan = recommend.similarities_by_item(visits, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    words = visits.where("item is not null").select("user", F.col("item").cast("string").alias("item"))
    assert recommend.similarities_by_item(words).count() == recommend.similarities_by_item(visits).count()


def test_phrases_are_counted_from_windows(spark):
    rows = [("a", "A b 12 c b a b"), ("b", "b a b 7"), ("b", "a b, x1 9"), ("c", None), ("d", "3 4"), ("e", "漢字 a b c d e f g h a b c d e f g h")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    grams = keyphrase.ngrams(docs)
    ranked = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    counts = keyphrase.phrase_counts(grams)
    found = keyphrase.counted_phrases(docs)
    assert found.columns == counts.columns and ranked(found) == ranked(counts) and dict(found.dtypes) == dict(counts.dtypes)
    wanted = keyphrase.document_keyphrases(grams, counts.where("n_terms >= 2 and df >= 2"), 6, 2)
    best = keyphrase.keyphrases_by_document(docs, 6, most=2)
    assert ranked(best) == ranked(wanted)
    asked = spark.createDataFrame([("a", "a b"), ("a", "zz y"), ("b", "a b"), ("b", "a b"), ("f", "a b")], "doc_id string, phrase string")
    assert ranked(keyphrase.evaluate_texts(asked, docs)) == ranked(keyphrase.evaluate(asked, grams.where("n_terms >= 2")))
    assert ranked(keyphrase.evaluate_texts(asked.limit(0), docs.limit(0))) == ranked(keyphrase.evaluate(asked.limit(0), grams.limit(0)))
    plan = found._jdf.queryExecution().executedPlan().toString().rpartition("Initial Plan")[2]
    assert plan.count("Exchange hash") == 1, plan
