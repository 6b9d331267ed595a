"""Queries without a statement against plain Python, and the readers and writers that no query uses."""

import gzip
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.catalog import analysis, learning, lsh, similarity, wiki
from tessera.operators import itemsets
from tessera.operators import learning as ml
from tessera.sources import models, resources
from tests.conftest import DATA

SF = str(DATA / "sf0.001")


def test_term_ids_are_gapless(spark):
    rows = analysis.QUERIES["term_ids"](spark, SF).collect()
    from tessera.operators.analysis import positions

    terms = {r.term for r in positions(spark.read.parquet(f"{SF}/documents.parquet")).select("term").distinct().collect()}
    assert {r.term for r in rows} == terms and sorted(r.id for r in rows) == list(range(len(terms)))
    assert [r.term for r in sorted(rows, key=lambda r: r.id)] == sorted(terms, key=lambda t: (zlib.crc32(t.encode()) % 256, t.encode()))


def test_ad_predictor_and_its_predictions(spark):
    events = learning._impressions(spark, SF)
    rows = sorted(events.collect(), key=lambda r: r.seq)
    weights: dict = defaultdict(lambda: [0.0, 400.0])
    for r in rows:
        keys = [(r.model, f) for f in r.features]
        total = math.sqrt(450.0**2 + sum(weights[k][1] for k in keys))
        y = 1 if r.clicked else -1
        t = y * sum(weights[k][0] for k in keys) / total
        v = math.exp(-t * t / 2) / math.sqrt(2 * math.pi) / (0.5 * (1 + math.erf(t / math.sqrt(2))))
        w = v * (v + t)
        for k in keys:
            m, s = weights[k]
            weights[k] = [m + y * s / total * v, s * (1 - s / total**2 * w)]
    got = {(r.model, r.feature): (r.mean, r.variance) for r in learning.QUERIES["ctr_ad_predictor"](spark, SF).collect()}
    assert set(got) == set(weights) and all(np.allclose(got[k], weights[k]) for k in got)
    rates = {(r.model, r.feature): r for r in learning._click_rates(spark, SF).collect()}
    for r in learning.QUERIES["ctr_ad_predict"](spark, SF).join(events, "row_id").collect():
        known = [rates[r.model, f] for f in r.features]
        z = sum(k.mean for k in known) / math.sqrt(450.0**2 + sum(k.variance for k in known))
        assert abs(r.p - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 1e-6


@pytest.mark.parametrize("name", ["ctr_ftrl", "ctr_ftrl_strict"])
def test_ftrl(spark, name):
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda k: 0.0 if abs(z[k]) <= 0.1 else -(z[k] - math.copysign(0.1, z[k])) / ((1 + math.sqrt(n[k])) / 0.5 + 0.1)
    for r in sorted(learning._impressions(spark, SF).collect(), key=lambda r: r.seq):
        keys = [(r.model, f) for f in r.features]
        old = [weight(k) for k in keys]
        p = 1 / (1 + math.exp(-sum(old)))
        g = (0.0 if p == r.clicked else 1.0) if name.endswith("strict") else p - r.clicked
        for k, w in zip(keys, old):
            z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / 0.5 * w
            n[k] += g * g
    got = {(r.model, r.feature): (r.z, r.n, r.w) for r in learning.QUERIES[name](spark, SF).collect()}
    assert set(got) == set(z) and all(np.allclose(got[k], (z[k], n[k], weight(k))) for k in got)


def test_wiki_features_and_their_lines(spark):
    entities = wiki._entities(spark, SF).collect()
    types = {r.name: r.type for r in wiki._types(spark, SF).collect()}
    want = {}
    for s in {e.surface for e in entities}:
        want |= {(s, f): 1.0 for f in (f"PU_{s[:1]}", f"SU_{s[-1:]}", f"PB_{s[:2]}", f"SB_{s[-2:]}")}
        want[s, "LENGTH"] = min(len(s) / 10, 1.0)
        for side, kind in (("left", "LC_"), ("right", "RC_")):
            near = Counter(e[side] for e in entities if e.surface == s and e[side])
            want |= {(s, kind + x): n / sum(near.values()) for x, n in near.items()}
    rows = wiki.QUERIES["wiki_features"](spark, SF).collect()
    assert {(r.surface, r.feature): (r.value, r.type) for r in rows} == {k: (round(v, 6), types.get(k[0], 0)) for k, v in want.items()}
    lines = {r.surface: r.line for r in wiki.QUERIES["wiki_libsvm"](spark, SF).collect()}
    ids = {}
    for s, line in lines.items():
        kind, *parts = line.split(" ")
        assert int(kind) == types.get(s, 0)
        pairs = [(int(a), float(b)) for a, b in (p.split(":") for p in parts)]
        assert pairs == sorted(pairs) and sorted(v for _, v in pairs) == sorted(round(v, 6) for (x, _), v in want.items() if x == s)
        ids |= dict.fromkeys(i for i, _ in pairs)
    assert sorted(ids) == list(range(1, len({f for _, f in want}) + 1))


def test_spectral_bits(spark):
    x = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()], dtype=float)
    bits = np.array([r.bits for r in lsh.QUERIES["lsh_spectral_hash"](spark, SF).orderBy("vec_id").collect()])
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    p = x @ axes[:4].T
    low, wide = p.min(axis=0), np.ptp(p, axis=0)
    modes = sorted(((m * math.pi / wide[i]) ** 2, i, m) for i in range(4) for m in range(1, 9))[:8]
    for b, (_, i, m) in enumerate(modes):
        mine = np.sin(math.pi / 2 + m * math.pi / wide[i] * (p[:, i] - low[i])) > 0
        # A principal direction may point either way, which turns odd modes over.
        assert max((bits[:, b] == mine).mean(), (bits[:, b] != mine).mean()) > 0.98


def test_string_similarity(spark):
    one = spark.createDataFrame([("a b c d", "b c x d"), ("a b", "c d"), ("a a a", "a a a")], "l string, r string")
    from tessera.operators.similarity import string_similarity

    got = [r.sim for r in string_similarity(one, "l", "r").collect()]
    # From the left "b c" is one run, and the term that ends it is passed over; from the right "b c" and "d" are two.
    assert np.allclose(got, [(0.95 * 2 / 4 + 0.05 + 0.95 * 3 / 4 + 0.05 / 2) / 2, 0.0, 1.0])
    assert all(0 <= r.sim <= 1 for r in similarity.QUERIES["string_similarity"](spark, SF).collect())


def test_labelled_topics_keep_to_the_labels(spark):
    words = spark.createDataFrame([(0, i, w) for i in range(12) for w in (["sun", "sea"] if i % 2 else ["tax", "law"]) * 3], "shard int, doc_id long, word string")
    labels = spark.createDataFrame([(i, "beach" if i % 2 else "court") for i in range(12)], "doc_id long, topic string")
    out = {(r.topic, r.word): r.n for r in ml.labeled_lda(words, labels, 3).collect()}
    assert out == {("beach", "sun"): 18, ("beach", "sea"): 18, ("court", "tax"): 18, ("court", "law"): 18}


def test_classifiers_beat_guessing(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    ring = (x[:, :2] ** 2).sum(axis=1) > 1.4
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame([(i, v.tolist(), float(v[0] > 0), float(r)) for i, (v, r) in enumerate(zip(x, ring))], "vec_id long, x array<double>, side double, ring double")
    flat = df.withColumn("features", array_to_vector("x")).withColumn("label", F.col("side"))
    assert ml.linear_svm(flat).transform(flat).where("prediction = label").count() > 380
    round_ = df.withColumn("label", F.col("ring"))
    model, lift = ml.rbf_svm(round_, features_col="x")
    assert model.transform(lift(round_)).where("prediction = label").count() > 340


def test_paragraphs_of_equal_words_are_alike(spark):
    rows = spark.createDataFrame([(i, ["a", "b", "c"] if i % 2 else ["x", "y", "z"]) for i in range(40)], "id long, tokens array<string>")
    from pyspark.ml.functions import vector_to_array

    out = {r.id: np.array(r.v) for r in ml.paragraph_vectors(rows, 4).transform(rows).select("id", vector_to_array("vector").alias("v")).collect()}
    assert all(np.allclose(out[i], out[i % 2]) for i in out) and not np.allclose(out[0], out[1])


def test_maximal_sets_of_any_size(spark):
    rng = np.random.default_rng(4)
    sets = [frozenset(rng.integers(0, 40, rng.integers(1, 7)).tolist()) for _ in range(150)] + [frozenset(range(90)), frozenset({3, 5}), frozenset({91, 3})]
    df = spark.createDataFrame([(i, int(x)) for i, s in enumerate(sets) for x in s], "set_id int, item int")
    want = {i for i, s in enumerate(sets) if not any(s < t for t in sets)}
    for most in (64, 3):
        assert {r.set_id for r in itemsets.maximal_sets(df, most).collect()} == want


def test_models_are_kept(spark, tmp_path):
    events = learning._impressions(spark, SF)
    weights = ml.ftrl(events)
    path = f"file://{tmp_path}/ftrl"
    models.save_model(path, {"weights": weights.limit(0)}, {"alpha": 0.1})
    models.save_model(path, {"weights": weights}, {"alpha": 0.5})
    tables, settings = models.load_model(spark, path)
    assert settings == {"alpha": 0.5}
    before = {r.row_id: round(r.p, 9) for r in ml.linear_predict(events, weights).collect()}
    assert before == {r.row_id: round(r.p, 9) for r in ml.linear_predict(events, tables["weights"]).collect()}


def test_resources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ntwo\n")
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(b"three\n"))
    found = resources.read_resources(spark, str(tmp_path))
    crc = {r.path.rsplit("/", 1)[1]: r.crc for r in found.collect()}
    assert crc["a.txt"] == zlib.crc32(b"one\ntwo\n")
    expected = found.select("path", F.when(F.col("path").endswith("gz"), F.col("crc") + 1).otherwise(F.col("crc")).alias("crc"))
    assert [r.path[-2:] for r in resources.changed_resources(found, expected).collect()] == ["gz"]
    assert sorted(r.line for r in resources.read_lines(spark, str(tmp_path)).collect()) == ["one", "three", "two"]


def test_callbacks(spark, tmp_path):
    seen = []
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    resources.call_back(stream, lambda df, n: seen.append((n, df.count())), str(tmp_path / "mark")).awaitTermination()
    assert sum(c for _, c in seen) == 5
