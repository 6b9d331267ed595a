"""Click-through and classification models: online learners, factorization machines, maximum entropy, SVM, LDA, paragraph vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import clip, normal_cdf, sigmoid
from tessera.plans.staging import stage

_ROOT = math.sqrt(2 / math.pi)


def _in_order(events: DataFrame, model: list[str], step, schema: str) -> DataFrame:
    """``step(rows)`` over each model's events in order of ``seq``; online learners depend on that order."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return step(key, frame.sort_values("seq", kind="stable"))

    return events.groupBy(*model).applyInPandas(run, schema)


def ad_predictor(events: DataFrame, mean: float = 0.0, variance: float = 400.0, beta: float = 450.0) -> DataFrame:
    """``(model, feature, mean, variance)``: Gaussian weights after all of a model's events ``(model, seq, features, clicked)``, in order.

    Each event moves its features' weights by the truncated-Gaussian correction of a probit
    model. Order matters, so one model's events are one ordered group; models run side by side.
    """

    def step(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        weights: dict[str, list[float]] = {}
        for features, clicked in zip(frame["features"], frame["clicked"]):
            active = [weights.setdefault(f, [mean, variance]) for f in features]
            spread = math.sqrt(beta * beta + sum(w[1] for w in active))
            y = 1.0 if clicked else -1.0
            t = y * sum(w[0] for w in active) / spread
            v = _ROOT * math.exp(-t * t / 2) / max(1 + math.erf(t / math.sqrt(2)), 1e-300)
            shrink = v * (v + t)
            for w in active:
                w[0] += y * (w[1] / spread) * v
                w[1] *= 1 - w[1] / (spread * spread) * shrink
        return pd.DataFrame([(key[0], f, m, s) for f, (m, s) in weights.items()], columns=["model", "feature", "mean", "variance"])

    return _in_order(events, ["model"], step, "model string, feature string, mean double, variance double")


def ad_forget(weights: DataFrame, rate: float = 0.08, mean: float = 0.0, variance: float = 400.0) -> DataFrame:
    """All weights moved towards their prior."""
    v = F.col("variance")
    fresh = variance * v / ((1 - rate) * variance + rate * v)
    return weights.withColumn("_v", fresh).withColumn("mean", F.col("_v") * ((1 - rate) * F.col("mean") / v + rate * mean / variance)).withColumn("variance", F.col("_v")).drop("_v")


def ad_predict(rows: DataFrame, weights: DataFrame, beta: float = 450.0) -> DataFrame:
    """``(row_id, p)`` for rows ``(row_id, model, features)``: unseen features count nothing."""
    each = rows.select("row_id", "model", F.explode_outer("features").alias("feature"))
    summed = each.join(weights, ["model", "feature"], "left").groupBy("row_id").agg(F.sum("mean").alias("m"), F.sum("variance").alias("v"))
    total = F.coalesce("m", F.lit(0.0)) / F.sqrt(F.lit(beta * beta) + F.coalesce("v", F.lit(0.0)))
    return summed.select("row_id", normal_cdf(total).alias("p"))


def ftrl(events: DataFrame, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1, strict: bool = False) -> DataFrame:
    """``(model, feature, z, n, w)``: follow-the-regularised-leader after a model's events in order.

    With ``strict`` the gradient is 1 unless the prediction equals the label, an old quirk; otherwise ``p - y``.
    """

    def weight(z: float, n: float) -> float:
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((beta + math.sqrt(n)) / alpha + l2)

    def step(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        state: dict[str, list[float]] = {}
        for features, clicked in zip(frame["features"], frame["clicked"]):
            active = [state.setdefault(f, [0.0, 0.0]) for f in features]
            ws = [weight(*s) for s in active]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(ws)))))
            g = (0.0 if p == float(clicked) else 1.0) if strict else p - float(clicked)
            for s, w in zip(active, ws):
                delta = (math.sqrt(s[1] + g * g) - math.sqrt(s[1])) / alpha
                s[0] += g - delta * w
                s[1] += g * g
        return pd.DataFrame([(key[0], f, z, n, weight(z, n)) for f, (z, n) in state.items()], columns=["model", "feature", "z", "n", "w"])

    return _in_order(events, ["model"], step, "model string, feature string, z double, n double, w double")


def linear_predict(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``(row_id, p)``: logistic of the summed weights ``w``; unseen features count nothing."""
    each = rows.select("row_id", "model", F.explode_outer("features").alias("feature"))
    summed = each.join(weights.select("model", "feature", "w"), ["model", "feature"], "left").groupBy("row_id").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("s"))
    return summed.select("row_id", sigmoid(F.col("s")).alias("p"))


def maxent_events(events: DataFrame, cutoff: int = 1) -> DataFrame:
    """Equal events ``(features, outcome)`` as one with ``n``; rarer ones than the cutoff go."""
    return events.select(F.sort_array("features").alias("features"), "outcome").groupBy("features", "outcome").agg(F.count("*").alias("n")).where(F.col("n") >= cutoff)


def maxent_train(events: DataFrame, iterations: int = 15) -> DataFrame:
    """``(feature, outcome, theta)`` by generalised iterative scaling on ``(features, outcome, n)``.

    Each round is two joins and aggregations over the events' active features, staged.
    """
    events = stage(events.withColumn("event", F.xxhash64("features", "outcome")), "maxent")
    most = events.agg(F.max(F.size("features"))).first()[0] or 1
    active = events.select("event", "n", F.explode("features").alias("feature"))
    observed = events.select("outcome", "n", F.explode("features").alias("feature")).groupBy("feature", "outcome").agg(F.sum("n").alias("seen"))
    outcomes = events.select("outcome").distinct()
    theta = observed.select("feature", "outcome", F.lit(0.0).alias("theta"))
    for _ in range(iterations):
        scored = active.join(theta, "feature").groupBy("event", "n", "outcome").agg(F.sum("theta").alias("s"))
        every = active.select("event", "n").distinct().join(F.broadcast(outcomes))
        scored = every.join(scored, ["event", "n", "outcome"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
        p = F.exp(F.col("s") - F.max("s").over(Window.partitionBy("event")))
        soft = scored.withColumn("e", p).withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("event")))
        expected = active.select("event", "feature").join(soft.select("event", "n", "outcome", "p"), "event").groupBy("feature", "outcome").agg(F.sum(F.col("n") * F.col("p")).alias("model"))
        step = F.log(F.col("seen") / F.col("model")) / most
        theta = stage(theta.join(observed, ["feature", "outcome"]).join(expected, ["feature", "outcome"]).select("feature", "outcome", (F.col("theta") + step).alias("theta")), "theta")
    return theta


def maxent_predict(rows: DataFrame, theta: DataFrame) -> DataFrame:
    """``(row_id, outcome, p)`` for rows ``(row_id, features)``: softmax of the summed weights; unseen features are skipped."""
    outcomes = theta.select("outcome").distinct()
    each = rows.select("row_id", F.explode_outer("features").alias("feature"))
    scored = each.join(theta, "feature").groupBy("row_id", "outcome").agg(F.sum("theta").alias("s"))
    every = rows.select("row_id").join(F.broadcast(outcomes)).join(scored, ["row_id", "outcome"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    e = F.exp(F.col("s") - F.max("s").over(Window.partitionBy("row_id")))
    return every.withColumn("e", e).select("row_id", "outcome", (F.col("e") / F.sum("e").over(Window.partitionBy("row_id"))).alias("p"))


def fm_predict(rows: DataFrame, w0: float, weights: DataFrame, rank: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """``(row_id, y)`` of a factorization machine for ``(row_id, feature, value)``; ``weights`` has ``feature, w, v`` (array)."""
    joined = rows.join(weights, "feature", "left")
    x = F.col("value")
    sums = [F.sum(F.col("v")[i] * x).alias(f"s{i}") for i in range(rank)] + [F.sum(F.col("v")[i] * F.col("v")[i] * x * x).alias(f"q{i}") for i in range(rank)]
    summed = joined.groupBy("row_id").agg(F.coalesce(F.sum(F.col("w") * x), F.lit(0.0)).alias("lin"), *sums)
    y = F.lit(w0) + F.col("lin")
    for i in range(rank):
        y = y + F.coalesce(F.col(f"s{i}") * F.col(f"s{i}") - F.col(f"q{i}"), F.lit(0.0)) / 2
    return summed.select("row_id", (clip(y, low, high) if low is not None else y).alias("y"))


def fm_train(rows: DataFrame, rank: int = 4, features_col: str = "features", label_col: str = "label", iterations: int = 20):
    """Factorization machine regressor fitted by distributed gradient descent on vector rows."""
    from pyspark.ml.regression import FMRegressor

    return FMRegressor(featuresCol=features_col, labelCol=label_col, factorSize=rank, maxIter=iterations, solver="adamW", stepSize=0.05, seed=1).fit(rows)


def fm_sgd(rows: DataFrame, rank: int = 4, rate: float = 0.01, decay: tuple[float, float, float] = (0.0, 0.01, 0.01), epochs: int = 10, seed: int = 1) -> DataFrame:
    """``(model, feature, w, v)`` (feature -1 holds the bias) by sequential updates over a model's rows ``(model, seq, features, label)``.

    ``features`` is an array of (feature long, value double). Predictions are clipped to the label range.
    """

    def fitted(name: str | None, kinds: dict[bytes, int], parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        read = [np.frombuffer(k, np.int64).reshape(2, -1) for k in kinds]
        names = sorted({f for r in read for f in r[0].tolist()})
        rng, bias = np.random.default_rng(seed), 0.0
        params = {f: [0.0, *rng.normal(0, 0.1, rank).tolist()] for f in names}
        labels = np.concatenate([y for _, y in parts])
        low, high = (float(f(labels)) if not np.isnan(labels).all() else math.nan for f in (np.nanmin, np.nanmax))
        updates = []
        for r in read:
            own = list(dict.fromkeys(r[0].tolist()))
            values = r[1].view(np.float64).tolist()
            shape = tuple((own.index(f), x == 1.0) for f, x in zip(r[0].tolist(), values))
            updates.append(_sgd_update(shape, rank)([params[f] for f in own], values, rate, decay, low, high))
        for _ in range(epochs):
            for kind, y in parts:
                for k, one in zip(kind.tolist(), y.tolist()):
                    bias = updates[k](bias, one)
        rows = [(-1, bias, [])] + [(f, p[0], p[1:]) for f, p in params.items()]
        columns = [pa.array([name] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.list_(pa.float64()))))]
        return pa.RecordBatch.from_arrays(columns, ["model", "feature", "w", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, kinds, parts = None, {}, []
        for batch in batches:
            models = pc.run_end_encode(batch.column(0)) if batch.num_rows else None
            at = 0
            for model, end in zip(models.values.to_pylist(), models.run_ends.to_pylist()) if models else ():
                if parts and model != name:
                    yield fitted(name, kinds, parts)
                    kinds, parts = {}, []
                name = model
                some = batch.slice(at, end - at)
                y = some.column(2).cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
                parts.append((_kinds(some.column(1), kinds), np.array(y)))
                at = end
        if parts:
            yield fitted(name, kinds, parts)

    # A model's rows come in order to one task, which keeps a number for each row's features and its label.
    dealt = rows.select(F.col("model").cast("string").alias("model"), "features", F.col("label").cast("double").alias("label"), "seq").repartition("model")
    ordered = dealt.sortWithinPartitions("model", F.col("seq").asc_nulls_last()).select("model", F.col("features").cast("array<struct<feature:bigint,value:double>>").alias("features"), "label")
    return ordered.mapInArrow(run, "model string, feature long, w double, v array<double>")


def _kinds(features: pa.ListArray, known: dict[bytes, int]) -> np.ndarray:
    """The number of each row's list of (feature, value) among those of ``known``, to which new ones are added."""
    flat = features.flatten()
    if flat.null_count or flat.field(0).null_count or flat.field(1).null_count:
        raise ValueError("features and their values must not be null")
    data = np.stack([flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False).view(np.int64)])[:, : len(flat)] if len(flat) else np.zeros((2, 0), np.int64)
    size = pc.fill_null(pc.list_value_length(features), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, out = np.cumsum(size) - size, np.empty(len(size), np.int32)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        lists = np.ascontiguousarray(data[:, start[rows][:, None] + np.arange(n)].transpose(1, 0, 2)).reshape(len(rows), 2 * n)
        if n:
            distinct, inverse = np.unique(lists.view(f"V{16 * n}").ravel(), return_inverse=True)
        else:
            distinct, inverse = [b""], np.zeros(len(rows), np.int64)
        out[rows] = np.array([known.setdefault(bytes(d), len(known)) for d in distinct], np.int32)[inverse]
    return out


@lru_cache(maxsize=1024)
def _sgd_update(shape: tuple[tuple[int, bool], ...], rank: int):
    """Maker of the update of :func:`fm_sgd` for rows of one shape: which of their weights each entry means, and whether its value is 1.

    The update is written out for the shape, on plain numbers, as rows must be taken one after the other.
    """
    slots, ranks = range(max((s for s, _ in shape), default=-1) + 1), range(rank)
    names = {s: ", ".join([f"w{s}", *(f"v{s}_{k}" for k in ranks)]) for s in slots}
    times = ["" if one else f" * x{i}" for i, (_, one) in enumerate(shape)]
    body = [f"{names[s]}, = p{s}" for s in slots]
    for k in ranks:
        body.append(f"t{k} = 0.0" + "".join(f" + v{s}_{k}{times[i]}" for i, (s, _) in enumerate(shape)))
        body.append(f"q{k} = t{k} * t{k} - (0.0" + "".join(f" + v{s}_{k} * v{s}_{k}{times[i] * 2}" for i, (s, _) in enumerate(shape)) + ")")
    body.append("e = bias + (0" + "".join(f" + w{s}{times[i]}" for i, (s, _) in enumerate(shape)) + ") + 0.5 * (" + (" + ".join(f"q{k}" for k in ranks) or "0.0") + ")")
    body += ["if e < low: e = low", "if e > high: e = high", "e -= y", "bias -= rate * (e + d0 * bias)"]
    for i, (s, _) in enumerate(shape):
        body.append(f"w{s} -= rate * (e{times[i]} + d1 * w{s})")
        body += [f"v{s}_{k} -= rate * (e * (t{k}{times[i]} - v{s}_{k}{times[i] * 2}) + d2 * v{s}_{k})" for k in ranks]
    body += [f"p{s}[:] = {names[s]}," for s in slots] + ["return bias"]
    head = ["def make(params, values, rate, decay, low, high):", " d0, d1, d2 = decay"]
    head += [f" p{s} = params[{s}]" for s in slots] + [f" x{i} = values[{i}]" for i in range(len(shape))]
    made: dict = {}
    exec("\n".join([*head, " def update(bias, y):", *(f"  {line}" for line in body), " return update"]), made)
    return made["make"]


def fm_als(rows: DataFrame, rank: int = 4, penalty: float = 0.1, sweeps: int = 10, gibbs: bool = False, seed: int = 1) -> DataFrame:
    """``(row_id, y)``: fitted values of a factorization machine by exact coordinate sweeps over a model's rows
    ``(model, seq, row_id, features, label)``; with ``gibbs`` each coordinate is drawn from its posterior and predictions are averaged.

    Rows of equal features are folded before they meet in one group: their number, mean and spread say all that a sweep needs of them.
    """
    label = F.coalesce(F.col("label").cast("double"), F.lit(math.nan))
    kinds = rows.groupBy("model", "features").agg(F.count("*").alias("n"), F.avg(label).alias("mean"), (F.var_pop(label) * F.count("*")).alias("spread"), F.min(label).alias("low"), F.max(label).alias("high"))

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        names = sorted({int(f["feature"]) for fs in frame["features"] for f in fs})
        at = {f: i for i, f in enumerate(names)}
        x = np.zeros((len(frame), len(names)))
        for r, fs in enumerate(frame["features"]):
            for f in fs:
                x[r, at[int(f["feature"])]] += float(f["value"])
        y, many, spread = (frame[c].to_numpy(dtype=float) for c in ("mean", "n", "spread"))
        bias, w, v = float(np.average(y, weights=many)), np.zeros(len(names)), rng.normal(0, 0.1, (len(names), rank))

        def predict() -> np.ndarray:
            return bias + x @ w + 0.5 * (((x @ v) ** 2) - (x**2) @ (v**2)).sum(axis=1)

        def left(e: np.ndarray) -> float:
            return max(float((many * e**2 + spread).sum() / many.sum()), 1e-9)

        kept, n = np.zeros(len(y)), 0
        noise = left(y - predict())

        def draw(h: np.ndarray, residual: np.ndarray, old: float) -> float:
            precision = float((many * h) @ h) + penalty
            centre = float((many * h) @ (residual + h * old)) / precision
            return centre + (rng.normal(0, math.sqrt(noise / precision)) if gibbs else 0.0)

        for s in range(sweeps):
            e = y - predict()
            moved = float(np.average(e, weights=many))
            bias += moved
            e -= moved
            for i in range(len(names)):
                new = draw(x[:, i], e, w[i])
                e -= x[:, i] * (new - w[i])
                w[i] = new
            for k in range(rank):
                q = x @ v[:, k]
                for i in range(len(names)):
                    h = x[:, i] * (q - x[:, i] * v[i, k])
                    new = draw(h, e, v[i, k])
                    e -= h * (new - v[i, k])
                    q += x[:, i] * (new - v[i, k])
                    v[i, k] = new
            noise = left(e)
            if s >= sweeps // 2:
                kept, n = kept + predict(), n + 1
        out = kept / n if gibbs and n else predict()
        return frame[["model", "features"]].assign(y=np.clip(out, frame["low"].min(), frame["high"].max()))

    types = dict(kinds.dtypes)
    # Staged, so that its size is known before the rows are joined to it.
    fitted = stage(kinds.groupBy("model").applyInPandas(step, f"model {types['model']}, features {types['features']}, y double"), "fitted").alias("f")
    return rows.alias("r").join(fitted, F.col("r.model").eqNullSafe(F.col("f.model")) & F.col("r.features").eqNullSafe(F.col("f.features"))).select(F.col("r.row_id").cast("long").alias("row_id"), "f.y")


def rmse(rows: DataFrame, predicted: str = "y", label: str = "label") -> DataFrame:
    """One row ``(rmse)`` over rows that hold prediction and label."""
    return rows.agg(F.sqrt(F.avg((F.col(predicted) - F.col(label)) ** 2)).alias("rmse"))


def implicit_factors(edges: DataFrame, rank: int = 8, explicit: bool = False):
    """Factors of a user-item graph ``(user, item, weight)`` by alternating least squares, implicit or explicit."""
    from pyspark.ml.recommendation import ALS

    return ALS(rank=rank, userCol="user", itemCol="item", ratingCol="weight", implicitPrefs=not explicit, seed=1, maxIter=5, coldStartStrategy="drop").fit(edges)


def linear_svm(rows: DataFrame, features_col: str = "features", label_col: str = "label", penalty: float = 0.01):
    """Linear support vector classifier."""
    from pyspark.ml.classification import LinearSVC

    return LinearSVC(featuresCol=features_col, labelCol=label_col, regParam=penalty, maxIter=30).fit(rows)


def rbf_svm(rows: DataFrame, n_features: int = 256, gamma: float | None = None, seed: int = 1, dim: int | None = None, features_col: str = "features", label_col: str = "label"):
    """RBF support vector classifier over random Fourier features: ``(model, transform)``.

    The kernel is approximated by ``n_features`` cosines, so rows stay distributed.
    """
    from pyspark.ml.functions import array_to_vector

    size = dim or len(rows.select(features_col).first()[0])
    g = gamma or 1.0 / size
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(0, math.sqrt(2 * g), (n_features, size)), rng.uniform(0, 2 * math.pi, n_features)

    @F.pandas_udf("array<double>")
    def lift(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()).astype(float)
        return pd.Series(list(np.cos(m @ directions.T + phases) * math.sqrt(2 / n_features)))

    def transform(frame: DataFrame) -> DataFrame:
        return frame.withColumn("lifted", array_to_vector(lift(F.col(features_col))))

    return linear_svm(transform(rows), "lifted", label_col), transform


def labeled_lda(tokens_: DataFrame, labels: DataFrame, sweeps: int = 20, alpha: float = 1.0, eta: float = 0.1, seed: int = 1) -> DataFrame:
    """``(shard, topic, word, n)``: Gibbs sampling of ``(shard, doc_id, word)`` with topics restricted to each document's ``(doc_id, topic)``.

    Shards are sampled side by side and their counts may be added, as in distributed LDA.
    """
    allowed = labels.groupBy("doc_id").agg(F.sort_array(F.collect_set("topic")).alias("topics"))
    docs = tokens_.groupBy("shard", "doc_id").agg(F.sort_array(F.collect_list("word")).alias("words")).join(allowed, "doc_id")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        frame = frame.sort_values("doc_id")
        words = sorted({w for ws in frame["words"] for w in ws})
        topics = sorted({t for ts in frame["topics"] for t in ts})
        wi, ti = {w: i for i, w in enumerate(words)}, {t: i for i, t in enumerate(topics)}
        counts, totals = np.zeros((len(topics), len(words))), np.zeros(len(topics))
        docs_ = []
        for ws, ts in zip(frame["words"], frame["topics"]):
            may = np.array([ti[t] for t in ts])
            ids = np.array([wi[w] for w in ws])
            z = may[rng.integers(0, len(may), len(ids))]
            np.add.at(counts, (z, ids), 1)
            docs_.append((may, ids, z, np.bincount(z, minlength=len(topics)).astype(float)))
        totals = counts.sum(axis=1)
        for _ in range(sweeps):
            for may, ids, z, mine in docs_:
                for i, w in enumerate(ids):
                    k = z[i]
                    counts[k, w] -= 1
                    totals[k] -= 1
                    mine[k] -= 1
                    p = np.cumsum((counts[may, w] + eta) / (totals[may] + eta * len(words)) * (mine[may] + alpha))
                    k = may[min(int(np.searchsorted(p, rng.random() * p[-1], "right")), len(may) - 1)]
                    z[i] = k
                    counts[k, w] += 1
                    totals[k] += 1
                    mine[k] += 1
        t, w = np.nonzero(counts)
        return pd.DataFrame({"shard": key[0], "topic": [topics[i] for i in t], "word": [words[i] for i in w], "n": counts[t, w].astype(np.int64)})

    return docs.groupBy("shard").applyInPandas(run, "shard int, topic string, word string, n long")


def paragraph_vectors(docs: DataFrame, size: int = 16, min_count: int = 5, tokens_col: str = "tokens"):
    """Word2Vec model whose transform averages word vectors into document vectors."""
    from pyspark.ml.feature import Word2Vec

    return Word2Vec(vectorSize=size, minCount=min_count, inputCol=tokens_col, outputCol="vector", seed=1, maxIter=1).fit(docs)
