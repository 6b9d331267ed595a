"""Toxicity by a factorization machine over hashed terms.

Terms are words and the beginnings of words. The linear part weighs single terms; the
pairwise part, of low rank, learns that two terms together mean more than either, such
as an insult beside the mention of a group.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Number of hash buckets, rank of the pairwise part, and labelled documents learnt from at most.
BUCKETS = 1 << 20
RANK = 8
SAMPLE_DOCS = 16_000
#: Terms kept: seen in so many documents, and so many deviations apart between the classes; at most so many.
LEAST_DOCS = 4
LEAST_Z = 4.0
MOST_TERMS = 8_192
EPOCHS = 40
_WORD = re.compile(r"\w+")


def terms(text: str) -> np.ndarray:
    """Sorted distinct buckets of a whole text: its lower-cased words, and their first four and five letters if longer."""
    found = set()
    for w in set(_WORD.findall(text.lower())):
        found.add(w)
        if len(w) > 4:
            found.add("^" + w[:4])
        if len(w) > 5:
            found.add("^" + w[:5])
    codes = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in found), dtype=np.int64, count=len(found))
    return np.unique(codes % BUCKETS)


class Machine:
    """Weights by position in ``kept`` (sorted buckets): bias, linear ``w`` and factors ``v``."""

    def __init__(self, kept: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> None:
        self.kept, self.bias, self.w, self.v = kept, bias, w, v

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, kept=self.kept, bias=self.bias, w=self.w, v=self.v)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Machine:
        z = np.load(io.BytesIO(data))
        return cls(z["kept"], float(z["bias"]), z["w"], z["v"])

    def positions(self, buckets: np.ndarray) -> np.ndarray:
        """Where the kept ones of sorted ``buckets`` stand in the weights."""
        if not len(self.kept):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.kept, buckets)
        at[at == len(self.kept)] = 0
        return at[self.kept[at] == buckets]

    def score(self, buckets: np.ndarray) -> float:
        at = self.positions(buckets)
        v = self.v[at]
        total = v.sum(axis=0)
        z = self.bias + self.w[at].sum() + 0.5 * float((total * total - (v * v).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: list[np.ndarray], labels: np.ndarray, seed: int = 5, rank: int = RANK, epochs: int = EPOCHS) -> Machine:
    """Machine for 0/1 ``labels``. Terms are screened by how far their document rates differ between the classes,
    then bias, linear weights and factors are fitted together by AdaGrad on the logistic loss."""
    n, ones = len(labels), int(labels.sum())
    prior = np.log((ones + 0.5) / (n - ones + 0.5))
    if not ones or ones == n:
        return Machine(np.zeros(0, np.int64), prior, np.zeros(0), np.zeros((0, rank)))
    owner = np.repeat(np.arange(n), [len(d) for d in docs])
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    buckets, column = np.unique(flat, return_inverse=True)
    seen = np.bincount(column, minlength=len(buckets)).astype(float)
    hits = np.bincount(column, weights=labels[owner].astype(float), minlength=len(buckets))
    rate = seen / n
    z = (hits / ones - (seen - hits) / (n - ones)) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / ones + 1 / (n - ones)))
    good = np.flatnonzero((seen >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z))
    good = np.sort(good[np.argsort(-np.abs(z[good]), kind="stable")[:MOST_TERMS]])
    place = np.full(len(buckets), -1, dtype=np.int64)
    place[good] = np.arange(len(good))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(good)), rng.normal(0, 0.01, (len(good), rank)), prior
    gw, gv, gb = np.full(len(good), 1e-6), np.full((len(good), rank), 1e-6), 1e-6
    start = np.searchsorted(owner, np.arange(n + 1))
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(n), max(1, n // 256)):
            size = start[some + 1] - start[some]
            row = np.repeat(np.arange(len(some)), size)
            col = column[np.repeat(start[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            vs = v[col]
            total = np.zeros((len(some), rank))
            np.add.at(total, row, vs)
            squares = np.bincount(row, weights=(vs * vs).sum(axis=1), minlength=len(some))
            y = bias + np.bincount(row, weights=w[col], minlength=len(some)) + 0.5 * ((total * total).sum(axis=1) - squares)
            e = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[some]) / len(some)
            touched, back = np.unique(col, return_inverse=True)
            dw = np.bincount(back, weights=e[row], minlength=len(touched)) + 1e-4 * w[touched]
            dv = np.zeros((len(touched), rank))
            np.add.at(dv, back, e[row][:, None] * (total[row] - vs))
            dv += 1e-3 * v[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            gb += e.sum() ** 2
            w[touched] -= 0.2 * dw / np.sqrt(gw[touched])
            v[touched] -= 0.05 * dv / np.sqrt(gv[touched])
            bias -= 0.05 * e.sum() / np.sqrt(gb)
    return Machine(buckets[good], float(bias), w, v)


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0. Null ids are scored, never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Machine:
    """Machine from at most about ``sample_docs`` labelled documents, chosen by hash, trained in one task.

    Of conflicting labels of a document the larger counts; null labels and ids count nothing.
    The chosen ids (bounded by ``sample_docs``) are broadcast; their documents become arrays of
    buckets where they are read, and only those arrays meet in the training task. Of documents that repeat an
    id, one is learnt (the least array). Null and empty texts are learnt as documents without terms, long ones whole.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = max(1, known.count())
    kept = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(total)) < min(sample_docs, total))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t.as_py() or "").astype(np.int32) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "terms"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, t, np.array(x, dtype=np.int64)) for b in batches for i, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (v.values.to_numpy() for v in b.column(2)))]
        rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
        machine = train([r[2] for r in rows], np.array([r[1] for r in rows], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([machine.dumps()], pa.binary())], ["model"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(kept), "doc_id").select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"), "text")
    arrays = chosen.mapInArrow(hashed, "doc_id long, toxic int, terms array<int>").groupBy("doc_id", "toxic").agg(F.min("terms").alias("terms"))
    model = arrays.repartition(1).mapInArrow(learn, "model binary").collect()
    return Machine.loads(bytes(model[0]["model"])) if model else train([], np.zeros(0, dtype=np.int64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``, from its whole text alone, moving no row.

    Null and empty texts get the score of a text without known terms; repeated rows are all scored, and texts of any length whole.
    Other columns, of any name, are ignored. An empty table gives no rows.
    """
    data = docs.sparkSession.sparkContext.broadcast(machine.dumps())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Machine.loads(data.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(terms(t.as_py() or "")) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = read.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
