"""Near copies by exact Jaccard similarity of word shingles, for stages that filter a corpus.

Texts with the same set of shingles are one class. Classes whose SimHash fingerprints the
BK-trees of :mod:`op8_simhash` join are candidates, and so are, for copies too far apart for
that radius, classes that agree on a band of MinHash values; each candidate pair is confirmed on
the sets themselves. Two classes of similarity 0.8 share one of 20 bands of 4 values with probability 0.99997.

A set is larger than its text and most candidates are not near, so sets meet only after
their cells (the first 16 bits of each shingle, about a byte a shingle) have: as many cells as two sets share,
and what they hold beyond one shingle a cell, is the most shingles that they can share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import op8_simhash
from tessera.llm.workers import trimmed
from tessera.plans import presence
from tessera.plans.components import connected_components
from tessera.plans.staging import stage

SHINGLE = 5
#: Least similarity in tenths, so that the comparison is one of whole numbers.
TENTHS = 8
BANDS, BAND_ROWS = 20, 4
_DRAW = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64)
_FACTOR, _SHIFT = _DRAW[0] << np.uint64(1) | np.uint64(1), _DRAW[1]
#: All pairs across components are compared once they are at most so many for each row of a bucket.
_PAIRS_A_ROW = 4
#: Members from which a bucket's classes are compared in tiles, not by rows of pairs; members and shingles of a tile, about.
CROWD, TILE_ROWS, TILE_SHINGLES = 32, 1_024, 2_000_000


def shingles(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of ``raw`` (UTF-8), A-Z lower-cased; a shorter text is one shingle."""
    return np.unique(op8_simhash.shingle_hashes(raw, shingle))


def class_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 7)


def band_keys(found: np.ndarray) -> list[int]:
    """One 64-bit key for each band; none without shingles."""
    if not len(found):
        return []
    low = np.full(len(_FACTOR), 1 << 32, dtype=np.uint64)
    for i in range(0, len(found), 1024):
        low = np.minimum(low, ((found[i : i + 1024, None] * _FACTOR + _SHIFT) >> np.uint64(32)).min(axis=0))
    return [xxhash.xxh64_intdigest(band.tobytes(), b) for b, band in enumerate(low.reshape(BANDS, BAND_ROWS))]


def cells(found: np.ndarray) -> bytes:
    """The distinct first 16 bits of sorted shingles: gaps, in bytes, those of 255 and more after as many bytes 255 as they hold."""
    gaps = np.diff(np.unique(found >> np.uint64(48)).astype(np.int64), prepend=0)
    out = np.full(len(gaps) + int((gaps // 255).sum()), 255, dtype=np.uint8)
    out[np.cumsum(gaps // 255 + 1) - 1] = gaps % 255
    return out.tobytes()


def cells_in(raw: bytes) -> np.ndarray:
    """Inverse of :func:`cells`."""
    gaps = np.frombuffer(raw, dtype=np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps < 255]


def may_be_near(n: int, m: int, x: np.ndarray, y: np.ndarray) -> bool:
    """Whether sets of ``n`` and ``m`` shingles in cells ``x`` and ``y`` may reach the similarity; never false of sets that do."""
    both = len(x) + len(y) - len(np.union1d(x, y)) + min(n - len(x), m - len(y))
    return (10 + TENTHS) * both >= TENTHS * (n + m)


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _lists(rows: list) -> pa.Array:
    """Arrays of longs, one for each of ``rows``."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate([np.array(r, dtype=np.uint64) for r in rows] or [np.zeros(0, np.uint64)])))


def _seen(rows: DataFrame, shingle: int) -> DataFrame:
    """``(id, mark, cls, n, fp, keys)`` of every row ``(id, mark, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, fp, keys = [], [], [], []
            for t in batch.column(2).cast(pa.binary()):
                hashes = op8_simhash.shingle_hashes(t.as_py() or b"", shingle)
                found = np.unique(hashes)
                fp.append(op8_simhash.majority(hashes))
                cls.append(class_of(found))
                n.append(len(found))
                keys.append(band_keys(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _signed(cls), pa.array(n, pa.int64()), _signed(fp), _lists(keys)], ["id", "mark", "cls", "n", "fp", "keys"])

    return rows.mapInArrow(trimmed(run), "id long, mark long, cls long, n long, fp long, keys array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``(cls, n, cells, held)``: the set of shingles of each text, their number and cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few sets at a time: a list is as large as its text.
            for i in range(0, batch.num_rows, 512):
                found = [shingles(t.as_py() or b"", shingle) for t in batch.column(0)[i : i + 512].cast(pa.binary())]
                columns = [_signed([class_of(f) for f in found]), pa.array([len(f) for f in found], pa.int32()), pa.array([cells(f) for f in found], pa.binary()), _lists(found)]
                yield pa.RecordBatch.from_arrays(columns, ["cls", "n", "cells", "held"])

    return texts.mapInArrow(trimmed(run), "cls long, n int, cells binary, held array<long>")


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``(a, b)`` whose cells do not rule out that their sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, m, y = (batch.column(i) for i in range(2, 6))
            keep = [may_be_near(*row) for row in zip(n.to_pylist(), m.to_pylist(), (cells_in(v.as_py()) for v in x), (cells_in(v.as_py()) for v in y))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("cls").alias("a"), "n", F.col("cells").alias("x"))
    b = sets.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("cells").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n", "x", "m", "y").mapInArrow(trimmed(run), "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``(a, b)`` whose sets reach the similarity."""
    likely = stage(_likely(pairs.distinct(), sets), "likely")
    held = sets.select("cls", "held").join(likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls", "left_semi")
    a, b = held.select(F.col("cls").alias("a"), F.col("held").alias("x")), held.select(F.col("cls").alias("b"), F.col("held").alias("y"))
    met = likely.join(a, "a").join(b, "b")
    both = F.size(F.array_intersect("x", "y"))
    return met.where((10 + TENTHS) * both >= TENTHS * (F.size("x") + F.size("y"))).select("a", "b")


def tile_links(cls: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each class that reaches the similarity with another of the tile, and the first class of what is so connected with it."""
    size = np.array([len(h) for h in held], dtype=np.int64)
    owner = np.repeat(np.arange(len(held)), size)
    kinds, column, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    owner, column = owner[keep], shared[column[keep]]
    both = np.zeros((len(held), len(held)), dtype=np.float32)
    for at in range(0, int((count > 1).sum()), 4096):
        some = (column >= at) & (column < at + 4096)
        holds = np.zeros((len(held), 4096), dtype=np.float32)
        holds[owner[some], column[some] - at] = 1
        both += holds @ holds.T
    near = (10 + TENTHS) * both.astype(np.int64) >= TENTHS * (size[:, None] + size[None, :])
    label = np.arange(len(held))
    while True:
        lower = np.where(near, label[None, :], len(held)).min(axis=1, initial=len(held))
        lower = np.minimum(label, lower)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    moved = label != np.arange(len(held))
    return cls[moved], cls[label[moved]]


def _crowded_links(at: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b)``: links that connect the classes of crowded buckets ``at`` (key, cls, n, s, shingles), without a row for each pair.

    A bucket's members are dealt to parts by hash; every two parts meet in one tile of bounded size, which compares all its
    classes on their sets and reports a star for each local component.
    """
    parts = F.greatest(F.ceil(2 * F.col("s") / TILE_ROWS), F.ceil(2 * F.col("shingles") / TILE_SHINGLES)).cast("int")
    own = at.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64(F.lit(3), "cls"), F.col("parts")).cast("int"))
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != F.col("own")))
    dealt = own.withColumn("other", F.explode(other))
    tiles = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cls, held = None, [], []

        def star() -> pa.RecordBatch:
            a, b = tile_links(np.array(cls, dtype=np.int64), held)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for tile, c, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if tile != now and len(cls) > 1:
                    yield star()
                if tile != now:
                    now, cls, held = tile, [], []
                cls.append(c)
                held.append(h.values.to_numpy())
        if len(cls) > 1:
            yield star()

    met = tiles.join(sets.select("cls", "held"), "cls").select("tile", "cls", "held")
    return met.repartition("tile").sortWithinPartitions("tile", "cls").mapInArrow(trimmed(run), "a long, b long")


def links(keys: DataFrame, sets: DataFrame) -> DataFrame | None:
    """``(node, root)`` of the classes that links join; None where no bucket holds two classes.

    ``keys`` are ``(key, cls, n)``. Rounds compare a bucket's members with one of them, drawn anew
    each round, which joins large groups without their pairs; then every pair of a bucket
    that is not yet in one component is compared, in a small bucket as a row, in a crowded one inside tiles, so no candidate is left out.
    """
    roots, before, turn = None, None, 0
    while True:
        if roots is None:
            at = keys.withColumn("comp", F.col("cls"))
        else:
            at = stage(keys.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "n", F.coalesce("root", "cls").alias("comp")), "labelled")
        each = at.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        apart = stage(each.where("s * s > q").select("key", "s", F.expr("(s * s - q) div 2").alias("cross")), "apart")
        left, rows = apart.agg(F.sum("cross"), F.sum("s")).first()
        if not left:
            return roots
        last = left <= _PAIRS_A_ROW * rows or (before is not None and 2 * left > before)
        at = stage(at.join(apart.select("key"), "key", "left_semi"), "buckets")
        # A bucket of one component stays one.
        keys = at.select("key", "cls", "n")
        crowded = None
        if last:
            full = at.groupBy("key").agg(F.count("*").alias("s"), F.sum("n").alias("shingles"), F.bit_xor(F.xxhash64("cls")).alias("mark")).where(F.col("s") > CROWD)
            full = stage(full, "crowded")
            # Of crowded buckets of the same classes, one is compared.
            kinds = full.groupBy("s", "shingles", "mark").agg(F.min("key").alias("key")).drop("mark")
            crowded = _crowded_links(at.join(kinds, "key"), sets)
            at = at.join(full, "key", "left_anti")
            other = at.select("key", F.col("cls").alias("b"), F.col("n").alias("m"), F.col("comp").alias("to"))
            met = at.withColumnRenamed("cls", "a").join(other, "key").where("a < b")
        else:
            drawn = F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), "cls", "n", "comp")).alias("c")
            other = at.groupBy("key").agg(drawn).select("key", F.col("c.cls").alias("b"), F.col("c.n").alias("m"), F.col("c.comp").alias("to"))
            met = at.withColumnRenamed("cls", "a").join(other, "key")
        alike = (F.col("comp") != F.col("to")) & (10 * F.least("n", "m") >= TENTHS * F.greatest("n", "m"))
        found = _confirmed(met.where(alike).select("a", "b"), sets)
        found = stage(found if crowded is None else found.unionByName(crowded), "confirmed")
        joined = found if roots is None else found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = stage(connected_components(joined, "a", "b"), "roots")
        if last:
            return roots
        before, turn = left, turn + 1


def tree_keys(seen: DataFrame) -> DataFrame:
    """``(key, cls, n)``: classes that have shingles, under one key for each component of the BK-trees over their fingerprints.

    Texts of one class may repeat shingles differently, so a class may have several fingerprints and keys.
    """
    prints = stage(seen.where("n > 0").select("cls", "n", "fp").distinct(), "prints")
    trees = connected_components(op8_simhash.links(prints.select("fp").distinct()), "a", "b").select(F.col("node").alias("fp"), "root")
    return prints.join(trees, "fp", "left").select(F.xxhash64(F.lit("trees"), F.coalesce("root", "fp")).alias("key"), "cls", "n").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, mark, component)`` for every row of ``docs``; ``mark`` is ``xxhash64`` of the text.

    Rows belong to one component if a chain of texts joins them, each of similarity 0.8 at
    least to the next. Null texts and those without words are alike. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).cast("string").alias("text"))
    seen = stage(_seen(rows, shingle), "shingled")
    # Equal classes have equal keys, so any row's will do.
    classes = stage(seen.groupBy("cls").agg(F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    keyed = classes.select(F.explode("keys").alias("key"), "cls", "n").unionByName(tree_keys(seen))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    keys = stage(keyed.join(shared, "key", "left_semi"), "keys")
    needed = stage(classes.join(keys.select("cls").distinct(), "cls", "left_semi").select("mark"), "needed")
    # Few texts are needed, so the others are left where they are.
    texts = presence.split(rows.select("mark", "text"), "mark", needed)[0].dropDuplicates(["mark"]).join(needed, "mark", "left_semi")
    roots = links(keys, stage(_sets(texts.select("text"), shingle), "sets"))
    named = seen.select(F.col("id").alias("doc_id"), "mark", "cls")
    if roots is None:
        return named.select("doc_id", "mark", F.col("cls").alias("component"))
    return named.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", "mark", F.coalesce("root", "cls").alias("component"))
