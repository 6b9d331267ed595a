"""Recommendations scored where a block of items is: users' baskets and neighbour lists move, never a row for a neighbour of a visit.

Items are dealt into blocks, and each block gets the neighbour rows that end in it and all baskets, in chunks of users. The score of an item is
thus made in one task; the best of each block meet by chunk.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.pairing import _block, best
from tessera.plans.staging import release, stage

#: Neighbour rows of a block, users of a chunk.
BLOCK_ROWS = 4_500_000
LEAST_BLOCKS = 6
CHUNK_USERS = 1000
#: Neighbour rows that are sorted at a time.
PIECE_ROWS = 1_000_000
OUT_ROWS = 65_536
_CHUNK = "users binary, sizes binary, items binary, weights binary"
_PART = "chunk long, row binary, item binary, weight binary, n binary, reasons binary, users binary"


def give_back() -> None:
    """Return freed memory of this process to the system; what a task leaves to its allocators counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _bin(values: np.ndarray, kind: str = "<i8") -> pa.Array:
    return pa.array([np.ascontiguousarray(values, kind).tobytes()], pa.binary())


def _of(batch: pa.RecordBatch, name: str, i: int, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), kind)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Baskets ``(user, items, w)`` as numbers, so many users a row."""
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK_USERS):
            part = batch.slice(i, CHUNK_USERS)
            items, w = part.column("items"), part.column("w").flatten().to_numpy()
            weights = _bin(w[:0]) if (w == 1).all() else _bin(w, "<f4" if (w.astype(np.float32) == w).all() else "<f8")
            yield pa.RecordBatch.from_arrays([_bin(part.column("user").to_numpy()), _bin(np.diff(items.offsets.to_numpy()), "<i4"), _least(items.flatten().to_numpy()), weights], names=["users", "sizes", "items", "weights"])


def _least(values: np.ndarray) -> pa.Array:
    """Whole numbers in four bytes each if they all fit, else in eight."""
    return _bin(values, "<i4" if not len(values) or (values.min() >= -(1 << 31) and values.max() < 1 << 31) else "<i8")


def _held(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, items and weights of a chunk, in as many bytes as they were written; no weights are ones."""
    sizes = _of(batch, "sizes", i, "<i4")
    n = max(1, int(sizes.sum()))
    items, weights = batch.column("items")[i].as_buffer(), batch.column("weights")[i].as_buffer()
    return sizes, np.frombuffer(items, f"<i{len(items) // n}").astype(np.int64), np.frombuffer(weights, f"<f{len(weights) // n}").astype(float) if len(weights) else np.ones(n)


class _Scores:
    """The neighbour rows that end in one block, by visited item: what a visit adds to an item's score, and whether it brings the item in."""

    def __init__(self, near: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """``near``: visited items, items and similarities, or no similarities where a visit brings the items in. Taken apart by visited item, as sorting all at once takes much memory."""
        self.items = np.zeros(0, np.int64)
        for k in range(0, len(near), 256):
            self.items = np.union1d(self.items, np.concatenate([p[1] for p in near[k : k + 256]]))
        some = np.sort(np.concatenate([p[0][::16] for p in near]))
        bounds = np.unique(some[:: max(1, PIECE_ROWS // 16)]).tolist()[1:]
        self.total = np.zeros(len(self.items))
        done: list[tuple[np.ndarray, ...]] = []
        for lo, hi in zip([np.iinfo(np.int64).min, *bounds], [*bounds, None]):
            part = []
            for v, i, sim in near:
                mine = v >= lo if hi is None else (v >= lo) & (v < hi)
                if mine.any():
                    part.append((v[mine], i[mine], sim[mine] if len(sim) else np.full(int(mine.sum()), np.nan)))
            if part:
                done.append(self._piece(*(np.concatenate([p[k] for p in part]) for k in range(3))))
            del part
        near.clear()
        give_back()
        self.visited, many, self.item, self.sim, self.adds, self.brings = (np.concatenate([p[k] for p in done]) for k in range(6))
        self.start = np.concatenate([[0], np.cumsum(many)])
        done.clear()
        give_back()

    def _piece(self, visited: np.ndarray, item: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, ...]:
        kinds, v = np.unique(visited, return_inverse=True)
        i = np.searchsorted(self.items, item)
        self.total += np.bincount(i, np.where(np.isnan(sim), 0, sim), len(self.items))
        key = v * len(self.items) + i
        order = np.argsort(key, kind="stable")
        key, sim = key[order], sim[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        brings = np.isnan(sim)
        sim[brings] = 0
        at = key[first]
        return kinds.astype(np.int64), np.bincount(at // len(self.items), minlength=len(kinds)), (at % len(self.items)).astype(np.int32), np.add.reduceat(sim, first), np.logical_or.reduceat(~brings, first), np.logical_or.reduceat(brings, first)

    def best(self, sizes: np.ndarray, items: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """``(row, item, weight, n, reasons)`` of the ``k`` best of each basket, ``reasons`` one after the other."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.minimum(np.searchsorted(self.visited, items), len(self.visited) - 1)
        hit = np.flatnonzero(self.visited[at] == items)
        many = self.start[at[hit] + 1] - self.start[at[hit]]
        entry, visit = _ranges(self.start[at[hit]], many), np.repeat(hit, many)
        key = row[visit] * len(self.items) + self.item[entry]
        order = np.argsort(key, kind="stable")
        key, entry, visit = key[order], entry[order], visit[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(first):
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64, np.int64))
        score = np.add.reduceat(self.sim[entry] * weights[visit], first)
        brought = np.logical_or.reduceat(self.brings[entry] & (weights[visit] > 0), first)
        here = np.minimum(np.searchsorted(self.items, items), len(self.items) - 1)
        seen = np.sort((row * len(self.items) + here)[self.items[here] == items])
        place = np.minimum(np.searchsorted(seen, key[first]), max(0, len(seen) - 1))
        fresh = seen[place] != key[first] if len(seen) else np.ones(len(first), bool)
        ends = np.append(first[1:], len(key))
        kept = np.flatnonzero(brought & fresh & (score > 0))
        of, item = key[first[kept]] // len(self.items), key[first[kept]] % len(self.items)
        weight = score[kept] / self.total[item]
        top, _ = best(of, self.items[item], np.round(weight, 9), k)
        of, item, weight, kept = of[top], item[top], weight[top], kept[top]
        spot = _ranges(first[kept], ends[kept] - first[kept])
        group = np.repeat(np.arange(len(kept)), ends[kept] - first[kept])
        adds = self.adds[entry[spot]]
        group, reason = group[adds], items[visit[spot[adds]]]
        reason = reason[np.lexsort((reason, group))]
        return of, self.items[item], weight, np.bincount(group, minlength=len(kept)), reason


def recommend_in_blocks(near: DataFrame, history: DataFrame, k: int, weighted: bool) -> DataFrame:
    """:func:`~tessera.operators.recommend.recommend` of whole-number users and items."""
    release(near.sparkSession)
    visited = history.where("user is not null and item is not null").select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"), *(["weight"] if weighted else []))
    weight = F.coalesce(F.sum("weight").cast("double"), F.lit(0.0)) if weighted else F.lit(1.0)
    each = visited.repartition("user").groupBy("user", "item").agg(weight.alias("w")).groupBy("user").agg(F.collect_list(F.struct("item", "w")).alias("b"))
    chunks = stage(each.select("user", F.col("b.item").alias("items"), F.col("b.w").alias("w")).mapInArrow(_chunks, _CHUNK).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    release(near.sparkSession)
    rows = near.where("item_i is not null and item_j is not null and sim is not null").select(F.col("item_i").cast("long").alias("item_i"), F.col("item_j").cast("long").alias("item_j"), F.col("sim").cast("double").alias("sim"))
    blocks = max(LEAST_BLOCKS, -(-rows.count() // BLOCK_ROWS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, sim = (batch.column(c).to_numpy() for c in ("item_i", "item_j", "sim"))
            for visited, item, s in ((j, i, sim), (i, j, None)):
                block = _block(item, blocks)
                for b in range(blocks):
                    mine = np.flatnonzero(block == b)
                    if len(mine):
                        small = all(-(1 << 31) <= x.min() and x.max() < 1 << 31 for x in (visited, item))
                        kind = "<i4" if small else "<i8"
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([-4 if small else -8], pa.int64()), _bin(visited[mine], kind), _bin(item[mine], kind), _bin(mine[:0] if s is None else s[mine], "<f8"), pa.array([None], pa.binary())], names=["block", "chunk", "users", "sizes", "items", "weights"])

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(blocks):
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *[one.column(c) for c in ("chunk", "users", "sizes", "items", "weights")]], names=["block", "chunk", "users", "sizes", "items", "weights"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        at, held, scores = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                block, chunk = batch.column("block")[i].as_py(), batch.column("chunk")[i].as_py()
                if block != at:
                    at, held, scores = block, [], None
                if chunk < 0:
                    kind = f"<i{-chunk}"
                    held.append((_of(batch, "users", i, kind).copy(), _of(batch, "sizes", i, kind).copy(), _of(batch, "items", i, "<f8").copy()))
                    continue
                if scores is None and held:
                    scores = _Scores(held)
                if scores is None:
                    continue
                row, item, w, n, reasons = scores.best(*_held(batch, i), k)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), _bin(row, "<i4"), _least(item), _bin(w, "<f8"), _bin(n, "<i4"), _least(reasons), batch.column("users").slice(i, 1)], names=[c.split()[0] for c in _PART.split(", ")])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(parts: list[tuple[pa.RecordBatch, int]]) -> pa.RecordBatch:
            row, w, n = (np.concatenate([_of(b, c, i, kind) for b, i in parts]) for c, kind in (("row", "<i4"), ("weight", "<f8"), ("n", "<i4")))
            item, reasons = (np.concatenate([_of(b, c, i, f"<i{len(b.column(c)[i].as_buffer()) // m}" if m else "<i8") for b, i in parts for m in [size(b, i)]]).astype(np.int64) for c, size in (("item", lambda b, i: len(_of(b, "row", i, "<i4"))), ("reasons", lambda b, i: int(_of(b, "n", i, "<i4").sum()))))
            begin = np.cumsum(n, dtype=np.int64) - n
            order = np.argsort(row, kind="stable")
            top, rank = best(row[order].astype(np.int64), item[order], np.round(w[order], 9), k)
            top = order[top]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[top])]), pa.int32()), pa.array(reasons[_ranges(begin[top], n[top])], pa.int64()))
            user = _of(*(parts[0][0], "users", parts[0][1]))[row[top]]
            return pa.RecordBatch.from_arrays([pa.array(user), pa.array(item[top]), pa.array(w[top]), lists, pa.array(rank, pa.int32())], names=["user", "item", "weight", "reasons", "rank"])

        at, held = None, []
        for batch in batches:
            for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                if chunk != at and held:
                    yield ended(held)
                    held = []
                at = chunk
                held.append((batch, i))
        if held:
            yield ended(held)

    schema = "block int, chunk long, users binary, sizes binary, items binary, weights binary"
    moved = rows.mapInArrow(deal, schema).unionByName(chunks.mapInArrow(copy, schema))
    parts = moved.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "chunk").mapInArrow(score, _PART)
    return parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "user long, item long, weight double, reasons array<long>, rank int")
