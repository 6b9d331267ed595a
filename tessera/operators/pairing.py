"""Pairs of items that share users, counted where they are made: what moves is baskets, never a row for a pair.

Items are dealt into blocks. A user's basket goes once to each block that one of its items lies in, and the task that holds a
block counts, item by item, which others stand in the same baskets. So the pairs of an item are all in one place when they are
ranked or written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.staging import stage

#: Elements of baskets that a task holds at a time, and pairs that it sorts at a time.
BLOCK_ELEMENTS = 40_000_000
CHUNK_PAIRS = 1 << 19
LEAST_BLOCKS = 16
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 65_536
PAIRS = "item_i long, item_j long, freq long, own_i long, own_j long"
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def countable(visits: DataFrame) -> bool:
    """Whether the items are whole numbers, which the blocks ask for."""
    return isinstance(visits.schema["item"].dataType, _INTEGERS)


def baskets(visits: DataFrame, mark: DataFrame | None = None) -> DataFrame:
    """``(items, own)`` of each user, staged: distinct items and, beside each, its number of users; 0 for items of ``mark``.

    One exchange by item, where repeats go and users are counted, and one by user.
    """
    once = visits.select("user", F.col("item").cast("long").alias("item")).where("user is not null and item is not null")
    once = once.repartition("item").groupBy("item", "user").agg(F.lit(1).alias("one"))
    counted = once.select("user", "item", F.count("*").over(Window.partitionBy("item")).alias("own"))
    if mark is not None:
        marked = mark.select(F.col("item").cast("long").alias("item")).distinct().withColumn("marked", F.lit(True))
        counted = counted.join(marked, "item", "left").select("user", "item", F.when(F.col("marked"), 0).otherwise(F.col("own")).alias("own"))
    each = counted.groupBy("user").agg(F.collect_list(F.struct("item", "own")).alias("b"))
    return stage(each.select(F.col("b.item").alias("items"), F.col("b.own").alias("own"), F.size("b").alias("n")), "baskets")


def _block(items: np.ndarray, blocks: int) -> np.ndarray:
    x = items.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


def _width(most: np.ndarray) -> np.ndarray:
    """Bytes that hold each unsigned number: 1, 2, 4 or 8."""
    return np.select([most < 1 << 8, most < 1 << 16, most < 1 << 32], [1, 2, 4], 8)


def _unnested(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _packer(blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each basket as the steps between its sorted items, in as few bytes as hold them, once for each block it has an item in."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sizes = _unnested(batch.column("items"))
            own, _ = _unnested(batch.column("own"))
            if not len(items):
                continue
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((items, row))
            items, own = items[order], own[order].astype(np.uint64)
            start = np.cumsum(sizes) - sizes
            steps = np.diff(items.view(np.uint64), prepend=np.uint64(0))
            steps[start] = 0
            wide, counts = _width(np.maximum.reduceat(steps, start)), _width(np.maximum.reduceat(own, start))
            at = np.unique(row * blocks + _block(items, blocks))
            for w in np.unique(wide):
                for c in np.unique(counts):
                    rows = np.flatnonzero((wide == w) & (counts == c))
                    if not len(rows):
                        continue
                    taken = ((wide == w) & (counts == c))[row]
                    ends = np.concatenate([[0], np.cumsum(sizes[rows])])

                    def binary(values: np.ndarray, width: int, ends=ends) -> pa.Array:
                        data = values.astype(f"<u{width}")
                        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * width).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())

                    place = np.full(len(sizes), -1)
                    place[rows] = np.arange(len(rows))
                    mine = at[place[at // blocks] >= 0]
                    which = pa.array(place[mine // blocks])
                    out = [pa.array(mine % blocks, pa.int32()), pa.array(np.full(len(mine), w), pa.int32()), pa.array(np.full(len(mine), c), pa.int32()), pa.array(items[start[rows]]).take(which), binary(steps[taken], w).take(which), binary(own[taken], c).take(which)]
                    whole = pa.RecordBatch.from_arrays(out, names=["block", "w", "c", "base", "steps", "own"])
                    yield from (whole.slice(i, OUT_ROWS) for i in range(0, whole.num_rows, OUT_ROWS))

    return pack


def _bytes(column: pa.BinaryArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(f"<u{width}") if len(data) % width == 0 and data.ctypes.data % width == 0 else np.frombuffer(data.tobytes(), f"<u{width}"), np.diff(offsets) // width


class _Row:
    """Numbers that are appended, in the least type that holds them; room is asked for once, and memory is taken as it fills."""

    def __init__(self, kind: type, room: int) -> None:
        self.all, self.n = np.empty(max(room, 1024), kind), 0

    def add(self, values: np.ndarray) -> None:
        kind = np.promote_types(self.all.dtype, values.dtype)
        if kind != self.all.dtype or self.n + len(values) > len(self.all):
            grown = np.empty(max(len(self.all), 2 * (self.n + len(values)) if self.n + len(values) > len(self.all) else 0), kind)
            grown[: self.n] = self.all[: self.n]
            self.all = grown
        self.all[self.n : self.n + len(values)] = values
        self.n += len(values)

    def values(self) -> np.ndarray:
        return self.all[: self.n]


class _Held:
    """The baskets of one block, of about ``room`` elements."""

    def __init__(self, room: int) -> None:
        self.items, self.own, self.sizes = _Row(np.int32, room), _Row(np.uint8, room), _Row(np.int32, 1024)

    def add(self, rows: pa.RecordBatch) -> None:
        w, c = rows.column("w").to_numpy(), rows.column("c").to_numpy()
        for kind in np.unique(w * 16 + c):
            some = rows.filter(pa.array(w * 16 + c == kind))
            steps, sizes = _bytes(some.column("steps"), int(kind) // 16)
            start = np.cumsum(sizes) - sizes
            run = np.cumsum(steps, dtype=np.uint64)
            first = some.column("base").to_numpy().view(np.uint64) - run[start]
            items = (run + np.repeat(first, sizes)).view(np.int64)
            small = -(1 << 31) <= items.min() and items.max() < 1 << 31
            own, _ = _bytes(some.column("own"), int(kind) % 16)
            self.items.add(items.astype(np.int32) if small else items)
            self.own.add(own)
            self.sizes.add(sizes.astype(np.int32))

    def pairs(self, block: int, blocks: int, chunk: int) -> Iterator[tuple[np.ndarray, ...]]:
        """``(item_i, item_j, freq, own_i, own_j)`` by item_i and item_j; all pairs of an item come together."""
        items, own, sizes = self.items.values(), self.own.values(), self.sizes.values().astype(np.int64)
        start = np.cumsum(sizes) - sizes
        piece = 1 << 19
        heads = np.concatenate([np.flatnonzero(_block(items[i : i + piece], blocks) == block) + i for i in range(0, len(items), piece)])
        heads = heads[np.argsort(items[heads], kind="stable")]
        basket = np.searchsorted(start, heads, "right") - 1
        begins = np.flatnonzero(np.diff(items[heads], prepend=items[heads[0]] - 1)) if len(heads) else np.zeros(0, int)
        work = np.concatenate([[0], np.cumsum(sizes[basket])])
        low, bits = int(items.min()), int(items.max()) - int(items.min())
        shift = int(own.max()).bit_length()

        def counted(lo: int, hi: int, code: np.ndarray) -> tuple[np.ndarray, ...]:
            n = sizes[basket[lo:hi]]
            at = np.repeat(start[basket[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            head, met = np.repeat(code, n), items[at].astype(np.int64)
            span = bits + 1
            if (len(begins) + 1) * span << shift < 1 << 63:
                key = np.sort(((head * span + (met - low)) << shift) | own[at].astype(np.int64))
                first = np.flatnonzero(np.diff(key >> shift, prepend=-1))
                freq, key = np.diff(first, append=len(key)), key[first]
                pair = key >> shift
                return pair // span, pair % span + low, freq, key & ((1 << shift) - 1)
            kinds, where, code_of = np.unique(met, return_index=True, return_inverse=True)
            pair, freq = np.unique(head * len(kinds) + code_of, return_counts=True)
            return pair // len(kinds), kinds[pair % len(kinds)], freq, own[at][where][pair % len(kinds)].astype(np.int64)

        ends = np.append(begins[1:], len(heads))
        done = work[ends]
        h = 0
        while h < len(begins):
            last = max(h + 1, int(np.searchsorted(done, work[begins[h]] + chunk, "right")))
            lo, hi = int(begins[h]), int(ends[last - 1])
            code = np.repeat(np.arange(last - h), ends[h:last] - begins[h:last])
            if work[hi] - work[lo] <= 2 * chunk:
                c, j, freq, own_j = counted(lo, hi, code)
            else:  # one item of very many baskets
                parts, cut = [], lo
                while cut < hi:
                    to = max(cut + 1, min(hi, int(np.searchsorted(work, work[cut] + chunk, "right")) - 1))
                    parts.append(counted(cut, to, np.zeros(to - cut, np.int64)))
                    cut = to
                    if len(parts) > 8 or cut == hi:
                        j, where, inverse = np.unique(np.concatenate([p[1] for p in parts]), return_index=True, return_inverse=True)
                        freq = np.zeros(len(j), np.int64)
                        np.add.at(freq, inverse, np.concatenate([p[2] for p in parts]))
                        parts = [(np.zeros(len(j), np.int64), j, freq, np.concatenate([p[3] for p in parts])[where])]
                c, j, freq, own_j = parts[0]
            at = heads[begins[h:last]]
            yield items[at].astype(np.int64)[c], j, freq, own[at].astype(np.int64)[c], own_j
            h = last


def pairs_by_item(packed: DataFrame, finish: Callable[..., dict[str, np.ndarray]] | None = None, schema: str = PAIRS) -> DataFrame:
    """Pairs of all items that share a user, each item with itself too, as ``finish`` makes them of ``(item_i, item_j, freq, own_i, own_j)``.

    ``packed`` are :func:`baskets`. As many blocks are taken as keep a block's baskets below :data:`BLOCK_ELEMENTS`.
    """
    blocks = LEAST_BLOCKS

    def held_by_one() -> int:
        return int((packed.agg(F.sum(F.col("n").cast("double") * F.least("n", F.lit(blocks)))).first()[0] or 0) / blocks)

    while (room := held_by_one()) > BLOCK_ELEMENTS and blocks < 1 << 24:
        blocks *= 2
    room += room // 8
    chunk = CHUNK_PAIRS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(held: _Held, block: int) -> Iterator[pa.RecordBatch]:
            for found in held.pairs(block, blocks, chunk):
                made = finish(*found) if finish else dict(zip(("item_i", "item_j", "freq", "own_i", "own_j"), found))
                n = len(made["item_i"])
                for i in range(0, n, OUT_ROWS):
                    yield pa.RecordBatch.from_pydict({k: pa.array(v[i : i + OUT_ROWS]) for k, v in made.items()})

        pa.default_memory_pool().release_unused()
        at, held = None, _Held(room)
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if at is not None and block[lo] != at:
                    yield from ended(held, at)
                    held = _Held(room)
                at = int(block[lo])
                held.add(batch.slice(lo, hi - lo))
        if at is not None:
            yield from ended(held, at)

    moved = packed.select("items", "own").mapInArrow(_packer(blocks), "block int, w int, c int, base long, steps binary, own binary")
    return moved.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(count, schema)


def best(item: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` highest scores of each item, ties by ``other``, and their ranks; ``item`` comes in runs."""
    if not len(item):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    begins = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    size = np.diff(begins, append=len(item))
    run = np.repeat(np.arange(len(begins)), size)
    # Which could be among them, by one sort of numbers that hold run and score roughly; the rest is exact.
    rough = run - score / (2 * max(float(score.max()), 1e-300))
    floor = np.sort(rough)[begins + np.minimum(size, k) - 1]
    kept = np.flatnonzero(rough <= floor[run] + 1e-9)
    kept = kept[np.lexsort((other[kept], -score[kept], run[kept]))]
    first = np.flatnonzero(np.diff(run[kept], prepend=-1))
    rank = np.arange(len(kept)) - np.repeat(first, np.diff(first, append=len(kept))) + 1
    return kept[rank <= k], rank[rank <= k].astype(np.int32)
