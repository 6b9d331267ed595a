"""Translation model 1 by expectation maximisation, with each source term's pairs in one place.

A source's expectations need its own probabilities only; what sources share is one total a target term. So sentence pairs move once, to the
blocks of their sources, and a round moves the totals alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import stage, unstage

#: Most target terms, whose totals the driver and every task hold.
MOST_TARGETS = 1 << 20
#: Co-occurrences of a block, and rounds between two stagings of the counts.
BLOCK_PAIRS = 1_000_000
LEAST_BLOCKS = 12
ROUNDS_STAGED = 5
OUT_ROWS = 65_536
_STATE = "block int, words array<string>, source binary, target binary, at binary, sizes binary, counts binary"


def by_source(sentences: DataFrame) -> DataFrame:
    """``(x, y)`` of sentence pairs ``(pair_id, x, y)``; parts of one ``pair_id`` are brought together source by source, as they share its sum."""
    parts = sentences.select("pair_id", "x", "y").where("size(x) > 0 and size(y) > 0").groupBy("pair_id").agg(F.collect_list(F.struct("x", "y")).alias("p"))
    whole = F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    merged = F.transform(F.array_distinct(F.flatten("p.x")), lambda s: F.struct(F.array(s).alias("x"), F.flatten(F.transform(F.filter("p", lambda p: F.array_contains(p["x"], s)), lambda p: p["y"])).alias("y")))
    return parts.select(F.inline(F.when(F.size("p") == 1, whole).otherwise(merged)))


def targets_of(texts: DataFrame) -> pa.Array | None:
    """The target terms of ``(x, y)``, or nothing if they are more than :data:`MOST_TARGETS`."""
    found = texts.select(F.explode("y").alias("term")).distinct().limit(MOST_TARGETS + 1).toArrow()["term"].combine_chunks()
    return found if len(found) <= MOST_TARGETS else None


def _numbers(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _packer(targets: pa.Array, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A sentence pair as the numbers of its targets, once for each block that holds one of its sources."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, block = (batch.column(c) for c in ("x", "y", "b"))
            target = pc.index_in(y.flatten(), targets).to_numpy().astype(np.int32)
            ends = np.cumsum(np.diff(y.offsets.to_numpy()))
            words = x.flatten()
            row = np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy()))
            key = row * blocks + block.flatten().to_numpy()
            order = np.argsort(key, kind="stable")
            cuts = np.concatenate([np.flatnonzero(np.diff(key[order], prepend=-1)), [len(key)]]).astype(np.int32)
            of = key[order][cuts[:-1]]
            rows = of // blocks
            sent = [_numbers(target[(ends[r - 1] if r else 0) : ends[r]], "<i4") for r in range(len(ends))]
            out = pa.RecordBatch.from_arrays([pa.array(of % blocks, pa.int32()), pa.ListArray.from_arrays(pa.array(cuts), words.take(pa.array(order))), pa.array(sent, pa.binary()).take(pa.array(rows))], names=["block", "x", "y"])
            yield from (out.slice(i, 1024) for i in range(0, out.num_rows, 1024))

    return pack


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The co-occurrences of a block: where each stands among its distinct pairs, and the number of each sentence pair's and source's."""

    def ended(block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        words = pa.concat_arrays([p.column("x").flatten() for p in parts])
        names = pc.unique(words)
        source = pc.index_in(words, names).to_numpy().astype(np.int64)
        many = np.concatenate([np.diff(p.column("x").offsets.to_numpy()) for p in parts])
        texts = [np.frombuffer(v, "<i4") for p in parts for v in p.column("y").to_pylist()]
        length = np.array([len(t) for t in texts])
        width = int(max(t.max() for t in texts)) + 1
        sizes = np.repeat(length, many)
        key = np.repeat(source * width, sizes)
        key += np.concatenate([np.tile(t, n) for t, n in zip(texts, many)])
        pairs, at = np.unique(key, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([names.to_pylist()], pa.list_(pa.string())), *[pa.array([v], pa.binary()) for v in (_numbers(pairs // width, "<i4"), _numbers(pairs % width, "<i4"), _numbers(at, "<i4"), _numbers(sizes, "<i4"), _numbers(np.ones(len(pairs)), "<f8"))]], names=[c.split()[0] for c in _STATE.split(", ")])

    at, held = None, []
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if at not in (None, int(block[lo])):
                yield ended(at, held)
                held = []
            at = int(block[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield ended(at, held)


def _rounds(batch: pa.RecordBatch, i: int, since: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sources, targets and expected counts of a block's pairs after as many rounds as there are totals in ``since``."""
    source, target, at, sizes = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i4") for c in ("source", "target", "at", "sizes"))
    counts = np.frombuffer(batch.column("counts")[i].as_buffer(), "<f8")
    starts = np.cumsum(sizes) - sizes
    for totals in since:
        share = (counts / totals[target])[at]
        share /= np.repeat(np.add.reduceat(share, starts), sizes)
        counts = np.bincount(at, share, len(target))
    return source, target, counts


def _totals(state: DataFrame, since: list[np.ndarray], n: int) -> np.ndarray:
    """Counts after those rounds by target, summed over blocks by a task for each core, a few more and the driver."""

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part = np.zeros(n), 0
        for batch in batches:
            for i in range(batch.num_rows):
                _, target, counts = _rounds(batch, i, since)
                out += np.bincount(target, counts, n)
                part = batch.column("block")[i].as_py() % 4
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "totals": pa.array([_numbers(out, "<f8")], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(n)
        for batch in batches:
            for v in batch.column("totals"):
                out += np.frombuffer(v.as_buffer(), "<f8")
        yield pa.RecordBatch.from_pydict({"totals": pa.array([_numbers(out, "<f8")], pa.binary())})

    rows = state.coalesce(state.sparkSession.sparkContext.defaultParallelism).mapInArrow(of_blocks, "part int, totals binary").repartition(4, "part").mapInArrow(added, "totals binary").collect()
    return np.sum([np.frombuffer(r["totals"], "<f8") for r in rows], axis=0)


def model1(texts: DataFrame, targets: pa.Array, iterations: int) -> DataFrame:
    """``(source, target, p)`` after ``iterations`` rounds (one at least) over ``(x, y)`` of :func:`by_source`, from equal probabilities."""
    n = len(targets)
    met = texts.agg(F.sum(F.size("x").cast("long") * F.size("y"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-met // BLOCK_PAIRS))
    dealt = texts.select("x", "y", F.transform("x", lambda s: F.pmod(F.xxhash64(s), F.lit(blocks)).cast("int")).alias("b"))
    moved = dealt.mapInArrow(_packer(targets, blocks), "block int, x array<string>, y binary")
    state = stage(moved.repartitionById(blocks, F.col("block")).sortWithinPartitions("block").mapInArrow(_built, _STATE), "translation")
    since = [np.ones(n)]
    for k in range(1, iterations):
        if len(since) == ROUNDS_STAGED:
            before, state = state, stage(_advanced(state, since), "translation")
            unstage(before)
            since = []
        since.append(_totals(state, since, n))
    last = _totals(state, since, n)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                source, target, counts = _rounds(batch, i, since)
                words = batch.column("words")[i].values
                for k in range(0, len(source), OUT_ROWS):
                    s, t = source[k : k + OUT_ROWS], target[k : k + OUT_ROWS]
                    yield pa.RecordBatch.from_pydict({"source": words.take(pa.array(s)), "target": targets.take(pa.array(t)), "p": pa.array(counts[k : k + OUT_ROWS] / last[t])})

    return state.mapInArrow(written, "source string, target string, p double")


def _advanced(state: DataFrame, since: list[np.ndarray]) -> DataFrame:
    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = pa.array([_numbers(_rounds(batch, i, since)[2], "<f8")], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:-1], counts], names=batch.schema.names)

    return state.mapInArrow(advance, _STATE)
