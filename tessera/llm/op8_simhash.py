"""SimHash near-duplicates, found with BK-trees over shards of fingerprints.

Fingerprints that differ in at most ``radius`` bits agree on some choice of
``blocks - radius`` of ``blocks`` bit blocks, so a shard is one such choice and its
bits: every link lies inside a shard. Each shard builds a BK-tree (children keyed by
their integer Hamming distance to the parent) in the task that holds it, and every
member follows only the edges that the triangle inequality leaves within the radius.
A shard reports a star for each local component, not all of its pairs. Trees are built where
their shard lies and not broadcast, since all trees together are as large as the table.
A crowded shard is split by the bits that vary most inside it, or, where none tell its members
apart, dealt into tiles of bounded size that hold every two of its members together once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.workers import trimmed
from tessera.plans.components import connected_components
from tessera.plans.staging import stage

#: A shard with more members is split again before a tree is built.
SHARD_ROWS = 8192
#: Shards that this many parts cover are dealt into tiles at once.
_FEW_PARTS = 4
_FRONTIER = 1 << 20


def shingle_hashes(raw: bytes, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of ``raw`` (UTF-8), A-Z lower-cased, repeats included; a shorter text is one shingle, one without words has none."""
    words = raw.lower().split()
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(line, seed)] if words else []
    else:
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        hashes = [digest(line[s : e - 1], seed) for s, e in zip(starts, starts[shingle:])]
    return np.array(hashes, dtype=np.uint64)


def simhash64(raw: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit majority fingerprint of the word shingles of ``raw`` (UTF-8), A-Z lower-cased; 0 without words."""
    return majority(shingle_hashes(raw, shingle, seed))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of ``hashes`` have; 0 without any."""
    values = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), 1 << 15):
        ones += np.unpackbits(values[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, fp)`` for every row: ``fp`` is the fingerprint's 64 bits as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            out = np.fromiter((simhash64(t.as_py() or b"", shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["id", "fp"])

    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return ids.mapInArrow(trimmed(run), "id long, fp long")


def bk_forest(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One BK-tree for each run of equal ``shard`` values, all grown level by level.

    Returns each member's root and the children's table: sorted keys
    ``parent * 65 + distance`` and the child each leads to. ``fp`` is distinct within a shard.
    """
    first = np.r_[True, shard[1:] != shard[:-1]]
    root = np.maximum.accumulate(np.where(first, np.arange(len(fp)), 0))
    keys, kids = [], []
    waiting, at = np.flatnonzero(~first), root[~first]
    while len(waiting):
        key = at * 65 + np.bitwise_count(fp[waiting] ^ fp[at]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, waiting = key[order], waiting[order]
        new = np.r_[True, key[1:] != key[:-1]]
        keys.append(key[new])
        kids.append(waiting[new])
        child = waiting[new][np.cumsum(new) - 1]
        waiting, at = waiting[~new], child[~new]
    if not keys:
        return root, np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, kid = np.concatenate(keys), np.concatenate(kids)
    order = np.argsort(key)
    return root, key[order], kid[order]


def bk_links(root: np.ndarray, key: np.ndarray, kid: np.ndarray, fp: np.ndarray, radius: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(query, earlier member)`` within ``radius``, following only edges in ``[d - radius, d + radius]``."""
    q, node, found = queries, root[queries], []
    while len(q):
        d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
        hit = (d <= radius) & (node < q)
        found.append((q[hit], node[hit]))
        lo = np.searchsorted(key, node * 65 + np.maximum(d - radius, 0), "left")
        n = np.searchsorted(key, node * 65 + np.minimum(d + radius, 64), "right") - lo
        q = np.repeat(q, n)
        node = kid[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(q))]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of linked members; labels are the smallest member of a class."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def shard_stars(shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what each shard finds connected: ``(member, smallest member of its local component)``."""
    root, key, kid = bk_forest(shard, fp)
    label = np.arange(len(fp))
    size = np.bincount(root, minlength=len(fp))[root]
    cuts = np.searchsorted(np.cumsum(size), np.arange(_FRONTIER, int(size.sum()) + _FRONTIER, _FRONTIER), "right")
    begin = 0
    for end in np.unique(np.r_[cuts, len(fp)]):
        if end > begin:
            label = _merge(label, *bk_links(root, key, kid, fp, radius, np.arange(begin, end)))
            begin = end
    moved = label != np.arange(len(fp))
    return fp[moved], fp[label[moved]]


def _masks(bits: list[int], radius: int, blocks: int) -> list[int]:
    """Masks over ``bits``: one for each choice of ``blocks - radius`` of ``blocks`` even blocks."""
    edges = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in bits[s:e]) for s, e in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _block_count(distinct: int, radius: int) -> int:
    """Blocks that leave about 64 fingerprints to a shard if they are spread evenly."""
    for blocks in range(radius + 1, 2 * radius + 3):
        if distinct >> (64 * (blocks - radius) // blocks) <= 64:
            return blocks
    return 2 * radius + 2


def _plan(count: int, ones: list[int], radius: int, shard_rows: int) -> tuple[int, list[int]]:
    """How a shard of ``count`` fingerprints, ``ones`` of which have each bit set, is split: parts of tiles, or masks (parts 0).

    The bits that vary are dealt, most even first, to ``radius + 1`` blocks; members within the radius agree on one of
    them. That is worth it if fewer pairs then meet in all blocks together; else every two of ``parts`` form a tile.
    """
    parts = -(-2 * count // shard_rows)
    vary = sorted((b for b in range(64) if 0 < ones[b] < count), key=lambda b: (abs(2 * ones[b] - count), b))
    if parts > _FEW_PARTS and len(vary) > radius:
        blocks = [vary[i :: radius + 1] for i in range(radius + 1)]
        alike = [1 - 2 * (n / count) * (1 - n / count) for n in ones]
        if sum(float(np.prod([alike[b] for b in block])) for block in blocks) < 0.7:
            return 0, [_signed(sum(1 << b for b in block)) for block in blocks]
    return parts, []


def shards(classes: DataFrame, radius: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(s, fp)``: fingerprints by shard, so that any two within ``radius`` bits share a shard and none has much more than ``shard_rows`` members."""
    masks = _masks(list(range(64)), radius, _block_count(classes.count(), radius))
    held = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "bits"))
    held = held.select(F.xxhash64("t", "bits").alias("s"), "fp")
    done: list[DataFrame] = []
    level = 0
    while True:
        crowded = stage(held.groupBy("s").count().where(F.col("count") > shard_rows), "crowded")
        if crowded.isEmpty():
            return reduce(DataFrame.unionByName, [*done, held])
        done.append(held.join(crowded, "s", "left_anti"))
        level += 1
        full = stage(held.join(crowded, "s", "left_semi"), "crowded-rows")
        ones = F.array(*[F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1))) for b in range(64)])
        stats = full.groupBy("s").agg(F.count("*").alias("n"), ones.alias("ones"))

        def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [_plan(n, o, radius, shard_rows) for n, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in found], pa.int32()), pa.array([m for _, m in found], pa.list_(pa.int64()))], ["s", "parts", "masks"])

        plan = stage(stats.mapInArrow(planned, "s long, parts int, masks array<long>"), "crowded-plan")
        split = full.join(plan, "s")
        # Of two parts' tile, every member is in as many tiles as there are other parts.
        own = F.pmod(F.xxhash64(F.lit(level), "fp"), F.col("parts")).cast("int")
        tiled = split.where("parts > 0").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("own <> other")
        done.append(tiled.select(F.xxhash64("s", F.lit(level), F.least("own", "other"), F.greatest("own", "other")).alias("s"), "fp"))
        again = split.where("parts = 0").select("s", "fp", F.posexplode("masks").alias("u", "mask"))
        held = again.select(F.xxhash64("s", F.lit(level), "u", F.col("fp").bitwiseAND(F.col("mask"))).alias("s"), "fp")


def links(classes: DataFrame, radius: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that connect all within ``radius`` bits of each other.

    Rows outside need no link: two fingerprints get one, or a chain of them, if and only
    if a chain of steps of at most ``radius`` bits joins them.
    """
    rows = shards(classes, radius, shard_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(s: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            fresh = np.r_[True, (s[1:] != s[:-1]) | (fp[1:] != fp[:-1])]
            a, b = shard_stars(s[fresh], fp[fresh].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            s, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cut = int(np.searchsorted(s, s[-1], "left")) if len(s) else 0
            if cut or (kept and len(s) and kept[-1][0][-1] != s[-1]):
                kept.append((s[:cut], fp[:cut]))
                yield stars(*(np.concatenate(x) for x in zip(*kept)))
                kept = []
            kept.append((s[cut:], fp[cut:]))
        if sum(len(x) for x, _ in kept):
            yield stars(*(np.concatenate(x) for x in zip(*kept)))

    return rows.repartition("s").sortWithinPartitions("s", "fp").mapInArrow(trimmed(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Equal fingerprints are folded into one class before any tree is built, so a group of
    copies costs one member. Null and word-less texts have fingerprint zero and link like
    any other. ``component_id`` is the smallest non-null id reachable; it is null where no
    row of the component has an id. Repeated rows are all returned. Texts are read whole, however
    long; a text is held by the task that reads it. Other columns of
    ``docs`` are ignored. An empty table gives no rows.
    """
    seen = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stage(seen.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    roots = connected_components(links(classes, radius, shard_rows), "a", "b")
    grouped = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = grouped.join(lowest, "root").select("fp", "component_id")
    return seen.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
