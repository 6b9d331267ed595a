"""Nearest vectors among those that pass a test of their codes, found by products of blocks: no row is made for a pair.

Vectors and queries are dealt into blocks and meet once. In a task, products in single precision, with a bound on their error, leave the
few pairs that may be among the nearest; only of those are codes compared and distances taken, in double precision and in the order of the dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import stage

VECTORS, QUERIES = 200_000, 65_536
_QUERY_CHUNK, _VECTOR_CHUNK = 256, 16_384
#: Components up to this size keep single precision from overflowing.
_LARGEST = 1e9
Codes = Callable[[np.ndarray], np.ndarray]
Shared = Callable[[np.ndarray, np.ndarray], np.ndarray]


def projections(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Inner products of rows with ``directions``, added in the order of the dimensions."""
    out = np.zeros((len(x), len(directions)))
    for j in range(x.shape[1]):
        out += x[:, j, None].astype(float) * directions[:, j]
    return out


def regular(vectors: DataFrame, dim: int, vector_col: str) -> bool:
    """Whether ids are there once and vectors are whole: of ``dim`` finite components, none too large."""
    x = F.col(vector_col)
    sound = F.coalesce((F.size(x) == dim) & F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < _LARGEST, F.lit(False))), F.lit(False))
    bad = vectors.groupBy("vec_id").agg(F.count("*").alias("n"), F.min(sound).alias("sound")).where("n > 1 or not sound or vec_id is null")
    return not bad.limit(1).count()


def nearest(vectors: DataFrame, queries: DataFrame, tests: list[tuple[Codes, Shared] | None], k: int, dim: int, vector_col: str = "embedding") -> DataFrame:
    """``(test, query_id, vec_id, depth, distance)``, staged: of each block the ``k`` nearest of each query that pass a test, for each of ``tests``.

    A test holds a function from vectors to rows of codes and one from two rows of codes to a depth, 0 where the pair does not
    pass; None lets all pass. Both tables must be :func:`regular`.
    """
    n, m = vectors.count(), queries.count()
    down = max(1, min(12, n // 32_768), -(-n // VECTORS))
    across = max(1, -(-m // QUERIES))
    kind = np.float32 if dict(vectors.dtypes)[vector_col] == "array<float>" else np.float64

    def dealt(rows: DataFrame, side: int) -> DataFrame:
        mine, others = (across, down) if side == 0 else (down, across)
        own = F.pmod(F.xxhash64("vec_id"), F.lit(mine)).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        cell = rows.select("vec_id", F.col(vector_col).cast("array<float>" if kind is np.float32 else "array<double>").alias("x"), own.alias("own"), other.alias("other"))
        place = F.col("other") * across + F.col("own") if side == 0 else F.col("own") * across + F.col("other")
        return cell.select(place.alias("cell"), F.lit(side).alias("side"), "vec_id", "x")

    def ended(qid: list, q: list, vid: list, v: list) -> Iterator[pa.RecordBatch]:
        if qid and vid:
            yield from _meet(np.concatenate(qid), np.concatenate(q), np.concatenate(vid), np.concatenate(v), tests, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [], [])
        for batch in batches:
            cells = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if at is not None and cells[lo] // 2 != at:
                    yield from ended(*held)
                    held = ([], [], [], [])
                at, side, some = int(cells[lo]) // 2, int(cells[lo]) % 2, batch.slice(lo, hi - lo)
                held[2 * side].append(np.array(some.column(2).to_numpy()))
                held[2 * side + 1].append(np.array(some.column(3).flatten().to_numpy(), kind).reshape(-1, dim))
        yield from ended(*held)

    rows = dealt(queries, 0).unionByName(dealt(vectors, 1)).repartition(down * across, "cell").sortWithinPartitions("cell", "side")
    return stage(rows.mapInArrow(run, "test int, query_id long, vec_id long, depth int, distance double"), "nearest")


def _meet(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, tests: list, k: int) -> Iterator[pa.RecordBatch]:
    # Equal vectors are one, with their least ids: one more than are wanted, as a query is not its own neighbour.
    order = np.argsort(vid, kind="stable")
    _, first, which = np.unique(np.ascontiguousarray(v[order]).view(f"V{v.itemsize * v.shape[1]}").ravel(), return_index=True, return_inverse=True)
    x, by = v[order][first], np.argsort(which, kind="stable")
    many = np.bincount(which)
    begin, ids = np.cumsum(many) - many, vid[order][by]
    many = np.minimum(many, k + 1)
    coded = [t and t[0](x) for t in tests]
    single, double = x.astype(np.float32), np.einsum("ij,ij->i", x.astype(float), x.astype(float))
    longest = float(np.sqrt(double.max()))
    base = double.astype(np.float32)
    for c in range(0, len(q), _QUERY_CHUNK):
        some, own = q[c : c + _QUERY_CHUNK], qid[c : c + _QUERY_CHUNK]
        asked = [t and t[0](some) for t in tests]
        norm = np.einsum("ij,ij->i", some.astype(float), some.astype(float))
        margin = 1e-5 * (np.sqrt(norm) + longest) ** 2 + 1e-8
        twice = (-2 * some.astype(np.float32)).T.copy()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)) for _ in tests]
        bound = np.full(len(some), np.inf)

        def add(row: np.ndarray, at: np.ndarray) -> None:
            apart = (some[row].astype(float) - x[at]) ** 2
            gap = np.zeros(len(row))
            for j in range(x.shape[1]):
                gap += apart[:, j]
            gap = np.sqrt(gap)
            limit = np.zeros(len(some))
            for n, test in enumerate(tests):
                depth = test[1](asked[n][row], coded[n][at]) if test else np.ones(len(row), np.int32)
                took = np.flatnonzero(depth > 0)
                n_ids = many[at[took]]
                spread = np.repeat(took, n_ids)
                member = ids[np.repeat(begin[at[took]] - (np.cumsum(n_ids) - n_ids), n_ids) + np.arange(int(n_ids.sum()))]
                spread, member = (a[member != own[row[spread]]] for a in (spread, member))
                rows, members, depths, gaps = (np.concatenate(pair) for pair in zip(best[n], (row[spread], member, depth[spread].astype(np.int32), gap[spread])))
                sort = np.lexsort((members, np.round(gaps, 9), rows))
                count = np.bincount(rows, minlength=len(some))
                rank = np.arange(len(sort)) - np.repeat(np.cumsum(count) - count, count)
                kept = sort[rank < k]
                best[n] = rows[kept], members[kept], depths[kept], gaps[kept]
                worst = np.zeros(len(some))
                np.maximum.at(worst, best[n][0], best[n][3])
                limit = np.maximum(limit, np.where(count >= k, worst, np.inf))
            # Single precision may round the bound down by less than the margin holds beyond the products' error.
            bound[:] = (limit + 1e-8) ** 2 - norm + margin

        d, step = 0, max(_VECTOR_CHUNK // 8, 1)
        while d < len(x):
            far = single[d : d + step] @ twice
            far += base[d : d + step, None]
            if d == 0 and len(far) > 8 * k:
                # A first bound from the nearest of the first rows; those are looked at again with the others.
                near = np.argpartition(far[:1024], 4 * k, axis=0)[: 4 * k]
                add(np.tile(np.arange(len(some)), 4 * k), near.ravel())
                best = [tuple(a[:0] for a in b) for b in best]
            at, row = np.divmod(np.flatnonzero(far <= bound.astype(np.float32)), len(some))
            if len(row):
                add(row, at + d)
            d, step = d + step, min(4 * step, _VECTOR_CHUNK)
        for n, (rows, members, depths, gaps) in enumerate(best):
            columns = [pa.array(np.full(len(rows), n, np.int32)), pa.array(own[rows]), pa.array(members), pa.array(depths), pa.array(gaps)]
            yield pa.RecordBatch.from_arrays(columns, ["test", "query_id", "vec_id", "depth", "distance"])
