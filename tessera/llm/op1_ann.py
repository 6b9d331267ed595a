"""Nearest neighbours by inner product, through randomly rotated one-bit codes.

A vector, less the centre of its cell, is turned by a random rotation and kept as the signs of
its coordinates (packed bits) with two correction scalars. A query, turned alike and rounded to
whole numbers, meets the codes bit plane by bit plane (and, population count); that gives an
estimate of the inner product with an error bound that holds with high probability.

1. In the cells nearest to a query the likeliest candidates are scored exactly; the k-th best
   is the query's floor.
2. Cells that cannot reach the floor, by the exact bound of their radius, are left out. In all others a
   candidate is scored on its original vector if estimate plus error bound reaches the floor.

Codes and vectors lie in one written table; only codes and scalars meet the queries, and each
pass moves a vector once at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import stage

#: Width of the error bound in standard deviations; larger reranks more and misses less.
EPSILON = 2.5
#: Candidates scored first, in multiples of k: their k-th best score is the floor for the bounds.
SEEDS = 8
#: Rows a cell on average, cells at most, and rows from which their centres are learnt at most.
CELL_ROWS = 4_096
MOST_CELLS = 256
SAMPLE_ROWS = 16_384
#: Bits of a query's coordinates.
PLANES = 7
#: Index rows (of one cell) and queries that meet in one task.
SLICE_ROWS = (4_096, 65_536)
BLOCK_QUERIES = 2_048
_INDEX = "row long, vec_id long, vector {kind}, cell int, code binary, radius double, align double, asked boolean"


def rotation(dim: int, seed: int = 3) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def usable(rows: DataFrame, id_col: str, vector_col: str, *more: Column) -> DataFrame:
    """``(vec_id, vector, *more)`` of rows with an id and a vector without nulls, NaN or infinities, and not zero."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return rows.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("vector"), *more)


def centres(sample: np.ndarray, cells: int, seed: int = 3, rounds: int = 8) -> np.ndarray:
    """``cells`` centres of ``sample`` by rounds of nearest means; fewer if it has fewer distinct rows."""
    found = np.unique(sample, axis=0)
    found = found[np.random.default_rng(seed).permutation(len(found))[:cells]]
    for _ in range(rounds if len(found) > 1 else 1):
        home = nearest_cell(sample, found)
        count = np.bincount(home, minlength=len(found))
        total = np.zeros_like(found)
        np.add.at(total, home, sample)
        found = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], found)
    return found


def nearest_cell(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre * centre).sum(axis=1) - 2 * (x @ centre.T)).argmin(axis=1)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated residuals (whole 64-bit words), and per vector its residual's length and the cosine between the residual and its code."""
    rest = x - centre
    radius = np.sqrt((rest * rest).sum(axis=1))
    unit = (rest / np.maximum(radius, 1e-300)[:, None]) @ turn.T
    align = np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])
    return words(unit > 0), radius, align


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.uint64)


def estimate(queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, codes: np.ndarray, radius: np.ndarray, align: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries (rows) with coded vectors of one cell (columns), and their error bounds."""
    dim = queries.shape[1]
    turned = queries @ turn.T
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-300)
    level = np.rint((turned - low) / step).astype(np.int64)
    held = np.zeros((len(queries), len(codes)), dtype=np.float32)
    for j in range(PLANES):
        plane = words((level >> j & 1).astype(bool))
        for w in range(codes.shape[1]):
            held += np.float32(1 << j) * np.bitwise_count(codes[None, :, w] & plane[:, None, w])
    ones = np.bitwise_count(codes).sum(axis=1).astype(np.float32)
    # Coordinates count by their sign: twice those with a set bit, less all.
    signed = 2 * (low.astype(np.float32) * ones + step.astype(np.float32) * held) - turned.sum(axis=1, keepdims=True).astype(np.float32)
    scale = (radius / np.maximum(align, 1e-6)).astype(np.float32)
    near = signed * (scale / np.float32(np.sqrt(dim))) + (queries @ centre).astype(np.float32)[:, None]
    length = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
    spread = scale * np.sqrt(np.maximum(1 - align * align, 0)).astype(np.float32) / np.float32(np.sqrt(max(dim - 1, 1)))
    return near, np.float32(epsilon) * (length.astype(np.float32) * spread + (step / np.sqrt(12)).astype(np.float32) * scale) + np.float32(1e-5)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32)), pa.array(x.ravel()))


def nearest(vectors: DataFrame, asked: Column | None = None, queries: DataFrame | None = None, k: int = 20, epsilon: float = EPSILON, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = CELL_ROWS, slice_rows: tuple[int, int] = SLICE_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score, reranked)``: the ``k`` nearest rows of ``vectors`` to each query.

    Queries are the rows of ``vectors`` for which ``asked`` holds, each of which leaves itself out, or the rows of
    ``queries``, for which all rows are candidates. Scores are exact inner products in double precision;
    ties go to the smaller id. Every row is indexed and a candidate, rows that repeat an id too; a query that
    repeats an id has its own ranks. Vectors that are null, zero, hold null or
    non-finite components, lack an id, or differ in length from most take no part. Other columns
    of any name are ignored. Cell centres are learnt from at most ``SAMPLE_ROWS`` rows, by a hash of the id. Rows of a cell
    are dealt to slices by hash, so a large cell, or a third of all rows in one vector, spreads. ``reranked`` counts the vectors
    scored for the query. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    flag = F.lit(False) if asked is None else F.coalesce(asked, F.lit(False))
    known = usable(vectors, id_col, vector_col, flag.alias("asked"))
    sizes = known.groupBy(F.size("vector").alias("dim")).count().orderBy(F.col("count").desc(), "dim").collect()
    dim, rows = (sizes[0]["dim"], sizes[0]["count"]) if sizes else (0, 0)
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, reranked long")
    known = known.where(F.size("vector") == dim)
    kind = dict(known.dtypes)["vector"]
    cells = max(1, min(MOST_CELLS, rows // cell_rows))
    share = F.lit(1_000_000) * min(1.0, SAMPLE_ROWS / max(rows, 1))
    sample = known.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share).select("vector").limit(2 * SAMPLE_ROWS).collect() if cells > 1 else []
    # One cell needs only the mean; so does a sample that happens to be empty.
    middle = [[float(m) for m in known.agg(*[F.avg(F.col("vector")[i]) for i in range(dim)]).first()]] if not sample else []
    centre = centres(np.array([r["vector"] for r in sample], dtype=np.float64), cells, seed) if sample else np.array(middle, dtype=np.float64).reshape(-1, dim)
    turn = rotation(dim, seed)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            home = nearest_cell(x, centre)
            codes, radius, align = encode(x, centre[home], turn)
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(home, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(radius), pa.array(align), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "vector", "cell", "code", "radius", "align", "asked"])

    index = stage(known.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector", "asked").mapInArrow(code, _INDEX.format(kind=kind)), "index")
    if queries is None:
        own = index.where("asked").select("row", "vec_id", "vector")
    else:
        # Rows of the index number from 0 up, these from -1 down.
        own = usable(queries, id_col, vector_col).where(F.size("vector") == dim).select((-1 - F.monotonically_increasing_id()).alias("row"), "vec_id", F.col("vector").cast(kind).alias("vector"))
    extent = {r["cell"]: (r["n"], r["most"]) for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("most")).collect()}
    count = np.array([extent.get(c, (0, 0.0))[0] for c in range(len(centre))], dtype=np.int64)
    reach = np.array([extent.get(c, (0, 0.0))[1] for c in range(len(centre))])
    held = min(slice_rows[1], max(slice_rows[0], rows // 64))
    slices = np.maximum(1, -(-count // held))
    parts = F.element_at(F.array(*[F.lit(int(n)) for n in slices] or [F.lit(1)]), F.col("cell") + 1)
    index = index.withColumn("slice", F.pmod(F.xxhash64(F.lit(seed), "row"), parts).cast("int"))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells in which each query's floor is sought: the square root of all, and so many that they hold the seeds."""
        for batch in batches:
            q = _matrix(batch.column(2), dim)
            order = np.argsort(-np.where(count, q @ centre.T, -np.inf), axis=1, kind="stable")
            before = np.cumsum(count[order], axis=1) - count[order]
            wanted = (before < SEEDS * k) | (np.arange(len(centre)) < np.sqrt(len(centre)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([o[w].tolist() for o, w in zip(order, wanted)], pa.list_(pa.int32()))], ["qrow", "qid", "q", "cells"])

    own = stage(own.mapInArrow(probes, f"qrow long, qid long, q {kind}, cells array<int>"), "queries")
    blocks = max(1, -(-own.count() // block_queries))
    own = own.withColumn("qblock", F.pmod(F.xxhash64("qrow"), F.lit(blocks)).cast("int"))
    coded = index.select("row", "cell", "slice", "code", "radius", "align", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qblock"))
    per_slice = F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)).alias("slice")

    def met(left: DataFrame, best: int) -> DataFrame:
        """``(qrow, floor, cell, slice, rows, near)``: candidates of ``left`` (qrow, q, floor, cell, slice, qblock) that may reach the floor; the ``best`` likeliest in a slice at most, with their estimates, if that is not 0."""

        def meet(qs: pa.Table, xs: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if qs.num_rows and xs.num_rows:
                cell, part = xs["cell"][0].as_py(), xs["slice"][0].as_py()
                ids, radius, align = (xs[c].to_numpy() for c in ("row", "radius", "align"))
                codes = np.frombuffer(b"".join(xs["code"].to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
                qrow, floor, q = qs["qrow"].to_numpy(), qs["floor"].to_numpy(), _matrix(qs["q"], dim)
                some = max(1, (1 << 21) // len(ids))
                for s in range(0, len(qrow), some):
                    near, bound = estimate(q[s : s + some], centre[cell], turn, codes, radius, align, epsilon)
                    for i in range(len(near)):
                        at = np.flatnonzero((near[i] + bound[i] >= floor[s + i]) & (ids != qrow[s + i]))
                        if best and len(at) > best:
                            at = at[np.argpartition(-near[i][at], best - 1)[:best]]
                        if len(at):
                            out.append((int(qrow[s + i]), float(floor[s + i]), cell, part, ids[at], near[i][at].astype(np.float64) if best else []))
            kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()))
            return pa.table({n: pa.array([o[j] for o in out], t) for j, (n, t) in enumerate(zip(("qrow", "floor", "cell", "slice", "rows", "near"), kinds))})

        by = ("cell", "slice", "qblock")
        return left.groupBy(*by).cogroup(coded.groupBy(*by)).applyInArrow(meet, "qrow long, floor double, cell int, slice int, rows array<long>, near array<double>")

    def scored(wanted: DataFrame) -> DataFrame:
        """``(qrow, qid, row, vec_id, score, n)``: of ``wanted`` (qrow, floor, cell, slice, rows) those that reach the floor by their vectors, the ``k`` best of each slice.

        A row without ``row`` says how many were scored in the slice.
        """

        def score(qs: pa.Table, xs: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if qs.num_rows and xs.num_rows:
                ids = xs["row"].to_numpy()
                order = np.argsort(ids)
                ids, named, x = ids[order], xs["vec_id"].to_numpy()[order], _matrix(xs["vector"], dim)[order]
                for qrow, qid, floor, q, rows_ in zip(qs["qrow"].to_pylist(), qs["qid"].to_pylist(), qs["floor"].to_pylist(), _matrix(qs["q"], dim), qs["rows"]):
                    at = np.searchsorted(ids, np.array(rows_.values))
                    exact = (x[at] * q).sum(axis=1)
                    n = len(at)
                    at, exact = at[exact >= floor], exact[exact >= floor]
                    top = np.lexsort((named[at], -exact))[:k]
                    out.append((qrow, qid, None, None, None, n))
                    out += zip([qrow] * len(top), [qid] * len(top), ids[at[top]].tolist(), named[at[top]].tolist(), exact[top].tolist(), [0] * len(top))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            return pa.table({n: pa.array([o[j] for o in out], t) for j, (n, t) in enumerate(zip(("qrow", "qid", "row", "vec_id", "score", "n"), kinds))})

        left = wanted.join(own.select("qrow", "qid", "q"), "qrow")
        right = index.select("row", "vec_id", "vector", "cell", "slice")
        return left.groupBy("cell", "slice").cogroup(right.groupBy("cell", "slice")).applyInArrow(score, "qrow long, qid long, row long, vec_id long, score double, n long")

    # First pass: the likeliest of the nearest cells, scored.
    first = own.select("qrow", "q", "qblock", F.lit(float("-inf")).alias("floor"), F.explode("cells").alias("cell")).select("*", per_slice)
    likely = met(first, SEEDS * k).select("qrow", "floor", "cell", "slice", F.inline(F.arrays_zip("rows", "near")))
    order = F.row_number().over(Window.partitionBy("qrow").orderBy(F.col("near").desc(), "rows"))
    seeds = likely.withColumn("r", order).where(F.col("r") <= SEEDS * k).groupBy("qrow", "floor", "cell", "slice").agg(F.collect_list("rows").alias("rows"))
    seeded = stage(scored(seeds), "seeded")
    place = F.row_number().over(Window.partitionBy("qrow").orderBy(F.col("score").desc(), "vec_id", "row"))
    floors = seeded.where("row is not null").withColumn("r", place).where(F.col("r") == k).select("qrow", F.col("score").alias("floor"))

    def open_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, floor = _matrix(batch.column(1), dim), batch.column(3).to_numpy(zero_copy_only=False)
            most = q @ centre.T + np.sqrt((q * q).sum(axis=1))[:, None] * reach
            may = (most * (1 + 1e-9) + 1e-9 >= floor[:, None]) & (count > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([np.flatnonzero(m).tolist() for m in may], pa.list_(pa.int32()))], ["qrow", "q", "qblock", "floor", "cells"])

    second = own.join(floors, "qrow", "left").select("qrow", "q", "qblock", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    second = second.mapInArrow(open_cells, f"qrow long, q {kind}, qblock int, floor double, cells array<int>")
    second = second.select("qrow", "q", "qblock", "floor", F.explode("cells").alias("cell")).select("*", per_slice)
    found = stage(seeded.unionByName(scored(met(second, 0).select("qrow", "floor", "cell", "slice", "rows"))), "scored")
    effort = found.groupBy("qrow").agg(F.sum("n").alias("reranked"))
    # A vector may have been scored in both passes.
    ranked = found.where("row is not null").groupBy("qrow", "qid", "row", "vec_id", "score").agg(F.count("*")).withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.join(effort, "qrow").select(F.col("qid").alias("query_id"), "rank", "vec_id", "score", "reranked")


def search_embeddings(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest of all ``embeddings`` to each whose ``vec_id`` is divisible by 20."""
    return nearest(embeddings, F.col("vec_id") % 20 == 0)
