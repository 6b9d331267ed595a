"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by hash into blocks of about as many words. A source's
blocks, in a permuted order that is repeated as often as its target asks, give its quota:
the number of blocks that reach the target, the last of them cut at a document. The quotas
are split among the output shards by a tree of multivariate hypergeometric draws; every
shard draws its count of each source from that source's permuted blocks, disjoint by
construction, and takes just the documents of the blocks it drew, in a hashed order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.hypergeometric import splitting_tree
from tessera.plans.staging import stage

#: Weights by source in code-point order, repeating; null last.
WEIGHTS = (3, 1, 2)
#: Words of a block, the unit that the tree deals out. A source has blocks enough for each
#: shard, or one a document, if it is smaller than that.
BLOCK_WORDS = 20_000
BLOCKS_A_SHARD = 4
#: Blocks of a hashed range of a source, the unit of the running sums.
RANGE_BLOCKS = 4_000


def word_count(text) -> F.Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Targets that share ``share`` of all sizes by weight; none above ``cap`` times its size, the excess reshared."""
    targets, open_ = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    left = share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= cap * sizes[i]]
        for i in full or open_:
            targets[i] = min(unit * weights[i], cap * sizes[i])
        if not full:
            break
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def _running(rows: DataFrame, value: Column, hashed: Column, ranges: Column) -> DataFrame:
    """``rows`` (sid, ...) with ``before``: the sum of ``value`` over its source's rows that come earlier by ``turn``, then hash.

    Sums run inside hashed ranges and over the ranges' totals, so no task holds a source.
    """
    marked = rows.withColumn("h", hashed).withColumn("range", F.pmod(F.shiftrightunsigned("h", 1), ranges)).withColumn("v", value)
    part = ["sid", "turn", "range"]
    totals = marked.groupBy(*part).agg(F.sum("v").alias("s"))
    earlier = Window.partitionBy("sid").orderBy("turn", "range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*part, F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"))
    inner = F.sum("v").over(Window.partitionBy(*part).orderBy("h", "block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("v")
    return marked.withColumn("inner", inner).join(base, part).withColumn("before", F.col("base") + F.col("inner")).drop("h", "range", "v", "inner", "base")


def draw(blocks: DataFrame, targets: DataFrame, sources: int, shards: int, seed: int, cap: float) -> DataFrame:
    """``(sid, block, turn, shard, cut)``: the blocks that the shards draw; ``cut`` is how many words of it are wanted where a block is the last.

    ``blocks`` has ``sid, block, words``; ``targets`` has ``sid, target, ranges``. A block takes part once in each
    turn, and a turn is used up before the next begins. Reruns agree.
    """
    spark = blocks.sparkSession
    turns = F.explode(F.sequence(F.lit(0), F.lit(int(np.ceil(cap)) - 1))).alias("turn")
    every = blocks.join(targets, "sid").select("*", turns)
    placed = _running(every, F.col("words"), F.xxhash64(F.lit(seed + 1), "sid", "block", "turn"), F.col("ranges"))
    wanted = placed.where((F.col("before") < F.col("target")) & (F.col("words") > 0))
    cut = F.when(F.col("before") + F.col("words") > F.col("target"), F.col("target") - F.col("before"))
    wanted = stage(wanted.select("sid", "block", "turn", "ranges", cut.alias("cut")), "mix-wanted")

    quotas = {r["sid"]: r["count"] for r in wanted.groupBy("sid").count().collect()}
    counts = [quotas.get(i, 0) for i in range(sources)]
    capacity = [(sum(counts) + shards - 1 - s) // shards for s in range(shards)]
    tree = np.cumsum(np.array(splitting_tree(np.random.default_rng(seed), counts, capacity), dtype=np.int64).reshape(shards, -1), axis=0)
    bounds = spark.createDataFrame([(i, tree[:, i].tolist()) for i in range(sources)], "sid int, bounds array<bigint>")
    # A second permutation, so that every shard draws from all turns alike.
    own = wanted.select("sid", "block", F.col("turn").alias("at"), F.lit(0).alias("turn"), "ranges", "cut")
    ranked = _running(own, F.lit(1).cast("long"), F.xxhash64(F.lit(seed + 2), "sid", "block", "at"), F.col("ranges"))
    dealt = ranked.join(bounds, "sid").withColumn("shard", F.size(F.filter("bounds", lambda b: b <= F.col("before"))))
    return dealt.where(F.col("shard") < shards).select("sid", "block", F.col("at").alias("turn"), "shard", "cut")


def mix(docs: DataFrame, shards: int = 16, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each copy that a shard takes, and one with null ``turn`` for a document that none takes.

    ``docs`` has ``row`` (unique), ``doc_id``, ``source``, ``size`` (words) and ``crc``, and
    is cheap to read again. Returns those with ``source_size``, ``target``, ``turn``
    (0, 1, ...: the how-manieth copy), ``shard`` and ``shard_order``. A source's drawn blocks end at the document
    that comes nearest its target, so it misses that by half a document at most, however long its texts. The driver holds
    one row for each source (its size, target and blocks a shard), never a document or block. Documents without words
    add nothing to a target and go where their block goes. Null
    sources form one source. Equal documents are told apart by ``row``. An empty table gives no rows.
    """
    spark = docs.sparkSession
    stats = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    targets = water_fill([r["source_size"] for r in stats], [weights[i % len(weights)] for i in range(len(stats))], share, cap)
    known = []
    for i, (r, t) in enumerate(zip(stats, targets)):
        n = max(-(-r["source_size"] // block_words), -(-r["n"] // block_words), min(r["n"], BLOCKS_A_SHARD * shards))
        known.append((i, r["source"], r["source_size"], float(t), n, -(-n // RANGE_BLOCKS)))
    sources = spark.createDataFrame(known, "sid int, _source string, source_size long, target double, blocks long, ranges long")

    keyed = docs.join(sources.drop("ranges"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    keyed = keyed.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "row")).withColumn("block", F.pmod(F.shiftrightunsigned("h", 1), "blocks")).drop("blocks")
    sums = stage(keyed.groupBy("sid", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    drawn = stage(draw(sums, sources.select("sid", "target", "ranges"), len(stats), shards, seed, cap), "mix-drawn")

    # Inside a source's last block, documents are taken while their middle lies before the cut.
    last = drawn.where("cut is not null").select("sid", "block").distinct()
    order = Window.partitionBy("sid", "block").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = keyed.join(last, ["sid", "block"], "left_semi").withColumn("at", F.sum("size").over(order) - F.col("size") / 2).select("row", "at")
    taken = keyed.drop("h").join(drawn, ["sid", "block"], "left").join(edge, "row", "left")
    lost = F.col("cut").isNotNull() & (F.col("at") >= F.col("cut"))
    # Turns are used up one after the other, so of a block's rows only that of the last turn can be lost, if any.
    taken = taken.withColumn("turn", F.when(~lost, F.col("turn"))).withColumn("shard", F.when(~lost, F.col("shard"))).drop("cut", "at")
    return taken.withColumn("shard_order", F.xxhash64(F.lit(seed + 3), "row", "turn")).drop("sid", "block")


def _key(id_col: str, source_col: str, text_col: str) -> list[F.Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.crc32(text).alias("crc")]


def _numbered(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Narrow table of ``docs`` with a number for each row; rows that agree in all four values are counted, not lost."""
    counted = docs.select(*_key(id_col, source_col, text_col)).groupBy("doc_id", "source", "size", "crc").count()
    rows = counted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("again"))
    return stage(rows.select(F.xxhash64("doc_id", "source", "size", "crc", "again").alias("row"), "doc_id", "source", "size", "crc"), "mix-input")


def mix_documents(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies, shards)`` for every row of ``docs``: what the shards of :func:`mix` take of each, and which shards."""
    copies = mix(_numbered(docs, id_col, source_col, text_col), shards, seed)
    per = copies.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.count("shard").alias("copies"), F.sort_array(F.collect_list("shard")).alias("shards"))
    return per.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", F.array_join("shards", ",").alias("shards"))


def mixed_rows(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns and ``_mix_shard``, ``_mix_order``, once for each copy.

    To write it, repartition by ``_mix_shard`` and sort by ``_mix_order``. Repeated rows
    (equal id, source, size and checksum) stand for each other. Texts move once. Columns of ``docs``
    of any name come back as they were, but for these two names.
    """
    copies = mix(_numbered(docs, id_col, source_col, text_col), shards, seed).where("shard is not null")
    dealt = copies.groupBy(F.xxhash64("doc_id", "source").alias("_mix_key"), F.col("size").alias("_mix_size"), F.col("crc").alias("_mix_crc"))
    dealt = dealt.agg(F.collect_list(F.struct("shard", "shard_order")).alias("_mix_copies"))
    doc_id, source, size, crc = _key(id_col, source_col, text_col)
    whole = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("_mix_row")
    keyed = docs.select(whole, F.xxhash64(doc_id, source).alias("_mix_key"), size.alias("_mix_size"), crc.alias("_mix_crc"))
    keys = ["_mix_key", "_mix_size", "_mix_crc"]
    one = keyed.join(dealt, keys).dropDuplicates(keys)
    out = one.select("_mix_row", F.explode("_mix_copies").alias("_mix"))
    names = [c for c in docs.columns if c not in ("_mix_shard", "_mix_order")]
    return out.select(*[F.col("_mix_row").getField(c).alias(c) for c in names], F.col("_mix.shard").alias("_mix_shard"), F.col("_mix.shard_order").alias("_mix_order"))
