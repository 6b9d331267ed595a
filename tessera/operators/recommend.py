"""Co-visitation and item-based collaborative filtering from new visits ``(user, item)``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import pairing, scoring
from tessera.plans.staging import stage

NEIGHBOURS = 30


def covisits(visits: DataFrame) -> DataFrame:
    """``(item_i, item_j, freq)``: users who visited both items; ``freq`` of (i, i) is the users of i.

    Each user's distinct items are paired once. A user's pairs are the result's raw
    material; they are added up before they are shuffled.
    """
    once = visits.select("user", "item").distinct()
    a, b = once.select("user", F.col("item").alias("item_i")), once.select("user", F.col("item").alias("item_j"))
    return a.join(b, "user").groupBy("item_i", "item_j").agg(F.count("*").alias("freq"))


def covisits_of_batch(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts that a batch of new visits adds: new with new, and new with old in both directions."""
    n, o = new.select("user", "item").distinct(), old.select("user", "item").distinct()
    o = o.join(n, ["user", "item"], "left_anti")
    pairs = [(n, n), (n, o), (o, n)]
    out = None
    for left, right in pairs:
        part = left.select("user", F.col("item").alias("item_i")).join(right.select("user", F.col("item").alias("item_j")), "user")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("item_i", "item_j").agg(F.count("*").alias("freq"))


def merge_covisits(*counts: DataFrame) -> DataFrame:
    """Sum of co-visit tables, such as a stored one and a batch's."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("item_i", "item_j").agg(F.sum("freq").alias("freq"))


def visit_frequency(visits: DataFrame) -> DataFrame:
    return visits.groupBy("item").agg(F.countDistinct("user").alias("freq"))


def top_covisited(counts: DataFrame, k: int = 10, excluded: DataFrame | None = None) -> DataFrame:
    """``(item_i, item_j, weight, rank)``: the ``k`` items most visited with each; weights are shares of all its unfiltered co-visits."""
    kept = counts.where("item_i <> item_j")
    if excluded is not None:
        kept = kept.join(excluded.select(F.col("item").alias("item_j")), "item_j", "left_anti")
    total = F.sum("freq").over(Window.partitionBy("item_i"))
    rank = F.row_number().over(Window.partitionBy("item_i").orderBy(F.col("freq").desc(), "item_j"))
    return kept.select("item_i", "item_j", (F.col("freq") / total).alias("weight"), rank.alias("rank")).where(F.col("rank") <= k)


def similarities(counts: DataFrame) -> DataFrame:
    """``(item_i, item_j, sim)``: cosine of co-visits, ``c_ij / sqrt(c_ii * c_jj)``, for different items."""
    own = counts.where("item_i = item_j").select(F.col("item_i").alias("item"), F.col("freq").alias("own"))
    left = own.select(F.col("item").alias("item_i"), F.col("own").alias("own_i"))
    right = own.select(F.col("item").alias("item_j"), F.col("own").alias("own_j"))
    joined = counts.where("item_i <> item_j").join(left, "item_i").join(right, "item_j")
    return joined.select("item_i", "item_j", (F.col("freq") / F.sqrt(F.col("own_i").cast("double") * F.col("own_j"))).alias("sim"))


def similarities_of(counts: DataFrame, touched: DataFrame) -> DataFrame:
    """Similarities with an end in ``touched`` (item): the rows a batch changes."""
    t = touched.select("item").distinct()
    near = similarities(counts)
    left = near.join(t.withColumnRenamed("item", "item_i"), "item_i", "left_semi")
    right = near.join(t.withColumnRenamed("item", "item_j"), "item_j", "left_semi")
    return left.unionByName(right).distinct()


def neighbours(sims: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item_i").orderBy(F.col("sim").desc(), "item_j"))
    return sims.withColumn("rank", rank).where(F.col("rank") <= k)


def top_covisited_of(visits: DataFrame, k: int = 10, excluded: DataFrame | None = None) -> DataFrame:
    """:func:`top_covisited` of new visits. Pairs are counted and ranked in one place; no table of them is kept. Items that are not whole numbers take the way by counts."""
    if not pairing.countable(visits):
        return top_covisited(stage(covisits(visits), "covisits"), k, excluded)

    def finish(i, j, freq, own_i, own_j):
        kept = (i != j) & (own_j > 0)
        i, j, freq = i[kept], j[kept], freq[kept]
        if not len(i):
            return {"item_i": i, "item_j": j, "weight": freq.astype(float), "rank": freq.astype(np.int32)}
        begins = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        total = np.repeat(np.add.reduceat(freq, begins), np.diff(begins, append=len(i)))
        at, rank = pairing.best(i, j, freq.astype(float), k)
        return {"item_i": i[at], "item_j": j[at], "weight": freq[at] / total[at], "rank": rank}

    found = pairing.pairs_by_item(pairing.baskets(visits, excluded), finish, "item_i long, item_j long, weight double, rank int")
    return _typed(found, visits)


def similarities_by_item(visits: DataFrame, k: int | None = None) -> DataFrame:
    """:func:`similarities` of new visits or, with ``k``, :func:`neighbours` of them; no table of pairs is kept."""
    if not pairing.countable(visits):
        sims = similarities(stage(covisits(visits), "covisits"))
        return neighbours(sims, k) if k else sims

    def finish(i, j, freq, own_i, own_j):
        kept = i != j
        i, j, sim = i[kept], j[kept], freq[kept] / np.sqrt(own_i[kept].astype(float) * own_j[kept])
        if not k:
            return {"item_i": i, "item_j": j, "sim": sim}
        at, rank = pairing.best(i, j, sim, k)
        return {"item_i": i[at], "item_j": j[at], "sim": sim[at], "rank": rank}

    found = pairing.pairs_by_item(pairing.baskets(visits), finish, "item_i long, item_j long, sim double" + (", rank int" if k else ""))
    return _typed(found, visits)


def similarities_touching(visits: DataFrame, touched: DataFrame) -> DataFrame:
    """:func:`similarities_of` of new visits: only the baskets that hold a touched item are paired, and only with it."""
    t = touched.select("item").distinct()
    once = stage(visits.select("user", "item").where("user is not null and item is not null").distinct(), "once")
    mine = once.join(t, "item", "left_semi").select("user", F.col("item").alias("item_i"))
    counts = mine.join(once.select("user", F.col("item").alias("item_j")), "user").groupBy("item_i", "item_j").agg(F.count("*").alias("freq")).where("item_i <> item_j")
    own = once.groupBy("item").agg(F.count("*").alias("own"))
    joined = counts.join(own.select(F.col("item").alias("item_i"), F.col("own").alias("own_i")), "item_i").join(own.select(F.col("item").alias("item_j"), F.col("own").alias("own_j")), "item_j")
    sims = joined.select("item_i", "item_j", (F.col("freq") / F.sqrt(F.col("own_i").cast("double") * F.col("own_j"))).alias("sim"))
    return sims.unionByName(sims.select(F.col("item_j").alias("item_i"), F.col("item_i").alias("item_j"), "sim")).distinct()


def _typed(pairs: DataFrame, visits: DataFrame) -> DataFrame:
    kind = visits.schema["item"].dataType
    return pairs.withColumns({c: F.col(c).cast(kind) for c in ("item_i", "item_j")})


def recommend(near: DataFrame, history: DataFrame, k: int = 10, weighted: bool = False) -> DataFrame:
    """``(user, item, weight, reasons, rank)``: the ``k`` best items a user has not visited.

    ``near`` is a neighbour table ``(item_i, item_j, sim)``; ``history`` has ``user, item`` and,
    if ``weighted``, ``weight``. A candidate is a neighbour of a visited item (of positive
    weight); its score is the similarity of those of its own neighbours that were visited
    over that of all its neighbours. Scores above 0 are ranked, ties by item. Whole-number users and items are scored block by
    block (:mod:`~tessera.operators.scoring`); others take the way by a row for each neighbour of a visit.
    """
    whole = ("tinyint", "smallint", "int", "bigint")
    if all(dict(df.dtypes)[c] in whole for df, c in ((near, "item_i"), (near, "item_j"), (history, "user"), (history, "item"))):
        out = scoring.recommend_in_blocks(near, history, k, weighted)
        kinds = {"user": history.schema["user"].dataType, "item": near.schema["item_j"].dataType}
        return out.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})
    return _recommend_by_rows(near, history, k, weighted)


def _recommend_by_rows(near: DataFrame, history: DataFrame, k: int, weighted: bool) -> DataFrame:
    visited = stage(history.groupBy("user", "item").agg((F.sum("weight") if weighted else F.lit(1.0)).alias("w")), "visited")
    # What each visit adds to the items it is a neighbour of, which items it brings in, and the visit itself, in one sum.
    added = visited.join(near, visited["item"] == near["item_j"]).select("user", F.col("item_i").alias("item"), (F.col("sim") * F.col("w")).alias("s"), F.lit(0).alias("brought"), F.lit(0).alias("seen"))
    brought = visited.where("w > 0").join(near, visited["item"] == near["item_i"]).select("user", F.col("item_j").alias("item"), F.lit(None).cast("double").alias("s"), F.lit(1).alias("brought"), F.lit(0).alias("seen"))
    own = visited.select("user", "item", F.lit(None).cast("double").alias("s"), F.lit(0).alias("brought"), F.lit(1).alias("seen"))
    summed = added.unionByName(brought).unionByName(own).groupBy("user", "item").agg(F.sum("s").alias("s"), F.max("brought").alias("brought"), F.max("seen").alias("seen"))
    total = near.groupBy(F.col("item_i").alias("item")).agg(F.sum("sim").alias("total"))
    scored = summed.where("brought = 1 and seen = 0 and s > 0").join(total, "item").select("user", "item", (F.col("s") / F.col("total")).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.round("weight", 9).desc(), "item"))
    best = stage(scored.where("weight > 0").withColumn("rank", rank).where(F.col("rank") <= k), "best")
    why = best.join(near, best["item"] == near["item_i"]).select("user", "item", "item_j")
    why = why.join(visited.select("user", F.col("item").alias("item_j")), ["user", "item_j"]).groupBy("user", "item").agg(F.sort_array(F.collect_list("item_j")).alias("reasons"))
    return best.join(why, ["user", "item"]).select("user", "item", "weight", "reasons", "rank")
