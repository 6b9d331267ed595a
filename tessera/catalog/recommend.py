"""Recommendation and item-set queries: users are customers and items parts; sets are orders and their items suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import itemsets, recommend
from tessera.plans.staging import stage


def _visits(s: SparkSession, d: str) -> DataFrame:
    orders = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("user"))
    lines = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item"))
    return lines.join(orders, "o_orderkey").select("user", "item", "o_orderkey")


def _near(s: SparkSession, d: str) -> DataFrame:
    return stage(recommend.similarities_by_item(_visits(s, d), recommend.NEIGHBOURS), "neighbours")


def _batch(s: SparkSession, d: str) -> DataFrame:
    v = _visits(s, d)
    old, new = v.where("o_orderkey % 10 <> 0"), v.where("o_orderkey % 10 = 0")
    return recommend.covisits_of_batch(old, new.join(old.select("user", "item"), ["user", "item"], "left_anti"))


def _sets(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("set_id"), F.col("l_suppkey").alias("item"))


def _support(s: SparkSession, d: str) -> int:
    return max(3, _sets(s, d).select("set_id").distinct().count() // 20_000)


def _text(df: DataFrame) -> DataFrame:
    return df.select(F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "support")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _recommend(s: SparkSession, d: str) -> DataFrame:
    out = recommend.recommend(_near(s, d), _visits(s, d))
    return out.select("user", "item", F.round("weight", 6).alias("weight"), F.size("reasons").alias("n_reasons"), "rank")


def _recommend_weighted(s: SparkSession, d: str) -> DataFrame:
    history = _visits(s, d).select("user", "item", F.when(F.col("item") % 7 == 0, -0.5).otherwise(1.0).alias("weight")).distinct()
    out = recommend.recommend(_near(s, d), history, weighted=True)
    return out.select("user", "item", F.round("weight", 6).alias("weight"), F.size("reasons").alias("n_reasons"), "rank")


QUERIES = {
    "covisit_counts": lambda s, d: recommend.covisits(_visits(s, d)),
    "covisit_batch_update": _batch,
    "covisit_top_items": lambda s, d: _rounded(recommend.top_covisited_of(_visits(s, d), 5, s.createDataFrame([(13,), (17,)], "item long")), "weight"),
    "visit_frequency": lambda s, d: recommend.visit_frequency(_visits(s, d)),
    "item_cosine": lambda s, d: _rounded(recommend.similarities_by_item(_visits(s, d)), "sim"),
    "item_cosine_incremental": lambda s, d: _rounded(recommend.similarities_touching(_visits(s, d), s.createDataFrame([(3,), (5,)], "item long")), "sim"),
    "item_neighbours": lambda s, d: _near(s, d).select("item_i", "item_j", F.round("sim", 6).alias("sim"), "rank"),
    "item_recommend": _recommend,
    "item_recommend_weighted": _recommend_weighted,
    "frequent_itemsets": lambda s, d: _text(itemsets.frequent_itemsets(_sets(s, d), _support(s, d))),
    "fp_growth": lambda s, d: _text(itemsets.fp_growth(_sets(s, d), _support(s, d))),
    "maximal_sets": lambda s, d: itemsets.maximal_sets(_sets(s, d)),
}

_V = "visits as (select o_custkey as \"user\", l_partkey as item, o_orderkey from lineitem join orders on l_orderkey = o_orderkey), once as (select distinct \"user\", item from visits)"
_C = f"{_V}, counts as (select a.item as item_i, b.item as item_j, count(*) as freq from once a join once b using (\"user\") group by all)"
_S = f"{_C}, own as (select item_i as item, freq from counts where item_i = item_j), sims as (select c.item_i, c.item_j, c.freq / sqrt(x.freq::double * y.freq) as sim from counts c join own x on x.item = c.item_i join own y on y.item = c.item_j where c.item_i <> c.item_j)"
_N = f"{_S}, near as (select * from (select *, row_number() over (partition by item_i order by sim desc, item_j)::int as rank from sims) where rank <= 30)"


def _rec(weight: str) -> str:
    return f"""with {_N}, history as (select "user", item, {weight} as w from once),
pool as (select distinct h."user", n.item_j as item from history h join near n on n.item_i = h.item where h.w > 0),
fresh as (select p.* from pool p anti join history h on p."user" = h."user" and p.item = h.item),
total as (select item_i, sum(sim) as total from near group by 1),
scored as (select f."user", f.item, sum(n.sim * h.w) / min(t.total) as weight, count(*)::int as n_reasons from fresh f join near n on n.item_i = f.item join history h on h."user" = f."user" and h.item = n.item_j join total t on t.item_i = f.item group by 1, 2),
ranked as (select *, row_number() over (partition by "user" order by round(weight, 9) desc, item)::int as rank from scored where weight > 0)
select "user", item, round(weight, 6) as weight, n_reasons, rank from ranked where rank <= 10"""


_T = "rows as (select distinct l_orderkey as set_id, l_suppkey as item from lineitem), least_n as (select greatest(3, count(distinct set_id) // 20000) as m from rows)"
_F = f"""with recursive {_T}, grown as (select set_id, item as last, item::varchar as items, 1 as n from rows
union all select g.set_id, r.item, g.items || ',' || r.item, n + 1 from grown g join rows r on r.set_id = g.set_id and r.item > g.last)
select items, count(*) as support from grown where n <= {{most}} group by items having count(*) >= (select m from least_n)"""


ORACLE = {
    "covisit_counts": f"with {_C} select * from counts",
    "covisit_batch_update": f"""with {_V}, o as (select distinct "user", item from visits where o_orderkey % 10 <> 0), n as (select * from (select distinct "user", item from visits where o_orderkey % 10 = 0) except select * from o)
select item_i, item_j, count(*) as freq from (select a.item as item_i, b.item as item_j from n a join n b using ("user") union all select a.item, b.item from n a join o b using ("user") union all select a.item, b.item from o a join n b using ("user")) group by all""",
    "covisit_top_items": f"with {_C}, kept as (select * from counts where item_i <> item_j and item_j not in (13, 17)), ranked as (select item_i, item_j, round(freq / sum(freq) over (partition by item_i), 6) as weight, row_number() over (partition by item_i order by freq desc, item_j)::int as rank from kept) select * from ranked where rank <= 5",
    "visit_frequency": f"with {_V} select item, count(*) as freq from once group by item",
    "item_cosine": f"with {_S} select item_i, item_j, round(sim, 6) as sim from sims",
    "item_cosine_incremental": f"with {_S} select item_i, item_j, round(sim, 6) as sim from sims where item_i in (3, 5) or item_j in (3, 5)",
    "item_neighbours": f"with {_N} select item_i, item_j, round(sim, 6) as sim, rank from near",
    "item_recommend": _rec("1.0::double"),
    "item_recommend_weighted": _rec("case when item % 7 = 0 then -0.5 else 1.0 end::double"),
    "frequent_itemsets": _F.format(most=4),
    "fp_growth": _F.format(most=1000),
    "maximal_sets": """with rows as (select distinct l_orderkey as set_id, l_suppkey as item from lineitem), sized as (select set_id, count(*) as n, string_agg(item::varchar, ',' order by item) as items from rows group by 1), kinds as (select items, min(set_id) as kind, any_value(n) as n from sized group by 1),
krows as (select k.kind, k.n, r.item from kinds k join rows r on r.set_id = k.kind), shared as (select a.kind, a.n, b.kind as other, count(*) as n_shared from krows a join krows b on a.item = b.item and b.n > a.n group by all),
inside as (select distinct items from kinds join shared using (kind) where n_shared = shared.n) select set_id from sized where items not in (select items from inside)""",
}
