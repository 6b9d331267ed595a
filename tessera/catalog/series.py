"""Time-series and topic queries: keys are event types and users of ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import series

_START, _END = "2024-01-01", "2024-01-30"
_EMA = series.ema_coefficients(5)
_MACD = series.macd_coefficients()


def _types(s: SparkSession, d: str) -> DataFrame:
    return series.daily_counts(s.read.parquet(f"{d}/events.parquet"), "event_type", "ts", _START, _END)


def _users(s: SparkSession, d: str) -> DataFrame:
    events = s.read.parquet(f"{d}/events.parquet").withColumn("user", F.col("user_id"))
    return series.daily_counts(events, "user", "ts", _START, _END)


def _bursts(s: SparkSession, d: str) -> DataFrame:
    return series.bursts(_users(s, d), 0.5, 1.2)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    t = _types(s, d)
    left = t.select(F.col("key").alias("a"), F.col("day").alias("t"), F.col("value").alias("x"))
    right = t.select(F.col("key").alias("b"), F.col("day").alias("t"), F.col("value").alias("y"))
    return left.join(right, "t").where("a < b")


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _merged(s: SparkSession, d: str) -> DataFrame:
    users = _users(s, d)
    return series.merge_series(users, users.select("key", (F.col("key") % 7).alias("topic")).distinct())


def _dated(query):
    """Dates as text, which both engines write alike."""
    return lambda s, d: (lambda df: df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"}))(query(s, d))


QUERIES = {
    "series_daily_counts": _types,
    "series_ema5": lambda s, d: _r(series.moving_filter(_types(s, d), _EMA), "filtered"),
    "series_macd_histogram": lambda s, d: _r(series.moving_filter(_types(s, d), _MACD, 11), "filtered"),
    "series_bursts": _bursts,
    "series_shape_similarity": lambda s, d: _r(series.shape_similarity(_pairs(s, d)), "similarity"),
    "series_linked_shapes": lambda s, d: _r(series.linked_shapes(_users(s, d), 0.3), "similarity"),
    "series_statistics": lambda s, d: _r(series.series_statistics(_types(s, d)), "mean", "deviation"),
    "series_clip": lambda s, d: series.clip_series(_types(s, d), "2024-01-10", "2024-01-12"),
    "topics_active": lambda s, d: series.active_topics(_bursts(s, d), "2024-01-14", "2024-01-20"),
    "topics_merged": _merged,
}

QUERIES = {name: _dated(query) for name, query in QUERIES.items()}

_TYPES = f"""counted as (select event_type as key, ts::date as day, count(*) as value from events where ts::date between '{_START}' and '{_END}' group by all),
series as (select k.key, s.day::date as day, coalesce(c.value, 0)::double as value from (select distinct key from counted) k cross join (select unnest(generate_series('{_START}'::timestamp, '{_END}'::timestamp, interval 1 day)) as day) s left join counted c on c.key = k.key and c.day = s.day::date)"""
_USERS = _TYPES.replace("event_type as key", "user_id as key")


def _filter_sql(coefficients: list[float], gap: int) -> str:
    total = " + ".join(f"coalesce(lag(value, {j}) over w, 0) * {c!r}::double" for j, c in enumerate(coefficients))
    return f"shaped as (select *, case when least(row_number() over w, {len(coefficients)}) <= {gap} then 0.0::double else 0.0::double + {total} end as filtered from series window w as (partition by key order by day))"


_BURSTS = f"""{_USERS}, {_filter_sql(_MACD, 11)}, tall as (select *, max(value) over (partition by key) / avg(value) over (partition by key) as ratio from shaped), high as (select * from tall where ratio >= 1.2 and filtered >= 0.5),
runs as (select key, min(day) as start, count(*)::int as period from (select *, day - row_number() over (partition by key order by day)::int as island from high) group by key, island), bursts as (select * from runs where period >= 2)"""
_PSI = "({a}1 * {b}1 - ({a}0 * {b}2 + {a}2 * {b}0) / 2)"


def _shape_sql(source: str, least: float | None) -> str:
    keep = f"where similarity >= {least}" if least is not None else ""
    xy, xx, yy = (_PSI.format(a=a, b=b) for a, b in (("x", "y"), ("x", "x"), ("y", "y")))
    return f"""with {source}, v as (select key, day, lag(value) over w as v0, value as v1, lead(value) over w as v2 from series window w as (partition by key order by day)),
p as (select a.key as a, b.key as b, a.v0 as x0, a.v1 as x1, a.v2 as x2, b.v0 as y0, b.v1 as y1, b.v2 as y2 from v a join v b on a.day = b.day and a.key < b.key where a.v0 is not null and a.v2 is not null),
g as (select a, b, sqrt(2) * sum(abs({xy})) / sum(sqrt({xx} * {xx} + {yy} * {yy})) as similarity from p group by a, b) select a, b, round(similarity, 6) as similarity from g {keep}"""


ORACLE = {
    "series_daily_counts": f"with {_TYPES} select * replace (day::varchar as day) from series",
    "series_ema5": f"with {_TYPES}, {_filter_sql(_EMA, 0)} select key, day::varchar as day, value, round(filtered, 6) as filtered from shaped",
    "series_macd_histogram": f"with {_TYPES}, {_filter_sql(_MACD, 11)} select key, day::varchar as day, value, round(filtered, 6) as filtered from shaped",
    "series_bursts": f"with {_BURSTS} select * replace (start::varchar as start) from bursts",
    "series_shape_similarity": _shape_sql(_TYPES, None),
    "series_linked_shapes": _shape_sql(_USERS, 0.3),
    "series_statistics": f"with {_TYPES} select key, sum(value) as total, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as deviation, min(value) as low, max(value) as high from series group by key",
    "series_clip": f"with {_TYPES} select * replace (day::varchar as day) from series where day between '2024-01-10' and '2024-01-12'",
    "topics_active": f"with {_BURSTS} select distinct key from bursts where start < '2024-01-20' and start + period - 1 >= '2024-01-14'",
    "topics_merged": f"with {_USERS} select key % 7 as topic, day::varchar as day, max(value) as value from series group by all",
}
