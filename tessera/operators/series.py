"""Daily series: building, moving filters, bursts, shape similarity, topic storage and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ema_coefficients(n: int) -> list[float]:
    a = 2 / (n + 1)
    return [a * (1 - a) ** j for j in range(n)]


def _convolve(n: int, values: list[float]) -> list[float]:
    out = [0.0] * (len(values) + n - 1)
    for i, v in enumerate(values):
        for j, c in enumerate(ema_coefficients(n)):
            out[i + j] += v * c
    return out


def macd_coefficients(short: int = 4, long: int = 8, signal: int = 5) -> list[float]:
    """Coefficients of the MACD histogram: difference of two averages less its own average."""
    slow = _convolve(long, [1.0])
    fast = _convolve(short, [1.0]) + [0.0] * (long - short)
    macd = [f - s for f, s in zip(fast, slow)]
    smooth = _convolve(signal, macd)
    return [(macd[i] if i < len(macd) else 0.0) - v for i, v in enumerate(smooth)]


def daily_counts(events: DataFrame, key: str, time_col: str, start: str, end: str) -> DataFrame:
    """``(key, day, value)``: events a day from ``start`` to ``end`` (both included), zero where there are none."""
    day = F.to_date(time_col)
    counted = events.where(F.col(key).isNotNull() & day.between(start, end)).groupBy(F.col(key).alias("key"), day.alias("day")).agg(F.count("*").alias("value"))
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    spine = counted.select("key").distinct().select("key", days)
    return spine.join(counted, ["key", "day"], "left").select("key", "day", F.coalesce("value", F.lit(0)).cast("double").alias("value"))


def moving_filter(series: DataFrame, coefficients: list[float], gap: int = 0) -> DataFrame:
    """``series`` with ``filtered``: y[i] = sum of c[j] * x[i - j], 0 while ``gap`` days or fewer are known."""
    by_day = Window.partitionBy("key").orderBy("day")
    n = F.row_number().over(by_day)
    total = F.lit(0.0)
    for j, c in enumerate(coefficients):
        total = total + F.coalesce(F.lag("value", j).over(by_day), F.lit(0.0)) * c
    return series.withColumn("filtered", F.when(F.least(n, F.lit(len(coefficients))) <= gap, 0.0).otherwise(total))


def bursts(series: DataFrame, level: float = 1.0, peak: float = 13.0, coefficients: list[float] | None = None, gap: int | None = None) -> DataFrame:
    """``(key, start, period)``: runs of two days or more with a MACD histogram of ``level``, of keys whose largest value is ``peak`` times the mean or more.

    A run still open on the last day counts.
    """
    coefficients = coefficients or macd_coefficients()
    shaped = moving_filter(series, coefficients, 11 if gap is None else gap)
    whole = Window.partitionBy("key")
    tall = shaped.withColumn("ratio", F.max("value").over(whole) / F.avg("value").over(whole)).where(F.col("ratio") >= peak)
    high = tall.where(F.col("filtered") >= level)
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("key").orderBy("day")))
    runs = high.withColumn("island", island).groupBy("key", "island").agg(F.min("day").alias("start"), F.count("*").cast("int").alias("period"))
    return runs.where("period >= 2").select("key", "start", "period")


def _psi(a0: Column, a1: Column, a2: Column, b0: Column, b1: Column, b2: Column) -> Column:
    return a1 * b1 - (a0 * b2 + a2 * b0) / 2


def shape_similarity(pairs: DataFrame) -> DataFrame:
    """``(a, b, similarity)`` of aligned series ``(a, b, t, x, y)``: 0 below three points.

    sqrt(2) * sum |psi(x, y)| / sum sqrt(psi(x, x)^2 + psi(y, y)^2) over inner points.
    """
    w = Window.partitionBy("a", "b").orderBy("t")
    x = [F.lag("x").over(w), F.col("x"), F.lead("x").over(w)]
    y = [F.lag("y").over(w), F.col("y"), F.lead("y").over(w)]
    each = pairs.select("a", "b", _psi(*x, *y).alias("xy"), _psi(*x, *x).alias("xx"), _psi(*y, *y).alias("yy"))
    top, bottom = F.sum(F.abs("xy")), F.sum(F.sqrt(F.col("xx") * F.col("xx") + F.col("yy") * F.col("yy")))
    return each.groupBy("a", "b").agg(F.coalesce(F.when(bottom > 0, F.sqrt(F.lit(2.0)) * top / bottom), F.lit(0.0)).alias("similarity"))


def linked_shapes(series: DataFrame, least: float = 0.5) -> DataFrame:
    """``(a, b, similarity)`` with ``a < b`` of keys whose series have a shape similarity of ``least`` or more.

    Series meet on days on which both curve: without one their similarity is 0. What remains
    is one row a day and pair, added up by pair.
    """
    w = Window.partitionBy("key").orderBy("day")
    inner = series.select("key", "day", F.lag("value").over(w).alias("v0"), F.col("value").alias("v1"), F.lead("value").over(w).alias("v2")).where("v0 is not null and v2 is not null")
    curved = inner.withColumn("own", _psi(*[F.col(c) for c in ("v0", "v1", "v2")] * 2)).withColumn("own", F.abs("own")).where("v0 <> 0 or v1 <> 0 or v2 <> 0")
    a, b = curved.alias("a"), curved.alias("b")
    both = a.join(b, (F.col("a.day") == F.col("b.day")) & (F.col("a.key") < F.col("b.key")))
    psi = _psi(*[F.col(f"{s}.{v}") for s in "ab" for v in ("v0", "v1", "v2")])
    met = F.sqrt(F.col("a.own") * F.col("a.own") + F.col("b.own") * F.col("b.own"))
    shared = both.groupBy(F.col("a.key").alias("a"), F.col("b.key").alias("b")).agg(F.sum(F.abs(psi)).alias("top"), F.sum(met - F.col("a.own") - F.col("b.own")).alias("less"))
    total = curved.groupBy("key").agg(F.sum("own").alias("total"))
    sums = shared.join(total.select(F.col("key").alias("a"), F.col("total").alias("ta")), "a").join(total.select(F.col("key").alias("b"), F.col("total").alias("tb")), "b")
    bottom = F.col("ta") + F.col("tb") + F.col("less")
    out = sums.select("a", "b", F.when(bottom > 0, F.sqrt(F.lit(2.0)) * F.col("top") / bottom).otherwise(0.0).alias("similarity"))
    return out.where(F.col("similarity") >= least)


def active_topics(bursts_: DataFrame, start: str, end: str) -> DataFrame:
    """Keys with a burst day in ``[start, end)``."""
    last = F.date_add("start", F.col("period") - 1)
    return bursts_.where((F.col("start") < F.lit(end).cast("date")) & (last >= F.lit(start).cast("date"))).select("key").distinct()


def clip_series(series: DataFrame, start: str, end: str) -> DataFrame:
    return series.where(F.col("day").between(start, end))


def merge_series(series: DataFrame, members: DataFrame) -> DataFrame:
    """``(topic, day, value)``: the largest value a day over the keys of each topic; ``members`` has ``key, topic``."""
    return series.join(members, "key").groupBy("topic", "day").agg(F.max("value").alias("value"))


def series_statistics(series: DataFrame) -> DataFrame:
    """Sum, mean, deviation, extremes of each key's values."""
    return series.groupBy("key").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"), F.min("value").alias("low"), F.max("value").alias("high"))
