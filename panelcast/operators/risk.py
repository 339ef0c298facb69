"""Tail risk, historical and resampled. Value at risk is an order statistic, never interpolated."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.operators.portfolio import drawdown

BREACH_DAYS = 252


def _worst(n, confidence: float):
    return F.greatest(F.ceil(n * (1 - confidence) - 1e-9), F.lit(1)).cast("int")


def historical_var(returns: DataFrame, keys: list[str], confidence: float = 0.95) -> DataFrame:
    """K1. Loss on the k-th worst day and mean loss of the k worst, k = max(ceil(n (1 - c)), 1)."""
    own = Window.partitionBy(*keys)
    rows = returns.filter("r IS NOT NULL").withColumn("i", F.row_number().over(own.orderBy("r"))).withColumn("k", _worst(F.count("*").over(own), confidence))
    worst = rows.filter("i <= k")
    return worst.groupBy(*keys).agg((-F.max("r")).alias("var"), (-F.avg("r")).alias("cvar"), F.max("k").alias("k"))


def _least_lists(k: int):
    """For each row of a block, in order: the k least values of the rows before it, and of it and those behind it."""

    def of(values: list[float]) -> list[list[float]]:
        out, held = [], []
        for v in values:
            out.append(list(held))
            bisect.insort(held, v)
            del held[k:]
        return [*out, list(held)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        values = pdf["r"].tolist()
        return pdf.assign(before=of(values)[:-1], ahead=of(values[::-1])[:0:-1])

    return run


def rolling_limits(returns: DataFrame, keys: list[str], k: int, days: int = BREACH_DAYS) -> DataFrame:
    """Each row of returns with ``least``, the k least values of the ``days`` rows before it in order; null without so many.

    A window of ``days`` rows reaches over the end of one block of ``days`` rows and the start of the next. A block keeps for
    each row the k least values up to it and from it on, so a window is two lists of k values, whatever its length.
    """
    own = Window.partitionBy(*keys).orderBy("date")
    rows = returns.filter("r IS NOT NULL").select(*keys, "date", "r", (F.row_number().over(own) - 1).alias("_i"))
    rows = rows.withColumns({"block": F.floor(F.col("_i") / days).cast("int"), "place": (F.col("_i") % days).cast("int")}).drop("_i")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns) + ", before array<double>, ahead array<double>"
    lists = rows.groupBy(*keys, "block").applyInPandas(_least_lists(k), schema)
    last = lists.select(*keys, (F.col("block") + 1).alias("block"), "place", F.col("ahead").alias("_ahead"))
    found = lists.join(last, [*keys, "block", "place"], "left")
    return found.select(*keys, "date", "r", F.when(F.col("_ahead").isNotNull(), F.slice(F.array_sort(F.concat("before", "_ahead")), 1, k)).alias("least"))


def var_breaches(returns: DataFrame, keys: list[str], confidences: tuple[float, ...] = (0.95,), days: int = BREACH_DAYS) -> DataFrame:
    """K2. Days whose loss is strictly worse than the value at risk of the ``days`` days before; days tested."""
    k = {c: max(-int(-(days * (1 - c) - 1e-9) // 1), 1) for c in confidences}
    rows = rolling_limits(returns, keys, max(k.values()), days)
    hit = [F.struct(F.lit(c).alias("confidence"), F.count_if(F.col("r") < F.element_at("least", k[c])).alias("breaches"), F.count("least").alias("tested")) for c in confidences]
    return rows.groupBy(*keys).agg(F.array(*hit).alias("c")).select(*keys, F.explode("c").alias("c")).select(*keys, "c.*")


def tail_table(returns: DataFrame, keys: list[str], confidences: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """K3. K1 and K2 at each confidence, from one ranking of the returns, beside the largest drawdown and the days."""
    own = Window.partitionBy(*keys)
    rows = returns.filter("r IS NOT NULL").withColumns({"_i": F.row_number().over(own.orderBy("r")), "_n": F.count("*").over(own)})

    def at(c: float):
        k = _worst(F.col("_n"), c)
        worst = F.when(F.col("_i") <= k, F.col("r"))
        return F.struct(F.lit(c).alias("confidence"), (-F.max(worst)).alias("var"), (-F.avg(worst)).alias("cvar"), F.max(k).alias("k"))

    var = rows.groupBy(*keys).agg(F.max("_n").alias("days"), F.array(*map(at, confidences)).alias("c")).select(*keys, "days", F.explode("c").alias("c")).select(*keys, "days", "c.*")
    deepest = drawdown(returns, keys).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))
    return var.join(var_breaches(returns, keys, confidences), [*keys, "confidence"]).join(deepest, keys)


def return_history(returns: DataFrame, as_of, n: int) -> DataFrame:
    """K4. The last ``n`` joint return rows (portfolio_id, date, equity, bond) up to a date; portfolios with fewer are left out."""
    rows = returns.filter(F.col("date") <= as_of).filter("equity IS NOT NULL AND bond IS NOT NULL")
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc("date")))).filter(F.col("i") <= n)
    return rows.withColumn("have", F.count("*").over(Window.partitionBy("portfolio_id"))).filter(F.col("have") == n).drop("have")


def bootstrap_paths(history: DataFrame, draws: DataFrame, forecasts: DataFrame, weights: DataFrame, h: int) -> DataFrame:
    """K5. Value of the portfolio along each path of resampled days.

    ``draws(path, step, i)`` names the history day of each step (both assets of a day stay together), the same for all
    portfolios, so a run is a join on the day and repeats exactly. History is centred on forecast / h.
    """
    own = Window.partitionBy("portfolio_id")
    rows = history.join(forecasts, "portfolio_id")
    for a in ("equity", "bond"):
        rows = rows.withColumn(f"c_{a}", F.col(a) - F.avg(a).over(own) + F.col(f"f_{a}") / h)
    drawn = draws.join(rows.select("portfolio_id", "i", "c_equity", "c_bond"), "i").join(weights, "portfolio_id")
    w = Window.partitionBy("portfolio_id", "path").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.col("w_equity") * F.product(1 + F.col("c_equity")).over(w) + (1 - F.col("w_equity")) * F.product(1 + F.col("c_bond")).over(w)
    drawn = drawn.withColumn("value", value)
    return drawn.withColumn("fall", F.col("value") / F.greatest(F.lit(1.0), F.max("value").over(w)) - 1)


def hashed_draws(spark: SparkSession, paths: int, h: int, n: int, seed: int = 1) -> DataFrame:
    """Draw table (path, step, i) of K5: each step's day by a hash of seed, path and step, without any random state."""
    grid = spark.range(paths).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
    number = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "path", "step").cast("binary")), 1, 12), 16, 10).cast("long")
    return grid.select("path", "step", (number % n + 1).cast("int").alias("i"))


def bootstrap_tail(paths: DataFrame, h: int, confidence: float = 0.95) -> DataFrame:
    """Tail figures of K5's paths: over the horizon and on the first day, with mean, volatility and drawdown."""
    ends = paths.filter(F.col("step") == h).select("portfolio_id", (F.col("value") - 1).alias("r"))
    first = paths.filter("step = 1").select("portfolio_id", (F.col("value") - 1).alias("r"))
    falls = paths.groupBy("portfolio_id", "path").agg(F.min("fall").alias("fall")).groupBy("portfolio_id").agg(F.avg(F.least("fall", F.lit(0.0))).alias("mean_drawdown"))
    out = historical_var(ends, ["portfolio_id"], confidence).drop("k")
    day = historical_var(first, ["portfolio_id"], confidence).select("portfolio_id", F.col("var").alias("day_var"), F.col("cvar").alias("day_cvar"))
    return out.join(day, "portfolio_id").join(ends.groupBy("portfolio_id").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("volatility")), "portfolio_id").join(falls, "portfolio_id")
