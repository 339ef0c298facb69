"""Bars, downsampling and date sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candles(ticks: DataFrame, period: str) -> DataFrame:
    """N1. Bars of ``ticks(series_id, ts, value)``: open is the last close (the first value if there is none), high and
    low include the open."""
    bars = ticks.filter("value IS NOT NULL").groupBy("series_id", F.date_trunc(period, "ts").cast("date").alias("period_start")).agg(
        F.min_by("value", F.struct("ts", "value")).alias("first"), F.max("value").alias("top"), F.min("value").alias("bottom"), F.max_by("value", F.struct("ts", "value")).alias("close"), F.count("*").alias("volume")
    )
    opened = F.coalesce(F.lag("close").over(Window.partitionBy("series_id").orderBy("period_start")), F.col("first"))
    return bars.withColumn("open", opened).select("series_id", "period_start", "open", F.greatest("top", "open").alias("high"), F.least("bottom", "open").alias("low"), "close", "volume")


def latest_bar(bars: DataFrame, period: str, zone: str = "UTC") -> DataFrame:
    """N2. Bars (series_id, ts, close) filed under their period in the exchange's zone, the latest kept; null bars go."""
    local = bars.filter("close IS NOT NULL").withColumn("period_start", F.date_trunc(period, F.from_utc_timestamp("ts", zone)).cast("date"))
    return local.groupBy("series_id", "period_start").agg(F.max_by(F.struct("close", "ts"), F.struct("ts", "close")).alias("b")).select("series_id", "period_start", "b.close", F.col("b.ts").alias("filed"))


def downsample_minmax(rows: DataFrame, stretches: int) -> DataFrame:
    """N3. Of each of ``stretches`` equal stretches, the first row at its high and at its low; and the ends."""
    own = Window.partitionBy("series_id")
    r = rows.withColumn("i", F.row_number().over(own.orderBy("date")) - 1).withColumn("n", F.count("*").over(own))
    r = r.withColumn("stretch", F.floor(F.col("i") * stretches / F.col("n")))
    part = Window.partitionBy("series_id", "stretch")
    r = r.withColumn("up", F.row_number().over(part.orderBy(F.desc("value"), "i"))).withColumn("down", F.row_number().over(part.orderBy("value", "i")))
    return r.filter("up = 1 OR down = 1 OR i = 0 OR i = n - 1").select("series_id", "date", "value")


def downsample_even(rows: DataFrame, n: int) -> DataFrame:
    """N4. ``n`` evenly spaced rows and the rows of the global extremes."""
    own = Window.partitionBy("series_id")
    r = rows.withColumn("i", F.row_number().over(own.orderBy("date")) - 1).withColumn("n", F.count("*").over(own))
    r = r.withColumn("up", F.row_number().over(own.orderBy(F.desc("value"), "i"))).withColumn("down", F.row_number().over(own.orderBy("value", "i")))
    # row i is the first one at or after some k * (n - 1) / (wanted - 1)
    reach = lambda i: F.floor(i * (n - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    even = (F.col("n") <= n) | (F.col("i") == 0) | (reach(F.col("i")) > reach(F.col("i") - 1))
    return r.filter(even | (F.col("up") == 1) | (F.col("down") == 1)).select("series_id", "date", "value")


def top_flags(flags: DataFrame, k: int) -> DataFrame:
    """N5. The first ``k`` flagged dates of a series, and how many more there are."""
    own = Window.partitionBy("series_id")
    r = flags.withColumn("i", F.row_number().over(own.orderBy("date"))).withColumn("n", F.count("*").over(own)).filter(F.col("i") <= k)
    return r.groupBy("series_id").agg(F.array_join(F.sort_array(F.collect_list(F.col("date").cast("string"))), ", ").alias("named"), (F.max("n") - F.count("*")).alias("more"))


def calendar_sets(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """N6. Union, intersection and difference of two date sets."""
    return {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
