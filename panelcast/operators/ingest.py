"""Series dimensions: labels, classes, choice of signals and targets, joining of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Transforms of known tickers.
TICKER_TRANSFORMS = {"VIX": "LEVEL", "USGG10YR": "DIFFERENCE", "SPX": "LOG_RETURN"}
TOTAL_RETURN, LAST_PRICE = "TOT_RETURN", "PX_LAST"


def series_label(name: Column) -> Column:
    """B1. Runs of other characters than letters and digits as one underscore, trimmed."""
    return F.btrim(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), F.lit("_"))


def with_labels(files: DataFrame) -> DataFrame:
    """B1. Labels of ``files(file, security)``: from the security, or the file's stem where there is none or where
    another file has the same label."""
    stem = series_label(F.regexp_replace("file", r"\.[^.]*$", ""))
    rows = files.withColumn("label", F.when(F.coalesce(F.col("security"), F.lit("")) != "", series_label(F.col("security"))).otherwise(stem))
    clash = F.count("*").over(Window.partitionBy("label")) > 1
    return rows.withColumn("label", F.when(clash, stem).otherwise(F.col("label")))


def series_sources(series: DataFrame) -> DataFrame:
    """B2. The first file's (security, field, ticker) of each merged column. ``series(column, security, field, file)``."""
    w = Window.partitionBy("column").orderBy("file")
    return series.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").withColumn("ticker", F.split_part("security", F.lit(" "), F.lit(1)))


def classify_transform(series: DataFrame, known: DataFrame) -> DataFrame:
    """B3. LOG_RETURN for total returns, the known ticker's transform, else DIFFERENCE and unclassified."""
    rows = series.join(known.select("ticker", F.col("transform").alias("of_ticker")), "ticker", "left")
    total = F.instr("field", TOTAL_RETURN) > 0
    return rows.withColumn("transform", F.when(total, "LOG_RETURN").otherwise(F.coalesce("of_ticker", F.lit("DIFFERENCE")))).withColumn("unclassified", ~total & F.col("of_ticker").isNull()).drop("of_ticker")


def select_signals(series: DataFrame, target_securities: DataFrame) -> DataFrame:
    """B4. One field per security: no bid or ask, no field of a target, total return before last price before the first
    by name; a series without a security stands alone."""
    rows = series.filter(~F.col("field").rlike("BID|ASK")).join(target_securities, "security", "left_anti")
    rank = F.when(F.instr("field", TOTAL_RETURN) > 0, 0).when(F.col("field") == LAST_PRICE, 1).otherwise(2)
    own = F.coalesce(F.nullif("security", F.lit("")), F.concat(F.lit("#"), "series_id"))
    w = Window.partitionBy(own).orderBy(rank, "field", "series_id")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def empty_series(obs: DataFrame) -> DataFrame:
    """B5. Series without any value."""
    return obs.groupBy("series_id").agg(F.count("value").alias("n"), F.count("*").alias("rows")).filter("n = 0").select("series_id", "rows")


def resolve_inputs(series: DataFrame, tickers: DataFrame) -> DataFrame:
    """B14. For each required (target_id, ticker): its series, or that it is missing or ambiguous."""
    found = tickers.join(series.select("ticker", "series_id"), "ticker", "left").groupBy("target_id", "ticker").agg(F.count("series_id").alias("n"), F.min("series_id").alias("series_id"))
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return found.withColumn("status", status).withColumn("series_id", F.when(F.col("n") == 1, F.col("series_id"))).drop("n")


def resolve_targets(series: DataFrame, roles: DataFrame) -> DataFrame:
    """B15. Each role's series: total-return field, else the first field; with conflicts named. ``roles(security, role)``."""
    rows = series.join(roles, "security")
    rank = F.when(F.instr("field", TOTAL_RETURN) > 0, 0).otherwise(1)
    best = F.min_by("series_id", F.struct(rank, "field", "series_id"))
    out = rows.groupBy("role").agg(best.alias("series_id"), F.count_distinct("file").alias("files"))
    double = rows.groupBy("security").agg(F.count_distinct("role").alias("roles")).filter("roles > 1").join(rows, "security").groupBy("role").agg(F.count("*").alias("shared"))
    fault = F.when(F.col("files") > 1, "two files in one role").when(F.col("shared") > 0, "one security in two roles")
    return out.join(double, "role", "left").select("role", "series_id", fault.alias("conflict"))


def early_start(rebalances: DataFrame, published: str = "2005-05-01") -> DataFrame:
    """B16. Portfolios whose first rebalance is before the prior was published."""
    return rebalances.groupBy("portfolio_id").agg(F.min("date").alias("first")).withColumn("early", F.col("first") < F.lit(published).cast("date"))


def merge_on_date(*frames: DataFrame) -> DataFrame:
    """C1. Long frames (series_id, date, value) as one."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def to_wide(obs: DataFrame, series: list[str]) -> DataFrame:
    """C1. One column per series; an outer join on date in one shuffle."""
    return obs.groupBy("date").pivot("series_id", series).agg(F.first("value", ignorenulls=True))


def join_split_series(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C2. Parts ``(security, field, file, date, value)`` of a security with the same fields become one series: blanks are
    filled from later files; a date with two different values is a clash. Returns (joined, clashes)."""
    fields = parts.groupBy("security", "file").agg(F.array_join(F.sort_array(F.collect_set("field")), "|").alias("fields"))
    rows = parts.join(fields, ["security", "file"]).groupBy("security", "fields", "field", "date").agg(
        F.count_distinct("value").alias("n_values"), F.min_by("value", F.when(F.col("value").isNotNull(), F.col("file"))).alias("value"), F.count_distinct("file").alias("files")
    )
    clash = rows.filter("n_values > 1").groupBy("security", "field").agg(F.count("*").alias("clashes"), F.min("date").alias("first_clash"))
    return rows.filter("n_values <= 1").select("security", "field", "date", "value", "files"), clash
