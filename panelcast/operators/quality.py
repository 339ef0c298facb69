"""Data-quality reports over long observations ``obs(series_id, date, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SANE_LOW, SANE_HIGH = -300.0, 10000.0
BIG_MOVE, NAMED = 8.0, 5


def classify_check(field: Column) -> Column:
    """B6. POSITIVE for total returns, NUMERIC for prices, else a sane range."""
    return F.when(F.instr(field, "TOT_RETURN") > 0, "POSITIVE").when(F.instr(field, "_PX_") > 0, "NUMERIC").otherwise("SANE_RANGE")


def schema_errors(obs: DataFrame, checks: DataFrame) -> DataFrame:
    """D1. Per series: bad values of its check, with the first NAMED distinct ones in order and the count of the rest."""
    rows = obs.join(checks, "series_id")
    bad = (
        F.when(F.col("value").isNull(), False).when(F.col("check") == "POSITIVE", F.col("value") <= 0)
        .when(F.col("check") == "SANE_RANGE", ~F.col("value").between(SANE_LOW, SANE_HIGH)).otherwise(False)
    )
    wrong = rows.filter(bad)
    # distinct bad values are ranked by a window, so no list grows with them
    values = wrong.groupBy("series_id", "check", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("series_id", "check")
    values = values.withColumn("i", F.row_number().over(w.orderBy("value"))).withColumn("all", F.sum("n").over(w)).withColumn("distinct", F.count("*").over(w)).filter(F.col("i") <= NAMED)
    return values.groupBy("series_id", "check").agg(
        F.max("all").alias("bad_rows"), F.array_join(F.transform(F.sort_array(F.collect_list("value")), lambda v: F.format_string("%.4f", v)), ", ").alias("named"), (F.max("distinct") - F.count("*")).alias("more")
    )


def drop_exact_repeats(rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """D2. Rows equal to an earlier one in every column but ``order`` go; and the count dropped per file."""
    columns = [c for c in rows.columns if c != order]
    kept = rows.groupBy(*columns).agg(F.min(order).alias(order), F.count("*").alias("_n"))
    dropped = kept.groupBy("file").agg(F.sum(F.col("_n") - 1).alias("dropped"), F.count("*").alias("kept"))
    return kept.select(*rows.columns), dropped


def repeated_dates(rows: DataFrame, named: int = 10) -> DataFrame:
    """D3. Dates of a file that still have several different values: how many, and the first ``named``."""
    twice = rows.groupBy("file", "date").agg(F.count("*").alias("n")).filter("n > 1")
    w = Window.partitionBy("file")
    twice = twice.withColumn("i", F.row_number().over(w.orderBy("date"))).withColumn("dates", F.count("*").over(w)).filter(F.col("i") <= named)
    return twice.groupBy("file").agg(F.max("dates").alias("dates"), F.array_join(F.sort_array(F.collect_list(F.col("date").cast("string"))), ", ").alias("named"))


def weekend(date: Column) -> Column:
    """B11."""
    return F.weekday(date) >= 5


def quality_summary(obs: DataFrame, calendar: DataFrame, flags: DataFrame) -> DataFrame:
    """D4. Per series: rows, duplicate dates, weekend rows, share of calendar dates missing, flagged moves, span."""
    dates = calendar.select("date").distinct()
    n_dates = dates.agg(F.count("*").alias("n_dates"))
    per = obs.groupBy("series_id").agg(
        F.count("*").alias("rows"), (F.count("*") - F.count_distinct("date")).alias("duplicate_dates"), F.count_if(weekend(F.col("date"))).alias("weekend_rows"),
        F.count_distinct(F.when(F.col("value").isNotNull(), F.col("date"))).alias("valued"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    moves = flags.groupBy("series_id").agg(F.count("*").alias("flagged_moves"))
    out = per.crossJoin(n_dates).join(moves, "series_id", "left")
    return out.select("series_id", "rows", "duplicate_dates", "weekend_rows", ((1 - F.col("valued") / F.col("n_dates")) * 100).alias("missing_percent"), F.coalesce("flagged_moves", F.lit(0)).alias("flagged_moves"), "first_date", "last_date")


def unreadable_dates(rows: DataFrame) -> DataFrame:
    """B11. Rows of ``rows(file, pos, date, ..)`` whose date could not be read, by file: how many, and the first line."""
    return rows.filter("date IS NULL").groupBy("file").agg(F.count("*").alias("unreadable"), F.min("pos").alias("first_pos"))


def missing_rows(obs: DataFrame, series: DataFrame, holidays: DataFrame) -> DataFrame:
    """D5, C15. Dates on which some series has no value: which ones, and why. ``series`` is a dimension.

    A date's values are counted first, and only dates with too few of them are compared with the list of all series.
    """
    n = series.agg(F.count_distinct("series_id").alias("n"), F.collect_set("series_id").alias("all"))
    held = obs.groupBy("date").agg(F.collect_set(F.when(F.col("value").isNotNull(), F.col("series_id"))).alias("held"))
    gaps = held.crossJoin(n).filter("size(held) < n").withColumn("gone", F.sort_array(F.array_except("all", "held")))  # one row
    rows = gaps.select("date", F.array_join("gone", ", ").alias("missing"), F.size("gone").cast("long").alias("n_missing"))
    rows = rows.join(holidays.select("date", F.lit(True).alias("closed")), "date", "left")
    reason = F.when(F.col("date").isNull(), "unreadable date").when(weekend(F.col("date")), "weekend").when(F.col("closed"), "market holiday").otherwise("unexplained")
    return rows.withColumn("reason", reason).drop("closed")


def big_moves(obs: DataFrame, compounding: DataFrame, threshold: float = BIG_MOVE) -> DataFrame:
    """D6. Day-over-day changes with a robust z-score beyond the threshold.

    Scores use log changes where the series compounds (``compounding(series_id)``) and is positive throughout, else
    plain ones; the spread is the median absolute deviation, or the mean one where that is 0; the plain change is
    reported.
    """
    own = Window.partitionBy("series_id")
    rows = obs.filter("value IS NOT NULL").join(compounding.select("series_id", F.lit(True).alias("grows")), "series_id", "left")
    rows = rows.withColumn("logs", F.coalesce(F.col("grows"), F.lit(False)) & (F.min("value").over(own) > 0))
    before = F.lag("value").over(own.orderBy("date"))
    rows = rows.withColumn("rn", F.row_number().over(own.orderBy("date"))).withColumn("change", F.col("value") - before)
    rows = rows.withColumn("x", F.when(F.col("logs"), F.ln(F.when(F.col("logs"), F.col("value"))) - F.ln(F.when(F.col("logs"), before))).otherwise(F.col("change"))).filter("x IS NOT NULL")
    rows = rows.join(rows.groupBy("series_id").agg(F.median("x").alias("mid")), "series_id").withColumn("off", F.abs(F.col("x") - F.col("mid")))
    spread = rows.groupBy("series_id").agg(F.median("off").alias("mad"), F.avg("off").alias("mean_off"))
    scale = F.when(F.col("mad") > 0, 0.6745 / F.col("mad")).when(F.col("mean_off") > 0, 0.6745 / F.col("mean_off")).otherwise(0.0)
    rows = rows.join(spread, "series_id").withColumn("z", (F.col("x") - F.col("mid")) * scale)
    return rows.filter(F.abs("z") > threshold).select("series_id", "date", "rn", "change", "z")


def drop_rebounds(flags: DataFrame) -> DataFrame:
    """D7. A flagged day goes if the row before it is reported and moved the other way; a day that went does not
    suppress the next. Chains of opposite moves on neighbouring rows keep their 1st, 3rd, ... day."""
    w = Window.partitionBy("series_id").orderBy("rn")
    linked = (F.col("rn") == F.lag("rn").over(w) + 1) & (F.col("change") * F.lag("change").over(w) < 0)
    rows = flags.withColumn("opens", F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("chain", F.sum("opens").over(w)).withColumn("i", F.row_number().over(Window.partitionBy("series_id", "chain").orderBy("rn")))
    return rows.filter("i % 2 = 1").drop("opens", "chain", "i")


def alignment_report(aligned: DataFrame, lagged: DataFrame) -> DataFrame:
    """D8. Per target and signal: rows carried forward, and rows excluded (null after transform and lag)."""
    carried = aligned.groupBy("target_id", "series_id").agg(F.count_if(F.col("age").between(1, 3) & F.col("x").isNotNull()).alias("carried"))
    excluded = lagged.groupBy("target_id", "series_id").agg(F.count_if(F.col("x").isNull()).alias("excluded"))
    return carried.join(excluded, ["target_id", "series_id"])


def coverage_by_year(obs: DataFrame, calendar: DataFrame, series: DataFrame, limit: float = 0.2) -> DataFrame:
    """D9. Per series and year: share of calendar dates without a value, and whether it is over the limit. Dates with a value
    are counted and set against the year's number of dates."""
    days = calendar.select("date").distinct()
    years = days.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n_days"))
    held = obs.filter("value IS NOT NULL").select("series_id", "date").distinct().join(days, "date").groupBy("series_id", F.year("date").alias("year")).agg(F.count("*").alias("n_held"))
    rows = series.select("series_id").distinct().crossJoin(years).join(held, ["series_id", "year"], "left")  # a row per series and year
    return rows.select("series_id", "year", ((F.col("n_days") - F.coalesce("n_held", F.lit(0))) / F.col("n_days")).alias("missing")).withColumn("over", F.col("missing") > limit)


def dataset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """D10. Per series: dates in both or in one, share that differs, largest gap, ratio range, largest gap in the daily
    change over shared dates."""
    both = old.select("series_id", "date", F.col("value").alias("a")).join(new.select("series_id", "date", F.col("value").alias("b")), ["series_id", "date"], "full_outer")
    shared = F.col("a").isNotNull() & F.col("b").isNotNull()
    w = Window.partitionBy("series_id", "shared").orderBy("date")
    both = both.withColumn("shared", shared).withColumn("move", F.when(F.col("shared"), (F.col("a") - F.lag("a").over(w)) - (F.col("b") - F.lag("b").over(w))))
    differs = F.when(F.col("shared"), (F.col("a") != F.col("b")).cast("double"))
    ratio = F.when(F.col("shared"), F.col("b") / F.nullif("a", F.lit(0.0)))
    return both.groupBy("series_id").agg(
        F.count_if("shared").alias("both"), F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("only_old"), F.count_if(F.col("b").isNotNull() & F.col("a").isNull()).alias("only_new"),
        F.avg(differs).alias("share_differing"), F.max(F.when(F.col("shared"), F.abs(F.col("a") - F.col("b")))).alias("largest_gap"), F.min(ratio).alias("least_ratio"), F.max(ratio).alias("most_ratio"),
        F.max(F.abs("move")).alias("largest_move_gap"),
    )
