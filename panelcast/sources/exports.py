"""Vendor exports and factor files as long tables, and canonical output.

A bad file goes to a quarantine table with its reason and does not stop the others.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Median day steps that fit a period.
PERIOD_STEPS = {"D": (1, 7), "W": (5, 9), "M": (25, 35), "Q": (80, 100), "S": (170, 195), "Y": (350, 380), "A": (350, 380)}
MISSING = ("", "#N/A N/A", "#N/A")
#: A comma outside quotes.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _cells(line: str) -> Column:
    return F.transform(F.split(line, _COMMA), lambda c: F.btrim(F.trim(c), F.lit('"')))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of all text files under a path: file is its path, pos in the order of its lines.

    Files are read line by line, in blocks, so no file has to fit one row or one task. Lines of a block have ids in a row, so
    a line's place is its distance from the block's first id, after the lines of the file's blocks before, which are
    counted; lines are neither sorted nor moved for it.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    blocks = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    lines = raw.join(blocks, ["file", "block"])
    return lines.select("file", (F.col("start") + F.col("at") - F.col("first")).alias("pos"), F.regexp_replace("line", "^\\uFEFF|\r$", "").alias("line"))


def _with_header(lines: DataFrame) -> DataFrame:
    head = lines.filter(F.lower("line").startswith("date,")).groupBy("file").agg(F.min(F.struct("pos", "line")).alias("h"))
    return lines.join(head.select("file", F.col("h.pos").alias("head_pos"), _cells("h.line").alias("head")), "file", "left")


def read_exports(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A1. Metadata (file, key, value), the first value of a lower-cased key, and cells (file, pos, date_text, field,
    text) below the ``Date,`` row."""
    rows = _with_header(lines)
    above = rows.filter((F.col("pos") < F.col("head_pos")) & F.contains("line", F.lit(",")))
    key = F.lower(F.trim(F.split_part("line", F.lit(","), F.lit(1))))
    meta = above.select("file", key.alias("key"), F.trim(F.rtrim(F.expr("substr(line, instr(line, ',') + 1)"), F.lit(","))).alias("value"), "pos")
    meta = meta.filter("key <> ''").groupBy("file", "key").agg(F.min_by("value", "pos").alias("value"))
    below = rows.filter((F.col("pos") > F.col("head_pos")) & (F.trim(F.regexp_replace("line", ",", "")) != "")).withColumn("cells", _cells("line"))
    cells = below.select("file", "pos", F.trim(F.get("cells", F.lit(0))).alias("date_text"), F.posexplode("head").alias("i", "field"), "cells").filter("i > 0 AND trim(field) <> ''")
    return meta, cells.select("file", "pos", "date_text", F.trim("field").alias("field"), F.trim(F.get("cells", F.col("i"))).alias("text"))


def overlong_rows(lines: DataFrame) -> DataFrame:
    """A4. Rows with a cell that is not empty beyond the header's width."""
    rows = _with_header(lines).filter(F.col("pos") > F.col("head_pos")).withColumn("cells", _cells("line"))
    width = F.size("head")
    beyond = F.exists(F.slice("cells", width + 1, F.greatest(F.size("cells"), F.lit(1))), lambda c: F.trim(c) != "")
    return rows.filter((F.size("cells") > width) & beyond).select("file", (F.col("pos") + 1).alias("line_number"))


#: Fixed format: a date of two numbers and a year of four digits, with one separator, perhaps a time.
_NUMERIC_DATE = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})([ T]\d{2}:\d{2}(:\d{2})?)?$"


def _readings(text: Column) -> dict[str, Column]:
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.to_date(F.try_to_timestamp(F.regexp_extract(text, r"^\d{4}-\d{1,2}-\d{1,2}", 0), F.lit("y-M-d"))))
    plain = F.when(text.rlike(_NUMERIC_DATE), F.concat_ws("/", *[F.regexp_extract(text, _NUMERIC_DATE, i) for i in (1, 3, 4)]))
    return {"month_first": F.coalesce(iso, F.to_date(F.try_to_timestamp(plain, F.lit("M/d/y")))), "day_first": F.coalesce(iso, F.to_date(F.try_to_timestamp(plain, F.lit("d/M/y"))))}


def settle_date_order(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """A2. One reading per file: a date that only one reading can be settles it, else the start and end dates, else the
    median step that fits the period; otherwise the file is rejected. Returns file, reading, reason.

    A start or end date written like the data is read the same way, and rules out a reading in which it is no date;
    written in any other way it is read as ISO, and is no evidence where it is not. Evidence that rules out both
    readings, or neither, is passed over.
    """
    names = ("month_first", "day_first")
    dates = cells.select("file", "date_text").distinct()
    both = dates.select("file", *[c.alias(n) for n, c in _readings(F.trim("date_text")).items()])
    # rows without a reading stay, so no filter on a reading is pushed below what made the cells and run on its rows
    step = {n: F.nullif(F.datediff(n, F.lag(n).over(Window.partitionBy("file").orderBy(n))), F.lit(0)) for n in names}
    rows = both.withColumns({f"step_{n}": c for n, c in step.items()}).groupBy("file").agg(
        F.count("*").alias("n"), F.count_if(F.col("month_first") != F.col("day_first")).alias("open"),
        *[f(n).alias(f"{k}_{n}") for n in names for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))], *[F.median(f"step_{n}").alias(f"step_{n}") for n in names],
    )
    known = meta.groupBy("file").agg(*[F.first(F.when(F.col("key") == k, F.col("value")), ignorenulls=True).alias(k) for k in ("start date", "end date", "period")])
    rows = rows.join(known, "file", "left")
    whole = {n: F.coalesce(F.col(f"n_{n}") == F.col("n"), F.lit(False)) for n in names}
    bound, fits = {}, {}
    for n in names:
        inside = []
        for line, ok in (("start date", lambda d: F.col(f"lo_{n}") >= d), ("end date", lambda d: F.col(f"hi_{n}") <= d)):  # noqa: B023
            text = F.trim(F.col(line))
            inside.append(F.coalesce(ok(_readings(text)[n]), ~F.coalesce(text.rlike(_NUMERIC_DATE), F.lit(False))))
        bound[n] = whole[n] & inside[0] & inside[1]
        cases = F.lit(False)
        for p, (a, b) in PERIOD_STEPS.items():
            cases = cases | ((F.upper(F.substring("period", 1, 1)) == p) & F.col(f"step_{n}").between(a, b))
        fits[n] = whole[n] & F.coalesce(cases, F.lit(False))
    m, d = names
    reading = (
        F.when(whole[m] & whole[d] & (F.col("open") == 0), m).when(whole[m] & ~whole[d], m).when(whole[d] & ~whole[m], d)
        .when(bound[m] & ~bound[d], m).when(bound[d] & ~bound[m], d).when(fits[m] & ~fits[d], m).when(fits[d] & ~fits[m], d)
    )
    reason = F.when(~whole[m] & ~whole[d], "unreadable dates").when(reading.isNull(), "ambiguous dates")
    return rows.select("file", reading.alias("reading"), reason.alias("reason"))


def ungroup_numbers(cells: DataFrame) -> DataFrame:
    """A3. Values as doubles. Separators of thousands go only from a column in which every value is a number and some
    value has a point or two separators; cells marked missing are null."""
    text = F.when(~F.col("text").isin(*MISSING), F.col("text"))
    rows = cells.withColumn("text", text)
    grouped = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"
    number = F.col("text").rlike(r"^[+-]?(\d+|\d{1,3}(,\d{3})+)(\.\d*)?([eE][+-]?\d+)?$")
    ok = rows.groupBy("file", "field").agg(
        F.coalesce(F.bool_and(number), F.lit(True)).alias("all_numbers"), F.coalesce(F.bool_or(F.col("text").rlike(grouped) & (F.contains("text", F.lit(".")) | (F.length("text") - F.length(F.regexp_replace("text", ",", "")) >= 2))), F.lit(False)).alias("sure")
    )
    rows = rows.join(ok, ["file", "field"])
    plain = F.when(F.col("all_numbers") & F.col("sure"), F.regexp_replace("text", ",", "")).otherwise(F.col("text"))
    return rows.withColumn("value", plain.try_cast("double")).drop("all_numbers", "sure")


def reject_unnamed(meta: DataFrame, cells: DataFrame) -> DataFrame:
    """A5. Files with several data columns but no security."""
    named = meta.filter("key = 'security' AND value <> ''").select("file")
    return cells.groupBy("file").agg(F.count_distinct("field").alias("fields")).filter("fields > 1").join(named, "file", "left_anti").withColumn("reason", F.lit("no security"))


def observations(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A1 to A5 in one: obs(file, field, date, value, pos) of the good files, and the quarantine (file, reason)."""
    meta, cells = read_exports(lines)
    order = settle_date_order(cells, meta)
    bad = order.filter("reading IS NULL").select("file", "reason").union(reject_unnamed(meta, cells).select("file", "reason"))
    bad = bad.union(overlong_rows(lines).select("file", F.lit("row beyond the header")).distinct())
    good = ungroup_numbers(cells).join(order.filter("reading IS NOT NULL").select("file", "reading"), "file").join(bad.select("file").distinct(), "file", "left_anti")
    r = _readings(F.col("date_text"))
    date = F.when(F.col("reading") == "month_first", r["month_first"]).otherwise(r["day_first"])
    return good.select("file", "field", date.alias("date"), "value", "pos"), bad


def read_factor_table(lines: DataFrame, start: str, end: str) -> DataFrame:
    """A6. Daily factors (date, factor, value) from a file with prose around the table, within a span of dates."""
    head = lines.filter(F.contains("line", F.lit("Mkt-RF"))).groupBy("file").agg(F.min_by(F.split("line", ","), "pos").alias("head"))
    rows = lines.filter(F.col("line").rlike(r"^\s*\d{8}\s*,")).withColumn("cells", F.split("line", ",")).join(head, "file")
    rows = rows.withColumn("date", F.to_date(F.try_to_timestamp(F.trim(F.get("cells", F.lit(0))), F.lit("yyyyMMdd")))).filter(F.col("date").between(start, end))
    long = rows.select("date", "cells", F.posexplode("head").alias("i", "factor")).filter("i > 0")
    return long.select("date", F.trim("factor").alias("factor"), F.trim(F.get("cells", F.col("i"))).try_cast("double").alias("value"))


def write_canonical(df: DataFrame, path: str) -> None:
    """A7. Canonical CSV: ISO dates, no index."""
    df.write.csv(path, header=True, dateFormat="yyyy-MM-dd", lineSep="\n")


def _six_places(value: str) -> Column:
    """``%.6f``, but a value half-way between two texts goes to the one nearer zero; null stays null."""
    half = F.abs(value).try_cast("decimal(38,18)") % F.lit(Decimal("0.000001")) == F.lit(Decimal("0.0000005"))
    off = F.when(half, F.col(value) - F.signum(value) * 2e-7).otherwise(F.col(value))
    return F.when(F.col(value).isNotNull(), F.format_string("%.6f", off))


def dataset_hash(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A7. Identity of ``obs(series_id, date, value)`` that does not depend on row order: hashes of rows are joined in
    order per series and month, and those again per series. Lists are bounded by a month and by the months."""
    keys = keys or ["series_id"]
    text = F.concat_ws(",", *keys, F.col("date").cast("string"), F.coalesce(_six_places("value"), F.lit("")))
    months = obs.groupBy(*keys, F.date_format("date", "yyyy-MM").alias("month")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2(text, 256))), ""), 256).alias("h"))
    return months.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("month", "h"))), ""), 256).alias("content_hash"))


def dataset_fingerprint(obs: DataFrame) -> DataFrame:
    """A8. Rows, span, series and content hash per series: a change means stale results."""
    per = obs.groupBy("series_id").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return per.join(dataset_hash(obs), "series_id")


def export_merged(wide: DataFrame) -> DataFrame:
    """A9. Wide rows with dd/mm/yyyy dates, in date order."""
    return wide.orderBy("date").withColumn("date", F.date_format("date", "dd/MM/yyyy"))


def date_range(rows: DataFrame, text: str) -> DataFrame:
    """A11. First and last readable ISO date of a text column."""
    d = F.to_date(F.try_to_timestamp(F.col(text), F.lit("yyyy-MM-dd")))
    return rows.agg(F.min(d).alias("first_date"), F.max(d).alias("last_date"), F.count_if(d.isNull()).alias("unreadable"))


def append_log(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """A10. Append rows to a Parquet log."""
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
