"""Calendars, as-of alignment, transforms, labels and folds. Everything is keyed by target and series."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_STALENESS = 3
#: Rows of a block in which ranges of rows are looked up.
BLOCK = 64


def target_calendar(prices: DataFrame) -> DataFrame:
    """E1. Dates on which a target has a price, numbered from 1."""
    w = Window.partitionBy("target_id").orderBy("date")
    return prices.filter("price IS NOT NULL").select("target_id", "date", "price", F.row_number().over(w).alias("rn"))


def asof_align(signals: DataFrame, calendar: DataFrame, pairs: DataFrame, max_staleness: int | None = MAX_STALENESS) -> DataFrame:
    """C3. Last value on or before each calendar date, null once older than ``max_staleness`` calendar rows.

    Calendar rows and observations are laid in one order by date and carried forward by window functions: one shuffle
    by (target, series). ``age`` is the number of calendar rows since the observation, 0 on the day itself.
    """
    spine = calendar.select("target_id", "date", "rn").join(pairs, "target_id").withColumn("value", F.lit(None).cast("double"))
    seen = signals.join(pairs, "series_id").select("target_id", "date", F.lit(None).cast("int").alias("rn"), "series_id", "value")
    w = Window.partitionBy("target_id", "series_id").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    laid = spine.unionByName(seen).withColumn("ncal", F.coalesce(F.max("rn").over(w), F.lit(0)))
    last = F.last(F.when(F.col("value").isNotNull(), F.struct("value", "ncal")), ignorenulls=True).over(w)
    laid = laid.withColumn("o", last).filter("rn IS NOT NULL").withColumn("age", F.col("rn") - F.col("o.ncal"))
    fresh = F.col("o.value") if max_staleness is None else F.when(F.col("age") <= max_staleness, F.col("o.value"))
    return laid.select("target_id", "series_id", "date", "rn", fresh.alias("x"), "age")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, known: str, values: list[str], strict: bool = False, tie: str | None = None) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` whose ``known`` is at or before ``at`` (``strict``: before it).

    Both sides are laid in one order per key and carried forward, so the cost is one shuffle and a sort, however many rows
    of ``right`` precede one of ``left``. Among rows of ``right`` known at the same time the greatest ``tie`` counts.
    """
    kinds = dict(right.dtypes)
    side = 0 if strict else 1
    none = F.lit(None).cast(kinds[tie]) if tie else F.lit(None)
    asked = left.select(*keys, F.col(at).alias("_at"), F.lit(side).alias("_side"), none.alias("_tie"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_value"))
    told = right.select(*keys, F.col(known).alias("_at"), F.lit(1 - side).alias("_side"), (F.col(tie) if tie else none).alias("_tie"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"), F.struct(*values).alias("_value"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = asked.unionByName(told.filter("_at IS NOT NULL")).withColumn("_o", F.last("_value", ignorenulls=True).over(w))
    return laid.filter("_row IS NOT NULL").select("_row.*", *[F.col("_o")[v].alias(v) for v in values])


def exact_align(signals: DataFrame, calendar: DataFrame, pairs: DataFrame) -> DataFrame:
    """C4. Same-date values only; nothing is carried."""
    return calendar.select("target_id", "date", "rn").join(pairs, "target_id").join(signals, ["series_id", "date"], "left").select("target_id", "series_id", "date", "rn", F.col("value").alias("x"))


def stationary(aligned: DataFrame, transforms: DataFrame) -> DataFrame:
    """E2. Level, difference or log return of x along the calendar, as column t."""
    before = F.lag("x").over(Window.partitionBy("target_id", "series_id").orderBy("rn"))
    rows = aligned.join(transforms, "series_id", "left").withColumn("before", before)
    logged = F.when((F.col("x") > 0) & (F.col("before") > 0), F.ln("x") - F.ln("before"))
    t = F.when(F.col("transform") == "LEVEL", F.col("x")).when(F.col("transform") == "LOG_RETURN", logged).otherwise(F.col("x") - F.col("before"))
    return rows.withColumn("t", t).drop("before", "transform")


def lag_signals(moved: DataFrame, rows: int = 1) -> DataFrame:
    """E3. Signals as known ``rows`` calendar rows ago."""
    w = Window.partitionBy("target_id", "series_id").orderBy("rn")
    return moved.select("target_id", "series_id", "date", "rn", F.lag("t", rows).over(w).alias("x"))


def forward_return(calendar: DataFrame, h: int) -> DataFrame:
    """E4. Return over the next ``h`` rows and the date on which it is known."""
    w = Window.partitionBy("target_id").orderBy("rn")
    return calendar.select("target_id", "rn", "date", "price", (F.lead("price", h).over(w) / F.col("price") - 1).alias("y"), F.lead("date", h).over(w).alias("label_end"))


def build_panel(prices: DataFrame, signals: DataFrame, transforms: DataFrame, pairs: DataFrame, h: int) -> tuple[DataFrame, DataFrame]:
    """E5. The long panel (target, series, date, rn, x) and its labels."""
    calendar = target_calendar(prices)
    return lag_signals(stationary(asof_align(signals, calendar, pairs), transforms)), forward_return(calendar, h)


def merge_factors(frame: DataFrame, factors: DataFrame) -> DataFrame:
    """C5. Factors of the same date; dates without factors stay, with nulls."""
    return frame.join(factors, "date", "left")


def factor_coverage(factors: DataFrame, calendar: DataFrame) -> DataFrame:
    """C6. Per target: first and last factor date, dates with factors, dates without."""
    dates = factors.select("date").distinct().withColumn("has", F.lit(True))
    span = factors.agg(F.min("date").alias("first_factor"), F.max("date").alias("last_factor"))
    counted = calendar.join(dates, "date", "left").groupBy("target_id").agg(F.count("has").alias("usable"), F.count_if(F.col("has").isNull()).alias("without"))
    return counted.join(span, how="cross")  # one row


def common_calendar(prices: DataFrame) -> DataFrame:
    """C7. Per group: dates on which all of its assets have a price. ``prices(group_id, asset, date, price)``."""
    priced = prices.filter("price IS NOT NULL")
    size = priced.groupBy("group_id").agg(F.count_distinct("asset").alias("n_assets"))
    return priced.groupBy("group_id", "date").agg(F.count_distinct("asset").alias("n")).join(size, "group_id").filter("n = n_assets").select("group_id", "date")


def asof_forecast(rebalances: DataFrame, forecasts: DataFrame) -> DataFrame:
    """C9. Latest forecast at or before each rebalance, however old. Keyed by target_id."""
    both = rebalances.select("target_id", "date", F.lit(True).alias("due"), F.lit(None).cast("double").alias("predicted")).unionByName(
        forecasts.filter("predicted IS NOT NULL").select("target_id", "date", F.lit(None).cast("boolean").alias("due"), "predicted")
    )
    w = Window.partitionBy("target_id").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("o", F.last(F.when(F.col("predicted").isNotNull(), F.struct("predicted", F.col("date").alias("made"))), ignorenulls=True).over(w))
    return carried.filter("due").select("target_id", "date", "o.predicted", "o.made")


def rows_in_ranges(rows: DataFrame, ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows(target_id, rn, ..)`` of each of ``ranges(target_id, lo, hi, ..)``: an equi-join on target and block of ``block``
    rows, so that a row is tested only against the ranges that reach its block."""
    blocks = F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block)))
    r = ranges.filter("lo <= hi").withColumn("_block", blocks)
    laid = rows.withColumn("_block", F.floor(F.col("rn") / block))
    return laid.join(r, ["target_id", "_block"]).filter("rn BETWEEN lo AND hi").drop("_block", "lo", "hi")


def rows_in_fold(panel: DataFrame, folds: DataFrame, part: str = "train") -> DataFrame:
    """C10. Panel rows of each fold's train or test range. Aggregate right after: a row falls into TRAIN / TEST folds."""
    return rows_in_ranges(panel, folds.select("target_id", "fold_id", F.col(f"{part}_lo").alias("lo"), F.col(f"{part}_hi").alias("hi")))


def pairs_known_by(outcomes: DataFrame, rebalances: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """C11. Per portfolio and rebalance: n, the outcomes whose label ended before it, and sums over them. Rebalances
    before the first known outcome are left out.

    What is known only grows, so sums run over the outcomes in order of their label ends and each rebalance takes the
    last one's: linear in outcomes and rebalances.
    """
    so_far = Window.partitionBy("portfolio_id").orderBy("label_end").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = outcomes.filter("label_end IS NOT NULL").select("portfolio_id", "label_end", F.count("*").over(so_far).alias("n"), *[F.sum(c).over(so_far).alias(k) for k, c in sums.items()])
    due = rebalances.select("portfolio_id", F.col("date").alias("rebalance"))
    return asof(due, running, ["portfolio_id"], "rebalance", "label_end", ["n", *sums], strict=True).filter("n IS NOT NULL")


def clip_standardise(rows: DataFrame, width: float = 4.0) -> DataFrame:
    """B7. Per (target, fold, series): x clipped to mean +/- width sd of the training rows, then standardised.

    ``rows(target_id, fold_id, series_id, rn, x, part)`` with part train or test.
    """
    train = F.when(F.col("part") == "train", F.col("x"))
    w = Window.partitionBy("target_id", "fold_id", "series_id")
    rows = rows.withColumn("m", F.avg(train).over(w)).withColumn("s", F.stddev_samp(train).over(w))
    clipped = F.least(F.greatest(F.col("x"), F.col("m") - width * F.col("s")), F.col("m") + width * F.col("s"))
    z = (F.when(F.col("x").isNotNull(), F.coalesce(clipped, F.col("x"))) - F.col("m")) / F.coalesce(F.nullif("s", F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("z", z).drop("m", "s")


def polynomial_features(frame: DataFrame, inputs: list[str], degree: int) -> DataFrame:
    """B8. All monomials of the inputs of degree 1 to ``degree``, as columns like ``a*a*b``."""
    for d in range(2, degree + 1):
        for names in combinations_with_replacement(inputs, d):
            frame = frame.withColumn("*".join(names), reduce(lambda a, b: a * b, [F.col(n) for n in names]))
    return frame


def shape_feature(frame: DataFrame, expression: str, bindings: dict[str, str], name: str = "f") -> DataFrame:
    """B9. A user's arithmetic over bound columns: null in, null out; a value that is not finite with all inputs there
    becomes null and is marked in ``{name}_error``."""
    bound = frame.select("*", *[F.col(c).alias(k) for k, c in bindings.items()])
    value = F.expr(f"CAST(({expression}) AS DOUBLE)")
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in bindings])
    bound = bound.withColumn("_v", F.when(whole, value))
    odd = whole & (F.col("_v").isNull() | F.isnan("_v") | (F.abs("_v") == float("inf")))
    return bound.withColumn(name, F.when(~odd, F.col("_v"))).withColumn(f"{name}_error", odd).drop("_v", *bindings)


def complete_rows(panel: DataFrame, labels: DataFrame, n_signals: int) -> DataFrame:
    """B10. (target, rn) with every signal and the label present."""
    full = panel.groupBy("target_id", "rn").agg(F.count("x").alias("n")).filter(F.col("n") == n_signals).select("target_id", "rn")
    return labels.filter("y IS NOT NULL").join(full, ["target_id", "rn"], "left_semi")


def label_window_calendar(calendar: DataFrame, h: int) -> DataFrame:
    """E6. Per row, month ends, month starts and first-week Fridays among the next ``h`` rows."""
    w = Window.partitionBy("target_id").orderBy("rn")
    month = F.trunc("date", "month")
    flags = {
        "month_ends": F.lead(month).over(w) != month,
        "month_starts": F.lag(month).over(w) != month,
        "first_fridays": (F.weekday("date") == 4) & (F.dayofmonth("date") <= 7),
    }
    ahead = w.rowsBetween(1, h)
    rows = calendar.select("target_id", "date", "rn", *[F.coalesce(f, F.lit(False)).cast("int").alias(n) for n, f in flags.items()])
    return rows.select("target_id", "date", "rn", *[F.when(F.count("rn").over(ahead) == h, F.sum(n).over(ahead)).alias(n) for n in flags])


def label_window_moves(levels: DataFrame, lag: int, h: int) -> DataFrame:
    """E7. Move of the level over the label window, read from a panel lagged by ``lag`` rows, and the date of its end."""
    w = Window.partitionBy("target_id", "series_id").orderBy("rn")
    return levels.select("target_id", "series_id", "date", "rn", (F.lead("x", lag + h).over(w) - F.lead("x", lag).over(w)).alias("move"), F.lead("date", lag + h).over(w).alias("move_end"))


def level_and_change(aligned: DataFrame, transforms: DataFrame) -> DataFrame:
    """E8. The transformed series, and for each differenced one also its level as ``{series}_level``."""
    moved = stationary(aligned, transforms).select("target_id", "series_id", "date", "rn", "t")
    kept = aligned.join(transforms.filter("transform = 'DIFFERENCE'"), "series_id", "left_semi")
    return moved.unionByName(kept.select("target_id", F.concat("series_id", F.lit("_level")).alias("series_id"), "date", "rn", F.col("x").alias("t")))


def ensemble_inputs(aligned: DataFrame, transforms: DataFrame, calendar: DataFrame, h: int) -> DataFrame:
    """E8. Every input of the ensemble's members: E8's series lagged by one row, and E6's calendar counts, which are known
    ahead and not lagged, as series of their own."""
    counts = label_window_calendar(calendar, h).unpivot(["target_id", "date", "rn"], ["month_ends", "month_starts", "first_fridays"], "series_id", "x")
    lagged = lag_signals(level_and_change(aligned, transforms))
    return lagged.select("target_id", "series_id", "date", "rn", "x").unionByName(counts.withColumn("x", F.col("x").cast("double")))


def walk_forward_folds(calendar: DataFrame, train: int, test: int, embargo: int, tuning: int = 0, expanding: bool = False, cap: int | None = None) -> DataFrame:
    """E9, E10. Test windows of ``test`` rows after the first training rows; training rows end ``embargo`` rows before.

    ``expanding`` trains on all earlier rows, ``cap`` on the latest ``cap`` of them.
    """
    start = max(train, tuning) + embargo
    sizes = calendar.groupBy("target_id").agg(F.floor((F.count("*") - start) / test).cast("int").alias("n")).filter("n > 0")
    lo = F.lit(start + 1) + test * F.col("fold_id")
    first = lo - embargo - train if not expanding else F.lit(1)
    if cap is not None:
        first = F.greatest(F.lit(1), lo - embargo - cap)
    folds = sizes.select("target_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("fold_id"))
    return folds.select("target_id", "fold_id", first.alias("train_lo"), (lo - 1 - embargo).alias("train_hi"), lo.alias("test_lo"), (lo + test - 1).alias("test_hi"))


def purge(folds: DataFrame, labels: DataFrame, h: int) -> DataFrame:
    """E11. Training ends before the first row whose label is not known when the test window opens, and at least
    ``h`` rows before it. Label ends never go back from one row to the next."""
    opens = labels.select("target_id", F.col("rn").alias("test_lo"), F.col("date").alias("opens"))
    f = asof(folds.join(opens, ["target_id", "test_lo"]), labels.select("target_id", "label_end", F.col("rn").alias("known")), ["target_id"], "opens", "label_end", ["known"], strict=True, tie="known")
    ends = F.least(F.col("train_hi"), F.col("test_lo") - 1 - h, F.greatest(F.coalesce("known", F.lit(0)), F.col("train_lo") - 1))
    return f.withColumn("train_hi", ends).select(*folds.columns)


def too_short(calendar: DataFrame, train: int, test: int, embargo: int, tuning: int = 0) -> DataFrame:
    """E12. Targets without a single fold, with the rows they have and need."""
    need = max(train, tuning) + embargo + test
    return calendar.groupBy("target_id").agg(F.count("*").alias("have")).withColumn("need", F.lit(need)).filter("have < need")


def retune_schedule(folds: DataFrame, test: int, every: int = 252) -> DataFrame:
    """E13. Each fold's tuning period, and whether the fold opens it."""
    per = -(-every // test)
    return folds.select("target_id", "fold_id", F.floor(F.col("fold_id") / per).cast("int").alias("tuning_id"), (F.col("fold_id") % per == 0).alias("retunes"))


def every_hth(rows: DataFrame, key: str, order: str, h: int) -> DataFrame:
    """E14. Every h-th row of a key from its first."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") - 1) % h == 0).drop("_n")


def month_end_dates(calendar: DataFrame) -> DataFrame:
    """E15. Last calendar date of each month."""
    return calendar.groupBy("target_id", F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date")).drop("month")


def autocorr_overlap(labels: DataFrame) -> DataFrame:
    """E16. 1 / (1 - lag-1 autocorrelation) of the labels, between 1 and 63."""
    w = Window.partitionBy("target_id").orderBy("rn")
    rows = labels.filter("y IS NOT NULL").withColumn("before", F.lag("y").over(w))
    rho = rows.groupBy("target_id").agg(F.corr("y", "before").alias("rho"))
    return rho.select("target_id", F.when(F.col("rho") >= 1, 63.0).otherwise(F.least(F.greatest(1 / (1 - F.col("rho")), F.lit(1.0)), F.lit(63.0))).alias("overlap"))
