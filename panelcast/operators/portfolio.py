"""Weights from forecasts, backtests and performance. Everything is keyed by portfolio.

Two-asset inputs are wide: ``equity`` and ``bond`` columns; schedules and returns are long: a row per asset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.panel import MAX_STALENESS, asof, asof_align
from panelcast.operators.scoring import growing_fits, overlap_se, significance

YEAR = 252
BOUNDS = (0.2, 0.8)
LEVELS = (1, 2, 3, 4, 5)
PRIOR_DAYS, PRIOR_PREMIUM = 30 * 252, 0.066 / 252
LEAST_TRUST_PAIRS, TRUST_T = 252, 2.0


def _none(c: Column | str) -> Column:
    return F.nullif(c if isinstance(c, Column) else F.col(c), F.lit(0.0))


def daily_returns(prices: DataFrame) -> DataFrame:
    """Returns of ``prices(portfolio_id, asset, date, price)`` over the dates that all assets of the portfolio have."""
    size = prices.filter("price IS NOT NULL").groupBy("portfolio_id").agg(F.count_distinct("asset").alias("n"))
    common = prices.filter("price IS NOT NULL").groupBy("portfolio_id", "date").agg(F.count_distinct("asset").alias("n")).join(size, ["portfolio_id", "n"], "left_semi")
    rows = prices.join(common.select("portfolio_id", "date"), ["portfolio_id", "date"])
    before = F.lag("price").over(Window.partitionBy("portfolio_id", "asset").orderBy("date"))
    return rows.withColumn("r", F.col("price") / before - 1).select("portfolio_id", "asset", "date", "r")


def joint_calendar_returns(prices: DataFrame, starts: DataFrame, most: int = MAX_STALENESS) -> DataFrame:
    """C8. Daily returns on the union of a portfolio's calendars, from its first rebalance (``starts(portfolio_id, first)``)
    to the last day on which all of its assets have a price.

    A closed day carries the last price, so its return is 0 and the move lands on the next open day; the first row's
    return is 0. A price older than ``most`` rows is a gap in the data and no holiday: ``gap`` marks the row, and returns
    that would need its price are null, so that no flat market is invented.
    """
    priced = prices.filter("price IS NOT NULL")
    last = priced.groupBy("portfolio_id", "asset").agg(F.max("date").alias("b")).groupBy("portfolio_id").agg(F.min("b").alias("last"))
    dates = priced.select("portfolio_id", "date").distinct().join(last, "portfolio_id").join(starts.select("portfolio_id", "first"), "portfolio_id").filter("date BETWEEN first AND last")
    w = Window.partitionBy("portfolio_id").orderBy("date")
    calendar = dates.select(F.col("portfolio_id").alias("target_id"), "date", F.row_number().over(w).alias("rn"))
    series = F.struct("portfolio_id", "asset").alias("series_id")
    pairs = priced.select(F.col("portfolio_id").alias("target_id"), series).distinct()
    level = asof_align(priced.select(series, "date", F.col("price").alias("value")), calendar, pairs, most)
    own = Window.partitionBy("series_id").orderBy("date")
    r = F.when(F.col("rn") == 1, F.when(F.col("x").isNotNull(), 0.0)).otherwise(F.col("x") / F.lag("x").over(own) - 1)
    return level.select("series_id.portfolio_id", "series_id.asset", "date", r.alias("r"), (F.coalesce(F.col("age"), F.lit(0)) > 0).alias("closed"), F.col("x").isNull().alias("gap"))


def check_schedule(weights: DataFrame, assets: DataFrame, dates: DataFrame) -> DataFrame:
    """J1. Faults of ``weights(portfolio_id, date, asset, weight)``: a row per rebalance that has one."""
    size = assets.groupBy("portfolio_id").agg(F.count_distinct("asset").alias("n_assets"))
    on = dates.select("portfolio_id", "date").distinct().withColumn("on_calendar", F.lit(True))
    rows = weights.groupBy("portfolio_id", "date").agg(F.sum("weight").alias("total"), F.count("*").alias("n"), F.count_distinct("asset").alias("named"))
    rows = rows.join(size, "portfolio_id", "left").join(on, ["portfolio_id", "date"], "left")
    fault = (
        F.when(F.col("n") > F.col("named"), "repeated").when(F.col("named") < F.col("n_assets"), "asset missing")
        .when(F.coalesce(F.abs(F.col("total") - 1) > 1e-9, F.lit(True)), "does not sum to 1").when(F.col("on_calendar").isNull(), "not a trading day")
    )
    return rows.withColumn("fault", fault).filter("fault IS NOT NULL").select("portfolio_id", "date", "fault")


def drifted_weights(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """J2. Weights left to drift between rebalances, in closed form.

    The segment of a row is the number of rebalances strictly before it; within a segment an asset is worth its target
    weight times its compounded return, and the drifted weight is its part of the sum.
    """
    rows = returns.join(weights, ["portfolio_id", "asset", "date"], "left")
    w = Window.partitionBy("portfolio_id", "asset").orderBy("date")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("seg", F.count("weight").over(before)).withColumn("w0", F.last("weight", ignorenulls=True).over(before))
    held = F.product(1 + F.coalesce(F.col("r"), F.lit(0.0))).over(Window.partitionBy("portfolio_id", "asset", "seg").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("g", F.when(F.col("seg") > 0, F.col("w0") * held))
    rows = rows.withColumn("v", F.sum("g").over(Window.partitionBy("portfolio_id", "date")))
    return rows.select("portfolio_id", "asset", "date", "seg", "weight", "v", F.coalesce(F.col("g") / F.col("v"), F.lit(0.0)).alias("drifted"))


def portfolio_path(returns: DataFrame, weights: DataFrame, costs: DataFrame) -> DataFrame:
    """J3. Per day from the first rebalance on: gross and net return, turnover and cost.

    ``costs(asset, bps)``. A rebalance trades after the day's return; the first one's cost falls on the first return day.
    """
    rows = drifted_weights(returns, weights).join(costs, "asset")
    traded = F.abs(F.col("weight") - F.col("drifted"))
    days = rows.groupBy("portfolio_id", "date").agg(
        F.max("seg").alias("seg"), F.max("v").alias("v"), F.count("weight").alias("named"), F.coalesce(F.sum(traded), F.lit(0.0)).alias("turnover"),
        F.coalesce(F.sum(traded * F.col("bps") / 1e4), F.lit(0.0)).alias("cost"),
    )
    gross = F.col("v") / F.coalesce(F.lag("v").over(Window.partitionBy("portfolio_id", "seg").orderBy("date")), F.lit(1.0)) - 1
    w = Window.partitionBy("portfolio_id").orderBy("date")
    days = days.withColumn("gross", F.when(F.col("seg") > 0, gross)).filter("seg > 0 OR named > 0")
    opening = F.when(F.row_number().over(w) == 2, F.lag("cost").over(w)).otherwise(0.0)
    own = F.when(F.row_number().over(w) == 1, 0.0).otherwise(F.col("cost"))
    return days.withColumn("net", (1 + F.col("gross")) * (1 - own) * (1 - opening) - 1).select("portfolio_id", "date", "gross", "net", "turnover", "cost")


def month_end_weights(returns: DataFrame, start: DataFrame) -> DataFrame:
    """J4. The equal-weight benchmark's schedule: at the portfolio's first date and at each month's last date."""
    dates = returns.select("portfolio_id", "date").distinct().join(start, "portfolio_id").filter("date >= first")
    ends = dates.groupBy("portfolio_id", F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date")).select("portfolio_id", "date")
    due = ends.union(start.select("portfolio_id", F.col("first").alias("date"))).distinct()
    assets = returns.select("portfolio_id", "asset").distinct()
    n = F.count("*").over(Window.partitionBy("portfolio_id"))
    return due.join(assets.withColumn("weight", 1 / n), "portfolio_id").select("portfolio_id", "date", "asset", "weight")


def drawdown(returns: DataFrame, keys: list[str]) -> DataFrame:
    """J7. Wealth over its running peak less 1; the starting value is the first peak."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = returns.filter("r IS NOT NULL").withColumn("wealth", F.product(1 + F.col("r")).over(w))
    return rows.withColumn("drawdown", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(w)) - 1)


def performance(returns: DataFrame, keys: list[str]) -> DataFrame:
    """J6. Annual return, volatility, Sharpe, Sortino, Calmar and largest drawdown of daily returns r.

    A ratio with a zero denominator is null; a series that never varies has volatility 0 and no Sharpe ratio.
    """
    r = F.col("r")
    varies = (F.count("r") > 1) & (F.min("r") < F.max("r"))
    out = drawdown(returns, keys).groupBy(*keys).agg(
        F.count("r").alias("days"), F.product(1 + r).alias("growth"), F.avg("r").alias("mean"), F.when(varies, F.stddev_samp("r")).alias("sd"),
        F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2))).alias("downside"), F.min("drawdown").alias("worst"),
    )
    annual = F.pow("growth", YEAR / F.col("days")) - 1
    root = float(YEAR) ** 0.5
    return out.select(
        *keys, "days", annual.alias("annual_return"), F.coalesce(F.col("sd") * root, F.lit(0.0)).alias("annual_volatility"), (F.col("mean") * root / F.col("sd")).alias("sharpe"),
        (F.col("mean") * root / _none("downside")).alias("sortino"), (annual / _none(F.abs(F.least("worst", F.lit(0.0))))).alias("calmar"), F.least("worst", F.lit(0.0)).alias("max_drawdown"),
    )


def rolling(returns: DataFrame, keys: list[str], vol_days: int = 63, sharpe_days: int = 252) -> DataFrame:
    """J8, J9. Annualised rolling volatility and Sharpe ratio; null until a window is full."""
    w = Window.partitionBy(*keys).orderBy("date")
    a, b = w.rowsBetween(1 - vol_days, 0), w.rowsBetween(1 - sharpe_days, 0)
    root = float(YEAR) ** 0.5
    varied = (F.count("r").over(b) == sharpe_days) & (F.min("r").over(b) < F.max("r").over(b))
    return returns.filter("r IS NOT NULL").select(
        *keys, "date", F.when(F.count("r").over(a) == vol_days, F.stddev_samp("r").over(a) * root).alias("volatility"),
        F.when(varied, F.avg("r").over(b) / F.stddev_samp("r").over(b) * root).alias("sharpe"),
    )


def relative(both: DataFrame, keys: list[str]) -> DataFrame:
    """J10. Tracking error, information ratio and Newey-West t of the mean difference of ``both(date, r, base)``.

    The lags follow from the number of days, floor(4 (n / 100)^(2/9)). The Bartlett variance with L lags is the sum of
    squares of all sums over L + 1 successive days (those that reach over the ends included), divided by L + 1: one window
    per key, whose frame is a range over the day's number in units of L + 1/2.
    """
    own = Window.partitionBy(*keys)
    ordered = own.orderBy("date")
    rows = both.withColumn("d", F.col("r") - F.col("base")).filter("d IS NOT NULL")
    rows = rows.withColumns({"i": F.row_number().over(ordered), "e": F.col("d") - F.avg("d").over(own), "n": F.count("*").over(own)})
    rows = rows.withColumn("lags", F.floor(4 * F.pow(F.col("n") / 100, 2 / 9)).cast("int"))
    reach = f"sum(e) OVER (PARTITION BY {', '.join(keys)} ORDER BY i / (lags + 0.5D) RANGE BETWEEN 1.0D PRECEDING AND CURRENT ROW)"
    rows = rows.withColumns({"before": F.expr(reach), "after": F.sum("e").over(own) - F.sum("e").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("e")})
    square = F.pow("before", F.lit(2)) + F.when(F.col("i") > F.col("n") - F.col("lags"), F.pow("after", F.lit(2))).otherwise(0.0)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("days"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("lags").alias("lags"),
        (F.sum(square) / (F.max("lags") + 1)).alias("s"),
    )
    error = F.col("sd") * float(YEAR) ** 0.5
    t = F.when((F.col("days") >= 3) & (F.col("lo") < F.col("hi")) & (F.col("s") > 0), F.col("mean") / (F.sqrt("s") / F.col("days")))
    return out.select(*keys, "days", error.alias("tracking_error"), (F.col("mean") * YEAR / _none(error)).alias("information_ratio"), t.alias("spread_t"), "lags")


def cumulative(returns: DataFrame, keys: list[str]) -> DataFrame:
    """J11. Compounded return to date."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return returns.filter("r IS NOT NULL").select(*keys, "date", (F.product(1 + F.col("r")).over(w) - 1).alias("cumulative"))


def comparison_table(metrics: DataFrame, names: list[str]) -> DataFrame:
    """J12. ``metrics(portfolio_id, kind, ...)`` with kinds optimised and benchmark, as a row per metric."""
    pairs = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in names)
    long = metrics.select("portfolio_id", "kind", F.expr(f"stack({len(names)}, {pairs}) AS (metric, value)"))
    wide = long.groupBy("portfolio_id", "metric").pivot("kind", ["optimised", "benchmark"]).agg(F.first("value"))
    return wide.withColumn("difference", F.col("optimised") - F.col("benchmark"))


def _business_days_on(day: Column, h: int) -> Column:
    """The date ``h`` business days after a day; a weekend counts as its Friday."""
    from_monday = F.least(F.weekday(day), F.lit(4))
    ahead = from_monday + h
    return F.date_add(F.date_sub(day, F.weekday(day)), (F.floor(ahead / 5) * 7 + ahead % 5).cast("int"))


def directional_steps(forecasts: DataFrame, h: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """J14's steps: every ``h``-th row with an outcome, from the first inside the window (both ends included), with its place
    among them, whether it is invested, and the date it is held until: ``h`` of the forecast's dates later, or ``h``
    business days where those run out. ``days`` counts the window's rows with an outcome."""
    own = Window.partitionBy("target_id").orderBy("date")
    rows = forecasts.withColumn("held_until", F.coalesce(F.lead("date", h).over(own), _business_days_on(F.col("date"), h))).filter("realised IS NOT NULL")
    for bound, inside in ((start, F.col("date") >= F.lit(start).cast("date")), (end, F.col("date") <= F.lit(end).cast("date"))):
        rows = rows.filter(inside) if bound else rows
    rows = rows.withColumns({"i": F.row_number().over(own) - 1, "days": F.count("*").over(Window.partitionBy("target_id"))}).filter(F.col("i") % h == 0)
    invested = F.coalesce(F.col("predicted") > 0, F.lit(False))
    return rows.select("target_id", "date", (F.col("i") / h).cast("int").alias("step"), "predicted", "realised", invested.alias("invested"), "held_until", "days")


def directional_pnl(forecasts: DataFrame, h: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """J14. Long when the forecast is above 0, else in cash, in steps of ``h`` rows; against holding throughout.

    ``forecasts(target_id, date, predicted, realised)`` with realised the h-row return. A step without a forecast is in cash.
    """
    steps = directional_steps(forecasts, h, start, end)
    r = F.when(F.col("invested"), F.col("realised")).otherwise(0.0)
    hit = F.when(F.col("predicted").isNotNull(), ((F.col("predicted") > 0) == (F.col("realised") > 0)).cast("double"))
    return steps.groupBy("target_id").agg(
        F.max("days").alias("days"), F.count("*").alias("steps"), F.count_if(F.col("predicted").isNull()).alias("no_forecast"), F.avg(hit).alias("hit_rate"), F.avg(F.col("invested").cast("double")).alias("invested"),
        (F.product(1 + r) - 1).alias("strategy"), (F.product(1 + F.col("realised")) - 1).alias("hold"), F.min("date").alias("first_step"), F.max("date").alias("last_step"), F.max("held_until").alias("held_until"),
    )


def forecast_value(paths: DataFrame, plain: DataFrame, keys: list[str]) -> DataFrame:
    """J13. The paired test of J10 on net returns: a schedule's path against the same level's without forecasts."""
    both = paths.select(*keys, "date", F.col("net").alias("r")).join(plain.select(*keys, "date", F.col("net").alias("base")), [*keys, "date"])
    return relative(both, keys).withColumn("verdict", significance(F.col("spread_t")))


def covariance_at_rebalance(returns: DataFrame, rebalances: DataFrame, h: int, least: int = 2) -> DataFrame:
    """H2. Variances and covariance of daily returns over each rebalance's training rows, times ``h``.

    ``returns(portfolio_id, rn, equity, bond)`` wide, rn from 1 without gaps; ``rebalances(portfolio_id, date, lo, hi)`` with
    hi one of them. The first return inside a window is not used: it needs a price from before. Sums run once per
    portfolio and are subtracted at the two ends, whatever the length of a window; returns are centred on the
    portfolio's mean first, which changes no covariance.
    """
    own = Window.partitionBy("portfolio_id")
    so_far = own.orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = returns.select("portfolio_id", "rn", *[(F.col(c) - F.avg(c).over(own)).alias(c) for c in ("equity", "bond")])
    e, b = F.col("equity"), F.col("bond")
    pair = e.isNotNull() & b.isNotNull()
    sums = {
        "n_e": e.isNotNull().cast("long"), "e": e, "ee": e * e, "n_b": b.isNotNull().cast("long"), "b": b, "bb": b * b, "n_p": pair.cast("long"), "pe": F.when(pair, e), "pb": F.when(pair, b), "eb": e * b,
    }
    run = rows.select("portfolio_id", "rn", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(k) for k, c in sums.items()])
    at = lambda end: run.select("portfolio_id", F.col("rn").alias(end), *[F.col(k).alias(f"{end}_{k}") for k in sums])
    out = rebalances.join(at("hi"), ["portfolio_id", "hi"]).join(at("lo"), ["portfolio_id", "lo"], "left")
    s = {k: F.col(f"hi_{k}") - F.coalesce(f"lo_{k}", F.lit(0)) for k in sums}
    co = lambda n, x, y, xy: F.when(s[n] > 1, (s[xy] - s[x] * s[y] / s[n]) / (s[n] - 1) * h)
    out = out.select("portfolio_id", "date", s["n_e"].alias("n"), co("n_e", "e", "e", "ee").alias("var_e"), co("n_p", "pe", "pb", "eb").alias("cov"), co("n_b", "b", "b", "bb").alias("var_b"))
    return out.filter(F.col("n") >= least)


def long_run_premium(returns: DataFrame, h: int) -> DataFrame:
    """H3. The prior premium and the mean return difference so far, weighted by their days, over ``h`` days."""
    w = Window.partitionBy("portfolio_id").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = returns.filter("equity IS NOT NULL AND bond IS NOT NULL")
    total = F.sum(F.col("equity") - F.col("bond")).over(w)
    return rows.select("portfolio_id", "date", ((PRIOR_DAYS * PRIOR_PREMIUM + total) / (PRIOR_DAYS + F.count("*").over(w)) * h).alias("premium"))


def trust_pairs(signals: DataFrame, roles: DataFrame) -> DataFrame:
    """H4. Per portfolio and date: x, the difference of the two signals; y, the difference of realised returns less the
    difference of own levels; and the later of the label ends. ``roles(portfolio_id, equity, bond)`` names targets."""
    side = lambda n: signals.select(F.col("target_id").alias(n), "date", F.col("signal").alias(f"s_{n}"), F.col("realised").alias(f"y_{n}"), F.col("own_level").alias(f"l_{n}"), F.col("label_end").alias(f"e_{n}"))
    rows = side("equity").join(roles, "equity").join(side("bond"), ["bond", "date"])
    y = F.col("y_equity") - F.col("y_bond") - (F.col("l_equity") - F.col("l_bond"))
    return rows.select("portfolio_id", "date", (F.col("s_equity") - F.col("s_bond")).alias("x"), y.alias("y"), F.greatest("e_equity", "e_bond").alias("label_end"))


def forecast_trust(pairs: DataFrame, rebalances: DataFrame, h: int, least: int = LEAST_TRUST_PAIRS, gate: float = TRUST_T) -> DataFrame:
    """H5. Slope of F4 over the pairs of H4 known by each rebalance, between 0 and 1; 0 with too few pairs, a constant x, or
    a t-statistic that is not above the gate (``gate_shut``). Fits of all prefixes come from one window of running sums."""
    fits = growing_fits(pairs.filter("label_end IS NOT NULL"), ["portfolio_id"], "x", "y", "date", h - 1, keep=["label_end"])
    fits = overlap_se(fits).select("portfolio_id", "date", "label_end", F.col("n").alias("pairs"), "slope", "t")
    due = rebalances.select("portfolio_id", "date")
    rows = asof(due, fits.withColumnRenamed("date", "made"), ["portfolio_id"], "date", "label_end", ["pairs", "slope", "t"], strict=True, tie="made")
    enough = F.coalesce(F.col("pairs") >= least, F.lit(False))
    opened = enough & F.coalesce(F.col("t") > gate, F.lit(False))
    trust = F.when(opened, F.least(F.greatest("slope", F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return rows.select("portfolio_id", "date", trust.alias("trust"), (enough & ~opened).alias("gate_shut"))


def min_variance(inputs: DataFrame, bounds: tuple[float, float] = BOUNDS) -> DataFrame:
    """H6. D, the minimum-variance weight (null where every mix is equally risky) and the lowest-risk weight allowed."""
    lo, hi = map(F.lit, bounds)
    rows = inputs.withColumn("d", F.col("var_e") - 2 * F.col("cov") + F.col("var_b"))
    rows = rows.withColumn("w_mv", F.when(F.col("d") > 0, (F.col("var_b") - F.col("cov")) / F.col("d")))
    return rows.withColumn("w_low", F.when(F.col("w_mv").isNull(), (lo + hi) / 2).otherwise(F.least(F.greatest("w_mv", lo), hi)))


def _variance(w: Column) -> Column:
    return w * w * F.col("var_e") + 2 * w * (1 - w) * F.col("cov") + (1 - w) * (1 - w) * F.col("var_b")


def level_weight(inputs: DataFrame, bounds: tuple[float, float] = BOUNDS) -> DataFrame:
    """H7. For ``inputs`` with a level 1 to 5: the weight whose volatility is the level's share of the way from the
    lowest that the bounds allow (5) to the highest (1)."""
    hi = F.lit(bounds[1])
    rows = min_variance(inputs, bounds)
    low, high = F.sqrt(_variance(F.col("w_low"))), F.sqrt(_variance(hi))
    aim = low + (5 - F.col("level")) / 4 * (high - low)
    between = F.col("w_mv") + F.sqrt(F.greatest((aim * aim - _variance(F.col("w_mv"))) / F.col("d"), F.lit(0.0)))
    w = (
        F.when(F.col("w_mv").isNull(), F.col("w_low")).when((F.col("w_mv") >= hi) | (F.col("level") == 1), hi).when(F.col("level") == 5, F.col("w_low"))
        .otherwise(F.least(F.greatest(between, F.col("w_low")), hi))
    )
    return rows.withColumn("w_level", w)


def weight_breakdown(inputs: DataFrame, bounds: tuple[float, float] = BOUNDS) -> DataFrame:
    """H8. Level weight, forecast tilt and final equity weight, with a mark where a bound cuts the tilt.

    ``inputs(portfolio_id, date, level, var_e, cov, var_b, premium, trust, signal_diff)``.
    """
    lo, hi = map(F.lit, bounds)
    rows = level_weight(inputs, bounds)
    scale = F.when((F.col("level") == 5) | (F.col("premium") <= 0) | F.col("w_mv").isNull(), 0.0).otherwise(F.greatest(F.col("w_level") - F.col("w_mv"), F.lit(0.0)) / F.col("premium"))
    rows = rows.withColumn("tilt", F.col("trust") * F.col("signal_diff") * scale).withColumn("aim", F.col("w_level") + F.col("tilt"))
    return rows.withColumn("equity", F.least(F.greatest("aim", lo), hi)).withColumn("capped", F.col("aim") != F.col("equity")).drop("aim")


def with_levels(inputs: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Inputs of a rebalance for every risk level; estimated once, then repeated."""
    return inputs.withColumn("level", F.explode(F.array(*map(F.lit, levels))))


def schedule(breakdown: DataFrame) -> DataFrame:
    """H9. Long weights per portfolio, level, date and asset; rows without a weight are left out."""
    sides = F.explode(F.array(F.struct(F.lit("equity").alias("asset"), F.col("equity").alias("weight")), F.struct(F.lit("bond").alias("asset"), (1 - F.col("equity")).alias("weight"))))
    return breakdown.filter("equity IS NOT NULL").select("portfolio_id", "level", "date", sides.alias("s")).select("portfolio_id", "level", "date", "s.asset", "s.weight")


def market_conditions(breakdown: DataFrame, h: int) -> DataFrame:
    """H10. The latest rebalance's weight, tilt and trust, and volatilities by the year."""
    year = float(YEAR) / h
    rows = breakdown.withColumn("vol_e", F.sqrt(F.col("var_e") * year)).withColumn("vol_b", F.sqrt(F.col("var_b") * year)).withColumn("vol", F.sqrt(_variance(F.col("equity")) * year))
    picked = F.max_by(F.struct("date", "equity", "tilt", "trust", "vol_e", "vol_b", "vol"), "date")
    return rows.groupBy("portfolio_id", "level").agg(picked.alias("p")).select("portfolio_id", "level", "p.*")
