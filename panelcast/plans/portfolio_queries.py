"""Queries of portfolio construction (H), backtests (J) and tail risk (K)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcast.operators import portfolio, risk
from panelcast.plans import fixtures as fx
from panelcast.plans.panel_queries import PAIR, Parts, pair_prices, wide_returns
from panelcast.plans.register import query, r, rounded
from panelcast.plans.scoring_queries import hac_ctes, signals_of

ROOT = "sqrt(252)"
fx.cte("pret", "SELECT date, 'equity' AS asset, equity AS r FROM wide UNION ALL SELECT date, 'bond', bond FROM wide", "wide")
# monthly rebalances on the last common date of a month
fx.cte("due", "SELECT max(date) AS date FROM wide GROUP BY date_trunc('month', date)", "wide")
fx.cte("weights", "SELECT date, 'equity' AS asset, 0.2 + 0.6 * (month(date) % 4) / 3 AS weight FROM due UNION ALL SELECT date, 'bond', 1 - (0.2 + 0.6 * (month(date) % 4) / 3) FROM due", "due")
fx.cte("bench_weights", "SELECT date, asset, 0.5 AS weight FROM (SELECT date FROM due UNION SELECT min(date) FROM due) CROSS JOIN (SELECT 'equity' AS asset UNION ALL SELECT 'bond')", "due")


def path_ctes(prefix: str, weights: str) -> None:
    fx.cte(
        f"{prefix}_drift",
        f"""SELECT date, asset, seg, weight, v, coalesce(g / v, 0) AS drifted FROM (
  SELECT *, sum(g) OVER (PARTITION BY date) AS v FROM (
    SELECT *, CASE WHEN seg > 0 THEN w0 * product(1 + coalesce(r, 0)) OVER (PARTITION BY asset, seg ORDER BY date ROWS UNBOUNDED PRECEDING) END AS g FROM (
      SELECT p.date, p.asset, p.r, w.weight, count(w.weight) OVER b AS seg, last_value(w.weight IGNORE NULLS) OVER b AS w0 FROM pret p LEFT JOIN {weights} w ON w.date = p.date AND w.asset = p.asset
      WINDOW b AS (PARTITION BY p.asset ORDER BY p.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))))""",
        "pret", weights,
    )
    fx.cte(
        f"{prefix}_path",
        f"""SELECT date, gross, (1 + gross) * (1 - CASE WHEN k = 1 THEN 0 ELSE cost END) * (1 - CASE WHEN k = 2 THEN before ELSE 0 END) - 1 AS net, turnover, cost FROM (
  SELECT *, row_number() OVER (ORDER BY date) AS k, lag(cost) OVER (ORDER BY date) AS before FROM (
    SELECT date, seg, CASE WHEN seg > 0 THEN v / coalesce(lag(v) OVER (PARTITION BY seg ORDER BY date), 1) - 1 END AS gross, turnover, cost, named FROM (
      SELECT date, max(seg) AS seg, max(v) AS v, count(weight) AS named, coalesce(sum(abs(weight - drifted)), 0) AS turnover, coalesce(sum(abs(weight - drifted) * CASE asset WHEN 'equity' THEN {fx.EQUITY_BPS} ELSE {fx.BOND_BPS} END / 10000), 0) AS cost FROM {prefix}_drift GROUP BY 1))
  WHERE seg > 0 OR named > 0)""",
        f"{prefix}_drift",
    )


path_ctes("opt", "weights")
path_ctes("bench", "bench_weights")


class Book:
    def __init__(self, spark, d):
        self.parts = Parts(spark, d)
        self.returns = portfolio.daily_returns(pair_prices(self.parts))
        dates = self.returns.select("portfolio_id", "date").distinct()
        self.due = dates.groupBy("portfolio_id", F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date")).select("portfolio_id", "date")
        w = 0.2 + 0.6 * (F.month("date") % 4) / 3
        side = F.explode(F.array(F.struct(F.lit("equity").alias("asset"), w.alias("weight")), F.struct(F.lit("bond").alias("asset"), (1 - w).alias("weight"))))
        self.weights = self.due.select("portfolio_id", "date", side.alias("s")).select("portfolio_id", "date", "s.asset", "s.weight")
        self.costs = spark.createDataFrame([("equity", fx.EQUITY_BPS), ("bond", fx.BOND_BPS)], "asset string, bps double")
        self.start = self.due.groupBy("portfolio_id").agg(F.min("date").alias("first"))

    @cached_property
    def path(self):
        return portfolio.portfolio_path(self.returns, self.weights, self.costs)

    @cached_property
    def bench(self):
        return portfolio.portfolio_path(self.returns, portfolio.month_end_weights(self.returns, self.start), self.costs)

    @cached_property
    def both(self):
        kinds = self.path.withColumn("kind", F.lit("optimised")).unionByName(self.bench.withColumn("kind", F.lit("benchmark")))
        return kinds.select("portfolio_id", "kind", "date", F.col("net").alias("r")).filter("r IS NOT NULL")


fx.cte("both_net", "SELECT 'optimised' AS kind, date, net AS r FROM opt_path WHERE net IS NOT NULL UNION ALL SELECT 'benchmark', date, net FROM bench_path WHERE net IS NOT NULL", "opt_path", "bench_path")
fx.cte(
    "dd",
    "SELECT *, wealth / greatest(1, max(wealth) OVER (PARTITION BY kind ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown FROM (SELECT *, product(1 + r) OVER (PARTITION BY kind ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM both_net)",
    "both_net",
)
fx.cte(
    "perf",
    f"""SELECT kind, days, annual_return, coalesce(sd * {ROOT}, 0) AS annual_volatility, mean * {ROOT} / sd AS sharpe, mean * {ROOT} / nullif(downside, 0) AS sortino, annual_return / nullif(abs(worst), 0) AS calmar, worst AS max_drawdown FROM (
  SELECT kind, count(r) AS days, pow(product(1 + r), 252 / count(r)) - 1 AS annual_return, avg(r) AS mean, CASE WHEN count(r) > 1 AND min(r) < max(r) THEN stddev_samp(r) END AS sd, sqrt(avg(pow(least(r, 0), 2))) AS downside, least(min(drawdown), 0) AS worst FROM dd GROUP BY 1)""",
    "dd",
)


@query(
    "J1_check_schedule",
    fx.sql(
        f"""SELECT 'pair' AS portfolio_id, date, CASE WHEN total_off THEN 'does not sum to 1' ELSE 'not a trading day' END AS fault FROM (
  SELECT date, abs(sum(weight) - 1) > 1e-9 AS total_off, date IN (SELECT date FROM wide) AS good FROM (SELECT date, asset, CASE WHEN asset = 'bond' AND month(date) = 3 THEN weight / 2 ELSE weight END AS weight FROM weights UNION ALL SELECT date + INTERVAL 1000 YEAR, asset, weight FROM weights WHERE month(date) = 5) GROUP BY 1) WHERE total_off OR NOT good""",
        "weights", "wide",
    ),
)
def check_schedule(spark, d):
    b = Book(spark, d)
    spoilt = b.weights.withColumn("weight", F.when((F.col("asset") == "bond") & (F.month("date") == 3), F.col("weight") / 2).otherwise(F.col("weight")))
    late = b.weights.filter(F.month("date") == 5).withColumn("date", F.add_months("date", 12000))
    assets = b.returns.select("portfolio_id", "asset").distinct()
    return portfolio.check_schedule(spoilt.unionByName(late), assets, b.returns)


@query("J2_drifted_weights", fx.sql("SELECT 'pair' AS portfolio_id, asset, date, round(drifted, 8) AS drifted FROM opt_drift WHERE seg > 0", "opt_drift"))
def drifted_weights(spark, d):
    b = Book(spark, d)
    return rounded(portfolio.drifted_weights(b.returns, b.weights).filter("seg > 0").select("portfolio_id", "asset", "date", "drifted"), "drifted")


PATH = "SELECT 'pair' AS portfolio_id, date, round(gross, 8) AS gross, round(net, 8) AS net, round(turnover, 8) AS turnover, round(cost, 10) AS cost FROM "


@query("J3_portfolio_path", fx.sql(PATH + "opt_path", "opt_path"))
def portfolio_path(spark, d):
    return rounded(rounded(Book(spark, d).path, "gross", "net", "turnover"), "cost", places=10)


@query("J4_benchmark_path", fx.sql(PATH + "bench_path", "bench_path"))
def benchmark_path(spark, d):
    return rounded(rounded(Book(spark, d).bench, "gross", "net", "turnover"), "cost", places=10)


METRICS = ("annual_return", "annual_volatility", "sharpe", "sortino", "calmar", "max_drawdown")


@query("J5_backtest", fx.sql(f"SELECT 'pair' AS portfolio_id, kind, days, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)} FROM perf", "perf"))
def backtest(spark, d):
    return rounded(portfolio.performance(Book(spark, d).both, ["portfolio_id", "kind"]), *METRICS, places=6)


ALL_RETURNS = "SELECT target_id, date, price / lag(price) OVER (PARTITION BY target_id ORDER BY date) - 1 AS r FROM prices"
fx.cte("tret", ALL_RETURNS, "prices")


def target_returns(p: Parts):
    before = F.lag("price").over(Window.partitionBy("target_id").orderBy("date"))
    return p.prices.withColumn("r", F.col("price") / before - 1).select("target_id", "date", "r")


@query(
    "J6_performance",
    fx.sql(
        f"SELECT target_id, count(r) AS days, round(pow(product(1 + r), 252 / count(r)) - 1, 6) AS annual_return, round(stddev_samp(r) * {ROOT}, 6) AS annual_volatility, round(avg(r) * {ROOT} / stddev_samp(r), 6) AS sharpe, round(avg(r) * {ROOT} / sqrt(avg(pow(least(r, 0), 2))), 6) AS sortino FROM tret WHERE r IS NOT NULL GROUP BY 1",
        "tret",
    ),
)
def performance(spark, d):
    out = portfolio.performance(target_returns(Parts(spark, d)), ["target_id"])
    return rounded(out.select("target_id", "days", "annual_return", "annual_volatility", "sharpe", "sortino"), "annual_return", "annual_volatility", "sharpe", "sortino", places=6)


@query("J7_drawdown", fx.sql("SELECT kind, date, round(drawdown, 8) AS drawdown FROM dd", "dd"))
def drawdown(spark, d):
    return rounded(portfolio.drawdown(Book(spark, d).both, ["kind"]).select("kind", "date", "drawdown"), "drawdown")


@query(
    "J8_rolling_volatility",
    fx.sql(f"SELECT target_id, date, CASE WHEN count(r) OVER w = 63 THEN round(stddev_samp(r) OVER w * {ROOT}, 6) END AS volatility FROM tret WHERE r IS NOT NULL WINDOW w AS (PARTITION BY target_id ORDER BY date ROWS 62 PRECEDING)", "tret"),
)
def rolling_volatility(spark, d):
    return rounded(portfolio.rolling(target_returns(Parts(spark, d)), ["target_id"]).select("target_id", "date", "volatility"), "volatility", places=6)


@query(
    "J9_rolling_sharpe",
    fx.sql(f"SELECT target_id, date, CASE WHEN count(r) OVER w = 252 THEN round(avg(r) OVER w / stddev_samp(r) OVER w * {ROOT}, 5) END AS sharpe FROM tret WHERE r IS NOT NULL WINDOW w AS (PARTITION BY target_id ORDER BY date ROWS 251 PRECEDING)", "tret"),
)
def rolling_sharpe(spark, d):
    return rounded(portfolio.rolling(target_returns(Parts(spark, d)), ["target_id"]).select("target_id", "date", "sharpe"), "sharpe", places=5)


fx.cte(
    "rel",
    """SELECT o.date, o.net - b.net AS d, row_number() OVER (ORDER BY o.date) AS i, o.net - b.net - avg(o.net - b.net) OVER () AS e, CAST(floor(4 * pow(count(*) OVER () / 100, 2 / 9)) AS INT) AS lags FROM opt_path o JOIN bench_path b ON b.date = o.date WHERE o.net IS NOT NULL AND b.net IS NOT NULL""",
    "opt_path", "bench_path",
)


@query(
    "J10_relative",
    fx.sql(
        f"""SELECT 'pair' AS portfolio_id, count(*) AS days, round(stddev_samp(d) * {ROOT}, 6) AS tracking_error, round(avg(d) * 252 / (stddev_samp(d) * {ROOT}), 5) AS information_ratio,
round(avg(d) / (sqrt((SELECT sum(CASE WHEN a.l = 0 THEN 1 ELSE 2 * (1 - a.l / (a.lags + 1)) END * a.e * b.e) FROM (SELECT *, unnest(range(lags + 1)) AS l FROM rel) a JOIN rel b ON b.i = a.i - a.l)) / count(*)), 5) AS spread_t, max(lags) AS lags FROM rel""",
        "rel",
    ),
)
def relative(spark, d):
    b = Book(spark, d)
    both = b.path.select("portfolio_id", "date", F.col("net").alias("r")).join(b.bench.select("portfolio_id", "date", F.col("net").alias("base")), ["portfolio_id", "date"])
    return rounded(rounded(portfolio.relative(both, ["portfolio_id"]), "tracking_error", places=6), "information_ratio", "spread_t", places=5)


@query("J11_cumulative", fx.sql("SELECT kind, date, round(wealth - 1, 8) AS cumulative FROM dd", "dd"))
def cumulative(spark, d):
    return rounded(portfolio.cumulative(Book(spark, d).both, ["kind"]), "cumulative")


@query(
    "J12_comparison_table",
    fx.sql(
        "SELECT metric, round(o.value, 6) AS optimised, round(b.value, 6) AS benchmark, round(o.value - b.value, 6) AS difference FROM (UNPIVOT (SELECT * EXCLUDE (kind, days) FROM perf WHERE kind = 'optimised') ON COLUMNS(*) INTO NAME metric VALUE value) o JOIN (UNPIVOT (SELECT * EXCLUDE (kind, days) FROM perf WHERE kind = 'benchmark') ON COLUMNS(*) INTO NAME metric VALUE value) b USING (metric)",
        "perf",
    ),
)
def comparison_table(spark, d):
    metrics = portfolio.performance(Book(spark, d).both, ["portfolio_id", "kind"])
    return rounded(portfolio.comparison_table(metrics, list(METRICS)).drop("portfolio_id"), "optimised", "benchmark", "difference", places=6)


HELD = f"date - (isodow(date) - 1)::INT + ((least(isodow(date) - 1, 4) + {fx.HORIZON}) // 5 * 7 + (least(isodow(date) - 1, 4) + {fx.HORIZON}) % 5)::INT"


def directional_sql(window: str) -> str:
    return f"""SELECT target_id, max(days) AS days, count(*) AS steps, count(*) - count(predicted) AS no_forecast, round(avg(CASE WHEN predicted IS NOT NULL THEN CASE WHEN (predicted > 0) = (realised > 0) THEN 1.0 ELSE 0.0 END END), 8) AS hit_rate, round(avg(CASE WHEN coalesce(predicted > 0, false) THEN 1.0 ELSE 0.0 END), 8) AS invested,
round(product(1 + CASE WHEN coalesce(predicted > 0, false) THEN realised ELSE 0 END) - 1, 6) AS strategy, round(product(1 + realised) - 1, 6) AS hold, min(date) AS first_step, max(date) AS last_step, max(held) AS held_until FROM (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY target_id) AS days FROM (SELECT *, coalesce(lead(date, {fx.HORIZON}) OVER (PARTITION BY target_id ORDER BY date), {HELD}) AS held FROM sig WHERE model_id = 'shape') WHERE realised IS NOT NULL{window})
WHERE i % {fx.HORIZON} = 0 GROUP BY 1"""


@query("J14_directional_pnl", fx.sql(directional_sql(""), "sig"))
def directional_pnl(spark, d):
    out = portfolio.directional_pnl(signals_of(Parts(spark, d)).filter("model_id = 'shape'"), fx.HORIZON)
    return rounded(rounded(out, "hit_rate", "invested"), "strategy", "hold", places=6)


@query("J14_directional_window", fx.sql(directional_sql(" AND date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'"), "sig"))
def directional_window(spark, d):
    out = portfolio.directional_pnl(signals_of(Parts(spark, d)).filter("model_id = 'shape'"), fx.HORIZON, "1996-01-01", "1997-06-30")
    return rounded(rounded(out, "hit_rate", "invested"), "strategy", "hold", places=6)


# construction ------------------------------------------------------------------------------------------------------
H = fx.HORIZON
START = max(fx.TRAIN, fx.TUNING) + fx.EMBARGO
fx.cte("reb", f"SELECT date, rn - {fx.EMBARGO} - {fx.TRAIN} AS lo, rn - 1 - {fx.EMBARGO} AS hi FROM wide WHERE rn > {START} AND (rn - {START} - 1) % {H} = 0", "wide")
fx.cte("cov", f"SELECT b.date, count(w.equity) AS n, var_samp(w.equity) * {H} AS var_e, covar_samp(w.equity, w.bond) * {H} AS cov, var_samp(w.bond) * {H} AS var_b FROM reb b JOIN wide w ON w.rn > b.lo AND w.rn <= b.hi GROUP BY 1", "reb", "wide")
fx.cte("prem", f"SELECT date, (7560 * (0.066 / 252) + sum(equity - bond) OVER (ORDER BY date)) / (7560 + count(*) OVER (ORDER BY date)) * {H} AS premium FROM wide WHERE equity IS NOT NULL AND bond IS NOT NULL", "wide")
fx.cte(
    "tp",
    f"""SELECT e.date, e.date AS o, e.signal - b.signal AS x, e.realised - b.realised - (e.own_level - b.own_level) AS y, greatest(le.label_end, lb.label_end) AS label_end FROM sig e JOIN sig b ON b.date = e.date AND b.target_id = '{fx.BOND}' AND b.model_id = 'shape'
JOIN labels le ON le.target_id = e.target_id AND le.rn = e.rn JOIN labels lb ON lb.target_id = b.target_id AND lb.rn = b.rn WHERE e.target_id = '{fx.EQUITY}' AND e.model_id = 'shape'""",
    "sig", "labels",
)
fx.cte("known", "SELECT r.date AS rebalance, t.o, t.x, t.y FROM tp t JOIN reb r ON t.label_end < r.date", "tp", "reb")
hac_ctes("thac", "known", ["rebalance"], str(H - 1))
fx.cte(
    "trust",
    """SELECT r.date, CASE WHEN coalesce(slope / greatest(se_bartlett, se_uniform) > 2, false) THEN least(greatest(slope, 0), 1) ELSE 0 END AS trust, n IS NOT NULL AND NOT coalesce(slope / greatest(se_bartlett, se_uniform) > 2, false) AS gate_shut
FROM reb r LEFT JOIN (SELECT * FROM thac WHERE n >= 252) t ON t.rebalance = r.date""",
    "reb", "thac",
)
LO, HI = portfolio.BOUNDS


def variance_sql(w: str) -> str:
    return f"(({w}) * ({w}) * var_e + 2 * ({w}) * (1 - ({w})) * cov + (1 - ({w})) * (1 - ({w})) * var_b)"


fx.cte("mv", f"SELECT *, CASE WHEN w_mv IS NULL THEN {(LO + HI) / 2} ELSE least(greatest(w_mv, {LO}), {HI}) END AS w_low FROM (SELECT *, CASE WHEN d > 0 THEN (var_b - cov) / d END AS w_mv FROM (SELECT *, var_e - 2 * cov + var_b AS d FROM cov))", "cov")
AIM = f"pow(sqrt({variance_sql('w_low')}) + (5 - level) / 4 * (sqrt({variance_sql(str(HI))}) - sqrt({variance_sql('w_low')})), 2)"
fx.cte(
    "lev",
    f"""SELECT *, CASE WHEN w_mv IS NULL THEN w_low WHEN w_mv >= {HI} OR level = 1 THEN {HI} WHEN level = 5 THEN w_low ELSE least(greatest(w_mv + sqrt(greatest(({AIM} - {variance_sql('w_mv')}) / d, 0)), w_low), {HI}) END AS w_level FROM mv CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS level)""",
    "mv",
)
fx.cte(
    "brk",
    f"""SELECT *, least(greatest(w_level + tilt, {LO}), {HI}) AS equity, w_level + tilt <> least(greatest(w_level + tilt, {LO}), {HI}) AS capped FROM (
  SELECT l.*, p.premium, s.diff, t.trust, t.trust * s.diff * CASE WHEN level = 5 OR p.premium <= 0 OR w_mv IS NULL THEN 0 ELSE greatest(w_level - w_mv, 0) / p.premium END AS tilt FROM lev l JOIN prem p ON p.date = l.date JOIN (SELECT date, x AS diff FROM tp) s ON s.date = l.date JOIN trust t ON t.date = l.date)""",
    "lev", "prem", "tp", "trust",
)


class Plan:
    def __init__(self, spark, d):
        self.parts = Parts(spark, d)
        self.wide = wide_returns(self.parts)

    @cached_property
    def rebalances(self):
        at = self.wide.filter((F.col("rn") > START) & ((F.col("rn") - START - 1) % H == 0))
        return at.select("portfolio_id", "date", (F.col("rn") - fx.EMBARGO - fx.TRAIN).alias("lo"), (F.col("rn") - 1 - fx.EMBARGO).alias("hi"))

    @cached_property
    def cov(self):
        return portfolio.covariance_at_rebalance(self.wide.drop("date"), self.rebalances, H)

    @cached_property
    def trust_pairs(self):
        s = signals_of(self.parts).filter("model_id = 'shape'").join(self.parts.labels.select("target_id", "rn", "label_end"), ["target_id", "rn"])
        roles = self.parts.prices.sparkSession.createDataFrame([("pair", fx.EQUITY, fx.BOND)], "portfolio_id string, equity string, bond string")
        return portfolio.trust_pairs(s, roles)

    @cached_property
    def inputs(self):
        base = self.cov.join(portfolio.long_run_premium(self.wide, H), ["portfolio_id", "date"])
        pairs = self.trust_pairs
        diff = pairs.select("portfolio_id", "date", F.col("x").alias("signal_diff"))
        trust = portfolio.forecast_trust(pairs, self.rebalances, H).select("portfolio_id", "date", "trust")
        return base.join(diff, ["portfolio_id", "date"]).join(trust, ["portfolio_id", "date"])

    @cached_property
    def breakdown(self):
        return portfolio.weight_breakdown(portfolio.with_levels(self.inputs))


@query("H1_rebalance_dates", fx.sql("SELECT 'pair' AS portfolio_id, date, lo, hi FROM reb", "reb"))
def rebalance_dates(spark, d):
    return Plan(spark, d).rebalances


@query("H2_covariance", fx.sql("SELECT 'pair' AS portfolio_id, date, n, round(var_e, 12) AS var_e, round(cov, 12) AS cov, round(var_b, 12) AS var_b FROM cov", "cov"))
def covariance(spark, d):
    return rounded(Plan(spark, d).cov, "var_e", "cov", "var_b", places=12)


@query("H3_long_run_premium", fx.sql("SELECT 'pair' AS portfolio_id, date, round(premium, 10) AS premium FROM prem", "prem"))
def long_run_premium(spark, d):
    return rounded(portfolio.long_run_premium(Plan(spark, d).wide, H), "premium", places=10)


@query("H4_trust_pairs", fx.sql("SELECT 'pair' AS portfolio_id, date, round(x, 8) AS x, round(y, 8) AS y, label_end FROM tp", "tp"))
def trust_pairs(spark, d):
    return rounded(Plan(spark, d).trust_pairs, "x", "y")


@query("H5_forecast_trust", fx.sql("SELECT 'pair' AS portfolio_id, date, round(trust, 6) AS trust, gate_shut FROM trust", "trust"))
def forecast_trust(spark, d):
    p = Plan(spark, d)
    return rounded(portfolio.forecast_trust(p.trust_pairs, p.rebalances, H), "trust", places=6)


@query("H6_min_variance", fx.sql("SELECT date, round(d, 12) AS d, round(w_mv, 6) AS w_mv, round(w_low, 6) AS w_low FROM mv", "mv"))
def min_variance(spark, d):
    return rounded(rounded(portfolio.min_variance(Plan(spark, d).cov).select("date", "d", "w_mv", "w_low"), "d", places=12), "w_mv", "w_low", places=6)


@query("H7_level_weight", fx.sql("SELECT date, level, round(w_level, 6) AS w_level FROM lev", "lev"))
def level_weight(spark, d):
    return rounded(portfolio.level_weight(portfolio.with_levels(Plan(spark, d).cov)).select("date", "level", "w_level"), "w_level", places=6)


@query("H8_weight_breakdown", fx.sql("SELECT date, level, round(w_level, 6) AS w_level, round(tilt, 6) AS tilt, round(equity, 6) AS equity, capped FROM brk", "brk"))
def weight_breakdown(spark, d):
    return rounded(Plan(spark, d).breakdown.select("date", "level", "w_level", "tilt", "equity", "capped"), "w_level", "tilt", "equity", places=6)


@query("H9_weight_schedule", fx.sql("SELECT 'pair' AS portfolio_id, level, date, asset, round(CASE asset WHEN 'equity' THEN equity ELSE 1 - equity END, 6) AS weight FROM brk CROSS JOIN (SELECT unnest(['equity', 'bond']) AS asset)", "brk"))
def weight_schedule(spark, d):
    return rounded(portfolio.schedule(Plan(spark, d).breakdown), "weight", places=6)


@query(
    "H10_market_conditions",
    fx.sql(f"SELECT 'pair' AS portfolio_id, level, date, round(equity, 6) AS equity, round(tilt, 6) AS tilt, round(trust, 6) AS trust, round(sqrt(var_e * 252 / {H}), 6) AS vol_e, round(sqrt(var_b * 252 / {H}), 6) AS vol_b, round(sqrt({variance_sql('equity')} * 252 / {H}), 6) AS vol FROM brk WHERE date = (SELECT max(date) FROM brk)", "brk"),
)
def market_conditions(spark, d):
    return rounded(portfolio.market_conditions(Plan(spark, d).breakdown, H), "equity", "tilt", "trust", "vol_e", "vol_b", "vol", places=6)


# J13: both schedules of every level, backtested; SQL walks the same closed form level by level
def level_path_ctes(prefix: str, weight: str) -> None:
    fx.cte(
        f"{prefix}_drift",
        f"""SELECT level, date, asset, seg, weight, v, coalesce(g / v, 0) AS drifted FROM (SELECT *, sum(g) OVER (PARTITION BY level, date) AS v FROM (
    SELECT *, CASE WHEN seg > 0 THEN w0 * product(1 + coalesce(r, 0)) OVER (PARTITION BY level, asset, seg ORDER BY date ROWS UNBOUNDED PRECEDING) END AS g FROM (
      SELECT p.level, p.date, p.asset, p.r, w.weight, count(w.weight) OVER b AS seg, last_value(w.weight IGNORE NULLS) OVER b AS w0 FROM (SELECT * FROM pret CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS level)) p
      LEFT JOIN (SELECT level, date, a.asset, CASE a.asset WHEN 'equity' THEN {weight} ELSE 1 - ({weight}) END AS weight FROM brk CROSS JOIN (SELECT unnest(['equity', 'bond']) AS asset) a WHERE {weight} IS NOT NULL) w ON w.level = p.level AND w.date = p.date AND w.asset = p.asset
      WINDOW b AS (PARTITION BY p.level, p.asset ORDER BY p.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))))""",
        "pret", "brk",
    )
    fx.cte(
        f"{prefix}_path",
        f"""SELECT level, date, (1 + gross) * (1 - CASE WHEN k = 1 THEN 0 ELSE cost END) * (1 - CASE WHEN k = 2 THEN before ELSE 0 END) - 1 AS net FROM (
  SELECT *, row_number() OVER (PARTITION BY level ORDER BY date) AS k, lag(cost) OVER (PARTITION BY level ORDER BY date) AS before FROM (
    SELECT level, date, seg, CASE WHEN seg > 0 THEN v / coalesce(lag(v) OVER (PARTITION BY level, seg ORDER BY date), 1) - 1 END AS gross, cost, named FROM (
      SELECT level, date, max(seg) AS seg, max(v) AS v, count(weight) AS named, coalesce(sum(abs(weight - drifted) * CASE asset WHEN 'equity' THEN {fx.EQUITY_BPS} ELSE {fx.BOND_BPS} END / 10000), 0) AS cost FROM {prefix}_drift GROUP BY 1, 2))
  WHERE seg > 0 OR named > 0)""",
        f"{prefix}_drift",
    )


level_path_ctes("told", "equity")
level_path_ctes("plain", "w_level")
fx.cte(
    "worth",
    "SELECT t.level, t.date, t.net - p.net AS d, row_number() OVER (PARTITION BY t.level ORDER BY t.date) AS i, t.net - p.net - avg(t.net - p.net) OVER (PARTITION BY t.level) AS e, CAST(floor(4 * pow(count(*) OVER (PARTITION BY t.level) / 100, 2 / 9)) AS INT) AS lags FROM told_path t JOIN plain_path p ON p.level = t.level AND p.date = t.date WHERE t.net IS NOT NULL AND p.net IS NOT NULL",
    "told_path", "plain_path",
)


@query(
    "J13_forecast_value",
    fx.sql(
        f"""SELECT *, CASE WHEN spread_t IS NULL THEN 'undefined' WHEN spread_t >= 2 THEN 'outperforms' WHEN spread_t <= -2 THEN 'underperforms' ELSE 'not significant' END AS verdict FROM (
  SELECT w.level, count(*) AS days, round(stddev_samp(d) * {ROOT}, 6) AS tracking_error, round(CASE WHEN min(d) < max(d) THEN avg(d) / (sqrt(max(l.s)) / count(*)) END, 4) AS spread_t, max(lags) AS lags FROM worth w
  JOIN (SELECT a.level, sum(CASE WHEN a.l = 0 THEN 1 ELSE 2 * (1 - a.l / (a.lags + 1)) END * a.e * b.e) AS s FROM (SELECT *, unnest(range(lags + 1)) AS l FROM worth) a JOIN worth b ON b.level = a.level AND b.i = a.i - a.l GROUP BY 1) l ON l.level = w.level GROUP BY 1)""",
        "worth",
    ),
)
def forecast_value(spark, d):
    """The schedule of every level against the same level without forecasts, both backtested net of costs."""
    plan, book = Plan(spark, d), Book(spark, d)
    returns = book.returns.withColumn("level", F.explode(F.array(*map(F.lit, portfolio.LEVELS))))
    named = lambda df: df.withColumn("portfolio_id", F.concat_ws("/", "portfolio_id", "level"))
    breakdown = plan.breakdown
    kinds = {}
    for kind, weight in (("told", "equity"), ("plain", "w_level")):
        schedule = portfolio.schedule(breakdown.withColumn("equity", F.col(weight)))
        kinds[kind] = portfolio.portfolio_path(named(returns).drop("level"), named(schedule).drop("level"), book.costs)
    out = portfolio.forecast_value(kinds["told"], kinds["plain"], ["portfolio_id"])
    level = F.split_part("portfolio_id", F.lit("/"), F.lit(2)).cast("int")
    return rounded(rounded(out, "tracking_error", places=6), "spread_t", places=4).select(level.alias("level"), "days", "tracking_error", "spread_t", "lags", "verdict")


@query("M4_saved_paths", fx.sql("SELECT 'pair' AS run_key, p.date, round(p.net, 8) AS net, round(w.weight, 8) AS equity FROM opt_path p LEFT JOIN weights w ON w.date = p.date AND w.asset = 'equity'", "opt_path", "weights"))
def saved_paths(spark, d):
    from panelcast.operators import runlog

    b = Book(spark, d)
    daily = b.path.select(F.col("portfolio_id").alias("run_key"), "date", "net")
    set_at = b.weights.filter("asset = 'equity'").select(F.col("portfolio_id").alias("run_key"), "date", F.col("weight").alias("equity"))
    return rounded(runlog.saved_paths(daily, set_at, daily.select("run_key")), "net", "equity")


@query("M4_run_weights", fx.sql("SELECT 'pair' AS portfolio_id, date, asset, round(weight, 8) AS weight FROM weights", "weights"))
def run_weights(spark, d):
    from panelcast.operators import runlog

    b = Book(spark, d)
    return rounded(runlog.of_runs(b.weights, b.due, "portfolio_id"), "weight")


# tail risk -----------------------------------------------------------------------------------------------------------
def var_sql(c: float) -> str:
    return f"SELECT target_id, max(k) AS k, round(-max(r), 8) AS var, round(-avg(r), 8) AS cvar FROM (SELECT target_id, r, row_number() OVER (PARTITION BY target_id ORDER BY r) AS i, greatest(ceil(count(*) OVER (PARTITION BY target_id) * {1 - c!r} - 1e-9), 1)::INT AS k FROM tret WHERE r IS NOT NULL) WHERE i <= k GROUP BY 1"


def breach_sql(c: float, k: int) -> str:
    return f"SELECT target_id, count(*) FILTER (r < lim) AS breaches, count(lim) AS tested FROM (SELECT target_id, r, CASE WHEN len(w) = 252 THEN list_sort(w)[{k}] END AS lim FROM (SELECT target_id, r, list(r) OVER (PARTITION BY target_id ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS w FROM tret WHERE r IS NOT NULL)) GROUP BY 1"


@query("K1_historical_var", fx.sql(var_sql(0.95), "tret"))
def historical_var(spark, d):
    return rounded(risk.historical_var(target_returns(Parts(spark, d)), ["target_id"]), "var", "cvar")


@query("K2_var_breaches", fx.sql(breach_sql(0.95, 13), "tret"))
def var_breaches(spark, d):
    return risk.var_breaches(target_returns(Parts(spark, d)), ["target_id"]).drop("confidence")


DEEPEST = """SELECT target_id, count(*) AS days, round(min(wealth / greatest(1, peak) - 1), 8) AS max_drawdown FROM (SELECT *, max(wealth) OVER w AS peak FROM (SELECT target_id, date, exp(sum(ln(1 + r)) OVER w) AS wealth FROM tret WHERE r IS NOT NULL WINDOW w AS (PARTITION BY target_id ORDER BY date)) WINDOW w AS (PARTITION BY target_id ORDER BY date)) GROUP BY 1"""


@query("K3_tail_table", fx.sql(f"SELECT *, 0.95 AS confidence FROM ({var_sql(0.95)}) JOIN ({breach_sql(0.95, 13)}) USING (target_id) JOIN ({DEEPEST}) USING (target_id) UNION ALL SELECT *, 0.99 FROM ({var_sql(0.99)}) JOIN ({breach_sql(0.99, 3)}) USING (target_id) JOIN ({DEEPEST}) USING (target_id)", "tret"))
def tail_table(spark, d):
    return rounded(risk.tail_table(target_returns(Parts(spark, d)), ["target_id"]), "var", "cvar", "max_drawdown")


fx.cte("hist", "SELECT *, row_number() OVER (ORDER BY date DESC) AS i FROM wide WHERE date <= DATE '1998-06-30' AND equity IS NOT NULL AND bond IS NOT NULL QUALIFY i <= 500", "wide")
DRAWS = 2000


def history(spark, d):
    return risk.return_history(wide_returns(Parts(spark, d)), F.lit("1998-06-30").cast("date"), 500)


@query("K4_return_history", fx.sql("SELECT 'pair' AS portfolio_id, date, i, round(equity, 8) AS equity, round(bond, 8) AS bond FROM hist", "hist"))
def return_history(spark, d):
    return rounded(history(spark, d).select("portfolio_id", "date", "i", "equity", "bond"), "equity", "bond")


fx.cte("draws", f"SELECT path, step, (path * 7919 + step * 104729 + path * step * 31) % 500 + 1 AS i FROM (SELECT unnest(range({DRAWS})) AS path) CROSS JOIN (SELECT unnest(range(1, {H + 1})) AS step)")


def bootstrap_ctes(prefix: str, draws: str, f_equity: float, f_bond: float) -> None:
    fx.cte(
        f"{prefix}path",
        f"""SELECT *, value / greatest(1, max(value) OVER (PARTITION BY path ORDER BY step)) - 1 AS fall FROM (
  SELECT path, step, 0.6 * product(1 + e) OVER (PARTITION BY path ORDER BY step) + 0.4 * product(1 + b) OVER (PARTITION BY path ORDER BY step) AS value FROM (
    SELECT d.path, d.step, h.e, h.b FROM {draws} d JOIN (SELECT i, equity - avg(equity) OVER () + {f_equity} / {H} AS e, bond - avg(bond) OVER () + {f_bond} / {H} AS b FROM hist) h ON h.i = d.i))""",
        draws, "hist",
    )
    fx.cte(
        f"{prefix}tail",
        f"""SELECT v.var, v.cvar, w.var AS day_var, w.cvar AS day_cvar, m.mean, m.volatility, f.mean_drawdown FROM (SELECT -max(r) AS var, -avg(r) AS cvar FROM (SELECT value - 1 AS r, row_number() OVER (ORDER BY value) AS i FROM {prefix}path WHERE step = {H}) WHERE i <= {DRAWS // 20}) v
CROSS JOIN (SELECT -max(r) AS var, -avg(r) AS cvar FROM (SELECT value - 1 AS r, row_number() OVER (ORDER BY value) AS i FROM {prefix}path WHERE step = 1) WHERE i <= {DRAWS // 20}) w
CROSS JOIN (SELECT avg(value - 1) AS mean, stddev_samp(value - 1) AS volatility FROM {prefix}path WHERE step = {H}) m CROSS JOIN (SELECT avg(least(fall, 0)) AS mean_drawdown FROM (SELECT min(fall) AS fall FROM {prefix}path GROUP BY path)) f""",
        f"{prefix}path",
    )


fx.cte("hdraws", f"SELECT path, step, CAST(('0x' || substr(md5(concat_ws('-', 1, path, step)), 1, 12))::BIGINT % 500 + 1 AS INT) AS i FROM (SELECT unnest(range({DRAWS})) AS path) CROSS JOIN (SELECT unnest(range(1, {H + 1})) AS step)")
bootstrap_ctes("b", "draws", 0.004, 0.001)
bootstrap_ctes("s", "draws", 0.002, 0.003)
bootstrap_ctes("h", "hdraws", 0.004, 0.001)
TAIL = ("var", "cvar", "day_var", "day_cvar", "mean", "volatility", "mean_drawdown")


def tail_of(spark, d, f_equity=0.004, f_bond=0.001):
    past = history(spark, d)
    ids = past.select("portfolio_id").distinct()
    grid = spark.range(DRAWS).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(1), F.lit(H))).alias("step"))
    draws = grid.withColumn("i", ((F.col("path") * 7919 + F.col("step") * 104729 + F.col("path") * F.col("step") * 31) % 500 + 1).cast("int"))
    paths = risk.bootstrap_paths(past, draws, ids.select("portfolio_id", F.lit(f_equity).alias("f_equity"), F.lit(f_bond).alias("f_bond")), ids.withColumn("w_equity", F.lit(0.6)), H)
    return risk.bootstrap_tail(paths, H)


@query("K5_bootstrap_tail", fx.sql(f"SELECT 'pair' AS portfolio_id, {', '.join(f'round({t}, 7) AS {t}' for t in TAIL)} FROM btail WHERE (SELECT count(*) FROM hist) = 500", "btail", "hist"))
def bootstrap_tail(spark, d):
    return rounded(tail_of(spark, d), *TAIL, places=7)


@query("K5_hashed_draws", fx.sql(f"SELECT 'pair' AS portfolio_id, {', '.join(f'round({t}, 7) AS {t}' for t in TAIL)} FROM htail WHERE (SELECT count(*) FROM hist) = 500", "htail", "hist"))
def hashed_draws(spark, d):
    past = history(spark, d)
    ids = past.select("portfolio_id").distinct()
    draws = risk.hashed_draws(spark, DRAWS, H, 500)
    paths = risk.bootstrap_paths(past, draws, ids.select("portfolio_id", F.lit(0.004).alias("f_equity"), F.lit(0.001).alias("f_bond")), ids.withColumn("w_equity", F.lit(0.6)), H)
    return rounded(risk.bootstrap_tail(paths, H), *TAIL, places=7)


@query("B16_early_start", fx.sql("SELECT 'pair' AS portfolio_id, min(date) AS first, min(date) < DATE '2005-05-01' AS early FROM reb", "reb"))
def early_start(spark, d):
    from panelcast.operators import ingest

    return ingest.early_start(Plan(spark, d).rebalances)
