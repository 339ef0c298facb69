"""Queries of calendars, alignment, labels and folds (C, E, parts of B)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from panelcast.operators import models, panel, portfolio
from panelcast.plans import fixtures as fx
from panelcast.plans.register import query, r, rounded

TRAIN_TEST = """SELECT f.target_id, f.fold_id, 'train' AS part, l.rn, l.date, l.y FROM purged f JOIN labels l ON l.target_id = f.target_id AND l.rn BETWEEN f.train_lo AND f.train_hi
UNION ALL SELECT f.target_id, f.fold_id, 'test', l.rn, l.date, l.y FROM purged f JOIN labels l ON l.target_id = f.target_id AND l.rn BETWEEN f.test_lo AND f.test_hi"""
fx.cte("frows", TRAIN_TEST, "purged", "labels")


class Parts:
    """The tables that most queries start from."""

    def __init__(self, spark, d):
        self.prices, self.signals = fx.prices(spark, d), fx.signals(spark, d)
        self.pairs, self.transforms = fx.pairs(self.prices, self.signals), fx.transforms(self.signals)
        self.calendar = panel.target_calendar(self.prices)

    @cached_property
    def aligned(self):
        return panel.asof_align(self.signals, self.calendar, self.pairs)

    @cached_property
    def moved(self):
        return panel.stationary(self.aligned, self.transforms)

    @cached_property
    def panel(self):
        return panel.lag_signals(self.moved)

    @cached_property
    def labels(self):
        return panel.forward_return(self.calendar, fx.HORIZON)

    @cached_property
    def folds(self):
        return panel.walk_forward_folds(self.calendar, fx.TRAIN, fx.TEST, fx.EMBARGO, fx.TUNING)

    @cached_property
    def purged(self):
        return panel.purge(self.folds, self.labels, fx.HORIZON)

    @cached_property
    def rows(self):
        return models.fold_rows(self.labels, self.purged)


def wide_rows(p):
    """Rows of every fold with the two inputs a and b, joined before the folds repeat them."""
    return models.fold_rows(p.labels.join(two_inputs(p), ["target_id", "rn"]), p.purged)


def series_rows(p, *series: str):
    """Rows of every fold for each series of the panel (or those named)."""
    x = p.panel.select("target_id", "rn", "series_id", "x")
    return models.fold_rows(p.labels.join(x.filter(F.col("series_id").isin(*series)) if series else x, ["target_id", "rn"]), p.purged)


@query("E1_target_calendar", fx.sql("SELECT target_id, date, round(price, 12) AS price, rn FROM cal", "cal"))
def target_calendar(spark, d):
    return rounded(Parts(spark, d).calendar, "price", places=12)


@query("C3_asof_align", fx.sql("SELECT target_id, series_id, date, rn, round(x, 8) AS x, age, age BETWEEN 1 AND 3 AS carried FROM aligned WHERE x IS NOT NULL", "aligned"))
def asof_align(spark, d):
    return rounded(Parts(spark, d).aligned.filter("x IS NOT NULL"), "x").withColumn("carried", F.col("age").between(1, 3))


@query(
    "C4_exact_align",
    fx.sql("SELECT c.target_id, p.series_id, c.date, c.rn, round(s.value, 8) AS x FROM cal c JOIN pairs p ON p.target_id = c.target_id LEFT JOIN signals s ON s.series_id = p.series_id AND s.date = c.date", "cal", "pairs", "signals"),
)
def exact_align(spark, d):
    p = Parts(spark, d)
    return rounded(panel.exact_align(p.signals, p.calendar, p.pairs), "x")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
fx.cte("factors", "SELECT date, " + ", ".join(f"max(value) FILTER (series_id = 'seg_{s}') AS {s.lower()}" for s in SEGMENTS) + " FROM signals WHERE series_id LIKE 'seg%' GROUP BY 1", "signals")


def factors(p):
    long = p.signals.filter(F.col("series_id").startswith("seg_"))
    return long.groupBy("date").agg(*[F.max(F.when(F.col("series_id") == f"seg_{s}", F.col("value"))).alias(s.lower()) for s in SEGMENTS])


@query("C5_merge_factors", fx.sql("SELECT c.target_id, c.date, " + ", ".join(f"round(f.{s.lower()}, 6) AS {s.lower()}" for s in SEGMENTS) + " FROM cal c LEFT JOIN factors f ON f.date = c.date", "cal", "factors"))
def merge_factors(spark, d):
    p = Parts(spark, d)
    return rounded(panel.merge_factors(p.calendar.select("target_id", "date"), factors(p)), *[s.lower() for s in SEGMENTS], places=6)


@query(
    "C6_factor_coverage",
    fx.sql(
        "SELECT c.target_id, count(f.date) AS usable, count(*) - count(f.date) AS without, (SELECT min(date) FROM factors) AS first_factor, (SELECT max(date) FROM factors) AS last_factor FROM cal c LEFT JOIN factors f ON f.date = c.date GROUP BY 1",
        "cal", "factors",
    ),
)
def factor_coverage(spark, d):
    p = Parts(spark, d)
    return panel.factor_coverage(factors(p), p.calendar)


PAIR = f"('{fx.EQUITY}', '{fx.BOND}')"
fx.cte("common", f"SELECT date FROM prices WHERE target_id IN {PAIR} AND price IS NOT NULL GROUP BY 1 HAVING count(DISTINCT target_id) = 2", "prices")
fx.cte(
    "wide",
    f"""SELECT date, row_number() OVER (ORDER BY date) AS rn, e / lag(e) OVER (ORDER BY date) - 1 AS equity, b / lag(b) OVER (ORDER BY date) - 1 AS bond FROM (
  SELECT date, max(price) FILTER (target_id = '{fx.EQUITY}') AS e, max(price) FILTER (target_id = '{fx.BOND}') AS b FROM prices WHERE date IN (SELECT date FROM common) GROUP BY 1)""",
    "prices", "common",
)


def pair_prices(p):
    role = F.when(F.col("target_id") == fx.EQUITY, "equity").when(F.col("target_id") == fx.BOND, "bond")
    return p.prices.withColumn("asset", role).filter("asset IS NOT NULL").select(F.lit("pair").alias("portfolio_id"), "asset", "date", "price")


def wide_returns(p):
    from pyspark.sql import Window

    long = portfolio.daily_returns(pair_prices(p))
    wide = long.groupBy("portfolio_id", "date").agg(*[F.max(F.when(F.col("asset") == a, F.col("r"))).alias(a) for a in ("equity", "bond")])
    return wide.withColumn("rn", F.row_number().over(Window.partitionBy("portfolio_id").orderBy("date")))


@query("C7_common_calendar", fx.sql("SELECT 'pair' AS group_id, date FROM common", "common"))
def common_calendar(spark, d):
    return panel.common_calendar(pair_prices(Parts(spark, d)).withColumnRenamed("portfolio_id", "group_id"))


fx.cte("start", "SELECT min(date) AS first FROM common", "common")
fx.cte(
    "joint",
    f"""SELECT asset, date, rn, age, CASE WHEN age <= 3 THEN price END AS x FROM (
  SELECT c.asset, c.date, c.rn, p.price, c.rn - coalesce((SELECT max(u.rn) FROM jcal u WHERE u.date <= p.date), 0) AS age FROM (SELECT * FROM jcal CROSS JOIN (SELECT '{fx.EQUITY}' AS t, 'equity' AS asset UNION ALL SELECT '{fx.BOND}', 'bond')) c
  ASOF LEFT JOIN (SELECT * FROM prices WHERE price IS NOT NULL) p ON p.target_id = c.t AND c.date >= p.date)""",
    "jcal", "prices",
)
fx.cte(
    "jcal",
    f"""SELECT date, row_number() OVER (ORDER BY date) AS rn FROM (SELECT DISTINCT date FROM prices WHERE target_id IN {PAIR} AND price IS NOT NULL) WHERE date BETWEEN (SELECT first FROM start) AND (SELECT min(m) FROM (SELECT max(date) AS m FROM prices WHERE target_id IN {PAIR} GROUP BY target_id))""",
    "prices", "start",
)


@query(
    "C8_joint_returns",
    fx.sql("SELECT 'pair' AS portfolio_id, asset, date, round(CASE WHEN rn = 1 THEN CASE WHEN x IS NOT NULL THEN 0 END ELSE x / lag(x) OVER (PARTITION BY asset ORDER BY rn) - 1 END, 8) AS r, coalesce(age, 0) > 0 AS closed, x IS NULL AS gap FROM joint", "joint"),
)
def joint_calendar(spark, d):
    prices = pair_prices(Parts(spark, d))
    common = panel.common_calendar(prices.withColumnRenamed("portfolio_id", "group_id"))
    starts = common.groupBy(F.col("group_id").alias("portfolio_id")).agg(F.min("date").alias("first"))
    return rounded(portfolio.joint_calendar_returns(prices, starts), "r")


@query("E2_stationary", fx.sql("SELECT target_id, series_id, date, rn, round(t, 6) AS t FROM moved WHERE t IS NOT NULL", "moved"))
def stationary(spark, d):
    return rounded(Parts(spark, d).moved.select("target_id", "series_id", "date", "rn", "t").filter("t IS NOT NULL"), "t", places=6)


@query("E3_lag_signals", fx.sql("SELECT target_id, series_id, date, rn, round(x, 6) AS x FROM panel", "panel"))
def lag_signals(spark, d):
    return rounded(Parts(spark, d).panel, "x", places=6)


@query("E4_forward_return", fx.sql("SELECT target_id, rn, date, round(y, 8) AS y, label_end FROM labels", "labels"))
def forward_return(spark, d):
    return rounded(Parts(spark, d).labels.select("target_id", "rn", "date", "y", "label_end"), "y")


@query("E5_build_panel", fx.sql("SELECT p.target_id, p.series_id, p.date, p.rn, round(p.x, 6) AS x, round(l.y, 8) AS y, l.label_end FROM panel p JOIN labels l ON l.target_id = p.target_id AND l.rn = p.rn", "panel", "labels"))
def build_panel(spark, d):
    p = Parts(spark, d)
    x, y = panel.build_panel(p.prices, p.signals, p.transforms, p.pairs, fx.HORIZON)
    return x.join(y.drop("date", "price"), ["target_id", "rn"]).select("target_id", "series_id", "date", "rn", r("x", "x", 6), r("y", "y"), "label_end")


@query(
    "E6_label_window_calendar",
    fx.sql(
        f"""SELECT target_id, date, rn, CASE WHEN count(*) OVER w = 5 THEN sum(me) OVER w END AS month_ends, CASE WHEN count(*) OVER w = 5 THEN sum(ms) OVER w END AS month_starts, CASE WHEN count(*) OVER w = 5 THEN sum(ff) OVER w END AS first_fridays FROM (
  SELECT target_id, date, rn, CASE WHEN date_trunc('month', lead(date) OVER o) <> date_trunc('month', date) THEN 1 ELSE 0 END AS me, CASE WHEN date_trunc('month', lag(date) OVER o) <> date_trunc('month', date) THEN 1 ELSE 0 END AS ms,
    CASE WHEN isodow(date) = 5 AND day(date) <= 7 THEN 1 ELSE 0 END AS ff FROM cal WINDOW o AS (PARTITION BY target_id ORDER BY rn))
WINDOW w AS (PARTITION BY target_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND {fx.HORIZON} FOLLOWING)""",
        "cal",
    ),
)
def label_window_calendar(spark, d):
    return panel.label_window_calendar(Parts(spark, d).calendar, fx.HORIZON)


fx.cte("levels", "SELECT target_id, series_id, date, rn, lag(level) OVER (PARTITION BY target_id, series_id ORDER BY rn) AS x FROM moved", "moved")


def lagged_levels(p):
    return panel.lag_signals(p.aligned.withColumn("t", F.col("x")))


@query(
    "E7_label_window_moves",
    fx.sql(
        f"SELECT target_id, series_id, date, rn, round(lead(x, {1 + fx.HORIZON}) OVER w - lead(x, 1) OVER w, 6) + 0.0 AS move, lead(date, {1 + fx.HORIZON}) OVER w AS move_end FROM levels WINDOW w AS (PARTITION BY target_id, series_id ORDER BY rn)",
        "levels",
    ),
)
def label_window_moves(spark, d):
    return rounded(panel.label_window_moves(lagged_levels(Parts(spark, d)), 1, fx.HORIZON), "move", places=6)


@query(
    "E8_level_and_change",
    fx.sql("SELECT target_id, series_id, date, rn, round(t, 6) AS t FROM (SELECT target_id, series_id, date, rn, t FROM moved UNION ALL SELECT target_id, concat(series_id, '_level'), date, rn, level FROM moved WHERE series_id LIKE 'seg%')", "moved"),
)
def level_and_change(spark, d):
    p = Parts(spark, d)
    return rounded(panel.level_and_change(p.aligned, p.transforms), "t", places=6)


fx.cte(
    "counts",
    f"""SELECT target_id, date, rn, CASE WHEN count(*) OVER w = {fx.HORIZON} THEN sum(me) OVER w END AS month_ends, CASE WHEN count(*) OVER w = {fx.HORIZON} THEN sum(ms) OVER w END AS month_starts, CASE WHEN count(*) OVER w = {fx.HORIZON} THEN sum(ff) OVER w END AS first_fridays FROM (
  SELECT target_id, date, rn, (month(lead(date) OVER o) <> month(date))::INT AS me, (month(lag(date) OVER o) <> month(date))::INT AS ms, (isodow(date) = 5 AND day(date) <= 7)::INT AS ff FROM cal WINDOW o AS (PARTITION BY target_id ORDER BY rn))
WINDOW w AS (PARTITION BY target_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND {fx.HORIZON} FOLLOWING)""",
    "cal",
)


@query(
    "E8_ensemble_inputs",
    fx.sql(
        """SELECT target_id, series_id, date, rn, round(lag(t) OVER (PARTITION BY target_id, series_id ORDER BY rn), 6) AS x FROM (SELECT target_id, series_id, date, rn, t FROM moved UNION ALL SELECT target_id, concat(series_id, '_level'), date, rn, level FROM moved WHERE series_id LIKE 'seg%')
UNION ALL SELECT target_id, series_id, date, rn, CAST(x AS DOUBLE) FROM (SELECT target_id, date, rn, unnest(['month_ends', 'month_starts', 'first_fridays']) AS series_id, unnest([month_ends, month_starts, first_fridays]) AS x FROM counts)""",
        "moved", "counts",
    ),
)
def ensemble_inputs(spark, d):
    p = Parts(spark, d)
    return rounded(panel.ensemble_inputs(p.aligned, p.transforms, p.calendar, fx.HORIZON), "x", places=6)


FOLD_COLUMNS = "target_id, fold_id, train_lo, train_hi, test_lo, test_hi"


@query("E9_walk_forward_folds", fx.sql(f"SELECT {FOLD_COLUMNS} FROM folds", "folds"))
def walk_forward_folds(spark, d):
    return Parts(spark, d).folds


@query("E10_capped_folds", fx.sql(f"SELECT target_id, fold_id, greatest(1, test_lo - {fx.EMBARGO} - 800) AS train_lo, train_hi, test_lo, test_hi FROM folds", "folds"))
def capped_folds(spark, d):
    return panel.walk_forward_folds(Parts(spark, d).calendar, fx.TRAIN, fx.TEST, fx.EMBARGO, fx.TUNING, cap=800)


@query("E11_purge", fx.sql(f"SELECT {FOLD_COLUMNS} FROM purged", "purged"))
def purge(spark, d):
    return Parts(spark, d).purged


@query("E12_too_short", fx.sql("SELECT target_id, count(*) AS have, 1740 AS need FROM cal GROUP BY 1 HAVING count(*) < 1740", "cal"))
def too_short(spark, d):
    return panel.too_short(Parts(spark, d).calendar, 1700, 20, 20)


@query("E13_retune_schedule", fx.sql("SELECT target_id, fold_id, fold_id // 13 AS tuning_id, fold_id % 13 = 0 AS retunes FROM folds", "folds"))
def retune_schedule(spark, d):
    return panel.retune_schedule(Parts(spark, d).folds, fx.TEST)


@query("E14_every_hth", fx.sql(f"SELECT target_id, date, rn FROM cal WHERE (rn - 1) % {fx.HORIZON} = 0", "cal"))
def every_hth(spark, d):
    return panel.every_hth(Parts(spark, d).calendar, "target_id", "date", fx.HORIZON).select("target_id", "date", "rn")


@query("E15_month_end_dates", fx.sql("SELECT target_id, max(date) AS date FROM cal GROUP BY target_id, date_trunc('month', date)", "cal"))
def month_end_dates(spark, d):
    return panel.month_end_dates(Parts(spark, d).calendar)


@query(
    "E16_autocorr_overlap",
    fx.sql(
        "SELECT target_id, round(CASE WHEN rho >= 1 THEN 63 ELSE least(greatest(1 / (1 - rho), 1), 63) END, 8) AS overlap FROM (SELECT target_id, corr(y, b) AS rho FROM (SELECT target_id, y, lag(y) OVER (PARTITION BY target_id ORDER BY rn) AS b FROM labels WHERE y IS NOT NULL) GROUP BY 1)",
        "labels",
    ),
)
def autocorr_overlap(spark, d):
    return rounded(panel.autocorr_overlap(Parts(spark, d).labels), "overlap")


@query(
    "C9_asof_forecast",
    fx.sql(
        "SELECT a.target_id, a.date, round(b.y, 8) AS predicted, b.date AS made FROM (SELECT target_id, date FROM cal) a ASOF LEFT JOIN (SELECT target_id, date, y FROM labels WHERE isodow(date) = 1 AND y IS NOT NULL) b ON a.target_id = b.target_id AND a.date >= b.date",
        "cal", "labels",
    ),
)
def asof_forecast(spark, d):
    p = Parts(spark, d)
    made = p.labels.filter(F.weekday("date") == 0).select("target_id", "date", F.col("y").alias("predicted"))
    return rounded(panel.asof_forecast(p.calendar, made), "predicted")


@query("C10_rows_in_fold", fx.sql("SELECT target_id, fold_id, part, count(*) AS n, min(rn) AS first_rn, max(rn) AS last_rn, round(avg(y), 8) AS mean_y FROM frows GROUP BY 1, 2, 3", "frows"))
def rows_in_fold(spark, d):
    rows = Parts(spark, d).rows.groupBy("target_id", "fold_id", "part").agg(F.count("*").alias("n"), F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"), F.avg("y").alias("mean_y"))
    return rounded(rows, "mean_y")


@query(
    "C11_pairs_known_by",
    fx.sql("SELECT l.target_id AS portfolio_id, c.date AS rebalance, count(*) AS n, round(sum(l.y), 6) AS total FROM labels l JOIN cal c ON c.target_id = l.target_id AND l.label_end < c.date GROUP BY 1, 2", "labels", "cal"),
)
def pairs_known_by(spark, d):
    p = Parts(spark, d)
    name = lambda df: df.withColumnRenamed("target_id", "portfolio_id")
    return rounded(panel.pairs_known_by(name(p.labels), name(p.calendar), {"total": F.col("y")}), "total", places=6)


@query(
    "B7_clip_standardise",
    fx.sql(
        """SELECT target_id, series_id, fold_id, part, count(z) AS n, round(sum(z), 4) AS total, round(max(z), 6) AS most FROM (
  SELECT target_id, series_id, fold_id, part, (least(greatest(x, m - 4 * s), m + 4 * s) - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS z FROM (
    SELECT r.target_id, p.series_id, r.fold_id, r.part, p.x, avg(p.x) FILTER (r.part = 'train') OVER w AS m, stddev_samp(p.x) FILTER (r.part = 'train') OVER w AS s FROM frows r JOIN panel p ON p.target_id = r.target_id AND p.rn = r.rn
    WINDOW w AS (PARTITION BY r.target_id, p.series_id, r.fold_id)) WHERE x IS NOT NULL) GROUP BY 1, 2, 3, 4""",
        "frows", "panel",
    ),
)
def clip_standardise(spark, d):
    rows = series_rows(Parts(spark, d)).filter("x IS NOT NULL")
    z = panel.clip_standardise(rows).groupBy("target_id", "series_id", "fold_id", "part").agg(F.count("z").alias("n"), F.sum("z").alias("total"), F.max("z").alias("most"))
    return rounded(rounded(z, "total", places=4), "most", places=6)


fx.cte("two", "SELECT target_id, rn, max(x) FILTER (series_id = 'disc_F') AS a, max(x) FILTER (series_id = 'disc_O') AS b FROM panel GROUP BY 1, 2", "panel")


def two_inputs(p):
    return p.panel.groupBy("target_id", "rn").agg(*[F.max(F.when(F.col("series_id") == s, F.col("x"))).alias(n) for s, n in (("disc_F", "a"), ("disc_O", "b"))])


@query("B8_polynomial_features", fx.sql('SELECT target_id, rn, round(a * a, 14) AS aa, round(a * b, 14) AS ab, round(b * b, 14) AS bb, round(a * a * b, 14) AS aab FROM two', "two"))
def polynomial_features(spark, d):
    rows = panel.polynomial_features(two_inputs(Parts(spark, d)), ["a", "b"], 3)
    return rows.select("target_id", "rn", r("`a*a`", "aa", 14), r("`a*b`", "ab", 14), r("`b*b`", "bb", 14), r("`a*a*b`", "aab", 14))


@query(
    "B9_shape_feature",
    fx.sql("SELECT target_id, rn, CASE WHEN b <= 0.0605 THEN round(a / (b + 1), 6) END AS f, coalesce(a IS NOT NULL AND b > 0.0605, false) AS f_error FROM two", "two"),
)
def shape_feature(spark, d):
    rows = panel.shape_feature(two_inputs(Parts(spark, d)), "try_divide(u, if(v > 0.0605D, 0, v + 1))", {"u": "a", "v": "b"})
    return rows.select("target_id", "rn", r("f", "f", 6), "f_error")


@query(
    "B10_complete_rows",
    fx.sql("SELECT l.target_id, l.rn, l.date FROM labels l JOIN (SELECT target_id, rn FROM panel GROUP BY 1, 2 HAVING count(x) = 10) f ON f.target_id = l.target_id AND f.rn = l.rn WHERE l.y IS NOT NULL", "labels", "panel"),
)
def complete_rows(spark, d):
    p = Parts(spark, d)
    return panel.complete_rows(p.panel, p.labels, 10).select("target_id", "rn", "date")
