"""Queries of solver-backed models (G3, G5 to G18) and scenarios (L)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcast.operators import boosted, models, panel, portfolio, scenario, scoring
from panelcast.plans import fixtures as fx
from panelcast.plans.panel_queries import Parts, lagged_levels, series_rows, two_inputs, wide_rows
from panelcast.plans.portfolio_queries import TAIL, Plan, tail_of
from panelcast.plans.register import query, rounded
from panelcast.plans.scoring_queries import FOLD_SCREEN, forecasts

H = fx.HORIZON


# G3: two inputs and Cramer's rule say the same as the solver ---------------------------------------------------------
fx.cte(
    "ols",
    """SELECT target_id, fold_id, (caa.b2 * say - caa.ab * sby) / d AS ba, (caa.a2 * sby - caa.ab * say) / d AS bb, my - (caa.b2 * say - caa.ab * sby) / d * ma - (caa.a2 * sby - caa.ab * say) / d * mb AS b0 FROM (
  SELECT target_id, fold_id, {'a2': var_pop(a), 'b2': var_pop(b), 'ab': covar_pop(a, b)} AS caa, covar_pop(a, y) AS say, covar_pop(b, y) AS sby, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) * var_pop(b) - pow(covar_pop(a, b), 2) AS d
  FROM inp WHERE part = 'train' AND a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 15)""",
    "inp",
)


@query("G3_ols_factors", fx.sql("SELECT i.target_id, i.fold_id, i.rn, round(o.b0 + o.ba * i.a + o.bb * i.b, 7) AS predicted FROM inp i JOIN ols o ON o.target_id = i.target_id AND o.fold_id = i.fold_id WHERE i.part = 'test' AND i.a IS NOT NULL AND i.b IS NOT NULL", "inp", "ols"))
def ols_factors(spark, d):
    out = models.ols_factors(wide_rows(Parts(spark, d)), ["a", "b"]).filter("part = 'test'")
    return rounded(out.select("target_id", "fold_id", "rn", "predicted"), "predicted", places=7)


def expanded(p: Parts):
    """Two inputs, clipped and standardised per fold, and their products up to degree 2."""
    z = panel.clip_standardise(series_rows(p, "disc_F", "disc_O")).groupBy("target_id", "fold_id", "part", "rn", "date", "y").agg(*[F.max(F.when(F.col("series_id") == s, F.col("z"))).alias(n) for s, n in (("disc_F", "a"), ("disc_O", "b"))])
    return z.withColumns({"aa": F.col("a") * F.col("a"), "ab": F.col("a") * F.col("b"), "bb": F.col("b") * F.col("b")})


TERMS = ["a", "b", "aa", "ab", "bb"]


FIT_B = "SELECT target_id, fold_id, CASE WHEN min(b) < max(b) THEN regr_slope(y, b) ELSE 0 END AS slope, CASE WHEN min(b) < max(b) THEN regr_intercept(y, b) ELSE avg(y) END AS base FROM inp WHERE part = 'train' AND y IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2"


@query("Q1_pluggable_model", fx.sql(f"SELECT i.target_id, i.fold_id, i.part, i.rn, round(f.base + f.slope * i.b, 9) AS predicted FROM inp i JOIN ({FIT_B}) f ON f.target_id = i.target_id AND f.fold_id = i.fold_id WHERE i.b IS NOT NULL", "inp"))
def pluggable_model(spark, d):
    out = models.forecasts_of(models.ShapeModel("b"), wide_rows(Parts(spark, d)))
    return rounded(out.select("target_id", "fold_id", "part", "rn", "predicted"), "predicted", places=9)


@query("Q1_describe", fx.sql(f"SELECT target_id, fold_id, printf('%.4f + %.4f * b', base, slope) AS equation FROM ({FIT_B})", "inp"))
def describe(spark, d):
    model = models.ShapeModel("b")
    return model.describe(model.fit(wide_rows(Parts(spark, d))))


@query("Q2_user_shape", fx.sql("SELECT target_id, rn, round(a * a - 2 * b + 1, 9) AS f, false AS f_error FROM two", "two"))
def user_shape(spark, d):
    """A user's arithmetic with two placeholders, bound to two signals."""
    rows = panel.shape_feature(two_inputs(Parts(spark, d)), "x * x - 2 * y + 1", {"x": "a", "y": "b"})
    return rounded(rows.select("target_id", "rn", "f", "f_error"), "f", places=9)


@query("G5_lasso_path")
def lasso_path(spark, d):
    return models.lasso_path(expanded(Parts(spark, d)), TERMS, H)


@query("G5_capped_path")
def capped_path(spark, d):
    """G5 with at most two terms."""
    return models.lasso_path(expanded(Parts(spark, d)), TERMS, H, max_terms=2)


@query("G6_derived_candidates")
def derived_candidates(spark, d):
    """Lassos on all products of the inputs up to degree 1, 2 and 3; per target the best by signal rank IC."""
    rows = expanded(Parts(spark, d))
    a, b = F.col("a"), F.col("b")
    cubes = {"aaa": a * a * a, "aab": a * a * b, "abb": a * b * b, "bbb": b * b * b}
    grid = {"degree 1": TERMS[:2], "degree 2": TERMS, "degree 3": [*TERMS, *cubes]}
    made = models.derived_candidates(rows.withColumns(cubes), grid, H)
    scores = scoring.rank_ic(scoring.signal_forecasts(made), ["target_id", "model_id"], "signal", "realised").withColumnRenamed("rank_ic", "signal_rank_ic")
    return scoring.best_candidate(scores)


RHO = f"""SELECT target_id, fold_id, series_id, n, least(s + (1 + 3 * s) / n + 3 * (1 + 3 * s) / n / n, 0.9999) AS rho FROM (SELECT target_id, fold_id, series_id, regr_slope(x, before) AS s, regr_count(x, before) AS n FROM (
  SELECT r.target_id, r.fold_id, l.series_id, l.x, lag(l.x) OVER (PARTITION BY r.target_id, r.fold_id, l.series_id ORDER BY r.rn) AS before FROM frows r JOIN levels l ON l.target_id = r.target_id AND l.rn = r.rn AND l.series_id IN ('disc_O', 'disc_F') WHERE r.part = 'train') GROUP BY 1, 2, 3)"""
fx.cte("rho", f"SELECT *, rho * (pow(rho, {H}) - 1) AS kappa FROM ({RHO})", "frows", "levels")


def fold_levels(p: Parts):
    x = lagged_levels(p).filter(F.col("series_id").isin("disc_O", "disc_F")).select("target_id", "rn", "series_id", "x")
    return models.fold_rows(p.labels.join(x, ["target_id", "rn"]), p.purged).filter("part = 'train'")


@query("G7_corrected_rho", fx.sql("SELECT target_id, fold_id, series_id, n, round(rho, 7) AS rho, round(kappa, 7) AS kappa FROM rho", "rho"))
def corrected_rho(spark, d):
    return rounded(models.corrected_rho(fold_levels(Parts(spark, d)), H), "rho", "kappa", places=7)


@query("Q3_custom_kappa", fx.sql("SELECT target_id, fold_id, series_id, round(rho, 7) AS rho, round(-0.5 * (1 - rho), 7) AS kappa FROM rho", "rho"))
def custom_kappa(spark, d):
    """G7 with a user's estimator of kappa."""
    out = models.corrected_rho(fold_levels(Parts(spark, d)), H, kappa=lambda rho, h, lag: -0.5 * (1 - rho))
    return rounded(out.drop("n"), "rho", "kappa", places=7)


fx.cte("lmoves", f"SELECT *, lead(x, {1 + H}) OVER w - lead(x, 1) OVER w AS move FROM levels WINDOW w AS (PARTITION BY target_id, series_id ORDER BY rn)", "levels")
INNOVATION = """SELECT target_id, fold_id, series_id, round(sqrt(avg(u * u)), 8) AS spread, count(u) AS n FROM (SELECT *, v - avg(v) OVER (PARTITION BY target_id, fold_id, series_id) AS u FROM (
  SELECT r.target_id, r.fold_id, m.series_id, m.move - k.kappa * m.x AS v FROM frows r JOIN lmoves m ON m.target_id = r.target_id AND m.rn = r.rn JOIN rho k ON k.target_id = r.target_id AND k.fold_id = r.fold_id AND k.series_id = m.series_id WHERE r.part = 'train')) GROUP BY 1, 2, 3"""


def innovation_rows(p: Parts):
    moves = panel.label_window_moves(lagged_levels(p), 1, H).filter(F.col("series_id").isin("disc_O", "disc_F")).select("target_id", "series_id", "rn", "move")
    levels = fold_levels(p)
    return models.innovations(levels.join(moves, ["target_id", "series_id", "rn"]), models.corrected_rho(levels, H))


@query("G8_innovations", fx.sql(INNOVATION, "frows", "lmoves", "rho"))
def innovations(spark, d):
    rows = innovation_rows(Parts(spark, d)).groupBy("target_id", "fold_id", "series_id").agg(F.sqrt(F.avg(F.col("u") * F.col("u"))).alias("spread"), F.count("u").alias("n"))
    return rounded(rows, "spread")


@query("G9_lasso_given_controls")
def lasso_given_controls(spark, d):
    p = Parts(spark, d)
    keys = ["target_id", "fold_id", "rn"]
    u = innovation_rows(p).groupBy(*keys).agg(*[F.max(F.when(F.col("series_id") == s, F.col("u"))).alias(f"u_{n}") for s, n in (("disc_F", "a"), ("disc_O", "b"))])
    rows = expanded(p).join(u, keys, "left")
    return models.lasso_given_controls(rows, ["u_a", "u_b"], ["a", "b"], H)


#: G10's parts: the naive one in all folds but every third, the shape one in those with odd numbers.
@query(
    "G10_hybrid_forecast",
    fx.sql(
        """SELECT target_id, fold_id, part, rn, round(CASE WHEN has_level AND has_flow THEN level + flow - m WHEN has_level THEN level WHEN has_flow THEN flow ELSE ym END, 11) AS predicted FROM (
  SELECT r.*, l.predicted AS level, f.predicted AS flow, count(l.predicted) OVER w > 0 AS has_level, count(f.predicted) OVER w > 0 AS has_flow, avg(f.predicted) FILTER (r.part = 'train') OVER w AS m, avg(r.y) FILTER (r.part = 'train') OVER w AS ym
  FROM frows r LEFT JOIN (SELECT * FROM fcast WHERE model_id = 'naive' AND fold_id % 3 > 0) l USING (target_id, fold_id, part, rn) LEFT JOIN (SELECT * FROM fcast WHERE model_id = 'shape' AND fold_id % 2 > 0) f USING (target_id, fold_id, part, rn)
  WINDOW w AS (PARTITION BY r.target_id, r.fold_id)) WHERE part = 'test'""",
        "frows", "fcast",
    ),
)
def hybrid_forecast(spark, d):
    p = Parts(spark, d)
    f = forecasts(p)
    out = models.hybrid_forecast(p.rows, f.filter("model_id = 'naive' AND fold_id % 3 > 0"), f.filter("model_id = 'shape' AND fold_id % 2 > 0")).filter("part = 'test'")
    return rounded(out.select("target_id", "fold_id", "part", "rn", "predicted"), "predicted", places=11)


@query("G11_ensemble_mean", fx.sql("SELECT target_id, fold_id, part, rn, CASE WHEN count(predicted) = 2 THEN round(avg(predicted), 11) END AS predicted FROM fcast WHERE part = 'test' GROUP BY 1, 2, 3, 4", "fcast"))
def ensemble_mean(spark, d):
    out = models.ensemble_mean(forecasts(Parts(spark, d)), 2).filter("part = 'test'")
    return rounded(out.select("target_id", "fold_id", "part", "rn", "predicted"), "predicted", places=11)


@query(
    "G11_ensemble_folds",
    fx.sql(
        f"""SELECT o.target_id, o.fold_id, CASE WHEN count(o.own_level) = 2 THEN round(avg(o.own_level), 9) END AS own_level, coalesce(any_value(k.signals), '') AS signals FROM own o
LEFT JOIN (SELECT target_id, fold_id, string_agg(series_id, ',' ORDER BY series_id) AS signals FROM ({FOLD_SCREEN}) WHERE abs(rank_ic) > 0.1 OR (abs(rank_ic) > 0.02 AND series_id LIKE 'disc%') GROUP BY 1, 2) k USING (target_id, fold_id) GROUP BY 1, 2""",
        "own", "ftrain",
    ),
)
def ensemble_folds(spark, d):
    """Two members that screen differently: one all series by a higher bound, one the discounts by the usual one."""
    p = Parts(spark, d)
    scored = rounded(screened(series_rows(p).withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})), "rank_ic")
    one = scored.select("target_id", "fold_id", "series_id", (F.abs("rank_ic") > 0.1).alias("kept"), F.lit("naive").alias("member"))
    two = scored.filter(F.col("series_id").startswith("disc")).select("target_id", "fold_id", "series_id", "kept", F.lit("shape").alias("member"))
    levels = scoring.own_level(forecasts(p)).withColumnRenamed("model_id", "member")
    out = models.ensemble_folds(levels, one.unionByName(two), 2)
    return rounded(out.withColumn("signals", F.array_join("signals", ",")), "own_level", places=9)


TERM_ROWS = "SELECT o_orderpriority AS target_id, concat('m', o_custkey % 4) AS member, concat('t', o_custkey % 30) AS term, round(avg(o_totalprice), 2) AS coef FROM orders GROUP BY 1, 2, 3"


@query("G12_merge_terms", f"SELECT target_id, term, round(sum(coef) / 4, 6) AS coef FROM ({TERM_ROWS}) GROUP BY 1, 2 HAVING sum(coef) <> 0")
def merge_terms(spark, d):
    o = fx.table(spark, d, "orders")
    terms = o.groupBy(F.col("o_orderpriority").alias("target_id"), F.concat(F.lit("m"), F.col("o_custkey") % 4).alias("member"), F.concat(F.lit("t"), F.col("o_custkey") % 30).alias("term")).agg(F.round(F.avg("o_totalprice"), 2).alias("coef"))
    return rounded(models.merge_terms(terms, 4), "coef", places=6)


#: Boosted trees: G14's inner walk-forward trains on at most so many rows; rounds and depth of the grid at most.
TUNING_TRAIN, ROUNDS, DEPTH = 252, 3, 2


def boosted_grid(spark):
    """Two configurations, leaves as they are or shrunk, each with four settings of depth and least rows of a leaf."""
    rows = [(c, f"{c}, depth {n}, leaf {leaf}", ROUNDS, n, 0.3, leaf, penalty) for c, penalty in (("plain", 0.0), ("shrunk", 20.0)) for n in (1, DEPTH) for leaf in (10, 40)]
    return spark.createDataFrame(rows, f"config string, params string, {boosted.SETTING}")


def screened(rows):
    """Screening of each fold's inputs on its training rows."""
    return scoring.screen_over_folds(rows.filter("part = 'train'").select("target_id", "fold_id", "series_id", "x", "y"))


def tuned_settings(spark, p: Parts):
    inner = boosted.tuning_folds(p.folds, p.labels, H, fx.TUNING, min(fx.TRAIN, TUNING_TRAIN), fx.TEST, fx.EMBARGO)
    rows = models.fold_rows(p.labels.join(p.panel.select("target_id", "rn", "series_id", "x"), ["target_id", "rn"]), inner)
    return boosted.tune_grid(rows, screened(rows), inner, boosted_grid(spark), ROUNDS, DEPTH)


def fold_settings(spark, p: Parts, folds):
    """The settings of each configuration's latest tuning for every fold."""
    periods = panel.retune_schedule(p.folds, fx.TEST).join(folds.select("target_id", "fold_id"), ["target_id", "fold_id"])
    tuned = tuned_settings(spark, p).select("target_id", "tuning_id", "config", "params")
    return periods.drop("retunes").join(tuned, ["target_id", "tuning_id"]).join(boosted_grid(spark), ["config", "params"]).drop("tuning_id")


@query("G13_boosted_walk_forward")
def boosted_walk_forward(spark, d):
    p = Parts(spark, d)
    rows = series_rows(p)
    return boosted.boosted_walk_forward(rows, screened(rows), fold_settings(spark, p, p.purged), ROUNDS, DEPTH)


@query("G14_tune_grid")
def tune_grid(spark, d):
    return tuned_settings(spark, Parts(spark, d))


@query("G15_feature_importance")
def feature_importance(spark, d):
    """Shares of the inputs in each target's latest fold, for both configurations."""
    p = Parts(spark, d)
    last = models.latest_fold(p.purged)
    rows = models.fold_rows(p.labels.join(p.panel.select("target_id", "rn", "series_id", "x"), ["target_id", "rn"]), last)
    return boosted.feature_importance(rows, screened(rows), fold_settings(spark, p, last), ROUNDS, DEPTH)


# G16: two stored equations over all complete rows of the panel -------------------------------------------------------
@query(
    "G16_score_function",
    fx.sql(
        """SELECT target_id, rn, model_id, round(CASE model_id WHEN 'm1' THEN 0.5 + 2 * za + 3 * za * zb * zb ELSE -1 + 4 * zb END, 8) AS value FROM (SELECT target_id, rn, (least(greatest(a, 0.02), 0.08) - 0.05) / 0.01 AS za, (least(greatest(b, 0.03), 0.07) - 0.05) / 0.02 AS zb FROM two WHERE a IS NOT NULL AND b IS NOT NULL) CROSS JOIN (SELECT unnest(['m1', 'm2']) AS model_id)""",
        "two",
    ),
)
def score_function(spark, d):
    wide = two_inputs(Parts(spark, d)).filter("a IS NOT NULL AND b IS NOT NULL")
    rows = wide.select(F.struct("target_id", "rn").alias("row_id"), F.expr("stack(2, 'a', a, 'b', b) AS (name, x)"))
    inputs = spark.createDataFrame([(m, n, lo, hi, 0.05, sd) for m in ("m1", "m2") for n, lo, hi, sd in (("a", 0.02, 0.08, 0.01), ("b", 0.03, 0.07, 0.02))], "model_id string, name string, lo double, hi double, mean double, sd double")
    terms = spark.createDataFrame([("m1", 0, 0.5, {}), ("m1", 1, 2.0, {"a": 1}), ("m1", 2, 3.0, {"a": 1, "b": 2}), ("m2", 0, -1.0, {}), ("m2", 1, 4.0, {"b": 1})], "model_id string, term_id int, coef double, factors map<string, int>")
    return rounded(models.score_function(rows, inputs, terms).select("row_id.target_id", "row_id.rn", "model_id", "value"), "value")


fx.cte("lastfold", "SELECT * FROM purged QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY fold_id DESC) = 1", "purged")


#: G17: bounds, mean and sd of the inputs; terms with powers.
SHAP_INPUTS = {"a": (0.02, 0.08, 0.05, 0.01), "b": (0.03, 0.07, 0.05, 0.02)}
SHAP_TERMS = [(2.0, {"a": 1}), (3.0, {"a": 1, "b": 1}), (-0.5, {"b": 3}), (1.5, {"a": 2, "b": 1})]
fx.cte(
    "shap",
    """SELECT target_id, rn, train, 2 * (a - ma) + 1.5 * (a - ma) * (mb + b) + 0.75 * (a * a - maa) * (mb + b) AS phi_a, 1.5 * (b - mb) * (ma + a) - 0.5 * (b * b * b - mbbb) + 0.75 * (b - mb) * (maa + a * a) AS phi_b FROM (
  SELECT *, avg(a) FILTER (train) OVER w AS ma, avg(b) FILTER (train) OVER w AS mb, avg(a * a) FILTER (train) OVER w AS maa, avg(b * b * b) FILTER (train) OVER w AS mbbb FROM (
    SELECT t.target_id, t.rn, t.rn BETWEEN f.train_lo AND f.train_hi AS train, (least(greatest(a, 0.02), 0.08) - 0.05) / 0.01 AS a, (least(greatest(b, 0.03), 0.07) - 0.05) / 0.02 AS b FROM two t JOIN lastfold f USING (target_id) WHERE a IS NOT NULL AND b IS NOT NULL)
  WINDOW w AS (PARTITION BY target_id))""",
    "two", "lastfold",
)


def attribution(spark, d):
    """Shares of every row, against the training rows of its target's latest fold."""
    p = Parts(spark, d)
    window = models.latest_fold(p.purged).select("target_id", "train_lo", "train_hi")
    rows = two_inputs(p).join(window, "target_id").withColumn("train", F.col("rn").between(F.col("train_lo"), F.col("train_hi")))
    return models.product_attribution(rows, SHAP_INPUTS, SHAP_TERMS, ["target_id"])


@query("G17_product_attribution", fx.sql("SELECT target_id, rn, train, round(phi_a, 8) AS phi_a, round(phi_b, 8) AS phi_b FROM shap", "shap"))
def product_attribution(spark, d):
    return rounded(attribution(spark, d).filter("phi_a IS NOT NULL"), "phi_a", "phi_b")


@query("G17_mean_attribution", fx.sql("SELECT target_id, 'a' AS signal, round(avg(abs(phi_a)), 8) AS importance FROM shap WHERE train GROUP BY 1 UNION ALL SELECT target_id, 'b', round(avg(abs(phi_b)), 8) FROM shap WHERE train GROUP BY 1", "shap"))
def mean_attribution(spark, d):
    return rounded(models.mean_attribution(attribution(spark, d), ["a", "b"], ["target_id"]), "importance")


@query(
    "G18_latest_fold",
    fx.sql(
        f"""SELECT l.*, coalesce(k.signals, '') AS signals, round(f.slope, 6) AS slope, round(f.base, 8) AS base FROM lastfold l
LEFT JOIN (SELECT target_id, fold_id, string_agg(series_id, ',' ORDER BY series_id) AS signals FROM ({FOLD_SCREEN}) WHERE kept GROUP BY 1, 2) k USING (target_id, fold_id)
LEFT JOIN (SELECT target_id, fold_id, CASE WHEN min(b) < max(b) THEN regr_slope(y, b) ELSE 0 END AS slope, CASE WHEN min(b) < max(b) THEN regr_intercept(y, b) ELSE avg(y) END AS base FROM inp WHERE part = 'train' AND y IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2) f USING (target_id, fold_id)""",
        "lastfold", "ftrain", "inp",
    ),
)
def latest_fold(spark, d):
    p = Parts(spark, d)
    last = models.latest_fold(p.purged)
    x = p.panel.select("target_id", "rn", "series_id", "x")
    seen = models.fold_rows(p.labels.join(x, ["target_id", "rn"]), last).filter("part = 'train'").withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})
    fits = models.shape_coefs(models.fold_rows(p.labels.join(two_inputs(p), ["target_id", "rn"]), last), "b")
    out = models.latest_fold_fit(p.purged, rounded(scoring.screen_over_folds(seen), "rank_ic"), fits)
    return rounded(rounded(out, "slope", places=6), "base")


# L ---------------------------------------------------------------------------------------------------------------------
fx.cte("lastdate", "SELECT target_id, max(date) AS last FROM cal GROUP BY 1", "cal")
fx.cte("lasto", "SELECT t.target_id, s.series_id, arg_max(s.value, s.date) AS value, max(s.date) AS date FROM signals s JOIN lastdate t ON s.date <= t.last WHERE s.value IS NOT NULL GROUP BY 1, 2", "lastdate", "signals")


def as_of(p: Parts):
    return p.calendar.groupBy("target_id").agg(F.max("date").alias("last"))


@query("L1_last_observed", fx.sql("SELECT target_id, series_id, round(value, 6) AS value, date FROM lasto", "lasto"))
def last_observed(spark, d):
    p = Parts(spark, d)
    return rounded(scenario.last_observed(p.signals, as_of(p)), "value", places=6)


AMOUNT = """CASE WHEN c_custkey % 11 = 0 THEN 'n/a' WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 400 - 200 AS VARCHAR) WHEN series_id LIKE 'seg%' THEN concat(c_custkey % 400, ',000') WHEN series_id LIKE 'disc%' THEN concat('0.0', c_custkey % 90 + 10) ELSE CAST(c_custkey % 900 - 40 AS VARCHAR) END"""
fx.cte(
    "shock",
    f"""SELECT c_custkey AS scenario_id, target_id, series_id, {AMOUNT} AS amount, CASE WHEN c_custkey % 2 = 0 THEN 'percent' ELSE 'absolute' END AS kind
FROM (SELECT c_custkey, (10 - c_custkey % 10) % 10 AS one, CASE WHEN c_custkey % 3 = 0 THEN (15 - c_custkey % 10) % 10 END AS two FROM customer) JOIN (SELECT series_id, row_number() OVER (ORDER BY series_id) % 10 AS place FROM (SELECT DISTINCT series_id FROM signals)) ON place IN (one, two) CROSS JOIN (SELECT DISTINCT target_id FROM prices)""",
    "signals", "prices",
)
fx.cte("kinds", "SELECT DISTINCT series_id, CASE WHEN series_id LIKE 'ret%' THEN 'LOG_RETURN' WHEN series_id LIKE 'disc%' THEN 'LEVEL' ELSE 'DIFFERENCE' END AS transform FROM signals", "signals")
fx.cte(
    "levelled",
    """SELECT scenario_id, target_id, series_id, base, CASE WHEN error IS NULL THEN level END AS level, error FROM (
  SELECT *, CASE WHEN base IS NULL THEN 'no observed value' WHEN entered IS NULL THEN 'not a number' WHEN transform <> 'DIFFERENCE' AND level <= 0 THEN 'must stay above 0' WHEN abs(level - base) > 10 * span THEN 'beyond ten times the observed range' END AS error FROM (
    SELECT *, CASE kind WHEN 'percent' THEN base * (1 + entered / 100) ELSE entered END AS level FROM (
      SELECT s.*, k.transform, TRY_CAST(replace(s.amount, ',', '') AS DOUBLE) AS entered, l.value AS base, r.span FROM shock s JOIN kinds k USING (series_id) JOIN (SELECT series_id, max(value) - min(value) AS span FROM signals GROUP BY 1) r USING (series_id) LEFT JOIN (SELECT target_id, series_id, value FROM lasto) l USING (target_id, series_id))))""",
    "shock", "signals", "lasto", "kinds",
)


class Shocks:
    """Scenarios of one series each, every third one of two, for all targets; the customers are the scenarios."""

    def __init__(self, spark, d):
        self.p = Parts(spark, d)
        ids = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("scenario_id"))
        place = F.row_number().over(Window.orderBy("series_id")) % 10  # a handful of series
        series = self.p.signals.select("series_id").distinct().withColumn("place", place)
        own, key = F.col("series_id"), F.col("scenario_id")
        hit = (10 - key % 10) % 10
        ids = ids.withColumn("place", F.explode(F.when(key % 3 == 0, F.array(hit, (15 - key % 10) % 10)).otherwise(F.array(hit))))
        amount = (
            F.when(key % 11 == 0, "n/a").when(key % 2 == 0, (key % 400 - 200).cast("string")).when(own.startswith("seg"), F.concat(key % 400, F.lit(",000")))
            .when(own.startswith("disc"), F.concat(F.lit("0.0"), key % 90 + 10)).otherwise((key % 900 - 40).cast("string"))
        )
        shocks = ids.join(series, "place").join(self.p.pairs, "series_id").withColumns({"amount": amount, "kind": F.when(key % 2 == 0, "percent").otherwise("absolute")})
        last = scenario.last_observed(self.p.signals, as_of(self.p))
        self.levels = scenario.validate_shocks(shocks, self.p.signals, last, self.p.transforms)
        usable = scenario.runnable(self.levels)
        self.scenarios = usable.select("scenario_id", "target_id").distinct()
        self.base = scenario.base_inputs(self.p.aligned, last, self.p.transforms)
        self.shocked = scenario.shocked_inputs(self.base, usable)


@query("L2_validate_shocks", fx.sql("SELECT scenario_id, target_id, series_id, round(base, 6) AS base, round(level, 6) AS level, error FROM levelled", "levelled"))
def validate_shocks(spark, d):
    return rounded(Shocks(spark, d).levels, "base", "level", places=6)


fx.cte("usable", "SELECT * FROM levelled WHERE (scenario_id, target_id) NOT IN (SELECT (scenario_id, target_id) FROM levelled WHERE error IS NOT NULL)", "levelled")
fx.cte("lasttwo", "SELECT target_id, max(rn) AS rn FROM cal GROUP BY 1", "cal")
# both days read afresh, with and without the shocked observation
fx.cte(
    "shocked",
    """SELECT scenario_id, target_id, series_id, CASE transform WHEN 'LEVEL' THEN x WHEN 'LOG_RETURN' THEN CASE WHEN x > 0 AND b > 0 THEN ln(x / b) END ELSE x - b END AS base,
  CASE transform WHEN 'LEVEL' THEN sx WHEN 'LOG_RETURN' THEN CASE WHEN sx > 0 AND sb > 0 THEN ln(sx / sb) END ELSE sx - sb END AS shocked FROM (
  SELECT z.scenario_id, z.target_id, k.series_id, k.transform, t.x, y.x AS b, CASE WHEN u.level IS NULL OR t.x IS NULL THEN t.x ELSE u.level END AS sx, CASE WHEN u.level IS NULL OR y.x IS NULL OR o.date > y.date THEN y.x ELSE u.level END AS sb
  FROM (SELECT DISTINCT scenario_id, target_id FROM usable) z CROSS JOIN kinds k JOIN lasttwo n ON n.target_id = z.target_id LEFT JOIN usable u ON u.scenario_id = z.scenario_id AND u.target_id = z.target_id AND u.series_id = k.series_id
  LEFT JOIN lasto o ON o.target_id = z.target_id AND o.series_id = k.series_id JOIN aligned t ON t.target_id = z.target_id AND t.series_id = k.series_id AND t.rn = n.rn JOIN aligned y ON y.target_id = z.target_id AND y.series_id = k.series_id AND y.rn = n.rn - 1)""",
    "usable", "kinds", "lasttwo", "lasto", "aligned",
)


@query("L3_shocked_inputs", fx.sql("SELECT scenario_id, target_id, series_id, round(base, 8) AS base, round(shocked, 8) AS shocked FROM shocked", "shocked"))
def shocked_inputs(spark, d):
    s = Shocks(spark, d)
    return rounded(scenario.whole_inputs(s.base, s.shocked, s.scenarios), "base", "shocked")


fx.cte("ranges", "SELECT p.target_id, p.series_id, min(p.x) AS lo, max(p.x) AS hi FROM panel p JOIN lastfold f ON f.target_id = p.target_id AND p.rn BETWEEN f.train_lo AND f.train_hi GROUP BY 1, 2", "panel", "lastfold")


def ranges(p):
    return scenario.training_ranges(panel.rows_in_fold(p.panel, models.latest_fold(p.purged)))


@query("L4_training_ranges", fx.sql("SELECT target_id, series_id, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ranges", "ranges"))
def training_ranges(spark, d):
    return rounded(ranges(Parts(spark, d)), "lo", "hi", places=6)


#: Two equations per target: (series, clipped and standardised by the training range or not), and their terms.
EQUATIONS = {"plain": (("disc_F", "ret_A", "seg_BUILDING"), False), "products": (("disc_O", "ret_N", "seg_MACHINERY"), True)}
EQUATION_TERMS = [
    ("plain", 0, 0.1, {}), ("plain", 1, 2.0, {"disc_F": 1}), ("plain", 2, 0.5, {"ret_A": 1}), ("plain", 3, 1e-6, {"seg_BUILDING": 1}),
    ("products", 0, -0.2, {}), ("products", 1, 1.5, {"disc_O": 2, "ret_N": 1}), ("products", 2, 0.7, {"seg_MACHINERY": 1}), ("products", 3, 0.3, {"disc_O": 1, "seg_MACHINERY": 1}),
]


def equations(spark, p: Parts):
    """Inputs and terms of every target's equations."""
    uses = spark.createDataFrame([(m, n, clipped) for m, (names, clipped) in EQUATIONS.items() for n in names], "kind string, series_id string, clipped boolean")
    own = ranges(p).join(uses, "series_id")
    held = lambda c: F.when(F.col("clipped"), c)
    inputs = own.select(
        F.concat_ws("/", "target_id", "kind").alias("model_id"), "target_id", F.col("series_id").alias("name"), held(F.col("lo")).alias("lo"), held(F.col("hi")).alias("hi"),
        held((F.col("lo") + F.col("hi")) / 2).alias("mean"), held(F.col("hi") - F.col("lo")).alias("sd"),
    )
    kinds = spark.createDataFrame(EQUATION_TERMS, "kind string, term_id int, coef double, factors map<string, int>")
    terms = inputs.select("model_id", F.element_at(F.split("model_id", "/"), -1).alias("kind")).distinct().join(kinds, "kind").select("model_id", "term_id", "coef", "factors")
    return inputs, terms


def _read(name: str, value: str) -> str:
    return f"max({value}) FILTER (s.series_id = '{name}')"


def _clipped(name: str, value: str) -> str:
    return f"max((least(greatest({value}, lo), hi) - (lo + hi) / 2) / (hi - lo)) FILTER (s.series_id = '{name}' AND {value} IS NOT NULL)"


def _equation_sql(v: str) -> str:
    do, rn, sm = (_clipped(n, v) for n in EQUATIONS["products"][0])
    return f"CASE kind WHEN 'plain' THEN 0.1 + 2 * {_read('disc_F', v)} + 0.5 * {_read('ret_A', v)} + 1e-6 * {_read('seg_BUILDING', v)} ELSE -0.2 + 1.5 * pow({do}, 2) * {rn} + 0.7 * {sm} + 0.3 * {do} * {sm} END"


@query(
    "L5_run_scenarios",
    fx.sql(
        f"""SELECT scenario_id, target_id, concat(target_id, '/', kind) AS model_id, round(base, 7) AS base, round(shocked, 7) AS shocked, round(shocked - base, 7) + 0.0 AS change FROM (
  SELECT s.scenario_id, s.target_id, kind, {_equation_sql("s.base")} AS base, {_equation_sql("s.shocked")} AS shocked FROM shocked s JOIN ranges r USING (target_id, series_id) CROSS JOIN (SELECT unnest(['plain', 'products']) AS kind) GROUP BY 1, 2, 3)""",
        "shocked", "ranges",
    ),
)
def run_scenarios(spark, d):
    s = Shocks(spark, d)
    out = scenario.run_scenarios(s.base, s.shocked, s.scenarios, *equations(spark, s.p))
    return rounded(out.drop("relative"), "base", "shocked", "change", places=7)


@query(
    "L5_input_changes",
    fx.sql(
        """SELECT scenario_id, target_id, concat(target_id, '/', kind) AS model_id, series_id, round(base, 7) AS base, round(shocked, 7) AS shocked, round(lo, 7) AS lo, round(hi, 7) AS hi, NOT coalesce(shocked BETWEEN lo AND hi, false) AS extrapolated,
  CASE WHEN kind = 'products' AND NOT shocked BETWEEN lo AND hi THEN round(least(greatest(shocked, lo), hi), 7) END AS clipped_to
FROM (SELECT *, CASE WHEN series_id IN ('disc_F', 'ret_A', 'seg_BUILDING') THEN 'plain' ELSE 'products' END AS kind FROM shocked WHERE series_id IN ('disc_F', 'ret_A', 'seg_BUILDING', 'disc_O', 'ret_N', 'seg_MACHINERY')) JOIN ranges USING (target_id, series_id)
WHERE (scenario_id, target_id, series_id) IN (SELECT (scenario_id, target_id, series_id) FROM usable) AND shocked IS DISTINCT FROM base""",
        "shocked", "usable", "ranges",
    ),
)
def input_changes(spark, d):
    s = Shocks(spark, d)
    out = scenario.input_changes(s.shocked, equations(spark, s.p)[0], ranges(s.p))
    return rounded(out, "base", "shocked", "lo", "hi", "clipped_to", places=7)


@query("L6_signals_read", "SELECT DISTINCT concat('m', l_partkey % 40) AS model_id, concat('s', l_suppkey % 25) AS series_id FROM lineitem")
def signals_read(spark, d):
    rows = fx.table(spark, d, "lineitem").select(F.concat(F.lit("m"), F.col("l_partkey") % 40).alias("model_id"), F.create_map(F.concat(F.lit("s"), F.col("l_suppkey") % 25), F.lit(1)).alias("factors"))
    return scenario.signals_read(rows)


@query(
    "L7_reoptimise",
    fx.sql(
        f"""SELECT date, level, s.scenario_id, round(least(greatest(w_level + trust * (diff + s.shift) * CASE WHEN level = 5 OR premium <= 0 OR w_mv IS NULL THEN 0 ELSE greatest(w_level - w_mv, 0) / premium END, {portfolio.BOUNDS[0]}), {portfolio.BOUNDS[1]}), 6) AS equity FROM brk CROSS JOIN (SELECT unnest(range(1, 11)) AS scenario_id, unnest(range(1, 11)) * 0.0005 - 0.003 AS shift) s WHERE date = (SELECT max(date) FROM brk)""",
        "brk",
    ),
)
def reoptimise(spark, d):
    inputs = Plan(spark, d).inputs
    latest = inputs.withColumn("last", F.max("date").over(Window.partitionBy("portfolio_id"))).filter("date = last").drop("last")
    shifts = spark.range(1, 11).select(F.lit("pair").alias("portfolio_id"), F.col("id").alias("scenario_id"), (F.col("id") * 0.0005 - 0.003).alias("shift"))
    out = portfolio.weight_breakdown(portfolio.with_levels(scenario.reoptimise(latest, shifts)))
    return rounded(out.select("date", "level", "scenario_id", "equity"), "equity", places=6)


@query("L8_portfolio_impact", fx.sql(f"SELECT 'pair' AS portfolio_id, {', '.join(f'round(s.{t} - b.{t}, 7) + 0.0 AS d_{t}' for t in TAIL)} FROM btail b CROSS JOIN stail s WHERE (SELECT count(*) FROM hist) = 500", "btail", "stail", "hist"))
def portfolio_impact(spark, d):
    return rounded(scenario.portfolio_impact(tail_of(spark, d), tail_of(spark, d, 0.002, 0.003)), *[f"d_{t}" for t in TAIL], places=7)
