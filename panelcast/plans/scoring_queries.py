"""Queries of forecast scoring (F), gates (B12, B13) and the closed-form models (G1, G2, G4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import models, panel, scoring
from panelcast.plans import fixtures as fx
from panelcast.plans.panel_queries import Parts, series_rows, two_inputs, wide_rows
from panelcast.plans.register import query, r, rounded

fx.cte("inp", "SELECT r.*, t.a, t.b FROM frows r JOIN two t ON t.target_id = r.target_id AND t.rn = r.rn", "frows", "two")
fx.cte(
    "fcast",
    """SELECT target_id, 'naive' AS model_id, fold_id, part, rn, date, round(avg(y) FILTER (part = 'train') OVER (PARTITION BY target_id, fold_id), 10) AS predicted, round(y, 10) AS realised FROM inp WHERE a IS NOT NULL AND b IS NOT NULL
UNION ALL SELECT i.target_id, 'shape', i.fold_id, i.part, i.rn, i.date, round(CASE WHEN lo < hi THEN c + s * i.b ELSE m END, 10), round(i.y, 10)
FROM inp i JOIN (SELECT target_id, fold_id, regr_slope(y, b) AS s, regr_intercept(y, b) AS c, avg(y) AS m, min(b) AS lo, max(b) AS hi FROM inp WHERE part = 'train' AND y IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2) f
ON f.target_id = i.target_id AND f.fold_id = i.fold_id WHERE i.b IS NOT NULL""",
    "inp",
)
fx.cte(
    "own",
    """SELECT target_id, model_id, fold_id, coalesce(CASE WHEN min(predicted) = max(predicted) THEN min(predicted) ELSE avg(predicted) END, avg(realised)) AS own_level, coalesce(min(predicted) = max(predicted), false) AS constant
FROM fcast WHERE part = 'train' GROUP BY 1, 2, 3""",
    "fcast",
)
fx.cte("sig", "SELECT f.*, o.own_level, round(f.predicted - o.own_level, 13) AS signal FROM fcast f JOIN own o ON o.target_id = f.target_id AND o.model_id = f.model_id AND o.fold_id = f.fold_id WHERE f.part = 'test'", "fcast", "own")


def forecasts(p: Parts, *wanted: str):
    """Forecasts of both models, or of those that are wanted."""
    both = {"naive": models.naive_value(["a", "b"]), "shape": models.shape_value("b")}
    made = models.several(wide_rows(p), {m: v for m, v in both.items() if m in (wanted or both)})
    return made.withColumn("predicted", F.round("predicted", 10)).withColumn("realised", F.round("realised", 10))


def signals_of(p: Parts, *wanted: str):
    return scoring.signal_forecasts(forecasts(p, *wanted)).withColumn("signal", F.round("signal", 13))


def corr_sql(source: str, keys: str, x: str, y: str, name: str) -> str:
    return f"""SELECT {keys}, CASE WHEN count(*) >= 2 AND min({x}) < max({x}) AND min({y}) < max({y}) THEN round(corr({x}, {y}), 8) END AS {name}, count(*) AS n FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {keys}"""


def ranked_sql(source: str, keys: str, x: str, y: str) -> str:
    return f"""(SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2 AS rx, rank() OVER (PARTITION BY {keys} ORDER BY {y}) + (count(*) OVER (PARTITION BY {keys}, {y}) - 1) / 2 AS ry
FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"""


def hac_ctes(name: str, source: str, keys: list[str], lags: str) -> None:
    """CTE ``name`` (keys, n, slope, intercept, se_bartlett, se_uniform) from CTE ``source`` (keys, x, y, o)."""
    k, on = ", ".join(keys), " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in keys)
    part = f"PARTITION BY {k}"
    fx.cte(f"{name}_p", f"SELECT {k}, x, y, row_number() OVER ({part} ORDER BY o) AS rn, x - avg(x) OVER ({part}) AS xc, {lags} AS lags FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL", source)
    fx.cte(f"{name}_f", f"SELECT {k}, count(*) AS n, sum(xc) AS sx, sum(xc * xc) AS sxx, avg(y) AS my, avg(x) AS mx, sum(xc * y) / sum(xc * xc) AS slope FROM {name}_p GROUP BY {k} HAVING count(*) >= 2 AND min(x) < max(x)", f"{name}_p")
    fx.cte(f"{name}_s", f"SELECT {', '.join('a.' + c for c in keys)}, a.rn, a.lags, a.y - b.my - b.slope * a.xc AS e, (a.y - b.my - b.slope * a.xc) * a.xc AS u FROM {name}_p a JOIN {name}_f b ON {on}", f"{name}_p", f"{name}_f")
    w = "CASE WHEN a.l = 0 THEN 0.5 ELSE 1 - a.l / (a.lags + 1) END", "CASE WHEN a.l = 0 THEN 0.5 ELSE 1 END"
    sums = ", ".join(
        f"sum(2 * ({v}) * b.e * a.e) AS s00{i}, sum(({v}) * (b.e * a.u + b.u * a.e)) AS s01{i}, sum(2 * ({v}) * b.u * a.u) AS s11{i}" for i, v in enumerate(w)
    )
    fx.cte(f"{name}_l", f"SELECT {', '.join('a.' + c for c in keys)}, {sums} FROM (SELECT *, unnest(range(lags + 1)) AS l FROM {name}_s) a JOIN {name}_s b ON {on} AND b.rn = a.rn - a.l GROUP BY {', '.join('a.' + c for c in keys)}", f"{name}_s")
    var = [f"(sx * sx * s00{i} - 2 * n * sx * s01{i} + n * n * s11{i}) / pow(n * sxx - sx * sx, 2)" for i in (0, 1)]
    se = [f"CASE WHEN {v} > 0 THEN sqrt({v}) END AS {n}" for v, n in zip(var, ("se_bartlett", "se_uniform"), strict=True)]
    fx.cte(name, f"SELECT {', '.join('a.' + c for c in keys)}, a.n, a.slope, a.my - a.slope * a.mx AS intercept, {', '.join(se)} FROM {name}_f a JOIN {name}_l b ON {on}", f"{name}_f", f"{name}_l")


@query("F1_ic", fx.sql(corr_sql("sig", "target_id, model_id", "predicted", "realised", "ic"), "sig"))
def ic(spark, d):
    return rounded(scoring.ic(signals_of(Parts(spark, d)), ["target_id", "model_id"]), "ic")


@query("F2_rank_ic", fx.sql(corr_sql(ranked_sql("sig", "target_id, model_id", "predicted", "realised"), "target_id, model_id", "rx", "ry", "rank_ic"), "sig"))
def rank_ic(spark, d):
    return rounded(scoring.rank_ic(signals_of(Parts(spark, d)), ["target_id", "model_id"]), "rank_ic")


@query("F3_rmse", fx.sql("SELECT target_id, model_id, round(sqrt(avg(pow(predicted - realised, 2))), 8) AS rmse FROM sig WHERE realised IS NOT NULL GROUP BY 1, 2", "sig"))
def rmse(spark, d):
    return rounded(scoring.rmse(signals_of(Parts(spark, d)), ["target_id", "model_id"]), "rmse")


fx.cte("shape_pairs", "SELECT target_id, date, date AS o, signal AS x, realised AS y FROM sig WHERE model_id = 'shape'", "sig")
hac_ctes("hac", "shape_pairs", ["target_id"], str(fx.HORIZON - 1))


def shape_pairs(p: Parts):
    return signals_of(p, "shape").select("target_id", "date", F.col("signal").alias("x"), F.col("realised").alias("y"))


@query(
    "F4_ols_hac",
    fx.sql("SELECT target_id, n, round(slope, 6) AS slope, round(intercept, 8) AS intercept, round(se_bartlett, 6) AS se_bartlett, round(se_uniform, 6) AS se_uniform, round(slope / greatest(se_bartlett, se_uniform), 5) AS t FROM hac", "hac"),
)
def ols_hac(spark, d):
    fit = scoring.overlap_se(scoring.ols_hac(shape_pairs(Parts(spark, d)), ["target_id"], "x", "y", "date", fx.HORIZON - 1))
    return fit.select("target_id", "n", r("slope", "slope", 6), r("intercept", "intercept"), r("se_bartlett", "se_bartlett", 6), r("se_uniform", "se_uniform", 6), r("t", "t", 5))


def standard_ranks(name: str, source: str, keys: str, x: str, y: str) -> None:
    fx.cte(
        name,
        f"""SELECT {keys}, o, (rx - avg(rx) OVER (PARTITION BY {keys})) / nullif(stddev_pop(rx) OVER (PARTITION BY {keys}), 0) AS x, (ry - avg(ry) OVER (PARTITION BY {keys})) / nullif(stddev_pop(ry) OVER (PARTITION BY {keys}), 0) AS y
FROM {ranked_sql(f'(SELECT *, date AS o FROM {source})', keys, x, y)}""",
        source,
    )


standard_ranks("zr", "sig", "target_id, model_id", "signal", "realised")
hac_ctes("rhac", "zr", ["target_id", "model_id"], str(fx.HORIZON - 1))
hac_ctes("whac", "zr", ["target_id", "model_id"], str(fx.TEST))


@query("F5_rank_ic_se", fx.sql("SELECT target_id, model_id, n, round(slope, 8) AS rank_ic, round(greatest(se_bartlett, se_uniform), 6) AS se, round(slope / greatest(se_bartlett, se_uniform), 5) AS t FROM rhac WHERE n >= 3", "rhac"))
def rank_ic_se(spark, d):
    out = scoring.rank_ic_se(signals_of(Parts(spark, d)), ["target_id", "model_id"], "signal", "realised", "date", fx.HORIZON - 1)
    return out.select("target_id", "model_id", "n", r("rank_ic", "rank_ic"), r("se", "se", 6), r("t", "t", 5))


fx.cte("pl", "SELECT p.target_id, p.series_id, p.rn, round(p.x, 9) AS x, round(l.y, 9) AS y FROM panel p JOIN labels l ON l.target_id = p.target_id AND l.rn = p.rn", "panel", "labels")
SCREEN = corr_sql(ranked_sql("pl", "target_id, series_id", "x", "y"), "target_id, series_id", "rx", "ry", "rank_ic")


def rounded_panel(p: Parts):
    return p.panel.withColumn("x", F.round("x", 9)), p.labels.withColumn("y", F.round("y", 9))


@query("F6_screen_signals", fx.sql(f"SELECT *, coalesce(abs(rank_ic) > 0.02, false) AS kept FROM ({SCREEN})", "pl"))
def screen_signals(spark, d):
    return rounded(scoring.screen_signals(*rounded_panel(Parts(spark, d))), "rank_ic")


fx.cte("ftrain", "SELECT r.target_id, r.fold_id, p.series_id, round(p.x, 9) AS x, round(r.y, 9) AS y FROM frows r JOIN panel p ON p.target_id = r.target_id AND p.rn = r.rn WHERE r.part = 'train'", "frows", "panel")
FOLD_SCREEN = f"SELECT *, coalesce(abs(rank_ic) > 0.02, false) AS kept FROM ({corr_sql(ranked_sql('ftrain', 'target_id, fold_id, series_id', 'x', 'y'), 'target_id, fold_id, series_id', 'rx', 'ry', 'rank_ic')})"


def fold_screens(p: Parts):
    rows = series_rows(p).filter("part = 'train'").withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})
    return rounded(scoring.screen_over_folds(rows), "rank_ic")


@query("F7_screen_over_folds", fx.sql(FOLD_SCREEN, "ftrain"))
def screen_over_folds(spark, d):
    return fold_screens(Parts(spark, d))


@query("F8_screening_summary", fx.sql(f"SELECT target_id, series_id, count(*) FILTER (kept) AS folds_kept, count(*) AS folds, arg_max(kept, fold_id) AS in_latest FROM ({FOLD_SCREEN}) GROUP BY 1, 2", "ftrain"))
def screening_summary(spark, d):
    return scoring.screening_summary(fold_screens(Parts(spark, d)))


@query("F9_own_level", fx.sql("SELECT target_id, model_id, fold_id, round(own_level, 8) AS own_level, constant FROM own", "own"))
def own_level(spark, d):
    return rounded(scoring.own_level(forecasts(Parts(spark, d))), "own_level")


@query("F10_signal_forecasts", fx.sql("SELECT target_id, model_id, fold_id, rn, date, signal, realised FROM sig", "sig"))
def signal_forecasts(spark, d):
    return signals_of(Parts(spark, d)).select("target_id", "model_id", "fold_id", "rn", "date", r("signal", "signal", 13), r("realised", "realised", 10))


SUMMARY = f"""SELECT i.target_id, i.model_id, i.ic, i.n, k.rank_ic, m.rmse, s.rank_ic AS signal_rank_ic, round(h.se, 6) AS se_overlap, round(w.se_bartlett, 6) AS se_window, o.folds, o.constant_folds, round(s.raw / greatest(h.se, w.se_bartlett), 5) AS t
FROM ({corr_sql('sig', 'target_id, model_id', 'predicted', 'realised', 'ic')}) i
LEFT JOIN ({corr_sql(ranked_sql('sig', 'target_id, model_id', 'predicted', 'realised'), 'target_id, model_id', 'rx', 'ry', 'rank_ic')}) k USING (target_id, model_id)
LEFT JOIN (SELECT target_id, model_id, round(sqrt(avg(pow(predicted - realised, 2))), 8) AS rmse FROM sig WHERE realised IS NOT NULL GROUP BY 1, 2) m USING (target_id, model_id)
LEFT JOIN (SELECT target_id, model_id, CASE WHEN min(rx) < max(rx) THEN corr(rx, ry) END AS raw, CASE WHEN min(rx) < max(rx) THEN round(corr(rx, ry), 8) END AS rank_ic FROM {ranked_sql('sig', 'target_id, model_id', 'signal', 'realised')} GROUP BY 1, 2) s USING (target_id, model_id)
LEFT JOIN (SELECT target_id, model_id, greatest(se_bartlett, se_uniform) AS se FROM rhac WHERE n >= 3) h USING (target_id, model_id)
LEFT JOIN whac w USING (target_id, model_id) JOIN (SELECT target_id, model_id, count(*) AS folds, count(*) FILTER (constant) AS constant_folds FROM own GROUP BY 1, 2) o USING (target_id, model_id)"""
fx.cte("summary", SUMMARY, "sig", "rhac", "whac", "own")


def summaries(p: Parts):
    s = scoring.summarise(forecasts(p), fx.HORIZON, fx.TEST, places=13)
    names = ("ic", "rank_ic", "rmse", "signal_rank_ic")
    return rounded(rounded(rounded(s, *names), "se_overlap", "se_window", places=6), "t", places=5)


@query("F11_summarise", fx.sql("SELECT * FROM summary", "summary"))
def summarise(spark, d):
    return summaries(Parts(spark, d))


@query(
    "F12_holdout",
    fx.sql(
        "SELECT model_id, target_id, count(DISTINCT fold_id) AS folds, count(*) AS rows FROM fcast JOIN (SELECT f.target_id, f.model_id, f.fold_id FROM fcast f JOIN labels l ON l.target_id = f.target_id AND l.rn = f.rn WHERE f.part = 'test' GROUP BY 1, 2, 3 HAVING max(l.label_end) < DATE '1998-01-01' AND count(*) = count(l.label_end)) e USING (target_id, model_id, fold_id) GROUP BY 1, 2",
        "fcast", "labels",
    ),
)
def holdout(spark, d):
    p = Parts(spark, d)
    kept = scoring.holdout(forecasts(p), p.labels, F.lit("1998-01-01").cast("date"))
    return kept.groupBy("model_id", "target_id").agg(F.count_distinct("fold_id").alias("folds"), F.count("*").alias("rows"))


@query("F13_best_candidate", fx.sql("SELECT target_id, model_id, signal_rank_ic FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY signal_rank_ic DESC NULLS LAST, model_id) AS k FROM summary) WHERE k = 1", "summary"))
def best_candidate(spark, d):
    return scoring.best_candidate(summaries(Parts(spark, d))).select("target_id", "model_id", "signal_rank_ic")


fx.cte(
    "crash",
    """SELECT f.target_id, f.model_id, f.fold_id, f.rn, coalesce(f.predicted < b.low, false) AS flag, coalesce(f.realised < b.tail_at, false) AS tail FROM fcast f JOIN (
  SELECT target_id, model_id, fold_id, quantile_cont(predicted, 0.05) AS low, avg(realised) - 2 * stddev_samp(realised) AS tail_at FROM fcast WHERE part = 'train' GROUP BY 1, 2, 3) b USING (target_id, model_id, fold_id) WHERE f.part = 'test'""",
    "fcast",
)


@query("F14_crash_days", fx.sql("SELECT target_id, model_id, fold_id, count(*) FILTER (flag) AS flags, count(*) FILTER (tail) AS tails, count(*) FILTER (flag AND tail) AS hits FROM crash GROUP BY 1, 2, 3", "crash"))
def crash_days(spark, d):
    rows = scoring.label_crash_days(forecasts(Parts(spark, d)))
    return rows.groupBy("target_id", "model_id", "fold_id").agg(F.count_if("flag").alias("flags"), F.count_if("tail").alias("tails"), F.count_if(F.col("flag") & F.col("tail")).alias("hits"))


@query(
    "F15_crash_scores",
    fx.sql(
        "SELECT target_id, model_id, round(h / nullif(t, 0), 8) AS recall, round(h / nullif(g, 0), 8) AS precision, round(2 * h / nullif(g + t, 0), 8) AS f1, t AS tails FROM (SELECT target_id, model_id, count(*) FILTER (flag AND tail) AS h, count(*) FILTER (flag) AS g, count(*) FILTER (tail) AS t FROM crash GROUP BY 1, 2)",
        "crash",
    ),
)
def crash_scores(spark, d):
    return rounded(scoring.crash_scores(scoring.label_crash_days(forecasts(Parts(spark, d))), ["target_id", "model_id"]), "recall", "precision", "f1")


fx.cte("sig_year", "SELECT *, year(date) AS year FROM sig", "sig")


@query("F16_score_by_year", fx.sql(corr_sql(ranked_sql("sig_year", "target_id, model_id, year", "signal", "realised"), "target_id, model_id, year", "rx", "ry", "rank_ic"), "sig_year"))
def score_by_year(spark, d):
    return rounded(scoring.score_by_year(signals_of(Parts(spark, d))), "rank_ic")


@query("F17_signal_correlations", fx.sql("SELECT a.target_id, a.model_id AS model_a, b.model_id AS model_b, CASE WHEN min(a.predicted) < max(a.predicted) THEN round(corr(a.predicted, b.predicted), 8) END AS correlation, count(*) AS n FROM sig a JOIN sig b ON a.target_id = b.target_id AND a.date = b.date AND a.model_id < b.model_id GROUP BY 1, 2, 3", "sig"))
def signal_correlations(spark, d):
    return rounded(scoring.signal_correlations(signals_of(Parts(spark, d)).withColumn("signal", F.col("predicted"))), "correlation")


@query(
    "F18_model_comparison",
    fx.sql(
        """SELECT target_id, model_id, signal_rank_ic, t, coalesce(signal_rank_ic > 0.02, false) AND coalesce(t > 2, false) AS passes, concat_ws(',', CASE WHEN NOT coalesce(signal_rank_ic > 0.02, false) THEN 'rank_ic' END, CASE WHEN NOT coalesce(t > 2, false) THEN 't' END) AS failed,
row_number() OVER (PARTITION BY target_id ORDER BY signal_rank_ic DESC NULLS LAST, model_id) AS place FROM summary""",
        "summary",
    ),
)
def model_comparison(spark, d):
    return scoring.model_comparison(summaries(Parts(spark, d))).select("target_id", "model_id", "signal_rank_ic", "t", "passes", "failed", "place")


@query("B12_apply_gate", fx.sql("SELECT target_id, series_id, rank_ic, coalesce(rank_ic > 0.02, false) AS passes, CASE WHEN coalesce(rank_ic > 0.02, false) THEN '' ELSE 'rank_ic' END AS failed FROM (" + SCREEN + ")", "pl"))
def apply_gate(spark, d):
    scored = rounded(scoring.screen_signals(*rounded_panel(Parts(spark, d))), "rank_ic").withColumn("t", F.lit(3.0))
    return scoring.apply_gate(scored, "rank_ic").select("target_id", "series_id", "rank_ic", "passes", "failed")


@query("B13_significance", fx.sql("SELECT target_id, model_id, CASE WHEN t IS NULL THEN 'undefined' WHEN t >= 2 THEN 'outperforms' WHEN t <= -2 THEN 'underperforms' ELSE 'not significant' END AS verdict FROM summary", "summary"))
def significance(spark, d):
    return summaries(Parts(spark, d)).select("target_id", "model_id", scoring.significance(F.col("t")).alias("verdict"))


fx.cte("shape_years", "SELECT *, year(date) AS year FROM shape_pairs", "shape_pairs")
hac_ctes("yhac", "shape_years", ["target_id", "year"], str(fx.HORIZON - 1))


@query("F19_slope_by_year", fx.sql("SELECT target_id, year, n, round(slope, 5) AS slope, round(slope / greatest(se_bartlett, se_uniform), 4) AS t FROM yhac WHERE n >= 3", "yhac"))
def slope_by_year(spark, d):
    out = scoring.slope_by_year(shape_pairs(Parts(spark, d)), ["target_id"], fx.HORIZON - 1)
    return rounded(rounded(out, "slope", places=5), "t", places=4)


#: Shifts of F20 are at least so many rows from the true order; its horizons.
LEAST_SHIFT, HORIZONS = 252, (1, 5, 20)
fx.cte(
    "hpairs",
    " UNION ALL ".join(f"SELECT target_id, {h} AS horizon, date, x, lead(price, {h}) OVER (PARTITION BY target_id ORDER BY rn) / price - 1 AS y FROM cal LEFT JOIN (SELECT target_id, date, x FROM shape_pairs) USING (target_id, date)" for h in HORIZONS),
    "cal", "shape_pairs",
)
fx.cte("numbered", "SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY target_id, horizon) AS n FROM hpairs WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY target_id, horizon ORDER BY date)", "hpairs")


def placebo_ctes(name: str, horizons: tuple[int, ...], step: int) -> None:
    """CTE ``name``: the regressions of every ``step``-th shift, each over its own rotated rows."""
    own = f"horizon IN ({', '.join(map(str, horizons))})"
    fx.cte(
        f"{name}_r",
        f"""SELECT a.target_id, a.horizon * 100000 + s.shift AS run, b.x, a.y, a.i AS o FROM numbered a JOIN (SELECT unnest(range(0, 100000)) AS shift) s ON (s.shift = 0 OR s.shift BETWEEN {LEAST_SHIFT} AND a.n - {LEAST_SHIFT}) AND s.shift % {step} = 0
JOIN numbered b ON b.target_id = a.target_id AND b.horizon = a.horizon AND b.i = (a.i - s.shift + a.n) % a.n WHERE a.{own}""",
        "numbered",
    )
    hac_ctes(name, f"{name}_r", ["target_id", "run"], str(horizons[0] - 1))


for _h in HORIZONS:
    placebo_ctes(f"plac{_h}", (_h,), 1)
PLACEBO = f"SELECT target_id, run // 100000 AS horizon, run % 100000 AS shift, n, slope, slope / greatest(coalesce(se_bartlett, se_uniform), coalesce(se_uniform, se_bartlett)) AS t FROM {{}}"


def horizon_pairs(p: Parts):
    """The shape model's signals with outcomes over several horizons."""
    x = shape_pairs(p).select("target_id", "date", "x")
    y = [panel.forward_return(p.calendar, h).select("target_id", "date", "y", F.lit(h).alias("horizon"), F.lit(h - 1).alias("lags")) for h in HORIZONS]
    return reduce(DataFrame.unionByName, y).join(x, ["target_id", "date"])


@query("F20_circular_shift_placebo", fx.sql("SELECT target_id, horizon, shift, n, round(slope, 7) AS slope, round(t, 5) AS t, coalesce(n >= 252 AND t > 2, false) AS opens FROM (" + PLACEBO.format("plac5") + ")", "plac5"))
def circular_shift_placebo(spark, d):
    """Every shift of the middle horizon."""
    pairs = horizon_pairs(Parts(spark, d)).filter(F.col("horizon") == HORIZONS[1])
    out = scoring.circular_shift_placebo(pairs, ["target_id", "horizon"], LEAST_SHIFT).drop("placebo_ic")
    return rounded(rounded(out, "slope", places=7), "t", places=5)


@query(
    "F20_placebo_share",
    fx.sql(
        "SELECT target_id, horizon, max(n) AS pairs, max(CASE WHEN shift = 0 THEN round(t, 5) END) AS t, max(CASE WHEN shift = 0 THEN opens END) AS opens, count(*) FILTER (shift > 0) AS shifts, round(avg(CASE WHEN shift > 0 THEN opens::INT END), 8) AS share_open FROM (SELECT *, coalesce(n >= 252 AND t > 2, false) AS opens FROM ("
        + " UNION ALL ".join(PLACEBO.format(f"plac{h}") for h in HORIZONS) + ")) GROUP BY 1, 2",
        *[f"plac{h}" for h in HORIZONS],
    ),
)
def placebo_share(spark, d):
    """All shifts of all horizons."""
    out = scoring.placebo_share(scoring.circular_shift_placebo(horizon_pairs(Parts(spark, d)), ["target_id", "horizon"], LEAST_SHIFT), ["target_id", "horizon"])
    return rounded(rounded(out, "share_open"), "t", places=5)


@query("G2_naive_mean", fx.sql("SELECT target_id, fold_id, part, count(*) AS n, round(max(m), 8) AS predicted FROM (SELECT *, avg(y) FILTER (part = 'train') OVER (PARTITION BY target_id, fold_id) AS m FROM inp WHERE a IS NOT NULL AND b IS NOT NULL) GROUP BY 1, 2, 3", "inp"))
def naive_mean(spark, d):
    """Per fold from running sums; the forecasts of rows are in F11 and G4's siblings."""
    p = Parts(spark, d)
    rows = p.labels.select("target_id", "rn", "y").join(two_inputs(p).select("target_id", "rn", "a", "b"), ["target_id", "rn"], "left")
    return rounded(models.naive_by_fold(rows, p.purged, ["a", "b"]), "predicted")


@query("G4_shape_fit", fx.sql("SELECT target_id, fold_id, rn, part, predicted FROM fcast WHERE model_id = 'shape' AND part = 'test'", "fcast"))
def shape_fit(spark, d):
    return rounded(forecasts(Parts(spark, d), "shape").filter("part = 'test'").select("target_id", "fold_id", "rn", "part", "predicted"), "predicted", places=10)


@query(
    "G1_walk_forward",
    fx.sql(
        f"""SELECT r.target_id, r.fold_id, r.part, count(*) AS n, round(sum(CASE WHEN k.fold_id IS NULL THEN r.m ELSE f.predicted END), 5) AS total FROM (SELECT *, avg(y) FILTER (part = 'train') OVER (PARTITION BY target_id, fold_id) AS m FROM inp) r
LEFT JOIN (SELECT DISTINCT target_id, fold_id FROM ({FOLD_SCREEN}) WHERE series_id = 'disc_O' AND kept) k USING (target_id, fold_id)
LEFT JOIN (SELECT * FROM fcast WHERE model_id = 'shape') f USING (target_id, fold_id, part, rn) WHERE k.fold_id IS NULL OR f.rn IS NOT NULL GROUP BY 1, 2, 3""",
        "inp", "ftrain", "fcast",
    ),
)
def walk_forward(spark, d):
    p = Parts(spark, d)
    rows = wide_rows(p)
    kept = fold_screens(p).filter("series_id = 'disc_O' AND kept").select("target_id", "fold_id")
    out = models.walk_forward(rows, lambda x: models.shape_fit(x, "b"), kept)
    return rounded(out.groupBy("target_id", "fold_id", "part").agg(F.count("*").alias("n"), F.sum("predicted").alias("total")), "total", places=5)
