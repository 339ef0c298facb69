"""Forecast scores: correlations, rank correlations, overlap-robust t-statistics, crash flags, gates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GATE_IC, GATE_T = 0.02, 2.0


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())


def ic(rows: DataFrame, keys: list[str], x: str = "predicted", y: str = "realised") -> DataFrame:
    """F1. Pearson correlation of complete pairs; null under two pairs or without variation."""
    c = F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return _pairs(rows, x, y).groupBy(*keys).agg(F.when((F.count("*") >= 2) & varied, F.round(c, 15)).alias("ic"), F.count("*").alias("n"))


def with_ranks(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Average ranks rx, ry of complete pairs within keys."""
    rows = _pairs(rows, x, y)
    for c, name in ((x, "rx"), (y, "ry")):
        ties = F.count("*").over(Window.partitionBy(*keys, c))
        rows = rows.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (ties - 1) / 2)
    return rows


def rank_ic(rows: DataFrame, keys: list[str], x: str = "predicted", y: str = "realised") -> DataFrame:
    """F2. Correlation of average ranks."""
    return ic(with_ranks(rows, keys, x, y), keys, "rx", "ry").withColumnRenamed("ic", "rank_ic")


def rmse(rows: DataFrame, keys: list[str], x: str = "predicted", y: str = "realised") -> DataFrame:
    """F3. Root mean squared error of complete pairs."""
    return _pairs(rows, x, y).groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col(x) - F.col(y), 2))).alias("rmse"))


def overlap_errors(lags: int) -> dict[str, tuple[str, int]]:
    """Both kernels over the same lags, by name."""
    return {"bartlett": ("bartlett", lags), "uniform": ("uniform", lags)}


def _hac(rows: DataFrame, keys: list[str], x: str, y: str, order: str, errors: dict[str, tuple[str, int]], also: dict[str, Column]) -> DataFrame:
    """One row per key: n, slope, intercept, se_{name} for each named (kernel, lags), null without two pairs and a varying
    x; and the aggregates ``also`` over all rows of the key, complete or not.

    Everything is a window over the key's complete pairs followed by one aggregation, so the rows are shuffled once. Sums
    over lags are products of rolling sums: with R the sum over a row and the L before it, the Bartlett variance is the
    sum of R * R over all rows, and over the L sums that reach beyond the last row, divided by L + 1; the uniform one is
    the sum of 2 e R - e * e.
    """
    rows = rows.withColumns({"_ok": F.col(x).isNotNull() & F.col(y).isNotNull(), "_x": F.col(x), "_y": F.col(y)})
    own = Window.partitionBy(*keys, "_ok")
    rows = rows.withColumns({"_n": F.count("*").over(own), "_mx": F.avg("_x").over(own), "_my": F.avg("_y").over(own), "_lo": F.min("_x").over(own), "_hi": F.max("_x").over(own)})
    xc = F.col("_x") - F.col("_mx")
    rows = rows.withColumns({"_xc": xc, "_sx": F.sum(xc).over(own), "_sxx": F.sum(xc * xc).over(own), "_sxy": F.sum(xc * F.col("_y")).over(own)})
    fits = F.col("_ok") & (F.col("_n") >= 2) & (F.col("_lo") < F.col("_hi"))
    slope = F.when(fits, F.col("_sxy") / F.col("_sxx"))
    e = F.col("_y") - F.col("_my") - slope * F.col("_xc")
    rows = rows.withColumns({"_slope": slope, "_e": e, "_u": e * F.col("_xc")})
    ordered = own.orderBy(order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = sorted({lags for _, lags in errors.values()})
    rolling = {f"_{c}{lags}": F.sum(f"_{c}").over(ordered.rowsBetween(-lags, 0)) for c in "eu" for lags in reach}
    # sums from a row to the end are the whole less what came before, as a frame that is open ahead is read anew for every row
    ahead = {f"_{c}a": F.sum(f"_{c}").over(own) - F.sum(f"_{c}").over(so_far) + F.col(f"_{c}") for c in "eu"}
    rows = rows.withColumns({**rolling, **ahead, "_left": F.col("_n") - F.row_number().over(ordered) + 1})
    sums = {}
    for name, (kernel, lags) in errors.items():
        for pair in ("ee", "eu", "uu"):
            a, b = (F.col(f"_{c}") for c in pair)
            ra, rb = (F.col(f"_{c}{lags}") for c in pair)
            if kernel == "bartlett":
                over = F.when(F.col("_left") <= lags, F.col(f"_{pair[0]}a") * F.col(f"_{pair[1]}a")).otherwise(0.0)
                term = (ra * rb + over) / (lags + 1)
            else:
                term = a * rb + b * ra - a * b
            sums[f"_{pair}_{name}"] = F.sum(F.when(fits, term))
    kept = {c: F.max(F.when(fits, F.col(c))) for c in ("_n", "_mx", "_my", "_sx", "_sxx", "_slope")}
    out = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in {**kept, **sums, **also}.items()])
    n, sx, det = F.col("_n"), F.col("_sx"), F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    found = []
    for name in errors:
        v = (sx * sx * F.col(f"_ee_{name}") - 2 * n * sx * F.col(f"_eu_{name}") + n * n * F.col(f"_uu_{name}")) / (det * det)
        found.append(F.when(v > 0, F.sqrt(v)).alias(f"se_{name}"))
    return out.select(*keys, n.alias("n"), F.col("_slope").alias("slope"), (F.col("_my") - F.col("_slope") * F.col("_mx")).alias("intercept"), *found, *also)


def ols_hac(rows: DataFrame, keys: list[str], x: str, y: str, order: str, lags: int) -> DataFrame:
    """F4. OLS of y on x with the slope's HAC standard error under the Bartlett and the uniform kernel, per key with two
    complete pairs and a varying x. A variance that is not positive gives a null error."""
    return _hac(rows, keys, x, y, order, overlap_errors(lags), {}).filter("n IS NOT NULL")


def growing_fits(rows: DataFrame, keys: list[str], x: str, y: str, order: str, lags: int, keep: list[str] | None = None) -> DataFrame:
    """F4 over every prefix of a key's complete pairs in order: one row per pair with n, slope, intercept, se_bartlett and
    se_uniform of the pairs up to it.

    Fit and variance are polynomials in sums of products of x, y and their lags, so all prefixes together cost one
    window of running sums. x and y are centred on the key's means, which changes no slope and no error.
    """
    own = Window.partitionBy(*keys)
    rows = _pairs(rows, x, y).withColumns({"_x0": F.col(x) - F.avg(x).over(own), "_y0": F.col(y) - F.avg(y).over(own), "_mx": F.avg(x).over(own), "_my": F.avg(y).over(own)})
    ordered = own.orderBy(order)
    rows = rows.withColumn("_a0", F.lit(1.0)).withColumns({f"_{c}{i}": F.lag(f"_{c}0", i, 0.0).over(ordered) for c in "axy" for i in range(1, lags + 1)})
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = lambda c: F.sum(c).over(so_far)
    X, Y = F.col("_x0"), F.col("_y0")
    rows = rows.withColumns({"_n": run(F.lit(1)), "_sx": run(X), "_sy": run(Y), "_sxx": run(X * X), "_sxy": run(X * Y), "_lo": F.min(x).over(so_far), "_hi": F.max(x).over(so_far)})
    # e = y - b0 - b1 x and u = e x are combinations of monomials of x and y; the products of e and u with their lags are
    # those combinations of the monomials' products with their lags, the same either way round
    monomials = {"1": lambda i: F.col(f"_a{i}"), "x": lambda i: F.col(f"_x{i}"), "y": lambda i: F.col(f"_y{i}"), "xx": lambda i: F.col(f"_x{i}") * F.col(f"_x{i}"), "xy": lambda i: F.col(f"_x{i}") * F.col(f"_y{i}")}
    of_e, of_u = ("1", "x", "y"), ("x", "xx", "xy")
    names = list(monomials)
    wanted = sorted({tuple(sorted((p, q), key=names.index)) for s in ((of_e, of_e), (of_e, of_u), (of_u, of_u)) for p in s[0] for q in s[1]})
    totals = {}
    for kernel in ("bartlett", "uniform"):
        weights = [0.5, *(1 - i / (lags + 1) if kernel == "bartlett" else 1.0 for i in range(1, lags + 1))]
        lagged = {m: reduce(lambda a, b: a + b, [w * monomials[m](i) for i, w in enumerate(weights)]) for m in names}
        totals |= {f"_{kernel}_{p}_{q}": run(monomials[p](0) * lagged[q] + monomials[q](0) * lagged[p]) for p, q in wanted}
    rows = rows.withColumns(totals)
    n, det = F.col("_n"), F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    b1 = (n * F.col("_sxy") - F.col("_sx") * F.col("_sy")) / det
    rows = rows.filter((n >= 2) & (F.col("_lo") < F.col("_hi"))).withColumn("slope", b1).withColumn("_b0", (F.col("_sy") - F.col("slope") * F.col("_sx")) / n)
    e = {"y": F.lit(1.0), "1": -F.col("_b0"), "x": -F.col("slope")}
    u = {"xy": F.lit(1.0), "x": -F.col("_b0"), "xx": -F.col("slope")}

    def product(kernel: str, a: dict[str, Column], b: dict[str, Column]) -> Column:
        at = lambda p, q: F.col("_{}_{}_{}".format(kernel, *sorted((p, q), key=names.index)))
        return reduce(lambda s, t: s + t, [v * w * at(p, q) for p, v in a.items() for q, w in b.items()])

    errors = {}
    for k in ("bartlett", "uniform"):
        sx = F.col("_sx")
        v = (sx * sx * product(k, e, e) - 2 * n * sx * product(k, e, u) + n * n * product(k, u, u)) / (det * det)
        errors[f"se_{k}"] = F.when(v > 0, F.sqrt(v))
    found = rows.withColumns(errors)
    return found.select(*keys, order, *(keep or []), n.alias("n"), "slope", (F.col("_b0") + F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), *errors)


def overlap_se(fit: DataFrame) -> DataFrame:
    """The uniform kernel's error only where it is larger, so that a fit is never surer than the Bartlett one."""
    return fit.withColumn("se", F.greatest("se_uniform", "se_bartlett")).withColumn("t", F.col("slope") / F.nullif("se", F.lit(0.0)))


def standard_ranks(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Average ranks with mean 0 and population sd 1 within keys, as zrx and zry."""
    ranked = with_ranks(rows, keys, x, y)
    own = Window.partitionBy(*keys)
    return ranked.withColumns({f"z{c}": (F.col(c) - F.avg(c).over(own)) / F.nullif(F.stddev_pop(c).over(own), F.lit(0.0)) for c in ("rx", "ry")})


def rank_ic_se(rows: DataFrame, keys: list[str], x: str, y: str, order: str, lags: int) -> DataFrame:
    """F5. Overlap-robust error and t of the slope between standardised ranks; null under three pairs."""
    ranked = standard_ranks(rows, keys, x, y)
    return overlap_se(ols_hac(ranked, keys, "zrx", "zry", order, lags)).filter("n >= 3").select(*keys, "n", F.col("slope").alias("rank_ic"), "se", "t")


def screen_signals(panel: DataFrame, labels: DataFrame, threshold: float = GATE_IC) -> DataFrame:
    """F6. Rank IC of each signal with the label, and whether it is kept; none is left out of the report."""
    rows = panel.join(labels.select("target_id", "rn", "y"), ["target_id", "rn"])
    scored = rank_ic(rows, ["target_id", "series_id"], "x", "y")
    return scored.withColumn("kept", F.coalesce(F.abs("rank_ic") > threshold, F.lit(False)))


def screen_over_folds(train_rows: DataFrame, threshold: float = GATE_IC) -> DataFrame:
    """F7. F6 on each fold's training rows (target_id, fold_id, series_id, x, y)."""
    scored = rank_ic(train_rows, ["target_id", "fold_id", "series_id"], "x", "y")
    return scored.withColumn("kept", F.coalesce(F.abs("rank_ic") > threshold, F.lit(False)))


def screening_summary(screens: DataFrame) -> DataFrame:
    """F8. Per signal: folds that kept it, folds seen, and whether the latest fold kept it."""
    return screens.groupBy("target_id", "series_id").agg(F.count_if("kept").alias("folds_kept"), F.count("*").alias("folds"), F.max_by("kept", "fold_id").alias("in_latest"))


_LEVEL = ["target_id", "model_id", "fold_id"]


def _level(forecast: Column, realised: Column, over: Callable[[Column], Column]) -> Column:
    """The training rows' mean forecast, exact where it is constant; the label's mean where there is no forecast."""
    least, most = over(F.min(forecast)), over(F.max(forecast))
    return F.coalesce(F.when(least == most, least).otherwise(over(F.avg(forecast))), over(F.avg(realised)))


def own_level(forecasts: DataFrame) -> DataFrame:
    """F9. A fold's own level: its mean in-sample forecast, exact where that is constant; the training mean of the
    label where there is no forecast."""
    train = forecasts.filter("part = 'train'")
    level = _level(F.col("predicted"), F.col("realised"), lambda c: c)
    return train.groupBy(*_LEVEL).agg(level.alias("own_level"), F.coalesce(F.min("predicted") == F.max("predicted"), F.lit(False)).alias("constant"))


def _levelled(forecasts: DataFrame) -> DataFrame:
    """All rows with their fold's own level and signal, by one window over the fold."""
    own = Window.partitionBy(*_LEVEL)
    train = lambda c: F.when(F.col("part") == "train", F.col(c))
    rows = forecasts.withColumn("own_level", _level(train("predicted"), train("realised"), lambda c: c.over(own)))
    return rows.withColumn("signal", F.col("predicted") - F.col("own_level"))


def signal_forecasts(forecasts: DataFrame) -> DataFrame:
    """F10. Test forecasts less their fold's own level; folds without training rows have none."""
    return _levelled(forecasts).filter("part = 'test' AND own_level IS NOT NULL")


def summarise(forecasts: DataFrame, h: int, test: int, places: int | None = None) -> DataFrame:
    """F11. Pooled scores per target and model; signals may be rounded first, so that ties are ties everywhere.

    Two shuffles of the forecasts: by fold for the own levels, then by model for the ranks, scores and errors, which are
    windows and one aggregation over the same partitions. Of the training rows one a fold goes on, to count the folds.
    """
    keys = ["target_id", "model_id"]
    rows = _levelled(forecasts)
    if places is not None:
        rows = rows.withColumn("signal", F.round("signal", places))
    train, fold = F.col("part") == "train", Window.partitionBy(*_LEVEL)
    first = F.row_number().over(Window.partitionBy(*_LEVEL, "part").orderBy("date")) == 1
    least, most = (f(F.when(train, F.col("predicted"))).over(fold) for f in (F.min, F.max))
    rows = rows.withColumns({"_fold": (train & first).cast("int"), "_constant": (train & first & F.coalesce(least == most, F.lit(False))).cast("int")})
    # from here on a fold's first training row stands for all of them
    rows = rows.filter((F.col("part") == "test") | (F.col("_fold") == 1))
    pair = (F.col("part") == "test") & F.col("realised").isNotNull()
    whole, marked = pair & F.col("predicted").isNotNull(), pair & F.col("signal").isNotNull()
    rows = rows.withColumns({"_p": whole, "_s": marked})

    def rank(c: str, among: str) -> Column:
        ties = F.count("*").over(Window.partitionBy(*keys, among, c))
        return F.when(F.col(among), F.rank().over(Window.partitionBy(*keys, among).orderBy(c)) + (ties - 1) / 2)

    rows = rows.withColumns({"_rp": rank("predicted", "_p"), "_ry": rank("realised", "_p"), "_rs": rank("signal", "_s"), "_rz": rank("realised", "_s")})
    among = Window.partitionBy(*keys, "_s")
    rows = rows.withColumns({f"_z{c}": (F.col(f"_r{c}") - F.avg(f"_r{c}").over(among)) / F.nullif(F.stddev_pop(f"_r{c}").over(among), F.lit(0.0)) for c in "sz"})

    def correlation(x: str, y: str, at: str) -> Column:
        x, y = (F.when(F.col(at), F.col(c)) for c in (x, y))
        c = F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
        return F.when((F.count_if(F.col(at)) >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.round(c, 15))

    also = {
        "ic": correlation("predicted", "realised", "_p"), "rows": F.count_if("_p"), "rank_ic": correlation("_rp", "_ry", "_p"),
        "rmse": F.sqrt(F.avg(F.when(F.col("_p"), F.pow(F.col("predicted") - F.col("realised"), 2)))), "signal_rank_ic": correlation("_rs", "_rz", "_s"),
        "folds": F.sum("_fold"), "constant_folds": F.sum("_constant"),
    }
    out = overlap_se(_hac(rows, keys, "_zs", "_zz", "date", overlap_errors(h - 1) | {"window": ("bartlett", test)}, also))
    enough = F.col("n") >= 3
    out = out.withColumns({"se_overlap": F.when(enough, F.col("se")), "se_window": F.col("se_window")}).filter("rows > 0")
    scores = out.select(*keys, "ic", F.col("rows").alias("n"), "rank_ic", "rmse", "signal_rank_ic", "se_overlap", "se_window", "folds", "constant_folds")
    return scores.withColumn("t", F.col("signal_rank_ic") / F.greatest("se_overlap", "se_window"))


def holdout(forecasts: DataFrame, labels: DataFrame, before: Column) -> DataFrame:
    """F12. Forecasts of the folds whose every test label ends before a date."""
    ends = forecasts.filter("part = 'test'").join(labels.select("target_id", "date", "label_end"), ["target_id", "date"])
    early = ends.groupBy("target_id", "model_id", "fold_id").agg(F.max("label_end").alias("end"), F.count_if(F.col("label_end").isNull()).alias("open"))
    return forecasts.join(early.filter((F.col("end") < before) & (F.col("open") == 0)), ["target_id", "model_id", "fold_id"], "left_semi")


def best_candidate(scores: DataFrame) -> DataFrame:
    """F13. Per target the model with the best signal rank IC; null is last, ties go to the first name."""
    w = Window.partitionBy("target_id").orderBy(F.desc_nulls_last("signal_rank_ic"), "model_id")
    return scores.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def label_crash_days(forecasts: DataFrame, share: float = 0.05, width: float = 2.0) -> DataFrame:
    """F14. Test rows with two marks: a forecast below the fold's low in-sample quantile, a return below the training
    mean less ``width`` sd. A comparison with a missing value is false."""
    keys = ["target_id", "model_id", "fold_id"]
    bounds = forecasts.filter("part = 'train'").groupBy(*keys).agg(
        F.percentile("predicted", F.lit(share)).alias("low"), (F.avg("realised") - width * F.stddev_samp("realised")).alias("tail_at")
    )
    rows = forecasts.filter("part = 'test'").join(bounds, keys)
    return rows.withColumn("flag", F.coalesce(F.col("predicted") < F.col("low"), F.lit(False))).withColumn("tail", F.coalesce(F.col("realised") < F.col("tail_at"), F.lit(False))).drop("low", "tail_at")


def crash_scores(marked: DataFrame, keys: list[str]) -> DataFrame:
    """F15. Recall, precision and F1 of the flags; null where the denominator is 0."""
    hit, flags, tails = F.count_if(F.col("flag") & F.col("tail")), F.count_if("flag"), F.count_if("tail")
    zero = F.lit(0)
    return marked.groupBy(*keys).agg(
        (hit / F.nullif(tails, zero)).alias("recall"), (hit / F.nullif(flags, zero)).alias("precision"), (2 * hit / F.nullif(flags + tails, zero)).alias("f1"), tails.alias("tails")
    )


def score_by_year(signals: DataFrame) -> DataFrame:
    """F16. Signal rank IC per test year."""
    return rank_ic(signals.withColumn("year", F.year("date")), ["target_id", "model_id", "year"], "signal", "realised")


def _cross_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over common dates of every pair of a block of models with another, or of a block with itself."""
    first, second = int(pdf["first"].iloc[0]), int(pdf["second"].iloc[0])
    dates = pdf["date"].factorize()[0]
    n = dates.max() + 1

    def side(block: int) -> tuple[np.ndarray, list[str]]:
        own = pdf[pdf["block"] == block]
        slots, names = own["model_id"].factorize(sort=True)
        out = np.full((n, len(names)), np.nan)
        out[dates[(pdf["block"] == block).to_numpy()], slots] = own["signal"].to_numpy(float)
        return out, list(names)

    (a, names_a), (b, names_b) = side(first), side(second)
    here, there = (~np.isnan(a)).astype(float), (~np.isnan(b)).astype(float)
    x, y = np.nan_to_num(a), np.nan_to_num(b)
    sums = {"n": here.T @ there, "sx": x.T @ there, "sy": here.T @ y, "sxx": (x * x).T @ there, "syy": here.T @ (y * y), "sxy": x.T @ y}
    low = np.stack([np.where(there[:, [j]] * here > 0, x, np.inf).min(axis=0) for j in range(len(names_b))], 1)
    high = np.stack([np.where(there[:, [j]] * here > 0, x, -np.inf).max(axis=0) for j in range(len(names_b))], 1)
    i, j = np.nonzero(sums["n"])
    keep = np.array([names_a[p] < names_b[q] for p, q in zip(i, j, strict=True)], bool) if first == second else np.ones(len(i), bool)
    i, j = i[keep], j[keep]
    words = {"target_id": [pdf["target_id"].iloc[0]] * len(i), "model_a": [names_a[p] for p in i], "model_b": [names_b[q] for q in j]}
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in words.items()} | {"low": low[i, j], "high": high[i, j]} | {k: v[i, j] for k, v in sums.items()})


def signal_correlations(signals: DataFrame, block: int = 32, span: int = 1024) -> DataFrame:
    """F17. Correlation of every pair of models' signals over common dates, per target; null where the first is constant.

    Models are numbered by name in blocks. A task gets two blocks over ``span`` days and sums their cross products by matrix
    products, so a signal is sent once per block and not once per model; the sums of all spans are then added. The
    models of a target are a dimension: their numbers come from one window.
    """
    models = signals.select("target_id", "model_id").distinct()
    place = F.row_number().over(Window.partitionBy("target_id").orderBy("model_id")) - 1
    models = models.withColumn("block", F.floor(place / block).cast("int")).withColumn("blocks", F.max(F.floor(place / block).cast("int")).over(Window.partitionBy("target_id")))
    # centred on the model's mean, as sums of squares of large values would lose their last digits
    centred = F.col("signal") - F.avg("signal").over(Window.partitionBy("target_id", "model_id"))
    rows = signals.filter("signal IS NOT NULL").select("target_id", "model_id", "date", centred.alias("signal")).join(models, ["target_id", "model_id"])
    rows = rows.withColumn("span", F.floor(F.datediff("date", F.lit("1970-01-01")) / span)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks"))))
    rows = rows.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).drop("blocks", "other")
    both = rows.groupBy("target_id", "span", "first", "second")
    kind = dict(signals.dtypes)["target_id"]
    sums = both.applyInPandas(_cross_sums, f"target_id {kind}, model_a string, model_b string, low double, high double, n double, sx double, sy double, sxx double, syy double, sxy double")
    total = sums.groupBy("target_id", "model_a", "model_b").agg(F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    spread = lambda c: n * F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}")
    r = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.sqrt(F.greatest(spread("x"), F.lit(0.0)) * F.greatest(spread("y"), F.lit(0.0))), F.lit(0.0))
    return total.select("target_id", "model_a", "model_b", F.when(F.col("low") < F.col("high"), r).alias("correlation"), n.cast("long").alias("n"))


def apply_gate(metrics: DataFrame, ic_column: str = "signal_rank_ic", t_column: str = "t") -> DataFrame:
    """B12. Passes only above both bounds; a null fails; failed gates are named."""
    good_ic = F.coalesce(F.col(ic_column) > GATE_IC, F.lit(False))
    good_t = F.coalesce(F.col(t_column) > GATE_T, F.lit(False))
    failed = F.array_join(F.array_compact(F.array(F.when(~good_ic, F.lit("rank_ic")), F.when(~good_t, F.lit("t")))), ",")
    return metrics.withColumn("passes", good_ic & good_t).withColumn("failed", failed)


def significance(t: Column, bound: float = 2.0) -> Column:
    """B13."""
    return F.when(t.isNull(), "undefined").when(t >= bound, "outperforms").when(t <= -bound, "underperforms").otherwise("not significant")


def model_comparison(summaries: DataFrame) -> DataFrame:
    """F18. One row per model with its gate, ranked within the target."""
    w = Window.partitionBy("target_id").orderBy(F.desc_nulls_last("signal_rank_ic"), "model_id")
    return apply_gate(summaries).withColumn("place", F.row_number().over(w))


def slope_by_year(pairs: DataFrame, keys: list[str], lags: int) -> DataFrame:
    """F19. F4 per calendar year; years under three pairs or with a constant x are left out."""
    return overlap_se(ols_hac(pairs.withColumn("year", F.year("date")), [*keys, "year"], "x", "y", "date", lags)).filter("n >= 3").select(*keys, "year", "n", "slope", "t")


def _placebo(x: np.ndarray, y: np.ndarray, lags: int, shifts: np.ndarray) -> dict[str, np.ndarray]:
    """Slope, its overlap-robust error and the correlation of y with x rotated by each shift.

    With x and y centred and z the rotated x, the error needs sums over i of u(i) u(i - l) with u = z (y - b z): four sums of
    a product of x's alone, rotated, with one of y's alone, so each is a cross-correlation, had for all shifts at once
    by Fourier transforms."""
    n = len(x)
    z, y = x - x.mean(), y - y.mean()

    def across(of_x: np.ndarray, of_y: np.ndarray) -> np.ndarray:
        return np.fft.irfft(np.conj(np.fft.rfft(of_x)) * np.fft.rfft(of_y), n)[shifts]

    sxx = float(z @ z)
    slope = across(z, y) / sxx
    totals = {"bartlett": np.zeros(len(shifts)), "uniform": np.zeros(len(shifts))}
    for lag in range(lags + 1):
        zl, within = np.roll(z, lag), np.arange(n) >= lag
        yl = np.roll(y, lag)
        product = across(z * zl, np.where(within, y * yl, 0.0)) - slope * (across(z * zl * zl, np.where(within, y, 0.0)) + across(z * z * zl, np.where(within, yl, 0.0))) + slope**2 * across((z * zl) ** 2, within.astype(float))
        totals["bartlett"] += product * (1 if lag == 0 else 2 * (1 - lag / (lags + 1)))
        totals["uniform"] += product * (1 if lag == 0 else 2)
    with np.errstate(invalid="ignore"):
        errors = [np.where(v > 0, np.sqrt(v), np.nan) / sxx for v in totals.values()]
    return {"slope": slope, "se": np.fmax(*errors), "placebo_ic": slope * np.sqrt(sxx / float(y @ y)) if y.any() else np.full(len(shifts), np.nan)}


def circular_shift_placebo(pairs: DataFrame, keys: list[str], least_shift: int, least: int = 252, gate: float = GATE_T) -> DataFrame:
    """F20. What the gate says of signals without skill: y regressed on x rotated against its dates, for every shift that is
    ``least_shift`` or more rows away from the true order, and for the true order as shift 0.

    ``pairs(keys.., date, x, y, lags)``; the errors allow for ``lags`` rows of overlap. Returns keys, shift, n, placebo_ic, slope,
    t and opens (at least ``least`` pairs and t above the gate). A task holds the pairs of one key; all shifts cost it
    n log n, not n squared. Keys with fewer than two pairs or a constant x have no row.
    """
    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", shift long, n long, placebo_ic double, slope double, t double, opens boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        x, y, n = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), len(pdf)
        if n < 2 or x.min() == x.max():
            return pd.DataFrame({k: pdf[k].iloc[:0] for k in keys} | {c: [] for c in ("shift", "n", "placebo_ic", "slope", "t", "opens")})
        shifts = np.concatenate([[0], np.arange(least_shift, n - least_shift + 1)])
        found = _placebo(x, y, int(pdf["lags"].iloc[0]), shifts)
        t = found["slope"] / found["se"]
        t[~np.isfinite(t)] = np.nan
        nullable = {c: pd.array(np.where(np.isfinite(v), v, 0.0), dtype="Float64") for c, v in (("placebo_ic", found["placebo_ic"]), ("slope", found["slope"]), ("t", t))}
        for c, v in (("placebo_ic", found["placebo_ic"]), ("t", t)):
            nullable[c][~np.isfinite(v)] = pd.NA
        out = pd.DataFrame({"shift": shifts, "n": n} | nullable | {"opens": (n >= least) & (np.nan_to_num(t, nan=-np.inf) > gate)})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "shift", "n", "placebo_ic", "slope", "t", "opens"]]

    return _pairs(pairs, "x", "y").groupBy(*keys).applyInPandas(run, schema)


def placebo_share(placebo: DataFrame, keys: list[str]) -> DataFrame:
    """F20. Per key the number of shifts and the share of them that the gate lets pass, beside the true order."""
    true = F.col("shift") == 0
    return placebo.groupBy(*keys).agg(
        F.max(F.when(true, F.col("n"))).alias("pairs"), F.max(F.when(true, F.col("t"))).alias("t"), F.max(F.when(true, F.col("opens"))).alias("opens"),
        F.count_if(~true).alias("shifts"), F.avg(F.when(~true, F.col("opens").cast("double"))).alias("share_open"),
    )
