"""Walk-forward models. Spark aggregates each fold's statistics; only k x k systems are solved, one row per fold.

Rows are wide: target_id, fold_id, part, rn, date, y and one column per input. A model has three parts (Q1):
``statistics(df) -> df``, ``solve(pandas row) -> coefficients`` spread by mapInPandas, ``score(df, coefs) -> df``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import comb
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.panel import rows_in_ranges

FOLD = ["target_id", "fold_id"]
SPLITS, PENALTIES, PENALTY_SPAN = 5, 100, 1e-3


def fold_rows(labels: DataFrame, folds: DataFrame) -> DataFrame:
    """Training and test rows of each fold with their labels and whatever other columns the rows have."""
    parts = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"{p}_lo").alias("lo"), F.col(f"{p}_hi").alias("hi")) for p in ("train", "test")]))
    ranges = folds.select("target_id", "fold_id", parts.alias("p")).select("target_id", "fold_id", "p.*")
    known = ("target_id", "fold_id", "part", "rn", "date", "y")
    others = [c for c in labels.columns if c not in (*known, "price", "label_end")]
    return rows_in_ranges(labels, ranges).select(*known, *others)


def with_inputs(rows: DataFrame, panel: DataFrame, inputs: list[str]) -> DataFrame:
    """Wide inputs of each row; a pivot of the panel joined by (target, rn)."""
    wide = panel.filter(F.col("series_id").isin(inputs)).groupBy("target_id", "rn").pivot("series_id", inputs).agg(F.first("x"))
    return rows.join(wide, ["target_id", "rn"])


def _forecasts(rows: DataFrame, model: str, predicted: Column) -> DataFrame:
    return rows.select("target_id", F.lit(model).alias("model_id"), "fold_id", "part", "rn", "date", predicted.alias("predicted"), F.col("y").alias("realised"))


def naive_value(inputs: list[str]) -> tuple[Column, Column]:
    """G2 as a column over wide rows, and the rows that it is for: those with every input."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in inputs])
    return F.avg(F.when((F.col("part") == "train") & whole, F.col("y"))).over(Window.partitionBy(*FOLD)), whole


def shape_value(shape: str) -> tuple[Column, Column]:
    """G4 as a column over wide rows, and the rows that it is for: those with the shape."""
    own, f = Window.partitionBy(*FOLD), F.col(shape)
    train = (F.col("part") == "train") & F.col("y").isNotNull() & f.isNotNull()
    x, y = F.when(train, f), F.when(train, F.col("y"))
    line = F.regr_intercept(y, x).over(own) + F.regr_slope(y, x).over(own) * f
    return F.when(F.min(x).over(own) < F.max(x).over(own), line).otherwise(F.avg(y).over(own)), f.isNotNull() & (F.count(x).over(own) > 0)


def several(rows: DataFrame, models: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Forecasts of several models that are columns over the same wide rows, in one pass over them."""
    named = {f"_v{i}": value for i, (value, _) in enumerate(models.values())} | {f"_a{i}": applies for i, (_, applies) in enumerate(models.values())}
    made = [F.when(F.col(f"_a{i}"), F.struct(F.lit(m).alias("model_id"), F.col(f"_v{i}").alias("predicted"))) for i, m in enumerate(models)]
    out = rows.withColumns(named).select("target_id", "fold_id", "part", "rn", "date", F.col("y").alias("realised"), F.explode(F.array_compact(F.array(*made))).alias("m"))
    return out.select("target_id", "m.model_id", "fold_id", "part", "rn", "date", "m.predicted", "realised")


def naive_mean(rows: DataFrame, inputs: list[str]) -> DataFrame:
    """G2. The training mean of the label, on rows with every input."""
    return several(rows, {"naive": naive_value(inputs)})


def naive_by_fold(rows: DataFrame, folds: DataFrame, inputs: list[str]) -> DataFrame:
    """G2 without the folds' rows: per fold and part the forecast and the number of rows that it is for.

    ``rows(target_id, rn, y, inputs..)`` has every row of a target's calendar. Sums and counts of complete rows run along
    each target once; a window's value is the difference of the sums at its ends."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in inputs])
    so_far = Window.partitionBy("target_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    fits = whole & F.col("y").isNotNull()
    known = {"all": F.count_if(whole), "n": F.count_if(fits), "s": F.sum(F.when(fits, F.col("y")).otherwise(0.0))}
    run = rows.select("target_id", "rn", F.struct(*[c.over(so_far).alias(n) for n, c in known.items()]).alias("sum"))
    ends = F.explode(F.array(*[F.struct(F.lit(e).alias("end"), (F.col(e) - F.lit(int(e.endswith("lo")))).alias("rn")) for e in ("train_lo", "train_hi", "test_lo", "test_hi")]))
    asked = folds.select(*FOLD, ends.alias("e")).select(*FOLD, "e.end", "e.rn")
    # the last row stands for ends beyond it, no row for the end before the first
    most = rows.groupBy("target_id").agg(F.max("rn").alias("_most"))
    asked = asked.join(most, "target_id").withColumn("rn", F.least("rn", "_most"))
    at = asked.join(run, ["target_id", "rn"], "left").groupBy(*FOLD).agg(F.map_from_entries(F.collect_list(F.struct("end", "sum"))).alias("m"))
    of = lambda part, name: F.coalesce(F.col("m")[f"{part}_hi"][name], F.lit(0)) - F.coalesce(F.col("m")[f"{part}_lo"][name], F.lit(0))
    parts = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), of(p, "all").alias("n")) for p in ("train", "test")]))
    out = at.select(*FOLD, (of("train", "s") / F.nullif(of("train", "n"), F.lit(0))).alias("predicted"), parts.alias("p"))
    return out.select(*FOLD, "p.part", "p.n", "predicted").filter("n > 0")


def shape_fit(rows: DataFrame, shape: str) -> DataFrame:
    """G4. a + b f per fold; the mean where f is constant."""
    return several(rows, {"shape": shape_value(shape)})


class Model(Protocol):
    """Q1. What a walk-forward needs of a model. ``rows`` are wide rows of all folds with part train and test."""

    def fit(self, rows: DataFrame) -> DataFrame:
        """One row of parameters per target and fold, from the training rows."""

    def predict(self, rows: DataFrame, fitted: DataFrame) -> DataFrame:
        """Forecasts of the rows that have the model's inputs."""

    def describe(self, fitted: DataFrame) -> DataFrame:
        """(target_id, fold_id, equation): each fit in words."""


class ShapeModel:
    """G4 as a pluggable model of one bound shape."""

    def __init__(self, shape: str):
        self.shape = shape

    def fit(self, rows: DataFrame) -> DataFrame:
        return shape_coefs(rows, self.shape)

    def predict(self, rows: DataFrame, fitted: DataFrame) -> DataFrame:
        out = rows.filter(F.col(self.shape).isNotNull()).join(fitted, FOLD)
        return _forecasts(out, "shape", F.col("base") + F.col("slope") * F.col(self.shape))

    def describe(self, fitted: DataFrame) -> DataFrame:
        return fitted.select(*FOLD, F.format_string(f"%.4f + %.4f * {self.shape}", "base", "slope").alias("equation"))


def forecasts_of(model: Model, rows: DataFrame) -> DataFrame:
    """Q1. A pluggable model's forecasts of all folds."""
    return model.predict(rows, model.fit(rows))


def gram(rows: DataFrame, inputs: list[str], keys: list[str]) -> DataFrame:
    """n and the sums of products of (1, inputs, y) over complete rows per key, as the array of an upper triangle."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*inputs, "y"]])
    v = [F.lit(1.0), *map(F.col, inputs), F.col("y")]
    sums = [F.sum(v[i] * v[j]) for i in range(len(v)) for j in range(i, len(v))]
    return rows.filter(whole).groupBy(*keys).agg(F.array(*sums).alias("g"))


def _square(g, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = g
    return m + np.triu(m, 1).T


def solved(stats: DataFrame, solve: Callable[[pd.DataFrame], np.ndarray], groups: list[str] = FOLD) -> DataFrame:
    """One row of coefficients (intercept first) per group of statistics rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in groups}, "coefs": [list(map(float, solve(pdf)))]})

    kinds = dict(stats.dtypes)
    return stats.groupBy(*groups).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in groups) + ", coefs array<double>")


def linear(rows: DataFrame, coefs: DataFrame, inputs: list[str], model: str) -> DataFrame:
    """Intercept plus the inputs' products with their coefficients, on complete rows."""
    out = rows.join(coefs, FOLD)
    value = reduce(lambda a, b: a + b, [F.col(c) * F.get("coefs", F.lit(i + 1)) for i, c in enumerate(inputs)], F.get("coefs", F.lit(0)))
    return _forecasts(out.filter(value.isNotNull()), model, value)


def ols_factors(rows: DataFrame, inputs: list[str], least: int = 15) -> DataFrame:
    """G3. OLS with an intercept on the lagged factors; folds under ``least`` complete rows have no forecast."""
    k = len(inputs) + 2

    def solve(pdf: pd.DataFrame) -> np.ndarray:
        m = _square(pdf["g"].iloc[0], k)
        return np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]

    stats = gram(rows.filter("part = 'train'"), inputs, FOLD).filter(F.get("g", F.lit(0)) >= least)
    return linear(rows, solved(stats, solve), inputs, "factors")


def _centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, covariances and input scales (0 for a constant input) of Gram matrices of (1, inputs, y), along the first axis."""
    n, k = m[:, :1, 0], m.shape[1] - 2
    mean = m[:, 0, 1:] / n
    c = m[:, 1:, 1:] / n[:, :, None] - mean[:, :, None] * mean[:, None, :]
    sd = np.sqrt(np.maximum(np.diagonal(c, axis1=1, axis2=2)[:, :k], 0))
    return mean, c, np.where(sd > 1e-12, sd, 0)


def lassos(m: np.ndarray, penalties: np.ndarray, free: int = 0, sweeps: int = 1000) -> np.ndarray:
    """Coordinate descent on Gram matrices (problem, k + 2, k + 2) of (1, inputs, y), for all problems and penalties side by
    side; inputs are scaled to unit population sd and the first ``free`` ones bear no penalty. Returns coefficients
    (problem, penalty, 1 + k), intercept first, in the inputs' own scale."""
    mean, c, sd = _centred(m)
    k = m.shape[1] - 2
    live, scale = sd > 0, np.where(sd > 0, sd, 1)
    q, b = c[:, :k, :k] / (scale[:, :, None] * scale[:, None, :]), c[:, :k, k] / scale
    w = np.zeros((len(m), len(penalties), k))
    for _ in range(sweeps):
        moved = 0.0
        for j in range(k):
            own = np.where(live[:, j], q[:, j, j], 1)[:, None]
            r = b[:, j, None] - np.matmul(w, q[:, j, :, None])[:, :, 0] + own * w[:, :, j]
            new = r / own if j < free else np.sign(r) * np.maximum(np.abs(r) - penalties, 0) / own
            new = np.where(live[:, j, None], new, 0.0)
            moved = max(moved, float(np.max(np.abs(new - w[:, :, j]), initial=0)))
            w[:, :, j] = new
        if moved < 1e-10:
            break
    own = w / scale[:, None, :]
    return np.concatenate([mean[:, None, k:] - np.sum(own * mean[:, None, :k], axis=2, keepdims=True), own], axis=2)


def lasso(m: np.ndarray, penalties: np.ndarray, free: int = 0) -> list[np.ndarray]:
    """Coefficients (intercept first) of one Gram matrix for each penalty."""
    return list(lassos(m[None], penalties, free)[0])


def _penalties(m: np.ndarray, free: int = 0) -> np.ndarray:
    _, c, sd = _centred(m[None])
    k = len(m) - 2
    most = max(np.max(np.abs(c[0, free:k, k] / np.where(sd[0] > 0, sd[0], np.inf)[free:]), initial=0), 1e-12)
    return most * np.logspace(0, np.log10(PENALTY_SPAN), PENALTIES)


def choose_lasso(blocks: dict[tuple[int, bool], np.ndarray], free: int = 0, max_terms: int | None = None) -> np.ndarray:
    """Fit on all blocks with the penalty of least squared error over time-ordered splits; split i trains on the blocks
    before i, without the rows that reach into it, and is judged on block i: all from the blocks' Gram matrices. With
    ``max_terms`` only penalties above the first whose fit on all blocks keeps more terms are looked at, or the greatest
    alone where even that keeps more."""
    total = sum(blocks.values())
    lams = _penalties(total, free)
    if max_terms is not None:
        kept = np.count_nonzero(lassos(total[None], lams, free)[0][:, 1 + free :], axis=1)
        lams = lams[: max(int(np.argmax(kept > max_terms)), 1)] if (kept > max_terms).any() else lams
    problems, tests = [], []
    for i in range(1, SPLITS + 1):
        train = sum((g for (b, late), g in blocks.items() if b < i - 1 or (b == i - 1 and not late)), np.zeros_like(total))
        test = sum((g for (b, _), g in blocks.items() if b == i), np.zeros_like(total))
        if train[0, 0] >= len(total) and test[0, 0]:
            problems.append(train), tests.append(test)
    fits = lassos(np.array([*problems, total]), lams, free)
    error = np.zeros(len(lams))
    for test, coefs in zip(tests, fits, strict=False):
        v = np.concatenate([coefs, np.full((len(lams), 1), -1.0)], axis=1)
        error += np.einsum("pi,ij,pj->p", v, test, v)
    return fits[-1, int(np.argmin(error)) if tests else 0]


def _blocked(rows: DataFrame, inputs: list[str], h: int) -> DataFrame:
    """Gram of each fold's training rows by time block, the last ``h`` rows of a block apart."""
    own = Window.partitionBy(*FOLD)
    train = rows.filter("part = 'train' AND y IS NOT NULL")
    train = train.withColumn("i", F.row_number().over(own.orderBy("rn")) - 1).withColumn("n", F.count("*").over(own))
    size = F.greatest(F.floor(F.col("n") / (SPLITS + 1)), F.lit(1))
    first = F.col("n") - size * SPLITS
    block = F.when(F.col("i") < first, 0).otherwise(F.floor((F.col("i") - first) / size) + 1)
    end = first + size * F.col("block")
    train = train.withColumn("block", block.cast("int")).withColumn("late", F.col("i") >= end - h)
    return gram(train, inputs, [*FOLD, "block", "late"])


def lasso_path(rows: DataFrame, inputs: list[str], h: int, model: str = "lasso", max_terms: int | None = None) -> DataFrame:
    """G5. Lasso on the given (clipped, standardised, expanded) inputs, the penalty chosen inside the training rows among
    those that keep at most ``max_terms`` terms."""
    return linear(rows, lasso_coefs(rows, inputs, h, max_terms=max_terms), inputs, model)


def lasso_coefs(rows: DataFrame, inputs: list[str], h: int, free: int = 0, max_terms: int | None = None) -> DataFrame:
    k = len(inputs) + 2

    def solve(pdf: pd.DataFrame) -> np.ndarray:
        return choose_lasso({(int(b), bool(l)): _square(g, k) for b, l, g in zip(pdf["block"], pdf["late"], pdf["g"], strict=True)}, free, max_terms)

    return solved(_blocked(rows, inputs, h), solve)


def derived_candidates(rows: DataFrame, candidates: dict[str, list[str]], h: int) -> DataFrame:
    """G6. Forecasts of a grid of lassos that differ in their inputs. The sums of products are taken once over all inputs, and
    each candidate reads its part of them; rows without one of all inputs have no forecast."""
    inputs = list(dict.fromkeys(c for names in candidates.values() for c in names))
    stats, k = _blocked(rows, inputs, h), len(inputs) + 2

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = {(int(b), bool(l)): _square(g, k) for b, l, g in zip(pdf["block"], pdf["late"], pdf["g"], strict=True)}
        found = []
        for names in candidates.values():
            at = [0, *(1 + inputs.index(c) for c in names), k - 1]
            coefs = np.zeros(k - 1)
            coefs[at[:-1]] = choose_lasso({b: g[np.ix_(at, at)] for b, g in blocks.items()})
            found.append(list(map(float, coefs)))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(candidates) for c in FOLD}, "model_id": list(candidates), "coefs": found})

    kinds = dict(stats.dtypes)
    coefs = stats.groupBy(*FOLD).applyInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in FOLD) + ", model_id string, coefs array<double>")
    value = reduce(lambda a, b: a + b, [F.col(c) * F.get("coefs", F.lit(i + 1)) for i, c in enumerate(inputs)], F.get("coefs", F.lit(0)))
    out = rows.join(coefs, FOLD).filter(value.isNotNull())
    return out.select("target_id", "model_id", "fold_id", "part", "rn", "date", value.alias("predicted"), F.col("y").alias("realised"))


def expected_move(rho: Column, h: int, lag: int) -> Column:
    """Kappa of G7: the move that persistence foretells over ``h`` rows, per unit of a level ``lag`` rows old."""
    return F.pow(rho, F.lit(lag)) * (F.pow(rho, F.lit(h)) - 1)


def corrected_rho(levels: DataFrame, h: int, lag: int = 1, kappa: Callable[[Column, int, int], Column] = expected_move) -> DataFrame:
    """G7. Persistence of each series in each fold's training rows, corrected for small-sample bias, at most 0.9999; and
    kappa, the expected move over the label window per unit of level, by a callback of (rho, h, lag) (Q3). ``levels(target_id, fold_id, series_id, rn, x)``."""
    w = Window.partitionBy(*FOLD, "series_id").orderBy("rn")
    fit = levels.withColumn("before", F.lag("x").over(w)).groupBy(*FOLD, "series_id").agg(F.regr_slope("x", "before").alias("r"), F.regr_count("x", "before").alias("n"))
    part = (1 + 3 * F.col("r")) / F.col("n")
    rho = F.least(F.col("r") + part + 3 * part / F.col("n"), F.lit(0.9999))
    return fit.withColumn("rho", rho).withColumn("kappa", kappa(F.col("rho"), h, lag)).drop("r")


def innovations(moves: DataFrame, rho: DataFrame) -> DataFrame:
    """G8. Moves less what the level foretells, with mean zero per fold and series. ``moves(.., x, move)``."""
    keys = [*FOLD, "series_id"]
    u = F.col("move") - F.col("kappa") * F.col("x")
    rows = moves.join(rho.select(*keys, "kappa"), keys).withColumn("u0", u)
    return rows.withColumn("u", F.col("u0") - F.avg("u0").over(Window.partitionBy(*keys))).drop("u0")


def lasso_given_controls(rows: DataFrame, controls: list[str], inputs: list[str], h: int) -> DataFrame:
    """G9. Lasso on levels with innovations and intercept free of penalty; controls are known in training only, so
    forecasts use the intercept at the controls' mean of zero and the levels."""
    coefs = lasso_coefs(rows, [*controls, *inputs], h, free=len(controls))
    kept = coefs.select(*FOLD, F.concat(F.slice("coefs", 1, 1), F.slice("coefs", len(controls) + 2, len(inputs))).alias("coefs"))
    return linear(rows, kept, inputs, "controlled")


def hybrid_forecast(rows: DataFrame, level: DataFrame, flow: DataFrame) -> DataFrame:
    """G10. Level part plus flow part less the flow's mean in-sample forecast; the part that a fold has where it has one, and
    its training mean where it has neither. A row that lacks a fitted part's forecast has none.
    ``rows(target_id, fold_id, part, rn, date, y)`` are the folds' rows."""
    keys, own = ["target_id", "fold_id", "part", "rn"], Window.partitionBy(*FOLD)
    both = rows.select(*keys, "date", "y").join(level.select(*keys, F.col("predicted").alias("level")), keys, "left").join(flow.select(*keys, F.col("predicted").alias("flow")), keys, "left")
    train = F.col("part") == "train"
    both = both.withColumns({"_l": F.count("level").over(own) > 0, "_f": F.count("flow").over(own) > 0, "_m": F.avg(F.when(train, F.col("flow"))).over(own), "_y": F.avg(F.when(train, F.col("y"))).over(own)})
    value = (
        F.when(F.col("_l") & F.col("_f"), F.col("level") + F.col("flow") - F.col("_m")).when(F.col("_l"), F.col("level")).when(F.col("_f"), F.col("flow")).otherwise(F.col("_y"))
    )
    return both.select("target_id", F.lit("hybrid").alias("model_id"), "fold_id", "part", "rn", "date", value.alias("predicted"), F.col("y").alias("realised"))


def ensemble_mean(members: DataFrame, n_members: int) -> DataFrame:
    """G11. Mean of all members' forecasts; null where one of them is missing."""
    keys = ["target_id", "fold_id", "part", "rn", "date"]
    mean = F.when(F.count("predicted") == n_members, F.avg("predicted"))
    return members.groupBy(*keys).agg(mean.alias("predicted"), F.max("realised").alias("realised")).withColumn("model_id", F.lit("ensemble"))


def ensemble_folds(own_levels: DataFrame, screens: DataFrame, n_members: int) -> DataFrame:
    """G11. Per fold of an ensemble its own level, the mean of all members' (null where one is missing), and the signals that
    any member's screening kept, by name. ``own_levels(target_id, member, fold_id, own_level)``,
    ``screens(target_id, member, fold_id, series_id, kept)``."""
    level = own_levels.groupBy(*FOLD).agg(F.when(F.count("own_level") == n_members, F.avg("own_level")).alias("own_level"))
    kept = screens.filter("kept").groupBy(*FOLD).agg(F.sort_array(F.collect_set("series_id")).alias("signals"))
    return level.join(kept, FOLD, "left").withColumn("signals", F.coalesce("signals", F.array().cast("array<string>")))


def merge_terms(terms: DataFrame, n_members: int) -> DataFrame:
    """G12. Mean of the members' equations ``terms(target_id, member, term, coef)``; terms that cancel go."""
    return terms.groupBy("target_id", "term").agg((F.sum("coef") / n_members).alias("coef")).filter("coef <> 0")


def standardised(x: Column) -> Column:
    """A stored equation's input, clipped to lo and hi and standardised by mean and sd; those that are null are left out."""
    return (F.least(F.greatest(x, F.col("lo")), F.col("hi")) - F.coalesce("mean", F.lit(0.0))) / F.coalesce("sd", F.lit(1.0))


def score_function(rows: DataFrame, inputs: DataFrame, terms: DataFrame) -> DataFrame:
    """G16. Value of stored equations: each input clipped and standardised, products of powers times coefficients, and
    the intercept. ``rows(row_id, name, x)``, ``inputs(model_id, name, lo, hi, mean, sd)``,
    ``terms(model_id, term_id, coef, factors map<name, power>)``; a term without factors is the intercept."""
    ready = rows.join(inputs, "name").select("row_id", "model_id", "name", F.when(F.col("x").isNotNull(), standardised(F.col("x"))).alias("z"))
    factors = terms.select("model_id", "term_id", "coef", F.explode_outer("factors").alias("name", "power"))
    per_term = ready.join(factors.filter("name IS NOT NULL"), ["model_id", "name"]).groupBy("row_id", "model_id", "term_id").agg(
        F.product(F.pow("z", F.col("power").cast("double"))).alias("p"), F.max("coef").alias("coef"), F.count("z").alias("n"), F.count("*").alias("want")
    )
    value = per_term.groupBy("row_id", "model_id").agg(F.sum(F.when(F.col("n") == F.col("want"), F.col("p") * F.col("coef"))).alias("v"))
    base = factors.filter("name IS NULL").groupBy("model_id").agg(F.sum("coef").alias("c"))
    return value.join(base, "model_id", "left").select("row_id", "model_id", (F.col("v") + F.coalesce("c", F.lit(0.0))).alias("value"))


def product_attribution(rows: DataFrame, inputs: dict[str, tuple[float | None, float | None, float, float]], terms: list[tuple[float, dict[str, int]]], keys: list[str]) -> DataFrame:
    """G17. Exact Shapley value of every input in every term, summed per row and input.

    ``inputs`` gives each input's bounds (or None), mean and sd, by which it is clipped and standardised; a term is a
    coefficient and the powers of its inputs. Out of a known set an input's power stands at its mean over the rows of
    its key whose ``train`` holds. The value of a product of k powers is the difference of one to its mean, times the mean over
    sizes of the mean product of the others with so many of them known: these are the coefficients of the product of
    (mean + value z), which grow one factor at a time. Rows lacking an input have null shares.
    """
    own = Window.partitionBy(*keys)
    powers = sorted({(c, p) for _, factors in terms for c, p in factors.items()})

    def ready(c: str) -> Column:
        lo, hi, mean, sd = inputs[c]
        x = F.col(c).cast("double")
        x = F.when(x.isNotNull(), F.greatest(x, F.lit(lo))) if lo is not None else x
        x = F.when(x.isNotNull(), F.least(x, F.lit(hi))) if hi is not None else x
        return (x - mean) / sd

    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in inputs])
    rows = rows.withColumns({f"_v_{c}_{p}": F.pow(ready(c), F.lit(float(p))) for c, p in powers})
    rows = rows.withColumns({f"_b_{c}_{p}": F.avg(F.when(F.col("train") & whole, F.col(f"_v_{c}_{p}"))).over(own) for c, p in powers})
    pair = lambda c, p: F.struct(F.col(f"_v_{c}_{p}").alias("v"), F.col(f"_b_{c}_{p}").alias("b"))
    zero = F.array(F.lit(0.0))

    def grown(so_far: Column, f: Column) -> Column:
        return F.zip_with(F.concat(so_far, zero), F.concat(zero, so_far), lambda low, high: low * f["b"] + high * f["v"])

    parts: dict[str, list[Column]] = {c: [] for c in inputs}
    for coef, factors in terms:
        k = len(factors)
        for c, p in factors.items():
            others = [pair(*f) for f in factors.items() if f[0] != c]
            by_size = F.aggregate(F.array(*others), F.array(F.lit(1.0)), grown) if others else F.array(F.lit(1.0))
            mixed = F.aggregate(F.zip_with(by_size, F.array(*[F.lit(1 / comb(k - 1, m)) for m in range(k)]), lambda e, w: e * w), F.lit(0.0), lambda a, e: a + e)
            parts[c].append(F.lit(coef / k) * (F.col(f"_v_{c}_{p}") - F.col(f"_b_{c}_{p}")) * mixed)
    return rows.select(*keys, "rn", "train", *[F.when(whole, reduce(lambda a, b: a + b, p, F.lit(0.0))).alias(f"phi_{c}") for c, p in parts.items()])


def mean_attribution(shares: DataFrame, inputs: list[str], keys: list[str]) -> DataFrame:
    """G17. Mean size of each input's shares over the training rows, a row per key and input."""
    means = shares.filter("train").groupBy(*keys).agg(*[F.avg(F.abs(f"phi_{c}")).alias(c) for c in inputs])
    return means.unpivot(keys, inputs, "signal", "importance")


def latest_fold(folds: DataFrame) -> DataFrame:
    """G18. Each target's last fold."""
    return folds.groupBy("target_id").agg(F.max_by(F.struct(*[c for c in folds.columns if c != "target_id"]), "fold_id").alias("f")).select("target_id", "f.*")


def latest_fold_fit(folds: DataFrame, screens: DataFrame, fits: DataFrame) -> DataFrame:
    """G18. Each target's last fold: its training window, the signals that the screening kept in it (by name, comma-joined)
    and the columns of ``fits(target_id, fold_id, ..)``, null where the fold was not fitted."""
    kept = screens.filter("kept").groupBy(*FOLD).agg(F.array_join(F.sort_array(F.collect_set("series_id")), ",").alias("signals"))
    return latest_fold(folds).join(kept, FOLD, "left").join(fits, FOLD, "left").withColumn("signals", F.coalesce("signals", F.lit("")))


def shape_coefs(rows: DataFrame, shape: str) -> DataFrame:
    """G4's parameters per fold: slope (0 where the shape is constant) and base."""
    train = rows.filter((F.col("part") == "train") & F.col("y").isNotNull() & F.col(shape).isNotNull())
    varies = F.min(shape) < F.max(shape)
    return train.groupBy(*FOLD).agg(F.when(varies, F.regr_slope("y", shape)).otherwise(0.0).alias("slope"), F.when(varies, F.regr_intercept("y", shape)).otherwise(F.avg("y")).alias("base"))


def walk_forward(rows: DataFrame, model: Callable[[DataFrame], DataFrame], screened: DataFrame | None = None) -> DataFrame:
    """G1. A model's forecasts on its folds' rows; a fold in which the screening keeps nothing forecasts its training
    mean on every row. ``screened(target_id, fold_id)`` lists folds with a kept signal."""
    if screened is None:
        return model(rows)
    kept = rows.join(screened, FOLD, "left_semi")
    rest = rows.join(screened, FOLD, "left_anti")
    made = model(kept)
    mean = F.avg(F.when(F.col("part") == "train", F.col("y"))).over(Window.partitionBy(*FOLD))
    plain = rest.withColumn("p", mean).crossJoin(made.select("model_id").limit(1))  # one row
    return made.unionByName(plain.select("target_id", "model_id", "fold_id", "part", "rn", "date", F.col("p").alias("predicted"), F.col("y").alias("realised")))

