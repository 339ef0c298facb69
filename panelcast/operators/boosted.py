"""Boosted trees by histogram sums (G13 to G15): all targets, folds and settings grow their trees together.

A fit is a target, a fold and a setting. Inputs are cut into quantile bins of the fold's training rows. Each level of
the trees is one aggregation of residuals by (fit, node, input, bin); a window over the bins gives the best split of each
node. No fit's rows meet in one process; the driver runs rounds and levels and holds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.panel import purge, retune_schedule
from panelcast.operators.scoring import rank_ic
from panelcast.staging import Staged

FOLD = ["target_id", "fold_id"]
FIT = [*FOLD, "params"]
BINS = 16
LEAST_ROWS = 15
#: A leaf keeps at least the setting's rows, but no more than this share of the training rows is asked for.
LEAF_CAP = 0.25
LEAST_FOLDS = 3
SETTING = "rounds int, depth int, rate double, leaf int, penalty double"


def binned(rows: DataFrame, screens: DataFrame) -> DataFrame:
    """Rows of each fold with the bins of the inputs that its screening kept, in the order of their names.

    ``rows(target_id, fold_id, part, rn, date, y, series_id, x)``, ``screens(target_id, fold_id, series_id, kept)``. A bin is
    the number of training quantiles below the value. Rows that lack a kept input are left out, as are folds that keep none.
    """
    long = rows.join(screens.filter("kept").select(*FOLD, "series_id"), [*FOLD, "series_id"])
    points = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    train = (F.col("part") == "train") & F.col("x").isNotNull() & F.col("y").isNotNull()
    edges = long.filter(train).groupBy(*FOLD, "series_id").agg(F.percentile_approx("x", points, 10_000).alias("edges"))
    place = F.size(F.filter("edges", lambda e: e < F.col("x")))
    own = F.sort_array(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("series_id", place.alias("bin")))))
    wide = long.join(edges, [*FOLD, "series_id"]).groupBy(*FOLD, "part", "rn", "date", "y").agg(own.alias("own"), F.count("*").alias("want"))
    return wide.filter(F.size("own") == F.col("want")).select(*FOLD, "part", "rn", "date", "y", F.col("own.bin").alias("bins"), F.col("own.series_id").alias("inputs"))


def _node(depth: int) -> Column:
    """The leaf, or the inner node so far, that a row's bins lead to in ``tree`` (node -> input and bin of its split)."""
    node = F.lit(1)
    for _ in range(depth):
        split = F.try_element_at("tree", node)
        node = F.when(split.isNull(), node).otherwise(2 * node + (F.element_at("bins", split["at"]) > split["bin"]).cast("int"))
    return node


def _best_splits(rows: DataFrame) -> DataFrame:
    """Per open node the split of most gain in explained squares; ties by input, then bin."""
    train = rows.filter((F.col("part") == "train") & F.col("y").isNotNull() & F.col("open"))
    sums = train.select(*FIT, "node", "least", (F.col("y") - F.col("f")).alias("r"), F.posexplode("bins").alias("at", "bin"))
    sums = sums.groupBy(*FIT, "node", "at", "bin").agg(F.sum("r").alias("r"), F.count("*").alias("n"), F.max("least").alias("least"))
    input_ = Window.partitionBy(*FIT, "node", "at")
    upto = input_.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = sums.select(*FIT, "node", "at", "bin", "least", *[F.sum(x).over(upto).alias(f"{x}l") for x in ("r", "n")], *[F.sum(x).over(input_).alias(x) for x in ("r", "n")])
    rest = F.col("n") - F.col("nl")
    gain = F.col("rl") ** 2 / F.col("nl") + (F.col("r") - F.col("rl")) ** 2 / F.nullif(rest, F.lit(0)) - F.col("r") ** 2 / F.col("n")
    c = c.withColumn("gain", F.round(gain, 15)).filter((F.col("nl") >= F.col("least")) & (rest >= F.col("least")) & (F.col("gain") > 0))
    best = F.max_by(F.struct((F.col("at") + 1).alias("at"), "bin", "gain"), F.struct("gain", -F.col("at"), -F.col("bin")))
    return c.groupBy(*FIT, "node").agg(best.alias("s")).select(*FIT, "node", "s.at", "s.bin", "s.gain")


def grow(rows: DataFrame, settings: DataFrame, rounds: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Forecasts of all fits, and the splits' gains. ``rows`` as of ``binned``, ``settings(target_id, fold_id, params, rounds,
    depth, rate, leaf, penalty)``; ``rounds`` and ``depth`` are their greatest. A leaf's value is its sum of residuals by its
    rows and the penalty, times the rate. Folds with fewer than LEAST_ROWS training rows have no fit."""
    staged = Staged(rows.sparkSession)
    trained = (F.col("part") == "train") & F.col("y").isNotNull()
    start = rows.filter(trained).groupBy(*FOLD).agg(F.avg("y").alias("f"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_ROWS)
    least = F.least("leaf", F.greatest(F.floor(F.col("n") * LEAF_CAP), F.lit(1))).cast("int")
    state = staged.keep(rows.drop("inputs").join(start, FOLD).join(settings, FOLD).withColumn("least", least).drop("n", "leaf"), "boosted")
    gains = []
    for k in range(rounds):
        own, found = state, []
        for level in range(depth):
            active = own.withColumn("node", _node(level) if level else F.lit(1))
            going = (F.col("rounds") > k) & (F.col("depth") > level) & (F.col("node") >= 2**level)
            splits = staged.keep(_best_splits(active.withColumn("open", going)), "splits")
            found.append(splits)
            made = reduce(DataFrame.unionByName, found)
            tree = made.groupBy(*FIT).agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("at", "bin")))).alias("tree"))
            own = state.join(tree, FIT, "left")
        gains += found
        leaf = own.withColumn("node", _node(depth))
        sums = leaf.filter(trained & (F.col("rounds") > k)).groupBy(*FIT, "node").agg((F.sum(F.col("y") - F.col("f")) / (F.count("*") + F.max("penalty")) * F.max("rate")).alias("value"))
        values = sums.groupBy(*FIT).agg(F.map_from_entries(F.collect_list(F.struct("node", "value"))).alias("values"))
        step = F.coalesce(F.try_element_at("values", F.col("node")), F.lit(0.0))
        # a fit without a split of its first node takes no step
        after = leaf.join(values, FIT, "left").withColumn("f", F.col("f") + F.when(F.col("tree").isNotNull(), step).otherwise(0.0))
        before, state = state, staged.keep(after.select(*state.columns), "boosted")
        staged.drop(before)
    return state, reduce(DataFrame.unionByName, gains)


def forecasts(state: DataFrame) -> DataFrame:
    """G13. Forecasts of every fit, its setting as the model."""
    return state.select("target_id", F.col("params").alias("model_id"), "fold_id", "part", "rn", "date", F.col("f").alias("predicted"), F.col("y").alias("realised"))


def boosted_walk_forward(rows: DataFrame, screens: DataFrame, settings: DataFrame, rounds: int, depth: int) -> DataFrame:
    """G13. Per target the configuration whose pooled test forecasts have the better rank IC (ties by name), each fold with
    the parameters of its latest tuning. A fold in which the screening keeps nothing forecasts its training mean.

    ``settings(target_id, fold_id, config, params, rounds, depth, rate, leaf, penalty)``."""
    state, _ = grow(binned(rows, screens), settings.drop("config"), rounds, depth)
    made = forecasts(state).join(settings.select(*FOLD, F.col("params").alias("model_id"), "config"), [*FOLD, "model_id"]).withColumn("model_id", F.col("config")).drop("config")
    score = rank_ic(made.filter("part = 'test'"), ["target_id", "model_id"])
    first = Window.partitionBy("target_id").orderBy(F.desc_nulls_last("rank_ic"), "model_id")
    best = score.withColumn("_k", F.row_number().over(first)).filter("_k = 1").select("target_id", "model_id")
    none = rows.join(screens.filter("kept").select(*FOLD).distinct(), FOLD, "left_anti").select(*FOLD, "part", "rn", "date", "y").distinct()
    mean = F.avg(F.when(F.col("part") == "train", F.col("y"))).over(Window.partitionBy(*FOLD))
    plain = none.withColumn("predicted", mean).join(best, "target_id").withColumnRenamed("y", "realised")
    return made.join(best, ["target_id", "model_id"], "left_semi").unionByName(plain.select(*made.columns))


def feature_importance(rows: DataFrame, screens: DataFrame, settings: DataFrame, rounds: int, depth: int) -> DataFrame:
    """G15. Each kept input's share of the splits' gain, per target, fold and setting; 0 where no split helps."""
    ready = binned(rows, screens)
    _, gains = grow(ready, settings, rounds, depth)
    won = gains.groupBy(*FIT, "at").agg(F.sum("gain").alias("gain"))
    enough = F.count_if((F.col("part") == "train") & F.col("y").isNotNull()) >= LEAST_ROWS
    names = ready.groupBy(*FOLD).agg(F.first("inputs").alias("inputs"), enough.alias("fitted")).filter("fitted")
    every = names.join(settings.select(*FIT), FOLD).select(*FIT, F.posexplode("inputs").alias("at", "input")).withColumn("at", F.col("at") + 1)
    gain = F.coalesce("gain", F.lit(0.0))
    share = gain / F.nullif(F.sum(gain).over(Window.partitionBy(*FIT)), F.lit(0.0))
    return every.join(won, [*FIT, "at"], "left").select(*FIT, "input", F.coalesce(share, F.lit(0.0)).alias("importance"))


def tuning_folds(folds: DataFrame, labels: DataFrame, h: int, tuning: int, train: int, test: int, embargo: int, every: int = 252) -> DataFrame:
    """G14. Purged inner folds of each tuning period of E13: a walk-forward inside the ``tuning`` rows that end
    ``embargo`` rows before the period's first test window, on at most ``train`` rows. ``inner_id`` numbers them within
    the period; ``fold_id`` does so over all periods. A window that holds fewer than LEAST_FOLDS is an error."""
    n = (tuning - train - embargo) // test
    if n < LEAST_FOLDS:
        raise ValueError(f"a tuning window of {tuning} rows holds {max(n, 0)} folds of {train} and {test} rows, {embargo} apart; {LEAST_FOLDS} are needed: shorten the train or test window")
    opens = retune_schedule(folds, test, every).filter("retunes").join(folds.select("target_id", "fold_id", "test_lo"), ["target_id", "fold_id"])
    inner = opens.select("target_id", "tuning_id", (F.col("test_lo") - embargo - tuning).alias("first"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("inner_id"))
    lo = F.col("first") + train + embargo + test * F.col("inner_id")
    bounds = {"train_lo": lo - embargo - train, "train_hi": lo - 1 - embargo, "test_lo": lo, "test_hi": lo + test - 1}
    inner = inner.withColumns({"fold_id": F.col("tuning_id") * n + F.col("inner_id"), **bounds}).drop("first")
    return purge(inner, labels, h)


def tune_grid(rows: DataFrame, screens: DataFrame, inner: DataFrame, grid: DataFrame, rounds: int, depth: int) -> DataFrame:
    """G14. Successive halving: all settings of ``grid(config, params, rounds, depth, rate, leaf, penalty)`` are scored on the
    first LEAST_FOLDS inner folds of each tuning period by pooled rank IC; the worse half of each configuration leaves, the
    rest is scored on twice as many folds, and so on until one is left or no folds are. Of equals the setting that the
    period before chose goes first, then names decide.

    Returns target_id, tuning_id, config, params, rank_ic and folds (on which it was last scored)."""
    staged = Staged(rows.sparkSession)
    ready = staged.keep(binned(rows, screens), "inner")
    periods = inner.select("target_id", "tuning_id", "fold_id", "inner_id")
    total = inner.agg(F.max("inner_id")).first()[0]
    total = 0 if total is None else total + 1
    alive = inner.select("target_id", "tuning_id").distinct().join(grid.select("config", "params"), F.lit(True))
    made, lo, hi = None, 0, LEAST_FOLDS
    left = grid.groupBy("config").count().agg(F.max("count")).first()[0]
    key = ["target_id", "tuning_id", "config"]
    while True:
        window = periods.filter(F.col("inner_id").between(lo, hi - 1))
        settings = window.join(alive, ["target_id", "tuning_id"]).join(grid, ["config", "params"]).drop("tuning_id", "inner_id", "config")
        state, _ = grow(ready.join(window.select(*FOLD), FOLD, "left_semi"), settings, rounds, depth)
        new = forecasts(state).filter("part = 'test'").join(periods, FOLD)
        made = new if made is None else made.unionByName(new)
        scores = rank_ic(made.withColumnRenamed("model_id", "params"), ["target_id", "tuning_id", "params"])
        scores = alive.join(scores.select("target_id", "tuning_id", "params", "rank_ic"), ["target_id", "tuning_id", "params"], "left")
        order = Window.partitionBy(*key).orderBy(F.desc_nulls_last("rank_ic"), "params")
        ranked = scores.withColumns({"_k": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(*key))}).withColumn("folds", F.lit(min(hi, total)))
        left = -(-left // 2)
        if hi >= total or left <= 1:
            break
        alive = staged.keep(ranked.filter(F.col("_k") <= F.ceil(F.col("_n") / 2)).select(*alive.columns), "alive")
        lo, hi = hi, min(2 * hi, total)
    return _chosen(ranked, key)


def _chosen(ranked: DataFrame, key: list[str]) -> DataFrame:
    """The best setting of each period; among equals of its best score the one that the period before chose, if it is one."""
    best = ranked.withColumn("_top", F.first("rank_ic").over(Window.partitionBy(*key).orderBy("_k"))).filter(F.col("rank_ic").eqNullSafe(F.col("_top")))
    equals = best.groupBy(*key).agg(F.sort_array(F.collect_list("params")).alias("equals"), F.first("rank_ic").alias("rank_ic"), F.first("folds").alias("folds"))
    # periods are a few per target, so a list of them is folded from the first on
    periods = equals.groupBy("target_id", "config").agg(F.sort_array(F.collect_list(F.struct("tuning_id", "equals", "rank_ic", "folds"))).alias("all"))
    step = lambda done, p: F.concat(done, F.array(F.when(F.array_contains(p["equals"], F.element_at(done, -1)), F.element_at(done, -1)).otherwise(p["equals"][0])))
    picks = periods.withColumn("picks", F.slice(F.aggregate("all", F.array(F.lit("")), step), 2, F.size("all") + 1))
    rows = picks.select("target_id", "config", F.explode(F.arrays_zip("all", "picks")).alias("z"))
    return rows.select("target_id", "z.all.tuning_id", "config", F.col("z.picks").alias("params"), "z.all.rank_ic", "z.all.folds")
