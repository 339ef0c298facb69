"""Scenarios: shocked inputs, shocked forecasts, shocked portfolios, for any number of scenarios in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.models import standardised
from panelcast.operators.panel import asof

MOST_RANGES = 10.0


def last_observed(obs: DataFrame, as_of: DataFrame) -> DataFrame:
    """L1. Per target and series, the last value and its date on or before the target's last price.
    ``as_of(target_id, last)``. Each series is read as of the distinct last dates, which are few, and targets share them."""
    seen = obs.filter("value IS NOT NULL")
    asked = seen.select("series_id").distinct().crossJoin(as_of.select("last").distinct())
    found = asof(asked, seen, ["series_id"], "last", "date", ["value", "date"]).filter("date IS NOT NULL")
    return as_of.join(found, "last").select("target_id", "series_id", "value", "date")


def validate_shocks(shocks: DataFrame, obs: DataFrame, last: DataFrame, transforms: DataFrame) -> DataFrame:
    """L2. Shocked levels with an error where a shock cannot be used.

    ``shocks(scenario_id, target_id, series_id, amount, kind)`` with amount as text: absolute is the new level, percent a
    change from the last value known to the target. Series read as levels or log returns must stay above 0."""
    span = obs.groupBy("series_id").agg((F.max("value") - F.min("value")).alias("span"))
    entered = F.regexp_replace("amount", ",", "").try_cast("double")
    rows = shocks.withColumn("entered", F.when(~F.isnan(entered) & (F.abs(entered) < float("inf")), entered))
    rows = rows.join(last.select("target_id", "series_id", F.col("value").alias("base")), ["target_id", "series_id"], "left").join(span, "series_id", "left").join(transforms, "series_id", "left")
    rows = rows.withColumn("level", F.when(F.col("kind") == "percent", F.col("base") * (1 + F.col("entered") / 100)).otherwise(F.col("entered")))
    error = (
        F.when(F.col("base").isNull(), "no observed value").when(F.col("entered").isNull(), "not a number").when(F.col("transform").isin("LEVEL", "LOG_RETURN") & (F.col("level") <= 0), "must stay above 0")
        .when(F.abs(F.col("level") - F.col("base")) > MOST_RANGES * F.col("span"), "beyond ten times the observed range")
    )
    return rows.select("scenario_id", "target_id", "series_id", "base", F.when(error.isNull(), F.col("level")).alias("level"), error.alias("error"))


def runnable(levels: DataFrame) -> DataFrame:
    """Shocks of the scenarios that have no error for a target; a scenario with one is not run for it."""
    wrong = F.count("error").over(Window.partitionBy("scenario_id", "target_id"))
    return levels.withColumn("_wrong", wrong).filter("_wrong = 0").select("scenario_id", "target_id", "series_id", "level")


def _moved(transform: Column, x: Column, before: Column) -> Column:
    logged = F.when((x > 0) & (before > 0), F.ln(x) - F.ln(before))
    return F.when(transform == "LEVEL", x).when(transform == "LOG_RETURN", logged).otherwise(x - before)


def base_inputs(aligned: DataFrame, last: DataFrame, transforms: DataFrame) -> DataFrame:
    """What the forecast of the day after a target's last one reads, once for all scenarios: per target and series the last
    two aligned values, the input made from them, and whether the one before also reads the last observation (carried)."""
    own = Window.partitionBy("target_id", "series_id").orderBy(F.desc("rn"))
    ends = aligned.withColumn("_k", F.row_number().over(own)).filter("_k <= 2")
    at = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    tips = ends.groupBy("target_id", "series_id").agg(at(1, "x").alias("x"), at(2, "x").alias("before"), at(2, "date").alias("_date"))
    seen = last.select("target_id", "series_id", F.col("date").alias("_seen"))
    tips = tips.join(seen, ["target_id", "series_id"], "left").join(transforms, "series_id")
    carried = F.coalesce(F.col("_seen") <= F.col("_date"), F.lit(False))
    return tips.select("target_id", "series_id", "transform", "x", "before", carried.alias("carried"), _moved(F.col("transform"), F.col("x"), F.col("before")).alias("base"))


def shocked_inputs(base: DataFrame, levels: DataFrame) -> DataFrame:
    """L3. Sparse overlay: a row per scenario, target and shocked series with the input before and after. The shock takes the
    place of the last observation, so a value that is too old to be read stays away.
    ``levels(scenario_id, target_id, series_id, level)``."""
    rows = levels.join(base, ["target_id", "series_id"])
    x = F.when(F.col("x").isNotNull(), F.col("level"))
    before = F.when(F.col("carried") & F.col("before").isNotNull(), F.col("level")).otherwise(F.col("before"))
    return rows.select("scenario_id", "target_id", "series_id", "base", _moved(F.col("transform"), x, before).alias("shocked"))


def whole_inputs(base: DataFrame, shocked: DataFrame, scenarios: DataFrame) -> DataFrame:
    """L3. All inputs of every scenario in ``scenarios(scenario_id, target_id)``; those not shocked keep their base."""
    over = shocked.select("scenario_id", "target_id", "series_id", "shocked", F.lit(True).alias("_hit"))
    rows = scenarios.join(base.select("target_id", "series_id", "base"), "target_id").join(over, ["scenario_id", "target_id", "series_id"], "left")
    return rows.select("scenario_id", "target_id", "series_id", "base", F.when(F.col("_hit"), F.col("shocked")).otherwise(F.col("base")).alias("shocked"))


def training_ranges(train_rows: DataFrame) -> DataFrame:
    """L4. Least and greatest value of each input over the latest fold's training rows."""
    return train_rows.groupBy("target_id", "series_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def run_scenarios(base: DataFrame, shocked: DataFrame, scenarios: DataFrame, inputs: DataFrame, terms: DataFrame) -> DataFrame:
    """L5. Base and shocked forecast of every stored equation (as in G16) in every scenario of its target, the change, and
    the change as a share of the base.

    ``inputs(model_id, target_id, name, lo, hi, mean, sd)`` and ``terms(model_id, term_id, coef, factors)``. A model's
    base is worked out once; an index from series to terms then finds the terms that a shock reaches, and only these are
    worked out again. A forecast with a missing input is null.
    """
    factors = terms.select("model_id", "term_id", "coef", F.explode("factors").alias("series_id", "power"))
    index = factors.join(inputs.withColumnRenamed("name", "series_id"), ["model_id", "series_id"])

    def worth(rows: DataFrame, x: Column, keys: list[str], name: str) -> DataFrame:
        power = F.pow(F.when(x.isNotNull(), standardised(x)), F.col("power").cast("double"))
        return rows.groupBy(*keys).agg(F.when(F.count(power) == F.count("*"), F.max("coef") * F.product(power)).alias(name))

    values = base.select("target_id", "series_id", "base")
    old = worth(index.join(values, ["target_id", "series_id"], "left"), F.col("base"), ["model_id", "target_id", "term_id"], "old")
    constant = terms.filter(F.size("factors") == 0).groupBy("model_id").agg(F.sum("coef").alias("constant"))
    models = old.groupBy("model_id", "target_id").agg(F.sum("old").alias("sum"), F.count_if(F.col("old").isNull()).alias("absent"))
    models = models.join(constant, "model_id", "left").withColumn("sum", F.coalesce("sum", F.lit(0.0)) + F.coalesce("constant", F.lit(0.0)))

    over = shocked.select("scenario_id", "target_id", "series_id", "shocked", F.lit(True).alias("_hit"))
    reached = over.join(index, ["target_id", "series_id"]).select("scenario_id", "model_id", "term_id").distinct()
    rows = reached.join(index, ["model_id", "term_id"]).join(over, ["scenario_id", "target_id", "series_id"], "left").join(values, ["target_id", "series_id"], "left")
    new = worth(rows, F.when(F.col("_hit"), F.col("shocked")).otherwise(F.col("base")), ["scenario_id", "model_id", "term_id"], "new")
    delta = new.join(old, ["model_id", "term_id"]).groupBy("scenario_id", "model_id").agg(
        F.sum(F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))).alias("moved"), (F.count_if(F.col("new").isNull()) - F.count_if(F.col("old").isNull())).alias("more")
    )
    out = scenarios.join(models, "target_id").join(delta, ["scenario_id", "model_id"], "left")
    out = out.select(
        "scenario_id", "target_id", "model_id", F.when(F.col("absent") == 0, F.col("sum")).alias("base"),
        F.when(F.col("absent") + F.coalesce("more", F.lit(0)) == 0, F.col("sum") + F.coalesce("moved", F.lit(0.0))).alias("shocked"),
    )
    return out.withColumn("change", F.col("shocked") - F.col("base")).withColumn("relative", F.col("change") / F.nullif(F.abs("base"), F.lit(0.0)))


def input_changes(shocked: DataFrame, inputs: DataFrame, ranges: DataFrame) -> DataFrame:
    """L5. A row per scenario, model and input that its shocks moved: before and after, the training range, whether the new
    value is outside of it, and the bound at which a clipping model holds it."""
    rows = shocked.filter(~F.col("base").eqNullSafe(F.col("shocked"))).join(inputs.withColumnRenamed("name", "series_id").withColumnsRenamed({"lo": "_lo", "hi": "_hi"}), ["target_id", "series_id"])
    rows = rows.join(ranges, ["target_id", "series_id"], "left")
    outside = F.when(F.col("shocked") < F.col("_lo"), F.col("_lo")).when(F.col("shocked") > F.col("_hi"), F.col("_hi"))
    return rows.select(
        "scenario_id", "target_id", "model_id", "series_id", "base", "shocked", "lo", "hi",
        F.coalesce(~F.col("shocked").between(F.col("lo"), F.col("hi")), F.lit(True)).alias("extrapolated"), outside.alias("clipped_to"),
    )


def signals_read(terms: DataFrame) -> DataFrame:
    """L6. Series that each model reads, from its terms' factors."""
    return terms.select("model_id", F.explode("factors").alias("series_id", "power")).select("model_id", "series_id").distinct()


def reoptimise(breakdown_inputs: DataFrame, shifts: DataFrame) -> DataFrame:
    """L7. Inputs of H8 with the signal difference moved by each scenario's change of the two forecasts."""
    return breakdown_inputs.join(shifts, "portfolio_id").withColumn("signal_diff", F.col("signal_diff") + F.col("shift"))


def portfolio_impact(base: DataFrame, shocked: DataFrame) -> DataFrame:
    """L8. Changes of the tail figures between two runs of K5 on the same draws."""
    names = [c for c in base.columns if c != "portfolio_id"]
    s = shocked.select("portfolio_id", *[F.col(c).alias(f"s_{c}") for c in names])
    return base.join(s, "portfolio_id").select("portfolio_id", *[(F.col(f"s_{c}") - F.col(c)).alias(f"d_{c}") for c in names])
