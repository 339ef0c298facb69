"""Queries over the append-only run log: runs, metrics, forecasts, uploads, active models, portfolio runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADLINES = ("signal_rank_ic", "t", "rmse")


def insert_new(log: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """C12. The rows whose keys the log does not have; one per key."""
    return rows.dropDuplicates(keys).join(log.select(*keys), keys, "left_anti")


def lineage(active: DataFrame, runs: DataFrame, sources: DataFrame, uploads: DataFrame) -> DataFrame:
    """C13. Active model -> run -> dataset -> source files, with the first upload of each file's hash."""
    first = uploads.groupBy("file_hash").agg(F.min_by("file_name", F.struct("uploaded_at", "file_name")).alias("file_name"), F.min("uploaded_at").alias("uploaded_at"))
    return active.join(runs, "run_id").join(sources, "dataset_hash", "left").join(first, "file_hash", "left").select("role", "model", "run_id", "dataset_hash", "file_hash", "file_name", "uploaded_at")


def runs_with_models(portfolio_runs: DataFrame, active: DataFrame, role: str) -> DataFrame:
    """C14. The model behind a past portfolio run, by role and the time in its inputs."""
    at = F.get_json_object("inputs", f"$.{role}_set_at").try_cast("timestamp")
    models = active.filter(F.col("role") == role).select(F.col("set_at").alias("at"), F.col("model").alias(f"{role}_model"))
    return portfolio_runs.withColumn("at", at).join(models, "at", "left").drop("at")


def runs_table(runs: DataFrame, metrics: DataFrame, metric_names: tuple[str, ...] = HEADLINES) -> DataFrame:
    """M1. Runs with their headline metrics as columns and the seconds they took."""
    wide = metrics.filter(F.col("metric").isin(*metric_names)).groupBy("run_id").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metric_names])
    seconds = (F.unix_millis("finished_at") - F.unix_millis("started_at")) / 1000
    return runs.join(wide, "run_id", "left").withColumn("seconds", seconds)


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """M2, M5, M11. The newest row per key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def newest(rows: DataFrame, at: str, tie: str, n: int) -> DataFrame:
    """M3. The ``n`` newest rows."""
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(n)


def active_signal(current: DataFrame, forecasts: DataFrame) -> DataFrame:
    """M6. Forecast less baseline of the current models."""
    return forecasts.join(current.select("run_id", "role", "baseline"), "run_id").withColumn("signal", F.col("predicted") - F.col("baseline"))


def settings_match(a: str, b: str) -> Column:
    """M7. Same horizon, test window and dataset of two aliased rows."""
    same = F.lit(True)
    for c in ("horizon", "test_window", "dataset_hash"):
        same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return same


def of_runs(saved: DataFrame, keys: DataFrame, key: str = "run_id") -> DataFrame:
    """M4. Saved rows (forecasts, metrics, paths, weights) of the runs asked for; none for a run that saved none."""
    return saved.join(keys.select(key).distinct(), key, "left_semi")


def saved_paths(daily: DataFrame, weights: DataFrame, keys: DataFrame) -> DataFrame:
    """M4. A portfolio run's saved daily returns with the weights set on that day, where one was."""
    return of_runs(daily, keys, "run_key").join(of_runs(weights, keys, "run_key"), ["run_key", "date"], "left")


def is_stale(dataset: Column, target: Column, own_dataset: Column, own_target: Column) -> Column:
    """M7. Whether a model was fitted on other data, or forecasts another target; a model that recorded no target is judged
    on its data alone."""
    return ~own_dataset.eqNullSafe(dataset) | ~(own_target.isNull() | own_target.eqNullSafe(target))


def portfolio_runs_table(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """M8. Runs with settings from their inputs and Sharpe ratios by basis and portfolio."""
    cells = [F.max(F.when((F.col("basis") == b) & (F.col("portfolio") == p) & (F.col("metric") == "sharpe"), F.col("value"))).alias(f"sharpe_{p}_{b}") for b in ("gross", "net") for p in ("optimised", "benchmark")]
    wide = metrics.groupBy("run_id").agg(*cells)
    read = lambda k: F.get_json_object("inputs", f"$.{k}")
    return runs.join(wide, "run_id", "left").withColumn("risk_level", read("risk_level").cast("int")).withColumn("horizon", read("horizon").cast("int"))


def number_new_runs(runs: DataFrame, numbers: DataFrame) -> DataFrame:
    """M9. Numbers for runs without one, after the largest given so far, in order of start and id.

    Runs are numbered within their day and days are offset by the counts of earlier days, so only a row per day is ever
    in one task. Every run has a start.
    """
    last = numbers.agg(F.coalesce(F.max("number"), F.lit(0)).alias("last"))
    new = runs.join(numbers, "run_id", "left_anti").withColumn("day", F.to_date("started_at"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = new.groupBy("day").agg(F.count("*").alias("n")).crossJoin(last).select("day", (F.col("last") + earlier).alias("before"))
    place = F.row_number().over(Window.partitionBy("day").orderBy("started_at", "run_id"))
    return new.withColumn("place", place).join(days, "day").select("run_id", (F.col("before") + F.col("place")).alias("number"))


def run_key(inputs: list[str]) -> Column:
    """M10. SHA-256 of the inputs as canonical JSON: names sorted, nulls left out by the writer."""
    return F.sha2(F.to_json(F.struct(*sorted(inputs))), 256)


def rerun_changes(runs: DataFrame, metrics: DataFrame, metric: str) -> DataFrame:
    """M13. A metric's history for settings that were run more than once."""
    again = runs.groupBy("settings").agg(F.count("*").alias("n")).filter("n > 1")
    rows = runs.join(again, "settings", "left_semi").join(metrics.filter(F.col("metric") == metric), "run_id")
    before = F.lag("value").over(Window.partitionBy("settings").orderBy("started_at", "run_id"))
    return rows.withColumn("change", F.col("value") - before).select("settings", "run_id", "started_at", "value", "change")


def beats_benchmark(metrics: DataFrame) -> DataFrame:
    """M14. Runs whose net Sharpe ratio is above the benchmark's."""
    pick = lambda p: F.max(F.when((F.col("basis") == "net") & (F.col("metric") == "sharpe") & (F.col("portfolio") == p), F.col("value")))
    return metrics.groupBy("run_id").agg(pick("optimised").alias("optimised"), pick("benchmark").alias("benchmark")).filter("optimised > benchmark")


def failure_rates(runs: DataFrame) -> DataFrame:
    """M15. Runs, failures and mean seconds per model."""
    seconds = (F.unix_millis("finished_at") - F.unix_millis("started_at")) / 1000
    return runs.groupBy("model").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failures"), F.avg(seconds).alias("mean_seconds"))


def direction_hit_rate(runs: DataFrame, forecasts: DataFrame) -> DataFrame:
    """M16. Per model: dates on which a forecast takes a view, that is, differs from its baseline, and the share of them
    whose outcome lies on the same side of the baseline (an outcome equal to it is on neither)."""
    views = forecasts.filter("predicted IS NOT NULL AND realised IS NOT NULL AND predicted <> baseline")
    right = F.signum(F.col("predicted") - F.col("baseline")) == F.signum(F.col("realised") - F.col("baseline"))
    share = F.avg(F.when(right, 1.0).otherwise(0.0))
    return views.join(runs.select("run_id", "model"), "run_id").groupBy("model").agg(F.count("*").alias("views"), share.alias("hit_rate"))
