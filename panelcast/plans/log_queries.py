"""Queries over the run log (M, C12 to C14). Orders play the runs, line items their metrics, events the uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import runlog
from panelcast.plans import fixtures as fx
from panelcast.plans.register import query, r, rounded

fx.cte(
    "runs",
    """SELECT o_orderkey AS run_id, o_orderpriority AS model, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'done' END AS status, o_orderdate AS started_at, o_orderdate + o_custkey % 600 * INTERVAL 1 SECOND AS finished_at,
concat(o_orderpriority, '/', o_custkey % 50) AS settings, concat('d', o_custkey % 20) AS dataset_hash, o_custkey % 3 AS horizon FROM orders""",
)
fx.cte(
    "metrics",
    """SELECT l_orderkey AS run_id, CASE l_linenumber WHEN 1 THEN 'signal_rank_ic' WHEN 2 THEN 't' WHEN 3 THEN 'rmse' ELSE 'sharpe' END AS metric, CASE l_linestatus WHEN 'O' THEN 'net' ELSE 'gross' END AS basis, CASE WHEN l_partkey % 2 = 0 THEN 'optimised' ELSE 'benchmark' END AS portfolio, l_discount + l_quantity AS value FROM lineitem""",
)
fx.cte("active", "SELECT o_orderkey AS run_id, o_orderpriority AS role, concat('m', o_custkey % 9) AS model, o_orderdate AS set_at, o_totalprice / 1000000 AS baseline FROM orders")
fx.cte("uploads", "SELECT concat('h', user_id % 25) AS file_hash, concat('file', event_id % 40) AS file_name, ts AS uploaded_at FROM events")
fx.cte("sources", "SELECT DISTINCT concat('d', user_id % 20) AS dataset_hash, concat('h', user_id % 25) AS file_hash FROM events")


def runs(spark, d):
    o = fx.table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("model"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey") % 600).alias("finished_at"), F.concat("o_orderpriority", F.lit("/"), F.col("o_custkey") % 50).alias("settings"),
        F.concat(F.lit("d"), F.col("o_custkey") % 20).alias("dataset_hash"), (F.col("o_custkey") % 3).alias("horizon"),
    )


def metrics(spark, d):
    i = fx.table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    return i.select(
        F.col("l_orderkey").alias("run_id"), F.when(n == 1, "signal_rank_ic").when(n == 2, "t").when(n == 3, "rmse").otherwise("sharpe").alias("metric"), F.when(F.col("l_linestatus") == "O", "net").otherwise("gross").alias("basis"),
        F.when(F.col("l_partkey") % 2 == 0, "optimised").otherwise("benchmark").alias("portfolio"), (F.col("l_discount") + F.col("l_quantity")).alias("value"),
    )


def active(spark, d):
    o = fx.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("role"), F.concat(F.lit("m"), F.col("o_custkey") % 9).alias("model"), F.col("o_orderdate").cast("timestamp").alias("set_at"), (F.col("o_totalprice") / 1000000).alias("baseline"))


def uploads(spark, d):
    return fx.table(spark, d, "events").select(F.concat(F.lit("h"), F.col("user_id") % 25).alias("file_hash"), F.concat(F.lit("file"), F.col("event_id") % 40).alias("file_name"), F.col("ts").cast("timestamp").alias("uploaded_at"))


def sources(spark, d):
    return fx.table(spark, d, "events").select(F.concat(F.lit("d"), F.col("user_id") % 20).alias("dataset_hash"), F.concat(F.lit("h"), F.col("user_id") % 25).alias("file_hash")).distinct()


PIVOT = ", ".join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in runlog.HEADLINES)


@query("M1_runs_table", fx.sql(f"SELECT r.run_id, r.model, r.status, round(epoch(finished_at - started_at), 3) AS seconds, {', '.join(f'round(w.{m}, 6) AS {m}' for m in runlog.HEADLINES)} FROM runs r LEFT JOIN (SELECT run_id, {PIVOT} FROM metrics GROUP BY 1) w ON w.run_id = r.run_id", "runs", "metrics"))
def runs_table(spark, d):
    out = runlog.runs_table(runs(spark, d), metrics(spark, d))
    return out.select("run_id", "model", "status", r("seconds", "seconds", 3), *[r(m, m, 6) for m in runlog.HEADLINES])


NEWEST = "row_number() OVER (PARTITION BY {k} ORDER BY {at} DESC, run_id DESC) = 1"


@query("M2_latest_run", fx.sql("SELECT settings, dataset_hash, run_id, started_at::DATE AS day FROM runs WHERE status = 'done' QUALIFY " + NEWEST.format(k="settings, dataset_hash", at="started_at"), "runs"))
def latest_run(spark, d):
    rows = runlog.latest(runs(spark, d).filter("status = 'done'"), ["settings", "dataset_hash"], "started_at", "run_id")
    return rows.select("settings", "dataset_hash", "run_id", F.col("started_at").cast("date").alias("day"))


@query("M3_list_runs", fx.sql("SELECT run_id, model, status FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 25", "runs"))
def list_runs(spark, d):
    return runlog.newest(runs(spark, d), "started_at", "run_id", 25).select("run_id", "model", "status")


@query("M4_run_metrics", fx.sql("SELECT run_id, metric, count(*) AS n, round(max(value), 6) AS value FROM metrics WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'failed') GROUP BY 1, 2", "runs", "metrics"))
def run_metrics(spark, d):
    failed = runs(spark, d).filter("status = 'failed'").select("run_id")
    return rounded(metrics(spark, d).join(failed, "run_id", "left_semi").groupBy("run_id", "metric").agg(F.count("*").alias("n"), F.max("value").alias("value")), "value", places=6)


@query("M5_current_active", fx.sql("SELECT role, model, run_id FROM active QUALIFY " + NEWEST.format(k="role", at="set_at"), "active"))
def current_active(spark, d):
    return runlog.latest(active(spark, d), ["role"], "set_at", "run_id").select("role", "model", "run_id")


@query("M6_active_signal", fx.sql("SELECT a.role, m.metric, round(m.value - a.baseline, 6) AS signal FROM (SELECT * FROM active QUALIFY " + NEWEST.format(k="role", at="set_at") + ") a JOIN metrics m ON m.run_id = a.run_id", "active", "metrics"))
def active_signal(spark, d):
    current = runlog.latest(active(spark, d), ["role"], "set_at", "run_id")
    forecasts = metrics(spark, d).select("run_id", "metric", F.col("value").alias("predicted"))
    return rounded(runlog.active_signal(current, forecasts).select("role", "metric", "signal"), "signal", places=6)


@query(
    "M7_settings_match",
    fx.sql("SELECT a.run_id AS run_a, b.run_id AS run_b, a.horizon = b.horizon AND a.dataset_hash = b.dataset_hash AS same FROM (SELECT * FROM runs QUALIFY " + NEWEST.format(k="model", at="started_at") + ") a JOIN (SELECT * FROM runs QUALIFY " + NEWEST.format(k="settings", at="started_at") + ") b ON a.model = b.model", "runs"),
)
def settings_match(spark, d):
    all_runs = runs(spark, d).withColumn("test_window", F.lit(20))
    a = runlog.latest(all_runs, ["model"], "started_at", "run_id").alias("a")
    b = runlog.latest(all_runs, ["settings"], "started_at", "run_id").alias("b")
    return a.join(b, F.col("a.model") == F.col("b.model")).select(F.col("a.run_id").alias("run_a"), F.col("b.run_id").alias("run_b"), runlog.settings_match("a", "b").alias("same"))


CELLS = ", ".join(f"max(value) FILTER (basis = '{b}' AND portfolio = '{p}' AND metric = 'sharpe') AS sharpe_{p}_{b}" for b in ("gross", "net") for p in ("optimised", "benchmark"))
NAMES = [f"sharpe_{p}_{b}" for b in ("gross", "net") for p in ("optimised", "benchmark")]


@query("M8_portfolio_runs_table", fx.sql(f"SELECT r.run_id, CAST(r.horizon AS INT) AS horizon, {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)} FROM runs r LEFT JOIN (SELECT run_id, {CELLS} FROM metrics GROUP BY 1) m ON m.run_id = r.run_id", "runs", "metrics"))
def portfolio_runs_table(spark, d):
    rows = runs(spark, d).select("run_id", F.to_json(F.struct(F.lit(3).alias("risk_level"), "horizon")).alias("inputs"))
    out = runlog.portfolio_runs_table(rows, metrics(spark, d))
    return out.select("run_id", "horizon", *[r(n, n, 6) for n in NAMES])


@query("M9_number_new_runs", fx.sql("SELECT run_id, (SELECT count(*) FROM runs WHERE status = 'done') + row_number() OVER (ORDER BY started_at, run_id) AS number FROM runs WHERE status <> 'done'", "runs"))
def number_new_runs(spark, d):
    all_runs = runs(spark, d)
    return runlog.number_new_runs(all_runs, runlog.number_new_runs(all_runs.filter("status = 'done'"), all_runs.select("run_id", F.lit(0).alias("number")).limit(0)))


@query("M10_run_key", fx.sql("""SELECT run_id, sha256(concat('{"dataset_hash":"', dataset_hash, '","horizon":', horizon, ',"settings":"', settings, '"}')) AS run_key FROM runs""", "runs"))
def run_key(spark, d):
    return runs(spark, d).select("run_id", runlog.run_key(["settings", "horizon", "dataset_hash"]).alias("run_key"))


@query("M11_latest_success", fx.sql("SELECT model, run_id FROM runs WHERE status = 'done' QUALIFY " + NEWEST.format(k="model", at="started_at"), "runs"))
def latest_success(spark, d):
    return runlog.latest(runs(spark, d).filter("status = 'done'"), ["model"], "started_at", "run_id").select("model", "run_id")


FIRST = "(SELECT file_hash, arg_min(file_name, (uploaded_at, file_name)) AS file_name, min(uploaded_at) AS uploaded_at FROM uploads GROUP BY 1)"


@query("M12_run_source_files", fx.sql(f"SELECT r.run_id, s.file_hash, u.file_name FROM runs r LEFT JOIN sources s ON s.dataset_hash = r.dataset_hash LEFT JOIN {FIRST} u ON u.file_hash = s.file_hash WHERE r.status = 'failed'", "runs", "sources", "uploads"))
def run_source_files(spark, d):
    failed = runs(spark, d).filter("status = 'failed'").select("run_id", "dataset_hash", F.lit("x").alias("role"), "model")
    return runlog.lineage(failed.select("run_id", "role", "model"), failed.select("run_id", "dataset_hash"), sources(spark, d), uploads(spark, d)).select("run_id", "file_hash", "file_name")


@query(
    "M13_rerun_changes",
    fx.sql("SELECT settings, run_id, round(value, 6) AS value, round(value - lag(value) OVER (PARTITION BY settings ORDER BY started_at, run_id), 6) + 0.0 AS change FROM (SELECT r.*, m.value FROM runs r JOIN (SELECT run_id, max(value) AS value FROM metrics WHERE metric = 't' GROUP BY 1) m ON m.run_id = r.run_id WHERE r.settings IN (SELECT settings FROM runs GROUP BY 1 HAVING count(*) > 1))", "runs", "metrics"),
)
def rerun_changes(spark, d):
    best = metrics(spark, d).groupBy("run_id", "metric").agg(F.max("value").alias("value"))
    return rounded(runlog.rerun_changes(runs(spark, d), best, "t").select("settings", "run_id", "value", "change"), "value", "change", places=6)


PICK = "max(value) FILTER (basis = 'net' AND metric = 'sharpe' AND portfolio = '{p}')"


@query("M14_beats_benchmark", fx.sql(f"SELECT run_id, round({PICK.format(p='optimised')}, 6) AS optimised, round({PICK.format(p='benchmark')}, 6) AS benchmark FROM metrics GROUP BY 1 HAVING {PICK.format(p='optimised')} > {PICK.format(p='benchmark')}", "metrics"))
def beats_benchmark(spark, d):
    return rounded(runlog.beats_benchmark(metrics(spark, d)), "optimised", "benchmark", places=6)


@query("M15_failure_rates", fx.sql("SELECT model, count(*) AS runs, count(*) FILTER (status = 'failed') AS failures, round(avg(epoch(finished_at - started_at)), 6) AS mean_seconds FROM runs GROUP BY 1", "runs"))
def failure_rates(spark, d):
    return rounded(runlog.failure_rates(runs(spark, d)), "mean_seconds", places=6)


fx.cte("made", "SELECT l_orderkey AS run_id, CAST(l_shipdate AS DATE) AS date, l_linenumber AS line, CAST(l_discount AS DOUBLE) AS predicted, CAST(l_tax AS DOUBLE) AS baseline, CAST(l_quantity AS DOUBLE) / 500 AS realised FROM lineitem")


def made(spark, d):
    """Line items as stored forecasts, with discounts as forecasts, taxes as baselines and quantities as outcomes."""
    i = fx.table(spark, d, "lineitem")
    number = lambda c: F.col(c).cast("double")
    return i.select(F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_linenumber").alias("line"), number("l_discount").alias("predicted"), number("l_tax").alias("baseline"), (number("l_quantity") / 500).alias("realised"))


@query(
    "M16_direction_hit_rate",
    fx.sql(
        """SELECT model, count(*) AS views, round(count(*) FILTER (moved * outcome > 0) / count(*), 8) AS hit_rate
FROM (SELECT run_id, predicted - baseline AS moved, realised - baseline AS outcome FROM made) v, runs WHERE runs.run_id = v.run_id AND moved <> 0 AND outcome IS NOT NULL GROUP BY ALL""",
        "runs", "made",
    ),
)
def direction_hit_rate(spark, d):
    return rounded(runlog.direction_hit_rate(runs(spark, d), made(spark, d)), "hit_rate")


@query("M4_run_forecasts", fx.sql("SELECT run_id, date, line, predicted, baseline, realised FROM made WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'failed')", "made", "runs"))
def run_forecasts(spark, d):
    return runlog.of_runs(made(spark, d), runs(spark, d).filter("status = 'failed'"))


@query("M3_recent_uploads", fx.sql("SELECT file_hash, file_name, uploaded_at FROM uploads ORDER BY uploaded_at DESC, file_name DESC LIMIT 20", "uploads"))
def recent_uploads(spark, d):
    return runlog.newest(uploads(spark, d), "uploaded_at", "file_name", 20)


@query("M7_is_stale", fx.sql("SELECT run_id, NOT (dataset_hash = 'd3' AND (run_id % 5 = 0 OR horizon = 1)) AS stale FROM runs", "runs"))
def is_stale(spark, d):
    target = F.when(F.col("run_id") % 5 != 0, F.concat(F.lit("t"), "horizon"))
    return runs(spark, d).select("run_id", runlog.is_stale(F.lit("d3"), F.lit("t1"), F.col("dataset_hash"), target).alias("stale"))


@query("C12_insert_new", fx.sql("SELECT count(*) AS inserted, min(run_id) AS first FROM runs WHERE run_id NOT IN (SELECT run_id FROM runs WHERE status = 'done')", "runs"))
def insert_new(spark, d):
    all_runs = runs(spark, d)
    return runlog.insert_new(all_runs.filter("status = 'done'"), all_runs.unionByName(all_runs), ["run_id"]).agg(F.count("*").alias("inserted"), F.min("run_id").alias("first"))


@query("C13_lineage", fx.sql(f"SELECT a.role, a.model, a.run_id, r.dataset_hash, s.file_hash, u.file_name FROM (SELECT * FROM active QUALIFY {NEWEST.format(k='role', at='set_at')}) a JOIN runs r ON r.run_id = a.run_id LEFT JOIN sources s ON s.dataset_hash = r.dataset_hash LEFT JOIN {FIRST} u ON u.file_hash = s.file_hash", "active", "runs", "sources", "uploads"))
def lineage(spark, d):
    current = runlog.latest(active(spark, d), ["role"], "set_at", "run_id").select("run_id", "role", "model")
    return runlog.lineage(current, runs(spark, d).select("run_id", "dataset_hash"), sources(spark, d), uploads(spark, d)).drop("uploaded_at")


@query("C14_runs_with_models", fx.sql("SELECT p.run_id, a.model AS equity_model FROM (SELECT run_id, started_at FROM runs WHERE status = 'failed') p LEFT JOIN (SELECT * FROM active WHERE role = '1-URGENT' QUALIFY row_number() OVER (PARTITION BY set_at ORDER BY run_id DESC) = 1) a ON a.set_at = p.started_at", "runs", "active"))
def runs_with_models(spark, d):
    past = runs(spark, d).filter("status = 'failed'").select("run_id", F.to_json(F.struct(F.date_format("started_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("equity_set_at"))).alias("inputs"))
    models = runlog.latest(active(spark, d).filter("role = '1-URGENT'").withColumn("role", F.lit("equity")), ["set_at"], "set_at", "run_id")
    return runlog.runs_with_models(past, models, "equity").select("run_id", "equity_model")
