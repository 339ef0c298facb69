"""Queries of ingest (A, B, C), data quality (D), bars and sets (N), streaming (P) over the provided tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from panelcast.operators import ingest, panel, quality, resample
from panelcast.plans import fixtures as fx
from panelcast.plans.panel_queries import SEGMENTS, Parts
from panelcast.plans.register import binary_round, query, rounded
from panelcast.sources import exports

EVENTS = "(SELECT concat('f', user_id % 2) AS file, event_type, CAST(ts AS DATE) AS date, value, event_id AS pos FROM events)"


def event_rows(spark, d):
    e = fx.table(spark, d, "events")
    return e.select(F.concat(F.lit("f"), F.col("user_id") % 2).alias("file"), "event_type", F.col("ts").cast("date").alias("date"), "value", F.col("event_id").alias("pos"))


def shared_path(spark, name):
    """A new path in the cluster's shared folder; a temporary folder only in local mode, where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="panelcast-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


# A: files made from the tables by Spark, then read back -------------------------------------------------------------
@query(
    "A1_read_exports",
    fx.sql("SELECT series_id, year(date) AS year, 'VALUE' AS field, date, round(value, 7) AS value FROM signals WHERE value IS NOT NULL", "signals"),
)
def read_exports(spark, d):
    """Writes every series and year as vendor exports, its lines sorted within the files, and reads them all as observations."""
    s = Parts(spark, d).signals.filter("value IS NOT NULL").withColumn("year", F.year("date"))
    text = F.concat_ws(",", F.col("date").cast("string"), F.format_string("%.9f", "value"))
    keys = ["series_id", "year"]
    heads = s.select(*keys).distinct().select(*keys, F.posexplode(F.array(F.concat(F.lit("Security,"), "series_id", F.lit(" Index")), F.lit("Period,D"), F.lit(""), F.lit("Date,VALUE"))).alias("pos", "value"))
    lines = heads.select(*keys, F.col("pos").cast("long"), "value").unionByName(s.select(*keys, F.datediff("date", F.lit("1900-01-01")).cast("long").alias("pos"), text.alias("value")))
    path = shared_path(spark, "exports")
    lines.repartition(*keys).sortWithinPartitions(*keys, "pos").select(*keys, "value").write.partitionBy(*keys).text(path)
    raw = exports.read_lines(spark, path)
    meta, _ = exports.read_exports(raw)
    named = meta.filter("key = 'security'").select("file", F.regexp_replace("value", " Index$", "").alias("series_id"))
    obs, _ = exports.observations(raw)
    return rounded(obs.join(named, "file").select("series_id", F.year("date").alias("year"), "field", "date", "value"), "value", places=7)


def week_files(spark, d):
    """Every series and week as the cells of an export in month-first numbers: some with bounds, some with a period."""
    s = Parts(spark, d).signals
    week = F.trunc("date", "week")
    rows = s.select(F.concat_ws("/", "series_id", week.cast("string")).alias("file"), "date", F.year(week).alias("year"), F.month(week).alias("month"))
    written = lambda c: F.date_format(c, "M/d/yyyy")
    ends = rows.groupBy("file").agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.first("year").alias("year"), F.first("month").alias("month"))
    known = F.map_filter(
        F.create_map(
            F.lit("start date"), F.when(F.col("year") % 2 == 0, written("lo")), F.lit("end date"), F.when(F.col("year") % 2 == 0, written("hi")), F.lit("period"), F.when(F.col("month") % 2 == 0, F.lit("D")),
        ),
        lambda k, v: v.isNotNull(),
    )
    return rows.select("file", written("date").alias("date_text")), ends.select("file", F.explode(known).alias("key", "value"))


fx.cte(
    "wk",
    "SELECT concat_ws('/', series_id, CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR)) AS file, CAST(date_trunc('week', date) AS DATE) AS w, date AS m, TRY_CAST(printf('%04d-%02d-%02d', year(date), day(date), month(date)) AS DATE) AS d FROM signals",
    "signals",
)


@query(
    "A2_settle_date_order",
    fx.sql(
        """SELECT file, reading, CASE WHEN reading IS NULL THEN 'ambiguous dates' END AS reason FROM (SELECT g.file, CASE WHEN NOT wd OR open = 0 THEN 'month_first' WHEN bounds AND NOT coalesce(ld >= sd AND hd <= ed, false) THEN 'month_first'
  WHEN period AND fm AND NOT fd THEN 'month_first' WHEN period AND fd AND NOT fm THEN 'day_first' END AS reading FROM (
    SELECT file, bool_and(d IS NOT NULL) AS wd, count(*) FILTER (m <> d) AS open, min(d) AS ld, max(d) AS hd, any_value(w) AS w, year(any_value(w)) % 2 = 0 AS bounds, month(any_value(w)) % 2 = 0 AS period, arg_min(d, m) AS sd, arg_max(d, m) AS ed FROM wk GROUP BY 1) g
  LEFT JOIN (SELECT file, median(s) BETWEEN 1 AND 7 AS fm FROM (SELECT file, m - lag(m) OVER (PARTITION BY file ORDER BY m) AS s FROM wk) GROUP BY 1) a USING (file) LEFT JOIN (SELECT file, median(s) BETWEEN 1 AND 7 AS fd FROM (SELECT file, d - lag(d) OVER (PARTITION BY file ORDER BY d) AS s FROM wk WHERE d IS NOT NULL) GROUP BY 1) b USING (file))""",
        "wk",
    ),
)
def settle_date_order(spark, d):
    return exports.settle_date_order(*week_files(spark, d))


@query(
    "A3_ungroup_numbers",
    "SELECT o_orderpriority AS file, o_orderstatus AS field, o_orderkey AS pos, CASE o_orderstatus WHEN 'F' THEN CASE WHEN max(floor(o_totalprice)) OVER w < 1000 OR floor(o_totalprice) < 1000 THEN CAST(floor(o_totalprice) AS DOUBLE) END WHEN 'O' THEN CAST(round(o_totalprice, 2) AS DOUBLE) WHEN 'P' THEN CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) END END AS value FROM orders WINDOW w AS (PARTITION BY o_orderpriority, o_orderstatus)",
)
def ungroup_numbers(spark, d):
    """Prices grouped with a point (certain), grouped without one (may be a decimal comma) and plain numbers with gaps."""
    o, status = fx.table(spark, d, "orders"), F.col("o_orderstatus")
    text = F.when(status == "F", F.format_number(F.floor("o_totalprice"), 0)).when(status == "O", F.format_number(F.round("o_totalprice", 2), 2)).when(F.col("o_custkey") % 7 == 0, "#N/A N/A").otherwise(F.col("o_custkey").cast("string"))
    cells = o.select(F.col("o_orderpriority").alias("file"), status.alias("field"), F.col("o_orderkey").alias("pos"), text.alias("text"))
    return exports.ungroup_numbers(cells).select("file", "field", "pos", "value")


def shipped_lines(spark, d):
    """Line items as lines of exports, by supplier; the seventh of an order has a cell too many, the sixth an empty one."""
    n = F.col("l_linenumber")
    line = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(","), F.col("l_quantity").cast("string"), F.when(n == 7, ",9").when(n == 6, ",").otherwise(""))
    file = F.concat(F.lit("f"), F.col("l_suppkey") % 20)
    items = fx.table(spark, d, "lineitem").select(file.alias("file"), (F.col("l_orderkey") * 8 + n).cast("long").alias("pos"), line.alias("line"))
    return items.select("file").distinct().select("file", F.lit(0).cast("long").alias("pos"), F.lit("Date,V").alias("line")).unionByName(items)


@query("A4_overlong_rows", "SELECT concat('f', l_suppkey % 20) AS file, CAST(l_orderkey * 8 + l_linenumber + 1 AS BIGINT) AS line_number FROM lineitem WHERE l_linenumber = 7")
def overlong_rows(spark, d):
    return exports.overlong_rows(shipped_lines(spark, d))


@query("A5_reject_unnamed", "SELECT concat('u', user_id) AS file, count(DISTINCT event_type) AS fields, 'no security' AS reason FROM events WHERE user_id % 3 = 0 GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def reject_unnamed(spark, d):
    e = fx.table(spark, d, "events")
    file = F.concat(F.lit("u"), "user_id").alias("file")
    meta = e.filter("user_id % 3 <> 0").select(file).distinct().select("file", F.lit("security").alias("key"), F.lit("X Index").alias("value"))
    return exports.reject_unnamed(meta, e.select(file, F.col("event_type").alias("field")))


@query(
    "A6_read_factor_table",
    fx.sql("UNPIVOT (SELECT date, " + ", ".join(f"round({s.lower()}, 4) AS {s.lower()}" for s in SEGMENTS) + " FROM factors WHERE date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31') ON COLUMNS(* EXCLUDE (date)) INTO NAME factor VALUE value", "factors"),
)
def read_factor_table(spark, d):
    """The factors as lines of a factor file, with prose above and below, read back within a span of dates."""
    names = [s.lower() for s in SEGMENTS]
    wide = ingest.to_wide(Parts(spark, d).signals.filter(F.col("series_id").startswith("seg_")), [f"seg_{s}" for s in SEGMENTS])
    cells = [F.coalesce(F.format_string("%.6f", f"seg_{s}"), F.lit("")) for s in SEGMENTS]
    rows = wide.select(F.datediff("date", F.lit("1900-01-01")).alias("pos"), F.concat_ws(",", F.date_format("date", "yyyyMMdd"), *cells).alias("line"))
    # the header is told by its first factor's name
    around = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("Some prose, 2020").alias("line")), F.struct(F.lit(1).alias("pos"), F.lit(",Mkt-RF " + "," .join(["", *names[1:]])).alias("line")), F.struct(F.lit(10**6).alias("pos"), F.lit("Copyright").alias("line")))).alias("l")).select("l.*")
    lines = rows.unionByName(around).withColumn("file", F.lit("factors"))
    out = exports.read_factor_table(lines, "1994-01-01", "1996-12-31").filter("value IS NOT NULL")
    return rounded(out.withColumn("factor", F.when(F.col("factor") == "Mkt-RF", names[0]).otherwise(F.col("factor"))), "value", places=4)


HASHED = """SELECT series_id, sha256(string_agg(mh, '' ORDER BY mh)) AS content_hash FROM (SELECT series_id, concat(month, sha256(string_agg(h, '' ORDER BY h))) AS mh FROM (
  SELECT series_id, strftime(date, '%Y-%m') AS month, sha256(concat_ws(',', series_id, CAST(date AS VARCHAR), coalesce(printf('%.6f', value), ''))) AS h FROM signals) GROUP BY series_id, month) GROUP BY 1"""


@query("A7_write_canonical", fx.sql("SELECT series_id, CAST(date AS VARCHAR) AS date, round(value, 6) AS value FROM signals", "signals"))
def write_canonical(spark, d):
    """Writes the signals as canonical CSV and reads the text back."""
    path = shared_path(spark, "canonical")
    exports.write_canonical(Parts(spark, d).signals, path)
    return rounded(spark.read.schema("series_id string, date string, value double").csv(path, header=True), "value", places=6)


@query("A7_dataset_hash", fx.sql(HASHED, "signals"))
def dataset_hash(spark, d):
    return exports.dataset_hash(fx.exact_signals(spark, d))


@query("A8_dataset_fingerprint", fx.sql(f"SELECT * FROM (SELECT series_id, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM signals GROUP BY 1) JOIN ({HASHED}) USING (series_id)", "signals"))
def dataset_fingerprint(spark, d):
    return exports.dataset_fingerprint(fx.exact_signals(spark, d))


@query("A9_export_merged", fx.sql("SELECT strftime(date, '%d/%m/%Y') AS date, " + ", ".join(f"round({s.lower()}, 4) AS {s.lower()}" for s in SEGMENTS) + " FROM factors", "factors"))
def export_merged(spark, d):
    wide = ingest.to_wide(Parts(spark, d).signals, [f"seg_{s}" for s in SEGMENTS]).dropna("all", subset=[f"seg_{s}" for s in SEGMENTS])
    return rounded(exports.export_merged(wide.withColumnsRenamed({f"seg_{s}": s.lower() for s in SEGMENTS})), *[s.lower() for s in SEGMENTS], places=4)


@query("A10_append_log", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def append_log(spark, d):
    """Appends the events in two parts to a partitioned log and reads it back."""
    e = fx.table(spark, d, "events")
    path = shared_path(spark, "log")
    for part in (0, 1):
        exports.append_log(e.filter(F.col("event_id") % 2 == part).select("event_id", "event_type", "value"), path, "event_type")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("A11_date_range", "SELECT min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date, 0 AS unreadable FROM orders")
def date_range(spark, d):
    return exports.date_range(fx.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("t")), "t")


# B --------------------------------------------------------------------------------------------------------------------
fx.cte(
    "dim",
    """SELECT c_custkey AS k, concat('S', c_custkey % 40, ' Index') AS security, concat('S', c_custkey % 40) AS ticker, CASE c_custkey % 5 WHEN 0 THEN 'PX_LAST' WHEN 1 THEN 'TOT_RETURN_INDEX' WHEN 2 THEN 'PX_BID' WHEN 3 THEN 'YLD' ELSE 'VOLUME' END AS field,
concat('s', c_custkey) AS series_id, concat('file_', c_custkey % 7, '.csv') AS file, c_mktsegment AS segment FROM customer""",
)


def dim(spark, d):
    k = F.col("c_custkey")
    field = F.when(k % 5 == 0, "PX_LAST").when(k % 5 == 1, "TOT_RETURN_INDEX").when(k % 5 == 2, "PX_BID").when(k % 5 == 3, "YLD").otherwise("VOLUME")
    return fx.table(spark, d, "customer").select(
        k.alias("k"), F.concat(F.lit("S"), k % 40, F.lit(" Index")).alias("security"), F.concat(F.lit("S"), k % 40).alias("ticker"), field.alias("field"), F.concat(F.lit("s"), k).alias("series_id"),
        F.concat(F.lit("file_"), k % 7, F.lit(".csv")).alias("file"), F.col("c_mktsegment").alias("segment"),
    )


@query(
    "B1_series_label",
    "SELECT file, security, CASE WHEN count(*) OVER (PARTITION BY l) > 1 THEN file_label ELSE l END AS label FROM (SELECT concat('f-', c_custkey, '.csv') AS file, c_name AS security, concat('f_', c_custkey) AS file_label, trim(regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g'), '_') AS l FROM customer)",
)
def series_label(spark, d):
    files = fx.table(spark, d, "customer").select(F.concat(F.lit("f-"), "c_custkey", F.lit(".csv")).alias("file"), F.col("c_name").alias("security"))
    return ingest.with_labels(files)


@query("B2_series_sources", fx.sql("SELECT field AS column, security, file, split_part(security, ' ', 1) AS ticker FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY file, k) AS i FROM dim) WHERE i = 1", "dim"))
def series_sources(spark, d):
    rows = dim(spark, d).withColumn("file_k", F.struct("file", "k"))
    out = ingest.series_sources(rows.select(F.col("field").alias("column"), "security", "field", F.struct("file", "k").alias("file")))
    return out.select("column", "security", F.col("file.file").alias("file"), "ticker")


@query("B3_classify_transform", fx.sql("SELECT series_id, CASE WHEN field LIKE '%TOT_RETURN%' THEN 'LOG_RETURN' WHEN ticker IN ('S1', 'S2') THEN 'LEVEL' ELSE 'DIFFERENCE' END AS transform, field NOT LIKE '%TOT_RETURN%' AND ticker NOT IN ('S1', 'S2') AS unclassified FROM dim", "dim"))
def classify_transform(spark, d):
    known = spark.createDataFrame([("S1", "LEVEL"), ("S2", "LEVEL")], "ticker string, transform string")
    return ingest.classify_transform(dim(spark, d), known).select("series_id", "transform", "unclassified")


@query(
    "B4_select_signals",
    fx.sql(
        "SELECT security, series_id, field FROM (SELECT *, row_number() OVER (PARTITION BY security ORDER BY CASE WHEN field LIKE '%TOT_RETURN%' THEN 0 WHEN field = 'PX_LAST' THEN 1 ELSE 2 END, field, series_id) AS i FROM dim WHERE field NOT LIKE '%BID%' AND security NOT IN ('S3 Index', 'S4 Index')) WHERE i = 1",
        "dim",
    ),
)
def select_signals(spark, d):
    targets = spark.createDataFrame([("S3 Index",), ("S4 Index",)], "security string")
    return ingest.select_signals(dim(spark, d), targets).select("security", "series_id", "field")


@query("B5_empty_series", "SELECT concat('e', user_id) AS series_id, count(*) AS rows FROM events GROUP BY 1 HAVING count(CASE WHEN value > 250 THEN value END) = 0")
def empty_series(spark, d):
    e = fx.table(spark, d, "events")
    return ingest.empty_series(e.select(F.concat(F.lit("e"), "user_id").alias("series_id"), F.when(F.col("value") > 250, F.col("value")).alias("value")))


@query("B6_classify_checks", fx.sql("SELECT series_id, CASE WHEN field LIKE '%TOT_RETURN%' THEN 'POSITIVE' WHEN instr(concat('_', field), '_PX_') > 0 THEN 'NUMERIC' ELSE 'SANE_RANGE' END AS check_name FROM dim", "dim"))
def classify_checks(spark, d):
    return dim(spark, d).select("series_id", quality.classify_check(F.concat(F.lit("_"), "field")).alias("check_name"))


@query("B11_weekend_rows", fx.sql("SELECT series_id, count(*) AS weekend_rows FROM signals WHERE isodow(date) >= 6 GROUP BY 1", "signals"))
def weekend_rows(spark, d):
    return Parts(spark, d).signals.filter(quality.weekend(F.col("date"))).groupBy("series_id").agg(F.count("*").alias("weekend_rows"))


@query(
    "B11_unreadable_dates",
    "SELECT concat('f', user_id % 7) AS file, count(*) AS unreadable, min(event_id) AS first_pos FROM events WHERE event_id % 9 = 0 GROUP BY 1",
)
def unreadable_dates(spark, d):
    """Events as rows of files, every ninth of which has its date written as a spreadsheet's serial number."""
    e = fx.table(spark, d, "events")
    text = F.when(F.col("event_id") % 9 == 0, "45293").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    date = F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return quality.unreadable_dates(e.select(F.concat(F.lit("f"), F.col("user_id") % 7).alias("file"), F.col("event_id").alias("pos"), date.alias("date")))


@query(
    "B14_resolve_inputs",
    fx.sql(
        "SELECT target_id, ticker, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE n WHEN 1 THEN s END AS series_id FROM (SELECT w.target_id, w.ticker, count(x.series_id) AS n, min(x.series_id) AS s FROM (SELECT DISTINCT o_orderpriority AS target_id, concat('S', o_custkey % 1700) AS ticker FROM orders) w LEFT JOIN (SELECT concat('S', k // 2 + CASE WHEN k % 3 = 0 THEN 500 ELSE 0 END) AS ticker, series_id FROM dim) x ON x.ticker = w.ticker GROUP BY 1, 2)",
        "dim",
    ),
)
def resolve_inputs(spark, d):
    wanted = fx.table(spark, d, "orders").select(F.col("o_orderpriority").alias("target_id"), F.concat(F.lit("S"), F.col("o_custkey") % 1700).alias("ticker")).distinct()
    k = F.col("k")
    own = F.concat(F.lit("S"), (F.floor(k / 2) + F.when(k % 3 == 0, 500).otherwise(0)).cast("string"))
    return ingest.resolve_inputs(dim(spark, d).withColumn("ticker", own), wanted)


@query(
    "B15_resolve_targets",
    fx.sql("SELECT role, arg_min(series_id, (CASE WHEN field LIKE '%TOT_RETURN%' THEN 0 ELSE 1 END, field, series_id)) AS series_id, CASE WHEN count(DISTINCT file) > 1 THEN 'two files in one role' END AS conflict FROM (SELECT *, CASE security WHEN 'S3 Index' THEN 'equity' ELSE 'bond' END AS role FROM dim WHERE security IN ('S3 Index', 'S4 Index')) GROUP BY 1", "dim"),
)
def resolve_targets(spark, d):
    roles = spark.createDataFrame([("S3 Index", "equity"), ("S4 Index", "bond")], "security string, role string")
    return ingest.resolve_targets(dim(spark, d), roles)


@query("C1_merge_on_date", fx.sql("SELECT date, " + ", ".join(f"round({s.lower()}, 4) AS seg_{s}" for s in SEGMENTS) + ", NULL::DOUBLE AS none FROM (SELECT date FROM signals GROUP BY 1) LEFT JOIN factors USING (date)", "signals", "factors"))
def merge_on_date(spark, d):
    s = Parts(spark, d).signals
    halves = [s.filter(F.col("series_id").startswith(x)) for x in ("ret_", "disc_", "seg_")]
    wide = ingest.to_wide(ingest.merge_on_date(*halves), [*[f"seg_{x}" for x in SEGMENTS], "none"])
    return rounded(wide.withColumn("none", F.col("none").cast("double")), *[f"seg_{x}" for x in SEGMENTS], places=4)


fx.cte("parts", f"SELECT event_type AS security, 'V' AS field, file, date, max(CASE WHEN value > 2 THEN round(value) END) AS value FROM {EVENTS} GROUP BY ALL")


def parts(spark, d):
    rows = event_rows(spark, d).groupBy(F.col("event_type").alias("security"), F.lit("V").alias("field"), "file", "date")
    return rows.agg(F.max(F.when(F.col("value") > 2, F.round("value", 0))).alias("value"))


@query("C2_join_split_series", fx.sql("SELECT security, field, count(*) AS clashes, min(date) AS first_clash FROM (SELECT security, field, date FROM parts GROUP BY ALL HAVING count(DISTINCT value) > 1) GROUP BY ALL", "parts"))
def split_clashes(spark, d):
    return ingest.join_split_series(parts(spark, d))[1]


@query("C2_joined", fx.sql("SELECT security, field, date, max(value) AS value, count(DISTINCT file) AS files FROM parts GROUP BY ALL HAVING count(DISTINCT value) <= 1", "parts"))
def split_joined(spark, d):
    return ingest.join_split_series(parts(spark, d))[0]


HOLIDAYS = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE month(o_orderdate) = 12 AND day(o_orderdate) = 25)"


def holidays(spark, d):
    o = fx.table(spark, d, "orders")
    return o.filter((F.month("o_orderdate") == 12) & (F.dayofmonth("o_orderdate") == 25)).select(F.col("o_orderdate").cast("date").alias("date")).distinct()


MISSING = f"""SELECT g.date, g.missing, g.n_missing, CASE WHEN isodow(g.date) >= 6 THEN 'weekend' WHEN h.date IS NOT NULL THEN 'market holiday' ELSE 'unexplained' END AS reason FROM (
  SELECT u.date, string_agg(u.series_id, ', ' ORDER BY u.series_id) AS missing, count(*) AS n_missing FROM (SELECT * FROM (SELECT DISTINCT date FROM signals) CROSS JOIN (SELECT DISTINCT series_id FROM signals)) u LEFT JOIN signals s ON s.date = u.date AND s.series_id = u.series_id WHERE s.value IS NULL GROUP BY 1) g LEFT JOIN {HOLIDAYS} h ON h.date = g.date"""


@query("D5_missing_rows", fx.sql(MISSING, "signals"))
def missing_rows(spark, d):
    s = Parts(spark, d).signals
    return quality.missing_rows(s, s.select("series_id").distinct(), holidays(spark, d))


@query("C15_holiday_join", fx.sql(f"SELECT reason, count(*) AS days FROM ({MISSING}) GROUP BY 1", "signals"))
def holiday_join(spark, d):
    return missing_rows(spark, d).groupBy("reason").agg(F.count("*").alias("days"))


# D --------------------------------------------------------------------------------------------------------------------
@query(
    "D1_schema_errors",
    """SELECT series_id, 'SANE_RANGE' AS check, CAST(sum(n) AS BIGINT) AS bad_rows, string_agg(printf('%.4f', v), ', ' ORDER BY v) FILTER (i <= 5) AS named, count(*) - least(count(*), 5) AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY v) AS i FROM (SELECT concat('seg_', c_mktsegment) AS series_id, round(o_totalprice / 20 - 300, 2) AS v, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) WHERE v < -300 OR v > 10000) GROUP BY 1""",
)
def schema_errors(spark, d):
    o = fx.table(spark, d, "orders").join(fx.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    obs = o.select(F.concat(F.lit("seg_"), "c_mktsegment").alias("series_id"), binary_round(F.col("o_totalprice") / 20 - 300, 2).alias("value"))
    checks = obs.select("series_id").distinct().withColumn("check", F.lit("SANE_RANGE"))
    return quality.schema_errors(obs, checks)


REPEATS = "(SELECT file, event_type, date, round(value) AS value, min(pos) AS pos, count(*) AS n FROM " + EVENTS + " GROUP BY ALL)"


@query("D2_drop_exact_repeats", f"SELECT file, CAST(sum(n - 1) AS BIGINT) AS dropped, count(*) AS kept FROM {REPEATS} GROUP BY 1")
def drop_exact_repeats(spark, d):
    return quality.drop_exact_repeats(event_rows(spark, d).withColumn("value", F.round("value", 0)), "pos")[1]


@query(
    "D3_repeated_dates",
    f"SELECT file, max(c) AS dates, string_agg(CAST(date AS VARCHAR), ', ' ORDER BY date) AS named FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY date) AS i, count(*) OVER (PARTITION BY file) AS c FROM (SELECT file, date FROM {REPEATS} GROUP BY 1, 2 HAVING count(*) > 1)) WHERE i <= 10 GROUP BY 1",
)
def repeated_dates(spark, d):
    kept, _ = quality.drop_exact_repeats(event_rows(spark, d).withColumn("value", F.round("value", 0)), "pos")
    return quality.repeated_dates(kept)


fx.cte(
    "moves",
    """SELECT series_id, date, rn, change, z FROM (SELECT *, (x - mid) * CASE WHEN mad > 0 THEN 0.6745 / mad WHEN mean_off > 0 THEN 0.6745 / mean_off ELSE 0 END AS z FROM (
  SELECT *, median(off) OVER (PARTITION BY series_id) AS mad, avg(off) OVER (PARTITION BY series_id) AS mean_off FROM (SELECT *, abs(x - mid) AS off FROM (
    SELECT *, median(x) OVER (PARTITION BY series_id) AS mid FROM (
      SELECT series_id, date, rn, value - before AS change, CASE WHEN series_id LIKE 'ret%' AND low > 0 THEN ln(value) - ln(before) ELSE value - before END AS x FROM (
        SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY date) AS before, min(value) OVER (PARTITION BY series_id) AS low, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn FROM signals WHERE value IS NOT NULL)) WHERE x IS NOT NULL)))) WHERE abs(z) > 2.5""",
    "signals",
)


def moves(spark, d):
    s = Parts(spark, d).signals
    return quality.big_moves(s, s.select("series_id").distinct().filter(F.col("series_id").startswith("ret_")), 2.5)


@query(
    "D4_quality_summary",
    fx.sql(
        "SELECT s.series_id, count(*) AS rows, count(*) - count(DISTINCT s.date) AS duplicate_dates, count(*) FILTER (isodow(s.date) >= 6) AS weekend_rows, round((1 - count(DISTINCT CASE WHEN value IS NOT NULL THEN s.date END) / (SELECT count(DISTINCT date) FROM signals)) * 100, 6) AS missing_percent, coalesce(max(m.n), 0) AS flagged_moves, min(s.date) AS first_date, max(s.date) AS last_date FROM signals s LEFT JOIN (SELECT series_id, count(*) AS n FROM moves GROUP BY 1) m ON m.series_id = s.series_id GROUP BY 1",
        "signals", "moves",
    ),
)
def quality_summary(spark, d):
    s = Parts(spark, d).signals
    return rounded(quality.quality_summary(s, s, moves(spark, d)), "missing_percent", places=6)


@query("D6_big_moves", fx.sql("SELECT series_id, date, rn, round(change, 4) AS change, round(z, 6) AS z FROM moves", "moves"))
def big_moves(spark, d):
    return rounded(rounded(moves(spark, d), "change", places=4), "z", places=6)


@query(
    "D7_drop_rebounds",
    fx.sql(
        "SELECT series_id, date, rn, round(change, 4) AS change FROM (SELECT *, row_number() OVER (PARTITION BY series_id, chain ORDER BY rn) AS i FROM (SELECT *, sum(opens) OVER (PARTITION BY series_id ORDER BY rn) AS chain FROM (SELECT *, CASE WHEN rn = lag(rn) OVER w + 1 AND change * lag(change) OVER w < 0 THEN 0 ELSE 1 END AS opens FROM moves WINDOW w AS (PARTITION BY series_id ORDER BY rn)))) WHERE i % 2 = 1",
        "moves",
    ),
)
def drop_rebounds(spark, d):
    return rounded(quality.drop_rebounds(moves(spark, d)).select("series_id", "date", "rn", "change"), "change", places=4)


@query("D8_alignment_report", fx.sql("SELECT a.target_id, a.series_id, count(*) FILTER (a.age BETWEEN 1 AND 3 AND a.x IS NOT NULL) AS carried, count(*) FILTER (p.x IS NULL) AS excluded FROM aligned a JOIN panel p USING (target_id, series_id, rn) GROUP BY 1, 2", "aligned", "panel"))
def alignment_report(spark, d):
    p = Parts(spark, d)
    return quality.alignment_report(p.aligned, p.panel)


@query(
    "D9_coverage_by_year",
    fx.sql("SELECT u.series_id, year(u.date) AS year, round(avg(CASE WHEN s.value IS NULL THEN 1.0 ELSE 0.0 END), 8) AS missing, avg(CASE WHEN s.value IS NULL THEN 1.0 ELSE 0.0 END) > 0.2 AS over FROM (SELECT * FROM (SELECT DISTINCT date FROM cal) CROSS JOIN (SELECT DISTINCT series_id FROM signals)) u LEFT JOIN signals s ON s.series_id = u.series_id AND s.date = u.date GROUP BY 1, 2", "cal", "signals"),
)
def coverage_by_year(spark, d):
    p = Parts(spark, d)
    return rounded(quality.coverage_by_year(p.signals, p.calendar, p.signals.select("series_id").distinct()), "missing")


fx.cte("newer", "SELECT series_id, date, CASE WHEN day(date) = 7 THEN value * 1.01 ELSE value END AS value FROM signals WHERE month(date) <> 2", "signals")


@query(
    "D10_dataset_diff",
    fx.sql(
        """SELECT series_id, count(*) FILTER (shared) AS both, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS only_old, count(*) FILTER (b IS NOT NULL AND a IS NULL) AS only_new, round(avg(CASE WHEN shared THEN CASE WHEN a <> b THEN 1.0 ELSE 0.0 END END), 8) AS share_differing, round(max(abs(a - b)), 4) AS largest_gap, round(min(b / nullif(a, 0)), 8) AS least_ratio, round(max(b / nullif(a, 0)), 8) AS most_ratio, round(max(abs(move)), 4) AS largest_move_gap FROM (
  SELECT *, CASE WHEN shared THEN (a - lag(a) OVER w) - (b - lag(b) OVER w) END AS move FROM (SELECT coalesce(o.series_id, n.series_id) AS series_id, coalesce(o.date, n.date) AS date, o.value AS a, n.value AS b, o.value IS NOT NULL AND n.value IS NOT NULL AS shared FROM signals o FULL JOIN newer n ON n.series_id = o.series_id AND n.date = o.date) WINDOW w AS (PARTITION BY series_id, shared ORDER BY date)) GROUP BY 1""",
        "signals", "newer",
    ),
)
def dataset_diff(spark, d):
    s = fx.exact_signals(spark, d)
    newer = s.filter(F.month("date") != 2).withColumn("value", F.when(F.dayofmonth("date") == 7, F.col("value") * 1.01).otherwise(F.col("value")))
    return rounded(rounded(quality.dataset_diff(s, newer), "share_differing", "least_ratio", "most_ratio"), "largest_gap", "largest_move_gap", places=4)


# N, P -----------------------------------------------------------------------------------------------------------------
def candle_sql(period: str) -> str:
    return f"""SELECT series_id, period_start, open, greatest(top, open) AS high, least(bottom, open) AS low, close, volume FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY series_id ORDER BY period_start), first) AS open FROM (
  SELECT event_type AS series_id, CAST(date_trunc('{period}', ts) AS DATE) AS period_start, arg_min(value, (ts, value)) AS first, max(value) AS top, min(value) AS bottom, arg_max(value, (ts, value)) AS close, count(*) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2))"""


def ticks(spark, d):
    return fx.table(spark, d, "events").select(F.col("event_type").alias("series_id"), "ts", "value")


@query("N1_candles_day", candle_sql("day"))
def candles_day(spark, d):
    return resample.candles(ticks(spark, d), "day")


@query("N1_candles_week", candle_sql("week"))
def candles_week(spark, d):
    return resample.candles(ticks(spark, d), "week")


@query("N2_latest_bar", "SELECT event_type AS series_id, CAST(ts - INTERVAL 5 HOUR AS DATE) AS period_start, arg_max(value, (ts, value)) AS close, max(ts) AS filed FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def latest_bar(spark, d):
    return resample.latest_bar(ticks(spark, d).withColumnRenamed("value", "close"), "day", "-05:00")


@query(
    "N3_downsample_minmax",
    fx.sql(
        "SELECT series_id, date, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY series_id, st ORDER BY value DESC, i) AS up, row_number() OVER (PARTITION BY series_id, st ORDER BY value, i) AS down FROM (SELECT *, i * 20 // n AS st FROM (SELECT series_id, date, round(value, 6) AS value, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM signals))) WHERE up = 1 OR down = 1 OR i = 0 OR i = n - 1",
        "signals",
    ),
)
def downsample_minmax(spark, d):
    return rounded(resample.downsample_minmax(rounded(Parts(spark, d).signals, "value", places=6), 20), "value", places=4)


@query(
    "N4_downsample_even",
    fx.sql(
        "SELECT series_id, date, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, i) AS up, row_number() OVER (PARTITION BY series_id ORDER BY value, i) AS down FROM (SELECT series_id, date, round(value, 6) AS value, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM signals)) WHERE up = 1 OR down = 1 OR n <= 50 OR i = 0 OR i * 49 // greatest(n - 1, 1) > (i - 1) * 49 // greatest(n - 1, 1)",
        "signals",
    ),
)
def downsample_even(spark, d):
    return rounded(resample.downsample_even(rounded(Parts(spark, d).signals, "value", places=6), 50), "value", places=4)


@query(
    "N5_top_flags",
    fx.sql("SELECT series_id, string_agg(CAST(date AS VARCHAR), ', ' ORDER BY date) AS named, max(n) - count(*) AS more FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM moves) WHERE i <= 5 GROUP BY 1", "moves"),
)
def top_flags(spark, d):
    return resample.top_flags(moves(spark, d).select("series_id", "date"), 5)


def date_sets(spark, d):
    p = Parts(spark, d).prices
    return resample.calendar_sets(p.filter(F.col("target_id") == fx.EQUITY).select("date"), p.filter(F.col("target_id") == fx.BOND).select("date"))


for _name, _word in (("union", "UNION"), ("intersect", "INTERSECT"), ("except", "EXCEPT")):
    query(f"N6_calendar_{_name}", fx.sql(f"SELECT date FROM prices WHERE target_id = '{fx.EQUITY}' {_word} SELECT date FROM prices WHERE target_id = '{fx.BOND}'", "prices"))(lambda spark, d, n=_name: date_sets(spark, d)[n])


@query("P1_stream_candles", candle_sql("day"))
def stream_candles(spark, d):
    """Streams the events through the candle job in three parts, with late events that amend a bar of the part before, and
    reads the bars as N1 gives them."""
    from panelcast.streaming import candles

    e = fx.table(spark, d, "events").select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    # every tenth event arrives half a day late, so it may come with the next part
    arrival = F.col("ts") + F.when(F.col("event_id") % 10 == 0, F.expr("INTERVAL 12 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    first = e.agg(F.min("ts").alias("opened"))
    parts = e.withColumn("arrival", arrival).crossJoin(first).withColumn("part", F.least(F.floor(F.datediff("arrival", "opened") / 10), F.lit(2)))
    source, out, state = (shared_path(spark, n) for n in ("ticks", "bars", "stream"))
    parts.filter("part < 0").select("series_id", "ts", "value").write.parquet(source)
    run = candles.write_candles(candles.stream_candles(spark.readStream.schema("series_id string, ts timestamp, value double").parquet(source), "1 day", "1 day"), out, state)
    try:
        for n in range(3):
            parts.filter(F.col("part") == n).select("series_id", "ts", "value").write.mode("append").parquet(source)
            run.processAllAvailable()
    finally:
        run.stop()
    bars = candles.read_candles(spark, out)
    return bars.withColumn("period_start", F.col("period_start").cast("date"))
