"""Views of the provided tables that play the library's inputs, as DataFrames and as SQL text.

SQL pieces are named common table expressions; ``sql`` joins the needed ones, in order, with a final select.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HORIZON = 5
TRAIN, TEST, EMBARGO, TUNING = 504, 20, 20, 504
EQUITY, BOND = "1-URGENT", "5-LOW"
EQUITY_BPS, BOND_BPS = 3.0, 5.0

CTE: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}


def cte(name: str, text: str, *needs: str) -> None:
    CTE[name], NEEDS[name] = text, needs


def sql(select: str, *needs: str) -> str:
    """``select`` with all CTEs that it needs, each after those it needs itself."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS[name]:
            visit(n)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    return ("WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n" if order else "") + select


cte("prices", "SELECT o_orderpriority AS target_id, CAST(o_orderdate AS DATE) AS date, 100 + avg(o_totalprice) / 100000 AS price FROM orders GROUP BY 1, 2")
cte(
    "signals",
    """SELECT concat('ret_', l_returnflag) AS series_id, CAST(l_shipdate AS DATE) AS date, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2
UNION ALL SELECT concat('disc_', l_linestatus), CAST(l_shipdate AS DATE), CAST(avg(l_discount) AS DOUBLE) FROM lineitem GROUP BY 1, 2
UNION ALL SELECT concat('seg_', c_mktsegment), CAST(o_orderdate AS DATE), CAST(avg(o_totalprice) AS DOUBLE) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
)
cte("cal", "SELECT target_id, date, price, row_number() OVER (PARTITION BY target_id ORDER BY date) AS rn FROM prices WHERE price IS NOT NULL", "prices")
cte("pairs", "SELECT DISTINCT p.target_id, s.series_id FROM (SELECT DISTINCT target_id FROM prices) p CROSS JOIN (SELECT DISTINCT series_id FROM signals) s", "prices", "signals")
cte(
    "aligned",
    """SELECT target_id, series_id, date, rn, CASE WHEN rn - oc <= 3 THEN ov END AS x, rn - oc AS age FROM (
  SELECT *, last_value(value IGNORE NULLS) OVER w AS ov, last_value(CASE WHEN value IS NOT NULL THEN ncal END IGNORE NULLS) OVER w AS oc FROM (
    SELECT *, coalesce(max(rn) OVER w, 0) AS ncal FROM (
      SELECT p.target_id, p.series_id, c.date, c.rn, CAST(NULL AS DOUBLE) AS value FROM cal c JOIN pairs p ON p.target_id = c.target_id
      UNION ALL SELECT p.target_id, p.series_id, s.date, NULL, s.value FROM signals s JOIN pairs p ON p.series_id = s.series_id) u
    WINDOW w AS (PARTITION BY target_id, series_id ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) v
  WINDOW w AS (PARTITION BY target_id, series_id ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) z
WHERE rn IS NOT NULL""",
    "cal", "pairs", "signals",
)
cte(
    "moved",
    """SELECT target_id, series_id, date, rn, age, x AS level, CASE WHEN series_id LIKE 'disc%' THEN x
  WHEN series_id LIKE 'ret%' THEN CASE WHEN x > 0 AND lag(x) OVER w > 0 THEN ln(x) - ln(lag(x) OVER w) END
  ELSE x - lag(x) OVER w END AS t FROM aligned WINDOW w AS (PARTITION BY target_id, series_id ORDER BY rn)""",
    "aligned",
)
cte("panel", "SELECT target_id, series_id, date, rn, lag(t) OVER (PARTITION BY target_id, series_id ORDER BY rn) AS x FROM moved", "moved")
cte(
    "labels",
    f"SELECT target_id, rn, date, price, lead(price, {HORIZON}) OVER w / price - 1 AS y, lead(date, {HORIZON}) OVER w AS label_end FROM cal WINDOW w AS (PARTITION BY target_id ORDER BY rn)",
    "cal",
)
cte(
    "folds",
    f"""SELECT target_id, fold_id, lo - {EMBARGO} - {TRAIN} AS train_lo, lo - 1 - {EMBARGO} AS train_hi, lo AS test_lo, lo + {TEST} - 1 AS test_hi FROM (
  SELECT target_id, unnest(range(n_folds)) AS fold_id, {max(TRAIN, TUNING) + EMBARGO} + 1 + {TEST} * unnest(range(n_folds)) AS lo FROM (
    SELECT target_id, greatest((count(*) - {max(TRAIN, TUNING) + EMBARGO}) // {TEST}, 0) AS n_folds FROM cal GROUP BY 1))""",
    "cal",
)
cte(
    "purged",
    f"""SELECT f.target_id, f.fold_id, f.train_lo, least(f.train_hi, f.test_lo - 1 - {HORIZON}, coalesce(min(l.rn) FILTER (l.label_end >= t.date) - 1, f.train_hi)) AS train_hi, f.test_lo, f.test_hi
FROM folds f JOIN cal t ON t.target_id = f.target_id AND t.rn = f.test_lo JOIN labels l ON l.target_id = f.target_id AND l.rn BETWEEN f.train_lo AND f.train_hi
GROUP BY f.target_id, f.fold_id, f.train_lo, f.train_hi, f.test_lo, f.test_hi""",
    "folds", "cal", "labels",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("target_id"), F.col("o_orderdate").cast("date").alias("date")).agg((100 + F.avg("o_totalprice") / 100000).alias("price"))


def exact_mean(c: str) -> Column:
    """The mean of amounts with two decimals, from their sum in whole hundredths: the order of rows does not show in it. Of
    other numbers, the plain mean."""
    hundredths = F.when(F.abs(c) < 1e13, F.floor(F.col(c) * 100 + 0.5))
    fits = F.col(c).isNull() | F.coalesce(hundredths / 100 == F.col(c), F.lit(False))
    return F.coalesce(F.when(F.bool_and(fits), F.try_divide(F.try_sum(hundredths), F.count(c) * 100)), F.avg(c))


def signals(spark: SparkSession, sf_dir: str, mean: Callable[[str], Column] = F.avg) -> DataFrame:
    items, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    shipped = F.col("l_shipdate").cast("date").alias("date")
    quantity = items.groupBy(F.concat(F.lit("ret_"), "l_returnflag").alias("series_id"), shipped).agg(F.sum("l_quantity").cast("double").alias("value"))
    discount = items.groupBy(F.concat(F.lit("disc_"), "l_linestatus").alias("series_id"), shipped).agg(mean("l_discount").cast("double").alias("value"))
    sold = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    segment = sold.groupBy(F.concat(F.lit("seg_"), "c_mktsegment").alias("series_id"), F.col("o_orderdate").cast("date").alias("date")).agg(mean("o_totalprice").cast("double").alias("value"))
    return quantity.unionByName(discount).unionByName(segment)


def exact_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``signals`` for results that show the last place of a mean, such as hashes of its text."""
    return signals(spark, sf_dir, exact_mean)


def transforms(signals: DataFrame) -> DataFrame:
    kind = F.when(F.col("series_id").startswith("ret_"), "LOG_RETURN").when(F.col("series_id").startswith("disc_"), "LEVEL").otherwise("DIFFERENCE")
    return signals.select("series_id").distinct().withColumn("transform", kind)


def pairs(prices: DataFrame, signals: DataFrame) -> DataFrame:
    """Every target with every series: two dimension tables."""
    return prices.select("target_id").distinct().crossJoin(signals.select("series_id").distinct())
