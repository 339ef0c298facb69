"""Means whose last place shows in a result: the order of rows must not."""

import duckdb
import pytest
from pyspark.sql import functions as F
from rows import canonical

import panelcast.catalog as catalog
from panelcast.plans import fixtures as fx
from panelcast.sources import exports

SF = "/root/testdata/sf0.1"
#: Days on which the mean discount of sf0.1 is half-way between two texts of six places.
TIED = ("1996-02-07", "1997-11-15", "1998-09-30", "1999-02-25", "1999-05-29", "1999-11-29", "2000-03-20", "2000-04-21", "2000-08-22", "2000-12-08")
PARTS = (1, 4, 7)


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """The tied days' line items in several numbers of files, so that their sums are made in parts; the other tables as they are."""
    items = spark.read.parquet(f"{SF}/lineitem.parquet").filter(F.col("l_shipdate").cast("date").cast("string").isin(*TIED))
    paths = []
    for n in PARTS:
        paths.append(str(tmp_path_factory.mktemp("tied")))
        items.repartition(n).write.parquet(f"{paths[-1]}/lineitem.parquet")
        for t in ("orders", "customer"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{paths[-1]}/{t}.parquet")
    return paths


def from_sql(name):
    """The query's SQL over the tied days in the order of the table."""
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet' WHERE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) IN {TIED}")
    for t in ("orders", "customer"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return canonical(c.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["A7_dataset_hash", "A8_dataset_fingerprint"])
def test_order_of_rows_does_not_show(spark, tied, name):
    want = from_sql(name)
    for path in tied:
        assert canonical(catalog.queries()[name](spark, path).toPandas()) == want


def test_plain_means_where_there_are_more_decimals(spark):
    rows = [("cents", 0.1), ("cents", 0.2), ("cents", None), ("more", 0.125), ("more", 0.25), ("none", None), ("odd", float("nan")), ("odd", 1.0), ("large", 1e300), ("large", 1e300)]
    got = {r["k"]: r["m"] for r in spark.createDataFrame(rows, "k string, v double").groupBy("k").agg(fx.exact_mean("v").alias("m")).collect()}
    assert got["cents"] == 0.15 and got["more"] == 0.1875 and got["none"] is None and got["odd"] != got["odd"] and got["large"] == 1e300


def test_texts_of_values_half_way(spark):
    cases = {0.0478125: "0.047812", -0.0478125: "-0.047812", 0.0000015: "0.000001", 0.0478126: "0.047813", 1.0: "1.000000", -0.0: "-0.000000", 123456.0000005: "123456.000000", 1e25: "10000000000000000000000000.000000", None: None}
    rows = spark.createDataFrame([(v,) for v in cases], "value double").select("value", exports._six_places("value").alias("t")).collect()
    assert [(r["value"], r["t"]) for r in rows] == list(cases.items())


def test_largest_gap_of_many_copies(spark, tmp_path):
    """The largest gap of seg_HOUSEHOLD at sf0.1 is half-way between two results, 3271.94325: sums of copies do not move it."""
    day = spark.read.parquet(f"{SF}/orders.parquet").filter("CAST(o_orderdate AS DATE) = DATE '1999-11-07'")
    for n, name in ((1, "one"), (600, "many")):
        d = str(tmp_path / name)
        day.crossJoin(spark.range(n)).drop("id").coalesce(1).sortWithinPartitions("o_totalprice").write.parquet(f"{d}/orders.parquet")
        spark.read.parquet(f"{SF}/customer.parquet").write.parquet(f"{d}/customer.parquet")
        spark.read.parquet(f"{SF}/lineitem.parquet").limit(1).write.parquet(f"{d}/lineitem.parquet")
        got = {r["series_id"]: r["largest_gap"] for r in catalog.queries()["D10_dataset_diff"](spark, d).collect()}
        assert got["seg_HOUSEHOLD"] == 3271.9433


def test_values_that_print_as_half_way(spark, oracle):
    """At sf0.1 some prices, scaled, print as half-way between two cents but are not."""
    got = catalog.queries()["D1_schema_errors"](spark, SF).toPandas()
    assert canonical(got) == canonical(oracle(catalog.oracle_sql()["D1_schema_errors"], "sf0.1"))
